"""Secrets, with multipart credential linking, on DataFrame and SQL functions alone.

Strict patterns give base spans. Weak patterns give parts of credentials that mean little alone: identifiers, secret-like
values and endpoints. A weak identifier or secret is reported only where a complementary part lies within reach and in the
same scope (text without a blank line); parts are linked by an interval join on scope and position bin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclake.llm.common import materialise
from srclake.llm.native import counts_before, let, matches, no_spans, written

#: Kinds, in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex")
ASSIGN, ACCESS, HEX = range(3)
#: Roles of parts.
IDENTIFIER, SECRET, ENDPOINT = range(3)

STRICT = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)",
    r"AKIA[A-Z0-9]++",
    r"(?<![0-9a-f])[0-9a-f]{32,}+",
)
#: A text without this has no match of the kind.
NEEDS = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", r"AKIA", r"[0-9a-f]{32}")
ROLE = (SECRET, IDENTIFIER, SECRET)

#: Weak parts: pattern, what a text must hold, role, and the kind it is reported as (endpoints are not reported).
WEAK = (
    (r"(?<![A-Za-z0-9_])(?i:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,}+)", r"(?i:user|login|client|account|access)[A-Za-z_]*[\"']?\x20*[:=]", IDENTIFIER, ACCESS),
    (r"(?<![A-Za-z0-9_])(?i:pwd|pass|passphrase|auth|credential|private_?key|signature)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{6,}+)", r"(?i:pwd|pass|auth|credential|key|signature)[\"']?\x20*[:=]", SECRET, ASSIGN),
    (r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]{0,39}[0-9])(?=[a-z0-9+/]{0,39}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", r"[A-Za-z0-9+/]{40}", SECRET, ASSIGN),
    (r"(?:https?|ftp|ssh|jdbc:[a-z]{2,12}|amqp|postgres(?:ql)?|mysql|mongodb|redis)://[A-Za-z0-9._:@/-]++|(?<![A-Za-z0-9_])(?i:host|endpoint|server|url)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._:/-]{4,}+", r"://|(?i:host|endpoint|server|url)[\"']?\x20*[:=]", ENDPOINT, None),
)
#: Code points between the end of one part and the start of another that are linked, at most.
REACH = 300
_SPANS = "array<struct<start:bigint,end:bigint,kind:int>>"


def _strict(text: Column) -> Column:
    """array<struct<start, end, kind int>> of base spans."""
    out = []
    for kind, (pattern, need) in enumerate(zip(STRICT, NEEDS)):
        found = F.when(text.rlike(need), matches(text, pattern, 1 if kind == ASSIGN else None)).otherwise(no_spans())
        if kind == ASSIGN:
            found = F.filter(found, lambda m: F.length(m["part"]) >= 8)
        if kind == ACCESS:
            found = F.filter(found, lambda m: m["end"] - m["start"] >= 16)
        out.append(F.transform(found, _of_kind(kind)))
    return F.concat(*out)


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"], m["end"], F.lit(kind).alias("kind"))


def _of_role(role: int, kind: int | None) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"], m["end"], F.lit(role).alias("role"), F.lit(kind).cast("int").alias("kind"))


def _weak(text: Column) -> Column:
    """array<struct<start, end, role int, kind int>> of weak parts."""
    found = lambda pattern, need: F.when(text.rlike(need), matches(text, pattern)).otherwise(no_spans())
    return F.concat(*[F.transform(found(pattern, need), _of_role(role, kind)) for pattern, need, role, kind in WEAK])


def _apart(weak: Column, base: Column) -> Column:
    """Weak parts that overlap no base span."""
    return F.filter(weak, lambda s: ~F.exists(base, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def _scoped(text: Column, base: Column, weak: Column) -> Column:
    """array<struct<start, end, role, kind, strong, scope>>: all parts, with the number of blank lines before each."""
    role = lambda s: F.when(s["kind"] == ACCESS, IDENTIFIER).otherwise(SECRET)
    strong = F.transform(base, lambda s: F.struct(s["start"], s["end"], role(s).alias("role"), s["kind"], F.lit(True).alias("strong")))
    parts = F.concat(F.transform(weak, lambda s: F.struct(s["start"], s["end"], s["role"], s["kind"], F.lit(False).alias("strong"))), strong)
    blanks = F.transform(matches(text, r"\n[\x20\t\r]*+\n"), lambda m: m["start"])
    scopes = lambda p: let(counts_before(F.transform(p, lambda s: s["start"]), blanks), lambda n: F.transform(p, lambda s, i: F.struct(s["start"], s["end"], s["role"], s["kind"], s["strong"], n[i].alias("scope"))))
    return let(parts, scopes)


def _parts(rows: DataFrame) -> DataFrame:
    """Replaces text in rows(text, ...) by base and parts; parts are there only in rows with a weak part to report."""
    rows = rows.withColumn("base", _strict(F.col("text"))).withColumn("weak", _weak(F.col("text")))
    rows = rows.withColumn("weak", _apart(F.col("weak"), F.col("base")))
    some = F.exists("weak", lambda s: s["kind"].isNotNull())
    return rows.withColumn("parts", F.when(some, _scoped(F.col("text"), F.col("base"), F.col("weak")))).drop("text", "weak")


def _linked(rows: DataFrame, *key: str) -> DataFrame:
    """(*key, added): of rows(*key, parts), the weak parts, as spans, for which a part with another role is in reach and in
    the same scope.

    A part is in all bins, REACH wide, that it touches, and a weak part looks into those within reach of it: an interval join
    as an equi join. Bins hold few parts whatever the document's length, and a left semi join gives no pairs."""
    parts = rows.where("parts is not null").select(*key, F.explode("parts").alias("p")).select(*key, "p.*")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / REACH), F.floor(b / REACH))).alias("bin")
    weak = parts.where("not strong and kind is not null").select("*", bins(F.col("start") - REACH, F.col("end") + REACH))
    other = parts.select(*[F.col(k).alias(f"o_{k}") for k in (*key, "scope", "start", "end", "role")], bins(F.col("start"), F.col("end")).alias("o_bin"))
    same = [F.col(k) == F.col(f"o_{k}") for k in (*key, "scope", "bin")]
    near = (F.col("o_start") - F.col("end") <= REACH) & (F.col("start") - F.col("o_end") <= REACH) & (F.col("role") != F.col("o_role"))
    on = near
    for c in same:
        on = c & on
    return weak.join(other, on, "left_semi").groupBy(*key).agg(F.collect_set(F.struct("start", "end", "kind")).alias("added"))  # of one document


def _with_added(rows: DataFrame, *key: str) -> DataFrame:
    joined = rows.join(materialise(_linked(rows, *key), "linked"), list(key), "left")
    return joined.select(*key, "base", F.concat("base", F.coalesce("added", F.array().cast(_SPANS))).alias("spans"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): for each row of docs(doc_id, text, ...) its base spans and all its spans, both as
    array<struct<start, end, kind int>>, in code points, end exclusive; kind is a place in KINDS.

    Null text is empty; texts without spans have empty arrays; a very long text is scanned whole, and its parts meet by bins.
    Rows stay as they are, repeated or not, each scanned and linked for itself; other columns are ignored; empty input gives
    an empty result. Only spans are stored, and only those of rows with a weak part are shuffled.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = materialise(_parts(rows), "parts")  # once, so that row numbers stay
    return rows.select("uid", "doc_id").join(_with_added(rows.drop("doc_id"), "uid"), "uid").select("doc_id", "base", "spans")


def _covered(spans: Column) -> Column:
    """Disjoint (start, end) that cover the same places, in order."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(ordered, F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text replaced by `mark`, touching and overlapping ones together; n_chars, if there, is the
    length of the new text. All rows and columns stay, null text stays null, rows without secrets stay as they are; other
    columns may have any names.

    Spans depend on the text alone, so they are found once for each different text that has some, by two hashes of it, and
    meet the documents by them; what is stored is spans, not texts."""
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("2"), "text").alias("k2")]
    rows = _parts(docs.where("text is not null").select(F.col("text").cast("string").alias("text")).select(*key, "text"))
    rows = materialise(rows, "parts").where("size(base) > 0 or parts is not null")  # stored first, so that spans are found once
    rows = materialise(rows.groupBy("k1", "k2").agg(F.first("base").alias("base"), F.first("parts").alias("parts")), "texts")
    cuts = _with_added(rows, "k1", "k2").select("k1", "k2", _covered(F.col("spans")).alias("cut")).where("size(cut) > 0")
    text = F.col("doc")["text"].cast("string")
    found = docs.select(F.struct("*").alias("doc")).select("doc", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("2"), text).alias("k2"))
    found = found.join(materialise(cuts, "cuts"), ["k1", "k2"], "left")
    begin = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(F.col("cut"), i - 1)["end"])
    piece = lambda c, i: F.substring(text, (begin(i) + 1).cast("int"), (c["start"] - begin(i)).cast("int"))
    tail = F.substring(text, (F.element_at("cut", -1)["end"] + 1).cast("int"), F.lit(2**31 - 1))
    clean = F.concat(F.array_join(F.transform("cut", lambda c, i: F.concat(piece(c, i), F.lit(mark))), ""), tail)
    found = found.withColumn("clean", F.when(F.col("cut").isNotNull(), clean))
    new = {"text": lambda t: F.col("clean").cast(t), "n_chars": lambda t: F.length("clean").cast(t)}
    columns = [F.when(F.col("cut").isNull(), F.col("doc")[c]).otherwise(new[c](t)).alias(c) if c in new else F.col("doc")[c].alias(c) for c, t in docs.dtypes]
    return found.select(*columns)


def digest_columns(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(written(F.col("base"), KINDS), 256).alias("base_sha256"), written(F.col("spans"), KINDS).alias("spans"))
