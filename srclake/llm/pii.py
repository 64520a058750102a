"""Personal data by weak supervision, on DataFrame and SQL functions alone.

Strict patterns give base spans, loose ones give candidates. Labelers (form, gazetteer, context, company, shape) vote on
each span: 1 for, -1 against, 0 no opinion; none of them knows which of the two a span is. Expectation-maximisation over the
counts of vote patterns, of which there is a fixed number at most whatever the corpus, estimates each labeler's
reliabilities. The posteriors are the soft labels on which a logistic span classifier is trained, which also sees signs of
the span and its context that no labeler votes by. Base spans stay; candidates stay if the classifier says so. Both fits are
array expressions over one row of counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclake.llm.common import materialise
from srclake.llm.native import let, matches, no_spans, total, written

#: Kinds, in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Strict patterns. Possessive quantifiers and the conditions on where a match may start change no match; they keep long runs
#: of the same characters linear.
STRICT = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Loose patterns, of what the strict ones miss: spelled-out addresses, addresses of eight groups, grouped numbers without
#: a country code.
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    r"(?<![0-9.-])[0-9]{4}(?:[.\x20/][0-9]{4}){3}(?![0-9.-])",
    r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
)
#: A text without this has no match of the kind.
NEEDS = ("@", ".", r"[0-9]", "+")
LOOSE_NEEDS = (r"[\[({]at[\])}]", r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"[0-9]{4}[.\x20/][0-9]{4}", r"[0-9]{3}[.-][0-9]{4}")

#: Forms, as patterns for each kind that well-formed values match, however they are spelled.
FORM = (
    r"^[A-Za-z0-9](?:[A-Za-z0-9]|[._%+-](?=[A-Za-z0-9])){0,63}\x20?(?:@|\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9][A-Za-z0-9.\x20()\[\]{}-]*[A-Za-z]{2}$",
    r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})$",
    r"^(?:[0-9]{12,19}|[0-9]{4}(?:[\x20./-][0-9]{4}){2,3}(?:[\x20./-][0-9]{1,3})?|[0-9]{4}[\x20./-][0-9]{6}[\x20./-][0-9]{5})$",
    r"^\+?(?:[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,5}){1,4}$",
)
#: Gazetteers, as patterns that a span of the kind matches: top-level domains, reserved networks, issuers, country codes.
KNOWN = (
    r"(?i)(?:\.|dot[\])}]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|pt|mx|ar)$",
    r"^(?!(?:0|10|127|169\.254|192\.168|22[4-9]|2[3-5][0-9])\.)",
    r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9]))",
    r"^(?:\+(?:1|2[07]|3[0-69]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|\(?[2-9][0-9]{2})",
)
#: Words of the forty characters before a span that speak for or against its kind.
CUES = (
    r"(?i)(?:mail|contact|write|schreib|courriel|correo|contacto|kontakt)",
    r"(?i)(?:\bip\b|host|server|address|adresse|direcci|login from|serveur|servidor)",
    r"(?i)(?:card|visa|master|payment|credit|karte|carte|tarjeta|zahlung|paiement)",
    r"(?i)(?:call|phone|tel|fax|mobil|anruf|appel|llam)",
)
AGAINST = r"(?i)(?:version|\bv\.?|section|isbn|serial|order|invoice|chapter|release|build|part no)[\s:#.]*$"
#: Given names and forms of address: a person is spoken of.
PERSON = (
    r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Se\u00f1or|Se\u00f1ora|Sr|Sra|"
    r"Adam|Alex|Alice|Amir|Ana|Andrea|Anna|Antonio|Ben|Carlos|Carmen|Charlotte|Chen|Claire|Clara|Daniel|David|Elena|Emily|Emma|Eric|Eva|Fatima|Felix|"
    r"Fran\u00e7ois|George|Hannah|Hans|Helen|Henry|Ivan|Jack|James|Jan|Jean|Jos\u00e9|John|Juan|Julia|Karl|Kate|Laura|Lea|Leon|Li|Lisa|Louis|Luc|Lucas|Luis|"
    r"Manuel|Maria|Marie|Mark|Martin|Mary|Max|Michael|Mohammed|Nina|Noah|Olivia|Omar|Oscar|Paul|Pedro|Peter|Pierre|Robert|Rosa|Sara|Sarah|Sofia|Sophie|"
    r"Stefan|Susan|Thomas|Tom|Victor|Wang|William|Yusuf|Zhang)\b"
)
BEFORE, NEAR = 40, 200
#: Votes of a span; signs of a span and its context beside the votes; the classifier's features: a constant, kinds, votes for
#: and against by labeler, and signs.
LABELERS, SIGNS = 5, 6
FEATURES = 1 + len(KINDS) + 2 * LABELERS + SIGNS
EM_ROUNDS, FIT_ROUNDS, RATE = 25, 150, 2.0


def _luhn(digits: Column) -> Column:
    """Digits as a string of 19 at most."""
    n = F.length(digits)
    doubled = lambda d: d - F.when(d > 9, 9).otherwise(0)
    each = F.transform(F.split(digits, ""), lambda c, i: let(c.cast("int"), lambda d: F.when((n - i) % 2 == 0, doubled(d * 2)).otherwise(d).cast("long")))
    return total(each) % 10 == 0


def _valid(kind: int, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == IP:
        return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    if kind == CARD:
        return let(digits, lambda d: F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == PHONE:
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _checked(kind: int) -> Callable[[Column], Column]:
    return lambda m: _valid(kind, m["value"])


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda m: F.struct(m["start"], m["end"], F.lit(kind).alias("kind"), m["value"])


def _spans(text: Column, patterns: tuple[str, ...], needs: tuple[str, ...], strict: bool) -> Column:
    """array<struct<start, end, kind int, value>> of all kinds."""
    out = []
    for kind, (pattern, need) in enumerate(zip(patterns, needs)):
        has = text.contains(need) if len(need) == 1 else text.rlike(need)
        found = F.when(has, matches(text, pattern)).otherwise(no_spans())
        if strict or kind == CARD:
            found = F.filter(found, _checked(kind))
        out.append(F.transform(found, _of_kind(kind)))
    return F.concat(*out)


def _context(text: Column, span: Column) -> Column:
    """The BEFORE characters in front of a span."""
    return F.substring(text, F.greatest(span["start"] + 1 - BEFORE, F.lit(1)).cast("int"), F.least(span["start"], F.lit(BEFORE)).cast("int"))


def _signs(context: Column, value: Column) -> Column:
    """array<boolean> of SIGNS."""
    return F.array(
        context.rlike(r"[:=]\s*$"),
        context.rlike(r"(?:^|\n|[<(\[\"'])$"),
        context.rlike(PERSON),
        value.rlike("[A-Za-z]"),
        value.rlike(r"(?:[0-9][^0-9]*+){10}"),
        value.rlike(r"[\x20()]"),
    )


def _votes(context: Column, span: Column, starts: Column) -> Column:
    """array<int> of LABELERS votes. starts: of all base spans of the text, in order."""
    pick = lambda table: F.get(F.array(*[F.lit(x) for x in table]), span["kind"])
    sign = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    company = F.exists(starts, lambda o: (o != span["start"]) & (F.abs(o - span["start"]) <= NEAR))
    dull = digits.rlike(r"^(?:([0-9])\1*|0?123456[0-9]*)$")
    return F.array(
        F.when(_rlike(span["value"], pick(FORM)), 1).otherwise(-1),
        F.when(_rlike(span["value"], pick(KNOWN)), 1).otherwise(-1),
        sign(_rlike(context, pick(CUES)), context.rlike(AGAINST)),
        F.when(company, 1).otherwise(0),
        sign(F.length(digits).between(4, 15) & ~dull, dull),
    )


def _rlike(value: Column, pattern: Column) -> Column:
    return F.regexp_like(value, pattern)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, loose): spans(start, end, kind, votes, signs) of each row of docs; loose ones overlap no base span."""
    starts = lambda: F.transform("base", lambda o: o["start"])

    def judged(s: Column) -> Column:
        return let(_context(F.col("text"), s), lambda c: F.struct(s["start"], s["end"], s["kind"], _votes(c, s, starts()).alias("votes"), _signs(c, s["value"]).alias("signs")))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", _spans(F.col("text"), STRICT, NEEDS, True))
    rows = rows.withColumn("loose", _spans(F.col("text"), LOOSE, LOOSE_NEEDS, False))
    free = F.filter("loose", lambda s: ~F.exists("base", lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))
    return rows.select("doc_id", F.transform("base", judged).alias("base"), F.transform(free, judged).alias("loose"))


def _patterns(found: DataFrame) -> DataFrame:
    """One row: p, the different (kind, votes, signs) with their counts, 4 * 3 ** LABELERS * 2 ** SIGNS at most."""
    spans = found.select(F.explode(F.concat("base", "loose")).alias("s"))
    counts = spans.groupBy("s.kind", "s.votes", "s.signs").agg(F.count("*").cast("double").alias("n"))
    return counts.agg(F.array_sort(F.collect_list(F.struct("kind", "votes", "signs", "n"))).alias("p"))


def _posterior(p: Column, theta: Column) -> Column:
    """P(personal | votes) of a pattern. theta: the share of personal spans, then by labeler, class and vote."""
    at = lambda y, v, i: F.get(theta, (1 + i * 6 + y * 3 + v + 1).cast("int"))
    like = lambda y: F.aggregate(F.transform(p["votes"], lambda v, i: at(y, v, i)), F.lit(1.0), lambda a, x: a * x)
    one, zero = F.get(theta, F.lit(0)) * like(1), (1 - F.get(theta, F.lit(0))) * like(0)
    return one / (one + zero)


def _em(p: Column) -> Column:
    """The reliabilities theta after EM_ROUNDS rounds. To begin with, a vote is right four times in five."""
    first = [0.8] + [x for _ in range(LABELERS) for x in (0.5, 0.3, 0.2, 0.1, 0.3, 0.6)]

    def step(theta: Column, _: Column) -> Column:
        scored = F.transform(p, lambda x: F.struct(x["votes"], (x["n"] * _posterior(x, theta)).alias("one"), x["n"]))

        def update(s: Column) -> Column:
            add = lambda f: F.aggregate(s, F.lit(0.0), lambda a, x: a + f(x))
            one, n = add(lambda x: x["one"]), add(lambda x: x["n"])

            def cell(k: Column) -> Column:
                i, y, v = F.floor(k / 6).cast("int"), F.floor(k / 3).cast("int") % 2, k % 3 - 1
                weight = lambda x: F.when(y == 1, x["one"]).otherwise(x["n"] - x["one"])
                return (add(lambda x: F.when(F.get(x["votes"], i) == v, weight(x)).otherwise(0.0)) + 1.0) / (F.when(y == 1, one).otherwise(n - one) + 3.0)

            return F.concat(F.array((one + 4.0) / (n + 5.0)), F.transform(F.sequence(F.lit(0), F.lit(6 * LABELERS - 1)), cell))

        return let(scored, update)

    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), F.array(*[F.lit(x) for x in first]), step)


def _features(kind: Column, votes: Column, signs: Column) -> Column:
    """FEATURES numbers: 1; a one for the kind; for each vote, whether it is for and whether it is against; the signs."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.concat(
        F.array(F.lit(1.0)),
        F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k: flag(k == kind)),
        F.transform(votes, lambda v: flag(v > 0)),
        F.transform(votes, lambda v: flag(v < 0)),
        F.transform(signs, flag),
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _fit(p: Column, theta: Column) -> Column:
    """Weights of the logistic classifier on the posteriors, by FIT_ROUNDS steps of gradient descent."""
    rows = F.transform(p, lambda x: F.struct(_features(x["kind"], x["votes"], x["signs"]).alias("x"), _posterior(x, theta).alias("q"), x["n"]))

    def fit(r: Column) -> Column:
        n = F.aggregate(r, F.lit(0.0), lambda a, x: a + x["n"])

        def step(w: Column, _: Column) -> Column:
            errors = F.transform(r, lambda x: F.struct(x["x"], (x["n"] * (_sigmoid(_dot(w, x["x"])) - x["q"])).alias("e")))
            gradient = F.aggregate(errors, F.array_repeat(F.lit(0.0), FEATURES), lambda g, e: F.zip_with(g, e["x"], lambda a, b: a + b * e["e"]))
            return F.zip_with(w, gradient, lambda a, g: a - RATE * (g / n + 0.001 * a))

        return F.aggregate(F.sequence(F.lit(1), F.lit(FIT_ROUNDS)), F.array_repeat(F.lit(0.0), FEATURES), step)

    return let(rows, fit)


def model(found: DataFrame) -> tuple[list[float], list[float]]:
    """(theta, weights), numbers of fixed length, of candidates(); counts of all spans of all documents go in. Without any
    span the classifier says no to everything."""
    one = _patterns(found).select("p", _em(F.col("p")).alias("theta"))
    one = one.select("theta", F.when(F.size("p") > 0, _fit(F.col("p"), F.col("theta"))).otherwise(F.array_repeat(F.lit(0.0), FEATURES)).alias("w"))
    row = one.first()
    return row["theta"], row["w"]


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, base, spans): for each row of docs(doc_id, text, ...) its base spans and all its spans, both as
    array<struct<start, end, kind int>>, in code points, end exclusive; kind is a place in KINDS.

    Null text is empty; texts without spans have empty arrays; a very long text is scanned whole. Rows stay as they are,
    repeated or not; other columns are ignored; empty input gives an empty result. A text's spans are found in its own row: no row meets another one but in the
    counts of vote patterns, and only the fitted numbers come to the driver.
    """
    found = materialise(candidates(docs), "spans")
    _, weights = model(found)
    w = F.array(*[F.lit(x) for x in weights])
    plain = lambda s: F.struct(s["start"], s["end"], s["kind"])
    added = F.filter("loose", lambda s: _sigmoid(_dot(w, _features(s["kind"], s["votes"], s["signs"]))) > threshold)
    return found.select("doc_id", F.transform("base", plain).alias("base"), F.concat(F.transform("base", plain), F.transform(added, plain)).alias("spans"))


def digest_columns(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(written(F.col("base"), KINDS), 256).alias("base_sha256"), written(F.col("spans"), KINDS).alias("spans"))
