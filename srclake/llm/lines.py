"""Line dedup by a log-template tree, on DataFrame and SQL functions alone.

The tree has a fixed depth: a line goes by its number of tokens and its first LEAD tokens to a leaf. Tokens with digits are
variable fields from the start. Within a leaf, places where no token has the majority are variable fields too; what stays
constant is the leaf's template. Lines whose template recurs across documents are dropped.

Recurring means: in texts of at least LEAST families. A family is a text and its near copies: texts that have over half of
their lines, by first tokens, in common. So copies keep their lines, however many there are, and are left to document dedup;
what else stands around a line, blank lines or other recurring ones, does not matter, nor does a line's share of all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclake.llm.common import few, materialise
from srclake.llm.components import components
from srclake.llm.native import let

#: Leading tokens of a leaf; families of texts in which a template recurs; least share of a line's tokens, in per cent, that
#: are as in the leaf's template.
LEAD, LEAST, ALIKE = 3, 5, 70
#: Cells in which a text looks for its near copies; each is a pair of least hashes of its lines.
CELLS = 6
#: Copies that a first text meets in one task, about so many.
HOT = 1024
#: A token with a digit; white space within a line that is not one space between tokens.
_FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_ODD_SPACE, _SPACE = r"[\x09\x0B-\x0D]|\x20\x20", r"[\x20\x09\x0B-\x0D]+"


def _masked(text: Column) -> Column:
    """The lines of a text, with one space between tokens and <*> for tokens with digits."""
    plain = F.when(text.rlike("[0-9]"), F.regexp_replace(text, _FIELD, "<*>")).otherwise(text)
    even = let(plain, lambda t: F.when(t.rlike(_ODD_SPACE), F.regexp_replace(t, _SPACE, " ")).otherwise(t))
    return F.transform(F.split(even, "\n", -1), lambda x: F.btrim(x))


def _lead(masked: Column) -> Column:
    return F.xxhash64(F.substring_index(masked, " ", LEAD))


def _leaves(text: Column) -> Column:
    """array<struct<line int, leaf long, full binary, lead long>> of the lines with a word: the leaf by number of tokens and
    first tokens, the whole masked line and its first tokens, as hashes. What is dropped goes by the whole line's, so that
    one has 128 bits; lines whose leaves collide are told apart by their tokens."""

    def of(masked: Column) -> Column:
        lead = F.transform(masked, _lead)
        item = lambda g: lambda m, i: F.struct(
            i.alias("line"),
            F.xxhash64(F.length(m) - F.length(F.replace(m, F.lit(" "), F.lit(""))), g[i]).alias("leaf"),
            F.unhex(F.md5(m)).alias("full"),
            g[i].alias("lead"),
            m.alias("masked"),
        )
        return let(lead, lambda g: F.filter(F.transform(masked, item(g)), lambda x: x["masked"] != ""))

    return let(_masked(text), of)


def _key(text: Column) -> list[Column]:
    """What tells texts apart: equal texts have equal lines to drop."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("2"), text).alias("k2")]


def _families(texts: DataFrame) -> DataFrame:
    """(k1, family) of the texts(k1, leads) that are near copies of others. A text meets the first one of each cell; their
    lines are compared, so that cells of recurring lines join no texts that differ otherwise."""
    least = lambda k: F.array_min(F.transform("leads", lambda x: F.xxhash64(x, F.lit(k))))
    cells = texts.select("k1", F.explode(F.array(*[F.xxhash64(F.lit(k), least(2 * k), least(2 * k + 1)) for k in range(CELLS)])).alias("cell"))
    cells = materialise(cells, "cells")
    shared = cells.groupBy("cell").agg(F.min("k1").alias("first"), F.max("k1").alias("last")).where("first <> last").select("cell", "first")
    pairs = materialise(cells.join(shared, "cell").where("k1 <> first").select("k1", "first").distinct(), "pairs")
    # The first text of a large family meets its copies in parts.
    hot = few(materialise(pairs.groupBy("first").agg(F.ceil(F.count("*") / HOT).cast("int").alias("g")).where("g > 1"), "hot"))
    parts = F.coalesce("g", F.lit(1))
    x = pairs.join(texts.select("k1", F.col("leads").alias("x")), "k1").join(hot, "first", "left").withColumn("part", F.pmod(F.xxhash64("k1"), parts).cast("int")).drop("g")
    y = texts.select(F.col("k1").alias("first"), F.col("leads").alias("y")).join(hot, "first", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("g")
    pairs = x.join(y, ["first", "part"])
    both = F.size(F.array_intersect("x", "y"))
    links = pairs.where(3 * both > F.size("x") + F.size("y")).select(F.col("k1").alias("u"), F.col("first").alias("v"))
    return components(links).withColumnsRenamed({"node": "k1", "component": "family"})


def _counted(rows: DataFrame, key: str) -> DataFrame:
    """The values of `key` that recur. rows(key, family): a line in a text. Sets of families would grow without bound, so
    each step is a partial aggregation."""
    return rows.groupBy(key, "family").agg(F.lit(1)).groupBy(key).agg(F.count("*").alias("families")).where(F.col("families") >= LEAST).select(key)


def recurring(docs: DataFrame) -> DataFrame:
    """(k1, k2, lines array<int>): by hashes of the text, the places in split(text, newline) of lines to drop."""
    texts = docs.where("text is not null").select(F.col("text").cast("string").alias("text"))
    found = texts.select(*_key(F.col("text")), F.transform(_leaves(F.col("text")), lambda x: x.dropFields("masked")).alias("x"))
    # One row for each different text: copies of a document are one text.
    different = materialise(found.groupBy("k1", "k2").agg(F.first("x").alias("x")).where(F.size("x") > 0), "texts")
    families = few(materialise(_families(different.select("k1", F.array_distinct("x.lead").alias("leads"))), "families"))
    rows = different.join(families, "k1", "left").select("k1", "k2", F.coalesce("family", "k1").alias("family"), F.explode("x").alias("x"))
    rows = materialise(rows.select("k1", "k2", "family", "x.line", "x.leaf", "x.full"), "lines")
    exact = _counted(rows, "full")
    variants = rows.groupBy("leaf", "full").agg(F.count("*").alias("n")).groupBy("leaf").agg(F.count("*").alias("variants"))
    crowded = materialise(_counted(rows, "leaf").join(variants.where("variants > 1").select("leaf"), "leaf", "left_semi"), "leaves")
    templated = _templated(texts, rows, crowded)
    drop = materialise(exact.unionByName(templated).distinct(), "templates")
    hit = rows.join(drop, "full", "left_semi")
    return hit.groupBy("k1", "k2").agg(F.collect_set("line").alias("lines"))  # of one text


def _templated(texts: DataFrame, rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """(full): lines of crowded leaves that are as their leaf's template, if the template recurs with those lines alone."""
    # One text for each line shows what the line is; other texts are not read again.
    shown = rows.join(crowded, "leaf", "left_semi").groupBy("leaf", "full").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2").distinct()
    keyed = texts.select(*_key(F.col("text")), "text").join(few(materialise(shown, "shown")), ["k1", "k2"], "left_semi")
    lines = keyed.select(F.explode(_leaves(F.col("text"))).alias("x")).select("x.leaf", "x.full", "x.masked")
    lines = materialise(lines.join(crowded, "leaf", "left_semi").groupBy("leaf", "full").agg(F.first("masked").alias("masked")), "crowded")
    tokens = lines.select("leaf", "full", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    counts = tokens.groupBy("leaf", "at", "token").agg(F.count("*").alias("n"))
    best = counts.groupBy("leaf", "at").agg(F.max_by("token", F.struct("n", "token")).alias("token"), F.max("n").alias("n"), F.sum("n").alias("all"))
    constant = F.when(2 * F.col("n") > F.col("all"), F.struct("at", "token"))
    templates = best.groupBy("leaf").agg(F.map_from_entries(F.collect_list(constant)).alias("template"))  # a line's places at most
    own = F.split("masked", " ")
    same = F.size(F.filter(own, lambda t, i: F.coalesce(F.try_element_at("template", i) == t, F.lit(False))))
    near = materialise(lines.join(templates, "leaf").where(100 * same >= ALIKE * F.size(own)).select("leaf", "full"), "alike")
    again = _counted(rows.join(near.select("full"), "full", "left_semi"), "leaf")
    return near.join(again, "leaf", "left_semi").select("full")


def drop_recurring(docs: DataFrame) -> DataFrame:
    """docs with the lines dropped whose template recurs across documents; n_chars, if there, is the new text's length.

    All rows and columns of docs(text, ...) stay, also rows that lose all lines (their text is then empty); texts without a
    recurring line stay byte for byte. Null text stays null; a very long text is a row of its lines' hashes. Repeated rows lose the same lines and count as one document.
    Empty input gives an empty result. Lines are shuffled as hashes only, and the text of crowded leaves; the texts
    themselves meet the lists of lines by hash, by broadcast where the lists are small enough for Spark's threshold.
    """
    lists = materialise(recurring(docs), "drops")
    keyed = docs.select(F.struct("*").alias("doc"), *_key(F.col("text").cast("string")))
    joined = keyed.join(lists, ["k1", "k2"], "left").withColumn("all", F.split(F.col("doc")["text"], "\n", -1))
    kept = F.array_join(F.filter("all", lambda v, i: ~F.array_contains("lines", i)), "\n")
    joined = joined.withColumn("kept", F.when(F.col("lines").isNull(), F.col("doc")["text"]).otherwise(kept))
    columns = [F.col("kept").alias(c) if c == "text" else F.when(F.col("lines").isNull(), F.col("doc")[c]).otherwise(F.length("kept")).cast(t).alias(c) if c == "n_chars" else F.col("doc")[c].alias(c) for c, t in docs.dtypes]
    return joined.select(*columns)
