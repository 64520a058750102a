"""Column builders for the operators that run on DataFrame and SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that prefix_sums adds up at a time.
STRIDE = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, and only where the result is asked for (a CASE branch stays lazy)."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)


def prefix_sums(values: Column) -> Column:
    """For each element the sum of those before it. Sums of blocks, and of blocks of blocks, keep an array of n elements from
    costing its square: with three levels the cost is n * STRIDE and (n / STRIDE ** 2) ** 2."""

    def sums(x: Column, levels: int) -> Column:
        if not levels:
            return F.transform(upto(F.size(x)), lambda b: total(F.slice(x, F.lit(1), b)))
        blocks = F.transform(upto(F.ceil(F.size(x) / STRIDE)), lambda b: total(F.slice(x, b * STRIDE + 1, STRIDE)))
        before = lambda b: sums(b, levels - 1)
        return let(let(blocks, before), lambda s: F.transform(upto(F.size(x)), lambda i: s[F.floor(i / STRIDE).cast("int")] + total(F.slice(x, i - i % STRIDE + 1, i % STRIDE))))

    return let(values, lambda x: sums(x, 2))


def counts_before(at: Column, marks: Column) -> Column:
    """For each of the places `at` how many of `marks` are before it: one sort of both and sums over it."""
    nothing = F.lit(None).cast("int")
    events = F.array_sort(F.concat(F.transform(marks, lambda m: F.struct((m + 1).cast("long").alias("at"), F.lit(0).alias("k"), nothing.alias("i"))), F.transform(at, lambda a, i: F.struct(a.cast("long").alias("at"), F.lit(1).alias("k"), i.alias("i")))))

    def tagged(e: Column) -> Column:
        before = prefix_sums(F.transform(e, lambda x: F.when(x["k"] == 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))
        own = F.filter(F.zip_with(e, before, lambda x, n: F.struct(x["i"].alias("i"), n.alias("n"))), lambda x: x["i"].isNotNull())
        return F.transform(F.array_sort(own), lambda x: x["n"])

    return let(events, tagged)


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """The leftmost non-overlapping matches as array<struct<start long, end long, value string, part string>>, in code
    points, end exclusive. value is the match, part one of its groups. The texts between matches give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None

    def placed(m: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))

        def with_gaps(g: Column) -> Column:
            steps = F.transform(m, lambda v, i: g[i] + F.length(v))
            starts = lambda s: F.transform(m, lambda v, i: F.struct((s[i] + g[i]).alias("start"), (s[i] + g[i] + F.length(v)).alias("end"), v.alias("value")))
            return let(prefix_sums(steps), starts)

        spans = let(gaps, with_gaps)
        if part is None:
            return F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["value"], F.lit("").alias("part")))
        return let(part, lambda p: F.transform(spans, lambda x, i: F.struct(x["start"], x["end"], x["value"], p[i].alias("part"))))

    return let(found, lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(no_spans()))


def no_spans() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint,value:string,part:string>>")


def written(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of spans(kind int, start, end), by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.array_join(F.transform(ordered, one), ",")
