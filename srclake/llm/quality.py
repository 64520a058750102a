"""Quality rules as a short-circuit cascade, on DataFrame and SQL functions alone.

Each rule is an expression over what a text shows: its words, its lines and counts of them. On a sample the time that each
rule takes and the share of rows that it rejects are measured; rules are then ordered by rejections per cost and become one
CASE, in which a rule is only computed for rows that all rules before it let pass. The order decides the cost, not the
outcome.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclake.llm.native import let

SYMBOLS, SPACE = "#*$%&|<>", " \t\n\x0b\f\r"
#: Rows of the sample on which costs are measured (about so many, by Bernoulli sampling of rows), and timed passes a rule.
SAMPLE, PASSES = 2000, 3


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more.

    Most texts repeat no window: their hashes are all different, and that is proof. Else windows are sorted as strings, so
    that equal ones are neighbours, and their places are counted."""
    n = F.size(words)
    inner = F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0)))
    hashes = F.transform(inner, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.transform(inner, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))

    def places(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["w"] == F.get(s, j - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, j + 1)["w"], F.lit(False))
        return F.size(F.array_distinct(F.flatten(F.transform(F.filter(s, same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    exact = let(F.sort_array(windows), places)
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(exact)).cast("long")


def clean_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class Facts:
    """What rules ask of a text. Each is an expression over the text and its words; `known` has those that are columns
    already."""

    def __init__(self, text: Column, words: Column, known: dict[str, Column] | None = None):
        self.text, self.words = text, words
        self.__dict__.update(known or {})

    @cached_property
    def n_words(self) -> Column:
        return F.size(self.words).cast("long")

    @cached_property
    def word_chars(self) -> Column:
        return F.length(_without(self.text, SPACE)).cast("long")

    @cached_property
    def n_symbols(self) -> Column:
        return (F.length(self.text) - F.length(_without(self.text, SYMBOLS))).cast("long")

    @cached_property
    def lines(self) -> Column:
        """struct<n, dup>: lines with a word, and those that are equal to an earlier one."""
        return let(_lines(self.text), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))

    @cached_property
    def n_repeat_words(self) -> Column:
        return _repeat_words(self.words)

    @cached_property
    def letters(self) -> Column:
        return F.length(F.regexp_replace(self.text, r"[^\p{L}]+", ""))

    @cached_property
    def capitals(self) -> Column:
        return F.length(F.regexp_replace(self.text, r"[^\p{Lu}]+", ""))


@dataclass(frozen=True)
class Rule:
    """rejects(facts): whether the rule rejects a text."""

    name: str
    rejects: Callable[[Facts], Column]


#: Limits. Prose has no symbols to speak of, mixed case, words of middling length and lines of its own.
RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeats", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("symbols", lambda f: 100 * f.n_symbols > 25 * f.n_words),
    Rule("dup_lines", lambda f: let(f.lines, lambda x: (x["n"] >= 4) & (2 * x["dup"] > x["n"]))),
    Rule("word_length", lambda f: (f.word_chars > 20 * f.n_words) | (f.word_chars < 2 * f.n_words)),
    Rule("shouting", lambda f: 10 * f.capitals > 4 * f.letters),
)
BASE = ("few_words", "repeats")


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """rules by the rejections per cost that they made on the sample, most first; on no rows as given.

    A row is sampled by chance, whatever its text, so copies of a text are as frequent there as in docs; the sample stays in
    the partitions that its rows are in. A rule's cost is its shortest pass less the shortest one without any rule, to the
    nearest power of two, so that the order is the same from run to run unless rules are about as good as each other."""
    n = docs.count()
    if not n:
        return list(rules)
    sample = docs.select(clean_text().alias("text")).sample(fraction=min(1.0, SAMPLE / n), seed=7).select("text", _words(F.col("text")).alias("words")).persist()
    try:
        sample.count()

        def measured(rejects: Column) -> tuple[int, float]:
            seconds = []
            for _ in range(1 + PASSES):  # the first one compiles
                began = time.perf_counter()
                rejected = sample.agg(F.sum(rejects.cast("int"))).first()[0] or 0
                seconds.append(time.perf_counter() - began)
            return rejected, min(seconds[1:])

        facts = Facts(F.col("text"), F.col("words"))
        _, idle = measured(F.length("text") < 0)
        found = []
        for rule in rules:
            rejected, seconds = measured(rule.rejects(facts))
            cost = 2.0 ** round(math.log2(max(seconds - idle, 1e-3)))
            found.append((-(rejected + 0.5) / cost, rule.name, rule))
        return [r for *_, r in sorted(found, key=lambda x: x[:2])]
    finally:
        sample.unpersist()


def verdict(facts: Facts, ordered: list[Rule]) -> Column:
    """The first rule in this order that rejects the text; null if none does. Later rules are not computed."""
    out = F
    for rule in ordered:
        out = out.when(rule.rejects(facts), F.lit(rule.name))
    return out if isinstance(out, Column) else F.lit(None).cast("string")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs(text, ...) that no rule rejects, unchanged, with all their columns.

    Null text is empty, and so has too few words; a very long text is judged whole. Repeated rows are judged each for itself;
    empty input gives an empty result. Other columns may have any names. One pass over the rows, no shuffle."""
    ordered, text = order_rules(docs, rules), clean_text()
    return docs.where(let(F.struct(text.alias("text"), _words(text).alias("words")), lambda x: verdict(Facts(x["text"], x["words"]), ordered)).isNull())


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept): the measures of each row of
    docs and the cascade's verdict. All measures are asked for here, so the cascade finds them as columns; null text, long
    texts, repeated rows and empty input are as in keep_good."""
    ordered = order_rules(docs, rules)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), clean_text().alias("text"))
    rows = rows.withColumn("words", _words(F.col("text")))
    facts = Facts(F.col("text"), F.col("words"))
    known = ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")
    rows = rows.select("doc_id", "text", "words", *[getattr(facts, k).alias(k) for k in known])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = verdict(Facts(F.col("text"), F.col("words"), {k: F.col(k) for k in known}), ordered).isNull()
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words", failed.alias("base_failed"), (~failed & passed).alias("kept"))
