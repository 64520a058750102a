"""Text lint: all rules of a file are computed in its own row and leave it through one explode, without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclake.functions.scalar import SPACE, lines_of
from srclake.operators.records import explode_records, record
from srclake.schemas import RECORD

#: Markers in order of priority.
MARKERS = ("TODO", "FIXME", "XXX", "HACK")


@dataclass(frozen=True)
class TextLint:
    """Which rules run, and the longest line that is not too long."""

    max_line_length: int = 120
    check_trailing_whitespace: bool = True
    check_line_length: bool = True
    check_todo: bool = True
    check_tab_indentation: bool = True
    check_final_newline: bool = True


def _each(lines: Column, test, **fields) -> Column:
    """A diagnostic for each line that passes the test; fields may be functions of the line."""
    made = lambda x, i: F.when(test(x), record(kind="diagnostic", path=F.col("path"), line=i + 1, **{k: v(x) if callable(v) else v for k, v in fields.items()}))
    return F.filter(F.transform(lines, made), lambda r: r.isNotNull())


def _body(line: Column) -> Column:
    return F.regexp_replace(line, r"\r+$", "")


def _where(found: Column, lines: Column, make) -> Column:
    """Line by line only if the text as a whole has something to find."""
    return F.when(found, make(lines)).otherwise(_none())


def trailing_whitespace(text: Column, lines: Column) -> Column:
    ends = lambda x: F.length(F.regexp_replace(_body(x), f"{SPACE}+$", "")) + 1
    make = lambda rows: _each(rows, lambda x: x.rlike(f"{SPACE}\\r*$") & _body(x).rlike(f"{SPACE}$"), severity="warning", code="L001", message="Trailing whitespace", col=ends)
    return _where(text.rlike(f"{SPACE}\\r*(?:\n|$)"), lines, make)


def long_lines(text: Column, lines: Column, longest: int) -> Column:
    message = lambda x: F.format_string(f"Line too long (%d > {longest})", F.length(_body(x)))
    make = lambda rows: _each(rows, lambda x: (F.length(x) > longest) & (F.length(_body(x)) > longest), severity="warning", code="L002", message=message, col=longest + 1)
    return _where(F.length(text) > longest, lines, make)


def markers(text: Column, lines: Column) -> Column:
    def first(line: Column, found) -> Column:
        out = F
        for m in MARKERS:
            out = out.when(F.contains(F.upper(line), F.lit(m)), found(m, line))
        return out

    has = lambda x: F.upper(x).rlike("|".join(MARKERS))
    message = lambda x: first(x, lambda m, _: F.lit(f"Found {m} comment"))
    place = lambda x: first(x, lambda m, line: F.instr(F.upper(line), m))
    return _where(has(text), lines, lambda rows: _each(rows, has, severity="info", code="L003", message=message, col=place))


def tab_indentation(text: Column, lines: Column) -> Column:
    make = lambda rows: _each(rows, lambda x: x.startswith("\t"), severity="warning", code="L004", message="Tab indentation (prefer spaces)", col=1)
    return _where(text.contains("\t"), lines, make)


def final_newline(text: Column, lines: Column) -> Column:
    one = record(kind="diagnostic", path=F.col("path"), severity="warning", code="L005", message="Missing newline at end of file", line=F.size(lines), col=F.length(F.element_at(lines, -1)) + 1)
    return F.when((text != "") & ~text.endswith("\n"), F.array(one)).otherwise(_none())


def _none() -> Column:
    return F.array().cast(f"array<{_type()}>")


def _type() -> str:
    return "struct<" + ",".join(f"{k}:{t}" for k, t in RECORD.items()) + ">"


def text_diagnostics(files: DataFrame, config: TextLint = TextLint()) -> DataFrame:
    """The diagnostics of files(path, text, shard_id); files without text (binary ones) have none."""
    lines, text = F.col("all_lines"), F.col("text")
    rules = [
        (config.check_trailing_whitespace, lambda: trailing_whitespace(text, lines)),
        (config.check_line_length, lambda: long_lines(text, lines, config.max_line_length)),
        (config.check_todo, lambda: markers(text, lines)),
        (config.check_tab_indentation, lambda: tab_indentation(text, lines)),
        (config.check_final_newline, lambda: final_newline(text, lines)),
    ]
    chosen = [rule() for on, rule in rules if on] or [_none()]
    rows = files.where("text is not null").select("shard_id", "path", "text", lines_of(text).alias("all_lines"))
    return explode_records(rows, F.concat(*chosen))
