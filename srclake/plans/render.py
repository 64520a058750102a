"""Deterministic text of small results: tables, JSON and JSON lines. Rows are sorted and paged by Spark or here."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

PAGE, WIDEST = 50, 60
#: Terminal codes.
STYLES = {"bold": "1", "dim": "2", "red": "31", "green": "32", "yellow": "33", "blue": "34", "cyan": "36"}


@dataclass(frozen=True)
class Col:
    name: str
    header: str | None = None
    width: int | None = None
    align: str = "left"

    @property
    def title(self) -> str:
        return self.name.upper() if self.header is None else self.header


def coloured(text: str, style: str, mode: str = "auto") -> str:
    """mode: always, never, or auto (a terminal that has not asked for none)."""
    on = mode == "always" or mode == "auto" and sys.stdout.isatty() and "NO_COLOR" not in os.environ
    return f"\x1b[{STYLES[style]}m{text}\x1b[0m" if on and style in STYLES else text


def plain(text: str) -> str:
    return re.sub(r"\x1b\[[0-9;]*m", "", text)


def _ordered(rows: Iterable[dict], key: str | Callable[[dict], object] | None) -> list[dict]:
    if key is None:
        return list(rows)
    return sorted(rows, key=(lambda r: r.get(key) or "") if isinstance(key, str) else key)


def paged(rows: Sequence[dict], page: int = 0, size: int = PAGE, most: int | None = None) -> list[dict]:
    return list(rows[:most] if most is not None else rows[page * size : (page + 1) * size])


def table(rows: Iterable[dict], columns: Sequence[Col | str], key: str | Callable[[dict], object] | None = None, most: int | None = None, page: int = 0, size: int = PAGE, header: bool = True, colour: str = "never") -> str:
    """Columns two spaces apart, as wide as their content up to WIDEST; longer values end in '...'."""
    shown = paged(_ordered(rows, key), page, size, most)
    if not shown:
        return ""
    cols = [c if isinstance(c, Col) else Col(c) for c in columns]
    cells = [[str(r.get(c.name, "")) for c in cols] for r in shown]
    widths = [c.width or min(WIDEST, max(len(c.title), *(len(row[i]) for row in cells))) for i, c in enumerate(cols)]
    fit = {"left": str.ljust, "right": str.rjust, "center": str.center}

    def line(values: Sequence[str]) -> str:
        return "  ".join(fit[c.align](v if len(v) <= w else v[: w - 3] + "...", w) for c, v, w in zip(cols, values, widths))

    top = [coloured("  ".join(fit[c.align](c.title, w) for c, w in zip(cols, widths)), "bold", colour), "  ".join("-" * w for w in widths)]
    return "\n".join(top * header + [line(v) for v in cells])


def as_json(value: object) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str)


def as_jsonl(rows: Iterable[dict], key: str | Callable[[dict], object] | None = None) -> str:
    return "\n".join(json.dumps(r, sort_keys=True, ensure_ascii=False, default=str) for r in _ordered(rows, key))
