"""Scalar functions of the engine as column expressions: references, paths, languages, text counts, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of text analysis: Unicode white space and the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"

#: Languages by lower-case file extension.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".jsx": "javascript",
    ".cs": "csharp",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".h": "c",
    ".hpp": "cpp",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".r": "r",
    ".sql": "sql",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".ps1": "powershell",
    ".md": "markdown",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".xml": "xml",
    ".html": "html",
    ".css": "css",
    ".scss": "scss",
    ".sass": "sass",
    ".less": "less",
}
#: Characters and names that no path may have, and severities by rank.
INVALID_CHARACTERS = r'[\x00-\x1f<>:"|?*]'
RESERVED_NAMES = ["con", "prn", "aux", "nul", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)]]
SEVERITIES = ("error", "warning", "info", "hint")

#: What is counted in script text when no parser is at hand. The patterns overlap.
TOKENS = {
    "keyword": r"\b(function|const|let|var|if|else|for|while|return|class|import|export|async|await)\b",
    "string": r"""(["'])(?:(?!\1)[^\\]|\\.)*\1""",
    "number": r"\b\d+(?:\.\d+)?\b",
    "comment": r"//.*|/\*[\s\S]*?\*/",
    "identifier": r"\b[a-zA-Z_$][a-zA-Z0-9_$]*\b",
}


def content_ref(content: Column) -> Column:
    """sha256:<hex> of binary or string content."""
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def ref_hex(ref: Column) -> Column:
    """The 64 digits of a reference, with or without its algorithm; null for anything else."""
    return F.nullif(F.regexp_extract(ref, r"^(?:sha256:)?([0-9a-fA-F]{64})$", 1), F.lit(""))


def checked_ref_hex(ref: Column) -> Column:
    """As ref_hex, but anything else is an error."""
    return F.coalesce(ref_hex(ref), F.raise_error(F.concat(F.lit("not an object reference: "), ref)).cast("string"))


def shard_prefix(ref: Column) -> Column:
    return F.substring(ref_hex(ref), 1, 2)


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def path_key(path: Column) -> Column:
    return F.lower(path)


def canonical_path(path: Column) -> Column:
    """struct(path, error, reason): the canonical relative path, or error 'invalid' or 'escape' with a reason.

    Backslashes are slashes; empty and '.' segments go; '..' takes back a segment, and more of them than there are segments
    escape the root."""
    clean = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), f"^{SPACE}+|{SPACE}+$", ""), "/+$", "")
    segments = F.filter(F.split(clean, "/", -1), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    step = lambda a, s: F.when(a.isNull() | (s == "..") & (F.size(a) == 0), F.lit(None)).when(s == "..", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.concat(a, F.array(s)))
    walked = F.aggregate(segments, empty, step)
    reserved = F.exists(walked, lambda s: F.array_contains(F.array(*map(F.lit, RESERVED_NAMES)), F.lower(F.substring_index(s, ".", 1))))
    fail = lambda error, reason: F.struct(F.lit(None).cast("string").alias("path"), F.lit(error).alias("error"), F.lit(reason).alias("reason"))
    return (
        F.when(path.isNull() | (path == ""), fail("invalid", "empty path"))
        .when(path.rlike(INVALID_CHARACTERS), fail("invalid", "invalid character"))
        .when(walked.isNull(), fail("escape", "above the root"))
        .when(reserved, fail("invalid", "reserved name"))
        .when(F.size(walked) == 0, fail("invalid", "no name"))
        .otherwise(F.struct(F.array_join(walked, "/").alias("path"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("reason")))
    )


def is_safe_path(path: Column) -> Column:
    return canonical_path(path)["error"].isNull()


def display_path(path: Column) -> Column:
    """Without any run of dots and slashes in front."""
    return F.regexp_replace(path, "^[./]+", "")


def extension(path: Column) -> Column:
    """From the last dot of the file name, in lower case; leading dots are no extension."""
    return F.lower(F.regexp_extract(path, r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, extension(path))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def loc(text: Column) -> Column:
    """Lines with anything but white space."""
    return F.size(F.filter(lines_of(text), lambda x: x.rlike(NOT_SPACE))).cast("long")


def text_stats(text: Column) -> Column:
    """struct(lines, words, characters, non_empty_lines)."""
    return F.struct(
        F.size(lines_of(text)).cast("long").alias("lines"),
        F.size(F.regexp_extract_all(text, F.lit(f"{NOT_SPACE}+"), F.lit(0))).cast("long").alias("words"),
        F.length(text).cast("long").alias("characters"),
        loc(text).alias("non_empty_lines"),
    )


def token_counts(text: Column) -> Column:
    """struct of a count for each of TOKENS."""
    return F.struct(*[F.regexp_count(text, F.lit("(?U)" + p)).cast("long").alias(k) for k, p in TOKENS.items()])


def occurrences(text: Column, character: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))).cast("long")


def is_text(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def severity_rank(severity: Column) -> Column:
    ranks = F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))])
    return F.coalesce(F.try_element_at(ranks, F.lower(severity)), F.lit(99))


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB, GB or TB, with one decimal from KB on."""
    out = F.when(n < 1024, F.format_string("%d B", n.cast("long")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**power)), 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(n / F.lit(float(1024**4)), 1)))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("\x1f", F.lit("v1"), *[p.cast("string") for p in parts])


def cache_key_parts(key: Column) -> Column:
    return F.slice(F.split(key, "\x1f", -1), F.lit(2), F.greatest(F.size(F.split(key, "\x1f", -1)) - 1, F.lit(0)))


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*m", "")
