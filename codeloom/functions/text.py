"""Column functions on text: lines, numbered lines, slices, names, token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the separators at which text falls into lines.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def lines(c: Column) -> Column:
    """Lines of a text; a last separator opens no further line, an empty text has none, null stays null."""
    trimmed = F.regexp_replace(c, rf"(?:{LINE_BREAK})\z", "")
    return F.when(c.isNull(), F.lit(None)).when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, LINE_BREAK))


def line_count(c: Column) -> Column:
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(lines(c)))


def numbered(ls: Column, start: Column, width: Column) -> Column:
    """Lines with right-justified numbers and ': ' before each; ls and width must be columns, as the lambda runs per line."""
    pieces = F.transform(ls, lambda line, k: F.concat(F.lpad((k + start).cast("string"), width, " "), F.lit(": "), line))
    return F.when(F.size(ls) == 0, F.lit("")).otherwise(F.array_join(pieces, "\n"))


def number_width(ls: Column, start: Column) -> Column:
    return F.length((start + F.size(ls) - 1).cast("string"))


def line_slice(c: Column, start: Column, end: Column, base: Column) -> Column:
    """Lines start..end of a text whose first line has the number base; '' where the range is not inside the text."""
    ls = lines(c)
    a, b = start - base + 1, end - base + 1
    inside = (a >= 1) & (b <= F.size(ls)) & (a <= b)
    return F.when(inside, F.array_join(F.slice(ls, F.when(inside, a).otherwise(1), F.when(inside, b - a + 1).otherwise(0)), "\n")).otherwise(F.lit(""))


def token_estimate(c: Column) -> Column:
    """Tokens of a text by its length, where no vocabulary is at hand: a quarter of its characters, rounded up; null is 0."""
    return F.ceil(F.coalesce(F.length(c), F.lit(0)) / 4).cast("long")


def message_tokens(prompt: Column, text: Column) -> Column:
    return token_estimate(F.concat(F.lit("system: "), prompt)) + token_estimate(F.concat(F.lit("user: "), text))


def text_budget(limit: Column, prompt_tokens: Column, overhead: int, reserve: int = 0) -> Column:
    return F.greatest(F.lit(128), limit - prompt_tokens - F.lit(max(0, overhead)) - F.lit(max(0, reserve)))


def chunk_tokens(prompts: DataFrame, limit: int | None, overhead: int, legacy: int | None = None, default: int = 4096) -> DataFrame:
    """(chunk_tokens): the least text budget that the prompts (prompt) of all extensions leave, at most legacy; legacy or default without a limit."""
    least = F.min(text_budget(F.lit(limit).cast("long"), token_estimate(F.col("prompt")), overhead)) if limit is not None else F.lit(legacy or default)
    return prompts.agg((F.least(least, F.lit(legacy)) if legacy is not None and limit is not None else least).cast("long").alias("chunk_tokens"))


def input_limit(configured: int | None, known: int | None, legacy: int | None = None) -> int | None:
    if configured and known:
        return min(configured, known)
    return configured or known or legacy


def sanitized_name(c: Column) -> Column:
    """A name fit for files: other characters as underscores, none of '._' at the ends, 'project' if nothing is left."""
    clean = F.btrim(F.regexp_replace(F.trim(c), r"(?U)[^\w.-]+", "_"), F.lit("._"))
    return F.when(F.coalesce(F.length(clean), F.lit(0)) == 0, F.lit("project")).otherwise(clean)


def suffix(path: Column) -> Column:
    """The extension of a path, lower-cased, '' if there is none; a leading dot of the name opens no extension."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def truncated(c: Column, limit: int = 4000, mark: str = "\n...") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)
