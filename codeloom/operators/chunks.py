"""Lines, semantic sections and token-bounded chunks of source files.

Null code has no lines and no chunks; empty code has none either.  ``start_line`` null or below 1 counts as 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Lines at which a semantic section begins, by extension.
BOUNDARIES: dict[str, tuple[str, ...]] = {
    ".py": (r"^\s*@", r"^\s*(async\s+def|def|class)\b"),
    ".js": (r"^\s*(export\s+)?(async\s+)?function\b", r"^\s*(export\s+)?class\b", r"^\s*(const|let|var)\s+\w+\s*=\s*(async\s*)?\(", r"^\s*\w+\s*:\s*(async\s*)?\("),
    ".ts": (r"^\s*(export\s+)?(async\s+)?function\b", r"^\s*(export\s+)?class\b", r"^\s*(export\s+)?interface\b", r"^\s*(export\s+)?type\b", r"^\s*(const|let|var)\s+\w+\s*=\s*(async\s*)?\("),
    ".java": (r"^\s*(public|private|protected)?\s*(static\s+)?class\b", r"^\s*(public|private|protected)?\s*(static\s+)?[\w<>\[\],\s]+\s+\w+\s*\([^;]*\)\s*\{?\s*$"),
    ".go": (r"^\s*func\b", r"^\s*type\s+\w+\s+struct\b", r"^\s*type\s+\w+\s+interface\b"),
    ".php": (r"^\s*(abstract\s+|final\s+)?class\b", r"^\s*(public|private|protected)?\s*function\b"),
    ".c": (r"^\s*(static\s+)?[\w\*\s]+\s+\w+\s*\([^;]*\)\s*\{?\s*$", r"^\s*(struct|typedef|enum)\b"),
    ".cpp": (r"^\s*(template\s*<.*>\s*)?[\w:\<\>\*\&\s]+\s+\w+\s*\([^;]*\)\s*(const)?\s*\{?\s*$", r"^\s*(class|struct|namespace)\b"),
    ".cs": (r"^\s*(public|private|protected|internal)?\s*(static\s+)?class\b", r"^\s*(public|private|protected|internal)?\s*(static\s+)?[\w<>\[\],\s]+\s+\w+\s*\([^;]*\)\s*\{?\s*$"),
}


def _lean(rule: str) -> str:
    """The same rule without optional words and blanks in front of a class that takes them anyway; they only cost backtracking."""
    return re.sub(r"^\^(?:\\s\*)?(?:\((?:public|private|protected|internal|\|)+\)\?\\s\*)?\(static\\s\+\)\?(?=\[\\w[^\]]*(?:\\\][^\]]*)*\\s\]\+)", "^", rule)


def file_lines(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, line_no, line): every line of every text, numbered from 1."""
    return files.select(key, F.posexplode(text.lines(F.col("source_code"))).alias("p", "line")).select(key, (F.col("p") + 1).alias("line_no"), "line")


def listings(files: DataFrame) -> DataFrame:
    """(file_id, listing): code with its true line numbers."""
    rows = files.where(F.col("source_code").isNotNull()).select("file_id", text.lines(F.col("source_code")).alias("ls"), F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).alias("first"))
    rows = rows.select("file_id", "ls", "first", text.number_width(F.col("ls"), F.col("first")).alias("width"))
    return rows.select("file_id", text.numbered(F.col("ls"), F.col("first"), F.col("width")).alias("listing"))


def is_boundary(line, ext):
    # a head with its parameter list cannot match a line without a bracket or one that ends a statement: most lines need no search
    head = line.contains("(") & ~F.rtrim(line).endswith(";")

    def any_of(rules: tuple[str, ...], flags: str):
        return reduce(lambda a, b: a | b, [head & line.rlike(flags + _lean(r)) if r"\([^;]*\)" in r else line.rlike(flags + r) for r in rules])

    ascii_line = F.octet_length(line) == F.length(line)  # Unicode classes are needed only beyond ASCII, and slow
    out = F.lit(False)
    for e, rules in BOUNDARIES.items():
        out = F.when(ext == e, F.when(ascii_line, any_of(rules, "")).otherwise(any_of(rules, "(?U)"))).otherwise(out)
    return out


def sections(files: DataFrame) -> DataFrame:
    """(file_id, start_line, end_line): line 1 and every boundary line open a section.

    The boundaries are found inside the array of lines, so no line leaves its row: no shuffle, no window.
    """
    ls = text.lines(F.col("source_code"))
    # the filter is on the text, and the outer form of explode adds none on the array: either would split and search the text again
    rows = files.where(F.length("source_code") > 0).select("file_id", ls.alias("ls"), text.suffix(F.col("path")).alias("ext"))
    marks = F.filter(F.transform(F.col("ls"), lambda line, k: F.when((k == 0) | is_boundary(line, F.col("ext")), k + 1)), lambda k: k.isNotNull())
    rows = rows.select("file_id", marks.alias("m"), F.size("ls").alias("n"))
    return rows.select("file_id", "m", "n", F.posexplode_outer("m").alias("k", "start_line")).select("file_id", "start_line", F.when(F.col("k") + 1 < F.size("m"), F.get("m", F.col("k") + 1) - 1).otherwise(F.col("n")).alias("end_line"))


_BREAK = re.compile(text.LINE_BREAK)
_COMPILED = {e: [re.compile(_lean(r)) for r in rules] for e, rules in BOUNDARIES.items()}


def estimate(s: str) -> int:
    return -(-len(s) // 4)


def pack(code: str, ext: str, budget: int, isolate: bool = False) -> list[tuple[int, int]]:
    """First and last line (from 1) of chunks within budget tokens: whole sections, each counted as one text, while they fit, lines of a
    section that is too large, a single line that is too large alone.  isolate keeps every section that fits on its own."""
    lines = code.splitlines()
    if not lines:
        return []
    costs = [estimate(x + "\n") for x in lines]
    starts = [k for k, x in enumerate(lines) if k == 0 or any(r.match(x) for r in _COMPILED.get(ext, ()))]
    out: list[tuple[int, int]] = []
    held: list[int] | None = None  # first line, last line, tokens

    def close() -> None:
        nonlocal held
        if held:
            out.append((held[0] + 1, held[1] + 1))
        held = None

    for a, b in zip(starts, [*starts[1:], len(lines)]):
        size = estimate("\n".join(lines[a:b]))
        if size > budget:
            close()
            for k in range(a, b):
                if held and held[2] + costs[k] > budget:
                    close()
                held = [held[0], k, held[2] + costs[k]] if held else [k, k, costs[k]]
            close()
        elif isolate:
            close()
            out.append((a + 1, b))
        else:
            if held and held[2] + size > budget:
                close()
            held = [held[0], b - 1, held[2] + size] if held else [a, b - 1, size]
    close()
    return out


def chunks(files: DataFrame, budget: int, isolate: bool = False) -> DataFrame:
    """(file_id, chunk_no, start_line, n_lines, n_tokens, chunk): greedy packing, a fold over each file's sections."""
    rows = files.select("file_id", "source_code", text.suffix(F.col("path")).alias("ext"), F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).alias("first")).where(F.length("source_code") > 0)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, code, ext, first in zip(pdf.file_id, pdf.source_code, pdf.ext, pdf["first"]):
                lines = code.splitlines()
                for k, (a, b) in enumerate(pack(code, ext, budget, isolate)):
                    body = "\n".join(lines[a - 1:b])
                    out.append((i, k, first + a - 1, b - a + 1, estimate(body), body))
            yield pd.DataFrame(out, columns=["file_id", "chunk_no", "start_line", "n_lines", "n_tokens", "chunk"])

    return rows.mapInPandas(run, "file_id long, chunk_no int, start_line int, n_lines int, n_tokens long, chunk string")
