"""Problem 5: splitting oversized files at natural boundaries.

Boundaries of a file are its line starts; a piece that ends at boundary e and follows a cut at b holds the text from the overlap lines
before b up to e.  Every boundary is joined to its farthest legal successor at once (a binary search in the line offsets: the
last declaration start that keeps the piece within the limit if that fills at least half of it, else the last line start).  The table of
successors is then squared again and again (pointer doubling): after log2(n) rounds all boundaries reachable from the first,
which are exactly the greedy cuts, are marked, without walking them one by one.  A line longer than the limit gets boundaries of its own
at white space, or where there is none at the limit.

A file of exactly the limit is not cut.  Null code, or an extension without a limit and no ``*`` row, gives no piece.  ``start_line``
null or below 1 counts as 1.  Rows delivered twice are cut once; extra columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# How a declaration begins, by language family; at the left margin or one level in.
_DECLARATION = {
    ".py": r"(?:async )?def |class |@\w|if __name__",
    ".go": r"func |type |var |const ",
    ".php": r"(?:(?:abstract|final|public|private|protected|static) )*(?:function|class|interface|trait) ",
    ".json": r"\S", ".xml": r"<\w", ".yaml": r"\w", ".yml": r"\w", ".toml": r"\[", ".ini": r"\[",
}
_BRACES = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|inline|const|constexpr|virtual|override|sealed|partial|unsigned|extern) )*(?:function|class|interface|enum|struct|namespace|template|type|[\w:<>\[\],*&]+(?: [\w:<>\[\],*&]+)*\s[\w:~*&]+\s*\()"
_RULES = {e: re.compile(rf"^(?:[ \t]{{0,4}})(?:{r})", re.M) for e, r in _DECLARATION.items()}
_OTHER = re.compile(rf"^(?:[ \t]{{0,4}})(?:{_BRACES})(?![^\n]*;[ \t]*\r?$)", re.M)


def boundaries(code: str, ext: str, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of all boundaries with the end of the text, which begin a declaration, which begin a line)."""
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    if starts[-1] == len(code) and len(starts) > 1:
        starts.pop()
    begin, line = [], []
    for a, b in zip(starts, [*starts[1:], len(code)]):
        begin.append(a)
        line.append(True)
        if b - a > limit // 2:  # a line that may not fit beside the overlap: boundaries within it, at white space if there is some
            at, step = a, max(1, limit // 4)
            while b - at > step:
                space = max(code.rfind(c, at + step // 2, at + step) for c in " \t;,") + 1
                at = space if space > at + step // 2 else at + step
                begin.append(at)
                line.append(False)
    rule = _RULES.get(ext, _OTHER)
    declared = {m.start() for m in rule.finditer(code)}
    offsets = np.array([*begin, len(code)], dtype=np.int64)
    return offsets, np.array([x in declared for x in begin] + [False]), np.array([*line, False])


def cuts(code: str, ext: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(begin with overlap, begin, end) of the pieces; consecutive pieces share the overlap lines before each cut."""
    limit = max(1, limit)
    offsets, declared, lines = boundaries(code, ext, limit)
    n = len(offsets) - 1
    line_at = np.flatnonzero(lines)
    # where the piece that follows boundary k begins: overlap lines earlier, fewer where they would take half of the limit
    which = np.searchsorted(line_at, np.arange(n), side="right") - 1
    back = offsets[line_at[np.maximum(0, which - overlap)]] if overlap > 0 else offsets[:n].copy()
    back = np.minimum(back, offsets[:n])
    if overlap > 0:
        for less in range(overlap - 1, -1, -1):
            wide = offsets[:n] - back > limit // 2
            if not wide.any():
                break
            shorter = offsets[line_at[np.maximum(0, which - less)]] if less else offsets[:n]
            back = np.where(wide, np.minimum(shorter, offsets[:n]), back)
    back[0] = 0
    # the farthest boundary, and the farthest declaration, within the limit: for all boundaries at once
    far = np.searchsorted(offsets, back + limit, side="right") - 1
    far = np.maximum(far, np.arange(n) + 1)
    last_declared = np.maximum.accumulate(np.where(declared, np.arange(n + 1), -1))
    last_line = np.maximum.accumulate(np.where(lines, np.arange(n + 1), -1))
    natural = last_declared[far]
    good = (natural > np.arange(n)) & (offsets[np.maximum(natural, 0)] - back >= limit // 2) & (far < n)
    whole_line = last_line[far]
    at_line = (whole_line > np.arange(n)) & (far < n)
    follow = np.where(good, natural, np.where(at_line, whole_line, far))
    jump = np.append(follow, n)
    reached = np.zeros(n + 1, dtype=bool)
    reached[0] = True
    for _ in range(max(1, int(n).bit_length())):
        reached[jump[reached]] = True
        jump = jump[jump]
    at = np.flatnonzero(reached[:n])
    return [(int(back[k]), int(offsets[k]), int(offsets[follow[k]])) for k in at]


def _kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file_id", "piece_no", "pieces", "start_line", "n_chars", "overlap_chars", "overlap_short", "piece"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
    for b in it:
        rows = []
        for i, ext, code, first, limit, overlap in zip(*(c.to_pylist() for c in b.columns)):
            found = cuts(code, ext, limit, overlap)
            line, seen = first, 0
            for k, (a, begin, end) in enumerate(found):
                line += code.count("\n", seen, a) if a >= seen else -code.count("\n", a, seen)
                seen = a
                # a cut within a line counts that line's beginning as one of the overlap
                held = code.count("\n", a, begin) + (begin > a and code[begin - 1] != "\n")
                rows.append((i, k, len(found), line, end - a, begin - a, a > 0 and held < overlap and code.count("\n", 0, begin) > held, code[a:end]))
        cols = list(zip(*rows)) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def pieces(files: DataFrame, limits: DataFrame) -> DataFrame:
    """(file_id, piece_no, pieces, start_line, n_chars, overlap_chars, overlap_short, piece) of every file longer than its limit.

    overlap_short: the lines of the overlap would take more than half of the limit, so the piece shares fewer with the one before.
    """
    own = limits.where(F.col("extension").isNotNull()).groupBy("extension").agg(F.min("max_chars").alias("max_chars"), F.min_by("overlap_lines", "max_chars").alias("overlap_lines"))
    star = own.where(F.col("extension") == "*").first()  # one row of a table of settings
    other_chars, other_lines = F.lit(star.max_chars if star else None).cast("int"), F.lit(star.overlap_lines if star else None).cast("int")
    rows = files.select("file_id", common.extension().alias("ext"), "source_code", "start_line").where(F.col("source_code").isNotNull() & F.col("file_id").isNotNull())
    joined = rows.join(own.where(F.col("extension") != "*"), rows["ext"] == own["extension"], "left")
    limit, overlap = F.coalesce(F.col("max_chars"), other_chars), F.coalesce(F.col("overlap_lines"), other_lines, F.lit(0))
    large = joined.where(F.length("source_code") > limit).select("file_id", "ext", "source_code", F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).alias("first"), limit.alias("max_chars"), F.greatest(overlap, F.lit(0)).alias("overlap"))
    large = large.dropDuplicates(["file_id"])  # only oversized files move
    return large.mapInArrow(_kernel, "file_id long, piece_no int, pieces int, start_line int, n_chars int, overlap_chars int, overlap_short boolean, piece string")
