"""Problem 1: source files that do not parse.

Files up to one chunk are decided where they are read: lexed, reduced by local grammars, decided as a whole.  Larger files are
cut into chunks of whole lines that are spread over the cluster; each chunk becomes a lexer-state map (entry state -> exit
state and residue, see ``lexmap``), maps of one file are combined in order, and only maps are shuffled for that, never code.

Null and blank code is no case, nor is a file of another extension.  Rows delivered twice give the same verdict and count once.
Repeated rows, ties and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, lexmap

EXTENSIONS = (".py", ".js", ".ts", ".java", ".go", ".php", ".c", ".h", ".cpp", ".cs", ".json", ".xml")


def _whole_files(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        ids, exts, codes = (b.column(k) for k in range(3))
        bad = [i.as_py() for i, e, c in zip(ids, exts, codes) if not lexmap.parses(e.as_py(), c.as_py(), None)]
        yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], names=["file_id"])


def _chunks(chunk: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, exts, codes = (b.column(k).to_pylist() for k in range(3))
            rows = [(i, e, k, part) for i, e, c in zip(ids, exts, codes) for k, part in enumerate(lexmap.cut(c, chunk, e))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((), (), (), ()), (pa.int64(), pa.string(), pa.int32(), pa.string()))], names=["file_id", "ext", "k", "part"])

    return run


def _maps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        ids, exts, ks, parts = (b.column(n).to_pylist() for n in ("file_id", "ext", "k", "part"))
        out = [json.dumps(lexmap.summary(e, part, [lexmap.FIRST.get(e, lexmap.CODE)] if k == 0 else None)) for e, k, part in zip(exts, ks, parts)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(exts, pa.string()), pa.array(ks, pa.int32()), pa.array(out, pa.string())], names=["file_id", "ext", "k", "map"])


def _fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    ext = pdf.ext.iloc[0]
    maps = pdf.sort_values("k").drop_duplicates("k")["map"].tolist()
    maps = [{s: tuple(v) for s, v in json.loads(m).items()} for m in maps]
    while len(maps) > 1:
        maps = [lexmap.combine(ext, *maps[n:n + 2]) if n + 1 < len(maps) else maps[n] for n in range(0, len(maps), 2)]
    fine = lexmap.whole(ext, maps[0][lexmap.FIRST.get(ext, lexmap.CODE)])
    return pd.DataFrame({"file_id": [] if fine else [key[0]]}, dtype="int64")


def unparsable(files: DataFrame, chunk: int = lexmap.CHUNK_CHARS) -> DataFrame:
    """(file_id) of the files whose code breaks the grammar of their language."""
    rows = files.select("file_id", common.extension().alias("ext"), "source_code").where(F.col("ext").isin(*EXTENSIONS) & F.col("source_code").isNotNull() & F.col("source_code").rlike(r"\S") & F.col("file_id").isNotNull())
    large = F.length("source_code") > chunk
    small = common.spread(rows.where(~large)).mapInArrow(_whole_files, "file_id long")
    parts = rows.where(large).mapInArrow(_chunks(chunk), "file_id long, ext string, k int, part string").repartition("file_id", "k")
    folded = parts.mapInArrow(_maps, "file_id long, ext string, k int, map string").groupBy("file_id").applyInPandas(_fold, "file_id long")
    return small.unionByName(folded).distinct()


def rates(files: DataFrame, chunk: int = lexmap.CHUNK_CHARS) -> DataFrame:
    """Per repo and language: files of a language checked here, files that do not parse, and their rate.

    A null repo is a group of its own.  Files without code are counted as files and never as broken.
    """
    keys = files.select("file_id", "repo", common.extension().alias("ext")).where(F.col("ext").isin(*EXTENSIONS)).dropDuplicates(["file_id"])
    bad = unparsable(files, chunk).withColumn("broken", F.lit(1))
    return (keys.join(bad, "file_id", "left").groupBy("repo", common.language(F.col("ext")).alias("language"))
            .agg(F.count("*").alias("files"), F.count("broken").alias("broken_files"))
            .withColumn("broken_rate", F.round(F.col("broken_files") / F.col("files"), 6)))
