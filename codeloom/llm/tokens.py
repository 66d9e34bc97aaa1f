"""Problem 4: token budget per source and language, and the token counts the packing and mixing operators use.

Texts above ``CHUNK_CHARS`` are cut only where the tokenizer's own splitting rule cannot join two sides: right before white space that
follows a character that is none, between letters and digits, and between either and a sign, unless an apostrophe stands before.  Every
piece the rule makes is white space, or at most one blank followed by characters of one class, or an apostrophe with a few letters,
so no piece crosses such a place, and the counts of the parts add up to the count of the whole.  Parts are spread over the
cluster by (id, part), counted, and summed per text; short texts are counted where they are read and never move.

A null text has no row in ``counts`` and counts as a record without tokens in the totals; an empty text has 0 tokens.  Rows
delivered twice count once.  The vocabulary's path is a parameter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting rule of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_CHARS = 65_536
_ENCODINGS: dict[str, object] = {}


def encoding(vocabulary: str = VOCABULARY):
    if vocabulary not in _ENCODINGS:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[vocabulary] = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[vocabulary]


#: Where two sides are independent; a run of characters of one class is one piece of the rule, so there is no such place within it.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def parts(text: str, size: int = CHUNK_CHARS) -> list[str]:
    """text in parts of about size characters, cut only at independent places."""
    out, pos = [], 0
    while len(text) - pos > size:
        m = _SAFE.search(text, pos + size)
        if not m:
            break
        out.append(text[pos:m.start()])
        pos = m.start()
    out.append(text[pos:])
    return out


def _counter(vocabulary: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in it:
            texts = b.column(b.num_columns - 1)
            n = pa.array([None if t is None else len(enc.encode_ordinary(t)) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    return run


def _cutter(size: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(i, k, p) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, p in enumerate(parts(t, size))]
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["id", "part", "piece"])

    return run


def counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, size: int = CHUNK_CHARS) -> DataFrame:
    """(key, n_tokens) of every distinct key with a text; rows delivered twice count once."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    long_text = F.length("text") > size
    short = common.spread(rows.where(~long_text)).mapInArrow(_counter(vocabulary), "id long, n_tokens long")
    cut = rows.where(long_text).mapInArrow(_cutter(size), "id long, part int, piece string").dropDuplicates(["id", "part"]).repartition("id", "part")
    summed = cut.mapInArrow(_counter(vocabulary), "id long, part int, n_tokens long").groupBy("id").agg(F.sum("n_tokens").alias("n_tokens"))
    return short.unionByName(summed).groupBy("id").agg(F.max("n_tokens").alias("n_tokens")).withColumnRenamed("id", key)


def source_name(c: str = "source"):
    """A document's source: trimmed, lower-cased, blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(F.col(c))), r"\s+", "_")


def document_language(c: str = "lang"):
    """A document's language: lower-cased, without its region; null stays null."""
    return F.lower(F.regexp_extract(F.trim(F.col(c)), r"^([A-Za-z]+)", 1))


def budget(files: DataFrame, documents: DataFrame, repos: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(kind, slice, domain, language, records, tokens): kind 'code' by repo and language, kind 'text' by source and language.

    Short texts carry their slice with them, so a text moves only if it is cut; what is shuffled is one number per record.
    """
    code = files.select(F.col("file_id").alias("id"), F.col("repo").alias("slice"), common.language(common.extension()).alias("language"), F.lit("code").alias("kind"), F.col("source_code").alias("text"))
    text = documents.select(F.col("doc_id").alias("id"), source_name().alias("slice"), document_language().alias("language"), F.lit("text").alias("kind"), "text")
    rows = code.unionByName(text).where(F.col("id").isNotNull())
    long_text = F.coalesce(F.length("text") > CHUNK_CHARS, F.lit(False))
    fields = "kind string, id long, slice string, language string"
    short = common.spread(rows.where(~long_text).select("kind", "id", "slice", "language", "text")).mapInArrow(_counter(vocabulary), f"{fields}, n_tokens long")
    large = rows.where(long_text).select("kind", "id", "slice", "language", "text")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [(*head, k, p) for *head, t in zip(*(c.to_pylist() for c in b.columns)) for k, p in enumerate(parts(t))]
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["kind", "id", "slice", "language", "part", "piece"])

    pieces = large.mapInArrow(cut, f"{fields}, part int, piece string").dropDuplicates(["kind", "id", "part"]).repartition("kind", "id", "part")
    summed = pieces.mapInArrow(_counter(vocabulary), f"{fields}, part int, n_tokens long").groupBy("kind", "id", "slice", "language").agg(F.sum("n_tokens").alias("n_tokens"))
    once = short.unionByName(summed).groupBy("kind", "id").agg(F.min(F.struct("slice", "language")).alias("s"), F.max("n_tokens").alias("n_tokens")).select("kind", "id", "s.*", "n_tokens")
    totals = once.groupBy("kind", "slice", "language").agg(F.count("*").alias("records"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    domains = repos.groupBy("repo").agg(F.max("repo_domain").alias("domain"))
    return totals.join(domains, (totals["slice"] == domains["repo"]) & (totals["kind"] == "code"), "left").select("kind", "slice", "domain", "language", "records", "tokens")
