"""Queries of the operators for training data: name -> (session, folder) -> DataFrame, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, mojibake, packing, prose, provenance, secrets, splitting, syntax, tokens
from .common import LANGUAGE_NAMES, extension, language, table


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "source_files")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return syntax.unparsable(_files(s, d))


def p1_rates(s: SparkSession, d: str) -> DataFrame:
    return syntax.rates(_files(s, d))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return provenance.not_first_party(_files(s, d), table(s, d, "lib_catalog")).select("file_id")


def p2_kinds(s: SparkSession, d: str) -> DataFrame:
    return provenance.not_first_party(_files(s, d), table(s, d, "lib_catalog")).groupBy("kind").agg(F.count("*").alias("files"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged(_files(s, d)).select("file_id", "field_name").distinct()


def p3_restored(s: SparkSession, d: str) -> DataFrame:
    return mojibake.damaged(_files(s, d)).dropDuplicates(["file_id", "field_name"])


def p4_budget(s: SparkSession, d: str) -> DataFrame:
    return tokens.budget(_files(s, d), _docs(s, d), table(s, d, "repos"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(_files(s, d), table(s, d, "size_limits")).where("piece_no = 0").select("file_id")


def p5_pieces(s: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(_files(s, d), table(s, d, "size_limits"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return secrets.secrets(_files(s, d))


def p6_redacted(s: SparkSession, d: str) -> DataFrame:
    return secrets.redacted(_files(s, d))


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return tokens.counts(_docs(s, d), "doc_id", "text")


def p7_containers(s: SparkSession, d: str) -> DataFrame:
    return packing.containers(_sizes(s, d), table(s, d, "pack_profiles"))


def p7_fill(s: SparkSession, d: str) -> DataFrame:
    profiles = table(s, d, "pack_profiles")
    return packing.fill_rates(packing.containers(_sizes(s, d), profiles), profiles)


def _mixture(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(s, d)
    weights = prose.measured(docs).select("doc_id", (F.lit(0.05) + F.col("prose_share")).alias("weight"))
    return mixing.mixture(docs, table(s, d, "mix_targets"), weights)


def p8_selection(s: SparkSession, d: str) -> DataFrame:
    return _mixture(s, d)[0]


def p8_shares(s: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixture(s, d))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return prose.not_prose(_docs(s, d))


def p9_statistics(s: SparkSession, d: str) -> DataFrame:
    return prose.scored(_docs(s, d))


def p4_records(s: SparkSession, d: str) -> DataFrame:
    """Records per repo and language, each counted once: the part of the token budget that SQL can check."""
    rows = _files(s, d).where(F.col("file_id").isNotNull()).select("file_id", "repo", language(extension()).alias("language")).dropDuplicates(["file_id"])
    return rows.groupBy("repo", "language").agg(F.count("*").alias("records"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_rates, p2_found, p2_kinds, p3_found, p3_restored, p4_budget, p4_records, p5_found, p5_pieces, p6_found, p6_redacted, p7_containers, p7_fill, p8_selection, p8_shares, p9_found, p9_statistics)}


_EXT = """coalesce(case when starts_with(lower(trim(extension)), '.') then lower(trim(extension)) else '.' || lower(trim(extension)) end,
  lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)), '')"""


def oracle_sql() -> dict[str, str]:
    names = "case e " + " ".join(f"when '{k}' then '{v}'" for k, v in LANGUAGE_NAMES.items()) + " else nullif(e, '') end"
    return {
        "p5_found": f"""with f as (select distinct file_id, {_EXT} as e, source_code from source_files where source_code is not null and file_id is not null),
  l as (select extension, min(max_chars) as m from size_limits where extension <> '*' group by extension), o as (select min(max_chars) as m from size_limits where extension = '*')
select distinct file_id from f left join l on f.e = l.extension cross join o where length(source_code) > coalesce(l.m, o.m)""",
        "p4_records": f"""with f as (select distinct file_id, repo, {_EXT} as e from source_files where file_id is not null) select repo, {names} as language, count(*) as records from f group by 1, 2""",
    }
