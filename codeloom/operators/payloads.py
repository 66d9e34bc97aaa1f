"""Contexts for the reviewer: rendering, signatures, budgets, deduplication, the candidate floor, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hints, text
from ..functions.ranks import numbered
from ..functions.storage import kept


def signature(c: Column) -> Column:
    return F.sha2(c, 256)


def context_signature(local: Column) -> Column:
    """Of a node's path, names, description, code and its sorted local nodes."""
    return F.sha2(F.concat_ws("||", "path", "source_name", "target_name", "descr", "source_code", F.array_join(F.array_sort(local), ",")), 256)


def first_per_signature(df: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
    """The first max(1, limit) rows of each signature; all rows if the limit is negative.

    row_number <= k is pushed below the exchange (window group limit), so copies of a hot signature leave their task as k rows.
    """
    if limit < 0:
        return df
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(1, limit)).drop("_n")


def both_signatures(df: DataFrame, limit: int, group: str = "path") -> DataFrame:
    """Rows (ord, payload_sig, context_sig) that pass both limits, counting only kept rows, in the order of ord.

    The two limits bind one another, so the rows of a group are walked in order; ids and signatures only, never texts.
    """
    if limit < 0:
        return df

    def walk(pdf):
        seen_a, seen_b, keep = {}, {}, []
        for a, b in zip(*(pdf.sort_values("ord")[c] for c in ("payload_sig", "context_sig"))):
            ok = seen_a.get(a, 0) < max(1, limit) and seen_b.get(b, 0) < max(1, limit)
            keep.append(ok)
            if ok:
                seen_a[a], seen_b[b] = seen_a.get(a, 0) + 1, seen_b.get(b, 0) + 1
        return pdf.sort_values("ord")[keep]

    return df.groupBy(group).applyInPandas(walk, df.schema)


def fits(df: DataFrame, prompt_tokens: int, limit: int | None, column: str = "payload") -> DataFrame:
    """Rows with message_tokens, without those above the limit."""
    rows = df.withColumn("message_tokens", text.token_estimate(F.concat(F.lit("user: "), F.col(column))) + prompt_tokens)
    return rows if limit is None else rows.where(F.col("message_tokens") <= limit)


def with_floor(df: DataFrame) -> DataFrame:
    """Candidates and, while they are fewer than min(S, max(10, S / 3)), rejected rows by descending score (then id).

    df: (id, score, is_candidate).  The floor is one number; rejected rows are numbered by a range-partitioned sort, in no single task.
    """
    df = kept(df.select("id", "score", "is_candidate"))  # read three times
    counts = df.agg(F.count("*").alias("s"), F.count_if("is_candidate").alias("kept")).first()
    missing = min(counts["s"], max(10, counts["s"] // 3)) - counts["kept"]
    own = df.where("is_candidate").withColumn("relaxed", F.lit(False))
    if missing <= 0:
        return own
    rest = numbered(df.where(~F.col("is_candidate")), [], [F.desc("score"), F.col("id")], "_place")
    return own.unionByName(rest.where(F.col("_place") <= missing).drop("_place").withColumn("relaxed", F.lit(True)))


def node_scores(prioritised: DataFrame, prescreen: DataFrame) -> DataFrame:
    """(id, payload_score)."""
    rows = prioritised.join(prescreen, "id")
    return rows.select("id", (F.col("hint_score") * 5 + F.col("in_degree") + F.col("out_degree") + F.col("n_local") * 2 + F.col("n_lines") + F.col("prescreen_score")).alias("payload_score"))


def hint_line(label: str, values: Column) -> Column:
    return F.when(F.size(values) == 0, F.lit(f"{label}: none")).otherwise(F.concat(F.lit(f"{label}: "), F.array_join(F.slice(values, 1, 8), " | ")))


def node_body() -> Column:
    """What a context says about one node (columns of ``graph.hinted``)."""
    return F.concat_ws("\n", F.concat(F.lit("path: "), "path"), F.concat(F.lit("file: "), "name"), F.concat(F.lit("caller: "), "source_name"), F.concat(F.lit("target: "), "target_name"), F.concat(F.lit("lines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")), F.concat(F.lit("code:\n"), "source_code"), F.concat(F.lit("summary: "), "descr"), *[hint_line(k, F.col(f"{k}_hits")) for k in hints.KINDS])


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("score"), F.desc("tokens"), "kind", "ord")
