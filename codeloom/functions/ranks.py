"""Positions and running sums over groups of any size: one range-partitioned sort and one row per partition and key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import kept


def running(df: DataFrame, keys: list[str], order: list[str | Column], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """df with the running sum of value (itself included) within keys, in the given order; for groups of any size.

    Rows are range-partitioned and sorted by keys and order, summed within each partition, and every partition's rows are lifted by
    what the partitions before it hold of the same key.  No group is ever in one task; the offsets are one row per key and partition.
    """
    spark = df.sparkSession
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cols = df.columns
    ordered = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", _within double"

    def sums(it: Iterator) -> Iterator:
        carry_key, carry = None, 0.0
        for pdf in it:
            if not len(pdf):
                continue
            key = pdf[keys].astype(object).where(pdf[keys].notna(), None).apply(tuple, axis=1) if keys else None
            v = pdf[value].astype("float64").fillna(0.0)
            group = (key != key.shift()).cumsum() if keys else v * 0
            within = v.groupby(group.to_numpy()).cumsum()
            if carry_key is not None and (not keys or key.iloc[0] == carry_key):
                within = within + (group == group.iloc[0]).to_numpy() * carry
            carry_key, carry = (key.iloc[-1] if keys else ()), float(within.iloc[-1])
            yield pdf.assign(_within=within)

    summed = kept(ordered.mapInPandas(sums, schema))
    totals = summed.groupBy("_part", *keys).agg(F.max("_within").alias("_sum"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0.0)))
    offsets = offsets.select(F.col("_part").alias("_at"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], "_before")
    same = F.col("_part") == F.col("_at")
    for k, name in enumerate(keys):
        same = same & F.col(name).eqNullSafe(F.col(f"_k{k}"))
    # one row per key and partition that holds it: at most the keys and twice the partitions
    return summed.join(offsets, same).select(*cols, (F.col("_within") + F.col("_before")).alias(out))


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], out: str) -> DataFrame:
    """df with each row's place (from 1) within keys in the given order."""
    rows = running(df.withColumn("_one", F.lit(1)), keys, order, "_one", out).drop("_one")
    return rows.withColumn(out, F.col(out).cast("long"))
