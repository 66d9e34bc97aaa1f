"""Problem 8: mixing sources to target weights.

Equal texts count as one text, that of the first copy in a source with a target.  The size of the mixture is the largest that gives
every source present its share without using a text more often than allowed.  A source's budget is spent in complete epochs first; what remains is a weighted sample without replacement
(Efraimidis-Spirakis): each text gets the key -ln(u) / weight, u from a hash of its id and the seed, weight from its quality; texts are
taken in order of their keys while their running token sum stays within the budget.  Order and running sum are one range-partitioned
sort with partition offsets, so a source that holds a third of all rows is in no single task.

Null and blank texts are not selected.  A target without texts is reported with share 0; a source without target is left out.
Texts are not cut, so a source falls short of its budget by less than the shortest of its texts that was not taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

SEED = 17


def plan(available: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, budget, epochs, remainder): one row per target, a small table."""
    goals = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).select(tokens.source_name().alias("source"), "target_share", F.greatest(F.col("max_repeats"), F.lit(0)).alias("max_repeats")).dropDuplicates(["source"])
    rows = goals.join(available, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    # sources that may be used at all decide the size of the whole
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0)
    whole = Window.partitionBy(F.lit(0))  # the table of targets, a few rows
    rows = rows.withColumn("size", F.min(F.when(usable, F.col("available") * F.col("max_repeats") / F.col("target_share"))).over(whole))
    budget = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.floor(F.col("target_share") * F.col("size") + 1e-6)).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("budget", F.least(budget, F.col("available") * F.col("max_repeats")))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(F.lit(0)).cast("int")
    return rows.withColumn("epochs", epochs).withColumn("remainder", F.col("budget") - F.col("epochs") * F.col("available")).drop("size")


def mixture(documents: DataFrame, targets: DataFrame, weights: DataFrame, vocabulary: str = tokens.VOCABULARY, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, n_tokens, uses), the plan).  weights: (doc_id, weight above 0), 1 where missing."""
    goals = targets.where(F.col("target_share") > 0).groupBy(tokens.source_name().alias("source")).agg((F.coalesce(F.max("max_repeats"), F.lit(0)) <= 0).alias("closed"))
    texts = documents.where(F.col("text").rlike(r"\S") & F.col("doc_id").isNotNull())
    # only a copy in a targeted source may stand for a text, one in a source that may be used before others
    targeted = texts.select("doc_id", tokens.source_name().alias("source"), F.sha2("text", 256).alias("text_id")).join(F.broadcast(goals), "source")
    once = targeted.groupBy("text_id").agg(F.min(F.struct("closed", "doc_id", "source")).alias("d")).select("d.doc_id", "d.source")
    sizes = tokens.counts(texts, "doc_id", "text", vocabulary).where(F.col("n_tokens") > 0)
    rows = once.join(sizes, "doc_id").join(weights.groupBy("doc_id").agg(F.max("weight").alias("weight")), "doc_id", "left")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    rows = rows.withColumn("key", -F.log(u) / F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-6)))
    rows = common.kept(rows.select("doc_id", "source", "n_tokens", "key"))
    planned = plan(rows.groupBy("source").agg(F.sum("n_tokens").alias("available")), targets)
    budgets = F.broadcast(planned.select("source", "epochs", "remainder"))
    ordered = common.running(rows, ["source"], ["key", "doc_id"], "n_tokens", "sum_tokens").join(budgets, "source")
    taken = ordered.withColumn("extra", (F.col("sum_tokens") <= F.col("remainder")).cast("int"))
    taken = common.kept(taken)
    while True:
        # a long text ends a run before its budget is spent: go on behind it with the texts that still fit, until none does; what is left
        # shrinks by a factor with every run, and each takes at least the first of them
        gap = taken.groupBy("source").agg((F.max("remainder") - F.sum(F.col("extra") * F.col("n_tokens"))).alias("gap"), F.min(F.when(F.col("extra") == 0, F.col("n_tokens"))).alias("least")).where(F.col("least") <= F.col("gap"))
        gap = common.kept(gap.select("source", "gap"))  # one row per source that is not done
        if gap.isEmpty():
            break
        fits = taken.where(F.col("extra") == 0).join(F.broadcast(gap), "source").where(F.col("n_tokens") <= F.col("gap")).select("doc_id", "source", "n_tokens", "key", "gap")
        more = common.running(fits, ["source"], ["key", "doc_id"], "n_tokens", "sum_more").where(F.col("sum_more") <= F.col("gap")).select("doc_id", F.lit(1).alias("more"))
        taken = common.kept(taken.join(more, "doc_id", "left").withColumn("extra", F.greatest("extra", F.coalesce("more", F.lit(0)))).drop("more"))
    chosen = taken.withColumn("uses", F.col("epochs") + F.col("extra")).where("uses > 0").select("doc_id", "source", "n_tokens", "uses")
    return chosen, planned


def shares(chosen: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, texts, most_uses, tokens, actual_share): what each source really got."""
    got = chosen.groupBy("source").agg(F.count("*").alias("texts"), F.max("uses").alias("most_uses"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per target
    return (planned.join(got, "source", "left").withColumn("total", total).select(
        "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)), 6).alias("actual_share")))
