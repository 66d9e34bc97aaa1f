"""The call graph as two tables: code units to nodes and edges, degrees, neighbourhoods, views.

Of several units of one source node the last (by ``unit_id``) gives its attributes; a target that is no source is a placeholder without
code.  Ids carry the caller's path, so no edge leaves a file and ``path`` is an exact partition key for all traversal.
Units without path, source or target are left out; repeated rows change nothing; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hints, text


def units(df: DataFrame) -> DataFrame:
    return df.where(F.col("path").isNotNull() & F.col("source_name").isNotNull() & F.col("target_name").isNotNull())


def node_id(name: str):
    return F.concat_ws("|", F.col("path"), F.col(name))


ATTRIBUTES = ("source_code", "target_name", "source_name", "descr", "start_line", "end_line", "name", "path")


def nodes(df: DataFrame) -> DataFrame:
    """(id, attributes, node_ord): node_ord is the unit that first names the node, doubled, plus one for targets."""
    u = units(df)
    own = F.struct(F.coalesce("source_code", F.lit("")).alias("source_code"), "target_name", "source_name", F.coalesce("source_desc", F.lit("")).alias("descr"), F.col("start_code_line").alias("start_line"), F.col("end_code_line").alias("end_line"), F.coalesce("name", F.lit("")).alias("name"), "path")
    bare = F.struct(F.lit("").alias("source_code"), F.lit("").alias("target_name"), F.col("target_name").alias("source_name"), F.lit("").alias("descr"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.coalesce("name", F.lit("")).alias("name"), "path")
    # one aggregation for both roles: the code travels once, and only up to the partial aggregation
    both = u.select(F.explode(F.array(
        F.struct(node_id("source_name").alias("id"), F.col("unit_id").alias("rank"), (F.col("unit_id") * 2).alias("ord"), own.alias("a")),
        F.struct(node_id("target_name").alias("id"), (-F.col("unit_id") - (1 << 62)).alias("rank"), (F.col("unit_id") * 2 + 1).alias("ord"), bare.alias("a")),
    )).alias("n")).select("n.*")
    return both.groupBy("id").agg(F.max_by("a", "rank").alias("a"), F.min("ord").alias("node_ord")).select("id", "a.*", "node_ord")


def edges(df: DataFrame) -> DataFrame:
    """(src, dst, path, edge_ord), each edge once."""
    return units(df).groupBy(node_id("source_name").alias("src"), node_id("target_name").alias("dst"), "path").agg(F.min("unit_id").alias("edge_ord"))


def degrees(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree): distinct neighbours; a self-loop counts in both."""
    ends = edge_table.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    counted = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return node_table.select("id").join(counted, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def hinted(node_table: DataFrame) -> DataFrame:
    """Nodes with their hits by kind (arrays), computed once."""
    ext = text.suffix(F.col("path"))
    rows = node_table.withColumn("_corpus", hints.corpus("source_name", "target_name", "descr", "source_code")).withColumn("_ext", ext)
    for k in hints.KINDS:
        rows = rows.withColumn(f"{k}_hits", hints.hits(F.col("_corpus"), F.col("_ext"), k))
    return rows.drop("_corpus", "_ext")


def profile(node_table: DataFrame, *more: Column) -> DataFrame:
    """(id, path, counts and flags by kind, hint_score, n_lines), and more columns of the hinted nodes."""
    rows = hinted(node_table)
    counts = {k: F.size(f"{k}_hits") for k in hints.KINDS}
    return rows.select("id", "path", "node_ord", *[counts[k].alias(f"{k}_count") for k in hints.KINDS], *[(counts[k] > 0).alias(f"has_{k}") for k in hints.KINDS], hints.score(counts).alias("hint_score"), F.greatest(F.lit(1), text.line_count(F.col("source_code"))).alias("n_lines"), (F.col("source_code") != "").alias("has_source"), *more)


def prioritised(node_table: DataFrame, edge_table: DataFrame, *more: Column) -> DataFrame:
    """The profile with degrees and the node priority, and more columns of the hinted nodes."""
    rows = profile(node_table, *more).join(degrees(node_table, edge_table), "id")
    flags = sum(F.col(f"has_{k}").cast("int") * hints.PRIORITY[k] for k in hints.KINDS)
    return rows.withColumn("priority", flags + F.col("hint_score") * 5 + F.col("in_degree") + F.col("out_degree") + F.col("n_lines"))


def two_hop(edge_table: DataFrame, selected: DataFrame) -> DataFrame:
    """(root, id, hop): neighbours of the selected ids within two undirected steps, the nearer step wins."""
    near = edge_table.select("src", "dst").union(edge_table.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    zero = selected.select(F.col("id").alias("root"), "id", F.lit(0).alias("hop"))
    one = zero.join(near, zero["id"] == near["src"]).select("root", F.col("dst").alias("id"), F.lit(1).alias("hop"))
    two = one.join(near, one["id"] == near["src"]).select("root", F.col("dst").alias("id"), F.lit(2).alias("hop"))
    return zero.union(one).union(two).groupBy("root", "id").agg(F.min("hop").alias("hop"))


def head_subgraph(node_table: DataFrame, edge_table: DataFrame, n: int = 120) -> DataFrame:
    """Edges between the first n nodes in insertion order."""
    first = node_table.orderBy("node_ord", "id").limit(n).select("id")
    kept = edge_table.join(F.broadcast(first.withColumnRenamed("id", "src")), "src", "left_semi")  # n rows
    return kept.join(F.broadcast(first.withColumnRenamed("id", "dst")), "dst", "left_semi").select("src", "dst")


def view(node_table: DataFrame) -> DataFrame:
    """(id, label, title, grp, size) as a graph viewer takes them."""
    title = F.concat(F.lit("file: "), "name", F.lit("\npath: "), "path", F.lit("\nsummary: "), "descr", F.lit("\nlines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return node_table.select("id", F.when(F.col("source_name") != "", F.col("source_name")).otherwise(F.col("id")).alias("label"), title.alias("title"), F.when(F.col("name") != "", F.col("name")).otherwise(F.lit("default")).alias("grp"), F.when(F.col("source_code") != "", 14).otherwise(8).alias("size"))


def search_any_column(df: DataFrame, pattern: str) -> DataFrame:
    """Rows in which the lower-cased pattern is found in the lower-cased text of any column."""
    found = F.lit(False)
    for c in df.columns:
        found = found | F.coalesce(F.lower(F.col(c).cast("string")).rlike(pattern.lower()), F.lit(False))
    return df.where(found)


def with_property(node_table: DataFrame, edge_table: DataFrame, column: str, values: list[str], by: str = "node") -> DataFrame:
    """(id) of nodes whose property is among values; by='edge': of both ends of edges whose property is."""
    if by == "node":
        return node_table.where(F.col(column).isin(values)).select("id").distinct()
    hit = edge_table.where(F.col(column).isin(values))
    return hit.select(F.col("src").alias("id")).union(hit.select(F.col("dst").alias("id"))).distinct()
