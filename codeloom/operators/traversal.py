"""Paths, local neighbourhoods and dependency trees, by one kernel per file's graph.

A file's graph is closed (no edge leaves a path), so graphs are grouped by path and walked independently.  Shortest paths keep, per node and
level, only the best candidate of each combination of the four flags: the priority of a path is a function of the flags plus a
sum over its nodes, so within one combination only the largest sum can win, and among equal sums the one found first.  That bounds
the work that enumeration of all shortest paths would make exponential, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

UPSTREAM, DOWNSTREAM, THROUGH = "upstream", "downstream", "through"
COUNTS = ("input_count", "sink_count", "validation_count", "safety_count")


@dataclass
class FileGraph:
    """Adjacency of one file with what the priorities need, neighbours in the order in which they are visited."""

    priority: dict[str, int]
    counts: dict[str, tuple[int, int, int, int]]
    succ: dict[str, list[str]] = field(default_factory=dict)
    pred: dict[str, list[str]] = field(default_factory=dict)
    extra: dict[str, tuple] = field(default_factory=dict)

    def link(self, edges: list[tuple[str, str]]) -> FileGraph:
        for a, b in edges:
            self.succ.setdefault(a, []).append(b)
            self.pred.setdefault(b, []).append(a)
        for side in (self.succ, self.pred):
            for ns in side.values():
                ns.sort(key=self.order)
        return self

    def order(self, n: str) -> tuple[int, str]:
        return -self.priority[n], n

    def linear(self, n: str) -> int:
        i, s, v, f = self.counts[n]
        return 40 * s + 25 * i + 8 * v + 5 * f + 10 + self.priority[n]

    def flags(self, n: str) -> int:
        return sum((c > 0) << k for k, c in enumerate(self.counts[n]))

    @staticmethod
    def chain(flags: int) -> int:
        """What a path gets for the combination of input (1), sink (2), validation (4) and safety (8) on it."""
        both = flags & 3 == 3
        return 80 * (flags & 1) + 100 * (flags >> 1 & 1) + 180 * both + 140 * (both and not flags & 12)

    def path_priority(self, path: list[str]) -> int:
        flags = 0
        for n in path:
            flags |= self.flags(n)
        return self.chain(flags) + sum(map(self.linear, path))

    def summary(self, path: list[str]) -> tuple[int, ...]:
        return tuple(map(sum, zip(*(self.counts[n] for n in path)))) if path else (0, 0, 0, 0)

    def directed(self, root: str, depth: int, reverse: bool = False) -> list[list[str]]:
        """The best shortest path to each node within depth steps, best first; in reverse the paths lead to the root."""
        side = self.pred if reverse else self.succ
        level: dict[str, dict[int, tuple[int, tuple, list[str]]]] = {root: {self.flags(root): (self.linear(root), (), [root])}}
        seen, best = {root}, {}
        for _ in range(depth):
            following: dict[str, dict[int, tuple[int, tuple, list[str]]]] = {}
            for states in level.values():
                for flags, (total, key, path) in states.items():
                    for k, n in enumerate(side.get(path[-1], ())):
                        if n in seen:
                            continue
                        state = (total + self.linear(n), (*key, k), [*path, n])
                        mine, f = following.setdefault(n, {}), flags | self.flags(n)
                        if f not in mine or (-state[0], state[1]) < (-mine[f][0], mine[f][1]):
                            mine[f] = state
            for n, states in following.items():
                _, path = min(((-(total + self.chain(f)), key), path) for f, (total, key, path) in states.items())
                best[n] = path[::-1] if reverse else path
            seen |= following.keys()
            level = following
            if not level:
                break
        return sorted(best.values(), key=lambda p: (-self.path_priority(p), str(p)))

    def ranked(self, root: str, depth: int, limit: int) -> list[tuple[str, list[str]]]:
        """Up to limit chains around the root: leading to it, away from it, and through it."""
        inbound, outbound = self.directed(root, depth, True), self.directed(root, depth)
        chains = [(UPSTREAM, p) for p in inbound] + [(DOWNSTREAM, p) for p in outbound]
        chains += [(THROUGH, a + b[1:]) for a in inbound[:limit] for b in outbound[:limit]]
        return sorted(chains, key=lambda c: (-self.path_priority(c[1]), c[0] != THROUGH, str(c[1])))[:limit]

    def local(self, root: str, depth: int, max_nodes: int, focus: int) -> list[str]:
        """Nodes around the root: those of its ranked chains in order, then breadth first until max_nodes."""
        found = dict.fromkeys(n for _, p in self.ranked(root, depth, min(max_nodes, max(1, focus))) for n in p)
        if len(found) >= max_nodes:
            return list(found)[:max_nodes]
        found.setdefault(root)
        ring = [root]
        for _ in range(depth):
            following = []
            for at in ring:
                for n in sorted([*self.pred.get(at, ()), *self.succ.get(at, ())], key=self.order):
                    if n not in found:
                        found[n] = None
                        following.append(n)
                        if len(found) >= max_nodes:
                            return list(found)
            ring = following
        return list(found)

    def branches(self, root: str, depth: int, max_nodes: int, width: int, up: bool) -> tuple[list[str], list[tuple[str, str]], list[list[str]]]:
        """(nodes in order, edges, branches best first) of one side of a dependency tree; the budget counts the root."""
        side, turn = (self.pred, lambda p: p[::-1]) if up else (self.succ, lambda p: p)
        found, edges, ends, level = {root: None}, [], [], [[root]]
        for reach in range(depth + 1):  # all paths of a level before those of the next
            longer: list[list[str]] = []
            for path in level:
                if len(found) >= max_nodes:
                    break
                steps = side.get(path[-1], ())[:width] if reach < depth else ()
                if not steps:
                    ends.append(turn(path))
                for n in steps:
                    edges.append((n, path[-1]) if up else (path[-1], n))
                    new = n not in found and len(found) < max_nodes
                    (longer if new else ends).append([*path, n] if new else turn([*path, n]))
                    if new:
                        found[n] = None
            level = longer
        unique = [list(p) for p in dict.fromkeys(map(tuple, ends or [[root]]))]
        unique.sort(key=lambda p: (-self.path_priority(p), -len(p), str(p)))
        return list(found)[1:], edges, unique

    def tree(self, root: str, depth: int, max_nodes: int, width: int) -> dict:
        half = max(2, max_nodes // 2)
        up = self.branches(root, depth, half, width, True)
        down = self.branches(root, depth, max(2, max_nodes - half), width, False)
        nodes = list(dict.fromkeys([root, *up[0], *down[0]]))[:max(1, max_nodes)]
        ends = [(UPSTREAM, p) for p in up[2]] + [(DOWNSTREAM, p) for p in down[2]]
        ends.sort(key=lambda b: (-self.path_priority(b[1]), b[0] != UPSTREAM, -len(b[1]), str(b[1])))
        return {"root": root, "nodes": nodes, "edges": up[1] + down[1], "branches": ends, "upstream": len(up[2]), "downstream": len(down[2])}

    def tree_priority(self, tree: dict) -> int:
        return sum(self.priority[n] for n in tree["nodes"])


ROW = "path string, kind int, id string, dst string, priority long, input_count int, sink_count int, validation_count int, safety_count int, node_ord long, has_source boolean"


def per_file(nodes: DataFrame, edges: DataFrame, walk: Callable[[FileGraph, list[str], list[str]], list[tuple]], schema: str, columns: list[str], extra: tuple[str, ...] = (), frame_rows: int = 20_000) -> DataFrame:
    """walk(graph, ids, ids with source) for each file's graph; nodes are rows of ``graph.prioritised``, with the columns of extra ('name type').

    Nodes and edges of a path are brought together once and walked as a sorted stream: one Python call per batch, not per file.  One
    file's graph is in memory at a time; its size is bounded by the file's own code.
    """
    fields = [x.split(" ")[0] for x in (*ROW.split(", "), *extra)]
    n_base = len(fields) - len(extra)
    left = nodes.select("path", F.lit(0).alias("kind"), "id", F.lit(None).cast("string").alias("dst"), F.col("priority").cast("long").alias("priority"), *[F.col(c).cast("int").alias(c) for c in COUNTS], "node_ord", "has_source", *[F.col(x.split(" ")[0]).cast(x.split(" ")[1]).alias(x.split(" ")[0]) for x in extra])
    right = edges.select("path", F.lit(1).alias("kind"), F.col("src").alias("id"), "dst", F.lit(None).cast("long").alias("priority"), *[F.lit(None).cast("int").alias(c) for c in COUNTS], F.lit(None).cast("long").alias("node_ord"), F.lit(None).cast("boolean").alias("has_source"), *[F.lit(None).cast(x.split(" ")[1]).alias(x.split(" ")[0]) for x in extra])
    rows = left.unionByName(right).select(*fields).repartition("path").sortWithinPartitions("path", "kind", "node_ord", "id")

    def solve(held: list[tuple]) -> list[tuple]:
        own = [r for r in held if r[1] == 0]
        g = FileGraph({r[2]: r[4] for r in own}, {r[2]: r[5:9] for r in own}, extra={r[2]: r[n_base:] for r in own}).link([(r[2], r[3]) for r in held if r[1] == 1])
        return walk(g, [r[2] for r in own], [r[2] for r in own if r[10]])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        for batch in it:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][0] != r[0]:
                    out += solve(held)
                    held = []
                    if len(out) > frame_rows:
                        yield from pack(out)
                        out = []
                held.append(r)
        yield from pack(out + (solve(held) if held else []))

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def pack(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        cols = list(zip(*out)) if out else [()] * len(columns)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return rows.mapInArrow(run, schema)


def directed_paths(nodes: DataFrame, edges: DataFrame, depth: int = 2, reverse: bool = False) -> DataFrame:
    """(root, target, n_nodes, chain, input_count, sink_count, validation_count, safety_count, priority) for every root."""

    def walk(g: FileGraph, ids: list[str], own: list[str]) -> list[tuple]:
        return [(r, p[0] if reverse else p[-1], len(p), " -> ".join(p), *g.summary(p), g.path_priority(p)) for r in ids for p in g.directed(r, depth, reverse)]

    return per_file(nodes, edges, walk, "root string, target string, n_nodes int, chain string, input_count int, sink_count int, validation_count int, safety_count int, priority long", ["root", "target", "n_nodes", "chain", *COUNTS, "priority"])


def ranked_paths(nodes: DataFrame, edges: DataFrame, depth: int = 2, limit: int = 6) -> DataFrame:
    """(root, rank, kind, chain, priority): the best chains of every node with source."""

    def walk(g: FileGraph, ids: list[str], own: list[str]) -> list[tuple]:
        return [(r, k + 1, kind, " -> ".join(p), g.path_priority(p)) for r in own for k, (kind, p) in enumerate(g.ranked(r, depth, limit))]

    return per_file(nodes, edges, walk, "root string, rank int, kind string, chain string, priority long", ["root", "rank", "kind", "chain", "priority"])


def local_nodes(nodes: DataFrame, edges: DataFrame, depth: int = 2, max_nodes: int = 12, focus: int = 6) -> DataFrame:
    """(root, ord, id) of every node with source."""

    def walk(g: FileGraph, ids: list[str], own: list[str]) -> list[tuple]:
        return [(r, k, n) for r in own for k, n in enumerate(g.local(r, depth, max_nodes, focus))]

    return per_file(nodes, edges, walk, "root string, ord int, id string", ["root", "ord", "id"])


def trees(nodes: DataFrame, edges: DataFrame, depth: int = 2, max_nodes: int = 12, width: int = 3) -> DataFrame:
    """(root, nodes, n_edges, branches, upstream, downstream, tree_priority) of every node with source."""

    def walk(g: FileGraph, ids: list[str], own: list[str]) -> list[tuple]:
        rows = []
        for r in own:
            t = g.tree(r, depth, max_nodes, width)
            rows.append((r, t["nodes"], len(t["edges"]), [{"direction": d, "path": p} for d, p in t["branches"]], t["upstream"], t["downstream"], g.tree_priority(t)))
        return rows

    return per_file(nodes, edges, walk, "root string, nodes array<string>, n_edges int, branches array<struct<direction:string,path:array<string>>>, upstream int, downstream int, tree_priority long", ["root", "nodes", "n_edges", "branches", "upstream", "downstream", "tree_priority"])


def local_summary(local: DataFrame, profile: DataFrame) -> DataFrame:
    """(root, n_nodes, input_nodes, sink_nodes, validation_nodes, safety_nodes, combined_nodes)."""
    rows = local.join(profile.select("id", "has_input", "has_sink", "has_validation", "has_safety"), "id")
    count = lambda c: F.sum(c.cast("int"))
    return rows.groupBy("root").agg(F.count("*").alias("n_nodes"), *[count(F.col(f"has_{k}")).alias(f"{k}_nodes") for k in ("input", "sink", "validation", "safety")], count(F.col("has_input") & F.col("has_sink")).alias("combined_nodes"))


def prescreened(prioritised: DataFrame, summary: DataFrame, threshold: int = 8) -> DataFrame:
    """(id, prescreen_score, is_candidate, n_local): the cheap test before contexts are built."""
    rows = prioritised.join(summary.withColumnRenamed("root", "id"), "id")
    c = F.col
    score = c("input_count") * 8 + c("sink_count") * 10 + c("validation_count") * 3 + c("safety_count") * 2 + c("input_nodes") * 4 + c("sink_nodes") * 5 + c("combined_nodes") * 12 + F.least(F.lit(6), c("in_degree") + c("out_degree"))
    direct = c("has_input") | c("has_sink") | c("has_validation") | c("has_safety")
    chain = (c("combined_nodes") > 0) | ((c("input_nodes") > 0) & (c("sink_nodes") > 0))
    keep = F.lit(True) if threshold < 0 else direct | chain | (score >= max(1, threshold))
    return rows.select("id", score.alias("prescreen_score"), keep.alias("is_candidate"), c("n_nodes").alias("n_local"))


def tree_scores(tree_table: DataFrame, prioritised: DataFrame) -> DataFrame:
    """(root, tree_score): hints, degrees and lines of the tree's nodes, its branches, and what the combination adds."""
    per_node = tree_table.select("root", F.explode("nodes").alias("id")).join(prioritised.select("id", "hint_score", "in_degree", "out_degree", "n_lines", *COUNTS), "id")
    sums = per_node.groupBy("root").agg(F.sum(F.col("hint_score") * 5 + F.col("in_degree") + F.col("out_degree") + F.col("n_lines")).alias("base"), *[F.sum(c).alias(c) for c in COUNTS])
    bonus = F.aggregate("branches", F.lit(0), lambda s, b: s + F.least(F.lit(120), F.size(b["path"]) * 15) + F.when(b["direction"] == DOWNSTREAM, 20).otherwise(0))
    i, s, v, f = (F.col(c) for c in COUNTS)
    both = (i > 0) & (s > 0)
    total = F.col("base") + F.col("bonus") + 25 * i + 35 * s + 8 * v + 5 * f + F.when(both, 200).otherwise(0) + F.when(both & (v == 0) & (f == 0), 150).otherwise(0)
    return tree_table.select("root", bonus.alias("bonus")).join(sums, "root").select("root", total.alias("tree_score"))


def global_trees(tree_table: DataFrame, limit: int) -> DataFrame:
    """The first trees by priority, branches, nodes, root."""
    return tree_table.orderBy(F.desc("tree_priority"), F.desc(F.size("branches")), F.desc(F.size("nodes")), "root").limit(limit)
