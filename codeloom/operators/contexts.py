"""Contexts in full: chains, tree summaries and node blocks, shrunk until they fit the reviewer's input, ordered for review.

Everything a context says is about one file, so contexts are written where the file's graph is walked: each node's block reaches that
task once, however many contexts it stands in, and no text is joined or gathered afterwards.  A context that fits at no size gives
no row; a limit of None lets everything pass.  Nodes without code are roots of no context; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import graph, payloads, reviewer, traversal
from .traversal import UPSTREAM, FileGraph

#: Branches that a tree's summary names.
SHOWN_BRANCHES = 8
#: Contexts in one frame; each holds the code of several nodes.
FRAME_ROWS = 500
EXTRA = ("label string", "body string", "prompt_chars long")


def node_texts() -> tuple[Column, Column, Column]:
    """label, body, prompt_chars of the rows of ``graph.hinted``: what contexts call a node and say about it, and its prompt's length."""
    label = F.coalesce(F.nullif("source_name", F.lit("")), F.nullif("target_name", F.lit("")), "id")
    prompt = reviewer.audit_prompt(F.array(text.suffix(F.col("path"))))
    return label.alias("label"), payloads.node_body().alias("body"), F.length(F.concat(F.lit("system: "), prompt)).cast("long").alias("prompt_chars")


def nodes_with_texts(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """``graph.prioritised`` with what contexts say about each node; the hints are found once for both."""
    return graph.prioritised(node_table, edge_table, *node_texts())


def _counts(counts: tuple) -> list[str]:
    return [f"{k}: {n}" for k, n in zip(traversal.COUNTS, counts)]


class Writer:
    """Writes the contexts of one file's graph; tokens are counted by the length of the messages."""

    def __init__(self, g: FileGraph, limit: int | None):
        self.g, self.limit = g, limit

    def chain(self, tag: str, kind: str, path: list[str]) -> str:
        return "\n".join([f"<{tag}>", f"kind: {kind}", "path: " + " -> ".join(self.g.extra[n][0] for n in path), *_counts(self.g.summary(path)), f"<{tag}>"])

    def tokens(self, root: str, payload: str) -> int:
        return -(-self.g.extra[root][2] // 4) + -(-(len("user: ") + len(payload)) // 4)

    def blocks(self, ids: list[str]) -> list[str]:
        return [f"<node_{k}>\n{self.g.extra[n][1]}\n<node_{k}>" for k, n in enumerate(ids)]

    def local(self, root: str, depth: int, max_nodes: int, focus: int) -> tuple | None:
        """(depth, node limit, nodes, payload, tokens) at the greatest depth, then the greatest node limit, at which the context fits."""
        for d in range(depth, 0, -1):
            full = self.g.local(root, d, max_nodes, focus)
            for m in range(max_nodes, 0, -1):
                chains = min(m, max(1, focus))
                # with as many chains the smaller context is the beginning of the larger one
                ids = full[:m] if chains == min(max_nodes, max(1, focus)) else self.g.local(root, d, m, focus)
                if m < max_nodes and len(full) < m and chains == min(max_nodes, max(1, focus)):
                    continue  # the same context as one above
                ranked = self.g.ranked(root, d, chains)
                head = ["<context_summary>", *[self.chain(f"chain_{k}", kind, p) for k, (kind, p) in enumerate(ranked)], "<context_summary>"] if ranked else []
                payload = "\n".join([*head, *self.blocks(ids)])
                used = self.tokens(root, payload)
                if self.limit is None or used <= self.limit:
                    return d, m, ids, payload, used
        return None

    def tree(self, root: str, depth: int, max_nodes: int, width: int, focus: int) -> tuple | None:
        """(nodes, payload, tokens) of the root's dependency tree if it fits."""
        t = self.g.tree(root, depth, max_nodes, width)
        n = len(t["branches"])
        ranked = self.g.ranked(root, max(2, n), min(max(1, focus), max(3, n)))
        lines = ["<context_summary>", f"root: {self.g.extra[root][0]}", f"nodes: {len(t['nodes'])}", f"edges: {len(t['edges'])}", f"branches: {n}", f"upstream_branches: {t['upstream']}", f"downstream_branches: {t['downstream']}"]
        lines += [f"root_{x}" for x in _counts(self.g.counts[root])]
        lines += [f"{'upstream' if kind == UPSTREAM else 'downstream'}_{k}: " + " -> ".join(self.g.extra[x][0] for x in path) for k, (kind, path) in enumerate(t["branches"][:SHOWN_BRANCHES])]
        if ranked:
            lines += [f"focus_chains: {len(ranked)}", *[self.chain(f"focus_{k}", kind, p) for k, (kind, p) in enumerate(ranked)]]
        payload = "\n".join([*lines, "<context_summary>", *self.blocks(t["nodes"])])
        used = self.tokens(root, payload)
        return (t["nodes"], payload, used) if self.limit is None or used <= self.limit else None


def local_contexts(nodes: DataFrame, edges: DataFrame, depth: int = 2, max_nodes: int = 12, focus: int = 6, limit: int | None = None) -> DataFrame:
    """(root, depth, node_limit, nodes, payload, message_tokens) of every node with source (of ``nodes_with_texts``) whose context fits at some size."""

    def walk(g: FileGraph, ids: list[str], own: list[str]) -> list[tuple]:
        w = Writer(g, limit)
        return [(r, *c) for r in own if (c := w.local(r, depth, max_nodes, focus))]

    return traversal.per_file(nodes, edges, walk, "root string, depth int, node_limit int, nodes array<string>, payload string, message_tokens long", ["root", "depth", "node_limit", "nodes", "payload", "message_tokens"], EXTRA, FRAME_ROWS)


def tree_contexts(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 2, max_nodes: int = 12, width: int = 3, focus: int = 6, limit: int | None = None) -> DataFrame:
    """(root, nodes, payload, message_tokens) of the trees of roots (root) that fit."""

    def walk(g: FileGraph, ids: list[str], own: list[str]) -> list[tuple]:
        w = Writer(g, limit)
        return [(r, *c) for r in own if (c := w.tree(r, depth, max_nodes, width, focus))]

    wanted = roots.select(F.col("root").alias("id"), F.lit(True).alias("_wanted")).distinct()
    nodes = nodes.join(wanted, "id", "left").withColumn("has_source", F.col("has_source") & F.col("_wanted").isNotNull()).drop("_wanted")
    return traversal.per_file(nodes, edges, walk, "root string, nodes array<string>, payload string, message_tokens long", ["root", "nodes", "payload", "message_tokens"], EXTRA, FRAME_ROWS)


def merged(trees: DataFrame, nodes: DataFrame, limit: int = 1) -> DataFrame:
    """(kind, root, score, tokens, ord, payload_sig): tree and node payloads (root, score, tokens, ord, payload_sig) as
    one list, best first, each payload at most max(1, limit) times; a negative limit keeps all."""
    rows = trees.select(F.lit(0).alias("kind"), "root", "score", "tokens", "ord", "payload_sig").unionByName(nodes.select(F.lit(1).alias("kind"), "root", "score", "tokens", "ord", "payload_sig"))
    return payloads.ordered(payloads.first_per_signature(rows, ["payload_sig"], [F.desc("score"), F.desc("tokens"), "kind", "ord"], limit))
