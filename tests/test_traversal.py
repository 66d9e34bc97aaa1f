import random

import pytest
from pyspark.sql import functions as F
from spec import Spec

from codeloom.operators import graph, traversal


def random_graph(seed):
    r = random.Random(seed)
    ids = [f"n{k}" for k in range(r.randint(2, 9))]
    edges = list({(r.choice(ids), r.choice(ids)) for _ in range(r.randint(1, 22))})
    counts = {n: tuple(r.choice((0, 0, 0, 1, 2)) for _ in range(4)) for n in ids}
    return ids, edges, {n: r.randint(1, 5) for n in ids}, counts


def build(seed):
    ids, edges, priority, counts = random_graph(seed)
    return ids, traversal.FileGraph(priority, counts).link(edges), Spec(priority, counts, edges)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_paths_equal_enumeration(depth):
    for seed in range(250):
        ids, g, spec = build(seed)
        for root in ids:
            for reverse in (False, True):
                assert g.directed(root, depth, reverse) == spec.directed(root, depth, reverse)
            assert g.ranked(root, depth, 4) == spec.ranked(root, depth, 4)


def test_local_nodes_are_bounded_and_start_with_the_chains():
    for seed in range(100):
        ids, g, spec = build(seed)
        for limit in (1, 3, 6):
            local = g.local(ids[0], 2, limit, 6)
            assert len(local) == len(set(local)) <= limit
            flat = list(dict.fromkeys(n for _, p in spec.ranked(ids[0], 2, min(limit, 6)) for n in p))[:limit]
            assert local[:len(flat)] == flat


def test_tree_budget_and_branches():
    for seed in range(100):
        ids, g, _ = build(seed)
        t = g.tree(ids[0], 2, 6, 2)
        assert t["nodes"][0] == ids[0] and len(t["nodes"]) <= 6
        assert all(ids[0] in p for _, p in t["branches"])
        assert t["branches"] == sorted(t["branches"], key=lambda b: (-g.path_priority(b[1]), b[0] != "upstream", -len(b[1]), str(b[1])))


UNITS = "unit_id long, path string, name string, source_code string, start_code_line int, end_code_line int, source_name string, target_name string, source_desc string, extra string"


def test_graph_from_units(spark):
    rows = [(1, "/p/a.py", "a.py", "old", 1, 2, "f", "g", None, "x"), (3, "/p/a.py", None, "x = request.args", 1, 9, "f", "f", "d", "x"), (3, "/p/a.py", None, "x = request.args", 1, 9, "f", "f", "d", "x"), (2, "/p/b.py", "b.py", "", 1, 1, "f", "g", "", "x"), (4, None, "n", "c", 1, 1, "f", "g", "", "x")]
    df = spark.createDataFrame(rows, UNITS)
    nodes = {r.id: r for r in graph.nodes(df).collect()}
    assert set(nodes) == {"/p/a.py|f", "/p/a.py|g", "/p/b.py|f", "/p/b.py|g"}
    assert nodes["/p/a.py|f"].source_code == "x = request.args" and nodes["/p/a.py|g"].source_code == ""
    degrees = {r.id: (r.in_degree, r.out_degree) for r in graph.degrees(graph.nodes(df), graph.edges(df)).collect()}
    assert degrees["/p/a.py|f"] == (1, 2)  # the self-loop counts in both
    p = graph.prioritised(graph.nodes(df), graph.edges(df))
    assert traversal.directed_paths(p, graph.edges(df)).count() == 2
    empty = df.limit(0)
    assert traversal.trees(graph.prioritised(graph.nodes(empty), graph.edges(empty)), graph.edges(empty)).count() == 0


GOLDEN = [
    ("/p/a.py", "run", "subprocess.run", 'cmd = request.args.get("cmd")\nsubprocess.run(cmd, shell=True)', {"input": ["request.args"], "sink": ["subprocess.run"]}, 10),
    ("/p/a.py", "f", "g", "p.resolve()", {}, 0),
    ("/p/b.java", "h", "k", "void h(@RequestParam String a)", {}, 0),
    ("/p/c.txt", "q", "", "File file FILE", {"input": ["File", "file", "FILE"]}, 12),
    ("/p/d.py", "sel", "", 'q = "select a" + x + y', {"sink": ['select a" + x +']}, 6),
    ("/p/e.py", "safe", "", "validate(x); whitelist", {"validation": ["validate"], "safety": ["whitelist"]}, 3),
]


def test_golden_hints(spark):
    rows = [(k, p, p, c, 1, 1, s, t or "zz", "", "") for k, (p, s, t, c, _, _) in enumerate(GOLDEN)]
    nodes = graph.nodes(spark.createDataFrame(rows, UNITS)).where("source_code <> ''").withColumn("target_name", F.expr("nullif(target_name, 'zz')"))
    hits = {r.id: r for r in graph.hinted(nodes).collect()}
    scores = {r.id: r.hint_score for r in graph.profile(nodes).collect()}
    for p, s, _, _, want, score in GOLDEN:
        got = hits[f"{p}|{s}"]
        assert {k: got[f"{k}_hits"] for k in ("input", "sink", "validation", "safety") if got[f"{k}_hits"]} == want
        assert scores[f"{p}|{s}"] == score
