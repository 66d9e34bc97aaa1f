import random

from pyspark.sql import functions as F

from codeloom.operators import contexts, graph, traversal

UNITS = "unit_id long, path string, name string, source_code string, start_code_line int, end_code_line int, source_name string, target_name string, source_desc string, label string, body string"


def build(seed):
    r = random.Random(seed)
    ids = [f"n{k}" for k in range(r.randint(1, 9))]
    g = traversal.FileGraph({i: r.randint(0, 9) for i in ids}, {i: tuple(r.choice((0, 0, 1, 2)) for _ in range(4)) for i in ids}, extra={i: (i.upper(), "x" * r.randint(1, 400), 40) for i in ids})
    return ids, g.link(list({(r.choice(ids), r.choice(ids)) for _ in range(r.randint(0, 20))}))


def plain(w, g, root, depth, max_nodes, focus, limit):
    """Every size from the greatest on, written from nothing each time."""
    for d in range(depth, 0, -1):
        for m in range(max_nodes, 0, -1):
            ids, ranked = g.local(root, d, m, focus), g.ranked(root, d, min(m, max(1, focus)))
            head = ["<context_summary>", *[w.chain(f"chain_{k}", kind, p) for k, (kind, p) in enumerate(ranked)], "<context_summary>"] if ranked else []
            payload = "\n".join([*head, *w.blocks(ids)])
            if w.tokens(root, payload) <= limit:
                return d, m, ids, payload, w.tokens(root, payload)
    return None


def test_shrinking_equals_trying_every_size():
    shrunk = lost = 0
    for seed in range(150):
        ids, g = build(seed)
        for limit in (30, 150, 300, 600):
            w = contexts.Writer(g, limit)
            got = w.local(ids[0], 2, 7, 3)
            assert got == plain(w, g, ids[0], 2, 7, 3, limit)
            shrunk += bool(got) and got[:2] != (2, 7)
            lost += got is None
    assert shrunk > 50 and lost > 50


def test_tree_contexts_name_eight_branches():
    for seed in range(60):
        ids, g = build(seed)
        nodes, payload, tokens = contexts.Writer(g, None).tree(ids[0], 2, 12, 3, 6)
        t = g.tree(ids[0], 2, 12, 3)
        assert nodes == t["nodes"] and payload.count("\nupstream_") + payload.count("\ndownstream_") == 2 + min(8, len(t["branches"]))
        assert payload.startswith("<context_summary>\nroot: N0\n") and payload.endswith(f"<node_{len(nodes) - 1}>")
        assert contexts.Writer(g, tokens).tree(ids[0], 2, 12, 3, 6) and contexts.Writer(g, tokens - 1).tree(ids[0], 2, 12, 3, 6) is None


def test_tables(spark):
    rows = [(1, "/p/a.py", "a.py", "eval(request.args)", 1, 2, "f", "g", None, "clash", "clash"), (1, "/p/a.py", "a.py", "eval(request.args)", 1, 2, "f", "g", None, "clash", "clash"), (2, "/p/a.py", None, "x", None, None, "g", "h", "d", None, None), (3, None, None, None, None, None, "f", "g", None, None, None)]
    u = spark.createDataFrame(rows, UNITS)
    nodes, edges = contexts.nodes_with_texts(graph.nodes(u), graph.edges(u)), graph.edges(u)
    got = {r.root: r for r in contexts.local_contexts(nodes, edges).collect()}
    assert set(got) == {"/p/a.py|f", "/p/a.py|g"} and "code:\neval(request.args)" in got["/p/a.py|f"].payload and got["/p/a.py|f"].nodes[0] in ("/p/a.py|f", "/p/a.py|g")
    assert contexts.local_contexts(nodes, edges, limit=1).count() == 0
    trees = contexts.tree_contexts(nodes, edges, spark.createDataFrame([("/p/a.py|f",), ("/p/a.py|f",), ("none",)], "root string"))
    assert [r.root for r in trees.collect()] == ["/p/a.py|f"]
    none = graph.nodes(u.limit(0))
    assert contexts.local_contexts(contexts.nodes_with_texts(none, graph.edges(u.limit(0))), graph.edges(u.limit(0))).count() == 0
    a = spark.createDataFrame([("t", 5, 9, 1, "s1"), ("u", 4, 9, 2, "s2")], "root string, score long, tokens long, ord long, payload_sig string")
    b = spark.createDataFrame([("n", 5, 9, 1, "s3"), ("m", 5, 10, 2, "s4"), ("o", 9, 1, 3, "s1")], "root string, score long, tokens long, ord long, payload_sig string")
    assert [r.root for r in contexts.merged(a, b).collect()] == ["o", "m", "n", "u"] and [r.root for r in contexts.merged(a, b, -1).collect()] == ["o", "m", "t", "n", "u"]
    assert contexts.merged(a, b).where(F.col("kind") == 0).count() == 1
