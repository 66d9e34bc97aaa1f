import random

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import mixing, packing, prose, splitting, tokens

LETTERS = st.text(st.sampled_from("ab c\n\t 1é中'\u00a0\u2003.-_s²Ⅷ٣tl'"), max_size=300)


@settings(max_examples=150, deadline=None)
@given(LETTERS, st.integers(1, 40))
def test_parts_add_up(text, size):
    enc = tokens.encoding()
    cut = tokens.parts(text, size)
    assert "".join(cut) == text and sum(len(enc.encode_ordinary(p)) for p in cut) == len(enc.encode_ordinary(text))


def test_text_without_blanks_is_cut():
    enc = tokens.encoding()
    for text in ("a1" * 50_000, "QUJDREVGR0g5+/x0" * 8_000, "f(a,b);" * 20_000):
        cut = tokens.parts(text, 10_000)
        assert len(cut) > 5 and max(map(len, cut)) < 10_100 and sum(len(enc.encode_ordinary(p)) for p in cut) == len(enc.encode_ordinary(text))


def test_counts(spark):
    long_text = "word and more\n" * 9000
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, ""), (3, None), (4, long_text), (4, long_text), (None, "x")], "id long, text string")
    enc = tokens.encoding()
    assert {r.id: r.n_tokens for r in tokens.counts(df, "id", "text").collect()} == {1: 2, 2: 0, 4: len(enc.encode_ordinary(long_text))}
    assert tokens.counts(df.limit(0), "id", "text").count() == 0


def test_budget(spark):
    files = spark.createDataFrame([(1, "r", "/a.py", ".PY", "x = 1"), (1, "r", "/a.py", ".PY", "x = 1"), (2, "r", "/b.py", None, None)], "file_id long, repo string, path string, extension string, source_code string")
    docs = spark.createDataFrame([(1, "Audit Report", "en-US", "a b"), (2, None, None, "c")], "doc_id long, source string, lang string, text string")
    repos = spark.createDataFrame([("r", "d")], "repo string, repo_domain string")
    got = {(r.kind, r["slice"], r.domain, r.language): (r.records, r.tokens) for r in tokens.budget(files, docs, repos).collect()}
    assert got == {("code", "r", "d", "python"): (2, 3), ("text", "audit_report", None, "en"): (1, 2), ("text", None, None, None): (1, 1)}


# ---------------------------------------------------------------- splitting

@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab (){};"), max_size=30), min_size=1, max_size=40), st.integers(8, 120), st.integers(0, 4))
def test_pieces(lines, limit, overlap):
    code = "\n".join(lines)
    found = splitting.cuts(code, ".js", limit, overlap)
    assert found[0][1] == 0 and found[-1][2] == len(code)
    for (a, b, c), following in zip(found, [*found[1:], None]):
        assert a <= b < c or not code
        assert c - a <= limit
        if following:
            assert following[1] == c and following[0] <= c


def test_cuts_equal_a_walk():
    r = random.Random(3)
    for _ in range(60):
        code = "".join(r.choice(["def f(a):\n", "    x = 1\n", "    yyyyyyyy = zzzz\n", "\n"]) for _ in range(r.randint(5, 80)))
        limit, overlap = r.randint(40, 200), r.randint(0, 3)
        found = {b: c for _, b, c in splitting.cuts(code, ".py", limit, overlap)}
        at, walked = 0, []
        while at < len(code):
            walked.append(at)
            at = found[at]
        assert walked == sorted(found)


def test_overlap_and_lines(spark):
    code = "".join(f"line {k}\n" for k in range(100))
    files = spark.createDataFrame([(1, code, ".py", "/a.py", 5, "z"), (1, code, ".py", "/a.py", 5, "z"), (2, "x" * 100, ".py", "/b.py", None, None), (3, "x" * 101, None, "/c.zz", 0, None), (4, None, ".py", "/d.py", 1, None), (5, "é" * 100, "PY", "/e", 1, None)], "file_id long, source_code string, extension string, path string, start_line int, max_chars string")
    limits = spark.createDataFrame([(".py", 100, 2), ("*", 100, 1), (None, 3, 3)], "extension string, max_chars int, overlap_lines int")
    rows = splitting.pieces(files, limits).orderBy("file_id", "piece_no").collect()
    assert {r.file_id for r in rows} == {1, 3}
    one = [r for r in rows if r.file_id == 1]
    assert all(len(r.piece) <= 100 for r in rows) and one[0].start_line == 5
    for r in one:
        first = int(r.piece.split("\n")[0].split()[1])
        assert r.start_line == first + 5 and (r.piece_no == 0 or r.overlap_chars == len("".join(f"line {k}\n" for k in (first, first + 1))))
    assert "".join(r.piece[r.overlap_chars:] for r in one) == code and not any(r.overlap_short for r in one)
    wide = splitting.pieces(spark.createDataFrame([(7, ("x" * 40 + "\n") * 9, ".py", "/a.py", 1, None)], files.schema), limits).collect()
    assert len(wide) > 1 and all(r.overlap_short == (r.piece_no > 0) for r in wide)
    assert splitting.pieces(files.limit(0), limits).count() == 0 and splitting.pieces(files, limits.limit(0)).count() == 0


# ---------------------------------------------------------------- packing

def plain_pack(sizes, capacity, most):
    bins, free, out, n = [], {}, [], 0
    for s in sizes:
        fit = [b for b in bins if free[b] >= s]
        if fit:
            room = min(free[b] for b in fit)
            b = [x for x in bins if free[x] == room][-1]
        else:
            if len(bins) >= most:
                room = min(free[b] for b in bins)
                bins.remove([b for b in bins if free[b] == room][-1])
            b, n = n, n + 1
            bins.append(b)
            free[b] = capacity
        free[b] -= s
        out.append(b)
        # a bin that takes an item moves behind the others with its room
        bins.remove(b)
        if free[b] > 0:
            bins.append(b)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=120), st.integers(20, 40), st.integers(1, 6))
def test_pack_equals_plain_best_fit(sizes, capacity, most):
    got = packing.pack(sizes, capacity, most)
    assert got == plain_pack(sizes, capacity, most)
    loads = {}
    for b, s in zip(got, sizes):
        loads[b] = loads.get(b, 0) + s
    assert all(v <= capacity for v in loads.values())


def test_containers(spark):
    r = random.Random(5)
    sizes = [(k, r.randint(1, 300)) for k in range(400)] + [(1000, 1700), (1001, 512), (1002, 0)]
    df = spark.createDataFrame([*sizes, sizes[0], (2000, None)], "doc_id long, n_tokens long")
    profiles = spark.createDataFrame([("small", 512), ("large", 8192)], "profile string, capacity_tokens int")
    rows = packing.containers(df, profiles).collect()
    for profile, cap in (("small", 512), ("large", 8192)):
        own = [x for x in rows if x.profile == profile]
        loads, whole = {}, {}
        for x in own:
            loads[x.container] = loads.get(x.container, 0) + x.tokens
            whole.setdefault(x.doc_id, []).append((x.part, x.tokens))
        assert max(loads.values()) <= cap and set(whole) == {k for k, _ in sizes}
        assert all(sum(t for _, t in parts) == dict(sizes)[k] for k, parts in whole.items())
        assert all(len(parts) == 1 or dict(sizes)[k] > cap for k, parts in whole.items())
    fill = {x.profile: x.fill_rate for x in packing.fill_rates(packing.containers(df, profiles), profiles).collect()}
    assert fill["small"] > 0.95
    assert packing.containers(df.limit(0), profiles).count() == 0


# ---------------------------------------------------------------- mixing

def test_budgets_are_spent_while_a_text_fits(spark):
    r = random.Random(4)
    rows = [(k, " ".join(["word"] * r.choice((3, 50, 400)) + [f"n{k}"]), "a" if k % 2 else "b") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    chosen, plan = mixing.mixture(docs, targets, spark.createDataFrame([], "doc_id long, weight double"))
    got = chosen.collect()
    sizes = {x.doc_id: x.n_tokens for x in tokens.counts(docs, "doc_id", "text").collect()}
    for p in plan.collect():
        used = sum(x.n_tokens * x.uses for x in got if x.source == p.source)
        left = [n for k, n in sizes.items() if ("a" if k % 2 else "b") == p.source and k not in {x.doc_id for x in got}]
        assert used <= p.budget and (not left or min(left) > p.budget - used)


def test_mixture(spark):
    rows = [(k, f"text number {k} with some words", "Big") for k in range(600)] + [(1000 + k, f"small text {k} here", "small") for k in range(20)]
    rows += [(5000, "small text 3 here", "small"), (5001, None, "small"), (5002, "  ", "small"), (5003, "other text", None), (5004, "x y z", "untargeted")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, source string, key string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.25, 4), ("absent", 0.25, 2)], "source string, target_share double, max_repeats int")
    weights = spark.createDataFrame([(k, 1.0) for k in range(10)], "doc_id long, weight double")
    chosen, plan = mixing.mixture(docs, targets, weights)
    got = chosen.collect()
    assert {r.source for r in got} == {"big", "small"} and 5000 not in {r.doc_id for r in got}
    assert max(r.uses for r in got if r.source == "big") == 1 and max(r.uses for r in got if r.source == "small") <= 4
    shares = {r.source: r.actual_share for r in mixing.shares(chosen, plan).collect()}
    assert abs(shares["big"] - 2 / 3) < 0.02 and abs(shares["small"] - 1 / 3) < 0.02 and shares["absent"] == 0
    again, _ = mixing.mixture(docs.repartition(7), targets, weights)
    assert sorted((r.doc_id, r.uses) for r in again.collect()) == sorted((r.doc_id, r.uses) for r in got)
    empty, plan = mixing.mixture(docs.limit(0), targets, weights)
    assert empty.count() == 0 and mixing.shares(empty, plan).count() == 3


def test_copies_outside_the_targets_do_not_take_a_text_away(spark):
    rows = [(1, "one text here", None), (2, "one text here", "small"), (3, "another text here", "untargeted"), (4, "another text here", "Small"), (5, "a third text", "closed"), (6, "a third text", "small"), (7, "no target at all", "untargeted")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("small", 1.0, 1), ("closed", 0.5, 0)], "source string, target_share double, max_repeats int")
    chosen, _ = mixing.mixture(docs, targets, spark.createDataFrame([], "doc_id long, weight double"))
    assert {(r.doc_id, r.source) for r in chosen.collect()} == {(2, "small"), (4, "small"), (6, "small")}


# ---------------------------------------------------------------- prose

PROSE = ["The store trusts the folder before the report is checked, so a partial folder can reach the unpacker.", "as noted last week, this change moves the quota out of the client and keeps the old name for one release", "Der Broker liest das Feld, bevor es geprüft wird, und gibt es an den Wrapper weiter.", "Si falla la petición, se queda en la cola y el sistema lo intenta de nuevo.", "如果请求失败，请求会留在队列里，过一会儿再重试一次。", "Title\n\nThe path is short: the cache takes the record and\nhands it to the shell, which runs it\nwithout a check.\n\n- one\n- two"]
OTHER = ["- a b\n- c d\n- e f\n- g h", "| a | b |\n|---|---|\n| c | d |", "a;b;c;d\n1;2;3;4\n5;6;7;8", "2026-06-15 09:05:12 INFO [x] a=571\n2026-06-15 09:05:13 INFO [y] b=3", "    at a.b(C.java:3)\n    at d.e(F.java:4)", "tbujUvtvTio60eiNALctqWvRZ+2QDxbUOpaSA421sotV7oxwIkiw24HxG3gPh5bAbSq5A8", "invoice - session invoice - session invoice - session invoice - session", "The path is short and it is there.\n" + "\n".join(f"- row {k}" for k in range(20)), "aaaaaaa aaaaaaaa", "a: 1\nb: 2\nc: no", "000000  f0 3b 42\n000010  2e 23 49", "A > B > C > D > E > F", "src/a/b.c\nsrc/d/e.py"]


def test_prose_share():
    assert all(prose.statistics(t)[-1] > 0.5 for t in PROSE) and all(prose.statistics(t)[-1] <= 0.5 for t in OTHER)
    assert len(prose.statistics("")) == len(prose.STATISTICS)


def test_tails_equal_counting(spark):
    rows = [(k, t, "en", "z") for k, t in enumerate(PROSE + OTHER)] + [(0, PROSE[0], "en", "z"), (500, None, "en", None), (501, " ", "en", None), (502, PROSE[0], None, None), (None, PROSE[0], "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, value string")
    stats = prose.measured(docs)
    own = [r for r in stats.collect() if r.language == "en"]
    assert len(own) == len(PROSE) + len(OTHER)
    values = [round(r.symbol_ratio, prose.DECIMALS) for r in own if r.prose_share > prose.REFERENCE_SHARE]
    for t in prose.tails(stats).where("language = 'en' and statistic = 'symbol_ratio'").collect():
        assert abs(t.left - sum(v <= t.value + 1e-9 for v in values) / len(values)) < 1e-9
        assert abs(t.right - sum(v >= t.value - 1e-9 for v in values) / len(values)) < 1e-9
    scored = {r.doc_id: r for r in prose.scored(docs).collect()}
    assert set(scored) == {*range(len(PROSE) + len(OTHER)), 502} and all(scored[k].is_prose == (k < len(PROSE)) for k in range(len(PROSE) + len(OTHER)))
    assert prose.not_prose(docs).count() > 0 and prose.not_prose(docs.limit(0)).count() == 0


def test_common_texts_that_are_no_prose_are_found(spark):
    # a third of the language is one list, between the prose in most statistics, so no tail holds it
    words = "the store trusts folder before report is checked so partial can reach unpacker and this change moves quota out of client".split()
    r = random.Random(11)
    prose_texts = [" ".join(r.choice(words) for _ in range(r.randint(4, 60))).capitalize() + r.choice([".", "", " (1)", " - 27, 5!"]) for _ in range(200)]
    copies = ["- the path and the cache\n- a key of the shell.\n- one of two"] * 100
    rows = [(k, t, "en") for k, t in enumerate(prose_texts + copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {x.doc_id for x in prose.not_prose(docs).collect()} >= set(range(200, 300))
    # how often a text occurs changes no score
    once = {r.doc_id: r.outlier_score for r in prose.scored(docs.where("doc_id < 201")).collect()}
    assert all(r.outlier_score == once[r.doc_id] for r in prose.scored(docs).where("doc_id < 201").collect())


def test_the_score_decides(spark):
    # the same share of prose, once amid texts of that kind and once far from all of them
    sentence = "The {} is read before the {} is checked, so the store keeps it for the next one."
    texts = ["# Note on {}\n\n".format(k) + " ".join(sentence.format(f"part {k}", f"line {j}") for j in range(2 + k % 3)) for k in range(100)]
    odd = "# 88 // 77 :: 66\n\n" + "The unquestionably multidimensional reconfigurations notwithstanding, it is the unconstitutionality (of 9,999,999; 8,888,888; 7,777,777) ..."
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate([*texts, odd])], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in prose.scored(docs).collect()}
    assert all(r.is_prose == (r.doc_id < 100) for r in got.values()) and got[100].prose_share <= prose.SENTENCES
    assert any(r.prose_share <= prose.SENTENCES for r in got.values() if r.is_prose)


def test_running_sums_cross_partitions(spark):
    from codeloom.llm import common

    rows = [(k % 3 if k % 5 else None, k, 1) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, k int, v int")
    got = common.running(df, ["g"], ["k"], "v", "s", partitions=9).collect()
    for g in (None, 0, 1, 2):
        own = sorted((r.k, r.s) for r in got if r.g == g)
        assert [s for _, s in own] == list(range(1, len(own) + 1))
