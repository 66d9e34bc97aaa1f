import io
import zipfile

from pyspark.sql import functions as F

from codeloom.config import NO_DEPENDENCY, Settings, load
from codeloom.functions import text
from codeloom.operators import chunks, payloads, reports, reviewer, units
from codeloom.sources import files as sources
from codeloom.streaming import ingest

FILES = "file_id long, path string, name string, source_code string, extension string, start_line int"


def one(df):
    return df.collect()[0][0]


def test_lines_and_slices(spark):
    df = spark.createDataFrame([(0, "a\r\nb\n"), (1, ""), (2, None), (3, "x\u2028y"), (4, "\n\n")], "k int, t string")
    got = {r.k: r.l for r in df.select("k", text.lines(F.col("t")).alias("l")).collect()}
    assert got == {0: ["a", "b"], 1: [], 2: None, 3: ["x", "y"], 4: ["", ""]}
    s = lambda a, b, base: text.line_slice(F.lit("a\nb\nc"), F.lit(a), F.lit(b), F.lit(base))
    row = spark.range(1).select(s(2, 3, 1).alias("a"), s(6, 7, 5).alias("b"), s(0, 1, 1).alias("c"), s(3, 2, 1).alias("d"), s(1, 9, 1).alias("e")).first()
    assert tuple(row) == ("b\nc", "b\nc", "", "", "")
    listing = chunks.listings(spark.createDataFrame([(1, "/a.py", "a", "x\n" * 11, ".py", 9)], FILES)).first().listing.split("\n")
    assert listing[0] == " 9: x" and listing[-1] == "19: x"


def test_packing_covers_every_line_within_budget():
    code = "".join(f"def f{k}():\n    return {k} + {'1 + ' * (k % 7)}2\n\n" for k in range(60))
    for budget in (5, 20, 100, 10_000):
        parts = chunks.pack(code, ".py", budget)
        assert [n for a, b in parts for n in range(a, b + 1)] == list(range(1, len(code.splitlines()) + 1))
        for a, b in parts:
            assert a == b or chunks.estimate("\n".join(code.splitlines()[a - 1:b])) <= budget + (b - a) // 4 + 1
    assert len(chunks.pack(code, ".py", 100, isolate=True)) == 60
    assert chunks.pack("", ".py", 10) == []


def test_extraction_of_python():
    code = "import os\n\ndef data(a):\n    logger.info(a)\n    return check(a)\n\nclass V:\n    def run(self):\n        pandas.read_csv(1)\n    def idle(self):\n        pass\n"
    got = {(s, t): (a, b) for s, t, _, a, b in units.extract(code, ".py", "m.py")}
    assert got[("data", "logger.info")] == (3, 5) and got[("data", "check")] == (3, 5) and got[("V.run", "pandas.read_csv")] == (8, 9)
    assert ("V.idle", NO_DEPENDENCY) in got and ("m", "import:os") in got
    assert units.extract("def f(:\n", ".py", "m.py") is None


def test_extraction_of_brace_languages():
    go = 'package a\n\nfunc Run(x string) string {\n    s := "{ not( a call"\n    return pool.Get(x)\n}\n'
    assert [(s, t) for s, t, *_ in units.extract(go, ".go", "a.go")] == [("Run", "pool.Get")]
    java = "class A {\n  public String get(String a) {\n    if (a == null) { store.load(a); }\n    return a;\n  }\n}\n"
    assert [(s, t) for s, t, *_ in units.extract(java, ".java", "A.java")] == [("A.get", "store.load")]
    ts = "export function cut(a: string): string {\n  return split.at(a);\n}\n"
    assert [(s, t) for s, t, *_ in units.extract(ts, ".ts", "a.ts")] == [("cut", "split.at")]


def test_brace_languages_have_a_module_scope():
    own = lambda code, ext: [t for s, t, *_ in units.extract(code, ext, "m" + ext) if s == "m"]
    assert own('package a\n\nimport (\n\t"fmt"\n\tx "net/http"\n)\n// import "no"\nvar p = pool.New(3)\n\nfunc Run() { f() }\n', ".go") == ["import:fmt", "import:net/http", "pool.New"]
    assert own("import { a,\n  b } from 'x/y';\nimport './z';\nboot(1);\nfunction f() { g(); }\nclass A {\n  run() { h(); }\n}\n", ".ts") == ["import:x/y", "import:./z", "boot"]
    assert own("import a.b.C;\nimport static d.E.*;\nclass X {\n  static P p = P.of(1);\n  @Path(1) void run() { f(); }\n  abstract int g(int a);\n}\n", ".java") == ["import:a.b.C", "import:d.E.*", "P.of"]
    assert own("#include <a.h>\n#include \"b/c.h\"\n#define F(x) g(x)\nint f(int a);\nint h(void) { return f(1); }\n", ".c") == ["import:a.h", "import:b/c.h"]
    assert own("using A.B;\nclass C { void F() { g(); } }\n", ".cs") == ["import:A.B"]
    assert own("<?php\nuse A\\B;\nrequire_once('c.php');\nboot();\nfunction f() { g(); }\n", ".php") == ["import:A\\B", "import:c.php", "boot"]


def test_extraction_table(spark):
    rows = [(1, "/a.py", None, "def f():\n    g()\n", ".py", 5), (2, "/b.py", "b.py", "def f(:\n", ".py", 1), (3, "/c.rb", "c.rb", "x", ".rb", 1), (4, "/d.py", "d", None, ".py", 1)]
    df = spark.createDataFrame(rows, FILES)
    got = {(r.file_id, r.status): r for r in units.extracted(df).collect()}
    assert set(got) == {(1, "ok"), (2, "failed")} and (got[(1, "ok")].start_code_line, got[(1, "ok")].end_code_line) == (5, 6)
    good, rest = units.dispatched(df)
    assert good.count() == 1 and {r.file_id for r in rest.collect()} == {2, 3, 4}
    assert units.dispatched(df, "ast")[1].count() == 0


def test_validation(spark):
    q = lambda c, f=units.is_natural_language: one(spark.range(1).select(f(F.lit(c))))
    assert q("data_processor") and not q("pool.get_all_of_it") and q("") and q("a b c d e") and not q("short_name")
    assert not one(spark.range(1).select(units.is_natural_language(F.lit("data_processor"), False)))
    s = lambda t, c: one(spark.range(1).select(units.is_supported(F.lit(t), F.lit(c))))
    assert s("a.b.load", "x.load()") and not s("a.b.load", "x.store()") and s("import:os.path", "from os import path") and s(NO_DEPENDENCY, "")


def test_extractor_lines(spark):
    out = "```text\n<输出单元>\nf<SEP>g<SEP>reads<SEP>3-9\nbad<SEP>x\n<输出单元>\n```"
    rows = units.parse_lines(spark.createDataFrame([(1, out), (2, "未发现数据"), (3, None), (4, "a<SEP>b<SEP>c<SEP>x")], "k int, output string")).collect()
    assert [(r.k, r.caller, r.first_line, r.last_line, r.parse_error) for r in rows] == [(1, "f", 3, 9, False), (1, "bad", None, None, True), (4, "a", None, None, True)]


def test_imports(spark):
    cases = [(".py", "from a.b import c as d, e", ["import:a.b.c", "import:a.b.e"]), (".py", "import x, y as z", ["import:x", "import:y"]), (".js", "const a = require('./b')", ["import:./b"]), (".ts", "import { a } from './c'", ["import:./c"]), (".java", "import static a.B.*;", ["import:a.B.*"]), (".c", "#include <stdio.h>", ["import:stdio.h"]), (".cs", "using A.B;", ["import:A.B"]), (".php", "require_once 'x.php';", ["import:x.php"])]
    for ext, line, want in cases:
        assert one(spark.range(1).select(units.import_targets(F.lit(ext), F.lit(line)))) == want


def test_imports_over_lines(spark):
    rows = [(1, "/a.py", "a", "from x.y import (  # z\n    b as c,\n    d,\n)\nimport e\n", ".py", 1), (2, "/b.ts", "b", "import {\n  a,\n  b,\n} from './c';\nimport './d';\n", ".ts", 1)]
    got = {(r.file_id, r.target) for r in units.imports(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {(1, "import:x.y.b"), (1, "import:x.y.d"), (1, "import:e"), (2, "import:./c"), (2, "import:./d")}


REPORT = "<审计报告>\n<文件>\n路径: /a\n结论: 发现漏洞\n<漏洞>\n类型: t\n判定: v\n等级: 高危\n位置:\n<代码特征>\n x \n</代码特征>\n</漏洞>\n</文件>\n</审计报告>"


def test_reports(spark):
    df = spark.createDataFrame([(1, REPORT + "\n" + reports.SEPARATOR + "\n\n" + REPORT), (2, "")], "k int, report string")
    sections = reports.split_sections(df)
    assert [(r.k, r.section_no) for r in sections.collect()] == [(1, 1), (1, 2)]
    f = reports.structured(sections).first()
    assert (f.file_path, f.type, f.feature) == ("/a", "t（v / 高危）", "x")
    assert f.location == "<代码特征>"  # an empty value takes the next line
    assert one(spark.range(1).select(reports.severity(F.lit("highlight")))) == "high"
    t = lambda *a: one(spark.range(1).select(reports.title(*map(F.lit, a))))
    assert (t("", "", ""), t("a", "", ""), t("a", "", "c")) == (reports.UNNAMED, "a", "a（c）")
    p = lambda c: one(spark.range(1).select(reports.passes_only(F.lit(c))))
    assert p("") and p("<审计通过>") and p("<结论>审核通过</结论>") and not p(REPORT) and not p("other")
    s = lambda ok, total: one(reports.run_summary(spark.createDataFrame([(k >= total - ok,) for k in range(total)], "ok boolean"), 0.3).select("incomplete"))
    assert s(7, 10) and not s(8, 10) and not s(10, 10)


def test_legacy_report(spark):
    section = "// /x\n■ 漏洞类型：t\n▶ 位置：L1\n▶ 代码特征：a\n  b\n▶ 潜在影响：c\nd\n<tag>\n■ 漏洞类型：u\n▶ 修复建议：e"
    rows = reports.legacy(spark.createDataFrame([(1, section)], "k int, section string"), "k").orderBy("finding_no").collect()
    assert [(r.file_path, r.type, r.location, r.feature, r.impact, r.fix) for r in rows] == [("/x", "t", "L1", "a\nb", "c d", ""), ("/x", "u", "", "", "", "e")]


def test_dedup_and_floor(spark):
    df = spark.createDataFrame([(k, "s", k % 2, float(k)) for k in range(6)], "ord long, path string, sig int, score double")
    assert payloads.first_per_signature(df, ["sig"], ["ord"], 0).count() == 2 and payloads.first_per_signature(df, ["sig"], ["ord"], -1).count() == 6
    both = spark.createDataFrame([(1, "p", "a", "x"), (2, "p", "b", "x"), (3, "p", "b", "y"), (4, "p", "b", "z")], "ord long, path string, payload_sig string, context_sig string")
    assert sorted(r.ord for r in payloads.both_signatures(both, 1).collect()) == [1, 3]
    c = spark.createDataFrame([(f"n{k:02}", k, k >= 28) for k in range(30)], "id string, score int, is_candidate boolean")
    floor = payloads.with_floor(c)
    assert floor.count() == 10 and floor.where("relaxed").count() == 8


def test_reviewer(spark):
    df = spark.createDataFrame([(k, "p" * k) for k in range(40)], "k long, payload string")
    rows = reviewer.reviewed(df, "k", limit_tokens=9).collect()
    assert len(rows) == 40 and sum(not r.ok for r in rows) == 3
    failing = lambda p: 1 / 0
    assert all(not r.ok and r.error for r in reviewer.reviewed(df, "k", call=failing, attempts=2).collect())


def test_sources(spark, tmp_path):
    (tmp_path / "p" / "src").mkdir(parents=True)
    (tmp_path / "p" / "node_modules").mkdir()
    (tmp_path / "p" / "src" / "a.py").write_bytes("é = 1\r\n".encode())
    (tmp_path / "p" / "src" / "b.py").write_bytes("é = 1\n".encode("latin-1"))
    (tmp_path / "p" / "src" / "c.bin").write_bytes(b"x")
    (tmp_path / "p" / "node_modules" / "d.py").write_bytes(b"x")
    (tmp_path / "p" / "src" / "big.py").write_bytes(b"x" * 200)
    s = Settings(max_file_mb=100 / 1048576, excluded_parts=("node_modules",))
    got = {r.name: r.source_code for r in sources.scan(spark, str(tmp_path / "p"), s).collect()}
    assert set(got) == {"a.py", "b.py"} and got["a.py"] == "é = 1\n"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("top/x.py", "1")
        z.writestr("top/../../evil.py", "2")
    rows = sources.from_zips(spark.createDataFrame([("a.zip", bytearray(buffer.getvalue())), ("broken.zip", bytearray(b"no"))], "path string, content binary")).collect()
    assert [(r.path, bytes(r.content)) for r in rows] == [("x.py", b"1")]
    assert "└─ b" in sources.tree_text(["/a/b"])
    assert load(str(tmp_path / "c.yaml")) == Settings() == load(str(tmp_path / "c.yaml"))


def test_graphml_and_memo(spark, tmp_path):
    from codeloom.operators import graph

    u = spark.createDataFrame([(1, "/p/a.py", "a", 'x = "<&>"\ny', 1, 2, "f", "g", None)], "unit_id long, path string, name string, source_code string, start_code_line int, end_code_line int, source_name string, target_name string, source_desc string")
    sources.write_graphml(graph.nodes(u), graph.edges(u), str(tmp_path / "g"))
    nodes, edges = sources.read_graphml(spark, str(tmp_path / "g"))
    assert {r.id: (r.source_code, r.start_line) for r in nodes.collect()} == {"/p/a.py|f": ('x = "<&>"\ny', 1), "/p/a.py|g": ("", 0)} and edges.count() == 1
    whole = spark.read.text(str(tmp_path / "g"), wholetext=True).first().value
    import xml.etree.ElementTree as ET

    assert ET.fromstring(whole.encode()).tag.endswith("graphml")
    # the usual writer's layout: indented, attributes by key, in another order
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.graphml").write_text("""<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns http://graphml.graphdrawing.org/xmlns/1.0/graphml.xsd">
  <key id="d1" for="node" attr.name="path" attr.type="string" />
  <key id="d0" for="node" attr.name="source_code" attr.type="string" />
  <key id="d2" for="node" attr.name="start_code_line" attr.type="long" />
  <graph edgedefault="directed">
    <node id="/p/a.py|f">
      <data key="d1">/p/a.py</data>
      <data key="d0">def f():
    g(1) &lt; 2
</data>
      <data key="d2">7</data>
    </node>
    <node id="/p/a.py|g" />
    <edge source="/p/a.py|f" target="/p/a.py|g" />
  </graph>
</graphml>
""")
    nodes, edges = sources.read_graphml(spark, str(tmp_path / "h"))
    assert {r.id: (r.path, r.source_code, r.start_line) for r in nodes.collect()} == {"/p/a.py|f": ("/p/a.py", "def f():\n    g(1) < 2\n", 7), "/p/a.py|g": ("", "", 0)}
    assert [(r.src, r.dst) for r in edges.collect()] == [("/p/a.py|f", "/p/a.py|g")]
    calls = []
    build = lambda: (calls.append(1), (graph.nodes(u), graph.edges(u)))[1]
    folder = sources.memo_path(str(tmp_path), "abc", Settings())
    assert [sources.graph_memo(spark, folder, build)[1].count() for _ in range(2)] == [1, 1] and len(calls) == 1
    sources.write_report(spark.createDataFrame([("r",)], "report string"), str(tmp_path / "r"))
    assert reports.SEPARATOR in spark.read.text(str(tmp_path / "r"), wholetext=True).first().value
    found = sources.discovered(spark.createDataFrame([("/d/x.graphml", 1), ("/d/x_report.log", 2), ("/e/y.log", 3)], "path string, modificationTime int"))
    assert [(r.dir, r.report_path) for r in found.collect()] == [("/d", "/d/x_report.log")]


def test_damaged_files_of_brace_languages_fall_back_to_sections(spark):
    assert units.extract("func f() {\n", ".go", "a.go") is None and units.extract("class A { void f() { g(; } }\n", ".java", "A.java") is None
    code = "func f() {\n    g(1)\n}\n\nfunc h() {\n    k(2\n}\n"
    got = units.extracted(spark.createDataFrame([(1, "/a.go", "a.go", code, ".go", 1), (2, "/b.go", "b.go", "func f( {\n", ".go", 1)], FILES)).collect()
    assert {(r.file_id, r.source_name, r.target_name, r.status) for r in got} == {(1, "f", "g", "fallback"), (2, None, None, "failed")}
    review = lambda left: left.select("file_id", F.lit("a<SEP>b<SEP>c<SEP>1-2\nbroken").alias("output"))
    both = units.all_units(spark.createDataFrame([(1, "/a.go", "a.go", code, ".go", 1), (2, "/b.go", "b.go", "func f( {\n", ".go", 1)], FILES), review)
    assert {(r.file_id, r.source_name, r.origin) for r in both.collect()} == {(1, "f", "ast"), (2, "a", "llm")}


def test_texts_reports_and_chunks_of_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("é\nx\n")
    assert [r.text for r in sources.read_text(spark, str(tmp_path / "t")).collect()] == ["é\nx\n"]
    for n, r in enumerate(("one", "two", "two")):
        sources.rewrite_report(spark.createDataFrame([(r,)], "report string"), min(n, 1), str(tmp_path / "r"))
    assert "".join(r.value for r in spark.read.text(str(tmp_path / "r" / "report"), wholetext=True).collect()).count(reports.SEPARATOR) == 2
    df = spark.createDataFrame([(1, "/a.py", "a", "x = 1\n" * 50, ".py", 3), (2, "/a.ini", "b", "x = 1\n" * 50, ".ini", 1)], FILES)
    parts = sources.flattened(df, 10).collect()
    assert [r.start_line for r in parts if r.file_id == 1] == [3] and len([r for r in parts if r.file_id == 2]) > 3
    assert {r.file_id for r in sources.flattened(df, 10, "llm").groupBy("file_id").count().where("count > 1").collect()} == {1, 2}
    assert units.fallback_tokens(None) == 12_000 and units.fallback_tokens(100) == 2_000 and units.fallback_tokens(8000) == 4_000


def test_findings_are_ordered_inside_a_section(spark):
    rows = spark.createDataFrame([(1, 1, "x（低危）"), (1, 2, "y（高危）"), (1, 3, "z（低危）"), (2, 4, "w（中危）")], "section int, ord int, type string")
    got = reports.finding_order(reports.reviewed(rows, ["high", "medium", "low"]), "section", "ord").collect()
    assert {r.ord: r.place for r in got} == {2: 1, 1: 2, 3: 3, 4: 1}


def test_stream_of_units(spark, tmp_path):
    schema = "unit_id long, path string, name string, source_code string, start_code_line int, end_code_line int, source_name string, target_name string, source_desc string"
    df = spark.createDataFrame([(1, "/p/a.py", "a", "x", 1, 2, "f", "g", None), (2, "/p/a.py", "a", "x", 1, 2, "f", "h", None)], schema)
    df.write.parquet(str(tmp_path / "in"))
    q = ingest.maintain_edges(ingest.unit_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
