import pytest

from codeloom.llm import provenance as P

A = P.automaton()
YES = ["// Code generated by x v1.2. DO NOT EDIT.", "# @generated by foo", "/*\n * This file was automatically generated from a.schema; changes will be lost.\n */", "// <auto-generated> produced by x </auto-generated>", "# Diese Datei wurde von x erzeugt. Nicht von Hand bearbeiten.", "// 本文件由 x 自动生成，请勿手动修改", "// Archivo generado por x. No editar.", "// Fichier produit automatiquement par x, ne pas modifier.", "# Machine-written by x; edit the row template instead.", "// Output of x. Any manual edit is overwritten on the next build.",
       "# Third-party code: x 2.16, imported unmodified", "# Copied verbatim from x 6.0; update with tools/sync", "# Upstream: x (tag 1.7). Report problems there.", "/*\n * (c) 2009 the x makers\n * See LICENCE.x for terms of use\n */", "# Vendored from the x project, release 1.2.", "# Übernommen aus x 1.10, nicht hier ändern", "// 此文件来自第三方库"]
NO = ["// The badge is generated automatically by the scheduler at night.", "// Do not edit policy rows by hand; call the importer.", "// This module generates the nightly report.", "# Third-party shelf data is checked here before use.", "// Adapter around the vendor SDK; our own code.", "// Compact form: minified output goes to the cache.", "# Copyright (c) 2023 r authors\n# Internal use only; see NOTICE in the root folder.", "/*\n * Copyright (c) 2025 the authors\n * All uses need consent of the authors.\n */"]


@pytest.mark.parametrize("text", YES)
def test_notices(text):
    assert P.notice(text + "\nx = 1\n", "r", A)
    assert not P.notice("x = 1\n" * 10 + text, "r", A)  # a notice stands in the header


@pytest.mark.parametrize("text", NO)
def test_no_notices(text):
    assert not P.notice(text + "\nx = 1\n", "r", A)


def test_paths():
    yes = ["/a/node_modules/x/b.js", "/a/third_party/b.c", "/a/gen/b.py", "/a/b_pb2.py", "/a/b.min.js", "/a/package-lock.json", "/a/x-1.2.3/b.c", "/a/dist/b.js", "/a/AbcGrpc.java", "/a/zz_generated_b.go", "/a/b.g.cs"]
    no = ["/a/generator/b.py", "/a/minifier/b.js", "/a/vendors/b.py", "/a/depsgraph/b.js", "/a/distribution/b.py", "/a/external_orders/b.py", "/a/admin.js", "/a/regen.py"]
    assert all(P.by_path(p, None) for p in yes) and not any(P.by_path(p, None) for p in no) and P.by_path(None, None) == ""


def test_shapes():
    assert P.shape("static const unsigned char a[] = {\n" + "    0x1a, 0x00, 0xbf, 0xa3, 0x20, 0xd8,\n" * 40 + "};\n", ".c") == "bulk data"
    assert P.shape("X = [\n" + "    -2.94, 0.12, 3.50,\n" * 60 + "]\n", ".py") == "bulk data"
    assert P.shape("var a=b=>b.map(c).filter(d);if(void 0===e){e={}}else{e.f=[1,2]}" * 30, ".js") == "minified"
    assert P.shape("".join(f"def get_row_{k}(m):\n    return m.v_{k}\n" for k in range(9)), ".py") == "machine form"
    assert P.shape("".join(f"def work(a):\n    text_{k} = 'x'\n    row_{k + 1} = pool.get(a, {k})\n    return a\n\n" for k in range(9)), ".py") == ""
    assert P.shape('help = "' + "word and more, " * 60 + '"\n', ".js") == ""
    padded = "def f(a):\n    return a\n\n" + ("# " + "x" * 70 + "\n# " + "-" * 68 + "\n") * 30 + "y = f(1)\n"
    assert P.shape(padded, ".py") == ""
    assert P.shape('blob = "' + "aGVsbG8gd29ybGQ0ZW5jb2RlZA9XyZ7+/Q" * 60 + '"\n', ".py") == "bulk data"
    assert P.shape("station;day;low;high\n" + "abc;2025-10-20 02:00;-7.9;29.6\n" * 9, ".py") == P.shape("00000000: 19 da 2b 77 98 f5 5a 10 |\r\n" * 12, ".js") == "bulk data"
    assert P.shape("".join(f"set {k}, {k + 1}, f({k})\nput 12345, 67890, g({k})\n" for k in range(9)), ".py") == ""
    assert P.shape("", ".py") == P.shape("{}", ".json") == ""
    assert P.shape('{\n' + ",\n".join(f'  "a_{k}": "stale-row"' for k in range(40)) + "\n}", ".json") == ""


FILES = "file_id long, repo string, path string, name string, source_code string, extension string, kind string"


def test_table(spark):
    lib = "".join(f"def part_{c}(a, b):\n    x = a.{c}one(b)\n    for i in x:\n        yield i.{c}two\n\n" for c in "abcdefgh")
    changed = lib.replace("yield i.atwo", "yield 3").replace("x = a.bone(b)", "x = a")
    rows = [(1, "r", "/a/b.py", None, changed, ".py", "z"), (1, "r", "/a/b.py", None, changed, ".py", "z"), (2, "r", "/a/c.py", None, "def own(a):\n    return a\n", ".py", "z"), (3, None, None, None, None, None, None), (4, "r", "/a/vendor/d.py", "d.py", None, ".py", None), (None, "r", "/a/vendor/d.py", "d.py", "x", ".py", None)]
    df = spark.createDataFrame(rows, FILES)
    libs = spark.createDataFrame([(1, lib), (2, None), (None, "x")], "lib_id int, source_code string")
    assert {(r.file_id, r.kind) for r in P.not_first_party(df, libs).collect()} == {(1, "library"), (4, "vendored")}
    assert {r.file_id for r in P.not_first_party(df, libs.limit(0)).collect()} == {4}
    assert P.not_first_party(df.limit(0), libs).count() == 0


def test_related_libraries_and_many_copies(spark):
    lib = ["".join(f"def part_{c}(a, b):\n    x = a.{c}one(b)\n    for i in x:\n        yield i.{c}two\n\n" for c in letters) for letters in ("abcdefgh", "abcdefgi", "klmnopqr")]
    # an exact copy of each library, two of them alike, and a third of all rows copies of one
    rows = [(k, "r", f"/a/b{k}.py", None, lib[k], ".py") for k in range(3)] + [(10 + k, "r", f"/a/c{k}.py", None, lib[1], ".py") for k in range(40)] + [(100 + k, "r", f"/a/d{k}.py", None, f"def own_{k}(a):\n    return a\n", ".py") for k in range(80)]
    df = spark.createDataFrame(rows, "file_id long, repo string, path string, name string, source_code string, extension string")
    libs = spark.createDataFrame(list(enumerate(lib)), "lib_id int, source_code string")
    want = {(k, "library") for k in (0, 1, 2, *range(10, 50))}
    assert {(r.file_id, r.kind) for r in P.not_first_party(df, libs).collect()} == want
    more = libs.unionByName(spark.createDataFrame([(10 + k, "".join(f"int f{k}_{j}(int a) {{ return b{j} + c{k}; }}\n" for j in range(9))) for k in range(300)], "lib_id int, source_code string"))
    assert {(r.file_id, r.kind) for r in P.not_first_party(df, more).collect()} == want
