import random

import pytest

from codeloom.llm import lexmap, syntax

GOOD = {
    ".py": ["", "x = 1\n", "def f(a, *, b=1):\n    '''((('''\n    return [\n        1,\n    ]\n", "try:\n  pass\nexcept* E as e:\n  pass\nelse:\n  pass\n", "@a.b\nasync def f():\n    async with x as y, z:\n        await y\n", "match = 1\nmatch x:\n  case {'a': 1}:\n    pass\n", "if a: b\nelif c: d\nelse: e\n", "f'{a!r:>{w}}' f\"x\"\n"],
    ".js": ["", "const a = 1\nlet {b, c: [d]} = e\n", "function f(a, b = {}) { return a ? b : c }\n", "class A extends B { static #x = 1; get y() { return this.#x } async *z() {} }\n", "x = /[/\\]]\\/(/g.test(s) ? `a${'`'}b` : 1 / 2 / 3;\n", "const f = async (a) => ({...a, [k]: 1});\nfor (const x of y) g(x)\n", "a\n  .b()\n  .c();\nlabel: while (1) { break label }\n", "var set = get.static; async();\n", "switch (a) { case 1: b(); break; default: c() }\n"],
    ".ts": ["export const a: Map<string, number[]> = new Map();\n", "interface A<T extends B> { x?: T; f(a: string): void; [k: string]: any }\n", "export function f(this: A, a?: string, ...b: number[]): a is string { return a as any; }\n", "enum E { A = 1, B }\ntype U = 'a' | { b: string } | ((x: number) => void);\n", "abstract class A<T> implements B { constructor(private readonly x: T) {} protected abstract f(): Promise<void>; }\n", "import type { A } from './a';\nexport * from './b';\n"],
    ".java": ["package a.b;\nimport java.util.*;\npublic class A<T> extends B implements C, D {\n private final int[] x = {1, 2};\n @Override public <R> List<R> f(Map<String, List<R>> m, int... n) throws E { for (var a : m) { g(a -> a.b(), C::new); } return x[0] > 1 ? null : (List<R>) m; }\n static { int y = 1; }\n enum F { A, B; int z; }\n}\n", "record P(int a, String b) { P { if (a < 0) throw new X(); } }\n", "class A { void f() { switch (x) { case 1 -> y(); default -> { } } try (var r = o()) { } catch (A | B e) { } finally { } } }\n"],
    ".go": ["package a\n\nimport (\n\t\"a/b\"\n\tx \"c\"\n)\n\ntype T struct {\n\tA int `json:\"a\"`\n\tB map[string][]*T\n}\n\nfunc (t *T) F(a, b int, c ...string) (int, error) {\n\tif x, err := g(); err != nil {\n\t\treturn 0, err\n\t} else if x > 1 {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor k, v := range m {\n\t\t_ = k\n\t}\n\tgo func() { c <- 1 }()\n\tswitch y := z.(type) {\n\tcase int:\n\tdefault:\n\t}\n\treturn T{A: 1}.A, nil\n}\n"],
    ".php": ["<?php\nnamespace A\\B;\nuse C\\D as E;\nclass X extends Y { private ?int $a = 1; public function f(array $b = [], ?string ...$c): static { foreach ($b as $k => $v) { echo \"$v {$k['x']}\"; } return new static(...$c); } }\n$f = fn($x) => $x ?? 1;\nif ($a): ?><b><?php endif;\n"],
    ".c": ["#include <a.h>\n#ifndef A\n#define A(x) ((x) + \\\n  1)\n#endif\ntypedef struct { int a; char *b[3]; } T;\nstatic const T t = { .a = 1, { \"x\" } };\nint (*f)(int, char **);\nint main(int argc, char *argv[]) { do { argc--; } while (argc > 0); switch (argc) { case 1: return t.a; default: goto end; } end: return (int) sizeof(T); }\n"],
    ".cpp": ["#include <a>\nnamespace a::b {\ntemplate <typename T, int N = 3> class X : public Y<T>, private Z { public: X() : Y<T>(1), a{2} {} virtual ~X() = default; auto f(const std::map<int, T>& m) const -> int { for (const auto& [k, v] : m) { g([&](auto x) { return x + k; }); } return 1; } bool operator==(const X& o) const { return true; } int a; };\n}\n"],
    ".cs": ["using System;\nnamespace A.B\n{\n  [Serializable]\n  public class X<T> : Y, IZ where T : class, new()\n  {\n    public int P { get; set; } = 1;\n    public string Q => $\"a {P}\";\n    private readonly List<int> a = new List<int> { 1, 2 };\n    public async Task<T> F(ref int b, params string[] c) { var x = from i in a where i > 1 select i; if (x is T y) { return y; } foreach (var z in a) { } return await G(() => 1); }\n  }\n}\n"],
    ".json": ["{}", "[1, -2.5e3, \"a\\u00e9\", null, {\"a\": [true, false]}]", " 1 "],
    ".xml": ["<?xml version=\"1.0\"?>\n<!-- c -->\n<a x='1' y=\"&amp;\"><b/><![CDATA[<<]]>&#65;</a>\n"],
}
BAD = {
    ".py": ["def f(:\n", "x = (1\n", "if a:\nb\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "x = 'a\n", "  x = 1\n", "else:\n  pass\n", "try:\n  pass\nx = 1\n", "x = 08\n", "print 1\n", "def f():\n", "a b\n"],
    ".js": ["function f( {\n", "a = b c;\n", "}\n", "x = 'a\n", "if (a { b }\n", "def f(a):\n    return a\n", "<<<<<<< HEAD\na();\n=======\nb();\n>>>>>>> x\n", "function f(a: string): string { return a }\n", "x = [1, 2;\n"],
    ".ts": ["export function f(a: string): string {\n", "const a: = 1;\n", "package a\n\nfunc f() {}\n"],
    ".java": ["class A { void f() { int x = 1 } }\n", "class A {\n", "class A { void f() { g(; } }\n", "def f(a):\n  pass\n", "station;reading day;low\nx;2025-07-18 06:00;2.8\n"],
    ".go": ["package a\nfunc f( {\n}\n", "package a\nfunc f() { return 1\n", "#include <a.h>\nint f() { return 1; }\n"],
    ".php": ["<?php\nfunction f($a { }\n", "<?php\n$a = 1\n$b = 2;\n", "<?php\nif ($a) {\n"],
    ".c": ["int f(const std::string& a) { return 1; }\n", "#ifndef A\nint a;\n", "int f() { return 1; \n", "namespace a { int b; }\n"],
    ".cpp": ["class A { int a }\n;", "int f() {\n", "std::string f( { }\n"],
    ".cs": ["class A { void F() { var x = 1 } }\n", "namespace A {\n", "class A { int F( { } }\n"],
    ".json": ["", "{'a': 1}", "{\"a\": 1,}", "[1 2]", "{\"a\" 1}", "01", "{} {}", "// c\n{}"],
    ".xml": ["<a><b></a></b>", "<a>", "<a/><b/>", "<a x=1/>", "<a>&x y</a>", "text", "<a x='1' x='2'/>"],
}


@pytest.mark.parametrize("ext", GOOD)
def test_programs_parse(ext):
    for code in GOOD[ext]:
        assert lexmap.parses(ext, code), code


@pytest.mark.parametrize("ext", BAD)
def test_broken_ones_do_not(ext):
    for code in BAD[ext]:
        assert not lexmap.parses(ext, code), code


JOINTS = {
    ".js": ["const a = `x ${b ? `\n  y ${c}\n` : d}\n ' z`;\nf(a);\n", "f(\n  /[/(]\\/`/.test(a),\n  b\n);\n/\"(/.exec(c);\n", "a = b\n  + c\n/* ` */\n  .d(`e\n ${f}\n`)\n"],
    ".ts": ["const a: string = `x ${g(`\n  ${h}`)}\n'`;\nf(a);\n"],
    ".c": ['const char *a =\n  "x"\n  "y"\n  "z";\nint b(void) { return c("d"\n  "e"\n  "f"); }\n'],
    ".cpp": ['auto a = f("x"\n  "y"\n  "z", 1);\nint b = 2;\n'],
    ".xml": ["<?xml version='1.0'?>\n<!DOCTYPE a [\n<!ENTITY b 'c'>\n]>\n<!-- <a\n <b> -->\n<a\n x='1'\n y='>'>\n <b><c/>\n</b><![CDATA[ <d\n <e> & ]]>\n<?f <g\n ?>\n</a>\n<!-- h -->\n", "<a>\n<b>\n</b>\n<b/>\n<b>t\n</b></a>"],
    ".cs": ['class A {\n string a = @"x\n ""y\n";\n string b = """\n z "\n """;\n}\n'],
    ".go": ["package a\n\nvar b = `x\n y(`\n\nfunc f() {\n\tg(1,\n\t\t2)\n}\n"],
    ".py": ["a = '''x\n (\n'''\nb = (1 +\n  2)\nc = 1 + \\\n  2\nif a:\n  b = \"\"\"\n'''\n\"\"\"\nelse:\n  pass\n"],
    ".php": ["<p>\n<?php\n$a = 'x\n y';\n$b = \"z\n'w\";\n?>\n<b>'\n<?php f($a);\n"],
    ".java": ['class A {\n /* { */\n String a = """\n x "\n """;\n}\n'],
    ".json": ["{\n\"a\": [\n1,\n{\"b\": null}\n],\n\"c\": -1.5e3\n}\n"],
}


@pytest.mark.parametrize("ext", JOINTS)
def test_joints_anywhere_change_nothing(ext):
    for code in JOINTS[ext]:
        assert lexmap.parses(ext, code, None), code
        for size in range(1, 60):
            assert "".join(lexmap.cut(code, size, ext)) == code
            assert lexmap.parses(ext, code, size), (size, code)
        for at in range(1, len(code), 3):  # damaged files are damaged in pieces as well
            broken = code[:at] + code[at + 1:]
            want = lexmap.parses(ext, broken, None)
            for size in (1, 9, 30):
                assert lexmap.parses(ext, broken, size) == want, (size, broken)


@pytest.mark.parametrize("ext", GOOD)
def test_chunks_change_nothing(ext):
    r = random.Random(1)
    bodies = [c.rstrip("\n") + "\n" for c in GOOD[ext] if c.strip()]
    for bad in (False, True):
        for _ in range(6):
            text = "".join(r.choice(bodies) for _ in range(6)) if ext in (".py", ".js", ".ts", ".c", ".cpp", ".java") else bodies[0]
            if bad:
                at = r.randrange(1, len(text))
                text = text[:at]
            want = lexmap.parses(ext, text)
            for size in (20, 60, 300):
                assert lexmap.parses(ext, text, size) == want, (size, text)


def test_combination_is_associative():
    text = "/* a\n" * 2 + "b */\nfunction f(a) {\n  return `x\n${a}`;\n}\n" * 3 + "g({\n  a: [1,\n 2]});\n"
    parts = lexmap.cut(text, 12)
    maps = [lexmap.summary(".js", p) for p in parts]
    left = maps[0]
    for m in maps[1:]:
        left = lexmap.combine(".js", left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = lexmap.combine(".js", m, right)
    for s in lexmap.STATES[".js"]:
        assert left[s][0] == right[s][0]
        assert lexmap.whole(".js", left[s]) == lexmap.whole(".js", right[s])


FILES = "file_id long, repo string, path string, name string, source_code string, extension string, start_line int, ext string, k int, part string"


def row(i, code, ext=".py", path="/a.py", repo="r"):
    return (i, repo, path, None, code, ext, None, "clash", 1, "clash")


def test_table(spark):
    long_good = "x = [\n" + "    1,\n" * 3000 + "]\n"
    long_js = "function f(a) {\n" + "  g(a, 1);\n" * 2000 + "}\n"
    rows = [row(1, "x = ("), row(1, "x = ("), row(2, None), row(3, "  \n"), row(4, "x ="), row(5, "x = 1", ".rb"), row(6, "{", None, "/a/b.JSON"), row(7, "[1]", " JSON "), row(8, long_good), row(9, long_good[:-2]), row(10, long_js, ".js"), row(11, long_js[:-2], ".js"), row(None, "x ="), row(12, "x = (", "", "/a.py")]
    df = spark.createDataFrame(rows, FILES)
    assert sorted(r.file_id for r in syntax.unparsable(df).collect()) == [1, 4, 6, 9, 11]
    assert sorted(r.file_id for r in syntax.unparsable(df, chunk=3).collect()) == [1, 4, 6, 9, 11]
    assert syntax.unparsable(df.limit(0)).count() == 0
    rates = {(r.repo, r.language): (r.files, r.broken_files) for r in syntax.rates(df).collect()}
    assert rates[("r", "javascript")] == (2, 1) and rates[("r", "json")] == (2, 1)


LABELLED = {
    ".php": ["<p>it's <<<X\n</p>\n<?php\n$a = 1; // <<<EOT\n$q = <<<SQL\nselect 'a\n from b \"\nwhere (c\nSQL;\n$b = 2;\n", "<?php\nf(<<<'A'\n{ don't\n\nA, <<<\"B\"\n } x\n y\n  B);\n$b = 2;\n"],
    ".cpp": ['int a = 1;\nconst char* q = R"sql(select \'a\nfrom "b\n)" { where\n)sql";\nint f() { return 2; }\n', '// R"(\nauto s = R"(\n  it\'s {\n\n)" R"x(\n (\n)x";\nint b = 2;\n'],
}
LABELLED[".h"] = LABELLED[".cpp"]


@pytest.mark.parametrize("ext", LABELLED)
def test_literals_with_a_label_are_never_cut(ext, spark):
    for code in LABELLED[ext]:
        assert lexmap.parses(ext, code), code
        broken = code + ("function (\n" if ext == ".php" else "int f( {\n")
        for size in (5, 12, 20, 40):
            assert "".join(lexmap.cut(code, size, ext)) == code and len(lexmap.cut(code, size, ext)) > 1
            assert lexmap.parses(ext, code, size) and not lexmap.parses(ext, broken, size), (size, code)
    df = spark.createDataFrame([(k, f"/a{ext}", ext, c) for k, c in enumerate(LABELLED[ext])], "file_id long, path string, extension string, source_code string")
    assert syntax.unparsable(df, chunk=12).count() == 0
