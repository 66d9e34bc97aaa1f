"""Code units: extraction from code, import targets, parsing of extractor output, validation.

Extraction reads Python with the standard parser and the other eight languages with a scanner of calls inside balanced bodies; a unit is one
caller and one target.  A caller without targets gets the sentinel target.  Files of other extensions, null and blank code give
no unit.  With engine 'auto' files that give none may go to a reviewer; 'ast' keeps them out.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..config import NO_DEPENDENCY, PARSED_EXTENSIONS
from ..functions import text

SEP = "<SEP>"


# ---------------------------------------------------------------- imports

# The patterns below say what counts as an import in each language.
def import_targets(ext: Column, raw: Column) -> Column:
    """'import:x' of every import in a line of code, by language; null for other languages."""
    flat = F.btrim(F.regexp_replace(raw, r"\s+", " "))
    name = lambda c: F.concat(F.lit("import:"), c)
    every = lambda p, g=1: F.transform(F.regexp_extract_all(flat, F.lit(p), F.lit(g)), name)
    alias = lambda c: F.btrim(F.split_part(F.btrim(c), F.lit(" as "), F.lit(1)))
    plain = F.transform(F.filter(F.transform(F.split(F.substring(flat, 8, 1 << 20), ","), alias), lambda c: c != ""), name)
    module = F.btrim(F.regexp_extract(flat, r"^from (.*?) import ", 1))
    listed = F.btrim(F.btrim(F.regexp_extract(flat, r"^from .*? import (.*)$", 1)), F.lit("()"))
    members = F.transform(F.filter(F.transform(F.split(listed, ","), alias), lambda c: c != ""), lambda c: name(F.concat(module, F.lit("."), c)))
    none = F.array().cast("array<string>")
    python = F.when(flat.startswith("import "), plain).when(flat.rlike("^from .* import "), members).otherwise(none)
    script = F.array_distinct(F.concat(every(r"import\s+(?:.+?\s+from\s+)?[\"']([^\"']+)[\"']"), every(r"require\s*\(\s*[\"']([^\"']+)[\"']\s*\)")))
    go = F.when(flat.startswith("package "), F.array(name(F.btrim(F.substring(flat, 9, 1 << 20))))).otherwise(every(r"\"([^\"]+)\""))
    php = F.array_distinct(F.concat(every(r"(?:include|include_once|require|require_once)\s*\(?\s*['\"]([^'\"]+)['\"]"), every(r"use\s+([a-zA-Z0-9_\\]+)")))
    return (F.when(ext == ".py", python).when(ext.isin(".js", ".ts"), script).when(ext == ".java", every(r"import\s+(?:static\s+)?([a-zA-Z0-9_.*]+)\s*;"))
            .when(ext == ".go", go).when(ext == ".php", php).when(ext.isin(".c", ".cpp"), every(r"#include\s*[<\"]([^>\"]+)[>\"]")).when(ext == ".cs", every(r"using\s+([a-zA-Z0-9_.]+)\s*;")))


# How an import statement begins, by language.
IMPORT_LINES = {
    ".py": r"^(?:import|from)\s", ".js": r"^import\s|require\s*\(", ".ts": r"^import\s|require\s*\(", ".java": r"^import\s", ".go": r"^(?:package\s|import\s|\"[^\"]+\"$)",
    ".php": r"^(?:include|require|use\s)", ".c": r"^#include", ".cpp": r"^#include", ".cs": r"^using\s",
}


#: Import statements that may run over lines.
LONG_IMPORTS = {".py": r"(?m)^[ \t]*from\s+[\w.]+\s+import\s*\([^)]*\)", ".js": r"(?m)^[ \t]*import\s+[^'\";()]*?\s+from\s+['\"][^'\"]+['\"]"}

#: The first line of such a statement, which alone says nothing.
OPEN_IMPORT = r"^from\s[^(]*\([^)]*$"


def imports(files: DataFrame) -> DataFrame:
    """(file_id, target): every import of every file."""
    ext = text.suffix(F.col("path"))
    is_import = F.lit(False)
    for e, p in IMPORT_LINES.items():
        is_import = F.when(F.col("ext") == e, F.col("line").rlike(p)).otherwise(is_import)
    rows = files.select("file_id", ext.alias("ext"), "source_code").where(F.col("ext").isin(*PARSED_EXTENSIONS) & F.col("source_code").isNotNull())
    rows = rows.select("file_id", "ext", text.lines(F.col("source_code")).alias("ls"))
    whole = F.array_join("ls", "\n")
    over_lines = F.when(F.col("ext") == ".py", F.regexp_extract_all(whole, F.lit(LONG_IMPORTS[".py"]), F.lit(0))).when(F.col("ext").isin(".js", ".ts"), F.regexp_extract_all(whole, F.lit(LONG_IMPORTS[".js"]), F.lit(0))).otherwise(F.array().cast("array<string>"))
    over_lines = F.transform(F.filter(over_lines, lambda c: c.contains("\n")), lambda c: F.regexp_replace(c, "#[^\n]*", ""))
    rows = rows.select("file_id", "ext", F.explode(F.filter(F.transform(F.concat("ls", over_lines), lambda c: F.btrim(c)), lambda c: c != "")).alias("line")).where(is_import & ~((F.col("ext") == ".py") & F.col("line").rlike(OPEN_IMPORT)))
    return rows.select("file_id", F.explode(import_targets(F.col("ext"), F.col("line"))).alias("target")).distinct()


# ---------------------------------------------------------------- extractor output

def parse_lines(df: DataFrame, column: str = "output") -> DataFrame:
    """df with one row per line of extractor output: caller, callee, summary, start_line, end_line, parse_error.

    Fences are dropped; a tagged block is read, else the lines with exactly three separators; the mark for 'nothing found'
    anywhere gives no row.  A line that does not parse is kept with parse_error true, where the reference gives up the file.
    """
    clean = F.btrim(F.regexp_replace(F.btrim(F.col(column)), r"```(?:text|plaintext)?", ""))
    block = F.regexp_extract(clean, r"(?s)<输出单元>\s*(.*?)\s*<输出单元>", 1)
    ls = F.when(block != "", F.filter(F.split(block, "\n"), lambda c: c.contains(SEP))).otherwise(F.filter(F.split(clean, "\n"), lambda c: F.size(F.split(F.btrim(c), SEP)) == 4))
    rows = df.where(~F.coalesce(F.col(column).contains("未发现数据"), F.lit(True))).withColumn("_line", F.explode(ls))
    parts = F.split(F.btrim(F.col("_line")), SEP)
    span = F.regexp_extract(F.btrim(F.get(parts, F.lit(3))), r"^(\d+)-(\d+)$", 0)
    ok = (F.size(parts) == 4) & (span != "")
    at = lambda k: F.btrim(F.get(parts, F.lit(k)))
    return rows.select(*df.columns, at(0).alias("caller"), at(1).alias("callee"), at(2).alias("summary"), F.when(ok, F.split_part(span, F.lit("-"), F.lit(1)).cast("int")).alias("first_line"), F.when(ok, F.split_part(span, F.lit("-"), F.lit(2)).cast("int")).alias("last_line"), (~F.coalesce(ok, F.lit(False))).alias("parse_error"))


# ---------------------------------------------------------------- validation

def is_natural_language(c: Column, drop_long_identifiers: bool = True) -> Column:
    spaces = F.length(c) - F.length(F.translate(c, " ，。", ""))
    long_word = (F.length(c) >= 12) & c.rlike(r"^[一-鿿_a-zA-Z0-9]+$") if drop_long_identifiers else F.lit(False)
    return (F.coalesce(F.length(c), F.lit(0)) == 0) | (F.length(c) > 120) | (spaces >= 4) | long_word


def is_supported(target: Column, code: Column) -> Column:
    """Whether a target is named in its caller's code: one of its last two parts, or of an import its name or last part."""
    imported = F.substring(target, 8, 1 << 20)
    last = lambda sep: F.element_at(F.split(imported, sep), -1)
    inside = lambda t: (t != "") & code.contains(t)
    parts = F.filter(F.transform(F.split(target, r"[.:/\\]+"), lambda c: F.btrim(c)), lambda c: c != "")
    tail = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2))
    return F.when(target.isin(NO_DEPENDENCY, ""), F.lit(True)).when(target.startswith("import:"), inside(imported) | inside(last(r"\.")) | inside(last("/"))).otherwise(F.exists(tail, lambda t: code.contains(t)))


def validated(units: DataFrame, drop_long_identifiers: bool = True) -> DataFrame:
    """Units that name both ends, as names, in a possible line range, with code that supports the target; each once, the first wins."""
    c = F.col
    good = (F.coalesce(F.length("source_name"), F.lit(0)) > 0) & (F.coalesce(F.length("target_name"), F.lit(0)) > 0)
    good = good & ~is_natural_language(c("source_name"), drop_long_identifiers) & ~is_natural_language(c("target_name"), drop_long_identifiers)
    good = good & (c("start_code_line") <= c("end_code_line")) & (c("start_code_line") >= 1) & (F.length(F.btrim(F.coalesce("source_code", F.lit("")))) > 0) & is_supported(c("target_name"), c("source_code"))
    w = Window.partitionBy("path", "source_name", "target_name", "start_code_line", "end_code_line").orderBy("unit_id")
    return units.where(good).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# ---------------------------------------------------------------- extraction

_STRING_OR_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*)\s*\(")
_HEAD = {
    ".js": re.compile(r"(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>)|^\s*(?:async\s+)?(?!if|for|while|switch|catch|return|function)([A-Za-z_$][\w$]*)\s*\([^()]*\)\s*(?=\{)", re.M),
    ".go": re.compile(r"^func\s+(?:\([^()]*\)\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?\(", re.M),
    ".php": re.compile(r"function\s+&?([A-Za-z_]\w*)\s*\("),
    "": re.compile(r"(?<![\w.])(?!(?:if|for|foreach|while|switch|catch|return|else|new|sizeof|using|lock|synchronized|case|throw)\b)([A-Za-z_~][\w:~]*)\s*\([^(){};]*\)\s*(?:const\s*|noexcept\s*|override\s*|throws\s+[\w., ]+)*(?=\{)", re.M),
}
_HEAD[".ts"] = re.compile(_HEAD[".js"].pattern.replace(r"\([^()]*\)\s*(?=\{)", r"\([^()]*\)\s*(?::\s*[^{};=]+)?(?=\{)"), re.M)
_CLASS = re.compile(r"\b(?:class|struct|interface|trait)\s+([A-Za-z_]\w*)[^;{}()]*\{")
_KEYWORDS = frozenset("if for foreach while switch catch return function func sizeof typeof new else do try using lock elseif array list isset empty unset echo print throw case await defer go select range super this".split())


# Import statements by language, read where comments are blanked and strings are not.
_IMPORT = {
    ".js": re.compile(r"^[ \t]*import\s+(?:[^;\"'()]*?\sfrom\s*)?[\"']([^\"'\n]+)[\"']", re.M),
    ".java": re.compile(r"^[ \t]*import\s+(?:static\s+)?([\w.*]+)\s*;", re.M),
    ".go": re.compile(r"^import\s*\(([^)]*)\)|^import\s+(?:[\w.]+\s+)?(\"[^\"\n]+\")", re.M),
    ".php": re.compile(r"\b(?:include|require)(?:_once)?\s*\(?\s*['\"]([^'\"\n]+)['\"]|^[ \t]*use\s+([\w\\]+)", re.M),
    ".c": re.compile(r"^[ \t]*#include\s*[<\"]([^>\"\n]+)[>\"]", re.M),
    ".cs": re.compile(r"^[ \t]*(?:global\s+)?using\s+([\w.]+)\s*;", re.M),
}
_IMPORT[".ts"], _IMPORT[".cpp"] = _IMPORT[".js"], _IMPORT[".c"]
_COMMENT = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|//[^\n]*|/\*[\s\S]*?\*/")
_BEFORE = re.compile(r"([\w$]+|[^\s\w])?[ \t]*$")
_EXPRESSION_WORDS = frozenset("new return await throw yield typeof in of case else do delete void not and or print echo".split())


def _declared(blank: str, at: int, ext: str, in_class: bool) -> bool:
    """Whether the name at this place outside the functions is declared, not called."""
    before = _BEFORE.search(blank, blank.rfind("\n", 0, at) + 1, at)[1] or ""
    if not before:
        return in_class or ext == ".go"
    if before[-1].isalnum() or before[-1] in "_$":
        return before not in _EXPRESSION_WORDS
    return before == "@" or before == "[" and ext == ".cs" or before in "*&>~]" and ext in (".c", ".cpp", ".java", ".cs")


def _module(code: str, blank: str, ext: str, spans: list[tuple[int, int]], classes: list[tuple[int, int, str]]) -> list[str]:
    """Imports of a file, then the calls outside its functions."""
    visible = _COMMENT.sub(lambda m: m[1] or re.sub(r"[^\n]", " ", m.group()), code)
    found = []
    for m in _IMPORT[ext].finditer(visible):
        if ext == ".php" and m[2] and any(a < m.start() < b for a, b, _ in classes):
            continue  # traits of a class
        said = next(filter(None, m.groups()), "")
        found += ["import:" + x for x in (re.findall(r"\"([^\"]+)\"", said) if ext == ".go" else [said])]
    plain = re.sub(r"^[ \t]*#(?:[^\n\\]|\\[\s\S])*", lambda m: re.sub(r"[^\n]", " ", m.group()), blank, flags=re.M) if ext in (".c", ".cpp", ".cs") else blank
    at = 0
    for a, b in [*sorted(spans), (len(plain), len(plain))]:  # what is left between the functions
        for m in _CALL.finditer(plain, at, a) if a > at else ():
            if m[1] in _KEYWORDS or m[1] in ("import", "include", "include_once", "require_once") or ext == ".php" and m[1] == "require":
                continue
            if not _declared(plain, m.start(), ext, any(x < m.start() < y for x, y, _ in classes)):
                found.append(_called(m[1]))
        at = max(at, b)
    return list(dict.fromkeys(found))


def _called(name: str) -> str:
    return name.replace("->", ".").replace("::", ".").lstrip("$")


def _body(code: str, at: int) -> int:
    """The end of the balanced block that opens at the first brace behind at; -1 if none closes."""
    start = code.find("{", at)
    depth = 0
    for m in _BRACES.finditer(code, start) if start >= 0 else ():
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return -1


_BRACES, _BRACKETS = re.compile(r"[{}]"), re.compile(r"[{}()\[\]]+")


def _balanced(blank: str) -> bool:
    """Whether brackets pair in code without strings and comments."""
    left, size = "".join(_BRACKETS.findall(blank)), -1
    while len(left) != size:  # as often as brackets are nested
        size = len(left)
        left = left.replace("()", "").replace("[]", "").replace("{}", "")
    return not left


def _scan(code: str, ext: str, module: str) -> list[tuple[str, int, int, list[str]]] | None:
    """(caller, first line, last line, targets) of the module, if it has targets, and the functions of a brace language; None if brackets do not pair."""
    blank = _STRING_OR_COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), code)
    if not _balanced(re.sub(r"^[ \t]*#(?:[^\n\\]|\\[\s\S])*", "", blank, flags=re.M) if ext in (".c", ".cpp", ".cs") else blank):
        return None
    classes = [(m.start(), _body(blank, m.start()), m[1]) for m in _CLASS.finditer(blank)]
    ends = [m.end() for m in re.finditer("\n", blank)]
    out, spans = [], []
    for m in _HEAD.get(ext, _HEAD[""]).finditer(blank):
        name = next(filter(None, m.groups()))
        end = _body(blank, m.end() - 1 if ext != ".go" else m.start())
        if end < 0:
            continue
        spans.append((m.start(), end))
        owner = [c for a, b, c in classes if a < m.start() < b]
        scope = f"{owner[-1]}.{name}" if owner and "::" not in name else name.replace("::", ".")
        begin = blank.find("{", m.end() - 1 if ext != ".go" else m.start())
        calls = [_called(c) for c in _CALL.findall(blank, begin, end) if c not in _KEYWORDS]
        out.append((scope, bisect_right(ends, m.start()) + 1, bisect_right(ends, end) + 1, list(dict.fromkeys(calls))))
    targets = _module(code, blank, ext, spans, classes)
    return [(module, 1, max(1, len(code.splitlines())), targets), *out] if targets else out


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return _dotted(node.func) if isinstance(node, ast.Call) else _dotted(node.value) if isinstance(node, ast.Subscript) else ""


class _Python(ast.NodeVisitor):
    def __init__(self, stem: str):
        self.stem, self.stack, self.found, self.spans = stem, [], {}, {}

    @property
    def scope(self) -> str:
        kinds = self.stack
        if not kinds or kinds[-1][0] == "class" and len(kinds) == 0:
            return self.stem
        name = kinds[-1][1]
        owner = next((n for k, n in reversed(kinds[:-1]) if k == "class"), "")
        return f"{owner}.{name}" if owner and kinds[-1][0] == "def" else name

    def add(self, target: str) -> None:
        if target:
            self.found.setdefault(self.scope, {}).setdefault(target)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._enter("class", node)

    def visit_FunctionDef(self, node) -> None:
        self._enter("def", node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def _enter(self, kind: str, node) -> None:
        self.stack.append((kind, node.name))
        if kind == "def":
            self.spans[self.scope] = (node.lineno, node.end_lineno)
            self.found.setdefault(self.scope, {})
        for child in node.body:
            self.visit(child)
        self.stack.pop()

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.add(f"import:{a.name}")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.add(f"import:{'.' * node.level}{node.module or ''}.{a.name}".replace("import:.", "import:", 1) if not node.module else f"import:{'.' * node.level}{node.module}.{a.name}")

    def visit_Call(self, node: ast.Call) -> None:
        self.add(_dotted(node.func))
        self.generic_visit(node)


def extract(code: str, ext: str, name: str) -> list[tuple[str, str, str, int, int]] | None:
    """(caller, target, description, first line, last line) of a file, lines from 1; None if it does not parse."""
    stem = (name or "module").rsplit(".", 1)[0]
    n_lines = len(code.splitlines())
    if ext == ".py":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError):
            return None
        v = _Python(stem)
        v.visit(tree)
        rows = [(scope, list(targets), *v.spans.get(scope, (1, n_lines))) for scope, targets in v.found.items()]
    else:
        found = _scan(code, ext, stem)
        if found is None:
            return None
        rows = [(scope, targets, a, b) for scope, a, b, targets in found]
    out = []
    for scope, targets, a, b in rows:
        for t in targets or [NO_DEPENDENCY]:
            said = "no outside dependency" if t == NO_DEPENDENCY else f"imports {t[7:][:12]}" if t.startswith("import:") else f"calls {t[:14]}"
            out.append((scope, t, said, a, b))
    return out


#: Characters of code in one frame of units.
FRAME_CHARS = 4_000_000
COLUMNS = "file_id long, path string, name string, source_name string, target_name string, source_desc string, start_code_line int, end_code_line int, source_code string, status string"


def fallback_tokens(max_input_tokens: int | None) -> int:
    """Size of the sections that are tried one by one where a file as a whole does not parse."""
    return min(12_000, max(2_000, (max_input_tokens or 24_000) // 2))


def extracted(files: DataFrame, max_input_tokens: int | None = 8000) -> DataFrame:
    """Units of every file of a parsed extension; status 'ok', 'fallback' (only sections that parse) or 'failed' with null ends."""
    from .chunks import pack

    budget = fallback_tokens(max_input_tokens)

    rows = files.select("file_id", "path", "name", "source_code", text.suffix(F.col("path")).alias("ext"), F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).alias("first"))
    rows = rows.where(F.col("ext").isin(*PARSED_EXTENSIONS) & F.col("source_code").rlike(r"\S"))

    names = [x.split(" ")[0] for x in COLUMNS.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[x.split(" ")[1]] for x in COLUMNS.split(", ")]

    def frame(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, held = [], 0
            for i, path, name, code, ext, first in zip(*(c.to_pylist() for c in batch.columns)):
                name = name or path.rsplit("/", 1)[-1]
                lines, found, status = code.splitlines(), extract(code, ext, name), "ok"
                if found is None:  # sections that parse by themselves
                    found, status = [], "fallback"
                    for a, b in pack(code, ext, budget, isolate=True):
                        part = extract("\n".join(lines[a - 1:b]), ext, name)
                        found += [(s, t, d, x + a - 1, y + a - 1) for s, t, d, x, y in part or ()]
                if not found:
                    out.append((i, path, name, None, None, None, None, None, None, "failed"))
                span, body = None, ""
                for s, t, d, a, b in found:
                    if span != (a, b):
                        span, body = (a, b), "\n".join(lines[a - 1:b])
                    out.append((i, path, name, s, t, d, a + first - 1, b + first - 1, body, status))
                    held += len(body)
                    if held > FRAME_CHARS:  # every unit carries its caller's code
                        yield frame(out)
                        out, held = [], 0
            yield frame(out)

    return rows.mapInArrow(run, COLUMNS)


def dispatched(files: DataFrame, engine: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(units, files left for a reviewer): 'ast' leaves none, 'llm' leaves all, 'auto' those without units."""
    engine = engine if engine in ("ast", "llm") else "auto"
    if engine == "llm":
        return extracted(files.limit(0)), files
    units = extracted(files)
    good = units.where("status <> 'failed'")
    return good, files.limit(0) if engine == "ast" else files.join(good.select("file_id").distinct(), "file_id", "left_anti")


def all_units(files: DataFrame, review: Callable[[DataFrame], DataFrame], engine: str = "auto") -> DataFrame:
    """(file_id, source_name, target_name, source_desc, start_code_line, end_code_line, origin) of both branches: read from the code ('ast'), and
    where that gives none from a reviewer ('llm'); review takes the files left and gives (file_id, output) of extractor lines."""
    good, left = dispatched(files, engine)
    names = ("source_name", "target_name", "source_desc", "start_code_line", "end_code_line")
    read = good.select("file_id", *names, F.lit("ast").alias("origin"))
    asked = parse_lines(review(left).select("file_id", "output")).where(~F.col("parse_error"))
    return read.unionByName(asked.select("file_id", *[F.col(a).alias(b) for a, b in zip(("caller", "callee", "summary", "first_line", "last_line"), names)], F.lit("llm").alias("origin")))
