"""Problem 2: generated, minified, vendored files and bulk data kept as code.

Four kinds of evidence, each decided per file where the file is read:

* the notice in the file's header, found by one multi-pattern automaton over the leading comment and confirmed by a sentence rule
  (code that merely talks about generated or third-party things does not match the sentence rule);
* path and name: vendored and generated directories, lockfiles, suffixes of generated and minified files;
* the shape of the text: minified or bundled scripts, bulk data, numbered families of machine-written members;
* the wording of known outside libraries: the catalogue's five-word shingles, hashed.  A bitmap of them (of fixed size, so it only lets
  more through as the catalogue grows) sifts the shingles of the files that nothing else gives away; what is left is joined with the
  catalogue by shingle, under a salt, as a third of all files may be copies of one library.  A file that shares at least ``SIMILARITY``
  of the smaller of the two shingle sets with any library is a copy.  Nothing of the catalogue but its bitmap reaches the driver.

Null code, path or name is no evidence.  Rows delivered twice count once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Directory names and name patterns of files that are not first-party hand-written source.
VENDORED_DIRS = "vendor third_party thirdparty third-party 3rdparty external extern node_modules bower_components deps godeps jspm_packages site-packages pods carthage _vendor vendored"
GENERATED_DIRS = "gen generated __generated__ autogen gen-src generated-src generated_sources stubs_gen codegen_out auto_generated autogenerated .generated"
BUILD_DIRS = "dist"
LOCKFILES = "package-lock.json yarn.lock pnpm-lock.yaml composer.lock gemfile.lock cargo.lock poetry.lock pipfile.lock go.sum npm-shrinkwrap.json packages.lock.json deps.lock.json flake.lock"
NAME = re.compile(
    r"(?:[._-]min|\.bundle|[._-]bundled|\.chunk|\.packed|\.prod)\.(?:js|ts|mjs|css)$|^(?:chunk|vendors?|bundle)[-.~][0-9a-f]{5,}[\w.-]*\.js$|^vendors?~.*\.js$|"
    r"(?:_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|ts|rb)|\.pb\.(?:go|cc|h|c|cpp|cc\.cpp)|\.pb\.cc\.\w+|Grpc\.java|OuterClass\.java|_grpc\.pb\.\w+)$|"
    r"(?:\.g|\.g\.i|\.designer|\.generated|\.gen|\.types\.gen|\.autogen)\.\w+$|(?:_gen|_generated|_autogen|\.generated)\.\w+$|^zz_generated[._]|^(?:moc|ui|qrc)_\w+\.(?:cpp|h|py)$|"
    r"^lex\.[\w.]+\.c$|\.(?:tab|yy)\.(?:c|h|cc|cpp)$|^y\.tab\.[ch]$|\.lock\.json$|(?:^|[-_.])lock\.(?:json|yaml|yml)$|_string\.go$|^bindata\.go$|\.js\.map$", re.I)
VERSIONED_DIR = re.compile(r"^[a-z][a-z0-9_]*-\d+(?:\.\d+)+$")

# What the automaton looks for in headers; a hit is then judged by the sentence rules below it.
HINTS = (
    "generated", "generado", "generato", "gerado", "generiert", "erzeugt", "généré", "genere", "produit automatiquement", "machine-written", "machine written", "machine output", "written by", "do not edit", "do not modify", "do not change", "edit the", "manual edit", "changes will be lost", "自动生成", "自動生成", "сгенерирован", "wygenerowan", "lockfile", "produced by",
    "third-party", "third party", "第三方", "imported unmodified", "copied", "verbatim", "upstream", "vendored", "übernommen", "copié", "copiado", "скопирован", "skopiowan", "licence", "license", "(c)", "copyright", "terms", "local patch", "minified", "bundled",
)
_SENTENCES = {
    "generated": re.compile(
        r"@generated\b|<auto-?generated|\bauto-?generated(?: file\b| code\b| by\b| from\b| on \d|$)|(?<!\bis )(?<!\bare )(?<!\bbe )\b(?:code |file |automatically )?generated (?:by|from|with|on \d)\b|\b(?:was|were|has been|is) (?:automatically |auto-)generated (?:by|from)\b|\bcode generated\b|"
        r"\bdo not (?:edit|modify|change)(?: (?:this file|manually|directly|by hand|it|them))*\s*(?:[.;!]\s*)?(?:\*/|-->|\",?)?$|\bmachine[- ](?:written|generated|made) (?:by|from|code|file)\b|\bmachine output\b|\bedit the [\w .]*\b(?:template|schema|grammar|source|definition|spec)s? instead\b|\bmanual (?:edit|change)s? (?:is|are|will be) (?:overwritten|lost)|\bchanges (?:made here )?will be (?:lost|overwritten)|"
        r"\bgenerad[oa] (?:automáticamente )?(?:por|desde|a partir)\b|\bno editar\b|\bgerad[oa] (?:automaticamente )?(?:por|a partir)\b|\bnão editar\b|\b(?:erzeugt|generiert)\.|\bnicht (?:von hand|manuell) (?:bearbeiten|ändern)\b|\b(?:produit|généré|genere)s? automatiquement (?:par|depuis|à partir)\b|\bgénéré par\b|\bne pas (?:modifier|éditer)\b|\bgenerato (?:automaticamente )?da\b|自动生成|自動生成|(?:сгенерирован|создан автоматически)|wygenerowan\w* (?:przez|automatycznie)", re.I),
    "vendored": re.compile(
        r"\bthird[- ]party (?:code|library|source|module|file)\b\s*(?:[:.,(]|$|from\b|imported\b|vendored\b)|\bimported (?:unmodified|unchanged|verbatim)\b|\bcopied (?:verbatim |unchanged |unmodified )?from [\w.-]+ v?\d|\b(?:vendored|taken|adapted) (?:verbatim |unmodified )?from [\w./-]+ v?\d|\bcopied verbatim from\b|\bvendored from\b|^\W*upstream: \S+|\breport (?:problems|bugs|issues) (?:there|upstream)\b|\bübernommen aus [\w.-]+ v?\d|\bnicht hier ändern\b|第三方库|第三方代码|"
        r"\bcopié(?:e)? (?:depuis|de) [\w.-]+ v?\d|\bcopiado de [\w.-]+ v?\d|\bсторонн\w+ (?:код|библиотек)|\bsee licen[cs]e\.\w+|\breleased under (?:the |an? )?(?!internal)[\w -]*\b(?:terms|licen[cs]e)\b|\bfree use under (?:the |an? )?[\w -]*licen[cs]e\b|\blicensed under (?:the |an? )?[\w -]*licen[cs]e\b|\blocal patch \d+\b", re.I),
}
_COPYRIGHT = re.compile(r"(?:copyright\s*)?(?:\(c\)|©)\s*(?:\d{4}(?:\s*[-,]\s*\d{4})*)?,?\s*(?:by\s+)?(?:the\s+)?([\w.-]+)?\s*(authors?|makers?|contributors?|developers?|team|project|foundation|inc|ltd)?", re.I)
_COMMENT_LINE = re.compile(r"^\s*(?:$|//|#(?!include|define|if|pragma)|/\*|\*|--|;|<!--|<\?|\"\"\"|'''|[\[{]?\s*$|\"_?(?:note|comment|generated|about|warning|readme)\w*\"\s*:)", re.I)
_IN_COMMENT = re.compile(r"^\s*(?://+|#+!?|/\*+|\*+/?|--|;+|<!--|\"\"\"|''')?\s*")
HEADER_LINES_OF_CODE = 3
SHINGLE, SIMILARITY = 5, 0.5
#: Bits of the bitmap of the catalogue's shingles, and parts a hot shingle is split into.
SHINGLE_BITS, SALTS = 1 << 24, 16


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in HINTS:
        a.add_word(w, w)
    a.make_automaton()
    return a


def header(code: str) -> str:
    """The file's leading comment, and a few lines of code behind it (a package clause may precede the notice)."""
    pos, left = 0, HEADER_LINES_OF_CODE
    open_block = ""
    while pos < len(code):
        end = code.find("\n", pos)
        end = len(code) if end < 0 else end
        line = code[pos:end]
        if open_block:
            if open_block in line:
                open_block = ""
        elif _COMMENT_LINE.match(line):
            s = line.strip()
            for a, b in (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''")):
                if s.startswith(a) and b not in s[len(a):]:
                    open_block = b
        else:
            left -= 1
            if left < 0:
                return code[:pos]
        pos = end + 1
    return code


def notice(code: str, repo: str | None, found: ahocorasick.Automaton) -> str:
    """The kind of notice in the header ('' if none)."""
    head = header(code)
    low = head.lower()
    if next(found.iter(low), None) is None:
        return ""
    for line in head.split("\n"):
        body = _IN_COMMENT.sub("", line).strip()
        if not body or next(found.iter(body.lower()), None) is None or not (_COMMENT_LINE.match(line) or "/*" in head):
            continue
        for kind, rule in _SENTENCES.items():
            if rule.search(body):
                return kind
        if (m := _COPYRIGHT.match(body)) and "(c)" in body.lower()[:16]:
            who = (m[1] or "").lower()
            if who and who not in ("authors", (repo or "").lower()) and m[2] and m[2].lower() not in ("authors", "author", "team"):
                return "vendored"
    return ""


_DIRS = {d: "vendored" for d in VENDORED_DIRS.split()} | {d: "generated" for d in GENERATED_DIRS.split()} | {d: "bundled" for d in BUILD_DIRS.split()}
_LOCKS = frozenset(LOCKFILES.split())


def by_path(path: str | None, name: str | None) -> str:
    parts = (path or "").split("/")
    for d in parts[:-1]:
        if (kind := _DIRS.get(d.lower())) or VERSIONED_DIR.match(d):
            return kind or "vendored"
    for n in {parts[-1], name or ""} - {""}:
        if n.lower() in _LOCKS or NAME.search(n):
            return "named"
    return ""


_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`')
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{60,}|(?:\\x[0-9a-fA-F]{2}|\\[0-7]{3}){12,}|(?:[A-Za-z0-9+/=]{40,}[\\\s\"'+.,]*){3,}")
_KEY = re.compile(r"-----BEGIN [A-Z ]*-----[\s\S]*?(?:-----END [A-Z ]*-----|\Z)")
_TAG = re.compile(r"</?\w{1,3}>")
_NUMBER = re.compile(r"\b(?:0[xX][0-9a-fA-F]+|\d[\d.]*(?:[eE][+-]?\d+)?)[uUlLfF]*\b")
_LITERALS = re.compile(r"[S0\s,;:\[\](){}=>+\-.]*")


def shape(code: str, ext: str) -> str:
    """'minified', 'bulk data' or 'machine form' by the form of the text, '' otherwise."""
    n = len(code)
    if n < 120:
        return ""
    if ext in (".js", ".ts", ".css", ".mjs"):
        lines = code.count("\n") + 1
        if n / lines > 110:
            bare = _STRING.sub("", code)
            if len(bare) > 0.5 * n and len(bare) / (bare.count("\n") + 1) > 90 and sum(map(bare.count, (" ", "\n", "\t"))) < 0.12 * len(bare):
                return "minified"
    digits = len(code) - len(code.translate(_NO_DIGITS))
    # a run of few different characters is a ruler or a filler, no data
    blobs = sum(len(m) for m in _BLOB.findall(_KEY.sub("", code)) if len(set(m)) > 8) if "=" in code or digits > 0.05 * n else 0
    if blobs > 0.55 * n and n > 600:
        return "bulk data"
    if digits > 0.25 * n or code.count('"') + code.count("'") > 0.06 * n:
        texts = [x[1:-1] for x in _STRING.findall(code)]
        rows = [x for x in _NUMBER.sub("0", _TAG.sub("", _STRING.sub("S", code))).split("\n") if x.strip()]
        data = sum(1 for x in rows if _LITERALS.fullmatch(x))
        if data > 0.75 * len(rows) or len(rows) < 4 and all(sum(map(x.count, "S0,[](){}: ;=")) > 0.9 * len(x) for x in rows):
            random_text = sum(len(x) for x in texts if len(x) >= 16 and " " not in x and any(c.isdigit() for c in x))
            if digits > 0.25 * n or random_text > 0.4 * n:
                return "bulk data"
    if digits > 0.1 * n and _table(code):
        return "bulk data"
    if _family(code):
        return "machine form"
    return ""


_DUMP = re.compile(r"[0-9A-Fa-f]{4,16}:?[ \t]+(?:[0-9A-Fa-f]{2,8}[ \t]+){4,}.*")
_CODE_SIGNS = re.compile(r"[(){}=]|//|\bif\b")


def _table(code: str) -> bool:
    """Whether nearly all lines are lines of a hex dump, or rows of as many cells and no signs of code."""
    lines = [x for x in map(str.strip, code.split("\n")) if x]
    if len(lines) < 6:
        return False
    if sum(bool(_DUMP.fullmatch(x)) for x in lines) > 0.9 * len(lines):
        return True
    for sep in ";,\t|":
        cells = lines[0].count(sep)
        if cells >= 2 and sum(x.count(sep) == cells and not _CODE_SIGNS.search(x) for x in lines) > 0.9 * len(lines):
            return True
    return False


_NO_DIGITS = str.maketrans("", "", "0123456789")
_MEMBER = re.compile(r"^[ \t]*(?:(?:public|private|static|export|const|function|def|func|int|String|string|auto|final|unsigned|char|short|case|exports\.|inline|std::string|self\.|var|#define)\b[ \t.]*)*(?:\(\w+ \*\w+\) )?([A-Za-z_][A-Za-z]*(?:_[A-Za-z]+)*?)_?(\d+)\b[ \t]*(?:[(=:]|\[|0x)", re.M)
_NUMBERED = re.compile(r"[A-Za-z_](\d{1,3})(?=\(|\[| = 0x| 0x| = function)")
_STEP = re.compile(r"^\s*case (\d+): ?(?:return|goto|state ?=) ?-?\d+;?\s*(?:break;)?\s*$", re.M)


def _family(code: str) -> bool:
    """Top-level members numbered one after the other (get_row_0, get_bucket_1, ...) or a table of states: no hand writes those."""
    steps = _STEP.findall(code) if "case 5" in code or "case " in code and "goto" in code else ()
    if len(steps) >= 8 and [int(x) for x in steps] == list(range(int(steps[0]), int(steps[0]) + len(steps))):
        return True
    if not {"1", "2", "3", "4"} <= set(_NUMBERED.findall(code)):
        return False
    members = [(m[1], int(m[2])) for m in _MEMBER.finditer(code) if len(m.group()) - len(m.group().lstrip()) <= 4 and (m.group()[-1] in "([" or m[1].isupper() or "exports" in m.group())]
    run = best = 0
    last = -1
    for _, k in members:
        run = run + 1 if k == last + 1 else run if k == last else 1
        last = k
        best = max(best, run)
    return best >= 5


_COMMENTS = re.compile(r"/\*[\s\S]*?\*/|(?://|#)[^\n]*")
_WORDS = re.compile(r"\w+")


def shingles(code: str) -> set[int]:
    """Hashes of five words in a row, without comments."""
    words = _WORDS.findall(_COMMENTS.sub(" ", code))
    return {zlib.crc32(" ".join(words[k:k + SHINGLE]).encode("utf-8", "surrogatepass")) for k in range(len(words) - SHINGLE + 1)}


def _bitmap(libraries: DataFrame) -> bytes:
    """The catalogue's shingles as bits; its size is fixed, whatever the size of the catalogue."""
    bit = F.pmod("h", F.lit(SHINGLE_BITS)).cast("int")
    parts = libraries.select(bit.alias("bit")).groupBy((F.col("bit") / (1 << 15)).cast("int").alias("part")).agg(F.collect_set("bit").alias("bits"))
    out = bytearray(SHINGLE_BITS >> 3)
    for row in parts.toLocalIterator():
        for k in row.bits:
            out[k >> 3] |= 1 << (k & 7)
    return bytes(out)


def _kernel(bitmap, smallest: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, bits = automaton(), bitmap.value
        for b in it:
            rows: list[tuple] = []
            for i, repo, path, name, code, ext in zip(*(b.column(k).to_pylist() for k in range(6))):
                kind = by_path(path, name)
                if not kind and code and code.strip():
                    kind = notice(code, repo, found) or shape(code, ext)
                    if not kind and smallest:
                        own = shingles(code)
                        hits = [h for h in own if bits[(h % SHINGLE_BITS) >> 3] >> (h & 7) & 1]
                        if hits and len(hits) >= SIMILARITY * min(len(own), smallest):
                            rows += [(i, None, len(own), h) for h in hits]
                if kind:
                    rows.append((i, kind, None, None))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64()))], names=["file_id", "kind", "n_own", "h"])

    return run


def _exploded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for i, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = sorted(shingles(code))
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), pa.int64()), pa.array([len(own)] * len(own), pa.int32()), pa.array(own, pa.int64())], names=["lib_id", "n_lib", "h"])


def library_copies(hits: DataFrame, libraries: DataFrame) -> DataFrame:
    """(file_id, kind) of the files of hits (file_id, n_own, h) that share at least SIMILARITY of the smaller shingle set with a library (lib_id, n_lib, h)."""
    own = hits.distinct().withColumn("salt", F.pmod(F.xxhash64("file_id"), F.lit(SALTS)))
    lib = libraries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    shared = own.join(lib, ["h", "salt"]).groupBy("file_id", "lib_id").agg(F.count("*").alias("n"), F.max("n_own").alias("n_own"), F.max("n_lib").alias("n_lib"))
    return shared.where(F.col("n") >= F.least("n_own", "n_lib") * SIMILARITY).select("file_id", F.lit("library").alias("kind")).distinct()


def not_first_party(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """(file_id, kind) of files that are generated, minified, vendored or bulk data; one row per file, the first kind of evidence."""
    rows = files.where(F.col("file_id").isNotNull()).select(F.col("file_id").cast("long").alias("file_id"), "repo", "path", "name", "source_code", common.extension().alias("ext"))
    lib = libraries.select(F.col("lib_id").cast("long"), "source_code").where(F.col("source_code").isNotNull() & F.col("lib_id").isNotNull())
    lib = common.kept(lib.mapInArrow(_exploded, "lib_id long, n_lib int, h long").dropDuplicates(["lib_id", "h"]))
    smallest = lib.agg(F.min("n_lib")).first()[0] or 0
    shared = files.sparkSession.sparkContext.broadcast(_bitmap(lib))
    found = common.kept(common.spread(rows).mapInArrow(_kernel(shared, smallest), "file_id long, kind string, n_own int, h long"))
    copies = library_copies(found.where("h is not null").select("file_id", "n_own", "h"), lib)
    return found.where("kind is not null").select("file_id", "kind").unionByName(copies).groupBy("file_id").agg(F.min("kind").alias("kind"))
