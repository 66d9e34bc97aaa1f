"""Risk hints: which words of a node's texts point to input, dangerous calls, safety or validation, by language."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("input", "sink", "validation", "safety")

# Patterns that decide the hints; common to all languages first, then by extension.
COMMON: dict[str, tuple[str, ...]] = {
    "input": (r"\b(upload|file|filename|filepath|path|callback|redirect)\b",),
    "sink": (r"\b(eval|exec)\b", r"\b(select|insert|update|delete)\b.*(\+|format\(|f\"|sprintf\()", r"\b(innerHTML|dangerouslySetInnerHTML|document\.write)\b"),
    "validation": (r"\b(validate|sanitize|escape|check|verify|guard|filter)\b", r"\b(auth|authorize|permission|acl|role|requiredLogin|requiredAuth)\b", r"\b(is_safe|safe_path|normalized|canonical)\b"),
    "safety": (r"\b(whitelist|allowlist)\b", r"\b(parameterized|prepared|placeholder)\b"),
}
BY_EXTENSION: dict[str, dict[str, tuple[str, ...]]] = {
    ".py": {
        "input": (r"\brequest\.(args|form|json|values|files)\b", r"\b(input|sys\.argv|os\.environ|getenv)\b"),
        "sink": (r"\b(subprocess\.(run|Popen|call)|os\.system)\b", r"\b(pickle\.load|pickle\.loads|yaml\.load)\b", r"\b(requests\.(get|post|request))\b", r"\b(open|Path\.open|read_text|write_text)\b", r"\b(sqlite3|pymysql|psycopg2|sqlalchemy)\b"),
        "validation": (r"\b(pydantic|validator|marshmallow|schema\.load)\b",),
        "safety": (r"\b(yaml\.safe_load|html\.escape|markupsafe\.escape)\b", r"\b(pathlib\.Path|resolve\(\))\b", r"\b(subprocess\.(run|Popen)\s*\(\s*\[)\b"),
    },
    ".js": {
        "input": (r"\b(req|request)\.(query|body|params|headers|files)\b", r"\b(process\.env|window\.location|document\.location)\b"),
        "sink": (r"\b(child_process\.(exec|spawn|execSync))\b", r"\b(require\s*\(|import\s*\()\b", r"\b(fetch|axios\.(get|post|request))\b", r"\b(fs\.(readFile|readFileSync|writeFile|writeFileSync|createReadStream|createWriteStream))\b"),
        "validation": (r"\b(zod|joi|yup|express-validator)\b",),
        "safety": (r"\b(path\.normalize|path\.resolve)\b", r"\b(DOMPurify|validator\.)\b"),
    },
    ".ts": {
        "input": (r"\b(req|request)\.(query|body|params|headers|files)\b", r"\b(process\.env)\b"),
        "sink": (r"\b(child_process\.(exec|spawn|execSync))\b", r"\b(fetch|axios\.(get|post|request))\b", r"\b(fs\.(readFile|readFileSync|writeFile|writeFileSync))\b"),
        "validation": (r"\b(zod|joi|class-validator|nestjs\/common)\b",),
        "safety": (r"\b(path\.normalize|path\.resolve)\b",),
    },
    ".java": {
        "input": (r"\b(request\.getParameter|@RequestParam|@PathVariable|@RequestBody)\b", r"\b(System\.getenv|MultipartFile)\b"),
        "sink": (r"\b(Runtime\.getRuntime\(\)\.exec|ProcessBuilder)\b", r"\b(HttpURLConnection|RestTemplate|WebClient)\b", r"\b(FileInputStream|FileOutputStream|Files\.(read|write))\b", r"\b(Statement|createStatement|executeQuery|executeUpdate)\b"),
        "validation": (r"\b(@Valid|Validator|BindingResult)\b",),
        "safety": (r"\b(PreparedStatement|@PreAuthorize|hasRole)\b", r"\b(Paths\.get|normalize\(\)|toRealPath\(\))\b"),
    },
    ".go": {
        "input": (r"\b(r\.URL\.Query|FormValue|PostFormValue|ShouldBindJSON|BindJSON)\b", r"\b(os\.Getenv|c\.Param|c\.Query|c\.PostForm)\b"),
        "sink": (r"\b(exec\.Command|sql\.DB|QueryRow|Query|Exec)\b", r"\b(http\.Get|http\.Post|client\.Do)\b", r"\b(os\.Open|os\.Create|ioutil\.ReadFile|os\.WriteFile)\b", r"\b(template\.HTML|text/template)\b"),
        "validation": (r"\b(validator\.New|ShouldBind|binding:)\b",),
        "safety": (r"\b(html/template|filepath\.Clean|filepath\.Join)\b", r"\b(PrepareContext|QueryContext|ExecContext)\b"),
    },
    ".php": {
        "input": (r"\b(_GET|_POST|_REQUEST|_FILES|_COOKIE|_SERVER|_ENV)\b",),
        "sink": (r"\b(include|include_once|require|require_once)\b", r"\b(system|exec|shell_exec|passthru|proc_open)\b", r"\b(mysqli_query|query|exec|PDO)\b", r"\b(file_get_contents|fopen|fwrite|readfile)\b", r"\b(unserialize)\b"),
        "validation": (r"\b(filter_input|htmlspecialchars|preg_match)\b",),
        "safety": (r"\b(PDO::prepare|prepare\s*\(|realpath|basename)\b",),
    },
    ".c": {
        "input": (r"\b(argv|getenv|recv|read|fgets|scanf)\b",),
        "sink": (r"\b(system|popen|execl|execv|sprintf|strcpy|strcat|gets)\b", r"\b(fopen|open|write|read)\b"),
        "validation": (r"\b(strlen|sizeof|strncmp|memcmp)\b",),
        "safety": (r"\b(snprintf|strncpy|realpath)\b",),
    },
    ".cpp": {
        "input": (r"\b(argv|getenv|recv|read|std::cin)\b",),
        "sink": (r"\b(system|popen|sprintf|strcpy|strcat)\b", r"\b(std::ifstream|std::ofstream|fstream)\b"),
        "validation": (r"\b(std::regex|std::clamp|size\(\))\b",),
        "safety": (r"\b(snprintf|std::filesystem::canonical|std::array)\b",),
    },
    ".cs": {
        "input": (r"\b(Request\.(Query|Form|Body|Headers)|IFormFile)\b", r"\b(Environment\.GetEnvironmentVariable)\b"),
        "sink": (r"\b(Process\.Start|SqlCommand|ExecuteReader|ExecuteNonQuery)\b", r"\b(File\.(ReadAllText|WriteAllText|OpenRead|OpenWrite))\b", r"\b(HttpClient\.(GetAsync|PostAsync|SendAsync))\b"),
        "validation": (r"\b(ModelState\.IsValid|DataAnnotations|FluentValidation)\b",),
        "safety": (r"\b(Path\.GetFullPath|Path\.Combine|SqlParameter)\b", r"\b(Authorize|RequireRole)\b"),
    },
}
# Weights of the scores.
SCORE = {"input": 4, "sink": 6, "validation": 2, "safety": 1}
PRIORITY = {"input": 120, "sink": 160, "validation": 70, "safety": 50}
FLAGS = "(?iudU)"  # case-insensitive with Unicode words; '.' stops at line feeds only
ASCII_FLAGS = "(?id)"  # the same on ASCII text, and several times faster


def patterns(ext: str, kind: str) -> tuple[str, ...]:
    return COMMON[kind] + BY_EXTENSION.get(ext, {}).get(kind, ())


def corpus(*parts: str) -> Column:
    """The texts that are not empty, joined by line feeds."""
    return F.concat_ws("\n", *[F.nullif(F.col(p), F.lit("")) for p in parts])


def hits(text: Column, ext: Column, kind: str) -> Column:
    """Distinct hits (their case counts) in the order of patterns, then of places."""

    def all_of(e: str, flags: str) -> Column:
        each = [F.regexp_extract_all(text, F.lit(flags + p), F.lit(0)) for p in patterns(e, kind)]
        return F.concat(*each) if len(each) > 1 else each[0]

    def found(e: str) -> Column:
        every = F.when(F.octet_length(text) == F.length(text), all_of(e, ASCII_FLAGS)).otherwise(all_of(e, FLAGS))
        return F.array_distinct(F.filter(F.transform(every, lambda c: F.trim(c)), lambda t: F.length(t) > 0))

    return reduce(lambda other, e: F.when(ext == e, found(e)).otherwise(other), reversed(BY_EXTENSION), found(""))


def score(counts: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, [counts[k] * SCORE[k] for k in KINDS])
