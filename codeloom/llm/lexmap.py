"""Lexer-state maps and bracket summaries of code chunks, and their associative reduction.

A chunk is a run of whole lines, in XML of whole tags and texts.  What it means depends on the lexer state it is entered in (code, a block
comment, one of the strings that may span lines; literals that end at a word of their own and templates within templates are never
cut), so a chunk is summarised as a map *entry state -> (exit state, residue)*.  The residue is the
chunk's code in the reduced alphabet of ``grammars``: all balanced bracket groups inside the chunk have been decided by their
local grammar and are one character each, so only unmatched brackets and the open levels around them are left.  Two
neighbours combine by following the state and by reducing the joined residues again; this is associative, so chunks of one
file may be reduced in any grouping, on any worker.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterable

from .grammars import LEFT, grammar

CODE, COMMENT, STRING, TRIPLE, OUTSIDE = "code", "comment", "string", "triple", "outside"
TEXT = "\x05"  # a string, until the words are done; then s
BAD = "\x01"  # a token that no program has: conflict marker, unterminated string, stray character
ERROR = "!"  # exit state of a chunk that no program holds
CHUNK_CHARS = 16_384
MEMO_LIMIT = 200_000

_CONFLICT = r"^(?:<{7}|>{7}|\|{7}|={7})(?:[ \t][^\n]*)?\r?$"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)"


def _tokens(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts), re.M)


# What is taken out of the code before words are looked at, by language; the order of alternatives is the lexer's order.
_REGEX_JS = r"(?:(?<=[=(,:!&|?\[])\s*+|(?:(?<=[;{}\n])|(?<=return)|(?<==>)) ?)/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`'\"]|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|\{[^{}]*\})*\})*`"
SCAN = {
    ".java": _tokens(_LINE, _BLOCK, r'"""[\s\S]*?(?:"""|\Z)', _DQ, r"'(?:[^'\\\n]|\\u*[0-9a-fA-F]+|\\.)'", _CONFLICT, r"[\"'`#\\]"),
    ".cs": _tokens(_LINE, _BLOCK, r'\$?"""[\s\S]*?(?:"""|\Z)', r'(?:\$@|@\$|@)"(?:[^"]|"")*(?:"|\Z)', r"\$?" + _DQ, r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'", _CONFLICT, r"^[ \t]*#[^\n]*", r"[\"'`#\\]"),
    ".c": _tokens(_LINE, _BLOCK, r"^[ \t]*#(?:[^\n\\/]|\\[\s\S]|/(?![*/]))*", r"(?:L|u8?|U)?" + _DQ, r"(?:L|u8?|U)?'(?:[^'\\\n]|\\[^\n])+'", _CONFLICT, r"[\"'`#\\@$]"),
    ".cpp": _tokens(_LINE, _BLOCK, r"^[ \t]*#(?:[^\n\\/]|\\[\s\S]|/(?![*/]))*", r'R"([^(\s]{0,16})\([\s\S]*?(?:\)\1"|\Z)', r"(?:L|u8?|U)?" + _DQ, r"(?<![0-9a-fA-F])(?:L|u8?|U)?'(?:[^'\\\n]|\\[^\n])+'", _CONFLICT, r"[\"`#\\@$]|(?<![0-9a-fA-F])'"),
    ".js": _tokens(_LINE, _BLOCK, _DQ, _SQ, _TEMPLATE, r"`(?:[^`\\]|\\[\s\S])*(?:`|\Z)", _CONFLICT, _REGEX_JS, r"\A#![^\n]*", r"[\"'`\\]"),
    ".go": _tokens(_LINE, _BLOCK, _DQ.replace(r"[\s\S]", "."), r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'", r"`[^`]*(?:`|\Z)", _CONFLICT, r"[\"'`\\#@$?]"),
    ".php": _tokens(r"//(?:[^\n?]|\?(?!>))*|\#(?!\[)(?:[^\n?]|\?(?!>))*", _BLOCK, r'"(?:[^"\\]|\\[\s\S])*(?:"|\Z)', r"'(?:[^'\\]|\\[\s\S])*(?:'|\Z)", r"<<<[ \t]*([\"']?)(\w+)\1\r?\n(?:[\s\S]*?\n)?[ \t]*\2\b|<<<[ \t]*[\"']?[A-Za-z]\w*[\s\S]*", r"\?>[\s\S]*?(?:<\?(?:php\b|=)|\Z)", _CONFLICT, r"`[^`]*`", r"[\"'`]"),
    ".py": _tokens(r"#[^\n]*", r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*(?:"""|\Z)', r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*(?:'''|\Z)", _DQ, _SQ, _CONFLICT, r"[\"'`?$!](?!=)"),
    ".json": _tokens(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', r'["\'/`#]'),
}
SCAN[".ts"], SCAN[".h"] = SCAN[".js"], SCAN[".cpp"]

#: Where a chunk entered in this state goes back to code.
RESUME = {
    COMMENT: re.compile(r"\*/"),
    "java:string": re.compile(r'"""'), "cs:string": re.compile(r'\A(?:[^"]|"")*+"'), "cs:triple": re.compile(r'"""'), "js:string": re.compile(r"\A(?:[^`\\]|\\[\s\S])*?`"), "go:string": re.compile("`"),
    "php:string": re.compile(r'\A(?:[^"\\]|\\[\s\S])*?"'), "php:triple": re.compile(r"\A(?:[^'\\]|\\[\s\S])*?'"), "php:outside": re.compile(r"<\?(?:php\b|=)"), "py:string": re.compile(r'\A(?:[^"\\]|\\[\s\S])*?"""'), "py:triple": re.compile(r"\A(?:[^'\\]|\\[\s\S])*?'''"),
}
STATES = {
    ".java": (CODE, COMMENT, STRING), ".cs": (CODE, COMMENT, STRING, TRIPLE), ".c": (CODE, COMMENT), ".cpp": (CODE, COMMENT), ".h": (CODE, COMMENT), ".js": (CODE, COMMENT, STRING), ".ts": (CODE, COMMENT, STRING),
    ".go": (CODE, COMMENT, STRING), ".php": (CODE, OUTSIDE, COMMENT, STRING, TRIPLE), ".py": (CODE, STRING, TRIPLE), ".json": (CODE,), ".xml": (CODE, COMMENT, STRING, TRIPLE),
}
FIRST = {".php": OUTSIDE}
LANGUAGE = {".ts": "js", ".h": "cpp"}
_DIRECTIVE = re.compile(r"\s*#\s*(\w*)")
_DIRECTIVES = frozenset("include define undef if ifdef ifndef elif else endif error warning pragma line import include_next elifdef elifndef embed".split())
_CS_DIRECTIVES = frozenset("region endregion if elif else endif define undef nullable pragma error warning line".split())


def _taker(ext: str) -> Callable[[re.Match], str]:
    """What stands in the reduced alphabet for a comment, string, directive or stray character."""
    c_like, lines = ext in (".c", ".cpp", ".h"), ext in (".js", ".ts", ".go", ".py")

    def take(m: re.Match) -> str:
        g = m.group()
        a = g[0]
        if g.startswith("/*"):
            if len(g) < 4 or not g.endswith("*/"):
                return "\x02" + COMMENT
            return "\n" if lines and "\n" in g else " "
        if g.startswith("//") or a == "#" and ext in (".py", ".php") or g.startswith("#!"):
            return ""
        if g[:7] in ("<<<<<<<", ">>>>>>>", "|||||||", "=======") and len(g) >= 7 and not (ext == ".php" and g[3:4].isalpha()):
            return BAD
        if ext == ".php":
            if g.startswith("?>"):
                return ";\x02" + OUTSIDE if not g.endswith(("<?php", "<?=")) or len(g) < 5 else ";"
            if g.startswith("<<<"):
                return TEXT if "\n" in g and re.search(r"\w\Z", g) and len(g.split("\n")) > 1 and g.rsplit("\n", 1)[1].strip() == re.match(r"<<<[ \t]*[\"']?(\w+)", g)[1] else BAD
            if len(g) < 2 or g[-1] != a or (len(g) - len(g[:-1].rstrip("\\"))) % 2 == 0:
                return BAD if a == "`" or len(g) < 2 and a not in "\"'" else "\x02" + (STRING if a == '"' else TRIPLE)
            return TEXT
        stripped = g.lstrip()
        if stripped[:1] == "#":
            word = _DIRECTIVE.match(g)[1]
            if c_like:
                if word in ("if", "ifdef", "ifndef"):
                    return "\x03"
                return "\x04" if word == "endif" else "" if word in _DIRECTIVES or not word else BAD
            if word in ("region", "if"):
                return "\x03"
            return "\x04" if word in ("endregion", "endif") else "" if word in _CS_DIRECTIVES else BAD
        if ext == ".py" and (g.startswith('"""') or g.startswith("'''")):
            if len(g) < 6 or g[-3:] != g[:3] or (len(g[3:-3]) - len(g[3:-3].rstrip("\\"))) % 2:
                return "\x02" + (STRING if a == '"' else TRIPLE)
            return TEXT
        if '"""' in g[:4]:
            return TEXT if len(g) > 6 and g.endswith('"""') else "\x02" + (TRIPLE if ext == ".cs" else STRING)
        if a == "`" and ext in (".js", ".ts", ".go"):
            if len(g) < 2 or g[-1] != "`" or ext != ".go" and (len(g[1:-1]) - len(g[1:-1].rstrip("\\"))) % 2:
                return "\x02" + STRING
            return TEXT
        if g[0] in "@$" and ext == ".cs" and len(g) > 1 and "@" in g[:2]:
            return TEXT if g.endswith('"') and len(g) > 2 else "\x02" + STRING
        if a == "R" and ext in (".cpp", ".h"):
            return TEXT if g.endswith('"') and ")" in g else BAD
        if ext in (".js", ".ts") and stripped[:1] == "/" and len(g) > 1:
            return TEXT
        return TEXT if len(g) > 1 else BAD

    return take


_NUMBER = re.compile(r"(?<![\w$])(?:0[xX][0-9a-fA-F_']+|0[bB][01_']+|\d[\d_']*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[a-zA-Z]{0,3}(?![\w.])")
_SPACE = re.compile(r"(?<![\w\x00]) ++| ++(?![\w\x00])")


# Line ends that end no statement.
_GO_JOINT = re.compile(r"(?<=[,({\[=+\-*/%&|<>:.!^;])(?<!\+\+)(?<!--)\n")
_JS_JOINT = re.compile(r"\n(?=(?:catch|finally)\b)|(?<=[,(\[=*/%&|<>:?.!^{;])\n|(?<![+-])(?<=[+-])\n(?=.)|\n(?=[.?:=*/%&|<>^,)\]]|[+-](?![+-]))")


def _by_letter(words: list[str]) -> str:
    """One alternative per first letter, so that most words are told from keywords by their first character."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in heads.items())


class Lexer:
    def __init__(self, ext: str):
        self.ext, self.scan, self.take = ext, SCAN[ext], _taker(ext)
        words = "" if ext in (".py", ".json") else _by_letter(grammar(ext).keywords)
        dollar = "$" if ext in (".js", ".ts") else ""
        keep = rf"(?!(?:{words})(?![\w{dollar}]))" if words else ""
        # after a dot, keywords are member names
        self.word = re.compile(rf"(?<![\w{dollar}])(?:(?<=\.)|(?<=->)|{keep})[^\W\d][\w{dollar}]*" + (r"|\$[\w$]*" if dollar else ""))
        self.var = re.compile(r"\$+[^\W\d]\w*") if ext == ".php" else None
        self.lines = ext in (".js", ".ts", ".go")

    def reduced(self, text: str) -> tuple[str, str]:
        """(exit state, code in the reduced alphabet with brackets), entered in code."""
        out = self.scan.sub(self.take, text)
        state = CODE
        if "\x02" in out:
            out, _, rest = out.partition("\x02")
            state = next((s for s in (COMMENT, STRING, TRIPLE, OUTSIDE) if rest.startswith(s)), ERROR)
            if state in (STRING, TRIPLE):
                out += TEXT
            if rest[len(state):].strip():
                state = ERROR
        if self.var:
            out = self.var.sub("\x06", out)
        out = self.word.sub("i", out).replace("\x06", "v")
        out = _NUMBER.sub("0", out).replace(TEXT, "s")
        out = out.replace("\r", "").replace("\t", " ").replace("\f", " ").replace("\x00", BAD).replace("\ufeff", "")
        if self.lines:
            out = re.sub(r" *\n[ \n]*", "\n", out)
            out = (_GO_JOINT if self.ext == ".go" else _JS_JOINT).sub("", out)
        else:
            out = out.replace("\n", " ")
        out = _SPACE.sub("", out)
        out = re.sub(r"  +", " ", out)
        if self.ext in (".c", ".cpp", ".h", ".java", ".cs", ".php", ".go", ".js", ".ts"):
            out = _STRINGS.sub("s", out) if self.ext in (".c", ".cpp", ".h") else out
        if "0,0," in out:  # tables of numbers
            out = re.sub(r"(?:-?0,){2,}", "0,", out)
        return state, out


_LEXERS: dict[str, Lexer] = {}


def lexer(ext: str) -> Lexer:
    if ext not in _LEXERS:
        _LEXERS[ext] = Lexer(ext)
    return _LEXERS[ext]


#: Literals that have no lexer state, as they end at a word of their own or hold others of their kind.
_LABELLED = {".php": "<<<", ".cpp": 'R"', ".h": 'R"', ".js": "`", ".ts": "`"}
_SLASH = re.compile(r"\s*/(?![/*])")
_STRINGS = re.compile(r"\bs(?: s\b)+")


def _uncut(ext: str, text: str) -> list[tuple[int, int]]:
    """(begin, end) of the heredocs, raw strings or nested templates of text that run over lines."""
    mark = _LABELLED.get(ext)
    if not mark or mark not in text or mark == "`" and "${" not in text:
        return []
    first = RESUME["php:outside"].search(text) if ext == ".php" else None
    if ext == ".php" and not first:
        return []
    return [m.span() for m in SCAN[ext].finditer(text, first.end() if first else 0) if m.group().startswith(mark) and "\n" in m.group() and (mark != "`" or m.group().count("`") > 2)]


def cut(text: str, size: int = CHUNK_CHARS, ext: str = "") -> list[str]:
    """Runs of whole lines of about size characters; a longer line is a chunk of its own, and no heredoc, raw string or nested template is cut. Joined, they are text."""
    if len(text) <= size:
        return [text]
    if ext == ".xml":
        return _cut_xml(text, size)
    out, pos, spans = [], 0, _uncut(ext, text)
    k = 0
    while pos < len(text):
        end = text.rfind("\n", pos, pos + size) + 1 or text.find("\n", pos) + 1 or len(text)
        while end < len(text):
            while k < len(spans) and spans[k][1] <= end:
                k += 1
            if k < len(spans) and spans[k][0] < end:
                end = text.find("\n", spans[k][1]) + 1 or len(text)
            elif text[max(0, end - 3):end].endswith(("\\\n", "\\\r\n")):  # a continued line is one line
                end = text.find("\n", end) + 1 or len(text)
            elif ext in (".js", ".ts") and _SLASH.match(text, end):  # what a slash means depends on what is before it
                end = text.find("\n", end) + 1 or len(text)
            else:
                break
        out.append(text[pos:end])
        pos = end
    return out


def _cut_xml(text: str, size: int) -> list[str]:
    """Runs of about size characters that begin at a ``<``: no tag holds another one, and what comments and the like hold is for the entry state."""
    out, pos = [], 0
    least = m.end() if "<!DOCTYPE" in text and (m := _XML_DOCTYPE.search(text)) else 0  # its declarations stay with it
    while pos < len(text):
        end = text.find("<", max(pos + size, least, pos + 1))
        end = len(text) if end < 0 else end
        out.append(text[pos:end])
        pos = end
    return out


def _marks(code: str) -> tuple[str, str]:
    """(unmatched #endif and #if of a residue, the rest of it)."""
    k = len(code) - len(code.lstrip("\x03\x04"))
    return code[:k], code[k:]


def _cancel(marks: str) -> str:
    while "\x03\x04" in marks:
        marks = marks.replace("\x03\x04", "")
    return marks


def _entered(ext: str, text: str, state: str, first: bool = True) -> tuple[str, str]:
    """(exit state, residue) of a chunk entered in a state; first: whether it begins the file."""
    if ext == ".xml":
        return xml_residue(text, state, first)
    if state != CODE:
        m = RESUME[state if state == COMMENT else f"{LANGUAGE.get(ext, ext[1:])}:{state}"].search(text)
        if not m:
            return state, ""
        text = text[m.end():]
        if state == COMMENT and ext in (".js", ".ts", ".go"):
            text = "\n" + text
    if ext == ".json":
        return json_residue(text)
    if ext == ".py":
        return py_residue(text)
    out, code = lexer(ext).reduced(text)
    if BAD in code or out == ERROR:
        return ERROR, ""
    marks = ""
    if "\x03" in code or "\x04" in code:
        marks = _cancel(re.sub("[^\x03\x04]", "", code))
        code = code.replace("\x03", "").replace("\x04", "")
    code = grammar(ext).reduce(code)
    return (ERROR, "") if code is None else (out, marks + code)


def summary(ext: str, text: str, states: Iterable[str] | None = None) -> dict[str, tuple[str, str]]:
    """The lexer-state map of one chunk; with given states, that of the file's first chunk."""
    return {s: _entered(ext, text, s, states is not None) for s in (states or STATES[ext])}


def combine(ext: str, a: dict[str, tuple[str, str]], b: dict[str, tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """The map of two neighbouring chunks from theirs; associative."""
    out = {}
    for s, (mid, left) in a.items():
        if mid == ERROR or b.get(mid, (ERROR,))[0] == ERROR:
            out[s] = (ERROR, "")
            continue
        end, right = b[mid]
        if ext == ".py":
            out[s] = (end, left + right)
        elif ext == ".xml":
            total = xml_joined(left, right)
            out[s] = (ERROR, "") if total is None else (end, total)
        elif ext == ".json":
            total = json_reduce(left + right)
            out[s] = total if total[0] == ERROR else (end, total[1])
        else:
            (m, left), (n, right) = _marks(left), _marks(right)
            code = left + (" " if left[-1:].isalnum() and right[:1].isalnum() else "") + right
            if ext in (".js", ".ts", ".go"):
                code = (_GO_JOINT if ext == ".go" else _JS_JOINT).sub("", re.sub(r"\n[ \n]*", "\n", code))
            elif ext in (".c", ".cpp", ".h"):
                code = _STRINGS.sub("s", code)
            code = grammar(ext).reduce(code)
            out[s] = (ERROR, "") if code is None else (end, _cancel(m + n) + code)
    return out


def whole(ext: str, total: tuple[str, str]) -> bool:
    """Whether the reduced file is a program: no bracket left, no open string, and a sequence of top-level items."""
    state, code = total
    if ext == ".py":
        return state == CODE and (lines := py_lines(code)) is not None and py_whole(lines)
    if ext == ".json":
        return state == CODE and json_whole(code)
    if ext == ".xml":
        return state == CODE and xml_whole(code)
    if state not in (CODE, OUTSIDE) or LEFT.search(code) or "\x03" in code or "\x04" in code:
        return False
    return grammar(ext).sequence("T", code.strip(" "))


# ---------------------------------------------------------------- Python: logical lines decided one by one

_PY_WORD = re.compile(rf"(?<![\w])(?!(?:{_by_letter('False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case _'.split())})\b)[^\W\d]\w*")
_PY_PREFIX = re.compile(r"(?<!\w)(?:[rRuUbBfFtT]|[rR][bBfFtT]|[bBfFtT][rR])" + TEXT)
_PY_STATEMENT: dict[str, str] = {}
_PY_NUM = re.compile(r"(?<![\w.])(?:0[xX][0-9a-fA-F]+(?:_[0-9a-fA-F]+)*|0[oO][0-7]+|0[bB][01]+|(?:0|[1-9]\d*(?:_\d+)*)(?![\d.eEjJ_])|(?:\d+(?:_\d+)*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[jJ]?)(?![\w.])")
_PY_HEAD = re.compile(r"(?:async )?(if|elif|else|for|while|try|except|finally|with|def|class|match|case)\b")
_PY_CLAUSES = frozenset("if elif else for while try except finally with def class".split())
_PY_AFTER = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except"), "except": ("try", "except"), "finally": ("try", "except", "else")}


def _py_kind(form: str) -> str:
    """'' if the logical line is no statement, else 's' or the word that opens its block ('head:word')."""
    m = _PY_HEAD.match(form)
    word = m[1] if m else ""
    body = form
    if word and form.endswith(":"):
        body += " pass"
        body = {"elif": "if 0: pass\n", "else": "if 0: pass\n", "except": "try: pass\n", "finally": "try: pass\n", "case": "match i:\n "}.get(word, "") + body
        if word == "match":
            body = form + "\n case _: pass"
        if word == "try":
            body += "\nfinally: pass"
    elif word in ("elif", "else", "except", "finally") and ":" in form:
        body = {"elif": "if 0: pass\n", "else": "if 0: pass\n", "except": "try: pass\n", "finally": "try: pass\n"}[word] + body
    elif word == "try":
        body += "\nfinally: pass"
    elif form.startswith("@"):
        body += "\ndef i(): pass"
    wrapped = "async def i():\n for i in i:\n  " + body.replace("\n", "\n  ") + "\n"
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(wrapped)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return ""
    return f"h{word}" if word and form.endswith(":") else "d" if form.startswith("@") else f"o{word}" if word in _PY_CLAUSES else "s"


def py_residue(text: str) -> tuple[str, str]:
    """(exit state, the lines in the reduced alphabet) of a chunk entered in code."""
    if "\x00" in text:
        return ERROR, ""
    taken = lexer(".py").scan.sub(lexer(".py").take, text.replace("\r\n", "\n").removeprefix("\ufeff"))
    state = CODE
    if "\x02" in taken:
        taken, _, rest = taken.partition("\x02")
        state = rest if rest in (STRING, TRIPLE) else ERROR
        taken += TEXT
    if BAD in taken or state == ERROR:
        return ERROR, ""
    taken = _PY_WORD.sub("i", _PY_PREFIX.sub(TEXT, taken)).replace(TEXT, "''").replace("\\\n", " ")
    taken = _PY_NUM.sub(lambda m: "0" if not (g := m.group()).isdigit() or g[0] != "0" or not g.strip("0") else g, taken)
    return state, re.sub(r"(?:-?0,[ ]?){2,}", "0,", taken) if "0," in taken else taken


def py_lines(taken: str) -> list[tuple[int, str]] | None:
    """[(indentation, form of the logical line)]; None: brackets do not pair."""
    if "\f" in taken:
        taken = re.sub(r"(?m)^\f", "", taken)
    lines: list[tuple[int, str]] = []
    depth, held, indent = 0, "", 0
    for raw in taken.split("\n"):
        body = raw.strip()
        if not body:
            continue
        if depth == 0:
            indent, held = len(raw) - len(raw.lstrip(" \t")), body
            if "\t" in raw[:indent]:
                indent = len(raw[:indent].expandtabs(8))
        else:
            held += " " + body
        for c in LEFT.findall(body):
            depth += 1 if c in "([{" else -1
        if depth < 0:
            return None
        if depth == 0:
            lines.append((indent, held))
            held = ""
    return None if depth else lines




def py_whole(lines: list[tuple[int, str]]) -> bool:
    """Whether the logical lines form a program: each a statement, indentation and clauses in order."""
    stack, opened, last = [0], "", {0: ""}
    for indent, form in lines:
        kind = _PY_STATEMENT.get(form)
        if kind is None:
            if len(_PY_STATEMENT) > MEMO_LIMIT:
                _PY_STATEMENT.clear()
            kind = _PY_STATEMENT[form] = _py_kind(form)
        if not kind:
            return False
        if opened:
            if indent <= stack[-1]:
                return False
            stack.append(indent)
            last[indent] = ""
        elif indent != stack[-1]:
            if indent > stack[-1]:
                return False
            while stack and stack[-1] > indent:
                last.pop(stack.pop(), None)
            if not stack or stack[-1] != indent:
                return False
        word = kind[1:] if kind[0] in "ho" else ""
        if word in _PY_AFTER and last[indent] not in _PY_AFTER[word]:
            return False
        if last.get(indent) == "try" and word not in ("except", "finally") or last.get(indent) == "@" and word not in ("def", "class", "") or last.get(indent) == "@" and kind == "s":
            return False
        last[indent] = "@" if kind == "d" else word if word else ""
        opened = word if kind[0] == "h" else ""
    return not opened and last.get(stack[-1]) != "@" and not any(v == "try" for v in last.values())


# ---------------------------------------------------------------- JSON and XML: groups and elements

_JSON_VALUE = r"(?:s|0|L|[\ue000\ue001])"
_JSON_GROUP = re.compile(r"\{[^{}\[\]]*\}|\[[^{}\[\]]*\]")
_JSON_OK = re.compile(rf"\{{(?:s:{_JSON_VALUE}(?:,s:{_JSON_VALUE})*)?\}}|\[(?:{_JSON_VALUE}(?:,{_JSON_VALUE})*)?\]")
_JSON_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|\b(?:true|false|null)\b")
_JSON_REPEAT = re.compile(rf"(?<=[\[,])({_JSON_VALUE})(?:,\1)+(?=[,\]])|(?<=[{{,])(s:{_JSON_VALUE})(?:,\2)+(?=[,}}])")


def json_residue(text: str) -> tuple[str, str]:
    out = SCAN[".json"].sub(lambda m: "s" if len(m.group()) > 1 else BAD, text)
    if BAD in out:
        return ERROR, ""
    out = _JSON_ATOM.sub(lambda m: "L" if m.group()[0] in "tfn" else "0", out)
    return json_reduce(re.sub(r"[ \t\r\n]+", "", out))


def json_reduce(code: str) -> tuple[str, str]:
    bad = []

    def one(m: re.Match) -> str:
        if not _JSON_OK.fullmatch(m.group()):
            bad.append(1)
        return "\ue000"

    n = 1
    while n and not bad:
        code = _JSON_REPEAT.sub(lambda m: m[1] or m[2], code)
        code, n = _JSON_GROUP.subn(one, code)
    return (ERROR, "") if bad else (CODE, code)


def json_whole(code: str) -> bool:
    return bool(re.fullmatch(_JSON_VALUE, code))


_XML_NAME = r"[^\W\d][\w.:-]*"
_XML_ATTRIBUTE = rf"\s+({_XML_NAME})\s*=\s*(?:\"[^<\"]*\"|'[^<']*')"
_XML_TOKEN = re.compile(
    rf"<!--(?:[^-]|-(?!-))*(?:-->|\Z)|<!\[CDATA\[[\s\S]*?(?:\]\]>|\Z)|<\?[\s\S]*?(?:\?>|\Z)|<!DOCTYPE[^>\[]*(?:\[[^\]]*\]\s*)?>|<(/?)({_XML_NAME})((?:{_XML_ATTRIBUTE.replace('(' + _XML_NAME + ')', _XML_NAME)})*)\s*(/?)>|[<]|[^<]+")
_XML_DOCTYPE = re.compile(r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\]\s*)?>")
_XML_RESUME = {COMMENT: re.compile(r"(?:[^-]|-(?!-))*(?:-->|\Z)"), STRING: re.compile(r"[\s\S]*?(?:\]\]>|\Z)"), TRIPLE: re.compile(r"[\s\S]*?(?:\?>|\Z)")}
_XML_ENDS = {COMMENT: "-->", STRING: "]]>", TRIPLE: "?>"}
_XML_AMP = re.compile(r"&(?!(?:#\d+|#x[0-9a-fA-F]+|[^\W\d][\w.-]*);)")


def xml_residue(text: str, state: str = CODE, first: bool = True) -> tuple[str, str]:
    """(exit state, residue) of a run of tags and texts, with element names as brackets: the names of unmatched ends and starts, and between
    them the number of elements (2 stands for more) and whether there is text, which only counts if that level turns out to be the outermost."""
    ends: list[str] = []
    starts: list[str] = []
    elements, loose, pos = 0, False, 0
    if state != CODE:
        m = _XML_RESUME[state].match(text)
        if not m:
            return ERROR, ""
        if not m.group().endswith(_XML_ENDS[state]):
            return state, xml_packed([], 0, False, [])
        pos, state, loose = m.end(), CODE, state == STRING
    for m in _XML_TOKEN.finditer(text, pos):
        g = m.group()
        name = m[2]
        if name:
            attributes = m[3]
            if attributes and (_XML_AMP.search(attributes) or len(found := re.findall(_XML_ATTRIBUTE, attributes)) != len(set(found))):
                return ERROR, ""
            if m[1]:
                if attributes or m[4]:
                    return ERROR, ""
                if starts:
                    if starts.pop() != name:
                        return ERROR, ""
                    elements += not starts
                else:
                    ends.append(name)
                    elements, loose = 0, False
            elif m[4]:
                elements += not starts
            else:
                starts.append(name)
        elif g[0] != "<":
            if _XML_AMP.search(g) or "]]>" in g:
                return ERROR, ""
            loose |= not starts and bool(g.strip().strip("\ufeff"))
        elif len(g) == 1 or re.match(r"<\?xml\s", g) and not (first and not text[: m.start()].strip("\ufeff")):
            return ERROR, ""
        else:
            kind = COMMENT if g.startswith("<!--") else STRING if g.startswith("<![") else TRIPLE if g.startswith("<?") else ""
            loose |= kind == STRING and not starts
            if kind and (not g.endswith(_XML_ENDS[kind]) or len(g) < {COMMENT: 7, STRING: 12, TRIPLE: 4}[kind]):
                state = kind
    return state, xml_packed(ends, elements, loose, starts)


def xml_packed(ends: list[str], elements: int, loose: bool, starts: list[str]) -> str:
    return "\n".join((" ".join(ends), f"{min(2, elements)}{'t' if loose else ''}", " ".join(starts)))


def xml_joined(a: str, b: str) -> str | None:
    """The residue of two neighbours; None: an element ends that did not begin."""
    (ends, level, starts), (more_ends, more_level, more_starts) = ([x.split(" ") if x and k != 1 else x for k, x in enumerate(r.split("\n"))] for r in (a, b))
    ends, starts, more_ends, more_starts = (x or [] for x in (ends, starts, more_ends, more_starts))
    closed = min(len(starts), len(more_ends))
    if starts[len(starts) - closed:][::-1] != more_ends[:closed]:
        return None
    elements, loose = int(level[0]), "t" in level
    if len(more_ends) > closed:  # what stood between is inside an element that ends here
        ends, elements, loose = ends + more_ends[closed:], int(more_level[0]), "t" in more_level
    elif closed == len(starts):
        elements, loose = elements + (closed > 0) + int(more_level[0]), loose or "t" in more_level
    return xml_packed(ends, elements, loose, starts[: len(starts) - closed] + more_starts)


def xml_whole(code: str) -> bool:
    """One element, nothing but white space and comments around it."""
    return code == "\n1\n"


def parses(ext: str, text: str, chunk: int | None = CHUNK_CHARS) -> bool:
    """Whether text as a whole parses in the language of ext, by chunk maps reduced pairwise; in one piece where chunk is None."""
    parts = cut(text, chunk or len(text), ext)
    start = FIRST.get(ext, CODE)
    if len(parts) == 1:
        return whole(ext, _entered(ext, text, start))
    maps = [summary(ext, parts[0], [start])] + [summary(ext, p) for p in parts[1:]]
    while len(maps) > 1:
        maps = [combine(ext, *maps[k:k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    return whole(ext, maps[0][start])
