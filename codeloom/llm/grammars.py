"""Local grammars of the brace languages over *reduced* code.

A lexer (``lexmap``) turns code into a short alphabet: ``i`` an identifier, ``0`` a number, ``s`` a string, keywords as they
are, operators as they are.  Then every innermost bracket group is replaced by one private-use character that stands for the
set of things the group can be (argument list, parameter list, block, object, ...).  What is left of a statement holds no
bracket at all, hence is a regular language, and one compiled expression per statement kind decides it.  Because programs
repeat their statement forms endlessly, each form is decided once per worker and looked up afterwards.
"""

from __future__ import annotations

import re

import regex

PAREN = {"A": 1, "E": 2, "P": 4, "F": 8, "Q": 16, "T": 32}
BRACE = {"B": 1, "O": 2, "K": 4, "S": 8, "U": 16, "N": 32, "X": 64}
SQUARE = {"I": 1, "D": 2, "Z": 4}
BASE = {"(": 0xE000, "{": 0xE400, "[": 0xE800}
KINDS = {"(": PAREN, "{": BRACE, "[": SQUARE}
MEMO_LIMIT = 200_000


def _charset(base: int, bit: int, size: int) -> str:
    return "[" + "".join(chr(base + m) for m in range(size) if m & bit) + "]"


_SETS = {f"«{k}»": f"(?&{k})" for kinds in KINDS.values() for k in kinds}
_RULES = {k: _charset(BASE[b], bit, 64 if b == "(" else 128 if b == "{" else 8) for b, kinds in KINDS.items() for k, bit in kinds.items()}


def rx(template: str, **parts: str) -> str:
    for k, v in parts.items():
        template = template.replace(f"«{k}»", v)
    for k, v in _SETS.items():
        template = template.replace(k, v)
    return template


class Rules(dict):
    """Named rules: each is written once and called by name, so the compiled expressions stay small."""

    def __call__(self, name: str, pattern: str) -> str:
        self[name] = pattern
        return f"(?&{name})"


class Grammar:
    """kinds: bracket -> {kind: list-of-items expression or None}; statement kinds are matched one after the other."""

    def __init__(self, rules: Rules, keywords: str, blocks: dict[str, str], groups: dict[str, dict[str, str]], newlines: bool = False, no_object: str = ";", no_members: str = ""):
        self.keywords, self.newlines = keywords.split(), newlines
        #: kind -> (expression of one item, expression of what may stand before the closing bracket without terminator)
        head = "(?(DEFINE)" + "".join(f"(?<{k}>{rx(v)})" for k, v in (_RULES | rules).items()) + ")"
        build = lambda x: regex.compile(head + f"(?:{rx(x)})", regex.V1 | regex.S)
        self.blocks = {k: build(item) for k, item in blocks.items()}
        self.groups = {b: {k: build(x) for k, x in kinds.items()} for b, kinds in groups.items()}
        #: statements that end where they seem to end are looked up by their form; others are matched in place
        self.piece = [re.compile(x) for x in ([r"[^;\n]*(?:[;\n]|\Z)"] if newlines else [r"[^;\ue400-\ue7ff]*(?:;|[\ue400-\ue7ff](?=(?!catch|finally|while)[\w@~]|\Z))", r"[^;]*;"])]
        #: what tells at a glance that a block is no object or initializer, and no list of members (where keywords are no names)
        self.no_object, self.no_members = no_object and re.compile(no_object), no_members and re.compile(no_members)
        self.pieces: dict[str, dict[str, bool]] = {k: {} for k in blocks}
        self.memo: dict[str, str] = {}

    def sequence(self, kind: str, text: str) -> bool:
        """Whether text is a sequence of the items of this kind of block."""
        rule, known, pos, n = self.blocks[kind], self.pieces[kind], 0, len(text)
        while pos < n:
            for piece in self.piece:
                if (m := piece.match(text, pos)) and m.end() > pos:
                    if (ok := known.get(form := m.group())) is None:
                        if len(known) > MEMO_LIMIT:
                            known.clear()
                        ok = known[form] = bool(rule.fullmatch(form) or form[-1:] == "\n" and rule.fullmatch(form[:-1]))
                    if ok:
                        break
            else:
                m = rule.match(text, pos)
                if not m or m.end() == pos:
                    return False
            pos = m.end()
        return True

    def symbol(self, group: str) -> str:
        """The character for a bracket group whose inner groups are characters already; empty if it can be nothing."""
        opening, body = group[0], group[1:-1]
        if {"(": ")", "[": "]", "{": "}"}[opening] != group[-1]:
            return ""
        if opening != "{" or not self.newlines:
            body = body.replace("\n", "")
        mask, never = 0, ""
        if opening == "{":
            never = ("O" if self.no_object and self.no_object.search(body) else "") + ("KUX" if self.no_members and self.no_members.search(body) else "")
        for kind, bit in KINDS[opening].items():
            if kind in never:
                continue
            flat = self.groups[opening].get(kind)
            if flat and flat.fullmatch(body.replace("\n", "") if kind in "ON" else body) or opening == "{" and kind in self.blocks and self.sequence(kind, body):
                mask |= bit
        return chr(BASE[opening] + mask) if mask else ""

    def reduce(self, text: str) -> str | None:
        """All balanced groups of text as characters; unmatched brackets stay. None: a group fits no rule."""
        memo, bad = self.memo, []

        def one(m: re.Match) -> str:
            g = m.group()
            if (c := memo.get(g)) is None:
                if len(memo) > MEMO_LIMIT:
                    memo.clear()
                c = memo[g] = self.symbol(g)
            if not c:
                bad.append(g)
            return c

        n = 1
        while n and not bad:
            text, n = GROUP.subn(one, text)
        self.last_bad = bad[:1]
        return None if bad else text


GROUP = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
LEFT = re.compile(r"[()\[\]{}]")

# Between a type and a name; no space is left behind a sign.
_GAP = r"(?: |(?<=[>.?*\]\ue800-\uefff]))"

# Operators shared by most of the languages.
_ASSIGN = r"(?:[-+*/%&|^.]|\*\*|<<|>>>?|&&|\|\||\?\?)?="
_BINARY = r"(?:===?|!==?|<=>|<=|>=|&&|\|\||\?\?|<<|>>>?|[-+*/%&|^<>])"


#: A call of a member as a statement, which no list of members holds.
_CALL = r"(?:^|[;\ue400-\ue7ff])i(?:(?:\.|->)i)+[\ue000-\ue03f];"


def _java() -> Grammar:
    rule = Rules()
    gen = rule("gen", r"(?:<[i,.?<>&\[\] ]*(?:(?:extends|super) [i,.?<>&]*)*>)?")
    typ = rule("typ", rx(rf"i{gen}(?:\.i{gen})*(?:«D»)*(?:\.\.\.)?"))
    one_ann = rule("one_ann", r"@i(?:\.i)*«A»? ?")
    ann = rule("ann", rf"{one_ann}*")
    mod = rf"(?:(?:public|private|protected|static|final|abstract|synchronized|native|transient|volatile|default|strictfp|sealed|non-sealed)(?: |(?=[<@]))|{one_ann})*"
    un = rule("un", rx(r"(?:\+\+|--|[-+!~]|(?:i|«P»)->|«E»(?=[i0s\ue000-\uefff!~(]|new|switch))*", E="«E»"))
    atom = rule("atom", rx(rf"(?:new {typ}(?:«A»«K»?|«I»+|«O»)|i{gen}|[0s]|«E»|«O»|switch«E»«S»|i(?:«D»)*(?:\.class)|class)"))
    post = rule("post", rx(r"(?:\.(?:new )?(?:<[i,.]*>)?(?:i|class)|«A»|«I»|\+\+|--|::(?:i|new))*"))
    one = rule("one", rf"{un}(?:{atom}{post}|(?<=->){_SETS['«B»']})")
    low = rule("low", rf"{one}(?:(?:{_BINARY}|{_ASSIGN}| instanceof (?:final )?){one}(?:(?<=i) i)?)*")
    ex = rule("ex", rf"{low}(?:\?{low}:{low})*")
    do = rule("do", rx(rf"(?:(?:{un}{atom}{post}){_ASSIGN}{ex}|(?:\+\+|--){one}|{one}(?:(?<=[\ue000-\ue3ff])|(?<=\+\+)|(?<=--)))"))
    decl = rule("decl", rf"{typ}{_GAP}i(?:{_SETS['«D»']})*(?:={ex})?(?:,i(?:={ex})?)*")
    kinds = rule("kinds", rf"{mod}(?:(?:class|interface|enum|record|@interface) i{gen}{_SETS['«P»']}?(?:(?: |(?<=[>\ue000-\ue3ff]))extends {typ}(?:,{typ})*)?(?:(?: |(?<=[>\ue000-\ue3ff]))implements {typ}(?:,{typ})*)?(?:(?: |(?<=[>\ue000-\ue3ff]))permits {typ}(?:,{typ})*)?)")
    case = rf"(?:case {ex}(?:,{ex})*|default)(?::|->)"
    stmt = rule("stmt", rx(rf"(?:if«E»|while«E»|for«F»|else ?|do ?|i:)*(?:;|«B»|(?:final |{one_ann})*{decl};|{do};|return(?: ?{ex})?;|throw ?{ex};|(?:break|continue|yield)(?: i)?;|yield ?{ex};|do«B»while«E»;|while«E»;|switch«E»«S»|try«A»?«B»(?:catch«P»«B»)*(?:finally«B»)?|synchronized«E»«B»|assert ?{ex}(?::{ex})?;|{kinds}(?:«K»|«U»))"))
    member = rule("member", rx(rf"(?:;|(?:static)?«B»|{mod}(?:<[i,.?<>&]*(?:(?: |(?<=[>\ue000-\ue3ff]))extends [i<>.&]*)?> ?)?(?:{typ}{_GAP})?i«P»(?:«D»)*(?:throws i(?:\.i)*(?:,i(?:\.i)*)*)?(?:default ?{ex})?(?:«B»|;)|{mod}i«B»|{mod}{decl};|{kinds}(?:«K»|«U»))"))
    top = rx(rf"(?:;|{ann}package i(?:\.i)*;|import (?:static )?i(?:\.i)*(?:\.\*)?;|{kinds}(?:«K»|«U»))")
    param = rule("param", rf"(?:(?:final |{one_ann})*{typ}{_GAP}(?:i|this)(?:{_SETS['«D»']})*|i(?:\|i)*(?: i)?)")
    return Grammar(rule, 
        r"public private protected static final abstract synchronized native transient volatile default strictfp sealed(?=\s+\w) non-sealed class interface enum record(?=\s+\w+\s*[(<]) extends implements permits(?=\s+\w) new return if else while for do switch case break continue try catch finally throw throws import package instanceof assert super",
        {"B": stmt, "K": member, "S": rf"(?:{case}|{stmt}|{ex};)", "U": rx(rf"(?:{ann}i«A»?«K»?(?:,|;|\Z)|{member})"), "T": top},
        {"(": {"A": rf"(?:{ex}(?:,{ex})*)?|(?:(?:final )?{typ}{_GAP}i={ex};?)+", "E": rf"{ex}|{typ}(?:&{typ})*", "P": rf"(?:{param}(?:,{param})*)?", "F": rf"(?:{decl}|{ex}(?:,{ex})*)?;(?:{ex})?;(?:{ex}(?:,{ex})*)?|(?:final )?{typ}{_GAP}i:{ex}"},
         "{": {"O": rx(rf"(?:(?:«O»|{ex})(?:,(?:«O»|{ex}))*,?)?")}, "[": {"I": ex, "D": ""}}, no_members=_CALL + r"|\b(?:return|if|else|for|while|do|break|continue)\b")


def _cs() -> Grammar:
    rule = Rules()
    gen = rule("gen", r"(?:<[i,.?<>\[\] ]*>)?")
    typ = rule("typ", rx(rf"(?:i(?:::i)?{gen}(?:\.i{gen})*|«T»)\??(?:«D»\??|\*)*"))
    att = rule("att", rx(r"(?:«I»|«Z»)*"))
    mod = rf"{att}(?:(?:public|private|protected|internal|static|readonly|const|sealed|abstract|virtual|override|async|partial|unsafe|extern|new|required|volatile|ref|file) )*"
    un = rule("un", rx(r"(?:\+\+|--|[-+!~&*^]|await |(?:async )?(?:i|«P»)=>|«E»(?=[i0s\ue000-\uefff!~]|new|await)|ref |out |throw )*"))
    atom = rule("atom", rx(rf"(?:new ?(?:{typ})?(?:«A»|«I»)?(?:«O»|«I»)?|i(?:::i)?{gen}|[0s]|«E»|«A»|«I»|(?:typeof|sizeof|nameof|default|checked)«A»|default|base|stackalloc {typ}|delegate«P»?«B»)"))
    post = rule("post", rx(rf"(?:(?:\?|!)?(?:\.|->)i{gen}|\??«I»|«A»|\+\+|--|!(?!=)|switch«O»|(?<=i) with«O»)*"))
    one = rule("one", rf"{un}(?:{atom}{post}|(?<==>){_SETS['«B»']})")
    low = rule("low", rf"{one}(?:(?:{_BINARY}|{_ASSIGN}| is (?:not )?| as | and | or ){one}(?:(?<=[i\]?]) i)?)*")
    query = rule("query", rf"i (?:{typ}{_GAP})?i in {low}(?: i(?: i=| i in)? ?{low})+")
    ex = rule("ex", rf"(?:{low}(?:\?{low}:{low})*|{query})")
    do = rule("do", rx(rf"(?:(?:{un}{atom}{post}){_ASSIGN}{ex}|(?:\+\+|--){one}|{one}(?:(?<=[\ue000-\ue3ff])|(?<=\+\+)|(?<=--)|(?<=!)))"))
    decl = rule("decl", rf"{typ}{_GAP}i(?:={ex})?(?:,i(?:={ex})?)*")
    where = rule("where", rf"(?: ?where i:(?:{typ}|new«A»|class|struct|notnull)(?:,(?:{typ}|new«A»|class|struct))*)*")
    kinds = rule("kinds", rx(rf"{mod}(?:(?:class|interface|struct|record(?: struct| class)?) i{gen}«P»?(?::{typ}«A»?(?:,{typ})*)?{where}(?:«K»;?|;)|enum i(?::i)?«U»;?|delegate {typ}{_GAP}i{gen}«P»;)"))
    stmt = rule("stmt", rx(rf"(?:if«E»|while«E»|for«F»|foreach«F»|await foreach«F»|else ?|do ?|using«A»|lock«E»|fixed«A»|i:)*(?:;|«B»|(?:const |using |await using |ref )?{decl};|{ex};|return ?(?:{ex})?;|throw ?(?:{ex})?;|(?:break|continue);|goto [i0s];|yield (?:return {ex}|break);|do«B»while«E»;|while«E»;|switch«E»«S»|try«B»(?:catch«P»?(?:when«E»)?«B»)*(?:finally«B»)?|(?:checked|unchecked|unsafe)«B»|(?:static |async )*{typ}{_GAP}i{gen}«P»(?:«B»|=>{ex};))"))
    member = rule("member", rx(rf"(?:;|{mod}(?:event )?{decl};|{mod}(?:{typ}{_GAP})?~?i(?:\.i)*{gen}«P»(?::(?:this|base)«A»|:i«A»)?{where}(?:«B»|;|=>{ex};)|{mod}{typ}{_GAP}(?:i(?:\.i)*|this«D»|this«I»|i«Z»)(?:«K»(?:={ex};)?|«B»(?:={ex};)?|=>{ex};)|{mod}(?:get|set|init|add|remove)(?:«B»|;|=>{ex};)|{mod}(?:{typ}{_GAP})?operator ?(?:[-+*/%&|^<>!~=]+|i|true|false)«P»(?:«B»|;|=>{ex};)|{mod}(?:implicit|explicit) operator {typ}«P»(?:«B»|=>{ex};)|{kinds})"))
    top = rule("top", rx(rf"(?:;|(?:global )?using (?:static )?(?:i=)?{typ};|extern i i;|namespace i(?:\.i)*(?:«X»;?|;)|«I»|«Z»|{kinds})"))
    prog = rx(rf"(?:{top}|{stmt})")
    param = rule("param", rf"{att}(?:(?:ref|out|in|this|params|scoped) )*{typ}(?:{_GAP}i)?(?:={ex})?")
    return Grammar(rule, 
        r"public private protected internal static readonly const sealed abstract virtual override async(?=\s+\w|\s*\() partial(?=\s+\w) unsafe extern new required(?=\s+\w) volatile ref out in is as class interface struct record(?=\s+(?:struct|class|\w+\s*[(<{:;])) enum delegate event operator implicit explicit return if else while for foreach do switch case default break continue goto try catch finally throw using namespace lock fixed yield(?=\s+(?:return|break)) await(?=\s+[\w(]) typeof sizeof nameof(?=\s*\() checked unchecked stackalloc get(?=\s*(?:[;{]|=>)) set(?=\s*(?:[;{]|=>)) init(?=\s*(?:[;{]|=>)) add(?=\s*\{) remove(?=\s*\{) params(?=\s+\w) base where(?=\s+\w+\s*:) when(?=\s*\() with(?=\s*\{)",
        {"B": stmt, "K": member, "X": top, "S": rf"(?:(?:case {ex}(?:when {ex})?|default):|{stmt})", "T": prog},
        {"(": {"A": rf"(?:(?:i:)?(?:(?:ref|out|in) )?(?:{typ}{_GAP}i(?:={ex})?|{ex})(?:,(?:i:)?(?:(?:ref|out|in) )?(?:{typ}{_GAP}i|{ex}))*)?", "E": rf"{ex}|{typ}", "P": rf"(?:{param}(?:,{param})*)?|i(?:,i)*", "F": rf"(?:{decl}|{ex}(?:,{ex})*)?;(?:{ex})?;(?:{ex}(?:,{ex})*)?|(?:{typ}|var){_GAP}(?:i|{_SETS['«A»']}) ?in ?{ex}", "T": rf"{typ}(?:{_GAP}i)?(?:,{typ}(?:{_GAP}i)?)+"},
         "{": {"O": rx(rf"(?:(?:«O»|(?:i|«I»)=«O»|{ex}(?:=>{ex})?)(?:,(?:«O»|(?:i|«I»)=«O»|{ex}(?:=>{ex})?))*,?)?"), "U": rx(rf"(?:{att}i(?:={ex})?(?:,{att}i(?:={ex})?)*,?)?")},
         "[": {"I": rf"(?:{ex}(?:\.\.(?:{ex})?)?|\.\.(?:{ex})?)(?:,{ex})*,?", "D": r",*", "Z": rf"(?:i:)?.*|{param}"}}, no_members=_CALL + r"|\b(?:return|if|else|for|while|do|break|continue|foreach|goto)\b")


def _c(cpp: bool) -> Grammar:
    rule = Rules()
    gen = rule("gen", r"(?:<(?:[i0s,.:*&<>=\[\] \ue000-\uefff]|const|unsigned|signed|long|short|int|char|float|double|void|bool|auto|typename|struct|class)*>)?") if cpp else ""
    name = rf"(?:::)?i{gen}(?:::~?i{gen})*" if cpp else "i"
    cv = r"(?:(?:const|volatile|static|inline|extern|register|restrict|constexpr|mutable|virtual|explicit|friend|thread_local|typename|_Atomic|consteval|constinit) ?)*" if cpp else r"(?:(?:const|volatile|static|inline|extern|register|restrict|_Noreturn|_Atomic|_Thread_local) ?)*"
    word = r"(?:(?:unsigned|signed|long|short|int|char|float|double|void|bool|auto)(?: (?:unsigned|signed|long|short|int|char|float|double))*|(?:struct|union|enum|class) i" if cpp else r"(?:(?:unsigned|signed|long|short|int|char|float|double|void|_Bool)(?: (?:unsigned|signed|long|short|int|char|float|double))*|(?:struct|union|enum) i"
    typ = rule("typ", rx(rf"{cv}{word}|{name}|(?:decltype|typeof|alignas)«A»)(?: const)?(?: volatile)?"))
    ptr = rule("ptr", r"(?:\*(?:const ?|restrict ?|volatile ?)*|&&?(?:const ?)?)*" if cpp else r"(?:\*(?:const ?|restrict ?|volatile ?)*)*")
    sp = r" ?"
    un = rule("un", rx(rf"(?:\+\+|--|[-+!~&*]|sizeof ?|«E»(?=[i0s\ue000-\uefff!~&*-])" + (r"|new ?|delete ?(?:«D»)?|throw ?|co_await |«Z»«P»?(?:mutable)?(?:->i)?(?=[\ue400-\ue7ff])" if cpp else "") + ")*"))
    atom = rule("atom", rx(rf"(?:{name}|[0s]+|«E»|«A»|«O»" + (rf"|(?:static_cast|dynamic_cast|const_cast|reinterpret_cast)<[^;]*?>«A»|{typ}{ptr}(?:«A»|«O»|«I»)|nullptr|this|«B»|operator[-+*/=<>!&|^%]+" if cpp else rf"|«E»«O»|{typ}{ptr}") + ")"))
    post = rule("post", rx(r"(?:(?:\.|->)(?:template )?~?i" + (gen if cpp else "") + r"|«A»|«I»|\+\+|--" + ("|«O»|\\.\\.\\." if cpp else "") + ")*"))
    one = rule("one", rf"{un}{atom}{post}")
    low = rule("low", rf"{one}(?:(?:{_BINARY}|{_ASSIGN}){one})*")
    ex = rule("ex", rf"{low}(?:\?{low}?:{low})*")
    init = rule("init", rx(rf"(?:={ex}" + (r"|«A»|«O»" if cpp else "") + ")?"))
    dtor = rule("dtor", rx(rf"{ptr}{sp}(?:{name}|«E»(?=[\ue000-\ue3ff])«P»" + (r"|«I»|«Z»" if cpp else "") + rf")(?:«I»|«D»)*(?::{ex})?{init}"))
    att = rule("att", rx(r"(?:__attribute__«A»|«Z»)*" if cpp else r"(?:__attribute__«A»)*"))
    decl = rule("decl", rf"{att}{typ}{sp}{dtor}(?:,{dtor})*{att}")
    agg = rule("agg", rx(rf"(?:struct|union" + ("|class" if cpp else "") + rf")(?: i{gen}(?: final)?(?::(?:(?:public|private|protected|virtual) ?)*{name}(?:,(?:(?:public|private|protected|virtual) ?)*{name})*)?)?" .replace("{gen}", gen) + r"«K»"))
    enum = rule("enum", rx(r"enum(?: class| struct)?(?: i)?(?::i)?«U»"))
    tail = rule("tail", rx(rf"(?:{sp}{dtor}(?:,{dtor})*)?;"))
    tdef = rule("tdef", rx(rf"typedef ?(?:{cv}(?:{agg}|{enum})(?:{sp}{ptr}i(?:,{ptr}i)*)?|{typ}{sp}{ptr}{sp}(?:i(?:«I»|«D»)*|«E»«P»|i«P»));"))
    common = rule("common", rx(rf"(?:{cv}(?:{agg}|{enum}){tail}|{tdef}|_Static_assert«A»;|static_assert«A»;)"))
    stmt = rule("stmt", rx(rf"(?:if(?: constexpr)?«E»|if«F»|while«E»|for«F»|switch«E»(?=«B»)|else ?|do ?|i:(?!:)|case {ex}:|default:)*(?:;|«B»|{decl};|{ex}(?:,{ex})*;|return ?(?:{ex}|«O»)?;|break;|continue;|goto i;|do«B»while«E»;|while«E»;|{common}" + (rf"|try«B»(?:catch«P»«B»|catch«E»«B»)+|throw ?(?:{ex})?;|using (?:namespace )?{name}(?:={typ}{ptr})?;|delete ?(?:«D»)?{ex};|co_return ?(?:{ex})?;" if cpp else "") + ")"))
    fn = rule("fn", rx(rf"{att}{typ}{sp}{ptr}{sp}{name}«P»{att}" + (rf"(?:const ?|noexcept«A»? ?|override ?|final ?|volatile ?|&&? ?)*(?:->{typ}{ptr})?(?::{name}(?:«A»|«O»)(?:,{name}(?:«A»|«O»))*)?(?:=(?:default|delete|0);|try ?)?" if cpp else "") + r"(?:«B»|;|(?<=;))"))
    items = rf"(?:;|{common}|{decl};|{fn}"
    if cpp:
        temp = rule("temp", r"template<[^;{}]*?> ?(?:requires ?[^;{}]*? )?")
        ctor = rx(rf"{cv}~?{name}«P»(?:const ?|noexcept«A»? ?|override ?)*(?::{name}(?:«A»|«O»)(?:,{name}(?:«A»|«O»))*)?(?:=(?:default|delete);|;|«B»)")
        oper = rx(rf"{att}(?:{typ}{ptr} ?)?(?:{name}::)?{cv}operator ?(?:[-+*/%^&|~!=<>,]+|«A»|«D»|{typ}{ptr}|new|delete)«P»(?:const ?|noexcept ?|override ?)*(?:->{typ})?(?:=(?:default|delete);|;|«B»)")
        items += rx(rf"|{ctor}|{oper}|using (?:namespace )?{name}(?:={typ}{ptr})?;|(?:inline )?namespace(?: i(?:::i)*)?«X»|namespace i={name};|extern s(?:«X»|{decl};|{fn})|(?:public|private|protected):|friend (?:class )?{name};|i«A»;?|{temp}+(?:{agg};|(?:struct|class) {name};|{decl};|{fn}|{ctor}|{oper}|using i={typ}{ptr};)|(?:class|struct) i;|concept i={ex};)")
    else:
        items += rx(r"|i«A»;?|extern s«X»|(?:struct|union|enum) i;)")
    param = rule("param", rx(rf"(?:{att}{typ}{sp}{ptr}(?:\.\.\.)?{sp}(?:i?(?:«I»|«D»)*|«E»«P»)(?:={ex})?|\.\.\.)"))
    key = "const volatile static inline extern register restrict sizeof struct union enum typedef return if else while for do switch case default break continue goto unsigned signed long short int char float double void _Bool _Noreturn _Atomic _Static_assert __attribute__ typeof"
    if cpp:
        key += " bool auto class namespace template typename using public private protected virtual override final explicit friend constexpr consteval constinit mutable noexcept operator new delete try catch throw this nullptr static_cast dynamic_cast const_cast reinterpret_cast decltype static_assert co_await co_return concept requires thread_local alignas"
    field = rule("field", rf"(?:\.i(?:{_SETS['«I»']})*=|{_SETS['«I»']}=)?(?:{_SETS['«O»']}|{ex})")
    return Grammar(rule, 
        key, {"B": stmt, "K": items, "X": items, "T": items},
        {"(": {"A": rf"(?:(?:{ex}|{typ}{ptr})(?:,(?:{ex}|{typ}{ptr}))*)?", "E": rf"{ex}(?:,{ex})*|{decl}|{typ}{ptr}|\*+(?:const )?i?|[*&]i(?:{_SETS['«I»']})*" + (r"|\.\.\." if cpp else ""), "P": rf"(?:{param}(?:,{param})*)?|void", "F": rf"(?:{decl}|{ex}(?:,{ex})*)?;(?:{ex}(?:,{ex})*)?;(?:{ex}(?:,{ex})*)?" + (rf"|{typ}{ptr} ?(?:i|{_SETS['«I»']}|{_SETS['«Z»']}):{ex}|{decl};{ex}" if cpp else "")},
         "{": {"O": rf"(?:{field}(?:,{field})*,?)?", "U": rf"(?:i(?:={ex})?(?:,i(?:={ex})?)*,?)?"},
         "[": {"I": rf"(?:static )?{ex}", "D": "", **({"Z": r"(?:[=&*i,.]|this|\ue800)*" + chr(0) + "?"} if cpp else {})}}, no_members=_CALL + r"|\b(?:return|if|else|for|while|do|break|continue|goto)\b")


_SCRIPT = r"\breturn [^=]|\b(?:var|let|const) i|(?:^|[;\n])i\.i"


def _js(ts: bool) -> Grammar:
    rule = Rules()
    gen = r"(?:<[i,.|&?=<>\[\]s0 \ue000-\uefff]*(?:(?:extends|keyof|typeof|void|null|this|readonly|in) ?[i,.|&?=<>s\[\] \ue000-\uefff]*)*>)?" if ts else ""
    gen = rule("gen", gen) if ts else ""
    prim = rx(rf"(?:(?:readonly |keyof |typeof |unique |infer |asserts )*(?:i{gen}(?:\.i{gen})*|[0s]|-0|void|null|«O»|«N»|«K»|«B»|«I»|«D»|«Q»(?!=>)|this)(?:«I»|«D»)*|(?:new ?)?{gen}«P»=>(?:i is )?)") if ts else ""
    prim = rule("prim", prim) if ts else ""
    typ = rx(rf"(?:[|&]?{prim})+(?: is {prim})?(?:(?: |(?<=[>\ue000-\ue3ff]))extends {prim}\?{prim}:{prim})?") if ts else ""
    typ = rule("typ", typ) if ts else ""
    ann = rf"(?:[?!]?:{typ})?" if ts else ""
    ann = rule("ann", ann) if ts else ""
    un = rule("un", rx(rf"(?:\+\+|--|[-+!~]|typeof ?|void ?|delete ?|await ?|yield\*? ?|\.\.\.|(?:async ?)?(?:i|{gen}«P»{ann})=>|new (?=new))*"))
    fn = rule("fn", rx(rf"(?:async )?function\*?(?: ?i)?{gen}«P»{ann}«B»"))
    cls = rx(rf"class(?: i{gen})?(?:(?: |(?<=[>\ue000-\ue3ff]))extends (?:i(?:\.i)*{gen}|«A»|i(?:\.i)*«A»))?" + (rf"(?:(?: |(?<=[>\ue000-\ue3ff]))implements {typ}(?:,{typ})*)?" if ts else "") + "«K»")
    cls = rule("cls", cls)
    target = rule("target", rx(rf"new (?:i(?:\.i)*{gen}|«E»|this)"))
    atom = rx(rf"(?:{target}«A»?|i{gen if ts else ''}|[0s]|this|super|null|«E»|«I»|«D»|«O»|{fn}|{cls}|import«A»|import\.i|new\.i)")
    atom = rule("atom", atom)
    post = rx(rf"(?:\??\.#?(?:i|«I»|«A»)|{gen}«A»|«I»|\+\+|--|s" + ("|!(?!=)" if ts else "") + ")*")
    post = rule("post", post)
    cast = rf"(?: (?:as|satisfies) (?:const|{typ}))*" if ts else ""
    one = rule("one", rf"(?:{un}(?:{atom}{post}|(?<==>){_SETS['«B»']}){cast})")
    low = rule("low", rf"{one}(?:(?:{_BINARY}|\*\*|{_ASSIGN}|\*\*=| ?in | instanceof |=){one})*")
    ex = rule("ex", rf"{low}(?:\?{low}:{low})*")
    comma = rule("comma", rf"{ex}(?:,{ex})*")
    pat = rule("pat", rx("(?:i|«N»|«O»|«I»|«D»)"))
    var = rule("var", rf"(?:const|let|var) ?{pat}{ann}(?:={ex})?(?:,{pat}{ann}(?:={ex})?)*")
    end = r"(?:;|\n+|\Z)"
    names = rule("names", rx(r"(?:i|\*(?: ?(?:as|i) i)?|«N»)"))
    head = rule("head", rx(r"\n*(?:(?:if«E»|while«E»|for(?: await)?«F»|else(?: |\b)?|do ?|i:|with«E»)\n*)*"))
    decls = rf"interface i{gen}(?:(?: |(?<=[>\ue000-\ue3ff]))extends {typ}(?:,{typ})*)?(?:«K»|«O»)|type i{gen}={typ}{end}|(?:const )?enum i«U»|(?:declare )?(?:namespace|module) (?:i(?:\.i)*|s)«B»|abstract {cls}|declare (?:{var}{end}|{cls}|function i{gen}«P»{ann}{end})|function\*? ?i{gen}«P»{ann}{end}" if ts else ""
    decls = rule("decls", decls)
    core = rx(rf"(?:;|«B»|(?:@i(?:\.i)*«A»?\n*)*{cls}|{fn}|{var}{end}|return ?(?:{comma})?{end}|throw ?{comma}{end}|(?:break|continue)(?: i)?{end}|debugger{end}|do«B»\n*while«E»{end}|switch«E»«S»|try«B»\n*(?:catch(?:«E»|«P»)?«B»\n*)?(?:finally«B»)?|import ?(?:type ?)?(?:i,)?{names} ?i ?s{end}|import ?(?:i|s){end}|export (?:type ?)?{names}(?: ?i ?s)?{end}|export ?\*(?: ?(?:as|i) i)? ?i ?s{end}|export default (?:async )?(?:{fn}|{cls}|{comma}{end})|export ?«N»(?: ?i ?s)?{end}|export (?:async )?(?:{var}{end}|{fn}|{cls}" + (f"|{decls}" if ts else "") + rf")|{comma}{end}" + (f"|{decls}|import i=(?:{comma}){end}" if ts else "") + ")")
    core = rule("core", core)
    stmt = rf"{head}{core}|\n+"
    # two statements on one line without a separator must not pass: after the expression comes an end, checked inside core
    mods = r"(?:(?:static|async|get|set|public|private|protected|readonly|abstract|override|declare|accessor) ?)*\*?" if ts else r"(?:(?:static|async|get|set) ?)*\*?"
    key = rule("key", rx(r"(?:#?i|s|0|«I»|get|set|static|async|constructor)"))
    member = rx(rf"(?:;|\n+|(?:@i(?:\.i)*«A»?\n*)+|static«B»|{mods}{key}{'[?!]?' if ts else ''}{gen}«P»{ann}\n*«B»|{mods}{key}{ann}(?:={ex}){end}|{mods}{key}{ann}{end}" + (rf"|{mods}(?:{key}[?]?)?{gen}«P»{ann}(?:;|,|\n+|\Z)|{mods}«Z»(?:[?]?:{typ})(?:;|,|\n+|\Z)|{mods}{key}[?!]?:{typ}(?:;|,|\n+|\Z)" if ts else "") + ")")
    member = rule("member", member)
    prop = rule("prop", rx(rf"(?:{mods}{key}«P»{ann}«B»|{key}:{ex}|\.\.\.{ex}|i(?:={ex})?)"))
    param = rf"(?:(?:\.\.\.)?(?:(?:public|private|protected|readonly|override) )*(?:this|{pat}){ann}(?:={ex})?)" if ts else rf"(?:(?:\.\.\.)?{pat}(?:={ex})?)"
    param = rule("param", param)
    tobj = rx(rf"(?:(?:readonly )?(?:{key}\??(?::{typ})?|{key}?\??{gen}«P»:{typ}|«Z»\??:{typ})[;,]?)*") if ts else ""
    tobj = rule("tobj", tobj)
    return Grammar(rule, 
        r"const let(?=\s+[\w$]|\s*[{\[]) var function class extends new return if else while for do switch case default break continue try catch finally throw import export typeof void delete await(?=\s+[\w$(\[]|\s*\() async(?=\s+[\w$(*]|\s*\([^)]*\)\s*=>) yield in instanceof this super debugger static(?=\s+[\w$#*\[{]) get(?=\s+[\w$\[#]) set(?=\s+[\w$\[#]) with(?=\s*\()" + (r" interface(?=\s+\w) type(?=\s+[A-Za-z_${*]) enum namespace(?=\s+\w) module(?=\s+[\w\"']) declare(?=\s+\w) abstract(?=\s+\w) implements(?=\s+\w) public(?=\s+[\w$#]) private(?=\s+[\w$#]) protected(?=\s+[\w$#]) readonly(?=\s+[\w$#\[]) keyof(?=\s+\w) infer(?=\s+\w) is(?=\s+[\w{]) as(?=\s+[\w{\[(]) satisfies(?=\s+[\w{\[]) override(?=\s+\w)" if ts else ""),
        {"B": stmt, "K": member, "S": rf"\n*(?:(?:case ?{comma}|default):|{stmt})", "T": stmt},
        {"(": {"A": rf"(?:{ex}(?:,{ex})*,?)?", "E": comma, "P": rf"(?:{param}(?:,{param})*,?)?", "F": rf"(?:{var}|{comma})?;(?:{comma})?;(?:{comma})?|(?:(?:const|let|var) ?)?{pat}{ann} ?(?:of|in|i) ?{ex}", **({"Q": typ} if ts else {})},
         "{": {"O": rf"(?:{prop}(?:,{prop})*,?)?" + (f"|{tobj}" if ts else ""), "N": rf"(?:(?:type )?(?:i|default|s)(?: as (?:i|default)| i (?:i|default))?(?:[:]{pat}|={ex})?(?:,(?:type )?(?:i|default|\.\.\.i)(?: as (?:i|default)| i (?:i|default))?(?::{pat})?(?:={ex})?)*,?)?", **({"U": rf"(?:(?:i|s)(?:={ex})?(?:,(?:i|s)(?:={ex})?)*,?)?"} if ts else {})},
         "[": {"I": rf",*(?:{ex}(?:,+{ex})*,*)?" + (f"|{typ}(?:,{typ})*" if ts else ""), "D": "", **({"Z": rf"i(?::| in ?){typ}"} if ts else {})}}, newlines=True, no_object=_SCRIPT if ts else ";", no_members=_SCRIPT)


def _php() -> Grammar:
    rule = Rules()
    name = rule("name", r"(?:\\)?i(?:\\i)*")
    typ = rule("typ", rf"\??(?:{name}|array|static)(?:[|&](?:{name}|array|static))*")
    un = rule("un", r"(?:\+\+|--|[-+!~@&]|new ?(?=class)|clone ?|print ?|(?:include|require)(?:_once)? ?|yield(?: from)? ?|throw ?|fn«P»(?::" + typ + r")?=>|\.\.\.|«E»(?=[iv0s\ue000-\uefff!~@-]|new))*")
    atom = rule("atom", rx(rf"(?:new (?:{name}|static|v(?:(?:->|::)v?i?)*)(?:«A»)?|new ?class«A»?(?:(?: |(?<=[>\ue000-\ue3ff]))extends {name})?(?:(?: |(?<=[>\ue000-\ue3ff]))implements {name}(?:,{name})*)?«K»|{name}|static|v|[0s]|«E»|«I»|array«A»|list«A»|(?:isset|empty|exit|die|unset|eval)«A»|exit|die|(?:static )?function&?«P»(?:use«A»)?(?::{typ})?«B»|match«E»«O»|\$«B»)"))
    post = rule("post", rx(r"(?:\??->(?:i|v|«B»|«O»|list|array|print|default|class|use|for|new)|::(?:i|v|class)|«A»|«I»|«B»(?=\ue7ff)|\+\+|--)*"))
    one = rule("one", rf"{un}{atom}{post}")
    low = rule("low", rf"{one}(?:(?:{_BINARY}|\*\*|\.(?!\.)|{_ASSIGN}&?|<>| (?:and|or|xor|instanceof) ?){one})*")
    ex = rule("ex", rf"{low}(?:\?{low}?:{low})*")
    args = rule("args", rf"(?:(?:i:)?{ex}(?:,(?:i:)?{ex})*,?|\.\.\.)?")
    kv = rule("kv", rf"(?:{ex}=>)?&?{ex}")
    att = rule("att", rx(r"(?:#«I»)*"))
    mod = rule("mod", rf"{att}(?:(?:public|private|protected|static|final|abstract|readonly|var)(?: |(?=\?)))*")
    cls = rule("cls", rx(rf"{att}(?:(?:final|abstract|readonly) )*(?:class|interface|trait|enum) i(?::i)?(?:(?: |(?<=[>\ue000-\ue3ff]))extends {name}(?:,{name})*)?(?:(?: |(?<=[>\ue000-\ue3ff]))implements {name}(?:,{name})*)?«K»"))
    fn = rule("fn", rx(rf"{att}function ?&?i«P»(?::{typ})?(?:«B»)"))
    stmt = rule("stmt", rx(rf"(?:if«E»:?|elseif«E»:?|while«E»:?|for«F»:?|foreach«F»:?|else:?(?: |\b)?|do ?|declare«A»(?=;|«B»)|i:(?!:))*(?:;|«B»|{ex};|return ?(?:{ex})?;|echo ?{ex}(?:,{ex})*;|(?:break|continue)(?: ?0)?;|do«B»while«E»;|while«E»;|switch«E»«S»|try«B»(?:catch«P»«B»)*(?:finally«B»)?|throw ?{ex};|global v(?:,v)*;|static v(?:={ex})?(?:,v(?:={ex})?)*;|unset«A»;|(?:endif|endwhile|endfor|endforeach|endswitch);|namespace ?{name}(?:;|«B»)|use ?(?:function |const )?{name}(?: as i)?(?:,{name}(?: as i)?)*;|use ?{name}\\«N»;|const (?:i )?i={ex}(?:,i={ex})*;|{cls}|{fn}|goto i;|h)"))
    member = rule("member", rx(rf"(?:;|{mod}(?:{typ} )?v(?:={ex})?(?:,v(?:={ex})?)*;|{mod}const (?:{typ} )?i={ex}(?:,i={ex})*;|{mod}function ?&?(?:i|list|print|echo|default|class|use|for|new)«P»(?::(?:static|{typ}))?(?:«B»|;)|use {name}(?:,{name})*(?:;|«B»|«K»)|case i(?:={ex})?;)"))
    param = rule("param", rf"{att}(?:(?:public|private|protected|readonly) )*(?:{typ} ?)?&?(?:\.\.\.)?&?v(?:={ex})?")
    return Grammar(rule, 
        "abstract and array as break case catch class clone const continue declare default die do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile eval exit extends final finally fn for foreach function global goto if implements include include_once instanceof interface isset list match namespace new or print private protected public readonly require require_once return static switch throw trait try unset use var while xor yield",
        {"B": stmt, "K": member, "S": rf"(?:(?:case ?{ex}|default)[:;]|{stmt})", "T": stmt},
        {"(": {"A": args + rf"|{kv}(?:,{kv})*,?|(?:,*&?v)+", "E": rf"{ex}|i", "P": rf"(?:{param}(?:,{param})*,?)?|{name}(?:\|{name})*(?: ?v)?", "F": rf"(?:{ex}(?:,{ex})*)?;(?:{ex}(?:,{ex})*)?;(?:{ex}(?:,{ex})*)?|{ex} as (?:&?{ex}=>)?&?{ex}|{ex} ?as ?(?:&?{ex}=>)?&?{ex}"},
         "{": {"O": rf"(?:(?:default|{ex}(?:,{ex})*)=>{ex}(?:,(?:default|{ex}(?:,{ex})*)=>{ex})*,?)?|{ex}", "N": rf"{name}(?: as i)?(?:,{name}(?: as i)?)*"},
         "[": {"I": rf"(?:,*(?:{kv}|\.\.\.{ex}))*,?"}}, no_members=r"(?:^|[;\ue400-\ue7ff])(?:v[-=\[]|return[ ;]|echo |i[-];|(?:if|foreach|for|while|switch)[-])")


def _go() -> Grammar:
    rule = Rules()
    prim = rule("prim", rx(r"(?:\*|«I»|«D»|chan ?|<-chan ?|map«I»|func«P»)*(?:i(?:\.i)?(?:«I»)?|struct«K»|interface«K»|func«P»(?:«P»)?|«E»|«Q»|any)"))
    typ = rule("typ", rf"(?:{prim})")
    res = rule("res", rx(rf"(?:«P»|{typ})?"))
    un = r"(?:[-+!^*&]|<-)*"
    comp = rule("comp", rx(rf"(?:(?:«I»|«D»|map«I»|\*)+{typ}|struct«K»|i(?:\.i)?)«O»"))
    atom = rule("atom", rx(rf"(?:{comp}|func«P»{res}«B»|(?:«I»|«D»)+{typ}|map«I»{typ}|chan {typ}|struct«K»|interface«K»|i|[0s]|«E»|«A»)"))
    post = rule("post", rx(r"(?:\.i|\.«E»|\.«Q»|«A»|«I»|«O»(?=[)\],;\n]|\Z))*"))
    bin_ = r"(?:==|!=|<=|>=|&&|\|\||<<|>>|&\^|[-+*/%&|^<>])"
    one = rule("one", rf"{un}{atom}{post}")
    ex = rule("ex", rf"{one}(?:{bin_}{one})*")
    lst = rule("lst", rf"{ex}(?:,{ex})*")
    ass = r"(?::=|=|[-+*/%&|^]=|<<=|>>=|&\^=)"
    simple = rule("simple", rf"(?:{lst}{ass}(?:range ?)?{lst}|{ex}(?:\+\+|--)|{ex}<-{ex}|{ex})")
    call = rule("call", rx(rf"(?:{lst}{ass}{lst}|{ex}(?:\+\+|--)|{ex}<-{ex}|<-{ex}|{one}(?<=[\ue000-\ue3ff]))"))
    end = r"(?:;|\n+|\Z)"
    spec = rule("spec", rf"i(?:,i)*(?: ?{typ})?(?:={lst})?")
    tspec = rule("tspec", rx(rf"i(?:«I»)? ?=?{typ}"))
    head = rx(rf"(?:if ?(?:{simple}?;)?{ex}|for ?(?:{simple}?;(?:{ex})?;(?:{simple})?|(?:{lst}(?::=|=))?range ?{ex}|{ex})?|switch ?(?:{simple}?;)?(?:{simple})?|select ?)")
    block = rx("«B»")
    cond = rule("cond", rf"(?:if ?(?:(?:{simple})?;)?{ex}{block}(?:else ?if ?(?:(?:{simple})?;)?{ex}{block})*(?:else ?{block})?)")
    stmt = rule("stmt", rx(rf"\n*(?:;|i:\n*)*(?:\n+|;|{cond}{end}|for ?(?:(?:{simple})?;(?:{ex})?;(?:{simple})?|(?:{lst}(?::=|=))?range ?{ex}|{ex})?«B»{end}|switch ?(?:(?:{simple})?;)?(?:{simple})?«S»{end}|select«S»{end}|(?:return|go|defer)(?: ?{lst})?{end}|(?:break|continue|goto)(?: i)?{end}|fallthrough{end}|(?:var|const) {spec}{end}|(?:var|const)«Q»{end}|type {tspec}{end}|{call}{end}|«B»{end})"))
    top = rule("top", rx(rf"\n*(?:\n+|;|package i{end}|import ?(?:i |\.)?s{end}|import«Q»{end}|import«E»{end}|import«A»{end}|func ?(?:«P» ?)?i(?:«I»|«Z»)?«P» ?{res}(?:«B»)?{end}|(?:var|const) {spec}{end}|(?:var|const)(?:«Q»|«A»){end}|type {tspec}{end}|type(?:«Q»|«A»){end})"))
    param = rule("param", rf"(?:i(?:,i)* ?)?(?:\.\.\.)?{typ}")
    item = rule("item", rf"(?:{ex}:)?(?:{_SETS['«O»']}|{ex})")
    return Grammar(rule, 
        "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
        {"B": stmt, "K": rx(rf"\n*(?:\n+|;|i(?:,i)* ?{typ}(?: ?s)?{end}|\*?i(?:\.i)?(?: ?s)?{end}|i«P»{res}{end}|~?{typ}(?:\|~?{typ})*{end})"), "S": rf"\n*(?:(?:case ?(?:{simple}|{lst}|{typ}(?:,{typ})*)|default):|{stmt})", "T": top},
        {"(": {"A": rf"(?:(?:{lst}|{typ}(?:,{lst})?)(?:\.\.\.)?,?)?", "E": rf"{ex}|type|{typ}", "P": rf"(?:{param}(?:,{param})*,?)?", "Q": rf"(?:;?(?:(?:i |\.)?s|{spec}|{tspec}|i))*;?"},
         "{": {"O": rf"(?:{item}(?:,{item})*,?)?"},
         "[": {"I": rf"(?:{ex})?(?::(?:{ex})?){{0,2}}|{typ}(?:,{typ})*|\.\.\.", "D": "", "Z": r"i(?:,i)* ?[i|~.,* ]*"}}, newlines=True, no_object=r":=|\b(?:return|if|for|go|defer|var|const|break|continue|goto|switch|select)\b", no_members=r":=|\b(?:return|if|for|go|defer|break|continue|goto|switch)\b")


_BUILT: dict[str, Grammar] = {}
MAKERS = {".java": _java, ".cs": _cs, ".c": lambda: _c(False), ".cpp": lambda: _c(True), ".js": lambda: _js(False), ".ts": lambda: _js(True), ".php": _php, ".go": _go}
MAKERS[".h"] = MAKERS[".cpp"]


def grammar(ext: str) -> Grammar:
    if ext not in _BUILT:
        _BUILT[ext] = MAKERS[ext]()
    return _BUILT[ext]
