"""Problem 3: text decoded with the wrong character encoding.

A text is a node; *encode with one codec, decode with another* and *unescape* are edges.  A best-first search walks from the text
as it is to the cheapest text it can reach, guided by how implausible the characters are in their places (a symbol inside a word, a
capital after a small letter, scripts mixed in a word, rare ideographs, Cyrillic letters in the wrong proportions, control
characters) and by how unusual the pair of codecs is: UTF-8 read as a code page of one byte a character is common, a code page read as its
neighbour happens, anything else is rare, and rarer as a second step.  Texts once seen are not entered again.  If the cheapest text is clearly more plausible, the way to it is the damage and
the text itself the restored original; a text with replacement characters is damaged, and lost, and so is one with two equally plausible
readings.

Only lines that hold a character beyond ASCII (or an escaped one) are looked at, by segments: the run from the first to the last such
character of the line, and each of its words.  The same segments recur without end, so each is searched once per worker.
Null fields are no case; rows delivered twice count once; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MEMO_LIMIT = 100_000
#: Bounds of one search that no damage comes near; longer texts are searched by windows of MAX_SEGMENT first.
MAX_STEPS, MAX_NODES, MAX_SEGMENT = 8, 250, 400
#: A reachable text must cost at most this share of the text as it is, and less by so much.
SHARE, MARGIN, STEP_COST = 0.62, 2.6, 0.6
#: The same where the way is UTF-8 out of a code page of single bytes, which no correct text is by chance.
UTF8_SHARE, UTF8_MARGIN = 0.8, 0.75
#: Readings whose costs are this close leave the original open.
RIVAL = 0.02
#: Codecs that are a little less likely than others of their kind.
UNLIKELIER = {"euc_jp": 0.05, "cp932": 0.05, "big5": 0.1, "euc_kr": 0.15, "cp1250": 0.05, "iso8859-2": 0.1, "iso8859-5": 0.1, "mac-roman": 0.1, "cp437": 0.1, "cp850": 0.15, "cp866": 0.05}

# Codecs that text is confused between.
READ_AS = ("cp1252", "cp1250", "cp1251", "koi8-r", "mac-roman", "cp437", "cp850", "cp866", "gb18030", "cp932", "latin-1", "iso8859-2", "iso8859-15", "cp1254")
MEANT = ("utf-8", "cp1252", "cp1250", "cp1251", "koi8-r", "gb18030", "euc_jp", "cp932", "euc_kr", "big5", "cp437", "mac-roman", "iso8859-2", "iso8859-5", "cp850", "cp866")
_WIDE = frozenset(("gb18030", "euc_jp", "cp932", "euc_kr", "big5"))
_CYRILLIC_PAGES, _LATIN_PAGES = frozenset(("cp1251", "koi8-r", "cp866", "iso8859-5")), frozenset(("cp1252", "latin-1", "iso8859-15", "cp1254", "mac-roman", "cp437", "cp850", "cp1250", "iso8859-2"))
#: What a step costs besides: common, likely and rare pairs of codecs.
COMMON, LIKELY, RARE, RARE_LATER = 0.0, 0.5, 3.5, 3.0
_LETTERS = frozenset("àâäáãåąæāçćčďđéèêëęěíîïìłñńňóôöòõőøœřšśßşțťúûüùůűýÿžźżğı")
_WORD_SIGNS = frozenset("’'·")
_RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10.97, 8.45, 8.01, 7.35, 6.70, 6.26, 5.47, 4.73, 4.54, 4.40, 3.49, 3.21, 2.98, 2.81, 2.62, 2.01, 1.90, 1.74, 1.70, 1.65, 1.59, 1.44, 1.21, 0.97, 0.94, 0.73, 0.64, 0.48, 0.36, 0.32, 0.26, 0.04, 0.04)))
_UKRAINIAN = frozenset("іїєґў")

_HIGH = re.compile(r"[^\x00-\x7f]")
_SEGMENT = re.compile(r"[^\x00-\x7f](?:[^\n]*[^\x00-\x7f])?")
_WORDS = re.compile(r"[^\s\x00-\x1f\"'()\[\]{}<>,;:/|=+*&%#@!?^~`$\\]*[^\x00-\x7f][^\s\x00-\x1f\"'()\[\]{}<>,;:/|=+*&%#@!?^~`$\\]*")
_ESCAPED = re.compile(r"(?:\\u00[c-f][0-9a-f]\\u00[89ab][0-9a-f]|&[AC][a-z]+;&[a-z]+;|\\x[c-f][0-9a-f]\\x[89ab][0-9a-f]|&#(?:19[4-9]|2[0-4]\d);&#1[2-9]\d;|%[CDE][0-9A-F](?:%[89AB][0-9A-F])+)", re.I)
_CYRILLIC = re.compile(r"[\u0400-\u052f_.\-]+")
_RUN = re.compile(r"(.)\1{2,}", re.S)

_C1252: dict[str, int] = {}
for _b in range(256):
    try:
        _C1252[bytes([_b]).decode("cp1252")] = _b
    except UnicodeDecodeError:
        _C1252[chr(_b)] = _b
_SLOPPY = {v: k for k, v in _C1252.items()}


def _encode(s: str, codec: str) -> bytes | None:
    if codec == "cp1252":  # its five undefined bytes pass as control characters, as programs do
        try:
            return bytes([_C1252[c] if c in _C1252 else _LATIN[c] for c in s])
        except KeyError:
            return None
    try:
        return s.encode(codec)
    except UnicodeEncodeError:
        return None


_LATIN = {chr(b): b for b in range(256)}
_COMMON: dict[str, float] = {}


def _ideograph(c: str) -> float:
    """Cheap for the everyday ideographs (level one of the national character set), dearer for the rest."""
    if c not in _COMMON:
        if len(_COMMON) > 50_000:
            _COMMON.clear()
        try:
            b = c.encode("gb2312")
            _COMMON[c] = 1.2 if 0xB0 <= b[0] <= 0xD7 else 2.6
        except UnicodeEncodeError:
            try:
                b = c.encode("euc_jp")
                _COMMON[c] = 1.3 if len(b) == 2 and 0xB0 <= b[0] <= 0xCF else 3.2
            except UnicodeEncodeError:
                _COMMON[c] = 3.4
    return _COMMON[c]


def _kanji(c: str) -> float:
    """The same in a text with kana: cheap for the everyday ideographs of Japanese."""
    key = "k" + c
    if key not in _COMMON:
        try:
            b = c.encode("euc_jp")
            _COMMON[key] = 1.2 if len(b) == 2 and b[0] <= 0xCF else 2.2 if len(b) == 2 else 3.0
        except UnicodeEncodeError:
            _COMMON[key] = 3.4
    return _COMMON[key]


def _kind(c: str) -> str:
    o = ord(c)
    if o < 0x80:
        return "a" if c.isalpha() else "d" if c.isdigit() else "_" if c == "_" else " "
    if o < 0xA0 or o == 0xFFFD or 0xE000 <= o <= 0xF8FF or o in (0xAD, 0xFEFF):
        return "x"
    if o == 0xB5:
        return "s"
    if o < 0x250 or 0x1E00 <= o <= 0x1EFF:
        if not c.isalpha():
            return "s"
        return "l" if c in _LETTERS else "L" if c.lower() in _LETTERS else "o"
    if 0x370 <= o <= 0x3FF:
        return "g"
    if 0x400 <= o <= 0x52F:
        return "c"
    if 0x4E00 <= o <= 0x9FFF:
        return "h"
    if 0x3040 <= o <= 0x30FF or o == 0x3005:
        return "k"
    if 0xAC00 <= o <= 0xD7A3:
        return "w"
    if 0xFF61 <= o <= 0xFF9F:
        return "f"
    if 0x3000 <= o <= 0x303F or 0xFF00 <= o <= 0xFF60:
        return "p"
    if 0x2500 <= o <= 0x259F:
        return "b"
    if unicodedata.category(c) in ("Cn", "Co", "Cs", "Cc"):
        return "x"
    if 0x2000 <= o <= 0x2BFF:
        return "s" if not c.isalpha() else "S"
    return "o"


_ALPHA = frozenset("alLocgS")


def cost(s: str) -> float:
    """How implausible the characters of s are in their places; 0 for ASCII."""
    kinds = [" ", *map(_kind, s), " "]
    chars = " " + s + " "
    total = 0.0
    ideograph = _kanji if "k" in kinds else _ideograph
    for k in range(1, len(kinds) - 1):
        kind = kinds[k]
        if kind in "ad_ ":
            continue
        c, p, n, before = chars[k], kinds[k - 1], kinds[k + 1], chars[k - 1]
        if kind == "x":
            total += 8
        elif kind in "lL":
            total += 0.7 if kind == "l" else 0.9
            if p in "lL" and c != before:
                total += 1.0
            if kind == "L" and (p in "al" and before.islower()):
                total += 4
            if p in "cghkw" or n in "cghkw":
                total += 3
        elif kind == "o":
            total += 3
            if c.isupper() and before.islower():
                total += 2
        elif kind == "c":
            low = c.lower()
            f = _RUSSIAN.get(low)
            total += (0.3 if f and f > 4 else 0.7 if f and f > 1.6 else 1.5 if f and f > 0.6 else 2.4 if f else 1.8 if low in _UKRAINIAN else 4.5)
            if c.isupper():
                total += 4 if before.islower() else 0.55
            if p in "alL" or n in "alL":
                total += 3
        elif kind == "g":
            total += 1.0
            if p in "al" and n in "al" or p in "al" and before.islower() or n in "al" and (p in "al" or chars[k + 1].islower() and c.islower()):
                total += 4
        elif kind == "h":
            total += ideograph(c)
            if p == "a" and n == "a" or (p == "a" and n == "h" and kinds[min(k + 2, len(kinds) - 1)] == "a" and chars[k + 2].islower() and before.islower()):
                total += 4
            elif (p == "a" and n not in "hk" or n == "a" and p not in "hk"):
                total += 2.5
        elif kind in "kw":
            total += 0.6 if kind == "k" else 1.2
            if kind == "k" and p == "a" and n == "a":
                total += 4
        elif kind == "f":
            total += 3.5
        elif kind == "p":
            total += 0.8
        elif kind == "b":
            total += 1.5
            if p in _ALPHA or n in _ALPHA:
                total += 4
        elif kind in "sS":
            total += 1.2
            if c in "¿¡":
                total += 4 if p in _ALPHA or not (n in _ALPHA or n in "dsh") else 0
            elif c in "ºª°²³¹":
                total += 4 if n in "alLc" and p in _ALPHA or c in "¹³²" and p in "al" and n in "al_" else 0
            elif c in _WORD_SIGNS or c in "—–…“”‘’«»„":
                total += 3.4 if c in "„“”…—–«»" and p in _ALPHA and n in _ALPHA else 3 if c == "·" and p in _ALPHA and n in _ALPHA and not (before == "l" and chars[k + 1] == "l") else 0
            elif p in _ALPHA or n in "lLocg" or n == "a" and p in "sSlLb":
                total += 4 if p in _ALPHA and n in _ALPHA or p in "lLoc" or n in "lLoc" or p == "a" and c not in "§€£¥©®™%‰†‡•√∞" else 0
            if p in "sS" and before != c and c not in "’”“‘…—–→←✓" and before not in "’”“‘…—–→←✓":
                total += 2
    return total


_EVERY = {chr(b) for b in range(128)}
_SEEN: dict[str, tuple[str, bool, bool] | None] = {}


def _plain(s: str) -> str:
    return re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|%([0-9A-F]{2})", lambda m: chr(int(m[1] or m[2] or m[3], 16)), s)


def _prior(read: str, meant: str) -> float:
    if meant == "utf-8":
        return COMMON if read in ("cp1252", "latin-1") else 0.2 if read in ("cp1250", "cp1251", "cp437", "cp850", "cp866", "koi8-r", "mac-roman") else 0.4 if read not in _WIDE else LIKELY
    if read in _LATIN_PAGES and (meant in _CYRILLIC_PAGES or meant in _WIDE or meant in _LATIN_PAGES) or read in _CYRILLIC_PAGES and meant in _CYRILLIC_PAGES or read in _WIDE and meant in _WIDE:
        return UNLIKELIER.get(meant, 0.0) + (LIKELY if meant not in _WIDE or read in _WIDE else 0.8 if read in ("cp1252", "latin-1") else RARE)
    return RARE


#: The steps of the search, the common ones first: what is reached in several ways counts as reached in the first.
STEPS = sorted(((_prior(a, b), a, b) for a in READ_AS for b in MEANT if a != b), key=lambda x: x[0])


def _next(s: str) -> Iterator[tuple[str, float, int]]:
    """(text, prior cost, kind of step: 2 UTF-8 out of a page of single bytes or an escape, 1 UTF-8 out of another, 0 any other) one step away."""
    if _ESCAPED.search(s):
        yield html.unescape(s), COMMON, 2
        yield _plain(s), COMMON, 2
    raws: dict[str, bytes | None] = {}
    done: set[tuple[bytes, str]] = set()
    for prior, a, b in STEPS:
        if a not in raws:
            raws[a] = _encode(s, a)
        raw = raws[a]
        if raw is None or (raw, b) in done:
            continue
        done.add((raw, b))
        try:
            out = raw.decode(b)
        except (UnicodeDecodeError, LookupError):
            continue
        yield out, prior, (2 if a not in _WIDE else 1) if b == "utf-8" else 0


def search(s: str) -> tuple[str, bool, bool] | None:
    """(the original, whether it is whole, whether the way to it leads through UTF-8 or an escape) if s is damaged text, None if it is not."""
    if s.isascii() and not _ESCAPED.search(s):
        return None
    if s in _SEEN:
        return _SEEN[s]
    if len(_SEEN) > MEMO_LIMIT:
        _SEEN.clear()
    _SEEN[s] = out = _search(s)
    return out


def _search(s: str) -> tuple[str, bool, bool] | None:
    if "�" in s:
        return s, False, True
    sample = _RUN.sub(r"\1\1", s)
    first = cost(sample) if not _ESCAPED.search(sample) else max(cost(u) for u in (html.unescape(sample), _plain(sample))) + 6
    if first < UTF8_MARGIN + STEP_COST:
        return None
    heap, seen, nodes = [(first, 0, s, 0.0, 3)], {s}, 0
    best, rival = (first, s, 3), first
    while heap and nodes < MAX_NODES:
        at, steps, text, spent, way = heapq.heappop(heap)
        nodes += 1
        if steps >= MAX_STEPS or best[0] < 0.12 * first and steps:
            continue
        plain = set(_HIGH.sub("", text)) if not _ESCAPED.search(text) else _EVERY
        for t, prior, kind in _next(text):
            # decoding never makes ASCII characters that were not there; escapes do
            if t in seen or len(t) * 4 < len(text) or not plain >= set(_HIGH.sub("", t)):
                continue
            seen.add(t)
            paid = spent + prior + STEP_COST + (RARE_LATER if steps and not kind else 0.0)
            c = cost(_RUN.sub(r"\1\1", t)) + paid
            w = min(way, kind)
            if c < best[0]:
                best, rival = (c, t, w), best[0] if best[1] != s else rival
            else:
                rival = min(rival, c)
            # text that is no more plausible by now is only worth a step if it was read twice
            if c < first * 1.05 or kind == 2 and c < first * 1.3:
                heapq.heappush(heap, (c, steps + 1, t, paid, w))
    share, margin = (UTF8_SHARE, UTF8_MARGIN) if best[2] == 2 else (SHARE, MARGIN)
    if best[1] != s and best[0] <= first * share and first - best[0] >= margin:
        # of two readings as plausible neither is the original for sure
        return (best[1], True, best[2] > 0) if rival - best[0] > RIVAL else (s, False, best[2] > 0)
    # controls that no text has, though no way back was found
    return (s, False, True) if sum(0x80 <= ord(c) < 0xA0 for c in s) >= 2 else None


_RUN_OF_TEXT = re.compile(r"[^\s\"'`]*(?:\\[ux]|&|%)[^\s\"'`]*")


def _long(s: str) -> tuple[str, bool, bool] | None:
    """search for a run of text of any length: by overlapping windows, whose edges may cut a character, then as a whole if one is damaged."""
    step = MAX_SEGMENT - 100
    for k in range(0, len(s), step):
        window = s[k:k + MAX_SEGMENT]
        # ordinary text costs about one a character beyond ASCII, damaged text several times that
        if "�" not in window and not _ESCAPED.search(window) and cost(_RUN.sub(r"\1\1", window)) < 1.5 * len(_HIGH.findall(_RUN.sub(r"\1\1", window))) + MARGIN:
            continue
        for a in range(4):
            for b in range(4):
                if (cut := window[a:len(window) - b]) and (not cut.isascii() or _ESCAPED.search(cut)) and search(cut):
                    return _search(s) or (s, False, True)
                if window.isascii():
                    break
            if window.isascii():
                break
    return None


def field(text: str) -> tuple[str | None, bool] | None:
    """(the restored field or null where something was lost, whether whole) if a field holds damaged text, else None."""
    if text.isascii() and not _ESCAPED.search(text):
        return None
    hit, lost, out = False, False, []
    for line in text.split("\n"):
        if line.isascii() and not _ESCAPED.search(line):
            out.append(line)
            continue
        m = _SEGMENT.search(line)
        whole = None
        if m:
            seg = line[m.start():m.end()]
            # letters right before and after belong to the first and last word
            a, b = m.start(), m.end()
            while a and (line[a - 1].isalnum() or line[a - 1] == "_"):
                a -= 1
            while b < len(line) and (line[b].isalnum() or line[b] == "_"):
                b += 1
            seg = line[a:b]
            whole = search(seg) if len(seg) <= MAX_SEGMENT else _long(seg)
            if whole and whole[1]:
                hit = True
                out.append(line[:a] + whole[0] + line[b:])
                continue

            swapped = not whole and len(_CYRILLIC.findall(seg)) > 1

            def word(w: re.Match) -> str:
                nonlocal hit, lost
                found = search(w.group()) if len(w.group()) <= MAX_SEGMENT else _long(w.group())
                # one alphabet read as another of the same script shows in whole phrases, not in single words of one
                if found and not (swapped and not found[2] and _CYRILLIC.fullmatch(w.group())):
                    hit = True
                    lost |= not found[1]
                    return found[0]
                return w.group()

            line = _WORDS.sub(word, line)
            if whole and not whole[1]:
                hit = lost = True
        else:

            def escaped(w: re.Match) -> str:
                nonlocal hit
                s = w.group()
                found = (search(s) if len(s) <= MAX_SEGMENT else _long(s)) if _ESCAPED.search(s) else None
                hit |= bool(found)
                return found[0] if found else s

            line = _RUN_OF_TEXT.sub(escaped, line)
        out.append(line)
    return ((None, False) if lost else ("\n".join(out), True)) if hit else None


def _kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rows = []
        for i, code, path in zip(*(b.column(k).to_pylist() for k in range(3))):
            for name, text in (("source_code", code), ("path", path)):
                if text and (found := field(text)):
                    rows.append((i, name, found[0], found[1]))
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.bool_()))], names=["file_id", "field_name", "original", "restored"])


def damaged(files: DataFrame) -> DataFrame:
    """(file_id, field_name, original, restored) of every field with damaged text; original is null where something was lost."""
    suspicious = lambda c: F.col(c).rlike(r"[^\x00-\x7f]|\\u00|&[ACac#]|\\x[c-fC-F]|%[CDE][0-9A-F]%")
    rows = files.select("file_id", F.when(suspicious("source_code"), F.col("source_code")).alias("source_code"), F.when(suspicious("path"), F.col("path")).alias("path"))
    rows = rows.where(F.col("file_id").isNotNull() & (F.col("source_code").isNotNull() | F.col("path").isNotNull()))
    return common.spread(rows).mapInArrow(_kernel, "file_id long, field_name string, original string, restored boolean")
