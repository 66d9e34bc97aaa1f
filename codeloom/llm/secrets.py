"""Problem 6: credentials embedded in source code.

1. Index: every structured literal of every file (long enough, mixed characters, no name, path, version or host) with the lines it
   begins on, the evidence around it (a credential's name before it, a login call, a URL with a password, a known token form) and a hash
   of its line.
2. Owners: the literals are grouped over the whole corpus.  One that more repositories share than ``min_owners`` and than ``owner_share``
   of all of them, on as many different lines, is a placeholder from a template and is dropped; copies of one file are one line, so
   copying does not make a secret a placeholder, and private keys and known token forms are none however widely shared.  One with
   evidence in at least one place is confirmed.
3. Re-scan of every file: a confirmed secret is known by its anchor, a run of letters and digits with the next one.  A bitmap of the
   anchors (of fixed size, so it only lets more through as secrets grow) sifts the words of every file; only words that may hold a secret,
   with their lines, are joined with the secrets by anchor, and an automaton of the joined secrets confirms the places, also those where
   nothing around the literal gives it away.  No text is shuffled to find secrets; the redaction, which keeps quotes and lengths
   of lines' other text, moves the files that hold some.

The index is grouped with partial aggregation, so a literal that fills a third of the corpus costs one row per task; only bitmaps are
sent to the driver.  Evidence is sought up to 400 characters before a literal on its line, and on the line before where it stands alone.
A literal above 4,096 characters is encoded data, not a secret, but for private keys.  Null or blank code has no secret; rows delivered twice count once; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A literal on more lines of more repositories than both is a placeholder: a number, and a share of all repositories.
MIN_OWNERS, OWNER_SHARE = 24, 0.25
#: Bits of the bitmap of anchors, and words a worker remembers as holding none.
ANCHOR_BITS = 1 << 24
IDLE_WORDS = 500_000

# Words between blanks, quotes and brackets; plain names (small letters and joints, or letters, and a number) and words without digits and signs are passed over, not captured.
_BREAK = r"\s\"'`<>(),;\[\]{}|\\\x00-\x1f"
_SIGNS = "!@#$%^&*~+?"
_WORD = re.compile(rf"(?=[A-Za-z])(?:[a-z]++[_.])*+[A-Za-z]*+\d{{0,5}}+(?![^{_BREAK}])|([^{_BREAK}\d]*+\d[^{_BREAK}]*+)|([^{_BREAK}{_SIGNS}]*+[{_SIGNS}][^{_BREAK}]*+)|[^{_BREAK}]++")
_JOIN = re.compile(r"([\"'])[ \t]*[+.&][ \t]*\1|\"[ \t]+\"")
_DIGIT = re.compile(r"\d")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----((?:[^-]|-(?!----))*)")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=]{24,}")

# Names under which credentials are kept, in several languages, and the words that make such a name harmless.
_NAMES = (
    r"(?:pg|db|my|usr|user|root|admin|ftp|ssh|smtp|http|redis|mongo)?pass[_-]?(?:word|wd|wort|phrase|code)?s?|pwd|passw|(?:wifi|wpa\d?|pre[_-]?shared)?[_-]?psk|(?:unlock|recovery|seed|mnemonic|login|backup|master|security|signing|encryption|decryption|vault|wallet|access|safe)[_-]?phrase|t?otp[_-]?(?:seed|secret)|kennwort|mot[_-]?de[_-]?passe|clave(?:[_-]?(?:acceso|secreta))?|contrase(?:ñ|n)a|senha|has[lł]o|парол\w*|密码|密钥|口令|パスワード|"
    r"secret(?:s|[_-]?(?:key|value|access[_-]?key))?|token|api[_-]?key|apikey|bearer|jwt|credentials?|creds|authori[sz]ation|(?:proxy[_-]?)?auth(?:[_-]?(?:header|value|key|token|code))?|dsn|conn(?:ection)?[_-]?str(?:ing)?|(?:login|access|pin|auth|security|activation|unlock)[_-]?code|"
    r"(?:presented|given|sent|provided|supplied|received|expected|stored|access|account|aes|des|hmac|consumer|deploy|storage|encryption|encrypt|decryption|signing|signature|sign|private|master|session|license|licence|service|shared|shared[_-]?access|client|host|tls|ssl|ssh|gpg|pgp|webhook|push|app|application|bot|ldap|db|database|smtp|admin|root|crypto|cipher|symmetric|developer|integration|subscription|functions?|registry|cookie|salt|vault|kms|s3|cloud|server|rsa|ec|ecdsa|pem)[_-]?key"
)
_HARMLESS = r"label|hint|path|file|dir|name|env|var|ttl|len|length|min|max|state|status|type|kind|policy|count|field|id|ids|ref|url|uri|expir\w*|prompt|format|regex|pattern|rule\w*|text|title|message|msg|help|error|column|header_name|algo\w*|alg|cipher|size|bits|hash|digest|fingerprint|version|placeholder|example|sample|strength|reset|page|form|input|timeout|scope|issuer|audience|rotation|required|enabled|mode|public"
_NAME = re.compile(rf"(?i)(?<![a-zà-ÿ])(?:[\w-]*?[_\-.])??(?:{_NAMES})(?![a-zà-ÿ])|(?:(?<=[a-z0-9])|(?<![A-Za-z]))(?:Pass(?:word|wd|wort|phrase)?|Pwd|Passe|Psk|Secret|Token|ApiKey|Key|Jwt|Auth(?:orization|Header|Value)?|Bearer|Credentials?|Dsn|Acceso)(?![a-z])")
_LOOSE_KEY = re.compile(r"(?:^|[^A-Za-z])(?:[a-z]\w*)?Key$")
_KEY_OWNER = re.compile(r"(?i)(?:presented|given|sent|provided|supplied|received|expected|stored|access|account|aes|hmac|consumer|deploy|storage|encrypt\w*|sign\w*|private|master|session|licen[cs]e|service|shared|client|host|tls|ssl|ssh|webhook|push|app|api|bot|ldap|db|smtp|admin|root|crypto|cipher|secret|auth)[_-]?key$")
_TAIL = re.compile(rf"(?:[_\-. ]?(?i:{_HARMLESS}))(?![a-z])|(?:Label|Hint|Path|File|Name|Env|Ttl|Length|State|Type|Kind|Policy|Count|Field|Id|Ref|Url|Prompt|Format|Text|Hash|Mode)(?![a-z])")
_PUBLIC = re.compile(r"(?i)public|primary|foreign|sort|partition|cache|lookup|index|example|sample|dummy|fake|checksum|sha\d|md5|integrity|commit|etag|fingerprint")
_LOGIN = re.compile(r"(?i)(?:log_?in|log_?on|connect\w*|authenticate|auth|sign_?in|set_?credentials?|open_session|bind)\s*\($|(?i:(?:log_?in|log_?on|authenticate|sign_?in|set_?credentials?|basic_?auth)\w*\s*\([^)]*$)")
_USER = re.compile(r"(?:-u|--user)[ =]+[\"']?$")
_PASS_FLAG = re.compile(r"(?:--?(?:password|passwd|pass|token|secret|api-key)[ =]|sshpass -p ?)[\"']?$")

_ATTACHED = re.compile(r"-p([^\s\"']{6,})$")
_CLIENT = re.compile(r"(?i)\b(?:mysql\w*|mariadb\w*|mongo\w*|psql|sshpass|redis-cli|ldap\w*)\b")
_URL = re.compile(r"[A-Za-z][\w+.-]*://[^\s:/@]*:([^\s@/]+)@[\w.\[-]")
_PLACEHOLDER = re.compile(r"(?i)^(?:x{4,}|\*{3,}|\.{3,}|-{3,}|0{6,}|1234\d*|abc123\w{0,3}|(?:your|my|the|some|insert|enter|put|add|replace|change)[\w\-. ]*|change_?me\w*|redacted\w*|placeholder\w*|example\w*|sample\w*|dummy\w*|test(?:ing)?\w{0,6}|todo\w*|fixme\w*|none|null|nil|undefined|empty|password\d{0,3}|secret\d{0,3}|token\d{0,3}|foo\w*|bar\w*)$|(?i:example|placeholder|redacted|changeme|your[_-]|-here$|_here$|dummy)|^(.)\1+$")
_REFERENCE = re.compile(r"^(?:\$\{?|\{\{|%\(|%[A-Z]|<|@|#\{|env[.:(]|ENV\[|os\.|process\.|System\.|vault[:/]|secret[s]?[:/]|ref[:+]|arn:|ssm:|file:|kms:|op://|keyring:)|\$\{|\{\{|[a-z_]+\.[a-z_]+\(|://[^@]*$|\w==\w|\w&&\w")
_PATH = re.compile(r"^(?:[~.]{0,2}/)?(?:[a-z_.\-][\w.\-]*/)+[\w.\-]*$|^[A-Za-z]:\\|^[.~]?/")
_IDENTIFIER = re.compile(r"^(?:[A-Za-z]+[_.:-])*[A-Za-z]+[_.:-]?\d{0,5}$|^[A-Z][A-Z0-9_]+$|^[a-z]+(?:[A-Z][a-z]+)*\d{0,3}$|^[\w.]+\(\S*$|^\$?[a-z_]+(?:->|::|\.)\w+$|^[A-Za-z_$][\w$.]*[-+*/|&^]?=!?[A-Za-z_$][\w$.]*$|^[a-z_$][a-z_$.]*\d?(?:[=<>!+*/|&-]+|\+\+|--)\d{0,6}$")
_VERSION = re.compile(r"^v?\d+(?:[.:/-]\d+)*(?:[a-z]{0,5}\d*)?$|^\d{4}-\d\d|^[\d.,:%/+-]+$|^0x[0-9a-fA-F]{1,16}$")
_HOST = re.compile(r"^(?:[\w+.-]+://)?[\w-]+(?:\.[\w-]+)*\.(?:example|com|org|net|io|local|internal|dev|test|invalid|localhost|py|js|ts|go|java|c|h|cpp|cs|php|xml|json|yaml|ini|toml|md|txt|png|jpg|svg|css|html)(?::\d+)?(?:/\S*)?$")
_HEX = re.compile(r"^[0-9a-f]{24,}$|^[0-9A-F]{24,}$|^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
_FORM = re.compile(
    r"^(?:eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|(?:A3T|AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16}|gh[pousr]_\w{20,}|glpat-[\w-]{16,}|xox[abprs]-[\w-]{10,}|AIza[\w-]{30,}|SG\.[\w-]{12,}\.[\w-]{12,}|npm_\w{20,}|"
    r"[a-z]{2,6}[_-](?:(?:live|test|prod|sk|pk|tok|token|pat|key|secret|api|rk|at|rt)[_-])+[A-Za-z0-9]{14,}|[A-Z]{2,5}\.[A-Za-z0-9_-]{18,}|[a-z]{2,5}\d{1,2}-[A-Za-z0-9]{18,})$")


def structured(v: str) -> bool:
    """Whether a literal looks made by a machine or by a password rule, not a name, number, path, host or placeholder."""
    if not _DIGIT.search(v) or len(v) > 4096 or _PLACEHOLDER.search(v) or _REFERENCE.search(v) or _VERSION.match(v):
        return False
    if _HEX.match(v) or _FORM.match(v):
        return True
    if _IDENTIFIER.match(v) or _HOST.match(v) or (_PATH.match(v) and not (len(v) > 30 and any(c.isupper() for c in v) and v.count("/") < len(v) / 8)):
        return False
    lower, upper = any(c.islower() for c in v), any(c.isupper() for c in v)
    kinds = lower + upper + 1 + any(not c.isalnum() for c in v)
    return kinds >= 3 and len(v) >= 8 or kinds >= 2 and len(v) >= 16 and (lower or upper)


def mixed(v: str) -> bool:
    """Whether a literal has small and capital letters, digits and signs, as passwords by rule do; too weak without a name before it."""
    if len(v) < 8 or _PLACEHOLDER.search(v) or _REFERENCE.search(v) or _VERSION.match(v) or _HOST.match(v) or "/" in v or "(" in v:
        return False
    return any(c.islower() for c in v) and any(c.isupper() for c in v) and any(c.isdigit() for c in v) and any(not c.isalnum() for c in v)


def signed(v: str) -> bool:
    """Whether a literal without digits has small and capital letters and signs that no name or text has within a word."""
    return len(v) >= 10 and bool(_SIGN.search(v)) and any(c.islower() for c in v) and any(c.isupper() for c in v) and not any(c in "/(){}<>" for c in v) and not _PLACEHOLDER.search(v) and not _REFERENCE.search(v) and not _HOST.match(v)


def _basic(v: str) -> bool:
    try:
        raw = base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False
    return b":" in raw and 3 < len(raw) and all(32 <= x < 127 for x in raw)


def _named(before: str) -> bool:
    """Whether a credential's name stands right before the literal."""
    last = None
    for m in _NAME.finditer(before):
        last = m
    if not last:
        return False
    name = last.group()
    if name.lower().endswith("key") and name.lower().rsplit("key", 1)[0].rstrip("_-") == "" and not _KEY_OWNER.search(before[: last.end()]):
        return False
    rest = before[last.end():]
    if _TAIL.match(rest):
        return False
    word = re.search(r"[\w.-]*$", before[: last.start()])[0] + name
    if _PUBLIC.search(word):
        return False
    # what may stand between name and value: signs, a parenthesis, an environment look-up, a few words of a comment
    if len(rest) > 90 or rest.count(" ") > 8:
        return False
    return not re.search(r"[;{}]\s*\S{6,}", rest) or bool(re.search(r"[=:>]\s*[\"'`]?$", rest) and ";" not in rest)


def candidates(code: str) -> list[tuple[str, int, int]]:
    """(literal, line, evidence 0 or 1) of all structured literals; of a private key the literal is its BEGIN line and first body line."""
    out: list[tuple[str, int, int]] = []
    if "PRIVATE KEY" in code:
        for m in _PEM.finditer(code):
            body = m[2].replace("\\n", "\n").replace("\\r", "")
            if _PEM_BODY.search(body) and not re.search(r"(?i)redacted|\.\.\.|<.*>|xxxx", body):
                out.append((m.group()[:64] + _PEM_BODY.search(body)[0][:64], code.count("\n", 0, m.start()) + 1, 1))
    if "-----BEGIN" in code:
        code = re.sub(r"-----BEGIN [A-Z0-9 ]+-----[\s\S]*?(?:-----END [A-Z0-9 ]+-----|\Z)", lambda m: "\n" * m.group().count("\n"), code)
    joined = _JOIN.sub("", code)  # joints of strings hold no line end
    n = counted = begin = 0
    for m in _WORD.finditer(joined):
        k = m.lastindex
        if k is None:
            continue
        v = m[k]
        if len(v) < 6:
            continue
        a = m.start()
        if (last := joined.rfind("\n", counted, a)) >= 0:
            n += joined.count("\n", counted, a)
            begin = last + 1
        counted = a
        if "://" in v and (u := _URL.search(v)):
            if not _PLACEHOLDER.search(u[1]) and not _REFERENCE.search(u[1]) and not re.match(r"[A-Z_]+$", u[1]):
                out.append((v, n + 1, 1))
            continue
        if not _DIGIT.search(v):
            before = joined[max(begin, a - 400):a]
            if before[-1:] in ("\"", "'", "`") and signed(v) and _ASSIGNED.search(before) and _named(before):
                out.append((v, n + 1, 1))
            continue
        before = joined[max(begin, a - 400):a]
        if (k := _ATTACHED.match(v)) and _CLIENT.search(before) and structured(k[1]):
            out.append((k[1], n + 1, 1))
            continue
        if before.endswith("//") and not before.strip("/ "):
            continue
        if before.endswith(("Basic ", "basic ")) and _basic(v):
            out.append((v, n + 1, 1))
            continue
        if _USER.search(before) and ":" in v and structured(v.split(":", 1)[1]):
            out.append((v, n + 1, 1))
            continue
        cut = v
        # name=value and name:value without quotes
        if (k := re.match(r"([\w.-]*[A-Za-z][\w.-]*)(?:=|:|：|->|=>)+(?=\S{6,})", v)) and not _URL.search(v) and _NAME.search(k[1]):
            before, cut = before + k.group(), v[k.end():]
        elif (k := re.match(r"[\"'：:=>-]+", v)):
            before, cut = before + k.group(), v[k.end():]
        cut = cut.strip("：").rstrip(".:,!?") if not _HEX.match(cut) else cut
        if not cut or not structured(cut) and not ((before and before[-1] in "\"'`" or cut is not v or _REMARK.search(before)) and mixed(cut)):
            continue
        if _FORM.match(cut):
            own = _ASSIGNED.search(before)
            out.append((cut, n + 1, int(not own or not _PUBLIC.search(own[1]))))
            continue
        if begin and not before.strip("\"'` \t("):
            above = joined[joined.rfind("\n", 0, begin - 1) + 1:begin - 1]
            if re.search(r"[=(:,+>|{]\s*$", above):
                before = above.strip()[-120:] + " " + before.strip()
        strong = _named(before) or bool(_LOGIN.search(before)) or bool(_PASS_FLAG.search(before)) or bool(re.search(r"(?i)\bbearer\s+$", before))
        if strong or structured(cut) and before[-1:] in "\"'`" and before or _HEX.match(cut):
            out.append((cut, n + 1, int(strong)))
    return out


_SIGN = re.compile(r"[A-Za-z][!@#$%^&*~+?][A-Za-z]")
_ASSIGNED = re.compile(r"([\w.-]+)[\"'\])]*\s*(?:=>|->|:=|[=:])\s*[\"'`(@$]*$")
_REMARK = re.compile(r"(?:^|\s)(?:#|//|/\*|\*|--|<!--|;)(?=\s)")


def _index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        rows = []
        for i, repo, code in zip(*(b.column(k).to_pylist() for k in range(3))):
            if found := candidates(code):
                lines = code.split("\n")
                rows += [(v, i, repo, n, e, zlib.crc32(lines[n - 1].strip().encode("utf-8", "surrogatepass"))) for v, n, e in found]
        cols = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int8(), pa.int64()))], names=["literal", "file_id", "repo", "line_no", "evidence", "line_key"])


def index(files: DataFrame) -> DataFrame:
    """(literal, file_id, repo, line_no, evidence, line_key): every structured literal of the corpus, one row per place."""
    rows = files.where(F.col("file_id").isNotNull() & F.col("source_code").rlike(r"\S")).select(F.col("file_id").cast("long").alias("file_id"), F.coalesce("repo", F.lit("")).alias("repo"), "source_code")
    return common.spread(rows).mapInArrow(_index, "literal string, file_id long, repo string, line_no int, evidence byte, line_key long")


def confirmed(places: DataFrame, bound: int = MIN_OWNERS) -> DataFrame:
    """(literal) that have evidence somewhere and are no placeholder: not on more than bound lines of more than bound repositories, or of a known form."""
    per_line = places.groupBy("literal", "repo", "line_key").agg(F.max("evidence").alias("evidence"))  # partial aggregation absorbs a hot literal
    spread = per_line.groupBy("literal").agg(F.max("evidence").alias("evidence"), F.least(F.countDistinct("repo"), F.countDistinct("line_key")).alias("owners"))
    known_form = F.col("literal").startswith("-----BEGIN") | F.col("literal").rlike(_FORM.pattern)
    return spread.where((F.col("evidence") > 0) & (known_form | (F.col("owners") <= bound))).select("literal")


def _matches(a: ahocorasick.Automaton, text: str) -> Iterator[tuple[int, int, str]]:
    """(begin, end, secret) of the secrets in text; one that is part of a longer run of letters and digits is another literal."""
    for last, s in a.iter(text):
        b, e = last - len(s) + 1, last + 1
        attached = text[max(0, b - 2):b] == "-p"  # a password behind the flag of a command
        if (b == 0 or attached or not (text[b - 1].isalnum() and s[0].isalnum())) and (e >= len(text) or not (text[e].isalnum() and s[-1].isalnum())):
            yield b, e, s


def _places(code: str, secrets: list[str]) -> list[tuple[int, int, str]]:
    """(begin, line, secret) of every place of the secrets in code, by one automaton; also where a secret is cut into joined strings."""
    if not secrets:
        return []
    a = ahocorasick.Automaton()
    for s in secrets:
        a.add_word(s, s)
    a.make_automaton()
    return [(b, n + 1, s) for n, line in enumerate(code.split("\n")) if len(line) >= 6 for b, _, s in _matches(a, _JOIN.sub("", line))]


def _confirm(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file_id, line_no, literal) of the rows (file_id, line_no, word, literal) whose word holds the literal, by one automaton per batch."""
    for b in it:
        ids, lines, words, literals = (b.column(k).to_pylist() for k in range(4))
        known = set(literals)
        held: dict[str, set[str]] = {}
        if known:
            a = ahocorasick.Automaton()
            for s in known:
                a.add_word(s, s)
            a.make_automaton()
            held = {w: {s for _, _, s in _matches(a, w)} for w in set(words)}
        keep = [k for k, (w, s) in enumerate(zip(words, literals)) if s in held[w]]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in keep], t) for x, t in ((ids, pa.int64()), (lines, pa.int32()), (literals, pa.string()))], names=["file_id", "line_no", "literal"])


def _redact(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        out = []
        for i, code, secrets in zip(*(b.column(k).to_pylist() for k in range(3))):
            placed = {s for _, _, s in _places(code, [s for s in secrets if not s.startswith("-----BEGIN")])}
            secrets = [s for s in secrets if s in placed or s.startswith("-----BEGIN")]
            if secrets:
                out.append((i, *redact(code, secrets)))
        cols = list(zip(*out)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], names=["file_id", "redacted_code", "redacted"])


MASK = "REDACTED"


def redact(code: str, secrets: list[str]) -> tuple[str, int]:
    """(code with the secrets replaced, number of replacements).  Only the characters of the secret change: quotes, string joins and
    line ends stay, so that the code around it is as whole as before; of a private key the lines between BEGIN and END go."""
    n = 0
    for s in sorted(set(secrets), key=len, reverse=True):
        if s.startswith("-----BEGIN"):
            head, body = s[:64], s[64:]

            def pem(m: re.Match) -> str:
                nonlocal n
                if body[:16] and body[:16] not in m.group().replace("\\n", "\n"):
                    return m.group()
                n += 1
                return re.sub(r"[A-Za-z0-9+/=]{20,}|(?<=\n)[A-Za-z0-9+/=]+(?=[\r\n])", MASK, m[0]) if m[2] else m[0]

            del head
            code = _PEM.sub(pem, code)
            continue
        if s in code:
            n += code.count(s)
            if (u := _URL.search(s)):
                code = code.replace(s, s[: u.start(1)] + MASK + s[u.end(1):])
            else:
                code = code.replace(s, MASK)
            continue
        # joined strings: every character of the secret may be followed by a quote, a sign and a quote
        joint = r"(?:[\"'][ \t]*[+.&]?[ \t]*[\"'])?"
        rule = re.compile(joint.join(map(re.escape, s)))

        def cut(m: re.Match) -> str:
            nonlocal n
            n += 1
            return MASK + "".join(re.findall(r"[\"'][ \t]*[+.&]?[ \t]*[\"']", m.group()))

        code = rule.sub(cut, code)
    return code, n


# Runs of letters and digits, each with the signs that part it from the next one.
_RUN = re.compile(r"([^\W_]+)((?:(?:[^\w\s]|_)+(?=[^\W_]))?)")


def anchors(word: str) -> list[str]:
    """Every run of letters and digits of a word, and every two neighbours with what stands between them."""
    runs = _RUN.findall(word)
    return [r for r, _ in runs] + [a + sign + b for (a, sign), (b, _) in zip(runs, runs[1:])]


def anchor(secret: str) -> str:
    """What stands in every word that holds the secret, as its ends part no run: its longest two neighbours, at the password of a URL; else its only run."""
    runs = list(_RUN.finditer(secret))
    pairs = [(a.start(), b.end(1)) for a, b in zip(runs, runs[1:])]
    if (u := _URL.search(secret)):
        pairs = [(a, b) for a, b in pairs if a < u.end(1) and b > u.start(1)] or pairs
    if pairs:
        a, b = max(pairs, key=lambda p: p[1] - p[0])
        return secret[a:b]
    return runs[0][1] if runs else ""


def _bit(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % ANCHOR_BITS


def _anchored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        literals = b.column(0).to_pylist()
        keys = [anchor(s) for s in literals]
        yield pa.RecordBatch.from_arrays([pa.array(literals, pa.string()), pa.array(keys, pa.string()), pa.array([_bit(k) for k in keys], pa.int32())], names=["literal", "anchor", "bit"])


def _bitmap(bits: DataFrame) -> bytes:
    """The bits of the rows (bit); its size is fixed, whatever their number."""
    out = bytearray(ANCHOR_BITS >> 3)
    for row in bits.groupBy((F.col("bit") / (1 << 15)).cast("int").alias("part")).agg(F.collect_set("bit").alias("bits")).toLocalIterator():
        for k in row.bits:
            out[k >> 3] |= 1 << (k & 7)
    return bytes(out)


def _words(text: str) -> set[str]:
    """The words of text that may hold a secret: every secret has a digit or a sign and is no plain name."""
    return {a or b for a, b in _WORD.findall(text)} - {""}


def _sifted(files: DataFrame, known: DataFrame) -> DataFrame:
    """(file_id, line_no, word, anchor) of every word of every file that may hold a secret, with the anchor of that secret."""
    shared = files.sparkSession.sparkContext.broadcast(_bitmap(known.select("bit")))

    def words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, idle = shared.value, set()
        for b in it:
            rows = []
            for i, code in zip(*(b.column(k).to_pylist() for k in range(2))):
                if len(idle) > IDLE_WORDS:
                    idle.clear()
                held = {}
                joined = _JOIN.sub("", code)
                for w in _words(joined) - idle:
                    hits = {k for k in anchors(w) if bits[(n := _bit(k)) >> 3] >> (n & 7) & 1}
                    if hits:
                        held[w] = hits
                    else:
                        idle.add(w)
                if held:
                    rows += [(i, n, w, k) for n, line in enumerate(joined.split("\n"), 1) for w in _words(line) if w in held for k in held[w]]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["file_id", "line_no", "word", "anchor"])

    texts = files.where(F.col("file_id").isNotNull() & F.col("source_code").rlike(r"\S")).select(F.col("file_id").cast("long").alias("file_id"), "source_code")
    return common.spread(texts).mapInArrow(words, "file_id long, line_no int, word string, anchor string")


def located(files: DataFrame, owner_share: float = OWNER_SHARE, min_owners: int = MIN_OWNERS) -> DataFrame:
    """(file_id, line_no, literal) of every place of a confirmed secret, wherever it is; a place may come twice."""
    places = common.kept(index(files))
    repos = files.agg(F.countDistinct("repo")).first()[0]
    sure = common.kept(confirmed(places, max(min_owners, int(owner_share * repos))))
    block = F.col("literal").startswith("-----BEGIN")  # a private key has its BEGIN line in every place, so the index has them all
    known = common.kept(sure.where(~block).mapInArrow(_anchored, "literal string, anchor string, bit int"))
    found = _sifted(files, known).join(known, "anchor").select("file_id", "line_no", "word", "literal").mapInArrow(_confirm, "file_id long, line_no int, literal string")
    return found.unionByName(places.join(sure, "literal", "left_semi").select("file_id", "line_no", "literal"))


def secrets(files: DataFrame, owner_share: float = OWNER_SHARE, min_owners: int = MIN_OWNERS) -> DataFrame:
    """(file_id, line_no) of every line on which a literal secret begins."""
    return located(files, owner_share, min_owners).select("file_id", "line_no").distinct()


def redacted(files: DataFrame, owner_share: float = OWNER_SHARE, min_owners: int = MIN_OWNERS) -> DataFrame:
    """(file_id, redacted_code, redacted): files that hold secrets, with the secrets replaced and their number.

    Only files whose id is in a bitmap of the ids with secrets are moved to them.
    """
    pairs = located(files, owner_share, min_owners).select("file_id", "literal").distinct()
    per_file = common.kept(pairs.groupBy("file_id").agg(F.collect_list("literal").alias("secrets")))  # bounded by the file's own text
    bit = F.pmod(F.xxhash64("file_id"), F.lit(ANCHOR_BITS)).cast("int")
    shared = files.sparkSession.sparkContext.broadcast(_bitmap(per_file.select(bit.alias("bit"))))

    @F.pandas_udf("boolean")
    def held(bits: pd.Series) -> pd.Series:
        k = bits.to_numpy()
        return pd.Series(np.frombuffer(shared.value, dtype=np.uint8)[k >> 3] >> (k & 7) & 1 == 1)

    texts = files.where(F.col("file_id").isNotNull() & F.col("source_code").isNotNull()).select(F.col("file_id").cast("long").alias("file_id"), "source_code").where(held(bit))
    return texts.join(per_file, "file_id").dropDuplicates(["file_id"]).mapInArrow(_redact, "file_id long, redacted_code string, redacted int")
