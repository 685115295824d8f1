"""Credentials embedded in code, configuration and notes, found with their place and redacted.

One deterministic automaton (Aho-Corasick) holds every way in which a credential announces itself: prefixes of token
formats, key armor, the scheme mark of connection strings, header schemes, command flags, phrases and the names of
secrets. A text is scanned once, in overlapping chunks; each hit gives an absolute position at which the small grammar of
its kind is tried on the whole text, so nothing is lost or found twice at a chunk's border. Overlapping spans are merged,
and placeholders are spliced into the value spans alone, so that the code around them stays as it was.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = "[REDACTED]"
CHUNK = 65_536

#: Prefixes of public token formats, each with what follows it.
TOKENS = {
    "AKIA": r"[A-Z0-9]{16}",
    "ASIA": r"[A-Z0-9]{16}",
    "ghp_": r"[A-Za-z0-9]{30,}",
    "gho_": r"[A-Za-z0-9]{30,}",
    "ghu_": r"[A-Za-z0-9]{30,}",
    "ghs_": r"[A-Za-z0-9]{30,}",
    "ghr_": r"[A-Za-z0-9]{30,}",
    "github_pat_": r"\w{22,}",
    "glpat-": r"[\w-]{20,}",
    "xoxb-": r"[\w-]{20,}",
    "xoxp-": r"[\w-]{20,}",
    "xoxa-": r"[\w-]{20,}",
    "xoxs-": r"[\w-]{20,}",
    "xapp-": r"[\w-]{20,}",
    "sk_live_": r"[A-Za-z0-9]{16,}",
    "sk_test_": r"[A-Za-z0-9]{16,}",
    "rk_live_": r"[A-Za-z0-9]{16,}",
    "SG.": r"[\w-]{16,}\.[\w-]{16,}",
    "npm_": r"[A-Za-z0-9]{30,}",
    "AIza": r"[\w-]{30,}",
    "eyJ": r"[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}",
    "pypi-": r"[\w-]{40,}",
    "hf_": r"[A-Za-z0-9]{30,}",
    "dop_v1_": r"[0-9a-f]{40,}",
    "shpat_": r"[0-9a-f]{30,}",
    "ya29.": r"[\w-]{30,}",
}
#: Ends of names that hold secrets, in the languages of the data (lower case; '_' may be left out).
NAMES = (
    "password passwd passwort kennwort pwd pw pass passphrase pass_phrase passcode motdepasse mot_de_passe contrasena contraseña senha secret token "
    "apikey api_key api-key accesskey access_key access-key secretkey secret_key privatekey private_key encryptionkey encryption_key signingkey "
    "signing_key hmackey hmac_key licensekey license_key masterkey master_key accountkey account_key auth auth-token private-token credential credentials"
).split()
#: Parameters of an address that carry a secret.
PARAMETERS = "token access_token auth_token api_key apikey key sig signature secret password passwd pwd auth".split()
#: How notes announce a secret at the end of a line.
PHRASES = ("pw until", "temp pw", "old token", "login is", "use pin", "pin is", "pin:", "passcode is", "password is", "passwort ist", "zugang ")

_QUOTE = r"\"\"\"|'''|\"|'|`"
_SEP = re.compile(r"[\"'\]]{0,2}[ \t]*(?:=>|:=|=(?!=)|:(?!:))[ \t]*")
_OPEN = re.compile(rf"([fFbBrRuU]{{0,2}})({_QUOTE})")
_JOIN = re.compile(rf"[ \t]*(?:\+|\.\.?|<>|\\)?[ \t]*(?:\r?\n[ \t]*(?:\+|\.\.?|<>)?[ \t]*)?({_QUOTE})")
_JOINED = re.compile(r"[ \t]*(?:\+|\.\.?|<>|\\)|[ \t]*\r?\n[ \t]*(?:\+|\.\.?|<>)")
_REST = re.compile(r"[^\s\"'`;]+")
_PART = re.compile(r"[^\s\"'`;&]+")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,\-]|\\[nr]|[\"'][ \t]*\+?[ \t]*\r?\n?[ \t]*[\"'])*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PEM_OPEN = re.compile(r"(?:[A-Za-z0-9+/=]{20,}|[A-Za-z0-9+/]+={0,3}(?=\\n|\s|$)|\\[nr]|[ \t\r\n])*")
_URL = re.compile(r"://([^\s:/@\"'`<>?#]{0,256}):([^\s/\"'`<>]{1,512}?)@(?=[\w\[${.-])")
_BEARER = re.compile(r"(?:bearer|token)[ \t]+([A-Za-z0-9._~+/=\-]{8,})", re.I)
_BASIC = re.compile(r"basic[ \t]+([A-Za-z0-9+/]{6,}={0,2})", re.I)
_HEADER = re.compile(r"[\"']?[ \t]*[:,=][ \t]*[\"']?([^\s\"'`<>${}]{8,})")
_COOKIE = re.compile(r"cookie[\"']?[ \t]*[:=][ \t]*[\"']?[\w-]*(?:sess|sid|token|auth)[\w-]*=([^\s\"'`;<>${}]{6,})", re.I)
_FLAG = re.compile(r"-p([\"']?)([^\s\"'`<>|;]{4,})")
_CLIENT = re.compile(r"\b(?:mysql|mariadb|mysqldump|mysqladmin|mongo|sqlcmd)\b")
_USER = re.compile(r"(?:-u|--user)[ =]?([\"']?)[^\s:\"'`$]{1,128}:([^\s\"'`]{4,256})")
_FETCH = re.compile(r"\b(?:curl|wget|http|https|svn)\b")
#: What stands before a name inside a list of settings: quoted, and not quoted (connection strings of a properties file).
_LISTED = re.compile(r"[;&?][ \t]*[\w ]*$|[\"'][\w ]*$")
_CONNECTED = re.compile(r"(?:^|[\w.\]])[ \t]*[=:][^\"'`\n]*[\w=/][^\"'`\n]*;[ \t]*[\w ]*$")
#: A name handed to a command: docker run -e NAME=, java -Dname=.
_HANDED = re.compile(r"(?:^|\s)(?:-e|--env|--build-arg|--set|-D|env)[ =]?[\w.\-]*$")
_CALLED = re.compile(r"[A-Za-z_][\w.]*(?:\(.*\)|\[.*\])$|[A-Za-z_.]+[(\[]")
_SETTING = re.compile(r"[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+|//\S*:)?[\w.\-]*$")
_CALL = re.compile(rf"\w*\([ \t]*(?:\w+[ \t]*,[ \t]*)?({_QUOTE})")
_DEFAULT = re.compile(rf"[\"'\]]?[ \t]*(?:,|\)[ \t]*\{{|\]?[ \t]*(?:\|\||\?\?|\?:|\bor\b))[ \t]*({_QUOTE})")
_ENV = re.compile(r"(?:getenv\(|get_env\(|environ\.get\(|process\.env[.\[]|ENV\.fetch\(|env\(|getProperty\()[ \t]*[\"']?\w*$", re.I)
_XMLVALUE = re.compile(r"[\"'][ \t]+value[ \t]*=[ \t]*([\"'])")
_XMLTEXT = re.compile(r">[ \t]*([^\s<>]{4,})[ \t]*</")
_NOTE_VALUE = re.compile(r"(?:[^\n:/]{0,60}[:/]|[^\n:/]{0,12}?)[ \t]+([^\s\"'`<>]{5,})[ \t]*(?:-->|\*/)?[ \t]*(?=\r?\n|$)")
_COMMENT = re.compile(r"[ \t]*(?://|#|<!--|/?\*|--|;|\"\"\"|REM\b)", re.I)
_REFERENCE = re.compile(r"\$\{|\$\(|\{\{|<%|%\(|\$[A-Za-z_]\w*$|\{[\w.\[\]\"']+\}$|#\{|@@|%[sd]$|\$env:")
_DUMMY = re.compile(
    r"(?:[x*.\-_#•0]+|your[-_ ]?.*|.*[-_]here|<.*>?|change[-_]?me.*|replace[-_]?me.*|todo.*|example.*|placeholder.*|redacted.*|dummy.*|sample[-_]?(?:key|token|secret|password)|insert[-_].*"
    r"|none|null|nil|undefined|true|false|empty|string|str|text|bool|boolean|int|number|any|object|bytes|required|optional|unset)$",
    re.I,
)
_ROOT = re.compile(r"(?:process|os|env|config|cfg|conf|settings|secrets?|vault|ctx|context|system|deno)\.|(?:self|this|props|properties|options|opts|args|params|request|req|app|data|var|local|module|each)\.[A-Za-z_.]+$", re.I)
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Endings of files that hold settings, where a bare value needs no sign that it is none of code.
SETTINGS = "env properties ini cfg conf config toml yaml yml tfvars npmrc netrc pgpass".split()
#: A longer value is no credential; so far back a name or a command is looked for. Bounds the work at each hit, however long a line is.
LONGEST = 4096
BEFORE = 2000


class Text:
    """A text with its line starts and quotes, so that each hit is placed in constant time on lines of any length."""

    def __init__(self, text: str, file: str | None = None):
        self.text = text
        self.settings = bool(file) and file.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() in SETTINGS
        self._lines: list[int] | None = None
        self._quotes: list[int] | None = None

    def line(self, at: int) -> int:
        """Where the line of a place begins."""
        if self._lines is None:
            self._lines = [0, *(m.end() for m in re.finditer("\n", self.text))]
        return self._lines[bisect_right(self._lines, at) - 1]

    def quoted(self, line: int, at: int) -> bool:
        """Whether a place lies between quotes, by how many there are before it in its line."""
        if self._quotes is None:
            self._quotes = [m.start() for m in re.finditer("[\"']", self.text)]
        return (bisect_left(self._quotes, at) - bisect_left(self._quotes, line)) % 2 == 1

    def before(self, line: int, at: int) -> str:
        return self.text[max(line, at - BEFORE) : at]


def _build():
    import ahocorasick

    a = ahocorasick.Automaton()

    def put(word: str, kind: str, extra: object) -> None:
        have = a.get(word, None)
        a.add_word(word, (*(have or ()), (kind, len(word), extra)))

    for prefix, rest in TOKENS.items():
        put(prefix.translate(_LOWER), "token", re.compile(re.escape(prefix) + rest))
    put("-----begin ", "pem", None)
    put("://", "url", None)
    for scheme in ("bearer ", "basic "):
        put(scheme, scheme.strip(), None)
    for header in ("private-token", "x-api-key", "x-auth-token", "x-access-token"):
        put(header, "header", None)
    put("cookie", "cookie", None)
    put(" -p", "flag", None)
    put(" -u", "user", None)
    put(" --user", "user", None)
    put(".login(", "login", None)
    for p in PARAMETERS:
        put(f"?{p}=", "parameter", None)
        put(f"&{p}=", "parameter", None)
    for p in PHRASES:
        put(p, "note", None)
    for n in NAMES:
        put(n.translate(_LOWER), "name", None)
    a.make_automaton()
    return a


_AUTOMATON = None


def automaton():
    """The automaton of this process, built on first use."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = _build()
    return _AUTOMATON


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _random(letters: str) -> bool:
    """Whether a run of letters is no word or name: too many changes of case, or too few vowels."""
    if len(letters) < 8:
        return False
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+", letters)
    if letters.lower() != letters and letters.upper() != letters:
        return len(letters) / len(parts) < 3.3
    return sum(c in "aeiouAEIOU" for c in letters) < 0.25 * len(letters)


def _mixed(value: str) -> bool:
    """Whether $... is no variable's name: a digit amid letters of both cases."""
    return bool(re.fullmatch(r"\$\w{6,}", value) and re.search(r"\d[A-Za-z]", value) and value.lower() != value != value.upper())


def plausible(value: str, bare: bool = False, named: bool = False) -> bool:
    """Whether a value in the place of a secret is one: no placeholder, reference, prose or address.

    A literal behind a name (named) may have four characters, and one blank if it is no prose, that is, with a digit in it.
    """
    if not (4 if named else 5) <= len(value) <= LONGEST or len(set(value)) < 3:
        return False
    blanks = sum(c.isspace() for c in value)
    if blanks and not (named and blanks == 1 and value.strip() == value and any(c.isdigit() for c in value)):
        return False
    if _DUMMY.match(value) or value.endswith("EXAMPLE") or "EXAMPLEKEY" in value or _REFERENCE.match(value) and not _mixed(value) or "${" in value or "://" in value or "{{" in value:
        return False
    if re.fullmatch(r"[A-Z][A-Z0-9_]*", value) and any(n.upper() in value for n in ("PASS", "SECRET", "TOKEN", "_KEY", "APIKEY", "AUTH", "PWD")) and not value.startswith(("AKIA", "ASIA")):
        return False
    if bare:
        if re.fullmatch(r"[A-Za-z_]+", value) and not _random(value) or _ROOT.match(value):
            return False
        if re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", value) and not re.search(r"\d", value):
            return False
    return True


def _quoted(text: str, at: int, quote: str) -> tuple[int, list[tuple[int, int]]] | None:
    """End and pieces of the literal that begins after its opening quote at `at`, and of those joined to it."""
    pieces: list[tuple[int, int]] = []
    while True:
        end = at
        while True:
            end = text.find(quote, end, at + LONGEST)
            if end < 0 or ("\n" in text[at:end] and len(quote) == 1 and quote != "`"):
                return (at, pieces) if pieces else None
            back = end - 1
            while back >= at and text[back] == "\\":
                back -= 1
            if (end - 1 - back) % 2 == 0:
                break
            end += 1
        pieces.append((at, end))
        after = end + len(quote)
        if not _JOINED.match(text, after):
            return after, pieces
        more = _JOIN.match(text, after)
        if not more:
            return after, pieces
        quote, at = more[1], more.end()


def _literal(text: str, at: int, quote: str, prefix: str = "", named: bool = False) -> list[tuple[int, int]]:
    got = _quoted(text, at, quote)
    if not got or not got[1]:
        return []
    value = "".join(text[a:b] for a, b in got[1])
    if "f" in prefix.lower() and "{" in value or quote == "`" and "${" in value:
        return []
    return got[1] if plausible(value, named=named) else []


def _after_name(place: Text, start: int, end: int) -> list[tuple[int, int]]:
    """The value of a name that ends at `end`, as pieces."""
    text = place.text
    nxt = text[end : end + 1]
    if nxt and _word(nxt):
        return _setter(text, start, end)
    head = text[max(0, start - 60) : end]
    if nxt == ">":
        m = _XMLTEXT.match(text, end)
        opened = re.search(r"<[\w:.-]*$", head)
        return [m.span(1)] if m and opened and plausible(m[1]) else []
    m = _XMLVALUE.match(text, end)
    if m:
        return _literal(text, m.end(), m[1])
    m = _DEFAULT.match(text, end)
    if m and _ENV.search(head):
        return _literal(text, m.end(), m[1])
    if nxt == "(":
        return _setter(text, start, end)
    m = _SEP.match(text, end)
    if not m:
        return []
    at = m.end()
    q = _OPEN.match(text, at)
    if q:
        if _PEM.match(text, q.end()):
            return []
        return _literal(text, q.end(), q[2], q[1], named=True)
    # A bare value: of a setting (rest of the line), or of a list of settings inside a literal.
    line = place.line(start)
    before = place.before(line, start)
    assigned = "=" in m[0] and not m[0].strip(" \t=") and " " not in m[0]  # NAME=value of an environment or a properties file
    if place.quoted(line, start):
        v = _PART.match(text, at, at + LONGEST + 1)
        return [v.span()] if v and _LISTED.search(before[-120:]) and plausible(v[0]) else []
    if assigned and (_CONNECTED.search(before[-400:]) or _HANDED.search(before[-200:])):
        v = _PART.match(text, at, at + LONGEST + 1)
        return [v.span()] if v and plausible(v[0]) else []
    if (start - line < BEFORE and _SETTING.fullmatch(before)) or _COMMENT.match(text, line, start):
        v = _REST.match(text, at, at + LONGEST + 1)
        if not v:
            return []
        a, b = v.span()
        variable = assigned and re.fullmatch(r"[ \t]*(?:(?:export|set)[ \t]+)?[A-Z0-9_.\-]+=", text[max(line, at - BEFORE) : at])
        if variable:  # of an environment: no code but a call may stand here
            if _CALLED.match(v[0]):
                return []
        elif text[b : b + 1] == ";" or v[0].endswith((",", ")")) or re.search(r"[A-Za-z_]\w*[(\[]", v[0]):
            return []
        return [(a, b)] if plausible(v[0], not ((assigned or place.settings) and v[0].isalpha())) else []
    return []


def _setter(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The literal in obj.setSecret(...), withPassword(ctx, ...), basicAuth(...): a method whose name ends with a secret's."""
    if text[end : end + 1] != "(":
        return []
    m = re.search(r"(?:\.|->|::)(\w*)$", text[max(0, start - 40) : start])
    if not m or m[1].lower().startswith(("get", "read", "fetch", "find", "check", "has", "is", "valid", "verify", "hash", "load")):
        return []
    m = _CALL.match(text, end)
    return _literal(text, m.end(), m[1]) if m else []


def _name_begins(text: str, start: int, word: str) -> bool:
    """Short names must be a word of their own: _pw, dbPass, PASS, but not compass."""
    if len(word) > 4 or start == 0:
        return True
    before = text[start - 1]
    if not before.isalpha():
        return True
    return (before.islower() and text[start].isupper()) or (before.isupper() and text[start : start + len(word)].isupper() and len(word) > 2)


def _table(place: Text, start: int, end: int) -> list[tuple[int, int]]:
    """The value below a column whose title is a secret's name (separated values)."""
    text = place.text
    line, stop = place.line(start), text.find("\n", end, end + BEFORE)
    if stop < 0 or start - line > BEFORE:
        return []
    title = text[line:stop].rstrip("\r")
    sep = next((s for s in (";", "\t", "|", ",") if s in title), None)
    if not sep or not re.fullmatch(r"[\w \-]+", title.replace(sep, "")):
        return []
    col = title[: start - line].count(sep)
    if title.split(sep)[col].strip() != text[start:end].strip() and not title.split(sep)[col].strip().lower().endswith(text[start:end].lower()):
        return []
    out, at = [], stop + 1
    n = title.count(sep)
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        row = text[at:stop].rstrip("\r")
        if row.count(sep) != n or " " in row.split(sep)[0]:
            break
        cells = row.split(sep)
        a = at + sum(len(c) + 1 for c in cells[:col])
        if plausible(cells[col]):
            out.append((a, a + len(cells[col])))
        at = stop + 1
    return out


def _at(place: Text, kind: str, start: int, end: int, extra) -> list[list[tuple[int, int]]]:
    """Credentials announced by a hit at start..end, each a list of spans."""
    text = place.text
    if kind == "token":
        m = extra.match(text, start)
        if m and not (start and _word(text[start - 1])) and not (m.end() < len(text) and _word(text[m.end()])) and plausible(m[0]):
            return [[m.span()]]
    elif kind == "pem":
        m = _PEM.match(text, start)
        if m:
            close, again = text.find("-----END ", m.end()), text.find("-----BEGIN ", m.end())
            whole = close >= 0 and (again < 0 or close < again)
            body = whole and _PEM_BODY.match(text, m.end()) or _PEM_OPEN.match(text, m.end())
            stop = body.end() if body else m.end()
            return [[(start, start + len(text[start:stop].rstrip()))]]
    elif kind == "url":
        m = _URL.match(text, start)
        if m and plausible(m[2]) and not m[2].startswith(("{", "$", "<", "%")):
            return [[m.span(2)]]
    elif kind == "bearer":
        m = _BEARER.match(text, start)
        if m and plausible(m[1]) and (re.search(r"\d", m[1]) or _random(m[1])) and not text[m.end() : m.end() + 1] == "(":
            return [[m.span(1)]]
    elif kind == "basic":
        m = _BASIC.match(text, start)
        if m:
            try:
                plain = base64.b64decode(m[1] + "=" * (-len(m[1]) % 4))
            except (binascii.Error, ValueError):
                plain = b""
            if b":" in plain and len(plain.split(b":", 1)[1]) > 2:
                return [[m.span(1)]]
    elif kind == "header":
        m = _HEADER.match(text, end)
        if m and plausible(m[1]):
            return [[m.span(1)]]
    elif kind == "cookie":
        m = _COOKIE.match(text, start)
        if m and plausible(m[1]):
            return [[m.span(1)]]
    elif kind == "flag":
        m = _FLAG.match(text, start + 1)
        if m and _CLIENT.search(place.before(place.line(start), start)) and not m[2].startswith("$") and plausible(m[2]):
            return [[m.span(2)]]
    elif kind == "user":
        m = _USER.match(text, start + 1)
        if m and _FETCH.search(place.before(place.line(start), start)) and not m[2].startswith("$") and plausible(m[2]):
            return [[m.span(2)]]
    elif kind == "login":
        m = _CALL.match(text, end - 1)
        spans = _literal(text, m.end(), m[1]) if m else []
        if spans and (re.search(r"\d|[-.+/=]", value := "".join(text[a:b] for a, b in spans)) or _random(value)):
            return [spans]
    elif kind == "parameter":
        m = re.compile(r"[^\s\"'`&#<>;]{6,}").match(text, end)
        if m and plausible(m[0]) and (re.search(r"[\d\-._]", m[0]) or len(m[0]) >= 16):
            return [[m.span()]]
    elif kind == "note":
        line = place.line(start)
        if _COMMENT.match(text, line, start if start > line else line + 3):
            m = _NOTE_VALUE.match(text, end)
            if m and plausible(m[1]) and re.search(r"[\d\-._!?#$]", m[1]) and not m[1].endswith((".", "?", "!;", ";")) | bool(re.fullmatch(r"[A-Za-z]+[!.?;]", m[1])):
                return [[m.span(1)]]
            if m and plausible(m[1]) and re.search(r"\d", m[1]):
                return [[m.span(1)]]
    elif kind == "name":
        if _name_begins(text, start, text[start:end]):
            spans = _after_name(place, start, end)
            if spans:
                return [spans]
            return [[s] for s in _table(place, start, end)] if text[end : end + 1] in "\r\n;,\t|" and end < len(text) else []
    return []


def find_credentials(text: str, chunk: int = CHUNK, file: str | None = None) -> list[list[tuple[int, int]]]:
    """Credentials of a text in order, each the spans (from 0, end excluded) of its value: one, or one for each joined literal.

    file, where its ending is that of a settings file, allows bare values of letters alone. Overlapping credentials are one.
    """
    if not text:
        return []
    a = automaton()
    low = text.translate(_LOWER)
    place = Text(text, file)
    overlap = 32  # longer than any word of the automaton
    hits: set[tuple[int, int, str]] = set()
    found: list[list[tuple[int, int]]] = []
    for base in range(0, len(low), chunk):
        for last, words in a.iter(low[base : base + chunk + overlap]):
            for kind, size, extra in words:
                start = base + last - size + 1
                if (start, size, kind) not in hits:
                    hits.add((start, size, kind))
                    found += _at(place, kind, start, start + size, extra)
    found.sort(key=lambda s: (s[0][0], -s[-1][1]))
    out: list[list[tuple[int, int]]] = []
    for spans in found:
        if out and spans[0][0] < out[-1][-1][1]:
            begin, end = out[-1][-1]
            if spans[-1][1] > end:  # what reaches beyond is part of it
                out[-1] = [*out[-1][:-1], (begin, spans[-1][1])]
            continue
        out.append(spans)
    return out


def spliced(text: str, found: list[list[tuple[int, int]]], placeholder: str = PLACEHOLDER) -> str:
    """text with the spans of every credential replaced (of joined literals the first; the others become empty)."""
    out, at = [], 0
    for spans in found:
        for k, (a, b) in enumerate(spans):
            out += [text[at:a], placeholder if k == 0 else ""]
            at = b
    return "".join(out) + text[at:]


def redact(text: str | None, placeholder: str = PLACEHOLDER, file: str | None = None) -> str | None:
    """text with every credential's value replaced; null stays null."""
    return spliced(text, find_credentials(text, file=file), placeholder) if text else text


def _rows(rows: DataFrame, key: str, text: str, file: str | None) -> DataFrame:
    path = F.col(file) if file else F.lit(None).cast("string")
    return rows.where(F.length(text) > 0).select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"), path.alias("file"))


def _found(b: pd.DataFrame) -> Iterator[tuple[int, str, list[list[tuple[int, int]]]]]:
    for i, t, f in zip(b.row_id, b.text, b.file):
        found = find_credentials(t, file=f if isinstance(f, str) else None) if isinstance(t, str) else []
        if found:
            yield i, t, found


def credential_places(rows: DataFrame, key: str, text: str, file: str | None = None) -> DataFrame:
    """row_id, start_pos, end_pos (characters, from 1, end included) of each credential in a text column; repeated rows count once.

    Null and empty texts have none; rows with a null key keep it. file names the column with the text's path, if there is one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, spans[0][0] + 1, spans[-1][1]) for i, _, found in _found(b) for spans in found]
            if out:
                yield pd.DataFrame(out, columns=["row_id", "start_pos", "end_pos"])

    return _rows(rows, key, text, file).mapInPandas(run, "row_id bigint, start_pos bigint, end_pos bigint").distinct()


def redacted(rows: DataFrame, key: str, text: str, file: str | None = None) -> DataFrame:
    """row_id, redacted text, credentials (their number) of each different row with a credential. A text is scanned once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, spliced(t, found), len(found)) for i, t, found in _found(b)]
            if out:
                yield pd.DataFrame(out, columns=["row_id", "text", "credentials"])

    return _rows(rows, key, text, file).mapInPandas(run, "row_id bigint, text string, credentials bigint").distinct()
