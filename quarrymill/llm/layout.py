"""Generated, minified, vendored and data files among source code.

Each file is lexed into comments, literals and code by the rules of its family of languages (strings, templates, block comments
and docstrings may go over lines), and its code is re-emitted in a canonical layout: a blank or a line break behind every
token that has one there. The two layouts are compared, over code without comments and imports:

* minified: the canonical layout adds more than EXPANSION of the characters
* generated: UNIFORM of the canonical lines have one of two shapes (words and literals blanked out)
* data: literals take LITERALS of the characters, or four times as many as words, BLOB at least, and hardly a word stands outside literals
* generated, too: a comment before the first line of code says so; vendored: it names another project as the source, or
  the file lies in a library's folder of a folder for third-party code, or its code is that of such a file

How much a short file shows is bounded by chance (surely), not by a least size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.plans.session import cut, spread

EXPANSION = 0.08
UNIFORM = 0.9
LITERALS = 0.6
#: Deviations of Wilson's bound, and what it must show of expansion and uniformity.
SURE = 2.58
SURE_EXPANSION = 0.045
SURE_UNIFORM = 0.47
#: A blob of data has so many characters.
BLOB = 300
#: Shorter code is not looked for among vendored files.
LEAST_COPY = 120
#: Code has more different words than data, however long a literal it carries.
DATA_WORDS = 7

#: What generators write into the head of a file, in the languages of the data.
GENERATED_HEAD = re.compile(
    r"code generated by\b|do not edit(?: manually| by hand|[.!]?\s*(?:\*/)?$)|automatisch (?:erzeugt|generiert)|nicht von hand bearbeiten|fichier g[ée]n[ée]r[ée] (?:par|automatiquement)"
    r"|ne pas modifier|generado autom[áa]ticamente|generado por\b|no (?:editar|modificar)\b|file (?:was|is) (?:produced|generated|created) (?:by|automatically)"
    r"|edits are lost on the next run|^\W*auto-?generated\b|<auto-?generated\b|@generated\b|^\W*generated (?:from|by)\b.*|machine[ -](?:written|generated)|自動生成|編集しないで",
    re.I,
)
#: How copies of other projects name their source.
VENDORED_HEAD = re.compile(
    r"^\W*(?:copied|vendored|imported|taken) (?:verbatim )?from \S+ v?\d|^\W*übernommen aus \S+ v?\d|^\W*copi[ée] (?:de|depuis) \S+ v?\d|^\W*copiado de \S+ v?\d|^\W*@license\b"
    r"|^\W*upstream: |^\W*part of the \S+ project\b|\(c\) the \S+ contributors|^\W*\w[\w.-]* v\d+\.\d+\.\d+\W*$|upstream revision [0-9a-f]{6,}",
    re.I,
)
#: Folders that hold one folder for each third-party library.
VENDOR_FOLDERS = (
    "3rdparty bower_components carthage contrib deps external externals godeps jspm_packages node_modules pods "
    "site-packages third-party third_party thirdparty vendor vendored web_modules"
).split()

#: How the languages' comments and strings are written, by the ending of the file, else by its language.
FAMILIES = {
    "py": "hash", "pyi": "hash", "rb": "hash", "sh": "hash", "yaml": "hash", "yml": "hash", "toml": "hash", "r": "hash", "pl": "hash", "ex": "hash",
    "python": "hash", "ruby": "hash", "shell": "hash", "bash": "hash", "perl": "hash", "elixir": "hash",
    "php": "both", "rs": "rust", "rust": "rust",
    "sql": "dash", "lua": "dash", "hs": "dash", "haskell": "dash",
    "html": "tags", "htm": "tags", "xml": "tags", "vue": "tags", "svg": "tags",
}

_STRINGS = r"""(?P<s>(?:@|\$|[rRbBfFuU]{1,2})?(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|\'\'\'(?:\\.|[^\\])*?\'\'\')|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
_TEMPLATE = r"(?P<t>`(?:\\.|[^`\\])*`)"
_NUMBER = r"(?P<n>(?<![\w.])-?(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)\b)"
_REGEX = r"(?P<x>(?<=[(,=:\[!&|?;{}])[ ]?/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)"
_C = r"(?P<c>//[^\r\n]*|/\*.*?(?:\*/|\Z))"
_HASH = r"(?P<c>\#(?![\[!])[^\r\n]*|^=begin\b.*?(?:^=end\b|\Z))"
_BOTH = r"(?P<c>//[^\r\n]*|\#(?![\[!])[^\r\n]*|/\*.*?(?:\*/|\Z))"
_DASH = r"(?P<c>--\[\[.*?(?:\]\]|\Z)|--[^\r\n]*|/\*.*?(?:\*/|\Z)|\{-.*?(?:-\}|\Z))"
_TAGS = r"(?P<c><!--.*?(?:-->|\Z)|/\*.*?(?:\*/|\Z))"
_CHARS = r"""(?P<s>b?r\#+".*?"\#+|b?r?"(?:\\.|[^"\\])*"|b?'(?:\\[^'\n]+|[^'\\\n])'|(?:(?<=[(,=\[])|(?<=[(,=\[][ ]))'(?:\\.|[^'\\\n<>&])*')"""
#: The lexer of each family: comments, strings, templates, numbers; what is between them is code.
LEXERS = {
    name: re.compile("|".join(parts), re.S | re.M)
    for name, parts in {
        "c": (_C, _STRINGS, _TEMPLATE, _REGEX, _NUMBER), "hash": (_HASH, _STRINGS, _NUMBER), "both": (_BOTH, _STRINGS, _NUMBER),
        "rust": (_C, _CHARS, _NUMBER), "dash": (_DASH, _STRINGS, _NUMBER), "tags": (_TAGS, _STRINGS, _NUMBER),
    }.items()
}

_OPENER = re.compile(r"\s*(?:<\?php|#!|<\?xml|'use strict'|\"use strict\"|package\b)")
_IMPORT = re.compile(r"\s*(?:import\b|from\b|use\b|using\b|require\b|require_once\b|include\b|#include\b|package\b|const \w+ = require|<\?php\s*$|#!)")
_WORD = re.compile(r"[^\W\d]\w*")
#: Where the canonical layout has a blank or a line break behind a token.
_TIGHT = re.compile(r"[,;](?=[^\s)\]}])|(?<=[\w\)\]\"'])(?:[-+*/%]?=|==+|[<>]=?|&&|\|\||\?|\+|\*)(?=[\w(\[\"'!])|[{}](?=[^\s;,)}])|\)(?=[{\w])|(?<=\)):(?=\w)")
_SPACES = re.compile(r"[ \t]+")
_BREAKS = re.compile(r"\r\n|\r|\n")


def vendored_path(file: str | None, root: str | None) -> bool:
    """Whether file lies in FOLDER/library/... below root, FOLDER being one for third-party code."""
    if not file:
        return False
    root = (root or "").rstrip("/")
    rel = file[len(root) :] if root and file.startswith(root + "/") else file
    parts = [p for p in rel.lower().split("/") if p]
    return any(p in VENDOR_FOLDERS and k + 2 < len(parts) for k, p in enumerate(parts))


def family(file: str | None, language: str | None) -> str:
    """How a file's comments and strings are written: by its ending, else by its language, else as in C."""
    ending = file.rsplit(".", 1)[-1].lower() if file and "." in file.rsplit("/", 1)[-1] else ""
    known = FAMILIES.get(ending)
    return known or ("c" if ending else FAMILIES.get((language or "").strip().lower(), "c"))


class Lexed(NamedTuple):
    head: list[str]  #: lines of comments before the first line of code
    code: list[str]  #: lines of code without comments and imports, each literal reduced to 0
    plain: list[str]  #: the same lines with their literals
    literals: int  #: characters in literals of those lines


def lex(text: str, kind: str) -> Lexed:
    """Comments, literals and code of a text. Strings, templates, block comments and docstrings may go over lines.

    Inside the lexed text, a comment becomes a mark, a literal a mark with its number; lines are cut afterwards, so that
    neither hides a line break from the other.
    """
    comments: list[str] = []
    literals: list[str] = []

    def reduce(m: re.Match) -> str:
        got = m.group()
        if m.lastgroup == "c" or (kind == "hash" and m.lastgroup == "s" and got.endswith(('"""', "'''")) and _alone(text, m)):
            comments.append(got)
            return "\x01"
        literals.append(got)
        return "\x02"

    reduced = LEXERS[kind].sub(reduce, text.replace("\x01", " ").replace("\x02", " "))
    head: list[str] = []
    code: list[str] = []
    plain: list[str] = []
    size = c = n = 0
    began = False
    for line in _BREAKS.split(reduced):
        marks = line.count("\x01")
        if marks:
            if not began and not line.replace("\x01", "").strip():
                head += [x.strip() for k in range(c, c + marks) for x in _BREAKS.split(comments[k]) if x.strip()]
            c += marks
            line = line.replace("\x01", "")
        own = line.count("\x02")
        n += own
        bare = line.strip()
        if not bare:
            continue
        if not _OPENER.match(line):
            began = True
        inside = sum(map(len, literals[n - own : n]))
        if not _IMPORT.match(line) or len(bare) + inside > 300:
            size += inside
            code.append(bare.replace("\x02", "0"))
            parts = bare.split("\x02")
            plain.append("".join(x for pair in zip(parts, [*literals[n - own : n], ""]) for x in pair))
    return Lexed(head, code, plain, size)


def _alone(text: str, m: re.Match) -> bool:
    """Whether a literal is a statement of its own: nothing but blanks before it in its line."""
    line = max(text.rfind("\n", 0, m.start()), text.rfind("\r", 0, m.start())) + 1
    return not text[line : m.start()].strip()


def canonical(code: list[str]) -> list[str]:
    """Code lines in the canonical layout: a blank or a line break behind every token that has one there, blanks never doubled."""
    return _TIGHT.sub(r"\g<0> ", _SPACES.sub(" ", "\n".join(code))).split("\n")


def surely(part: float, whole: float) -> float:
    """A share that part of whole shows beyond chance: Wilson's lower bound. Little evidence shows little, without a least size."""
    if whole <= 0:
        return 0.0
    p = min(1.0, part / whole)
    z2 = SURE * SURE
    return (p + z2 / (2 * whole) - SURE * ((p * (1 - p) + z2 / (4 * whole)) / whole) ** 0.5) / (1 + z2 / whole)


class Measures(NamedTuple):
    expansion: float  #: blanks that the canonical layout adds, against characters of code
    added: int
    uniform: float  #: share of the lines that have one of the two most frequent shapes
    lines: int
    literal: float  #: share of the characters in literals
    words: int  #: different words outside literals, where literals prevail
    size: int


def measures(lexed: Lexed) -> Measures:
    """What a text's code lacks against its canonical layout."""
    code = lexed.code
    if not code:
        return Measures(0.0, 0, 0.0, 0, 0.0, 0, 0)
    bare = _SPACES.sub(" ", "\n".join(code))
    laid = canonical(code)
    added = sum(map(len, laid)) + len(laid) - 1 - len(bare)
    size = sum(map(len, lexed.plain)) + len(lexed.plain) - 1
    literal = lexed.literals / max(1, size)
    shapes = Counter(_WORD.sub("w", x) for x in laid)
    uniform = sum(n for _, n in shapes.most_common(2)) / len(laid)
    found = _WORD.findall(bare) if literal >= LITERALS / 2 else []
    if LITERALS / 2 <= literal < LITERALS and 4 * sum(map(len, found)) <= literal * size:  # short numbers, long lists of them
        literal = LITERALS
    return Measures(added / max(1, len(bare)), added, uniform, len(laid), literal, len(set(found)), size)


def judged(text: str, file: str | None, root: str | None, language: str | None) -> tuple[bool, bool, bool, bool, str | None]:
    """generated, minified, vendored, data, and a hash of the code, of one file."""
    lexed = lex(text, family(file, language))
    m = measures(lexed)
    data = m.literal >= LITERALS and m.words <= DATA_WORDS and m.size >= BLOB
    minified = m.expansion > EXPANSION and surely(m.added, m.added / m.expansion) > SURE_EXPANSION
    even = m.uniform >= UNIFORM and surely(m.uniform * m.lines, m.lines) >= SURE_UNIFORM and not minified and not data
    generated = even or any(GENERATED_HEAD.search(x) for x in lexed.head)
    vendored = vendored_path(file, root) or any(VENDORED_HEAD.search(x) for x in lexed.head)
    return generated, minified, vendored, data, hash_of(lexed.plain) if m.size >= LEAST_COPY else None


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    text_or_none = lambda x: x if isinstance(x, str) else None
    for b in batches:
        rows = [judged(text_or_none(t) or "", *map(text_or_none, x)) for t, *x in zip(b.text, b.file, b.root_path, b.language)]
        cols = list(zip(*rows)) or [()] * 5
        yield pd.DataFrame({"doc_id": b.doc_id, **dict(zip(("generated", "minified", "vendored", "data", "code_hash"), map(list, cols)))})


def hash_of(code: list[str]) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest("\n".join(code))


def described_files(documents: DataFrame) -> DataFrame:
    """doc_id, generated, minified, vendored, data (booleans) and code_hash of each document of source source_file.

    A null or empty text is none of them by its layout, but may still be vendored by its path.
    """
    language = F.col("language") if "language" in documents.columns else F.lit(None).cast("string").alias("language")
    rows = spread(documents.where(F.col("source") == "source_file").select("doc_id", "text", "file", "root_path", language))
    return rows.mapInPandas(_describe, "doc_id bigint, generated boolean, minified boolean, vendored boolean, data boolean, code_hash string")


def not_hand_written(documents: DataFrame) -> DataFrame:
    """doc_id, kinds (array of generated, minified, vendored, data) of each source file that nobody wrote by hand.

    Files with the code of a vendored file (comments and imports apart) are vendored as well, wherever they lie.
    """
    files = cut(described_files(documents))
    third = files.where("vendored AND code_hash IS NOT NULL").select("code_hash").distinct()
    # All files of one text have one hash, so only those not yet known are looked up: no join on a hot hash.
    copies = files.where("NOT vendored AND code_hash IS NOT NULL").select("doc_id", "code_hash").join(third, "code_hash", "left_semi").select("doc_id", F.lit(True).alias("copy"))
    marked = files.join(copies, "doc_id", "left").withColumn("vendored", F.col("vendored") | F.coalesce("copy", F.lit(False)))
    kinds = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("generated", "minified", "vendored", "data")]))
    return marked.select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)
