"""Text scanning and weighting: tokens, tf-idf, BM25, patterns, personal data, entropy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Personal data by pattern (a common subset of regular expression dialects) and what replaces it.
PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "[EMAIL]"),
    "ipv4": (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "[IP]"),
    "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[SSN]"),
    "card": (r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "[CARD]"),
    "phone": (r"\+[0-9]{1,3}[ -][0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}\b", "[PHONE]"),
    "home": (r"/(?:home|Users)/[A-Za-z0-9._-]+", "[HOME]"),
}
#: Words by which a field's name tells what it holds; the first group that fits counts.
SENSITIVE = {"credential": ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key"), "contact": ("email", "phone", "address"), "financial": ("card", "iban", "account"), "identity": ("ssn", "birth", "passport")}
WORD = r"[a-z0-9]{3,}"


def words(c: Column) -> Column:
    """Words of three or more ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf: how often each word comes in each text."""
    return df.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(df: DataFrame, key: str, text: str, top: int = 50) -> DataFrame:
    """term, df, score of the corpus's `top` words: share of all words times (ln(texts / texts with the word) + 1)."""
    tc = term_counts(df, key, text)
    terms = tc.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df"))
    totals = df.where(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size(words(F.col(text)))).alias("all"))
    scored = terms.join(F.broadcast(totals)).withColumn("score", F.col("n") / F.col("all") * (F.log(F.col("docs") / F.col("df")) + 1))  # totals: one row
    return scored.select("term", "df", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "term").limit(top)


def bm25(df: DataFrame, key: str, text: str, query: Sequence[str], top: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the `top` texts for the words of a query."""
    sized = df.select(key, words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    stats = sized.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("_w")).alias("mean"))
    counts = [F.size("_w") - F.size(F.array_remove("_w", q)) for q in query]
    hits = sized.select(key, F.size("_w").alias("n"), F.explode(F.array(*[F.struct(F.lit(q).alias("term"), c.alias("tf")) for q, c in zip(query, counts)])).alias("h")).select(key, "n", "h.*").where("tf > 0")
    df_ = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row a word of the query
    w = hits.join(F.broadcast(df_), "term").join(F.broadcast(stats))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return w.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).limit(top)


def pattern_counts(df: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """key, kind, n for each pattern found in a text: one pass, one row a hit kind."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_count(F.col(text), F.lit(p)).alias("n")) for k, p in patterns.items()])
    return df.select(key, F.explode(found).alias("f")).select(key, "f.*").where("n > 0")


def redact_personal(text: Column) -> Column:
    for pattern, by in PERSONAL.values():
        text = F.regexp_replace(text, pattern, by)
    return text


def sensitivity(name: Column) -> Column:
    """The first group of words one of which is part of a name, else null."""
    low = F.lower(name)
    out: Column | None = None
    for kind, parts in SENSITIVE.items():
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(low, F.lit(p))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def convention(name: Column) -> Column:
    return (
        F.when(name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), "snake")
        .when(name.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"), "upper_snake")
        .when(name.rlike("^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$"), "camel")
        .when(name.rlike("^([A-Z][a-z0-9]+)+$"), "pascal")
        .when(name.rlike("^[a-z0-9]+$"), "lower")
        .otherwise("other")
    )


#: Extension of a file name to its language.
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "cs": "csharp", "rb": "ruby", "php": "php"}


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


@F.pandas_udf(T.DoubleType())
def byte_entropy(text: pd.Series) -> pd.Series:
    """Bits of entropy of a text's UTF-8 bytes; 0 for an empty one."""
    import numpy as np

    def one(s: str | None) -> float | None:
        if s is None:
            return None
        n = np.bincount(np.frombuffer(s.encode("utf-8", "surrogatepass"), np.uint8))
        p = n[n > 0] / max(1, len(s.encode("utf-8", "surrogatepass")))
        return float(-(p * np.log2(p)).sum()) + 0.0 if len(p) else 0.0

    return text.map(one)


@F.pandas_udf(T.StringType())
def summary(text: pd.Series) -> pd.Series:
    """The two most central sentences by TextRank (cosine of word counts, damping 0.85), in their order."""
    import re
    from collections import Counter

    import numpy as np

    sentences = 2

    def one(s: str | None) -> str | None:
        if not s:
            return s
        parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+", s) if p.strip()]
        many = len(parts)
        if many <= sentences:
            return " ".join(parts)
        vocab: dict[str, int] = {}
        cells = Counter((k, vocab.setdefault(w, len(vocab))) for k, p in enumerate(parts) for w in re.findall(WORD, p.lower()))
        # The word counts of the sentences as a sparse matrix of unit rows; similarities are only ever multiplied with, never written out.
        row, col = (np.fromiter((c[x] for c in cells), np.int64, len(cells)) for x in (0, 1))
        value = np.fromiter(cells.values(), float, len(cells))
        value /= np.sqrt(np.bincount(row, value * value, many))[row]
        own = np.bincount(row, value * value, many)  # a sentence's similarity to itself, left out

        def times(x: np.ndarray) -> np.ndarray:
            return np.bincount(row, value * np.bincount(col, value * x[row], len(vocab) or 1)[col], many) - own * x

        out = times(np.ones(many))
        linked = out > 1e-12
        rank = np.full(many, 1 / many)
        for _ in range(100):
            new = 0.15 / many + 0.85 * (times(np.where(linked, rank / np.where(linked, out, 1), 0)) + rank[~linked].sum() / many)
            if np.abs(new - rank).sum() < 1e-6:
                break
            rank = new
        best = sorted(sorted(range(many), key=lambda k: (-round(rank[k], 9), k))[:sentences])
        return " ".join(parts[k] for k in best)

    return text.map(one)
