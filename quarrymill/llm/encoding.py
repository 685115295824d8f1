"""Encoding of a corpus with a public byte-level BPE.

Frequent words of the whole corpus are counted, encoded once and compiled into a transducer lexicon (lexicon.py), a file
in the shared folder that every worker maps into memory. Texts are split as the tokenizer splits them; a word's ids come
from the lexicon, and words it does not have are merged exactly by their ranks. Each worker looks up a word once and keeps it.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.lexicon import Lexicon, compile_lexicon
from quarrymill.plans.session import cut, discard, scratch, spread

#: Words in the lexicon: the most frequent of all. Bounds what the driver sees.
LEXICON_WORDS = 50_000
#: Steps of the histogram of counts for each doubling.
STEPS = 8
#: Words that a worker keeps at once.
KEPT_WORDS = 400_000

#: Fixed value: the splitting pattern of the public byte-level tokenizers, with white space spelled out.
_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: The same for texts of ASCII alone, which the standard library's engine splits faster.
ASCII_PATTERN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_COUNTED = re.compile(r" ?[A-Za-z]+")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public vocabulary lies: by the module that comes with the files, else in its usual place."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Exact encoder of one process; remembers the ids of words."""

    def __init__(self, vocabulary: str, lexicon: str | None = None):
        import regex
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(vocabulary), special_tokens={})
        self.split_any = regex.compile(PATTERN).findall
        self.lexicon = Lexicon(lexicon) if lexicon else None
        # A word is what the pattern matches whole, so encoding it alone splits it no further: it is merged by its ranks.
        lookup, merge = self.lexicon.ids if self.lexicon else (lambda w: None), self.bpe.encode_ordinary

        class Kept(dict):
            def __missing__(kept, word: str) -> tuple[int, ...]:  # noqa: N805
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                ids = lookup(word.encode())
                kept[word] = ids = tuple(merge(word)) if ids is None else ids
                return ids

        self.kept = Kept()

    def encode(self, text: str) -> list[int]:
        words = ASCII_PATTERN.findall(text) if text.isascii() else self.split_any(text)
        return list(chain.from_iterable(map(self.kept.__getitem__, words)))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, lexicon: str | None = None) -> Encoder:
    key = (vocabulary, lexicon)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, lexicon)
    return _ENCODERS[key]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    for b in batches:
        for text in b.column(0).to_pylist():
            if text:
                seen.update(_COUNTED.findall(text))
        if len(seen) > 300_000:
            yield out()
            seen.clear()
    if seen:
        yield out()


def frequent_words(texts: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts (letters of ASCII, with the blank before them) that occur more than once: at most `most`.

    A histogram of the counts, STEPS steps for each doubling, gives the least count of which at most `most` words have as much or
    more; only these words are collected, however many tasks counted them.
    """
    counted = spread(texts.where(F.length("text") > 0).select("text")).mapInArrow(_count_words, "word string, n bigint")
    counts = cut(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    step = F.floor(F.log2("n") * STEPS).cast("int")
    sizes = sorted(((r.step, r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)  # 64 * STEPS rows at most
    least, total = None, 0
    for at, n in sizes:
        if total + n > most:
            break
        least, total = at, total + n
    words = [] if least is None else [r.word for r in counts.where(step >= least).orderBy("word").collect()]
    discard(counts)
    return words


def write_lexicon(spark: SparkSession, words: list[str], vocabulary: str) -> str:
    """Compile words with their ids to a file in the shared folder and give its path; where that is no mounted folder, spread the file with the job."""
    merge = Encoder(vocabulary).bpe.encode_ordinary
    data = compile_lexicon([(w.encode(), merge(w)) for w in words])
    path = scratch(spark, "lexicon")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    stream = files.create(target)
    stream.write(data)
    stream.close()
    if files.getScheme() == "file":
        return urlparse(path).path
    spark.sparkContext.addFile(path)
    return f"spark-file:{path.rsplit('/', 1)[-1]}"


def encode_documents(documents: DataFrame, vocabulary: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids (array of int) of each row, without special tokens; a null or an empty text has no ids (an empty array).

    Text that looks like a special token is ordinary text. Rows with equal or null doc_id are encoded each on its own.
    """
    spark = documents.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    words = frequent_words(documents, lexicon_words)
    lexicon = write_lexicon(spark, words, vocabulary) if words else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        path = SparkFiles.get(lexicon[11:]) if lexicon and lexicon.startswith("spark-file:") else lexicon
        encode = encoder(vocabulary, path).encode
        for b in batches:
            docs = b.column(0)
            for lo in range(0, b.num_rows, 2000):
                each = [encode(t) if t else [] for t in b.column(1).slice(lo, 2000).to_pylist()]
                ends = np.zeros(len(each) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in each], out=ends[1:])
                flat = np.fromiter(chain.from_iterable(each), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([docs.slice(lo, 2000), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def token_sizes(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, size: how many tokens the text of each row has; 0 for a null or an empty text."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary).bpe
        for b in batches:
            sizes = [len(bpe.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "size"])

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, size bigint")
