"""Long exact spans shared between texts.

1. Every text gives sparse phrases of PHRASE characters: of each run of least-PHRASE+1 neighbouring ones, the one with the
   smallest hash. Texts that have a span of `least` characters in common have all of one such run in common, hence a phrase at
   the same place in it: no span is missed, whatever the sampling.
2. Phrases that come in two different texts recur. A span of `least` characters around such a place lies within its window, the
   least-PHRASE characters on either side of it. The texts that have a recurring phrase are read again and only these windows
   go on, each to the shard of its phrase. That is the prefilter: what is left out cannot hold a shared span.
3. A shard collects the windows of SHARD phrases, from all texts. Their phrases are confirmed by their characters and compiled
   into an Aho-Corasick automaton; every window of the shard is streamed through it, which locates every occurrence of each of the phrases.
4. Occurrences of a phrase with equal surroundings are one class. Classes are compared by how far they agree to the left and to the
   right: two by two where there are few, else by looking up each of the `least`-character strings around the phrase, so that the
   work grows with the occurrences and the result, not with all pairs. A phrase with more than HOT windows is looked up in that
   way over the cluster, a row for each string. Exact copies are represented by one text.

Lengths and positions are characters (code points), compared exactly as stored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.plans.session import cut, spread

LEAST = 200
PHRASE = 64
#: Phrases of one automaton.
SHARD = 4000
#: Windows of one phrase that one task takes; more are looked up over the cluster.
HOT = 4096
#: Classes of one phrase that are compared two by two.
FEW = 24
#: Rows of one key that meet in one block of a join.
BLOCK = 1000
#: Bits of a filter of keys, whatever their number: broadcast as 262,144 words at most. A full filter lets all rows pass.
FILTER_BITS = 1 << 24

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        with np.errstate(over="ignore"):
            both = []
            for base in (_MULTIPLIER, inverse):
                p = np.full(size, base & _MASK, dtype=np.uint64)
                p[0] = 1
                both.append(np.cumprod(p))
        _POWERS[size] = (both[0], both[1])
    up, down = _POWERS[size]
    return up[:n], down[:n]


def phrase_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` code points; equal runs have equal hashes."""
    n = len(codes)
    if n < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * up[: n - size + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x7FB5D329728EA185)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x81DADEF4BC2DD44D)
        h ^= h >> np.uint64(33)
    return h


def _minima(blocks: np.ndarray, n: int, run: int) -> np.ndarray:
    """The least of each `run` neighbours of the first n values in blocks (rows of `run`)."""
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - run + 1], up[run - 1 : n])


def sampled(h: np.ndarray, run: int) -> np.ndarray:
    """Positions of the smallest hash (the last of equal ones) of each `run` neighbouring hashes."""
    n = len(h)
    if n < run:
        return np.empty(0, np.int64)
    whole = -(-n // run) * run
    padded = np.full(whole, np.uint64(_MASK))
    padded[:n] = h
    least = _minima(padded.reshape(-1, run), n, run)
    # The low bits of a hash make room for its place, counted from the end: the smallest such key is the last of the smallest.
    low = np.uint64((1 << max(24, n.bit_length())) - 1)
    padded[:n] = (h & ~low) | (low - np.arange(n, dtype=np.uint64))
    where = (low - (_minima(padded.reshape(-1, run), n, run) & low)).astype(np.int64)
    if (h[where] == least).all():
        return where[np.r_[True, where[1:] != where[:-1]]]
    # Two of the smallest differ in the low bits alone.
    # Runs with the same minimum follow one another; within them, a new occurrence of it may enter.
    ends = np.flatnonzero(np.r_[least[1:] != least[:-1], True])
    starts = np.r_[0, ends[:-1] + 1]
    at = np.flatnonzero(np.isin(h, least[starts]))
    value = h[at]
    keep = []
    order = np.lexsort((at, value))
    at, value = at[order], value[order]
    for s, e in zip(starts.tolist(), ends.tolist()):
        lo, hi = np.searchsorted(value, least[s], "left"), np.searchsorted(value, least[s], "right")
        if hi - lo == 1:
            keep.append(int(at[lo]))
            continue
        places = at[lo:hi]
        # The last occurrence inside each window s..e: windows end at s+run-1 .. e+run-1.
        last = places[np.searchsorted(places, np.arange(s, e + 1) + run - 1, "right") - 1]
        keep.extend(np.unique(last).tolist())
    return np.unique(np.array(keep, np.int64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _sample(least: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, hashes, places = [], [], []
            for text in b.column(2).to_pylist():
                h = phrase_hashes(_codes(text), size)
                at = sampled(h, least - size + 1)
                counts.append(len(at))
                hashes.append(h[at].view(np.int64))
                places.append(at.astype(np.int32))
            if counts:
                docs, kinds = (np.repeat(b.column(k).to_numpy(zero_copy_only=False), counts) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(kinds), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(places))], names=["doc_id", "kind", "h", "pos"])

    return run


def _among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows whose key may be one of keys(key), by a filter of FILTER_BITS bits; to be joined afterwards, having moved less."""
    slot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    word, bit = F.floor(slot / 64).cast("int"), (slot % 64).cast("int")
    words = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    marked = rows.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(words), "_word")
    return marked.where("shiftrightunsigned(_bits, _bit) & 1L = 1").select(*rows.columns)


def _windows(least: int, size: int):
    around = least - size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows: list[tuple] = []
            for doc, text, places in zip(*(b.column(k).to_pylist() for k in range(3))):
                alike: dict[tuple[str, int], list[int]] = defaultdict(list)
                for p in places:  # places with the same surroundings are one row
                    at = min(p, around)
                    alike[text[p - at : p + size + around], at].append(p)
                rows += [(xxhash.xxh3_64_intdigest(w[at : at + size].encode("utf-8", "surrogatepass")) - (1 << 63), doc, at, w, sorted(found)) for (w, at), found in alike.items()]
            for lo in range(0, len(rows), 20_000):
                cols = list(zip(*rows[lo : lo + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32())))], names=["phrase", "doc_id", "at", "window", "places"])

    return run


def _common(x: str, y: str) -> int:
    """How many leading characters two strings have in common."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n  # x[:lo] == y[:lo], x[:hi] != y[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


Class = tuple[str, str]  # what stands before a phrase, backwards, and what behind it


def _meetings(classes: list[Class], around: int) -> Iterator[tuple[list[int], list[int], int, int]]:
    """xs, ys, back, ahead: each of the classes xs agrees with each of ys (xs is ys: with each other) over `around` characters besides the phrase.

    Any two classes that agree meet once; back and ahead are how far they agree (two by two), or a stretch of `around` of it.
    """
    if len(classes) <= FEW:
        for i, (xb, xa) in enumerate(classes):
            for j in range(i):
                yb, ya = classes[j]
                m = _common(xb, yb)
                if m + min(len(xa), len(ya)) >= around:
                    n = _common(xa, ya)
                    if m + n >= around:
                        yield [i], [j], m, n
        return
    for m in range(around + 1):
        n = around - m
        same: dict[Class, list[int]] = defaultdict(list)
        for i, (back, ahead) in enumerate(classes):
            if len(back) >= m and len(ahead) >= n:
                same[back[:m], ahead[:n]].append(i)
        for group in same.values():
            if len(group) < 2:
                continue
            if m == 0:
                yield group, group, m, n
                continue
            # Those with the same next character met one step earlier.
            nexts: dict[str, list[int]] = defaultdict(list)
            for i in group:
                nexts[classes[i][1][n : n + 1]].append(i)
            ended = nexts.pop("", [])
            parts = list(nexts.values())
            before: list[int] = list(ended)
            if len(ended) > 1:
                yield ended, ended, m, n
            for part in parts:
                if before:
                    yield part, before, m, n
                before = before + part


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows (phrase, doc_id, at, window, places) in order of phrase, cut between phrases into parts of SHARD phrases."""
    part: list[tuple] = []
    phrases, last = 0, None
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(5))):
            if row[0] != last:
                if phrases >= SHARD:
                    yield part
                    part, phrases = [], 0
                last, phrases = row[0], phrases + 1
            part.append(row)
    if part:
        yield part


def _located(part: list[tuple], size: int, around: int) -> dict[str, dict[Class, dict[int, list[int]]]]:
    """phrase -> class -> doc_id -> places: all that the automaton of the shard's phrases finds in the shard's windows."""
    import ahocorasick

    shard = ahocorasick.Automaton()
    own: set[tuple[int, int]] = set()
    for _, doc, at, window, places in part:
        shard.add_word(window[at : at + size], window[at : at + size])
        own.update((doc, p) for p in places)
    shard.make_automaton()
    found: dict[str, dict[Class, dict[int, list[int]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for _, doc, at, window, places in part:
        for end, phrase in shard.iter(window):
            p = end - size + 1
            # Other places with a window of their own are left to it: it shows more of what stands around them.
            here = places if p == at else [x + p - at for x in places if (doc, x + p - at) not in own]
            if here:
                found[phrase][window[:p][::-1], window[p + size :]][doc] += here
    return found


def _pairs(least: int, size: int):
    around = least - size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []

        def put() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a.clear()
            b.clear()
            return out

        for part in _shards(batches, size):
            for by_class in _located(part, size, around).values():
                classes = list(by_class)
                docs = [list(by_class[c]) for c in classes]
                inside = ((i, i) for i, c in enumerate(classes) if len(docs[i]) > 1 and len(c[0]) + len(c[1]) >= around)
                across = ((i, j) for xs, ys, _, _ in _meetings(classes, around) for k, i in enumerate(xs) for j in (ys[:k] if xs is ys else ys))
                for source in (inside, across):
                    for i, j in source:
                        for k, x in enumerate(docs[i]):
                            for y in docs[i][:k] if i == j else docs[j]:
                                if x != y:
                                    a.append(min(x, y))
                                    b.append(max(x, y))
                        if len(a) > 100_000:
                            yield put()
        if a:
            yield put()

    return run


def _covered(least: int, size: int):
    around = least - size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _shards(batches, size):
            rows: list[tuple[int, int, int]] = []
            for by_class in _located(part, size, around).values():
                classes = list(by_class)
                docs = [set(by_class[c]) for c in classes]
                reach = [[-1, -1] for _ in classes]  # how far what is shared goes to either side
                for i, (back, ahead) in enumerate(classes):
                    if len(docs[i]) > 1 and len(back) + len(ahead) >= around:
                        reach[i] = [len(back), len(ahead)]
                if len(classes) > FEW:
                    _stretch(classes, docs, reach, around)
                else:
                    for (i,), (j,), m, n in _meetings(classes, around):
                        if len(docs[i] | docs[j]) > 1:
                            for x in (i, j):
                                reach[x] = [max(reach[x][0], m), max(reach[x][1], n)]
                rows += [(doc, p - m + 1, p + size + n) for c, (m, n) in zip(classes, reach) if m >= 0 for doc, places in by_class[c].items() for p in places]
            for lo in range(0, len(rows), 50_000):
                cols = list(zip(*rows[lo : lo + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "lo", "hi"])

    return run


def _stretch(classes: list[Class], docs: list[set[int]], reach: list[list[int]], around: int) -> None:
    """Widen reach to all strings of `around` characters besides the phrase that stand in two documents."""
    for m in range(around + 1):
        same: dict[Class, list[int]] = defaultdict(list)
        for i, (back, ahead) in enumerate(classes):
            if len(back) >= m and len(ahead) >= around - m:
                same[back[:m], ahead[: around - m]].append(i)
        for group in same.values():
            if len(group) > 1 and len(set().union(*(docs[i] for i in group))) > 1:
                for i in group:
                    reach[i] = [max(reach[i][0], m), max(reach[i][1], around - m)]


def _strings(least: int, size: int):
    """For windows of hot phrases, a row for each string of `least` characters around the phrase: its key, what stands next, where it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows: list[tuple] = []
            for phrase, doc, at, window, places in zip(*(b.column(k).to_pylist() for k in range(5))):
                head = phrase.to_bytes(8, "little", signed=True)
                for begin in range(max(0, at + size - least), min(at, len(window) - least) + 1):
                    text = window[begin : begin + least].encode("utf-8", "surrogatepass")
                    first = begin == at  # nothing of the string stands before the phrase
                    rows.append((xxhash.xxh3_128_digest(head + (at - begin).to_bytes(2, "little") + text), doc, None if first else window[begin + least : begin + least + 1], first, [p - at + begin for p in places]))
            for lo in range(0, len(rows), 20_000):
                cols = list(zip(*rows[lo : lo + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32())))], names=["key", "doc_id", "next", "first", "begins"])

    return run


def _meet(rows: DataFrame, key: str, columns: tuple[str, ...], condition: str) -> DataFrame:
    """x_*, y_* of each two rows of one key under a condition. A key's rows meet in blocks of BLOCK, over as many tasks."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks"))
    r = rows.join(sizes, key)
    left = r.select(key, F.pmod(F.xxhash64("doc_id"), F.col("_blocks")).cast("int").alias("_block"), *[F.col(c).alias(f"x_{c}") for c in columns])
    right = r.select(key, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), *[F.col(c).alias(f"y_{c}") for c in columns])
    return left.join(right, [key, "_block"]).where(condition).select(*[f"{s}_{c}" for s in "xy" for c in columns])


class SharedSpans:
    """The windows of recurring phrases and the exact copies of a corpus, from which pairs and spans are read."""

    def __init__(self, documents: DataFrame, least: int = LEAST, size: int = PHRASE):
        if size >= least:
            raise ValueError("a phrase must be shorter than the least span")
        self.least, self.size = least, size
        texts = documents.where((F.length("text") >= least) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        self.texts = texts
        sha = F.sha2("text", 256)
        kinds = texts.select("doc_id", F.unhex(sha).alias("kind")).groupBy("doc_id").agg(F.min("kind").alias("kind"))
        chosen = kinds.groupBy("kind").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        #: doc_id, rep of each text that has copies
        self.copies = cut(kinds.join(chosen.where("copies > 1"), "kind").select("doc_id", "rep"))
        # `kind` only tells whether a phrase recurs in another text; 64 bits do.
        marks = cut(spread(texts).select("doc_id", F.xxhash64("text").alias("kind"), "text").mapInArrow(_sample(least, size), "doc_id bigint, kind bigint, h bigint, pos int"))
        recurring = cut(marks.groupBy("h").agg(F.min("kind").alias("a"), F.max("kind").alias("b")).where("a <> b").select("h"))
        other = self.copies.where("doc_id <> rep").select("doc_id")
        own = _among(marks.select("doc_id", "h", "pos"), "h", recurring).join(recurring, "h", "left_semi").join(other, "doc_id", "left_anti")
        per_text = cut(own.groupBy("doc_id").agg(F.collect_set("pos").alias("places")))  # at most one for every few characters
        found = per_text.join(_among(texts, "doc_id", per_text), "doc_id").select("doc_id", "text", "places")
        #: phrase, doc_id, at (of the phrase in the window), window, places (of the phrase in the text)
        self.occurrences = cut(found.mapInArrow(_windows(least, size), "phrase bigint, doc_id bigint, at int, window string, places array<int>"))
        counts = self.occurrences.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        counts = cut(counts.select("phrase", (F.col("n") > HOT).alias("hot")))
        names = ("phrase", "doc_id", "at", "window", "places")
        usual = self.occurrences.join(counts.where("NOT hot"), "phrase", "left_semi")
        self._usual = usual.select(*names).repartition("phrase").sortWithinPartitions("phrase")
        self._strings = None
        if counts.where("hot").limit(1).count():
            hot = self.occurrences.join(F.broadcast(counts.where("hot")), "phrase", "left_semi").select(*names)  # one row for every HOT windows at most
            self._strings = cut(spread(hot).mapInArrow(_strings(least, size), "key binary, doc_id bigint, next string, first boolean, begins array<int>"))

    def representative_pairs(self) -> DataFrame:
        """a, b (a < b) of each two different texts that share a span of `least` characters, copies standing back for their smallest doc_id."""
        out = self._usual.mapInArrow(_pairs(self.least, self.size), "a bigint, b bigint")
        if self._strings is not None:
            # Two occurrences meet at the first of the strings they share: that nothing, or not the same, stands next to.
            met = _meet(self._strings, "key", ("doc_id", "next", "first"), "x_doc_id < y_doc_id AND (x_first OR x_next = '' OR x_next <> y_next)")
            out = out.unionByName(met.select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")))
        return out.distinct()

    def members(self) -> DataFrame:
        """doc_id, rep of each text of `least` characters or more: the smallest doc_id of its exact copies, itself included."""
        return self.texts.select("doc_id").distinct().join(self.copies, "doc_id", "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))

    def pairs(self) -> DataFrame:
        """doc_id_a, doc_id_b (a < b) of each two texts that share a span of `least` characters, copies included."""
        a, b = self.copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("_a")), self.copies.select(F.col("rep").alias("b"), F.col("doc_id").alias("_b"))
        across = self.representative_pairs().join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
        within = _meet(self.copies, "rep", ("doc_id",), "x_doc_id < y_doc_id").select(F.col("x_doc_id").alias("x"), F.col("y_doc_id").alias("y"))
        return across.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))

    def spans(self) -> DataFrame:
        """doc_id, start_pos, end_pos (characters from 1, end included): the maximal stretches of each text made of spans that stand in another one."""
        from pyspark.sql import Window

        found = self._usual.mapInArrow(_covered(self.least, self.size), "doc_id bigint, lo bigint, hi bigint")
        if self._strings is not None:
            shared = self._strings.groupBy("key").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo < _hi").select("key")
            begins = self._strings.join(shared, "key", "left_semi").select("doc_id", F.explode("begins").alias("_at")).distinct()
            found = found.unionByName(begins.select("doc_id", (F.col("_at") + 1).cast("bigint").alias("lo"), (F.col("_at") + self.least).cast("bigint").alias("hi")))
        # Reduced to one stretch for each start before texts are put in order.
        parts = found.groupBy("doc_id", "lo").agg(F.max("hi").alias("hi"))
        w = Window.partitionBy("doc_id").orderBy("lo")
        reached = parts.withColumn("_before", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        islands = reached.withColumn("_island", F.sum(F.when(F.col("lo") <= F.col("_before") + 1, 0).otherwise(1)).over(w))
        merged = islands.groupBy("doc_id", "_island").agg(F.min("lo").alias("start_pos"), F.max("hi").alias("end_pos")).drop("_island")
        single = merged.join(self.copies.select("doc_id"), "doc_id", "left_anti")
        whole = self.copies.select("doc_id").join(self.texts.select("doc_id", F.length("text").cast("bigint").alias("end_pos")), "doc_id").select("doc_id", F.lit(1).cast("bigint").alias("start_pos"), "end_pos")
        return single.unionByName(whole)


def shared_amounts(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, n_chars, shared_chars, share of each row: how much of its text stands elsewhere too. Null and empty texts share nothing."""
    sums = spans.groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("shared_chars"))
    sizes = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    shared = F.coalesce("shared_chars", F.lit(0)).cast("bigint")
    return sizes.join(sums, "doc_id", "left").select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(0.0).alias("share"))
