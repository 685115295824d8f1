"""Similar sets of one bucket, over arrays: sets of numbers, rarest first, that share enough items of their prefixes.

Two sets are similar if they share `threshold` of their items. A set of n shares at least ceil(threshold n) items with any set similar to it, and
at least ceil(2 threshold / (1 + threshold) n) with one that is not smaller. Of two sets that share o items, prefixes that are shorter than the sets
by o - k have k items in common; sets meet by combinations of k prefix items, of which the first, the rarest, says the bucket.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa

#: Most items of a combination, and the most combinations of a set.
MOST_SHARED, MOST_KEYS = 3, 400
#: Pairs that a task holds at once.
CHUNK = 1_000_000
SCHEMA = pa.schema([("bucket", pa.int32()), ("s", pa.int64()), ("g", pa.int64()), ("items", pa.list_(pa.int64()))])
FOUND = "x bigint, y bigint, similarity double"


def needed(n: int, threshold: float) -> int:
    """The fewest items that a set of n shares with any set similar to it."""
    return math.ceil(n * threshold - 1e-9)


def shared(n: int, threshold: float) -> int:
    """The length of combinations by which a set of n meets those that are not larger: never more than they share in any case."""
    need = needed(n, threshold)
    return next(k for k in range(max(1, min(MOST_SHARED, need)), 0, -1) if k == 1 or math.comb(min(n, n - need + k), k) <= MOST_KEYS)


def prefixes(n: int, threshold: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(length of combinations, length of the prefix) of a set of n towards those not larger, and towards those not smaller."""
    k, even = shared(n, threshold), math.ceil(2 * threshold / (1 + threshold) * n - 1e-9)
    kinds = sorted({shared(m, threshold) for m in range(n, math.floor((n + 1e-6) / threshold) + 2)})
    return [(k, min(n, n - needed(n, threshold) + k))], [(j, min(n, n - even + j)) for j in kinds]


def _signatures(mixed: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """128 bits a set, one for each item: sets that differ in few items differ in few bits."""
    bits = np.zeros((n, 2), np.uint64)
    np.bitwise_or.at(bits, (owner, ((mixed >> np.uint64(57)) & np.uint64(1)).astype(np.int64)), np.uint64(1) << (mixed >> np.uint64(58)))
    return bits


class _Bucket:
    def __init__(self, t: pa.Table, bucket: int, buckets: int, threshold: float):
        lists = pa.concat_arrays(t["items"].chunks)
        self.s, self.g, at = t["s"].to_numpy(), t["g"].to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        self.values, self.at, self.n = lists.values.to_numpy(), at[:-1], np.diff(at)
        self.bucket, self.buckets, self.threshold = bucket, buckets, threshold
        mixed = self.values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        self.mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        self.bits = _signatures(self.mixed, np.repeat(np.arange(len(self.s)), self.n), len(self.s))

    def keys(self) -> dict[tuple[bool, int], tuple[list, list]]:
        """By (towards those not larger, length): hashes of the combinations whose first item is of this bucket, and their sets."""
        out: dict[tuple[bool, int], tuple[list, list]] = defaultdict(lambda: ([], []))
        for size in np.unique(self.n).tolist():
            of = np.flatnonzero(self.n == size)
            for larger, kinds in zip((True, False), prefixes(size, self.threshold)):
                for k, length in kinds:
                    for first in range(length - k + 1):
                        here = of[self.values[self.at[of] + first] % self.buckets == self.bucket]
                        if not len(here):
                            continue
                        begin = self.mixed[self.at[here] + first] ^ self.g[here].view(np.uint64)
                        for others in combinations(range(first + 1, length), k - 1):
                            key = begin
                            for j in others:
                                key = key * np.uint64(0xD6E8FEB86659FD93) + self.mixed[self.at[here] + j]
                            out[larger, k][0].append(key)
                            out[larger, k][1].append(here)
        return out

    def candidates(self) -> Iterator[np.ndarray]:
        """x * sets + y of the pairs that meet and whose sizes and signatures allow it, y not larger; CHUNK meetings at once."""
        keys, t = self.keys(), self.threshold
        for k in range(1, MOST_SHARED + 1):
            if (True, k) not in keys or (False, k) not in keys:
                continue
            (pk, pi), (ik, ii) = ([np.concatenate(x) for x in keys.pop((larger, k))] for larger in (True, False))
            order = np.argsort(ik)
            ik, ii = ik[order], ii[order]
            order = np.argsort(pk)
            pk, pi = pk[order], pi[order]
            low, met = np.searchsorted(ik, pk), np.searchsorted(ik, pk, side="right")
            met -= low
            pi, low, met = pi[met > 0], low[met > 0], met[met > 0]
            ends = np.cumsum(met)
            last = int(ends[-1]) if len(ends) else 0
            for begin in range(0, last, CHUNK):
                end = min(begin + CHUNK, last)
                own = np.arange(np.searchsorted(ends, begin, side="right"), np.searchsorted(ends, end - 1, side="right") + 1)
                before = ends[own] - met[own]
                since = np.maximum(begin - before, 0)
                many = np.minimum(end - before, met[own]) - since
                x = np.repeat(pi[own], many)
                y = ii[np.repeat(low[own] + since - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                nx, ny = self.n[x], self.n[y]
                keep = np.flatnonzero(((ny < nx) | (ny == nx) & (self.s[y] < self.s[x])) & (self.g[x] == self.g[y]) & (ny >= t * nx - 1e-9))
                x, y, nx, ny = x[keep], y[keep], nx[keep], ny[keep]
                apart = np.bitwise_count(self.bits[x] ^ self.bits[y]).sum(axis=1, dtype=np.int64)
                keep = apart <= nx + ny - 2 * np.ceil(t / (1 + t) * (nx + ny) - 1e-9)
                yield np.unique(x[keep] * len(self.s) + y[keep])

    def verified(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The similar ones among pairs whose rarest shared item is of this bucket, and how similar they are."""
        x, y = pairs // len(self.s), pairs % len(self.s)
        many = np.concatenate([self.n[x], self.n[y]])
        pair = np.repeat(np.tile(np.arange(len(pairs)), 2), many)
        item = self.values[np.repeat(np.concatenate([self.at[x], self.at[y]]) - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        order = np.lexsort((item, pair))
        pair, item = pair[order], item[order]
        twice = np.flatnonzero((pair[1:] == pair[:-1]) & (item[1:] == item[:-1]))
        both = np.bincount(pair[twice], minlength=len(pairs))
        ones, first = np.unique(pair[twice], return_index=True)
        mine = np.zeros(len(pairs), bool)
        mine[ones] = item[twice[first]] % self.buckets == self.bucket
        similarity = both / (self.n[x] + self.n[y] - both)
        good = mine & (similarity >= self.threshold - 1e-12)
        return pairs[good], similarity[good]

    def found(self) -> pa.RecordBatch:
        pairs, similar = np.zeros(0, np.int64), np.zeros(0)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([pairs, *[p for p, _ in waiting]])
            kept, at = np.unique(every, return_index=True)
            return kept, np.concatenate([similar, *[v for _, v in waiting]])[at]

        held = 0
        for met in self.candidates():
            step = max(1, CHUNK // max(1, int(self.n.max())))
            for b in range(0, len(met), step):
                waiting.append(self.verified(met[b : b + step]))
                held += len(waiting[-1][0])
            if held > CHUNK:
                pairs, similar = merged()
                waiting, held = [], 0
        pairs, similar = merged()
        s = self.s
        return pa.RecordBatch.from_arrays([pa.array(s[pairs // len(s)]), pa.array(s[pairs % len(s)]), pa.array(similar)], ["x", "y", "similarity"])


def similar(batches: Iterator[pa.RecordBatch], threshold: float, buckets: int) -> Iterator[pa.RecordBatch]:
    """x, y, similarity of each pair of similar sets (bucket, s, g, items) once, over all buckets; only sets of equal g are compared."""
    t = pa.Table.from_batches(list(batches), SCHEMA)
    bucket = t["bucket"].to_numpy()
    for one in np.unique(bucket).tolist():
        yield _Bucket(t.filter(pa.array(bucket == one)), one, buckets, threshold).found()
