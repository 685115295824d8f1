"""Ways of any length in a directed graph that fits one task: strong components, and what leads to what, over arrays.

Nothing is written but the edges and the answer. Each function takes Arrow batches of (kind, src, dst): kind EDGE an edge, START a start (in src),
ASK an edge that is asked about; nodes of one type, loops left out of the edges.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.plans.session import cut_counting

EDGE, START, ASK = 0, 1, 2

#: Edges that one task holds: 250 bytes each at its peak, measured on 2,000,000.
LOCAL_EDGES = 3_000_000


def gathered(edges: DataFrame, starts: DataFrame | None = None, asked: DataFrame | None = None) -> tuple[DataFrame, int]:
    """A written table of (kind, src, dst) of the different edges(src, dst), starts(node) and asked(src, dst), without loops of edges, and its rows."""
    rows = edges.where("src <> dst").select(F.lit(EDGE).alias("kind"), "src", "dst")
    if starts is not None:
        rows = rows.unionByName(starts.where("node IS NOT NULL").select(F.lit(START).alias("kind"), F.col("node").alias("src"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst")))
    if asked is not None:
        rows = rows.unionByName(asked.where("src IS NOT NULL AND dst IS NOT NULL").select(F.lit(ASK).alias("kind"), "src", "dst"))
    out, n = cut_counting(rows.distinct(), rows=F.lit(True))
    return out, n["rows"]


def in_one_task(work: Callable, schema: str, rows: DataFrame) -> DataFrame:
    """The rows of work(batches) over all of gathered()."""
    return rows.repartition(1).mapInArrow(work, schema)


def _numbered(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, dict[int, tuple[np.ndarray, np.ndarray]]] | None:
    """The different nodes in order, and by kind the places of src and dst among them (-1: null)."""
    kept = [b for b in batches if b.num_rows]
    if not kept:
        return None
    t = pa.Table.from_batches(kept)
    coded = pa.chunked_array(t["src"].chunks + t["dst"].chunks).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order) + 1, np.int64)
    place[order.to_numpy()], place[-1] = np.arange(len(order)), -1
    codes = place[coded.indices.fill_null(-1).to_numpy()]
    kind, n = t["kind"].to_numpy(), t.num_rows
    return coded.dictionary.take(order), {k: (codes[:n][kind == k], codes[n:][kind == k]) for k in (EDGE, START, ASK)}


def _lists(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[list[int], list[int]]:
    """at, to: the neighbours of v are to[at[v]:at[v + 1]]."""
    order = np.argsort(src, kind="stable")
    return np.searchsorted(src[order], np.arange(n + 1)).tolist(), dst[order].tolist()


def strong_numbers(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The strong component of each node (Tarjan), numbered so that ways only go to smaller numbers."""
    at, to = _lists(n, src, dst)
    place, seen, low, comp = at[:n], [0] * n, [0] * n, [-1] * n
    number = parts = 0
    stack: list[int] = []
    for root in range(n):
        if seen[root]:
            continue
        number += 1
        seen[root] = low[root] = number
        stack.append(root)
        calls = [root]
        while calls:
            v = calls[-1]
            k = place[v]
            if k < at[v + 1]:
                place[v] = k + 1
                w = to[k]
                if not seen[w]:
                    number += 1
                    seen[w] = low[w] = number
                    stack.append(w)
                    calls.append(w)
                elif comp[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
                continue
            calls.pop()
            if calls and low[v] < low[calls[-1]]:
                low[calls[-1]] = low[v]
            if low[v] == seen[v]:
                while True:
                    w = stack.pop()
                    comp[w] = parts
                    if w == v:
                        break
                parts += 1
    return np.array(comp, np.int64)


class Ways:
    """The strong components of a graph and the edges between them. In each connected part one component, the pivot, is known by what
    leads to it (`before`) and what it leads to (`after`): ways from the one to the other need no search."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        self.of = strong_numbers(n, src, dst)
        self.parts = parts = int(self.of.max()) + 1 if n else 0
        self.size = np.bincount(self.of, minlength=parts)
        a, b = self.of[src], self.of[dst]
        links = np.unique(a[a != b] * max(parts, 1) + b[a != b])
        a, b = links // max(parts, 1), links % max(parts, 1)
        self.down, self.up = _lists(parts, a, b), _lists(parts, b, a)
        self.weak = self._connected(a.tolist(), b.tolist())
        busy = self.size.astype(float) ** 2 * (1 + np.bincount(a, minlength=parts)) * (1 + np.bincount(b, minlength=parts))
        order = np.lexsort((busy, self.weak))
        last = np.append(self.weak[order][1:] != self.weak[order][:-1], True) if parts else np.zeros(0, bool)
        self.pivots = order[last]
        self.pivot = bytearray(parts)
        for p in self.pivots.tolist():
            self.pivot[p] = 1
        self.before, self.after = self._from_pivots(*self.up), self._from_pivots(*self.down)

    def _connected(self, a: list[int], b: list[int]) -> np.ndarray:
        up = list(range(self.parts))
        for x, y in zip(a, b):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[max(x, y)] = min(x, y)
        for x in range(self.parts):  # a node's link is smaller, hence final
            up[x] = up[up[x]]
        return np.array(up, np.int64)

    def _from_pivots(self, at: list[int], to: list[int]) -> bytearray:
        """Flags of what the pivots lead to, themselves left out."""
        met, stack = bytearray(self.parts), self.pivots.tolist()
        while stack:
            v = stack.pop()
            for w in to[at[v] : at[v + 1]]:
                if not met[w]:
                    met[w] = 1
                    stack.append(w)
        return met

    def _closed(self, flags: bytearray) -> bytearray:
        return bytearray(x | y for x, y in zip(flags, self.pivot))

    def sums(self, weight: np.ndarray, back: bool = False) -> list[int]:
        """For each component the weight of all others that lead to it; back: that it leads to."""
        (at, to), before, after = (self.down, self.after, self.before) if back else (self.up, self.before, self.after)
        inner = self._closed(before)
        flags = np.frombuffer(bytes(before), np.uint8).astype(bool)
        through = np.bincount(self.weak[flags], weight[flags], minlength=self.parts).astype(np.int64)
        whole = through.copy()
        whole[self.weak[self.pivots]] += weight[self.pivots]
        through, whole, weak, w = through.tolist(), whole.tolist(), self.weak.tolist(), weight.tolist()
        total = [0] * self.parts
        for c in range(self.parts) if back else range(self.parts - 1, -1, -1):
            near = to[at[c] : at[c + 1]]
            if not near:
                continue
            if self.pivot[c]:
                total[c] = through[weak[c]]
            elif len(near) == 1:
                total[c] = total[near[0]] + w[near[0]]
            elif after[c]:
                outer = [q for q in near if not inner[q]]
                if not outer:
                    total[c] = whole[weak[c]]
                elif len(outer) == 1 and after[outer[0]]:
                    total[c] = total[outer[0]] + w[outer[0]]
                else:
                    seen, stack = set(outer), outer
                    while stack:
                        v = stack.pop()
                        for q in to[at[v] : at[v + 1]]:
                            if q not in seen and not inner[q]:
                                seen.add(q)
                                stack.append(q)
                    total[c] = whole[weak[c]] + sum(w[x] for x in seen)
            else:
                seen, stack = set(near), near
                while stack:
                    v = stack.pop()
                    for q in to[at[v] : at[v + 1]]:
                        if q not in seen:
                            seen.add(q)
                            stack.append(q)
                total[c] = sum(w[x] for x in seen)
        return total

    def leads(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether component a leads to component b, or is the same, for each pair."""
        early, late = self._closed(self.before), self._closed(self.after)
        e, l = np.frombuffer(bytes(early), np.uint8)[a] > 0, np.frombuffer(bytes(late), np.uint8)[b] > 0  # noqa: E741
        one = self.weak[a] == self.weak[b]
        out = (a == b) | (one & e & l)
        open_ = np.flatnonzero(~out & one & (a > b))
        open_ = open_[np.argsort(a[open_], kind="stable")]
        (at, to), starts = self.down, np.append(np.flatnonzero(np.diff(a[open_], prepend=-1)), len(open_))
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
            asks = open_[i:j]
            begin, least = int(a[asks[0]]), int(b[asks].min())
            skip = late if early[begin] else None
            seen, stack = {begin}, [begin]
            while stack:
                v = stack.pop()
                for w in to[at[v] : at[v + 1]]:
                    if w >= least and w not in seen and not (skip and skip[w]):
                        seen.add(w)
                        stack.append(w)
            out[asks] = [x in seen for x in b[asks].tolist()]
        return out


def _graph(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Array, dict, Ways] | None:
    got = _numbered(batches)
    if got is None:
        return None
    names, by = got
    return names, by, Ways(len(names), *by[EDGE])


def components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component (its smallest node) of the strong components of two nodes or more."""
    if (got := _numbered(batches)) is None:
        return
    names, by = got
    of = strong_numbers(len(names), *by[EDGE])
    least = np.full(of.max() + 1, len(names))
    np.minimum.at(least, of, np.arange(len(names)))
    nodes = np.flatnonzero(np.bincount(of)[of] > 1)
    yield pa.RecordBatch.from_arrays([names.take(pa.array(nodes)), names.take(pa.array(least[of[nodes]]))], ["node", "component"])


def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n: how many starts lead to each node, itself left out; nodes that none leads to are left out."""
    return _counted(batches, START)


def callers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n: how many nodes lead to each, itself left out; nodes that none leads to are left out."""
    return _counted(batches, EDGE)


def _counted(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[pa.RecordBatch]:
    """node, n: how many of the nodes in src of this kind lead to each."""
    if (got := _graph(batches)) is None:
        return
    names, by, ways = got
    start = np.zeros(len(names), np.int64)
    start[by[kind][0]] = 1
    weight = np.bincount(ways.of, start, minlength=ways.parts).astype(np.int64)
    n = (np.array(ways.sums(weight), np.int64) + weight)[ways.of] - start
    met = np.flatnonzero(n > 0)
    yield pa.RecordBatch.from_arrays([names.take(pa.array(met)), pa.array(n[met])], ["node", "n"])


def closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst of the asked edges whose dst leads to their src, or that are loops."""
    if (got := _graph(batches)) is None:
        return
    names, by, ways = got
    src, dst = by[ASK]
    keep = np.flatnonzero(ways.leads(ways.of[dst], ways.of[src]))
    yield pa.RecordBatch.from_arrays([names.take(pa.array(src[keep])), names.take(pa.array(dst[keep]))], ["src", "dst"])


def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, node, n: a greedy cover of all that the starts lead to, themselves left out; ties go to the smaller start.

    Gains never grow, so a start is worked out again only when it stands first. What a chosen start leads to is covered with all
    that follows it, so a search ends there; a chosen start itself may stay open (`alone`) until another leads to it.
    """
    if (got := _graph(batches)) is None:
        return
    names, by, ways = got
    of, size, (at, to) = ways.of.tolist(), ways.size.tolist(), ways.down
    most = ways.sums(ways.size, back=True)
    heap = [(-n, s) for s in np.unique(by[START][0]).tolist() if (n := most[of[s]] + size[of[s]] - 1) > 0]
    heapq.heapify(heap)
    covered, alone = bytearray(ways.parts), {}
    chosen: list[tuple[int, int]] = []
    while heap:
        n, s = heapq.heappop(heap)
        c = of[s]
        if covered[c]:
            continue
        met = {c}
        if c in alone:
            gain = int(alone[c] != s)
        else:
            gain, stack = size[c] - 1, [c]
            while stack:
                v = stack.pop()
                for w in to[at[v] : at[v + 1]]:
                    if w in met or covered[w]:
                        continue
                    met.add(w)
                    if w in alone:
                        gain += 1
                    else:
                        gain += size[w]
                        stack.append(w)
        if not gain:
            continue
        if gain != -n:
            heapq.heappush(heap, (-gain, s))
            continue
        chosen.append((s, gain))
        fresh = c not in alone
        for w in met:
            covered[w] = 1
            alone.pop(w, None)
        if fresh:
            covered[c], alone[c] = 0, s
    yield pa.RecordBatch.from_arrays([pa.array(range(len(chosen)), pa.int32()), names.take(pa.array([s for s, _ in chosen], pa.int64())), pa.array([n for _, n in chosen], pa.int64())], ["place", "node", "n"])
