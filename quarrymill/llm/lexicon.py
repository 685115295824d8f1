"""A minimal acyclic transducer from frequent words to their token ids.

Words are compiled, in sorted order, into the smallest acyclic automaton that accepts just them: states with equal
futures are shared. Every edge carries how many words come before those behind it, so that the sum along a word's way is
its number, which points into one array of ids. The whole is one file of flat arrays, mapped into memory by each worker.
"""

from __future__ import annotations

import mmap
from array import array
from collections.abc import Sequence

_BYTES = [bytes([b]) for b in range(256)]
_HEAD = 6


def compile_lexicon(entries: Sequence[tuple[bytes, Sequence[int]]]) -> bytes:
    """The file of a lexicon. entries: different words with their ids; their order does not matter."""
    entries = sorted(entries)
    # States under construction along the last word: (final, edges as list of (label, state number)).
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def close(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        got = register.get(key)
        if got is None:
            got = register[key] = len(states)
            states.append(key)
        return got

    path: list[list] = [[False, []]]
    last = b""
    for word, _ in entries:
        common = 0
        top = min(len(word), len(last))
        while common < top and word[common] == last[common]:
            common += 1
        for k in range(len(last), common, -1):
            final, edges = path.pop()
            path[-1][1].append((last[k - 1], close(final, edges)))
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        final, edges = path.pop()
        path[-1][1].append((last[k - 1], close(final, edges)))
    root = close(*path[0])

    words_below = [0] * len(states)  # states are numbered after all that they lead to
    first, labels, targets, before = array("I", [0]), bytearray(), array("I"), array("I")
    finals = bytearray()
    for n, (final, edges) in enumerate(states):
        total = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            before.append(total)
            total += words_below[target]
        words_below[n] = total
        first.append(len(labels))
        finals.append(final)
    where, ids = array("I", [0]), array("I")
    for _, out in entries:
        ids.extend(out)
        where.append(len(ids))
    labels += b"\0" * (-len(labels) % 4)
    finals += b"\0" * (-len(finals) % 4)
    head = array("I", [len(states), first[-1], len(entries), len(ids), root, len(labels)])
    return b"".join((head.tobytes(), first.tobytes(), targets.tobytes(), before.tobytes(), where.tobytes(), ids.tobytes(), bytes(finals), bytes(labels)))


class Lexicon:
    """A mapped lexicon; ids(word) gives the word's ids, or None."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self._map)
        states, edges, words, n_ids, self._root, _ = view[: 4 * _HEAD].cast("I")
        at = 4 * _HEAD

        def take(n: int) -> memoryview:
            nonlocal at
            part = view[at : at + 4 * n].cast("I")
            at += 4 * n
            return part

        self._first, self._target, self._before, self._where, self._ids = take(states + 1), take(edges), take(edges), take(words + 1), take(n_ids)
        self._finals = view[at : at + states]
        self._labels = at + states + (-states % 4)

    def ids(self, word: bytes) -> tuple[int, ...] | None:
        find, base, first, target, before = self._map.find, self._labels, self._first, self._target, self._before
        state, n = self._root, 0
        for b in word:
            edge = find(_BYTES[b], base + first[state], base + first[state + 1]) - base
            if edge < 0:
                return None
            n += before[edge]
            state = target[edge]
        return tuple(self._ids[self._where[n] : self._where[n + 1]]) if self._finals[state] else None
