"""Exact tokenization of bytes: weighted shortest paths, beams and merges, segment by segment.

A place whose two neighbouring bytes stand next to each other in no surface is a boundary of every
tokenization. Texts are cut there; the segments between, mostly a few bytes, repeat a great deal and
are remembered, so that each is solved once per worker.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

import numpy as np

from .vocab import BPE, PackError, Vocabulary

#: Segments that an encoder remembers at most; longer ones than this many bytes never.
MEMORY, MEMORY_BYTES = 200_000, 64
BEAM = 16


class Encoder:
    """Encoder of a vocabulary; deltas (surface -> int) change costs or ranks, not the reported cost."""

    def __init__(self, vocab: Vocabulary, deltas: dict[bytes, int] | None = None):
        deltas = deltas or {}
        self.vocab, self.max_len = vocab, vocab.max_len
        self.entries: dict[bytes, list[tuple[int, int]]] = {}
        for i, c, s in vocab.rows:
            self.entries.setdefault(s, []).append((c + deltas.get(s, 0), i))
        self.entry = {s: min(e) for s, e in self.entries.items()}
        self.base_cost = {i: c for i, c, _ in vocab.rows}
        self.surface = {i: s for i, _, s in vocab.rows}
        if any(not -(2**62) < c < 2**62 for c, _ in self.entry.values()):
            raise PackError("a cost is out of range", 5)
        self.single = [self.entry[bytes([b])][1] for b in range(256)]
        by_first: list[set[int]] = [set() for _ in range(256)]
        self.cross = np.zeros(65536, bool)
        for s in self.entry:
            by_first[s[0]].add(len(s))
            for a, b in zip(s, s[1:], strict=False):
                self.cross[a * 256 + b] = True
        self.lengths = [sorted(x, reverse=True) for x in by_first]
        self._memory: dict[bytes, tuple[list[int], list[int]]] = {}
        self._beams: dict[tuple[int, bytes], tuple[list[int], list[int]]] = {}
        self._solve = self._merge if vocab.algorithm == BPE else self._shortest

    def boundaries(self, data: bytes) -> list[int]:
        """Starts of the segments, and the end."""
        if not data:
            return [0]
        b = np.frombuffer(data, np.uint8).astype(np.int64)
        return [0, *(np.flatnonzero(~self.cross[b[:-1] * 256 + b[1:]]) + 1).tolist(), len(data)]

    def encode(self, data: bytes) -> tuple[list[int], list[int]]:
        """Token ids and their lengths in bytes."""
        cuts = self.boundaries(data)
        ids: list[int] = []
        lengths: list[int] = []
        single = self.single
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a == 1:
                ids.append(single[data[a]])
                lengths.append(1)
                continue
            found = self._solved(data[a:b])
            ids += found[0]
            lengths += found[1]
        return ids, lengths

    def _solved(self, segment: bytes) -> tuple[list[int], list[int]]:
        found = self._memory.get(segment)
        if found is None:
            found = self._solve(segment)
            if len(segment) <= MEMORY_BYTES:
                if len(self._memory) >= MEMORY:
                    self._memory.clear()
                self._memory[segment] = found
        return found

    def encode_many(self, sources: list[bytes], width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and lengths of all sources' tokens, one source behind the other, and where each begins.

        Single bytes are looked up whole arrays at a time; equal segments are solved once. width:
        the ids of ``beam``, whose paths meet at a segment's ends, where the first of the cheapest counts.
        """
        solve = self._solved if width is None else lambda segment: self._beamed(segment, width)
        single = self.single if width is None else [solve(bytes([k]))[0][0] for k in range(256)]
        data = b"".join(sources)
        edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, sources), np.int64, len(sources)))))
        if not data:
            none = np.zeros(0, np.int64)
            return none, none, edges
        b = np.frombuffer(data, np.uint8)
        cut = np.ones(len(b) + 1, bool)
        cut[1:-1] = ~self.cross[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        cut[edges] = True
        # every byte is a token of its own where its segment is one byte; longer segments are filled in
        token = np.array(single, np.int64)[b]
        first = cut[:-1].copy()
        starts = np.flatnonzero(cut[:-1] & ~cut[1:])
        sizes = np.flatnonzero(cut[1:] & ~cut[:-1]) + 1 - starts
        which = np.empty(len(starts), np.int64)
        solved: list[tuple[list[int], list[int]]] = []
        for size in range(2, 9):
            at = np.flatnonzero(sizes == size)
            if len(at):
                keys = np.zeros(len(at), np.uint64)
                for k in range(size):
                    keys = (keys << np.uint64(8)) | b[starts[at] + k]
                _, place, inverse = np.unique(keys, return_index=True, return_inverse=True)
                which[at] = inverse + len(solved)
                solved += [solve(data[a : a + size]) for a in starts[at[place]].tolist()]
        long: dict[bytes, int] = {}
        for k in np.flatnonzero(sizes > 8).tolist():
            segment = data[starts[k] : starts[k] + sizes[k]]
            if segment not in long:
                long[segment] = len(solved)
                solved.append(solve(segment))
            which[k] = long[segment]
        if solved:
            each = np.fromiter((len(x[0]) for x in solved), np.int64, len(solved))
            flat_ids = np.array([i for x in solved for i in x[0]], np.int64)
            flat_at = np.array([a for x in solved for a in accumulate(x[1][:-1], initial=0)], np.int64)
            n = each[which]
            source = np.repeat((np.cumsum(each) - each)[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            to = np.repeat(starts, n) + flat_at[source]
            token[to] = flat_ids[source]
            first[to] = True
        at = np.flatnonzero(first)
        return token[at], np.diff(np.append(at, len(b))), np.searchsorted(at, edges)

    def surfaces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted ids, where their surfaces begin and how long they are in one array of bytes, and that."""
        table = sorted(self.surface.items())
        sizes = np.array([len(s) for _, s in table], np.int64)
        return np.array([i for i, _ in table], np.int64), np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(s for _, s in table), np.uint8)

    def _shortest(self, data: bytes) -> tuple[list[int], list[int]]:
        """Least cost, then fewest tokens, then the longer token at the first difference, then the smaller id."""
        n, entry, lengths = len(data), self.entry, self.lengths
        best: list = [None] * n + [(0, 0)]
        step: list = [None] * n
        for i in range(n - 1, -1, -1):
            top = None
            for size in lengths[data[i]]:  # longer ones first, so that equals keep the longer
                if size <= n - i and (e := entry.get(data[i : i + size])) is not None:
                    rest = best[i + size]
                    value = (e[0] + rest[0], rest[1] + 1)
                    if top is None or value < top:
                        top, step[i] = value, (e[1], size)
            best[i] = top
        ids, sizes, i = [], [], 0
        while i < n:
            ids.append(step[i][0])
            sizes.append(step[i][1])
            i += step[i][1]
        return ids, sizes

    def _merge(self, data: bytes) -> tuple[list[int], list[int]]:
        """Merge the neighbours of the least rank, the leftmost first, until none makes a surface."""
        n, entry = len(data), self.entry
        end = list(range(1, n + 1))  # of the piece that starts at a place
        before, alive = list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n:
                e = entry.get(data[a : end[b]])
                if e is not None:
                    heapq.heappush(heap, (e[0], a, e[1], end[b]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, _, stop = heapq.heappop(heap)
            if not alive[a] or end[a] >= n or end[end[a]] != stop:
                continue  # one of the two has changed since
            alive[end[a]] = False
            end[a] = stop
            if stop < n:
                before[stop] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        ids, sizes, a = [], [], 0
        while a < n:
            ids.append(entry[data[a : end[a]]][1])
            sizes.append(end[a] - a)
            a = end[a]
        return ids, sizes

    def cost(self, ids: list[int]) -> int:
        """Sum of the vocabulary's own costs."""
        return sum(self.base_cost[i] for i in ids)

    def beam(self, data: bytes, width: int = BEAM) -> tuple[list[int], list[int]]:
        """The cheapest of the partial paths that a beam keeps at each place.

        Paths are kept by cost alone; equal ones stay in the order in which they were found:
        by start, then by surface, then as they were at the start.
        """
        n = len(data)
        paths: list[list[tuple[int, tuple | None]]] = [[] for _ in range(n + 1)]
        paths[0] = [(0, None)]
        for start in range(n):
            here = paths[start]
            for size in reversed(self.lengths[data[start]]):  # surfaces with a common start: shorter first
                if size > n - start:
                    continue
                for cost, number in self.entries.get(data[start : start + size], ()):
                    more = [(c + cost, (number, size, before)) for c, before in here]
                    paths[start + size] = sorted(paths[start + size] + more, key=lambda p: p[0])[:width]
            if start:
                paths[start] = []
        ids, sizes, node = [], [], paths[n][0][1] if n else None
        while node is not None:
            ids.append(node[0])
            sizes.append(node[1])
            node = node[2]
        return ids[::-1], sizes[::-1]

    def beam_segments(self, data: bytes, width: int = BEAM) -> list[int]:
        """The ids of ``beam``, segment by segment.

        All paths meet at a segment's ends, where the first of the cheapest is the one that counts.
        """
        cuts = self.boundaries(data)
        return [i for a, b in zip(cuts, cuts[1:], strict=False) for i in self._beamed(data[a:b], width)[0]]

    def _beamed(self, segment: bytes, width: int) -> tuple[list[int], list[int]]:
        found = self._beams.get((width, segment))
        if found is None:
            found = self.beam(segment, width)
            if len(segment) <= MEMORY_BYTES:
                if len(self._beams) >= MEMORY:
                    self._beams.clear()
                self._beams[width, segment] = found
        return found

    def decode(self, ids) -> bytes:
        """The surfaces of ids; an unknown id raises KeyError."""
        surface = self.surface
        return b"".join([surface[i] for i in ids])


def path_key(path) -> tuple:
    """Total order of paths of edges (start, end, namespace, kind, id, cost): the lesser is the better."""
    return sum(e[5] for e in path), len(path), tuple((-(e[1] - e[0]), e[2], e[4]) for e in path)


def run_dfa(transitions: dict[tuple[int, int], tuple[int, int]], accepts: dict[int, tuple[int, int]], start: int, data: bytes) -> tuple[int, int] | None:
    """(token id, cost) if the automaton accepts all of data, else None."""
    state, cost = start, 0
    for byte in data:
        step = transitions.get((state, byte))
        if step is None:
            return None
        state, cost = step[0], cost + step[1]
    end = accepts.get(state)
    return None if end is None else (end[0], cost + end[1])
