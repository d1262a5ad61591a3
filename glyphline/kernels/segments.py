"""Edited documents in segments: an edit reads and writes those that it changes, and their neighbours.

A segment is what lies between two checkpoints of the online stream: its bytes, and the ids of the
tokens that became certain while it was read. A checkpoint is the bytes that were pending at a
segment's begin. Places aren't stored: they follow from the segments' sizes, so that an edit moves
what is behind it without touching it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np

from .encode import Encoder
from .stream import OnlineStream
from .vocab import BPE, PackError

#: Bytes between checkpoints.
CHECKPOINT = 16 << 10


class DictStore:
    """Segments and checkpoints of one document in memory. Other stores have the same methods."""

    def __init__(self):
        self.segments: dict[int, tuple[bytes, bytes]] = {}
        self.points: dict[int, bytes] = {}

    def segment(self, number: int) -> tuple[bytes, bytes]:
        return self.segments[number]

    def point(self, number: int) -> bytes:
        return self.points[number]

    def put(self, number: int, data: bytes, ids: bytes, pending: bytes) -> None:
        self.segments[number], self.points[number] = (data, ids), pending

    def remove(self, number: int) -> None:
        del self.segments[number], self.points[number]


@dataclass
class Change:
    """What an edit did: tokens from ``token_from`` on, so many removed and ``ids`` put in; sizes and what was reused."""

    length: int
    n_tokens: int
    token_from: int
    removed: int
    ids: np.ndarray
    reprocessed: int
    reused_prefix: int
    reused_suffix: int
    resynchronized: bool
    touched: int


class _Reader:
    """Bytes of the new document from the first changed segment on; old segments are read when they are reached."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def take(self, n: int) -> bytes:
        out = []
        while n:
            if not self.held:
                self.held = next(self.pieces)
                continue
            out.append(self.held[:n])
            self.held = self.held[n:]
            n -= len(out[-1])
        return b"".join(out)


class SegmentedDocument:
    """A document whose segments lie in a store.

    index: of each segment in order its number in the store, its bytes and its tokens; following:
    the next free number. Both, with the store, are the whole state.
    """

    def __init__(self, encoder: Encoder, store, index: list[tuple[int, int, int]] | None = None, following: int = 0, checkpoint: int = CHECKPOINT, max_pending: int = 1 << 20):
        if encoder.vocab.algorithm == BPE:
            raise PackError("merges depend on what follows", 10)
        if checkpoint < 1:
            raise ValueError("checkpoints need a distance")
        self.encoder, self.store, self.checkpoint, self.max_pending = encoder, store, checkpoint, max_pending
        self.index, self.following, self.touched = list(index or ()), following, 0
        if not self.index:
            self._put(0, [(b"", [], b"")])

    @property
    def length(self) -> int:
        return sum(n for _, n, _ in self.index)

    def _segment(self, k: int) -> bytes:
        data, ids = self.store.segment(self.index[k][0])
        self.touched += len(data) + len(ids)
        return data

    def _point(self, k: int) -> bytes:
        pending = self.store.point(self.index[k][0])
        self.touched += len(pending)
        return pending

    def _put(self, at: int, made: list[tuple[bytes, list[int], bytes]], gone: int = 0) -> None:
        """Put segments (data, ids, pending at the begin) in place of ``gone`` ones from ``at`` on."""
        for number, _, _ in self.index[at : at + gone]:
            self.store.remove(number)
        rows = []
        for data, ids, pending in made:
            packed = np.array(ids, "<u4").tobytes()
            self.store.put(self.following, data, packed, pending)
            self.touched += len(data) + len(packed) + len(pending)
            rows.append((self.following, len(data), len(ids)))
            self.following += 1
        self.index[at : at + gone] = rows

    def edit(self, start: int, delete: int, insert: bytes) -> Change:
        """Replace ``delete`` bytes from ``start`` on by ``insert``; an edit outside the document changes nothing.

        Encoding begins at the last checkpoint at or before the edit, and ends at the first one
        behind it at which as many bytes of the same kind are pending as before, or at the
        document's end.
        """
        places = list(accumulate((n for _, n, _ in self.index), initial=0))
        total = places.pop()
        if not 0 <= start <= start + delete <= total:
            raise ValueError("the edit is outside the document")
        self.touched = 0
        shift, tail = len(insert) - delete, start + delete
        base = bisect_right(places, start) - 1
        pending = self._point(base)
        stream = OnlineStream(self.encoder, self.max_pending, pending)
        new_total, consumed, given = total + shift, places[base], places[base] - len(pending)
        waiting = bisect_left(places, tail, base + 1)  # checkpoints that may be met
        reader = _Reader(self._pieces(places, base, start, tail, insert))
        made, data, ids, begin, met = [], [], [], consumed, None
        while consumed < new_total:
            while waiting < len(places) and places[waiting] + shift <= consumed:
                waiting += 1
            stop = min(consumed - consumed % self.checkpoint + self.checkpoint, new_total)
            if waiting < len(places):
                stop = min(stop, places[waiting] + shift)
            data.append(reader.take(stop - consumed))
            ids += (i for i, _ in stream.push(data[-1]))
            consumed = stop
            if waiting < len(places) and places[waiting] + shift == consumed and self._point(waiting) == stream.pending:
                met = waiting
                break
            if consumed % self.checkpoint == 0 and consumed > begin:
                made.append((b"".join(data), ids, pending))
                data, ids, begin, pending = [], [], consumed, stream.pending
        if met is None:
            ids += (i for i, _ in stream.finish())
        made.append((b"".join(data), ids, pending))
        end = len(self.index) if met is None else met
        change = Change(
            new_total,
            0,
            sum(n for _, _, n in self.index[:base]),
            sum(n for _, _, n in self.index[base:end]),
            np.array([i for _, some, _ in made for i in some], np.int64),
            consumed - given,
            given,
            0 if met is None else new_total - (places[met] + shift - len(self._point(met))),
            met is not None,
            0,
        )
        self._put(base, made, end - base)
        change.n_tokens, change.touched = sum(n for _, _, n in self.index), self.touched
        return change

    def _pieces(self, places: list[int], base: int, start: int, tail: int, insert: bytes) -> Iterator[bytes]:
        k, held = base, self._segment(base)
        yield held[: start - places[base]]
        yield insert
        while k + 1 < len(places) and places[k + 1] <= tail:  # what lies within the deleted bytes isn't read
            k, held = k + 1, None
        while k < len(places):
            held = self._segment(k) if held is None else held
            yield held[max(0, tail - places[k]) :]
            k, held = k + 1, None

    def ids(self) -> np.ndarray:
        """All tokens' ids, from all segments."""
        return np.concatenate([np.frombuffer(self.store.segment(s)[1], "<u4") for s, _, _ in self.index]).astype(np.int64)

    def data(self) -> bytes:
        return b"".join(self.store.segment(s)[0] for s, _, _ in self.index)
