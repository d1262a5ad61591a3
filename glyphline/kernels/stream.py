"""Exact tokenization of growing and of edited bytes (weighted vocabularies only)."""

from __future__ import annotations

from .encode import Encoder
from .vocab import BPE, PackError

#: Bytes that one step of a push adds at most.
STEP = 64 << 10


class LimitError(ValueError):
    """Pending bytes are at their ceiling; ``accepted`` bytes of the push were taken, ``tokens`` are proven."""

    def __init__(self, accepted: int, tokens: list[tuple[int, int]]):
        super().__init__("pending bytes are at the ceiling")
        self.status, self.accepted, self.tokens = 9, accepted, tokens


class OnlineStream:
    """Tokens are given out as soon as no further byte can change them.

    For each place of the pending bytes there is one best way to tokenize what is before it. Those
    of the last places, at which a token that spans the next byte could begin, share a beginning:
    that much is certain. All chunkings give the tokens of the whole.
    """

    def __init__(self, encoder: Encoder, max_pending: int = 1 << 20, pending: bytes = b""):
        if encoder.vocab.algorithm == BPE:
            raise PackError("merges depend on what follows", 10)
        if max_pending < encoder.max_len:
            raise PackError("the ceiling is below the longest surface", 1)
        self.encoder, self.max_pending = encoder, max_pending
        self.pending = b""
        self._ways: list[tuple] = [(0, 0, (), -1, -1)]
        if pending:
            self._append(pending)

    def _append(self, data: bytes) -> None:
        """Best ways to the new places: (cost, tokens, path key, place before, token id)."""
        whole, e = self.pending + data, self.encoder
        ways = self._ways
        for end in range(len(self.pending) + 1, len(whole) + 1):
            best = None
            for size in range(1, min(e.max_len, end) + 1):
                entry = e.entry.get(whole[end - size : end])
                if entry is None:
                    continue
                before = ways[end - size]
                value = (before[0] + entry[0], before[1] + 1, (before, -size, entry[1]), end - size, entry[1])
                if best is None or self._less(value, best):
                    best = value
            ways.append(best)
        self.pending = whole

    @staticmethod
    def _less(a: tuple, b: tuple) -> bool:
        """Cost, tokens, then the longer token and the smaller id at the first difference."""
        if a[:2] != b[:2]:
            return a[:2] < b[:2]
        first = None
        x, y = a, b
        while x is not y and x[3] >= 0 and y[3] >= 0:
            if x[2][1:] != y[2][1:]:
                first = (x[2][1:], y[2][1:])
            x, y = x[2][0], y[2][0]
        return first is not None and first[0] < first[1]

    def _commit(self, places: range) -> list[tuple[int, int]]:
        """Tokens up to the place that the best ways to all given places pass last."""
        ends = set(places)
        while len(ends) > 1:  # the latest place gives way to the one before it
            top = max(ends)
            ends.discard(top)
            ends.add(self._ways[top][3])
        return self._take(ends.pop())

    def _take(self, place: int) -> list[tuple[int, int]]:
        out, at = [], place
        while at > 0:
            way = self._ways[at]
            out.append((way[4], at - way[3]))
            at = way[3]
        if place:
            rest = self.pending[place:]
            self.pending, self._ways = b"", [(0, 0, (), -1, -1)]
            self._append(rest)
        return out[::-1]

    def push(self, data: bytes) -> list[tuple[int, int]]:
        """(id, length) of the tokens that have become certain."""
        out, at = [], 0
        while at < len(data):
            room = min(STEP, self.max_pending - len(self.pending))
            if room <= 0:
                raise LimitError(at, out)
            out += self._forced(data[at : at + room])
            at += min(room, len(data) - at)
            n = len(self.pending)
            out += self._commit(range(max(0, n - (self.encoder.max_len - 1)), n + 1))
        return out

    def _forced(self, data: bytes) -> list[tuple[int, int]]:
        """Take in data; what is before the last place that no token can cross is certain at once."""
        whole = self.pending + data
        cut = self.encoder.boundaries(whole)[-2]
        if not cut:
            self._append(data)
            return []
        tokens = list(zip(*self.encoder.encode(whole[:cut]), strict=True))
        self.pending, self._ways = b"", [(0, 0, (), -1, -1)]
        self._append(whole[cut:])
        return tokens

    def finish(self) -> list[tuple[int, int]]:
        return self._take(len(self.pending))


def apply_edit(data: bytes, start: int, delete: int, insert: bytes) -> bytes:
    if not 0 <= start <= start + delete <= len(data):
        raise ValueError("the edit is outside the document")
    return data[:start] + insert + data[start + delete :]


class IncrementalDocument:
    """After an edit, tokens that end well before it are kept and the rest is encoded again."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        if encoder.vocab.algorithm == BPE:
            raise PackError("merges depend on what follows", 10)
        self.encoder, self.data = encoder, data
        self.ids, self.lengths = encoder.encode(data)
        self.reprocessed, self.reused = len(data), 0

    def edit(self, start: int, delete: int, insert: bytes) -> None:
        data = apply_edit(self.data, start, delete, insert)
        safe, kept, at = max(0, start - (self.encoder.max_len - 1)), 0, 0
        while kept < len(self.lengths) and at + self.lengths[kept] <= safe:
            at += self.lengths[kept]
            kept += 1
        ids, lengths = self.encoder.encode(data[at:])
        self.data = data
        self.ids, self.lengths = self.ids[:kept] + ids, self.lengths[:kept] + lengths
        self.reprocessed, self.reused = len(data) - at, at


class ResyncDocument:
    """Checkpoints of the online state let an edit keep what is before it and what is after it."""

    def __init__(self, encoder: Encoder, data: bytes = b"", checkpoint: int = 64 << 10, max_pending: int = 1 << 20):
        if checkpoint < 1:
            raise ValueError("checkpoints need a distance")
        self.encoder, self.checkpoint, self.max_pending = encoder, checkpoint, max_pending
        self.data, self.tokens, self.points = b"", [], [(0, 0, 0, b"")]
        self.reused_prefix = self.reused_suffix = 0
        self.tokens, self.points, _ = self._run(data, 0, self.points[0], [], 0, 0)
        self.data, self.reprocessed, self.resynchronized = data, len(data), False

    def _run(self, data: bytes, base: int, point: tuple, old: list[tuple], shift: int, tail: int):
        """Tokens from a checkpoint on, new checkpoints, and the old one that was met, if any.

        A checkpoint: (bytes consumed, bytes in given tokens, number of tokens, pending bytes).
        """
        stream = OnlineStream(self.encoder, self.max_pending, point[3])
        consumed, given, points, tokens = point[0], point[1], [point], []
        waiting = [p for p in old if p[0] >= tail]
        while consumed < len(data):
            stops = [consumed - consumed % self.checkpoint + self.checkpoint, len(data)]
            stops += [p[0] + shift for p in waiting if p[0] + shift > consumed][:1]
            stop = min(stops)
            new = stream.push(data[consumed:stop])
            tokens += new
            given += sum(n for _, n in new)
            consumed = stop
            met = next((p for p in waiting if p[0] + shift == consumed), None)
            if met is not None and met[3] == stream.pending and met[1] + shift == given:
                return tokens, points, met
            if consumed % self.checkpoint == 0 and consumed > points[-1][0]:
                points.append((consumed, given, point[2] + len(tokens), stream.pending))
        tokens += stream.finish()
        return tokens, points, None

    def edit(self, start: int, delete: int, insert: bytes) -> None:
        data = apply_edit(self.data, start, delete, insert)
        shift, tail = len(insert) - delete, start + delete
        base = max(k for k, p in enumerate(self.points) if p[0] <= start)
        point = self.points[base]
        tokens, points, met = self._run(data, base, point, self.points[base + 1 :], shift, tail)
        kept = self.tokens[: point[2]]
        moved = point[2] + len(tokens)
        if met is not None:
            rest = self.tokens[met[2] :]
            later = [p for p in self.points if p[0] >= met[0]]
            points = points + [(p[0] + shift, p[1] + shift, p[2] - met[2] + moved, p[3]) for p in later]
            self.reused_suffix, stop = len(data) - (met[1] + shift), met[0] + shift
        else:
            rest, self.reused_suffix, stop = [], 0, len(data)
        if sum(n for _, n in tokens) != len(data) - point[1] - self.reused_suffix:
            raise RuntimeError("the changed tokens don't fill the gap")
        self.data, self.tokens = data, kept + tokens + rest
        self.points = self.points[:base] + points
        self.reused_prefix, self.reprocessed, self.resynchronized = point[1], stop - point[1], met is not None

    def encode(self) -> tuple[list[int], list[int]]:
        return [i for i, _ in self.tokens], [n for _, n in self.tokens]
