"""Byte-level BPE by overlapping chunks that are stitched where their pre-tokens agree."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Characters of a chunk and of what it shares with the next.
CHUNK, OVERLAP = 8192, 256
#: Characters of a text whose chunks are dealt over tasks, and of such a chunk.
LONG, LONG_CHUNK = 1 << 20, 1 << 18
#: Pieces whose ids a worker remembers at most.
CACHE = 400_000

_loaded: dict[tuple[str, str], Codec] = {}


class Codec:
    """Encoder and decoder of one rank table (base64 surface and rank on each line).

    The pattern has to match every character of a text, as those of byte-level BPE do, and may not
    look behind a match's start or more than two characters beyond its end.
    """

    def __init__(self, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import regex
        import tiktoken

        rows = (line.split() for line in ranks.splitlines() if line.strip())
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.find = regex.compile(pattern).finditer
        self.chunk, self.overlap = chunk, max(1, min(overlap, chunk - 1))
        self.encoding = tiktoken.Encoding("glyphline", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self._piece = self.encoding._encode_single_piece
        self._cache: dict[str, bytes] = {}
        surface = {i: s for s, i in self.ranks.items()}
        size = max(surface, default=-1) + 1
        self._bytes = np.frombuffer(b"".join(surface.get(i, b"") for i in range(size)), np.uint8)
        self._length = np.fromiter((len(surface.get(i, b"")) for i in range(size)), np.int64, size)
        self._start = np.concatenate(([0], np.cumsum(self._length)))[:-1]

    def cuts(self, n: int, chunk: int | None = None) -> list[tuple[int, int]]:
        """Chunks of a text of n characters; each but the first begins ``overlap`` before the end of the one before."""
        chunk = chunk or self.chunk
        return [(max(0, a - self.overlap), min(n, a + chunk)) for a in range(0, max(n, 1), chunk)]

    def boundaries(self, piece: str) -> np.ndarray:
        """Where the matches of the pattern begin in a chunk, and the end of the last; the chunk alone decides."""
        ends = np.array([0, *(m.end() for m in self.find(piece))], np.int64)
        if ends[-1] != len(piece):
            raise ValueError("the pattern doesn't match every character")
        return ends

    def stitch(self, cuts: list[tuple[int, int]], found: list[np.ndarray], again) -> np.ndarray:
        """Where the text's pre-tokens begin, and its end, from those of its chunks.

        A pre-token depends on nothing before its start, so that from the first place in the
        overlap at which both chunks begin a pre-token the later chunk is right. The earlier chunk
        is trusted up to its last match but one, which ends before the chunk does. Where no place
        is common (a pre-token longer than the overlap), the text is found again, by again(a, b),
        from the last trusted place on, in a piece that doubles until it has a second match.
        """
        (_, end), now = cuts[0], found[0] + cuts[0][0]
        out = []
        for (left, stop), later in zip(cuts[1:], found[1:], strict=True):
            if stop <= end:
                continue
            later = later + left
            # matches that touch the chunk's end, or that its end could have changed, aren't trusted
            starts, ends = now[:-1], now[1:]
            trusted = starts[: max(1, int(np.searchsorted(ends, end - 1)) + 1)]
            meet = np.isin(later[:-1], trusted)
            if meet.any():
                at = int(later[:-1][meet][0])
            else:
                at, size = int(trusted[-1]), stop - int(trusted[-1])
                while True:
                    stop = min(cuts[-1][1], at + size)
                    later = again(at, stop) + at
                    if later[1] < stop - 1 or stop == cuts[-1][1]:
                        break
                    size *= 2
            out.append(starts[starts < at])
            now, end = later[later >= at], stop
        return np.concatenate([*out, now])

    def pretokens(self, text: str) -> list[str]:
        """The matches of the pattern in text; those of a text of several chunks are stitched.

        The chunks are cut up front and each is pre-tokenised on its own; see ``encode_long`` for
        texts whose chunks are dealt over tasks.
        """
        if len(text) <= self.chunk:
            return [m.group() for m in self.find(text)]
        cuts = self.cuts(len(text))
        return self.stitched(text, cuts, [self.boundaries(text[a:b]) for a, b in cuts])

    def stitched(self, text: str, cuts: list[tuple[int, int]], found: list[np.ndarray]) -> list[str]:
        """The pre-tokens of a text whose chunks' boundaries were found."""
        at = self.stitch(cuts, found, lambda a, b: self.boundaries(text[a:b])).tolist()
        return [text[a:b] for a, b in zip(at, at[1:])]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_pieces(self.pretokens(text))

    def encode_pieces(self, pieces: list[str]) -> bytes:
        """Ids of pre-tokens, each encoded by itself."""
        cache, parts = self._cache, []
        for piece in pieces:
            ids = cache.get(piece)
            if ids is None:
                ids = np.asarray(self._piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                if len(cache) >= CACHE:
                    cache.clear()
                if len(piece) <= 64:
                    cache[piece] = ids
            parts.append(ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        """The surfaces of the ids, concatenated."""
        at = np.frombuffer(ids, "<u4")
        if not len(at):
            return b""
        length = self._length[at]
        ends = np.cumsum(length)
        place = np.arange(ends[-1]) + np.repeat(self._start[at] - ends + length, length)
        return self._bytes[place].tobytes()


def codec(ranks: str, pattern: str) -> Codec:
    """One codec per rank table and worker process."""
    key = (hashlib.sha256(ranks.encode()).hexdigest(), pattern)
    if key not in _loaded:
        _loaded[key] = Codec(ranks, pattern)
    return _loaded[key]


def read_ranks(path: str) -> str:
    with open(path, encoding="ascii") as f:
        return f.read()


def _share(spark: SparkSession, path: str):
    """The rank table, sent to the executors: its size is that of a vocabulary file, under 1 MB."""
    bounded_batches(spark)
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs with ids (the token ids as packed little-endian uint32) and decoded (their bytes).

    Map-only: each text is encoded whole in the task that reads it, chunk by chunk, each match of
    ``pattern`` separately, without special tokens; decoding concatenates the ids' bytes. Null and
    empty texts have empty ids. Repeated rows and extra columns pass through; input columns named
    ids and decoded are replaced.
    """
    shared = _share(docs.sparkSession, ranks_path)
    names = [c for c in docs.columns if c not in ("ids", "decoded")]
    docs = docs.select(names)

    def run(batches):
        import pyarrow as pa

        c = codec(shared.value, pattern)
        for whole in batches:
            for part in _slices(whole, names.index(text_col)):
                ids = [c.encode(t) for t in texts(part.column(names.index(text_col)))]
                back = [c.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(back, pa.binary())], [*names, "ids", "decoded"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, ids binary, decoded binary")


def texts(column) -> list[str]:
    """Python strings of an Arrow column; a null is empty, bytes that aren't UTF-8 become U+FFFD."""
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [(t or b"").decode("utf-8", "replace") for t in column.cast("binary").to_pylist()]


def _slices(batch, at: int, most: int = 8 << 20):
    """Slices of a batch whose texts have about ``most`` bytes at most, or one row."""
    import pyarrow.compute as pc

    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(float)))
    cuts = [0]
    for i in range(1, batch.num_rows):
        if size[i] - (size[cuts[-1] - 1] if cuts[-1] else 0) > most:
            cuts.append(i)
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def _digests(c: Codec, ids: list[bytes]):
    """Columns n_tokens, ids_sha256 and decoded_sha256."""
    import pyarrow as pa

    back = [hashlib.sha256(c.decode(x)).hexdigest() for x in ids]
    return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(back, pa.string())]


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, chunk: int = LONG_CHUNK) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; the same rules as ``encode``.

    The digests are taken where the ids are made, so that no id leaves the task. A text of more
    than ``long`` characters isn't encoded where it is read: its chunks become rows that are dealt
    over tasks and pre-tokenised there (``long_digests``).
    """
    shared = _share(docs.sparkSession, ranks_path)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text") > long, F.lit(False))

    def run(batches):
        import pyarrow as pa

        c = codec(shared.value, pattern)
        for whole in batches:
            for part in _slices(whole, 1):
                columns = _digests(c, [c.encode(t) for t in texts(part.column(1))])
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[0].dataType.simpleString()
    short = docs.where(~is_long).mapInArrow(run, f"doc_id {kind}, {DIGESTS}")
    return short.unionByName(long_digests(docs.where(is_long), shared, pattern, chunk))


def long_digests(docs: DataFrame, shared, pattern: str, chunk: int) -> DataFrame:
    """The digests of very long texts, chunk by chunk in parallel.

    One row for each chunk is pre-tokenised in a task of its own, without what stands before it but
    for the overlap; where the chunks of a text meet again they are stitched, and the pieces are
    encoded. Texts are told apart by 128 bits of their hash and their length, so that repeated
    texts are encoded once. A text has to fit in a task, as it does in a row.
    """
    keys = ["h1", "h2", "n"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(41)).alias("h2"), F.length("text").alias("n"))
    overlap = max(1, min(OVERLAP, chunk - 1))
    pieces = rows.select(*keys, "text", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int"))).alias("k"))
    start = F.greatest(F.col("k") * chunk - overlap, F.lit(0))
    pieces = pieces.select(*keys, "k", F.substring(F.col("text"), start + 1, F.least(F.col("n"), (F.col("k") + 1) * chunk) - start).alias("piece"))
    pieces = pieces.repartition(*keys, "k")

    def pretokenise(batches):
        import pyarrow as pa

        c = codec(shared.value, pattern)
        for whole in batches:
            for part in _slices(whole, 4):
                found = [c.boundaries(t).astype(np.int32).tobytes() for t in texts(part.column(4))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*keys, "k", "piece", "bounds"])

    def stitch(batches):
        import pyarrow as pa

        c = codec(shared.value, pattern)
        now, held, bounds = None, [], []

        def finish():
            if now is not None:
                text = "".join([held[0], *(p[overlap:] for p in held[1:])])
                ids = c.encode_pieces(c.stitched(text, [(max(0, a - overlap), min(len(text), a + chunk)) for a in range(0, len(text), chunk)], bounds))
                yield pa.RecordBatch.from_arrays([*(pa.array([x], t) for x, t in zip(now, (pa.int64(), pa.int64(), pa.int32()), strict=True)), *_digests(c, [ids])], [*keys, "n_tokens", "ids_sha256", "decoded_sha256"])

        for whole in batches:
            for part in _slices(whole, 4):
                pieces = texts(part.column(4))
                for (*key, k), piece, found in zip(zip(*(part.column(i).to_pylist() for i in range(4)), strict=True), pieces, part.column(5).to_pylist(), strict=True):
                    if key != now:
                        yield from finish()
                        now, held, bounds = key, [], []
                    if k == len(held):  # not the same chunk of an equal text
                        held.append(piece)
                        bounds.append(np.frombuffer(found, np.int32).astype(np.int64))
        yield from finish()

    found = pieces.mapInArrow(pretokenise, "h1 long, h2 long, n int, k int, piece string, bounds binary")
    found = found.repartition(*keys).sortWithinPartitions(*keys, "k")
    found = found.mapInArrow(stitch, f"h1 long, h2 long, n int, {DIGESTS}")
    return rows.drop("text").join(found, keys).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
