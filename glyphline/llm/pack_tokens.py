"""Fixed-width training rows: best-fit-decreasing packing of token ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _share, _slices, codec, texts

#: Ids of a row; ids that one buffer holds before it is packed; bytes of text of a shard, about.
CAPACITY, BUFFER, SHARD_BYTES = 2048, 1 << 21, 4 << 20


class CapacityTree:
    """Open bins by free room, in a segment tree that finds the least room that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, bin_no: int) -> None:
        self.bins[room].append(bin_no)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the bin with the least room of at least ``need``, or None."""
        i, count = need + self.size, self.count
        while not count[i]:  # climb until a sibling to the right has bins
            while i & 1:
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins, as lists of item numbers, for items of 1 to ``capacity``; equal lengths keep their order."""
    tree, bins = CapacityTree(capacity), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        found = tree.take(need)
        if found is None:
            found = (capacity, len(bins))
            bins.append([])
        room, number = found
        bins[number].append(item)
        if room > need:
            tree.put(room - need, number)
    return bins


def shard_count(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> int:
    """How many shards the texts' bytes make; the texts alone decide."""
    total = docs.select(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(1, -(-total // shard_bytes))


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, eos: int | None = None, pad: int = 0, buffer: int = BUFFER, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of packed token ids.

    Columns: shard int and row int (the row's place), ids binary (``capacity`` little-endian
    unsigned 16-bit integers, 32-bit where an id needs them, padded with ``pad``), n_tokens int
    (ids that aren't padding), doc_ids array<long>, pieces array<int> (number of the piece of its
    document, from 0), cu_seqlens array<int> (0 and the running sum of segment lengths) and
    position_resets array<int> (where positions start at 0 again: every segment's start).

    A document's ids, with ``eos`` behind them if given, are one segment; a longer document is cut
    into segments of ``capacity`` ids and a rest, so that its pieces in order give all its ids.
    Segments are packed by best-fit decreasing, the bin being found in a segment tree over free
    room.

    A document's shard is a hash of its id and text (so that an id of a third of all rows is dealt
    over all shards), and a shard's documents are packed in the order of another hash, then of id
    and text, in buffers of about ``buffer`` ids. The rows thus depend on the documents and on
    ``shards`` (by default ``shard_count``) alone, not on how a table is split or on which task
    runs again. Documents are encoded where they are read; only their ids cross the network.
    What room is left is in ``utilisation``.

    Null and empty texts have no segment. Null ids stay null in doc_ids. Repeated rows are packed
    each; segments of equal length keep that order. An empty table gives an empty result. Very
    long texts are segments of several rows. Other columns aren't used, whatever their names.
    """
    shared = _share(docs.sparkSession, ranks_path)
    top = max(pad, eos or 0)
    count = shards or shard_count(docs, text_col)

    def encode(batches):
        import pyarrow as pa

        c = codec(shared.value, pattern)
        kind = "<u2" if max(top, max(c.ranks.values(), default=0)) < 1 << 16 else "<u4"
        end = np.full(1, eos, kind).tobytes() if eos is not None else b""
        for whole in batches:
            for part in _slices(whole, 3):
                ids = [c.encoding.encode_to_numpy(t).astype(kind).tobytes() + end for t in texts(part.column(3))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ids, pa.binary())], ["shard", "doc", "place", "ids"])

    def run(batches):
        import pyarrow as pa

        c = codec(shared.value, pattern)
        kind = np.dtype("<u2" if max(top, max(c.ranks.values(), default=0)) < 1 << 16 else "<u4")
        shard, row = None, 0
        held: list[np.ndarray] = []
        whose: list[tuple[int | None, int]] = []
        size = 0

        def flush():
            nonlocal row, size
            bins = best_fit_decreasing(np.fromiter(map(len, held), np.int64, len(held)), capacity)
            for at in range(0, len(bins), 256):
                some = bins[at : at + 256]
                matrix = np.full((len(some), capacity), pad, kind)
                sums, resets = [], []
                for line, members in zip(matrix, some, strict=True):
                    ends = np.cumsum([0, *(len(held[i]) for i in members)])
                    line[: ends[-1]] = np.concatenate([held[i] for i in members])
                    sums.append(ends.astype(np.int32))
                    resets.append(ends[:-1].astype(np.int32))
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(some), pa.int32()),
                        pa.array(range(row, row + len(some)), pa.int32()),
                        pa.array([line.tobytes() for line in matrix], pa.binary()),
                        pa.array([int(s[-1]) for s in sums], pa.int32()),
                        pa.array([[whose[i][0] for i in m] for m in some], pa.list_(pa.int64())),
                        pa.array([[whose[i][1] for i in m] for m in some], ints),
                        pa.array(sums, ints),
                        pa.array(resets, ints),
                    ],
                    ["shard", "row", "ids", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "position_resets"],
                )
                row += len(some)
            held.clear()
            whose.clear()
            size = 0

        for whole in batches:
            for part in _slices(whole, 2):
                for now, doc, packed in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if now != shard:
                        yield from flush()
                        shard, row = now, 0
                    ids = np.frombuffer(packed, kind)
                    for piece, a in enumerate(range(0, len(ids), capacity)):
                        held.append(ids[a : a + capacity])
                        whose.append((doc, piece))
                    size += len(ids)
                    if size >= buffer:
                        yield from flush()
        yield from flush()

    schema = "shard int, row int, ids binary, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, position_resets array<int>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("text <> ''")
    shard = F.pmod(F.xxhash64("doc", "text"), F.lit(count)).cast("int")
    rows = rows.select(shard.alias("shard"), "doc", F.xxhash64("text", "doc", F.lit(29)).alias("place"), "text")
    rows = rows.mapInArrow(encode, "shard int, doc long, place long, ids binary")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "place", "doc", "ids")
    return rows.select("shard", "doc", "ids").mapInArrow(run, schema)


def utilisation(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(shard, n_rows, n_tokens, used): the share of each shard's room that holds tokens."""
    out = packed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"))
    return out.withColumn("used", F.col("n_tokens") / (F.col("n_rows") * capacity))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet files, one or more for each shard."""
    packed.write.mode("errorifexists").parquet(path)


def positions(cu_seqlens: np.ndarray, capacity: int) -> np.ndarray:
    """Position ids of a row: from 0 in each segment; padding counts on as a segment of its own."""
    ends = np.append(np.asarray(cu_seqlens), capacity)
    starts = np.repeat(ends[:-1], np.diff(ends))
    return np.arange(capacity) - starts
