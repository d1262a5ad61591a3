"""Streams and edits of tables: chunks in order, one pass, state carried from row to row."""

from __future__ import annotations

import hashlib
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Engine
from ..kernels.stream import IncrementalDocument, OnlineStream, ResyncDocument
from ..plans.kernel import build_once, to_bytes

#: Rows that are held before they are given back.
ROWS = 4096


def _ordered(df: DataFrame, key: str, order: str, column: str, *more: str) -> DataFrame:
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(order).cast("bigint").alias("seq"), to_bytes(df, column).alias("chunk"), *more)
    return rows.where("key is not null").repartition("key").sortWithinPartitions("key", "seq")


def _stream(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 512):  # rows become Python values a few at a time
            yield from batch.slice(a, 512).to_pylist()


def _encoder(engine: Engine, tags=None):
    return engine.encoder(tags)


def online(df: DataFrame, engine: Engine, key: str, order: str, column: str = "text", max_pending: int = 1 << 20) -> DataFrame:
    """(key, token_no, token_id, start, length): tokens of each key's chunks, given out when certain.

    Chunks are read in the order of ``order``; nulls are empty. Memory holds one key's pending
    bytes, whatever the stream's length.
    """

    def run(batches):
        import pyarrow as pa

        names = ["key", "token_no", "token_id", "start", "length"]
        encoder = build_once(_encoder, (engine,))
        out: list[tuple] = []
        for k, rows in groupby(_stream(batches), key=lambda r: r["key"]):
            stream, number, at = OnlineStream(encoder, max_pending), 0, 0
            for chunk in _chunks(rows):
                tokens = stream.finish() if chunk is None else stream.push(chunk)
                for i, n in tokens:
                    out.append((k, number, i, at, n))
                    number, at = number + 1, at + n
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return _ordered(df, key, order, column).mapInArrow(run, "key bigint, token_no bigint, token_id bigint, start bigint, length bigint")


def _chunks(rows):
    """Chunks of a stream, then None for its end."""
    for r in rows:
        yield r["chunk"] or b""
    yield None


def buffered(df: DataFrame, engine: Engine, key: str, order: str, column: str = "text", auto: bool = False) -> DataFrame:
    """(key, n_bytes, n_tokens, ids_sha256): each key's chunks joined and encoded at their end.

    auto: the detected language's deltas apply alone.
    """

    def run(batches):
        import pyarrow as pa

        from ..operators.tokenize import _Router

        out = []
        one = _Router(engine) if auto else engine.encoder().encode
        for k, rows in groupby(_stream(batches), key=lambda r: r["key"]):
            data = b"".join(r["chunk"] or b"" for r in rows)
            ids = one(data)[0]
            out.append((k, len(data), len(ids), ids_digest(ids)))
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "n_bytes", "n_tokens", "ids_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "n_bytes", "n_tokens", "ids_sha256"])

    return _ordered(df, key, order, column).mapInArrow(run, "key bigint, n_bytes bigint, n_tokens bigint, ids_sha256 string")


def ids_digest(ids) -> str:
    return hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def online_digest(df: DataFrame, engine: Engine, key: str, order: str, column: str = "text", max_pending: int = 1 << 20) -> DataFrame:
    """(key, n_bytes, n_tokens, ids_sha256, max_pending): as ``buffered``, by the online stream."""

    def run(batches):
        import pyarrow as pa

        encoder, out = build_once(_encoder, (engine,)), []
        for k, rows in groupby(_stream(batches), key=lambda r: r["key"]):
            stream, digest, count, size, most = OnlineStream(encoder, max_pending), hashlib.sha256(), 0, 0, 0
            for chunk in _chunks(rows):
                tokens = stream.finish() if chunk is None else stream.push(chunk)
                digest.update(b"".join(i.to_bytes(4, "little") for i, _ in tokens))
                count, size, most = count + len(tokens), size + sum(n for _, n in tokens), max(most, len(stream.pending))
            out.append((k, size, count, digest.hexdigest(), most))
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "n_bytes", "n_tokens", "ids_sha256", "max_pending"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "n_bytes", "n_tokens", "ids_sha256", "max_pending"])

    return _ordered(df, key, order, column).mapInArrow(run, "key bigint, n_bytes bigint, n_tokens bigint, ids_sha256 string, max_pending bigint")


EDITS = "key bigint, seq bigint, length bigint, n_tokens bigint, ids_sha256 string, reprocessed bigint, reused_prefix bigint, reused_suffix bigint, resynchronized boolean"


def edits(df: DataFrame, engine: Engine, key: str, order: str, start: str, delete: str, insert: str, kind: str = "incremental", checkpoint: int = 64 << 10) -> DataFrame:
    """The state of each key's document after each edit, and how much of it was encoded again.

    Rows are edits in the order of ``order``: from ``start`` on ``delete`` bytes are replaced by
    ``insert``; documents begin empty. kind: plain (all is encoded again), incremental (tokens well
    before the edit stay) or resync (those after it too, once the stream's state is as it was).
    """

    def run(batches):
        import pyarrow as pa

        encoder, out = engine.encoder(), []
        fields = [f.split()[0] for f in EDITS.split(", ")]
        for k, rows in groupby(_stream(batches), key=lambda r: r["key"]):
            doc = ResyncDocument(encoder, b"", checkpoint) if kind == "resync" else IncrementalDocument(encoder)
            for r in rows:
                doc.edit(r["start"], r["delete"], r["chunk"] or b"")
                if kind == "plain":
                    doc = IncrementalDocument(encoder, doc.data)
                if kind == "resync":
                    ids, row = doc.encode()[0], (doc.reprocessed, doc.reused_prefix, doc.reused_suffix, doc.resynchronized)
                else:
                    ids, row = doc.ids, (doc.reprocessed, doc.reused, 0, False)
                out.append((k, r["seq"], len(doc.data), len(ids), ids_digest(ids), *row))
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], fields)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], fields)

    more = [F.col(start).cast("bigint").alias("start"), F.col(delete).cast("bigint").alias("delete")]
    return _ordered(df, key, order, insert, *more).mapInArrow(run, EDITS)
