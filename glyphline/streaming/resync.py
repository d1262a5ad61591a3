"""Edited documents in Structured Streaming: keyed state of segments and checkpoints.

A document's state is one entry for each segment, one for each checkpoint and a short index. An edit
reads and writes the entries between the checkpoint before it and the one at which the stream is as it was,
whatever the document's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import INVALID, LIMIT, OK, Engine
from ..kernels.segments import CHECKPOINT, SegmentedDocument
from ..kernels.stream import LimitError

#: What a stream of edits has to have, and what comes out for each of them.
EDITS = "doc string, seq long, start long, delete long, insert binary"
CHANGES = (
    "doc string, seq long, status int, length long, n_tokens long, token_from long, tokens_removed long, token_ids array<int>, "
    "reprocessed long, reused_prefix long, reused_suffix long, resynchronized boolean, touched long"
)
#: The state store that keyed state of several kinds needs.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State schema version of the index's packed rows.
_ROW = np.dtype([("number", "<i8"), ("bytes", "<i8"), ("tokens", "<i8")])


class _StateStore:
    """Segments and checkpoints of the current key, in map states."""

    def __init__(self, segments, points):
        self.segments, self.points = segments, points

    def segment(self, number: int) -> tuple[bytes, bytes]:
        data, ids = self.segments.getValue((number,))
        return bytes(data), bytes(ids)

    def point(self, number: int) -> bytes:
        return bytes(self.points.getValue((number,))[0])

    def put(self, number: int, data: bytes, ids: bytes, pending: bytes) -> None:
        self.segments.updateValue((number,), (data, ids))
        self.points.updateValue((number,), (pending,))

    def remove(self, number: int) -> None:
        self.segments.removeKey((number,))
        self.points.removeKey((number,))


class ResyncProcessor(StatefulProcessor):
    """Applies each document's edits in the order of seq, from 0 on."""

    def __init__(self, engine: Engine, checkpoint: int, max_pending: int, max_early: int, idle_ms: int):
        self.engine, self.checkpoint, self.max_pending = engine, checkpoint, max_pending
        self.max_early, self.idle_ms = max_early, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.encoder = handle, self.engine.encoder()
        self.head = handle.getValueState("head", "index binary, following long, next_seq long, early_bytes long, deadline long")
        self.segments = handle.getMapState("segments", "number long", "data binary, ids binary")
        self.points = handle.getMapState("points", "number long", "pending binary")
        self.early = handle.getMapState("early", "seq long", "start long, delete long, insert binary")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        head = self.head.get() if self.head.exists() else (b"", 0, 0, 0, 0)
        index, following, next_seq, early_bytes, deadline = bytes(head[0]), *head[1:]
        store = _StateStore(self.segments, self.points)
        known = [tuple(r) for r in np.frombuffer(index, _ROW).tolist()]
        doc = SegmentedDocument(self.encoder, store, known, following, self.checkpoint, self.max_pending)
        given: dict[int, tuple[int, int, bytes]] = {}
        for frame in rows:
            for r in frame.itertuples(index=False):
                if r.seq >= next_seq:  # others were applied already
                    given.setdefault(int(r.seq), (int(r.start), int(r.delete), bytes(r.insert or b"")))
        out = []
        while True:
            if next_seq in given:
                edit = given.pop(next_seq)
                if early_bytes and self.early.containsKey((next_seq,)):
                    early_bytes -= self._forget(next_seq)
            elif early_bytes and self.early.containsKey((next_seq,)):
                start, delete, insert = self.early.getValue((next_seq,))
                edit = start, delete, bytes(insert)
                early_bytes -= self._forget(next_seq)
            else:
                break
            out.append((key[0], next_seq, *self._apply(doc, edit)))
            next_seq += 1
        for seq, (start, delete, insert) in sorted(given.items()):
            if self.early.containsKey((seq,)):
                continue
            if early_bytes + len(insert) + 24 > self.max_early:
                out.append((key[0], seq, LIMIT, doc.length, sum(n for _, _, n in doc.index), 0, 0, [], 0, 0, 0, False, 0))
                continue
            self.early.updateValue((seq,), (start, delete, insert))
            early_bytes += len(insert) + 24
        if self.idle_ms:
            if deadline:
                self.handle.deleteTimer(deadline)
            deadline = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(deadline)
        self.head.update((np.array(doc.index, _ROW).tobytes(), doc.following, next_seq, early_bytes, deadline))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def _forget(self, seq: int) -> int:
        size = len(self.early.getValue((seq,))[2]) + 24
        self.early.removeKey((seq,))
        return size

    def _apply(self, doc: SegmentedDocument, edit: tuple[int, int, bytes]) -> tuple:
        try:
            c = doc.edit(*edit)
        except LimitError:
            return LIMIT, doc.length, sum(n for _, _, n in doc.index), 0, 0, [], 0, 0, 0, False, doc.touched
        except ValueError:
            return INVALID, doc.length, sum(n for _, _, n in doc.index), 0, 0, [], 0, 0, 0, False, 0
        return OK, c.length, c.n_tokens, c.token_from, c.removed, c.ids.tolist(), c.reprocessed, c.reused_prefix, c.reused_suffix, c.resynchronized, c.touched

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        """A document that got nothing for so long is forgotten, with all of its entries at once."""
        for state in (self.head, self.segments, self.points, self.early):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def resync_documents(edits: DataFrame, engine: Engine, checkpoint: int = CHECKPOINT, max_pending: int = 1 << 20, max_early: int = 16 << 20, idle_ms: int = 0) -> DataFrame:
    """``CHANGES`` of each edit of a stream of ``EDITS``: the tokens that it changes and what was reused.

    Documents begin empty. Edits are applied in the order of seq, from 0 on, each once: one that
    comes early waits for those before it in state, one that comes again is left out. status: 0;
    1 for an edit outside of the document, which changes nothing but takes its turn; 9 for one that
    would keep more than ``max_pending`` bytes pending, likewise, and for one that comes early when
    ``max_early`` bytes wait already, which is left out and may come again.

    The document's ids are those of before, with ``tokens_removed`` of them from ``token_from`` on
    replaced by token_ids, so that rows grow with the change and not with the document. reprocessed,
    reused_prefix, reused_suffix and resynchronized are those of ``replay.edits`` of kind resync
    with the same checkpoint distance; touched counts the bytes of state that the edit read and wrote.

    idle_ms: if given, a document that gets no edit for so long is forgotten. One timer for each
    document does that: entries with times to live of their own would take a document apart, as an
    edit renews only those that it changes. Rows without a doc or a seq are left out; a null start or
    delete is 0, a null insert is empty. Needs the state store ``ROCKS`` (setting ``STORE``).
    """
    from pyspark.sql import functions as F

    rows = edits.where("doc is not null and seq is not null")
    rows = rows.select("doc", F.col("seq").cast("long").alias("seq"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("start", "delete")], F.coalesce(F.col("insert").cast("binary"), F.lit(b"")).alias("insert"))
    processor = ResyncProcessor(engine, checkpoint, max_pending, max_early, idle_ms)
    return rows.groupBy("doc").transformWithStateInPandas(processor, CHANGES, "append", "processingTime" if idle_ms else "none")
