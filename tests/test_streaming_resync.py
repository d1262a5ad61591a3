"""Edited documents in segments: against the batch form, and in Structured Streaming."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphline.config import Engine
from glyphline.kernels.encode import Encoder
from glyphline.kernels.segments import DictStore, SegmentedDocument
from glyphline.kernels.stream import LimitError, ResyncDocument
from glyphline.kernels.vocab import PackError, base_language, base_vocabulary, raw_bpe_vocabulary
from glyphline.streaming import replay, resync


def _engine():
    return Engine(base_vocabulary(), (base_language("en"),)).seal()


def _random_edits(rng, n, longest=120):
    """(start, delete, insert) of a document that begins empty."""
    size, out = 0, []
    for k in range(n):
        start = rng.randrange(size + 1)
        delete = 0 if k == 0 else rng.randrange(min(60, size - start) + 1)
        insert = "".join(rng.choice(("the ", "token", "é", "漢", "\n", " and", "\x00")) for _ in range(rng.randrange(longest if k else 400))).encode()
        out.append((start, delete, insert))
        size += len(insert) - delete
    return out


@pytest.mark.parametrize("checkpoint", [1, 16, 64])
def test_segments_equal_the_batch_form(checkpoint):
    encoder = Encoder(base_vocabulary(), dict(base_language("en").deltas))
    rng = random.Random(checkpoint)
    for _ in range(4):
        plain, doc = ResyncDocument(encoder, b"", checkpoint), SegmentedDocument(encoder, DictStore(), checkpoint=checkpoint)
        for edit in _random_edits(rng, 40):
            before = doc.ids()
            plain.edit(*edit)
            c = doc.edit(*edit)
            now = plain.encode()[0]
            assert doc.data() == plain.data and doc.ids().tolist() == now and c.n_tokens == len(now) and c.length == len(plain.data)
            assert np.concatenate((before[: c.token_from], c.ids, before[c.token_from + c.removed :])).tolist() == now
            assert (c.reprocessed, c.reused_prefix, c.reused_suffix, c.resynchronized) == (plain.reprocessed, plain.reused_prefix, plain.reused_suffix, plain.resynchronized)
            # the state alone is enough to go on
            doc = SegmentedDocument(encoder, doc.store, doc.index, doc.following, checkpoint)


def test_bad_edits_and_settings_change_nothing():
    encoder = Encoder(base_vocabulary())
    doc = SegmentedDocument(encoder, DictStore(), checkpoint=8)
    doc.edit(0, 0, b"the quick brown fox jumps")
    for bad in ((26, 0, b""), (0, 26, b""), (-1, 0, b"x"), (3, -1, b"")):
        with pytest.raises(ValueError):
            doc.edit(*bad)
    assert doc.data() == b"the quick brown fox jumps"
    tight = SegmentedDocument(encoder, DictStore(), checkpoint=8, max_pending=encoder.max_len)
    tight.edit(0, 0, b"abc")
    try:
        tight.edit(1, 0, b"the " * 50)
    except LimitError:
        assert tight.data() == b"abc"
    with pytest.raises(PackError):
        SegmentedDocument(Encoder(raw_bpe_vocabulary()), DictStore())
    with pytest.raises(ValueError):
        SegmentedDocument(encoder, DictStore(), checkpoint=0)


def test_an_edit_touches_little_of_a_large_document():
    """10 MB: an edit reads and writes less than a hundredth of the state, in the middle and at both ends."""
    encoder = Encoder(base_vocabulary(), dict(base_language("en").deltas))
    doc = SegmentedDocument(encoder, DictStore())
    text = b"the tokens of a large document are kept in segments.\n" * 200_000
    doc.edit(0, 0, text)
    state = sum(len(d) + len(i) for d, i in doc.store.segments.values()) + sum(map(len, doc.store.points.values()))
    assert doc.length > 10_000_000
    for start, delete, insert in ((5_000_000, 3, b"edited"), (0, 0, b"first "), (doc.length - 10, 4, b""), (7_000_000, 0, b"x" * 100)):
        c = doc.edit(start, delete, insert)
        assert 0 < c.touched < state / 100 and c.reprocessed < 60_000


@pytest.fixture
def rocks(spark):
    old = {k: spark.conf.get(k) for k in (resync.STORE, "spark.sql.shuffle.partitions")}
    spark.conf.set(resync.STORE, resync.ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_stream_equals_batch(rocks, tmp_path):
    """Edits over several micro-batches, early, late and repeated: the deltas rebuild the batch form's ids and counters."""
    spark, engine, rng = rocks, _engine(), random.Random(9)
    rows = [(f"d{d}", seq, *edit) for d in range(3) for seq, edit in enumerate(_random_edits(rng, 14))]
    late = [r for r in rows if r[0] == "d1" and r[1] == 4]
    batches = [[r for r in rows if r not in late and r[1] < 7], [r for r in rows if 5 <= r[1] < 10] + late, [r for r in rows if r[1] >= 9] + [("d0", 14, 10**6, 0, b"outside"), ("d0", 15, None, None, b"x"), (None, 0, 0, 0, b""), ("d2", None, 0, 0, b"")]]
    source = tmp_path / "in"
    for k, batch in enumerate(batches):
        rng.shuffle(batch)
        spark.createDataFrame(batch, resync.EDITS).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(resync.EDITS).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = resync.resync_documents(stream, engine, checkpoint=32)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        assert (r.doc, r.seq) not in got
        got[r.doc, r.seq] = r
    assert sorted(got) == sorted([(r[0], r[1]) for r in rows] + [("d0", 14), ("d0", 15)])
    assert got["d0", 14].status == 1 and got["d0", 15].status == 0
    numbered = spark.createDataFrame([(int(d[1:]), *rest) for d, *rest in rows], "doc long, seq long, start long, delete long, insert binary")
    want = {(f"d{r.key}", r.seq): r for r in replay.edits(numbered, engine, "doc", "seq", "start", "delete", "insert", "resync", 32).collect()}
    ids = {d: [] for d in ("d0", "d1", "d2")}
    for (d, seq), r in sorted(got.items()):
        if seq < 14:
            ids[d] = ids[d][: r.token_from] + list(r.token_ids) + ids[d][r.token_from + r.tokens_removed :]
            w = want[d, seq]
            assert (replay.ids_digest(ids[d]), r.length, r.n_tokens) == (w.ids_sha256, w.length, w.n_tokens)
            assert (r.reprocessed, r.reused_prefix, r.reused_suffix, r.resynchronized) == (w.reprocessed, w.reused_prefix, w.reused_suffix, w.resynchronized)
    assert any(r.resynchronized for r in got.values())


def test_idle_documents_are_forgotten_and_early_edits_bounded(rocks, tmp_path):
    spark, engine = rocks, _engine()

    def run(rows):
        """One micro-batch; what came out of all so far."""
        spark.createDataFrame(rows, resync.EDITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(resync.EDITS).parquet(str(tmp_path / "in"))
        out = resync.resync_documents(stream, engine, max_early=100, idle_ms=1000)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(once=True).start()
        try:
            assert q.awaitTermination(60)
        finally:
            q.stop()
        return sorted((r.doc, r.seq, r.status, r.length) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = [("a", 0, 0, 14), ("a", 3, 9, 14)]  # the last is left out, the one before it waits
    assert run([("a", 0, 0, 0, b"the first text"), ("a", 2, 0, 0, b"x" * 50), ("a", 3, 0, 0, b"y" * 500)]) == first
    time.sleep(1.5)
    run([("b", 0, 0, 0, b"other")])  # the timer of a fires
    assert run([("a", 0, 0, 0, b"begins anew")]) == sorted([*first, ("b", 0, 0, 5), ("a", 0, 0, 11)])
