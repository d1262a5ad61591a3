"""Configuration made of tables, fixed cases of engines and containers, and events."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from glyphline.config import STATUS, Engine, Limits
from glyphline.kernels.vocab import PackError, base_detector, base_language, base_vocabulary, raw_bpe_vocabulary
from glyphline.operators import metrics, observer, registry, tokenize
from glyphline.queries import engine, registry_table
from glyphline.sources import packs, readers
from glyphline.streaming.processors import online_tokens

#: SHA-256 of the containers of the built-in languages; fixed values.
LANGUAGE_FILES = {
    "en": (372, "75179427e58eeade21cfa70d5ea1af127a497a849f55d6cb6e915a421c104551"),
    "hi": (373, "309fdd7db255d9dd5ba704c095805e7049a08fae0f9bb8655edaab100b142e9e"),
    "ja": (357, "7abcebfa000d09583190edd33bb6833245fa79c2c0977ba2743d83f3e83aa9e3"),
}


def test_language_files():
    for tag, (size, sha256) in LANGUAGE_FILES.items():
        data = packs.write_language(base_language(tag))
        assert (len(data), hashlib.sha256(data).hexdigest()) == (size, sha256)


def test_rank_file_checks(spark):
    lines = packs.format_tiktoken(raw_bpe_vocabulary()).splitlines()
    rows = lambda x: readers.tiktoken_rows(spark.createDataFrame([(v,) for v in x], "value string"))
    assert readers.check_tiktoken(rows(lines)).count() == 0
    assert {r.problem for r in readers.check_tiktoken(rows([*lines[3:], "eHl6 100", "eHh4 x"])).collect()} == {"bad line", "duplicate rank", "missing byte"}


def _status(call) -> int:
    try:
        call()
    except PackError as e:
        return e.status
    return 0


def test_engine_states(spark):
    plain = Engine(base_vocabulary())
    assert _status(lambda: plain.seal().with_limits(Limits())) == 13
    assert _status(lambda: plain.with_language(base_language("en")).with_language(base_language("en"))) == 8
    assert _status(lambda: plain.with_detector(base_detector()).with_detector(base_detector())) == 8
    assert _status(lambda: tokenize.encode_batch(spark.createDataFrame([("a",)], "text string"), plain)) == 13
    assert _status(lambda: Limits(0)) == 1
    assert engine("en", "hi").fingerprint() == engine("hi", "en").fingerprint() != engine("en").fingerprint()


def test_languages_as_tables(spark):
    e = engine("en", "hi", "ja")
    deltas = tokenize.language_table(spark, e)
    assert {r.tag: (r.status, r.n_deltas, r.total) for r in tokenize.language_sizes(deltas).collect()} == {"en": (0, 2, -50), "hi": (0, 1, -60), "ja": (0, 1, -60)}
    attached = {r.token_id: r.delta for r in tokenize.adjustments(spark, e).collect()}
    assert {i: d for i, d in attached.items() if d} == {271: -40, 258: -10, 273: -60, 274: -60} and len(attached) == 275
    odd = spark.createDataFrame([("a_b", b"x", 1), ("", b"x", 1), (None, b"x", 1), ("ok", b"x", 1), ("ok", b"x", 2), ("a\n", b"y", 1)], "tag string, surface binary, delta int")
    assert {r.tag: (r.status, r.n_deltas, r.total) for r in tokenize.language_sizes(odd).collect()} == {"a_b": (1, 1, 1), "": (1, 1, 1), None: (1, 1, 1), "ok": (3, 1, 3), "a\n": (1, 1, 1)}
    assert tokenize.language_sizes(odd.limit(0)).count() == 0
    words = spark.createDataFrame([(1, 5, b"x"), (2, 6, b"x"), (3, 7, b"z"), (4, 8, None)], "token_id long, cost int, surface binary")
    assert {r.token_id: r.delta for r in tokenize.attach_deltas(words, odd).collect()} == {1: 6, 2: 6, 3: 0, 4: 0}


def test_resolved_constraints(spark):
    asked = [("a", "model", "^1.2.3", "1.9.0"), ("b", "model", "^0.2.3", "0.2.9"), ("c", "model", "^0.0.3", "0.0.3"), ("d", "model", ">=1.0.0, <10.0.0", "2.0.0"), ("e", "model", ">2.0.0", "10.0.0"), ("f", "model", "==0.3.0", "0.3.0"), ("g", "lexer", "1.2.3", "1.2.3")]
    need = spark.createDataFrame([(r, "acme", n, c) for r, n, c, _ in asked], "role string, publisher string, name string, constraint string")
    found = registry.resolve(registry_table(spark), need)
    assert found.columns == ["role", *registry_table(spark).columns]
    assert {r.role: (r.name, r.version) for r in found.collect()} == {r: (n, v) for r, n, _, v in asked}
    assert registry.resolve(registry_table(spark), need.limit(0)).count() == 0


def test_status_texts(spark):
    rows = spark.createDataFrame([(k,) for k in (*range(16), -1, 16, None)], "s int").select("s", metrics.status_texts(F.col("s")).alias("t")).collect()
    assert [r.t for r in rows] == [*STATUS, "unknown status", "unknown status", None]


# --- events ---------------------------------------------------------------------------------------


def _steps():
    n = F.octet_length("text")
    return n, [("encode", F.col("status"), n, F.size("ids")), ("decode", F.col("decode_status"), F.size("ids"), F.octet_length("decoded")), ("detect", F.lit(0), n, F.lit(0))]


def test_row_events(spark):
    small = engine("en", limits=Limits(8))
    docs = spark.createDataFrame([(1, "hello"), (2, "hello tokenizer"), (3, "")], "k int, text string")
    rows = tokenize.decode(tokenize.encode_ids(docs, small), small).withColumn("decode_status", F.when(F.col("status") == 0, F.col("decode_status")))
    _, steps = _steps()
    got = observer.operation_events(rows, ["k"], steps).orderBy("k", "sequence").collect()
    assert [(r.k, r.sequence, r.operation, r.kind, r.status) for r in got] == [(1, 1, "encode", "success", 0), (1, 2, "decode", "success", 0), (1, 3, "detect", "success", 0), (2, 1, "encode", "resource", 9), (2, 2, "detect", "success", 0), (3, 1, "encode", "success", 0), (3, 2, "decode", "success", 0), (3, 3, "detect", "success", 0)]
    assert got[0].status_text == "ok" and got[3].status_text == "resource limit" and (got[0].input_units, got[1].output_units) == (5, 5)
    only = observer.operation_events(rows, ["k"], steps, observer.RESOURCE).collect()
    assert [(r.k, r.sequence, r.operation) for r in only] == [(2, 1, "encode")]
    assert observer.operation_events(rows.limit(0), ["k"], steps).count() == 0


def test_batch_events_are_ordered_masked_and_guarded(spark):
    small = engine("en", limits=Limits(8))
    docs = spark.createDataFrame([(1, "hello"), (2, "hello tokenizer"), (3, "")], "k int, text string")
    n, _ = _steps()

    def run(watcher):
        encoded = watcher.watch(tokenize.encode_ids(docs, small), "encode", F.col("status"), n, F.size("ids"))
        decoded = tokenize.decode(encoded, small)
        decoded = watcher.watch(decoded, "decode", F.when(F.col("status") == 0, F.col("decode_status")), F.size("ids"), F.octet_length("decoded"))
        found = watcher.watch(tokenize.detect(decoded, small), "detect", F.lit(0), n, F.lit(0))
        found.write.format("noop").mode("overwrite").save()
        watcher.deliver()

    events = []
    run(observer.Observer(events.append, small))
    assert [(e.sequence, e.operation, e.kind, e.operations, e.input_units) for e in events] == [(1, "encode", 1, 2, 5), (2, "encode", 4, 1, 15), (3, "decode", 1, 2, 1), (4, "detect", 1, 3, 20)]
    assert [e.resource_limit for e in events] == [0, 8, 0, 0] and {e.fingerprint for e in events} == {small.fingerprint()} and events[2].output_units == 5
    masked = []
    run(observer.Observer(masked.append, small, observer.RESOURCE))
    assert [(e.sequence, e.operation) for e in masked] == [(1, "encode")]
    nested = []

    def again(event):
        nested.append(event)
        if len(nested) == 1:
            run(guarded)

    guarded = observer.Observer(again, small)
    run(guarded)
    assert [e.sequence for e in nested] == [1, 2, 3, 4]


def test_stream_events(spark, tmp_path):
    e = engine("en")
    events = []
    watcher = observer.Observer(events.append, e)
    listener = watcher.listener()
    source = str(tmp_path / "in")
    rows = [("s", 0, b"hello ", False), ("s", 1, b"tokenizer", True), ("t", 0, b"the", True)]
    schema = "stream string, seq long, chunk binary, last boolean"
    spark.createDataFrame(rows[:1], schema).coalesce(1).write.parquet(source)
    tokens = online_tokens(spark.readStream.schema(schema).parquet(source), e)
    watched = watcher.watch(tokens, "stream", F.when(F.col("token_no") < 0, F.col("token_id")).otherwise(0), F.col("length"), F.lit(1))
    spark.streams.addListener(listener)
    try:
        query = watched.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        spark.createDataFrame(rows[1:], schema).coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
        query.stop()
        until = time.time() + 30
        while sum(x.input_units for x in events) < 18 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert sum(x.input_units for x in events) == 18 and {x.operation for x in events} == {"stream"}
    assert [x.sequence for x in events] == list(range(1, len(events) + 1)) and [x.batch for x in events] == sorted(x.batch for x in events)
