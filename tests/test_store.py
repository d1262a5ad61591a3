"""A cache read by key: files that are read, two writers, damage; encoding through it."""

import hashlib
import os
import random

from pyspark.sql import functions as F

from glyphline.operators import document, store, tokenize
from glyphline.queries import engine
from glyphline.sources import readers


def _rows(spark, texts):
    return document.cache_records(spark.createDataFrame([(t,) for t in texts], "text string"))


def _values(got):
    return {bytes(r.cache_key): (r.cache_status, None if r.cache_value is None else bytes(r.cache_value)) for r in got.collect()}


def test_only_files_of_wanted_prefixes_are_read(spark, tmp_path):
    table = store.CacheTable(spark, str(tmp_path / "c"), digits=2)
    rows = _rows(spark, [f"text {k}" for k in range(3000)])
    table.put(rows)
    parts = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "c") for f in names if f.endswith(".parquet")]
    assert len(parts) >= 250
    some = rows.where(F.hex("cache_key").startswith("7F") | F.hex("cache_key").startswith("01"))
    n = some.count()
    found = table.lookup(some)
    assert n and found.count() == n and 1 <= len(found.inputFiles()) <= 0.02 * len(parts)
    assert all(s == 0 for s, _ in _values(table.get(some)).values())
    assert len(table.lookup(rows).inputFiles()) == len(parts) and table.lookup(rows.limit(0)).count() == 0


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    """A writer finds that another made its version first, and makes its change on what that one left."""
    monkeypatch.setattr(store, "KEPT", 3)
    path = str(tmp_path / "c")
    one, two = store.CacheTable(spark, path, 1), store.CacheTable(spark, path, 1)
    rows = [_rows(spark, [f"{k} {n}" for n in range(20)]) for k in range(4)]
    one.put(rows[0])
    original = one._write
    calls = []

    def late(some):  # the other writes while this one is at it
        part = original(some)
        if not calls:
            calls.append(1)
            two.put(rows[1])
            two.remove(rows[0].where("text = '0 3'"))
        return part

    one._write = late
    one.put(rows[2])
    assert one.lookup(rows[0].unionByName(rows[1]).unionByName(rows[2])).count() == 59
    calls.clear()
    one.remove(rows[1])
    left = _values(one.get(rows[0].unionByName(rows[1]).unionByName(rows[2])))
    assert sorted(s for s, _ in left.values()) == [0] * 39 + [11] * 21
    one._write = original
    before = _values(one.get(rows[2]))
    one.put(rows[3])
    one.merge()
    assert len(one._state()[1]) == 1 and _values(two.get(rows[2])) == before and two.lookup(rows[3]).count() == 20
    for k in range(store.KEPT + 3):  # versions and parts that nobody needs go
        one.put(_rows(spark, [f"more {k}"]))
    assert len(one.versions()) == store.KEPT and one.lookup(_rows(spark, [f"more {k}" for k in range(store.KEPT + 3)])).count() == store.KEPT + 3
    one.merge()


def test_damaged_entries_and_odd_keys(spark, tmp_path):
    table = store.CacheTable(spark, str(tmp_path / "c"), 1)
    rows = _rows(spark, ["a", "b", "c"])
    assert {s for s, _ in _values(table.get(rows)).values()} == {11}
    table.remove(rows)
    bad = rows.withColumn("cache_record", F.when(F.col("text") == "a", F.lit(b"short")).otherwise(F.lit(rows.where("text = 'c'").first().cache_record)))
    table.put(bad.unionByName(bad))
    got = _values(table.get(rows))
    key = lambda t: hashlib.sha256(t.encode()).digest()
    assert got == {key("a"): (12, None), key("b"): (12, None), key("c"): (0, b"c")}


def _texts(rng, n):
    words = ["the ", "token", "é", "漢字 ", "\n", "नमस्ते ", "x", "  "]
    shared = "".join(rng.choice(words) for _ in range(9000))
    return [("".join(rng.choice(words) for _ in range(rng.randrange(4000))) + (shared if k % 3 == 0 else "")) for k in range(n)]


def test_encoding_through_the_cache(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "HOT_KEYS", 3)
    rng, own = random.Random(3), engine("en", "hi")
    texts = [*_texts(rng, 40), "", None, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    cuts = {}
    for r in store.pieces(df, own, ["id"]).collect():
        cuts.setdefault(r.id, []).append((r.piece, bytes(r.content)))
    assert all(b"".join(c for _, c in sorted(cuts.get(i, []))) == (t or "").encode() for i, t in enumerate(texts))
    table = store.CacheTable(spark, str(tmp_path / "c"), 1)
    want = {r.id: list(r.ids) if r.ids is not None else None for r in tokenize.encode_ids(df, own).collect()}

    def run(frame):
        out, counts = store.encode_cached(frame, own, table, ["id"])
        return {r.id: r.ids for r in readers.unpack_ids(out).collect()}, counts

    got, first = run(df)
    assert got == want and first["encoded"] == first["distinct"] < first["pieces"]  # what texts share is encoded once
    got, again = run(df)
    assert got == want and again["encoded"] == 0 and again["stored"] == again["distinct"]
    changed = df.withColumn("text", F.when(F.col("id") == 0, F.concat(F.substring("text", 1, 2000), F.lit("edited "), F.substring("text", 2001, 100_000))).otherwise(F.col("text")))
    got, some = run(changed)
    assert got[1] == want[1] and 1 <= some["encoded"] <= 4
    assert got[0] == list(tokenize.encode_ids(changed.where("id = 0"), own).first().ids)
    # a damaged entry is encoded anew
    key = store.pieces(df.where("id = 1"), own, ["id"]).select("cache_key").limit(1)
    record = table.lookup(key).withColumn("cache_record", F.lit(b"damaged"))
    record = spark.createDataFrame(record.collect(), record.schema)
    table.remove(key)
    table.put(record)
    got, mended = run(df)
    assert got == want and mended["encoded"] == 1
    assert run(df.limit(0))[1] == {"pieces": 0, "distinct": 0, "stored": 0, "encoded": 0}
