"""Data sources and sinks: planning, pushed filters, and what is left of a job that fails."""

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from glyphline.kernels.vocab import PackError, base_language, base_vocabulary, raw_bpe_vocabulary
from glyphline.sources import files, formats, packs


@pytest.fixture(scope="module", autouse=True)
def _registered(spark):
    formats.register(spark)


def _tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_a_folder_of_containers(spark, tmp_path):
    vocabulary, language = packs.write_vocabulary(base_vocabulary()), packs.write_language(base_language("en"))
    for k in range(1000):
        folder = tmp_path / "packs" / f"d{k % 7}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"p{k:04d}.pack").write_bytes(vocabulary if k % 4 else language)
    (tmp_path / "packs" / "_hidden").write_bytes(b"x")
    df = spark.read.format("glyphline_pack").option("tasks", 8).load(str(tmp_path / "packs"))
    assert 8 <= df.rdd.getNumPartitions() <= 16
    assert {(r.kind, r["count"]) for r in df.groupBy("kind").count().collect()} == {(1, 1000), (2, 1000), (4, 750), (5, 250)}
    some = df.where("kind = 4")
    assert "kind" in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 750 and {bytes(r.body) for r in some.select("body").distinct().collect()} == {packs.section(vocabulary, 4)}
    assert df.where("kind in (4, 5) and kind = 5").select("magic", "length").distinct().collect() == [("MSLG", len(packs.section(language, 5)))]
    assert spark.read.format("glyphline_pack").option("pathGlobFilter", "p000*.pack").load(str(tmp_path / "packs")).where("section = 0").count() == 10


def test_only_wanted_bodies_are_read(tmp_path, monkeypatch):
    """A large container is planned by its sections, and a pushed filter leaves the other bodies alone."""
    from pyspark.sql.datasource import EqualTo, In, IsNotNull

    data = packs.write_vocabulary(base_vocabulary())
    (tmp_path / "one.pack").write_bytes(data)
    monkeypatch.setattr(formats, "TASK_BYTES", 100)
    source = formats.PushedPackSource({"path": str(tmp_path), "tasks": "4"})
    reader = source.reader(None)
    assert [p.files[0][1:] for p in reader.partitions()] == [(0, 1), (1, 2), (2, 3)]
    rest = list(reader.pushFilters([EqualTo(("kind",), 4), In(("kind",), (4, 5)), IsNotNull(("kind",))]))
    assert len(rest) == 1 and [p.files for p in reader.partitions()] == [[(str(tmp_path / "one.pack"), 2, 3)]]
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read(self, n=None):
            out = self.f.read(n)
            read.append(len(out))
            return out

        def seek(self, at):
            return self.f.seek(at)

        def size(self):
            return self.f.size()

    class Store:
        def open_input_file(self, path):
            return Counted(files.store_of(path)[0].open_input_file(path))

    monkeypatch.setattr(formats, "store_of", lambda p: (Store(), p))
    rows = list(reader.read(formats.Ranges([(str(tmp_path / "one.pack"), 2, 3)])))
    assert rows[0][2:6] == (2, 4, "MSVC", len(packs.section(data, 4))) and sum(read) == packs.HEADER + 3 * packs.ENTRY + len(rows[0][6])


def test_bad_containers(spark, tmp_path):
    good = packs.write_vocabulary(base_vocabulary())
    (tmp_path / "good.pack").write_bytes(good)
    (tmp_path / "short.pack").write_bytes(good[:50])
    (tmp_path / "hash.pack").write_bytes(good[:-1] + bytes([good[-1] ^ 1]))
    load = lambda **o: spark.read.format("glyphline_pack").options(**o).load(str(tmp_path))
    with pytest.raises(Exception, match="not a container"):
        load().count()
    names = {"status": "true"}
    got = sorted((os.path.basename(r.path), r.status, r.section) for r in load(**names).collect())
    assert got == sorted([("short.pack", 3, -1), *((n, 0, k) for n in ("good.pack", "hash.pack") for k in range(3))])
    got = {(os.path.basename(r.path), r.status) for r in load(**names, verify="true").collect()}
    assert got == {("short.pack", 3), ("hash.pack", 3), ("good.pack", 0)}
    with pytest.raises(Exception, match="NotFound|FileNotFound|No such"):
        spark.read.format("glyphline_pack").load(str(tmp_path / "none")).count()


def test_ranks_and_ids_come_back(spark, tmp_path):
    rows = [(bytearray(s), i) for i, _, s in raw_bpe_vocabulary().rows]
    ranks = spark.createDataFrame(rows, "surface binary, rank bigint").repartitionByRange(3, "rank").sortWithinPartitions("rank")
    path = str(tmp_path / "ranks")
    ranks.write.format("glyphline_ranks").mode("overwrite").save(path)
    back = spark.read.format("glyphline_ranks").load(path)
    assert sorted((bytes(r.surface), r["rank"]) for r in back.collect()) == sorted((bytes(s), i) for s, i in rows)
    text = "".join(open(os.path.join(path, f)).read() for f in _tree(path) if f.endswith(".tiktoken"))
    assert text == packs.format_tiktoken(raw_bpe_vocabulary()) and files.MARK in _tree(path)
    ids = [("a.u32", [1, 2, 4294967295]), ("sub/b.u32", []), ("c.u32", None)]
    df = spark.createDataFrame(ids, "path string, ids array<bigint>").repartition(2)
    path = str(tmp_path / "ids")
    df.write.format("glyphline_ids").mode("append").save(path)
    got = {os.path.relpath(r.path, path): r.ids for r in spark.read.format("glyphline_ids").load(path).collect()}
    assert got == {"a.u32": [1, 2, 4294967295], "sub/b.u32": [], "c.u32": []}
    with pytest.raises(Exception, match="FileExistsError|a.u32"):
        df.write.format("glyphline_ids").mode("append").save(path)
    assert sorted(_tree(path)) == sorted([files.MARK, "a.u32", "c.u32", "sub/b.u32"])
    df.where("path = 'a.u32'").write.format("glyphline_ids").mode("overwrite").save(path)
    assert _tree(path) == [files.MARK, "a.u32"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "ids")
    good = spark.range(40).selectExpr("concat('f', id, '.u32') as path", "array(id) as ids").repartition(4)
    bad = good.withColumn("ids", F.when(F.col("path") == "f7.u32", F.array(F.lit(-1).cast("bigint"))).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="out of range"):
        bad.write.format("glyphline_ids").mode("append").save(path)
    assert _tree(path) == []
    good.write.format("glyphline_ids").mode("append").save(path)
    for odd, what in (("concat('../', path)", "unsafe"), ("'same'", "same file name"), ("cast(null as string)", "missing")):
        with pytest.raises(Exception, match=what):
            good.selectExpr(f"{odd} as path", "ids").write.format("glyphline_ids").mode("append").save(path)
    assert len(_tree(path)) == 41 and files.STAGING not in os.listdir(path)
    assert spark.read.format("glyphline_ids").load(path).select(F.sum(F.get("ids", F.lit(0)))).first()[0] == sum(range(40))


def test_records_and_archives_come_back(spark, tmp_path):
    data = [bytes([k % 256]) * (k * 37 % 500) for k in range(200)]
    path = str(tmp_path / "records")
    spark.createDataFrame([(bytearray(d),) for d in data], "record binary").repartition(5).write.format("glyphline_records").mode("append").save(path)
    assert sorted(bytes(r.record) for r in spark.read.format("glyphline_records").load(path).collect()) == sorted(data)
    part = next(os.path.join(path, f) for f in _tree(path) if f.endswith(".rec"))
    whole = bytearray(open(part, "rb").read())
    whole[-1] ^= 1
    open(part, "wb").write(bytes(whole))
    with pytest.raises(Exception, match="bad record"):
        spark.read.format("glyphline_records").load(path).count()

    entries = [(f"dir{k % 3}/file{k}", False, k, bytearray(os.urandom(k * 13))) for k in range(30)] + [("dir0", True, 5, None)]
    path = str(tmp_path / "archives")
    df = spark.createDataFrame(entries, "path string, folder boolean, time bigint, content binary").repartition(3)
    for level in ("0", "6"):
        df.write.format("glyphline_archive").option("root", "box").option("level", level).mode("overwrite").save(path)
        back = spark.read.format("glyphline_archive").load(path)
        got = sorted((r.path, r.folder, r.time, bytes(r.content), r.crc32, r.root) for r in back.collect())
        assert got == sorted((p, f, t, bytes(c or b""), zlib.crc32(bytes(c or b"")), "box") for p, f, t, c in entries)


def test_archive_streams():
    entries = [("a", False, 7, b"content"), ("b/c", True, 0, b"")]
    data = formats.write_archive(entries, "root")
    assert struct.unpack_from("<4I2QI", data)[:4] == (0x31434D5A, 1, 1, 6) and data[:4] == b"ZMC1"
    assert formats.read_archive(data) == ("root", entries) and formats.read_archive(formats.write_archive([], level=0)) == ("", [])
    for at in (0, 4, 8, 20, 34, 45, len(data) - 1):  # magic, version, algorithm, sizes, CRC, packed bytes
        with pytest.raises(PackError):
            formats.read_archive(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :])
    for cut in (0, 39, 40, len(data) - 1):
        with pytest.raises(PackError):
            formats.read_archive(data[:cut])


def test_native_bytes_grow_with_the_bytes(spark):
    """A text of 1 MB in seconds: nothing in a lambda is made anew for each byte."""
    import time

    from glyphline.functions import native
    from glyphline.operators import tokenize
    from glyphline.queries import engine
    from glyphline.sources import readers

    text = "the token é " * 80_000
    df = spark.createDataFrame([(text,), ("",), (None,), ("x",)], "text string")
    begin = time.time()
    native_n = [r.n_segments for r in tokenize.segments_sql(df, engine()).collect()]
    kernel_n = [r.n_segments for r in tokenize.segments(df, engine()).collect()]
    assert native_n[:2] == kernel_n[:2] and native_n[3] == kernel_n[3] == 1
    ids = df.select(native.byte_ids(F.encode("text", "UTF-8")).alias("ids")).collect()
    assert [r.ids for r in ids] == [list(text.encode()), [], None, [120]]
    packed = spark.createDataFrame([(bytearray(b"\x01\x02\x03\xff" * 250_000),), (bytearray(),), (bytearray(b"abc"),)], "packed_ids binary")
    got = [r.ids for r in readers.unpack_ids(packed).collect()]
    assert len(got[0]) == 250_000 and set(got[0]) == {0xFF030201} and got[1:] == [[], None]
    assert time.time() - begin < 60
