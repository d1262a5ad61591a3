"""A cache that is a table read by key, and encoding that goes through it."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import INTEGRITY, NOT_FOUND, OK, Engine
from ..kernels import records
from ..plans.kernel import bounded_batches, build_once, flat_kernel, slices, to_bytes, with_kernel

#: Hexadecimal digits of a key that name its folder: 256 folders; more for tables of many TB.
DIGITS = 2
#: Versions of the list of files that are kept for readers that began with them.
KEPT = 16
#: Bytes of a piece that is encoded and stored on its own: at least, and at most but for a longer stretch without a boundary.
PIECE, LONGEST = 1 << 10, 8 << 10
#: A boundary of so many ends a piece, by the bytes before it.
ONE_IN = 16
#: A key that more than one of so many rows have is joined by broadcast.
HOT_KEYS = 2_000
PIECE_DOMAIN = b"glyphline piece v1\0"
#: Keys that are broadcast at most, so that other entries and pieces are left out where they are read.
FEW_KEYS = 100_000
#: In place of a piece's number, of a source without pieces: it is empty, it is null.
EMPTY, NULL = -1, -2


@contextmanager
def _shuffles_dropped(spark):
    """What is written here leaves no shuffle files, which else stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class CacheTable:
    """Entries (cache_key, cache_record) in files by key prefix, verified before a value is returned.

    Keys are digests. A part is a folder of one file for each prefix that it has; the list of parts that
    count is a file of its own for each version, which is made by a rename that fails if another
    writer has made this version meanwhile: then the change is made again on what that writer
    left. A reader keeps to the version that it began with. Files of parts that no longer count
    are deleted when the versions that name them are.
    """

    def __init__(self, spark, path: str, digits: int = DIGITS):
        self.spark, self.path, self.digits = spark, path.rstrip("/"), digits
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._place = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._files = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = hadoop.FileContext.getFileContext(hadoop.Path(self.path).toUri() if "://" in self.path else self._files.getUri(), spark._jsc.hadoopConfiguration())
        self._plain = spark._sc._gateway.new_array(hadoop.Options.Rename, 0)

    # --- versions

    def versions(self) -> list[int]:
        if not self._files.exists(self._place("")):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._place(""))]
        return sorted(int(n.removeprefix("CURRENT-")) for n in names if n.startswith("CURRENT-") and n[8:].isdigit())

    def _state(self) -> tuple[int, list[str]]:
        """The newest version and its parts."""
        known = self.versions()
        if not known:
            return 0, []
        lines = self.spark.read.text(f"{self.path}/CURRENT-{known[-1]:012d}").collect()
        return known[-1], [r.value for r in lines if r.value]

    def _switch(self, version: int, names: list[str]) -> bool:
        """Make the version after ``version``; False if there is one."""
        new = self._place(f"_CURRENT.{uuid.uuid4().hex}")
        out = self._files.create(new)
        out.write(bytearray("\n".join(names).encode()))
        out.close()
        place = self._place(f"CURRENT-{version + 1:012d}")
        try:
            self._context.rename(new, place, self._plain)
        except Exception:
            if not self._files.exists(place):
                raise
            self._files.delete(new, False)
            return False
        self._forget(version + 1)
        return True

    def _forget(self, newest: int) -> None:
        """Delete versions beyond those kept, and parts that none of the kept ones names."""
        known = self.versions()
        old = [v for v in known if v <= newest - KEPT]
        if not old:
            return
        parts = lambda v: {r.value for r in self.spark.read.text(f"{self.path}/CURRENT-{v:012d}").collect() if r.value}
        kept = set().union(*(parts(v) for v in known if v not in old))
        gone = set().union(*map(parts, old)) - kept
        for v in old:
            self._files.delete(self._place(f"CURRENT-{v:012d}"), False)
        for name in gone:
            self._files.delete(self._place(name), True)

    # --- rows

    def stage(self, rows: DataFrame) -> DataFrame:
        """rows, made once: written beside the parts, of which they are none, until the application ends."""
        name = f"staged-{uuid.uuid4().hex}"
        with _shuffles_dropped(self.spark):
            rows.select("*").write.parquet(f"{self.path}/{name}")
        self._files.deleteOnExit(self._place(name))
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def _prefix(self):
        return F.lower(F.substring(F.hex("cache_key"), 1, self.digits))

    def _write(self, rows: DataFrame) -> str:
        return self._save(rows.withColumn("prefix", self._prefix()).repartition(F.col("prefix")).sortWithinPartitions("prefix", "cache_key"))

    def _save(self, rows: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        with _shuffles_dropped(self.spark):
            rows.select("*").write.option("compression", "zstd").partitionBy("prefix").parquet(f"{self.path}/{name}")
        return name

    def encode(self, contents: DataFrame, known: DataFrame, engine: Engine) -> str:
        """Encode and add the entries of (cache_key, content), each different key once and none that ``known`` has; the name of their part.

        Contents meet in their prefix's task and become records there, so that they are shuffled and not the records, which are larger.
        """
        rows = contents.select("cache_key", "content").unionByName(known.select("cache_key", F.lit(None).cast("binary").alias("content")))
        rows = rows.withColumn("prefix", self._prefix()).repartition(F.col("prefix")).sortWithinPartitions("prefix", "cache_key", F.col("content").isNotNull())
        part = self._save(rows.mapInArrow(_encoded(engine), "cache_key binary, cache_record binary, prefix string"))
        version, names = self._state()
        while not self._switch(version, [*names, part]):
            version, names = self._state()
        return part

    def checked(self, wanted: DataFrame, n: int, values: bool) -> DataFrame:
        """cache_key and cache_status of entries, and their values, compressed, if asked for, checked where they are read.

        Entries that aren't ``wanted`` are left out if it is of few keys, ``n``; else they may be among the rows. A damaged one of equal keys counts.
        """
        schema = "cache_key binary, cache_status int, packed binary"
        found = self._read()
        if found is None:
            return self.spark.createDataFrame([], schema)
        found = found.select("cache_key", "cache_record")
        if n <= FEW_KEYS:
            found = found.join(F.broadcast(wanted.select("cache_key")), "cache_key", "left_semi")
        bounded_batches(self.spark)
        return found.mapInArrow(_checked(values), schema).groupBy("cache_key").agg(F.max("cache_status").alias("cache_status"), F.first("packed", True).alias("packed"))

    def _read(self, prefixes: list[str] | None = None) -> DataFrame | None:
        _, names = self._state()
        return self._parts(names, prefixes)

    def _parts(self, names: list[str], prefixes: list[str] | None = None) -> DataFrame | None:
        """Entries of some parts; of few ``prefixes`` only these folders are listed and read."""
        schema = "cache_key binary, cache_record binary, prefix string"
        out = None
        for name in names:
            base = f"{self.path}/{name}"
            reader = self.spark.read.schema(schema)
            if prefixes is not None and 4 * len(prefixes) <= 16**self.digits:
                there = [p for p in prefixes if self._files.exists(self._place(f"{name}/prefix={p}"))]
                if not there:
                    continue
                rows = reader.option("basePath", base).parquet(*[f"{base}/prefix={p}" for p in there])
            else:
                rows = reader.parquet(base)
            out = rows if out is None else out.unionByName(rows)
        return out

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The entries of some keys, each once; only the files of their prefixes are read."""
        wanted = keys.select("cache_key").distinct()
        prefixes = [r[0] for r in wanted.select(self._prefix().alias("p")).distinct().collect()]  # at most 16 ** digits
        found = self._read(prefixes)
        if found is None:
            return self.spark.createDataFrame([], "cache_key binary, cache_record binary")
        return found.join(wanted, "cache_key", "left_semi").select("cache_key", "cache_record").dropDuplicates(["cache_key"])

    def get(self, keys: DataFrame) -> DataFrame:
        """keys with cache_status (11: not there, 12: not what its key says) and cache_value."""
        found = keys.select("cache_key").distinct().join(self.lookup(keys), "cache_key", "left")
        found = read_cache_records(found)
        other = F.substring("cache_record", 25, 32) != F.col("cache_key")  # another key's entry
        status = F.when(other, F.lit(INTEGRITY)).otherwise(F.coalesce("cache_status", F.lit(NOT_FOUND)))
        return found.select("cache_key", status.alias("cache_status"), F.when(~F.coalesce(other, F.lit(False)), F.col("cache_value")).alias("cache_value"))

    def put(self, rows: DataFrame) -> None:
        """Add the entries whose keys aren't there yet. Two writers that put one key leave two equal entries, read as one."""
        rows = rows.select("cache_key", "cache_record").dropDuplicates(["cache_key"])
        version, names = self._state()
        if names:
            rows = self.stage(rows)  # they are looked up before they are written
            rows = rows.join(self.lookup(rows).select("cache_key"), "cache_key", "left_anti")
        part = self._write(rows)
        while not self._switch(version, [*names, part]):
            version, names = self._state()

    def remove(self, keys: DataFrame) -> None:
        """Write the table without some keys as one part, then let it count."""
        gone = keys.select("cache_key").distinct()
        while True:
            version, names = self._state()
            old = self._parts(names)
            if old is None:
                return
            part = self._write(old.select("cache_key", "cache_record").join(gone, "cache_key", "left_anti"))
            if self._switch(version, [part]):
                return
            self._files.delete(self._place(part), True)

    def merge(self) -> None:
        """Write all parts as one, a file for each prefix, an entry for each key."""
        while True:
            version, names = self._state()
            if len(names) < 2:
                return
            part = self._write(self._parts(names).select("cache_key", "cache_record").dropDuplicates(["cache_key"]))
            if self._switch(version, [part]):
                return
            self._files.delete(self._place(part), True)


def _cache_read():
    def fn(data):
        try:
            return OK, records.read_cache_record(data)
        except records.RecordError as e:
            return e.status, None

    return fn


def read_cache_records(df: DataFrame, column: str = "cache_record") -> DataFrame:
    """df with cache_status and cache_value; a record that doesn't agree has status 12."""
    return with_kernel(df, column, "cache_status int, cache_value binary", _cache_read)


# --- encoding through the cache -------------------------------------------------------------------


def _pieces(engine: Engine):
    encoder = engine.encoder()

    def fn(data):
        if len(data) <= PIECE:
            return [(0, data)] if data else []
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        cuts = np.flatnonzero(~encoder.cross[b[:-1] << 8 | b[1:]]) + 1
        ok = cuts[cuts >= 4]
        mark = (b[ok - 4] * 2654435761 + b[ok - 3] * 40503 + b[ok - 2] * 2246822519 + b[ok - 1] * 3266489917) & 0xFFFFFFFF
        ends = ok[(mark >> 13) % ONE_IN == 0].tolist()
        out, begin = [], 0
        while begin < len(data):
            k = bisect_left(ends, begin + PIECE)
            at = ends[k] if k < len(ends) else len(data)
            if at > begin + LONGEST:  # the first boundary at or behind the longest
                k = int(np.searchsorted(cuts, begin + LONGEST))
                at = min(at, int(cuts[k])) if k < len(cuts) else at
            out.append((len(out), data[begin:at]))
            begin = at
        return out

    return fn


def pieces(df: DataFrame, engine: Engine, keys: list[str], column: str = "text") -> DataFrame:
    """keys, piece, content and cache_key of the pieces that each source is cut into.

    Cuts are at places that no token can cross, chosen by the bytes before them, so that equal
    stretches of different sources are equal pieces. The key is a digest of the engine's identity and the content.
    """
    rows = flat_kernel(df, keys, column, "piece int, content binary", _pieces, engine)
    head = F.lit(bytearray(PIECE_DOMAIN + engine.fingerprint()))
    return rows.withColumn("cache_key", F.unhex(F.sha2(F.concat(head, F.col("content")), 256)))


def _keyed(engine: Engine, content: bool):
    """Numbers and keys of the pieces of a source, behind a byte that is 0 for null; with their content if asked for."""
    cut, head = _pieces(engine), PIECE_DOMAIN + engine.fingerprint()

    def fn(data):
        if len(data) < 2:
            return [] if content else [(EMPTY if data[0] else NULL, None)]
        found = [(k, hashlib.sha256(head + d).digest(), d) for k, d in cut(data[1:])]
        return found if content else [f[:2] for f in found]

    return fn


def _keyed_pieces(df: DataFrame, engine: Engine, keys: list[str], column: str, content: bool) -> DataFrame:
    data = F.concat(F.lit(b"\1"), to_bytes(df, column))
    rows = df.select(*keys, F.coalesce(data, F.lit(b"\0")).alias("__data"))
    return flat_kernel(rows, keys, "__data", "piece int, cache_key binary" + ", content binary" * content, _keyed, engine, content)


def _encoded(engine: Engine):
    """For mapInArrow over (cache_key, content, prefix), sorted: cache_key and cache_record of packed ids of each first row that has a content."""

    def run(batches):
        import pyarrow as pa

        encoder, last = build_once(_encoder, (engine,)), None
        for whole in batches:
            for part in slices(whole, 1):
                rows = []
                for key, content, prefix in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if key != last and content is not None:
                        rows.append((key, content, prefix))
                    last = key
                if not rows:
                    continue
                keys, contents, prefixes = zip(*rows, strict=True)
                ids, _, at = encoder.encode_many(contents)
                ids, at = ids.astype("<u4"), at.tolist()
                made = [records.write_cache_record(k, ids[a:z].tobytes()) for k, a, z in zip(keys, at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(made, pa.binary()), pa.array(prefixes, pa.string())], ["cache_key", "cache_record", "prefix"])

    return run


def _checked(values: bool):
    """For mapInArrow over (cache_key, cache_record): cache_key, cache_status and, if asked for, the compressed value."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for part in slices(whole, 1):
                out = []
                for key, record in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    try:
                        value = records.read_cache_record(record, key)
                        out.append((key, OK, compressed(value) if values else None))
                    except records.RecordError as e:
                        out.append((key, e.status, None))
                if out:
                    columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["cache_key", "cache_status", "packed"])

    return run


def compressed(ids: bytes) -> bytes:
    """Packed ids: the first bytes of all, then the second ones and so on, compressed; as they are behind a byte 0 if they aren't whole."""
    if len(ids) % 4:
        return b"\0" + ids
    return b"\1" + zlib.compress(np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes(), 6)


def uncompressed(data: bytes) -> bytes:
    if not data[0]:
        return data[1:]
    return np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(4, -1).T.tobytes()


def _put_together(names: list[str]):
    """For mapInArrow over keys and a list of compressed ids: keys, the ids of all and how many there were."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                part = whole.slice(a, 64)
                lists = part.columns[-1].to_pylist()
                packed = pa.array([b"".join(map(uncompressed, x)) for x in lists], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], packed, pa.array(list(map(len, lists)), pa.int32())], names)

    return run


def _encoder(engine: Engine):
    return engine.encoder()


def encode_cached(df: DataFrame, engine: Engine, store: CacheTable, keys: list[str], column: str = "text") -> tuple[DataFrame, dict[str, int]]:
    """(keys, packed_ids, n_pieces) of each source, and how many pieces there are, differ, were stored, were encoded.

    The numbers and keys of pieces are staged beside the store, without their contents, which are cut once more
    if some are missing. Each different piece is looked up; those that aren't in the store, or whose entry is damaged, are
    encoded once and stored, and all ids come from the store. So a second run encodes nothing, and
    a changed text its changed pieces. ``keys`` have to tell rows apart. A null source has null
    packed_ids, an empty one empty ones.

    Entries are checked where they are read, and their ids travel compressed. Pieces that many sources
    share meet their ids by a broadcast of the few keys that more than one in ``HOT_KEYS`` rows have.
    """
    staged = store.stage(_keyed_pieces(df, engine, keys, column, False))
    rows = staged.where("piece >= 0")
    distinct = store.stage(rows.groupBy("cache_key").agg(F.count("*").alias("n")))
    counts = distinct.agg(F.sum("n").alias("a"), F.count("*").alias("b")).first()
    status = store.checked(distinct, counts.b, False).select("cache_key", "cache_status")
    status = distinct.select("cache_key").join(status, "cache_key", "left").select("cache_key", F.coalesce("cache_status", F.lit(NOT_FOUND)).alias("cache_status"))
    missing = store.stage(status.where(F.col("cache_status") != OK))
    damaged = missing.where(F.col("cache_status") == INTEGRITY).select("cache_key")
    if not damaged.isEmpty():
        store.remove(damaged)
    encoded, n = 0, missing.count()
    if n:
        contents, missing = _keyed_pieces(df, engine, keys, column, True), missing.select("cache_key")
        there = distinct.select("cache_key").join(missing, "cache_key", "left_anti")
        if n <= FEW_KEYS:
            contents, there = contents.join(F.broadcast(missing), "cache_key", "left_semi"), there.limit(0)
        encoded = store._parts([store.encode(contents, there, engine)]).count()
    out = {"pieces": counts.a or 0, "distinct": counts.b, "stored": counts.b - encoded, "encoded": encoded}

    values = store.checked(distinct, counts.b, True).where(F.col("cache_status") == OK).select("cache_key", "packed")
    edge = (counts.a or 0) / HOT_KEYS
    hot = F.broadcast(distinct.where((F.col("n") > 1) & (F.col("n") > edge)).select("cache_key"))  # at most HOT_KEYS
    if hot.isEmpty():
        both = rows.join(values, "cache_key")
    else:
        often = rows.join(hot, "cache_key", "left_semi").join(F.broadcast(values.join(hot, "cache_key", "left_semi")), "cache_key")
        seldom = rows.join(hot, "cache_key", "left_anti").join(values.join(hot, "cache_key", "left_anti"), "cache_key")
        both = often.unionByName(seldom)
    found = both.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("piece", "packed"))).alias("__p")).select(*keys, F.col("__p.packed").alias("__p"))
    schema = staged.select(*keys).schema.add("packed_ids", "binary").add("n_pieces", "integer")
    bounded_batches(store.spark)
    found = found.mapInArrow(_put_together(schema.names), schema)
    none = staged.where("piece < 0").select(*keys, F.when(F.col("piece") == EMPTY, F.lit(b"")).alias("packed_ids"), F.lit(0).alias("n_pieces"))
    return found.unionByName(none), out
