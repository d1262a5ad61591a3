"""What the operators of this package share: tables, shared storage and word hashing.

Intermediate tables are cut from their lineage by writing them to the folder named in
``spark.checkpoint.dir``, which driver and executors both see, so that a lost executor never
costs more than the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphline.plans.kernel import bounded_batches, spread  # noqa: F401  operators take both from here

#: A side of a join is broadcast only if its rows, counted first, take no more bytes than this.
BROADCAST_BYTES = 8 << 20
#: Keys of a join that count as hot at most: those of more than one of so many rows.
HOT_KEYS = 20_000
#: Rows of a key below which it is never hot in a salted join, and parts that a hot key's rows are dealt into.
HOT_ROWS, SALTS = 20_000, 64
#: ASCII white space, the word separators of every shingle operator here.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; the path may be any that Spark's readers open.

    A table of fewer parts than there are cores is dealt out over them.
    """
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode, as in tests, one of our own where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        found = tempfile.mkdtemp(prefix="glyphline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/glyphline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """df marked for broadcast if its counted rows are small enough, else df itself.

    row_bytes: what a row takes, as a bound or as a column that is summed. df should be
    materialized, since it is counted here.
    """
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.select(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def unique_join(left: DataFrame, right: DataFrame, keys: list[str], row_bytes: int, count: str | None = None, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, whose rows have different keys, without a hot key in one task.

    A right side of few rows is broadcast. Otherwise the keys that stand in more than one of
    ``HOT_KEYS`` rows of left are, of which there can't be more than ``HOT_KEYS``; the others meet
    by a shuffle. count: a column of right that says how often left has the key; without one the
    keys are counted, with partial aggregation. Both sides should be materialized.
    """
    if right.count() * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), keys, how)
    edge = left.count() / HOT_KEYS
    if count is None:
        hot = materialize(left.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > edge).select(keys), "hot")
    else:
        hot = right.where(F.col(count) > edge).select(keys)
    hot = F.broadcast(hot)
    often, seldom = right.join(hot, keys, "left_semi"), right.join(hot, keys, "left_anti")
    return left.join(hot, keys, "left_semi").join(F.broadcast(often), keys, how).unionByName(left.join(hot, keys, "left_anti").join(seldom, keys, how))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, row_bytes: int | Column) -> DataFrame:
    """left inner joined with right on a key that both may have in any number of rows, without a hot key in one task.

    A right side of few bytes is broadcast. Otherwise the keys of more than ``HOT_ROWS`` rows of
    left, and of more than one in ``HOT_KEYS``, are hot (at most ``HOT_KEYS``, a broadcast of two
    columns): their rows of left are dealt into ``SALTS`` parts by a hash of ``spread_by``, and
    right's rows of these keys go to each part. right should be materialized; left is read twice more.
    """
    right_small = small_side(right, row_bytes)
    if right_small is not right:
        return left.join(right_small, key)
    edge = max(HOT_ROWS, left.count() / HOT_KEYS)
    parts, hot_key, salt = "__parts", "__hot_key", "__salt"
    counts = left.groupBy(F.col(key).alias(hot_key)).agg(F.count("*").alias("__n"))
    hot = F.broadcast(materialize(counts.where(F.col("__n") > edge).select(hot_key, F.lit(SALTS).alias(parts)), "hot"))

    def with_parts(df: DataFrame) -> DataFrame:
        return df.join(hot, F.col(key) == F.col(hot_key), "left").drop(hot_key).withColumn(parts, F.coalesce(parts, F.lit(1)))

    dealt = with_parts(left).withColumn(salt, F.pmod(F.xxhash64(spread_by), F.col(parts)).cast("int")).drop(parts)
    copies = with_parts(right).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    return dealt.join(copies, [key, salt]).drop(salt)


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def words(text: Column) -> Column:
    """Lower-cased words between runs of ASCII white space; an empty array for null or blank text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+")
    return F.array_remove(parts, "")


# --- vectorised hashing of words in UTF-8 bytes -------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _POWER, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string or binary array and its n + 1 offsets; a null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first-word-of-each-document of the maximal runs of word bytes.

    A run never crosses a document's end. The third array has n + 1 entries.
    """
    n = len(is_word)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(is_word[1:], is_word[:-1], out=change[1:])
    inner = offsets[(offsets > 0) & (offsets < n)]
    change[inner] = True
    edges = np.flatnonzero(change)
    ends = np.append(edges[1:], n)
    keep = is_word[edges]
    starts, ends = edges[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    place = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    values = _BYTE[data[np.repeat(starts, lengths) + place]]
    values *= _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def shingle_sets(column, width: int = 5):
    """For each text of an Arrow column its sorted, distinct hashed word shingles (uint64).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. With fewer words than
    ``width`` the whole sequence is one shingle; without words the set is empty.
    """
    data, offsets = text_buffer(column)
    low = LOWER_ASCII[data]
    starts, ends, first = word_spans(~IS_SPACE[low], offsets)
    hashed = hash_words(low, starts, ends)
    del low
    n = len(hashed)
    rolled = np.full(max(n - width + 1, 0), width, np.uint64)
    for k in range(width):
        rolled = mix(rolled * _POWER + hashed[k : k + len(rolled)])
    for d in range(len(offsets) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = mix(h * _POWER + hashed[k : k + 1])
            yield h
        else:
            yield np.zeros(0, np.uint64)


def let(value: Column, body) -> Column:
    """body of a value that is computed once per row, also where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
