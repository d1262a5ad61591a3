"""Kernels in map-only stages: bytes cross to Python once, results come back as typed columns."""

from __future__ import annotations

import functools
import hashlib
import pickle
from collections.abc import Callable, Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of source that are turned into results before they are handed back.
SLICE = 4 << 20
#: Bytes of an Arrow batch at most.
BATCH_BYTES = 8 << 20
#: Bytes of files that a table has at most for its rows to be dealt out.
SMALL = 128 << 20


def to_bytes(df: DataFrame, column: str) -> Column:
    """The exact bytes of a column: binary as it is, strings as UTF-8."""
    kind = df.schema[column].dataType
    return F.col(column) if isinstance(kind, T.BinaryType) else F.encode(F.col(column).cast("string"), "UTF-8")


def slices(batch, at: int, most: int = SLICE):
    """Parts of an Arrow batch whose sources have about ``most`` bytes, or one row."""
    import pyarrow.compute as pc

    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(float)))
    begin = 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or size[i] - (size[begin - 1] if begin else 0) > most:
            yield batch.slice(begin, i - begin)
            begin = i


def spread(df: DataFrame) -> DataFrame:
    """df, a table just read, over at least as many partitions as there are cores, if it is small.

    A table of few files or row groups, of ``SMALL`` bytes at most by its files' sizes, is dealt
    out once, for the kernels; a larger one is left as it is read.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bytes for each Arrow batch to 8 MB, if they are more.

    A batch counts rows first, and thousands of long texts take more memory than a task should;
    results don't depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def lists(counts: np.ndarray, columns: dict, missing: np.ndarray | None = None):
    """A list array of structs: how many each row has, and the fields of all of them."""
    import pyarrow as pa

    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
    items = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
    return pa.ListArray.from_arrays(offsets, items, mask=None if missing is None else pa.array(missing))


def to_arrow(values: Sequence, kind):
    """An Arrow array of Python values; lists of numbers or of tuples are turned into columns whole.

    Structs inside lists are tuples of their fields.
    """
    import pyarrow as pa

    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    sizes = np.fromiter((0 if v is None else len(v) for v in values), np.int64, len(values))
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    inner = kind.value_type
    mask = pa.array(np.fromiter((v is None for v in values), bool, len(values)))
    if any(isinstance(v, np.ndarray) for v in values):
        items = pa.array(np.concatenate([v for v in values if v is not None]), inner)
        return pa.ListArray.from_arrays(offsets, items, mask=mask).cast(kind)
    flat = [x for v in values if v is not None for x in v]
    if pa.types.is_struct(inner):
        columns = list(zip(*flat, strict=True)) or [()] * inner.num_fields
        parts = [to_arrow(c, f.type) for c, f in zip(columns, inner, strict=True)]
        items = pa.StructArray.from_arrays(parts, fields=list(inner))
    elif pa.types.is_integer(inner):
        items = pa.array(np.array(flat, inner.to_pandas_dtype()))
    else:
        items = pa.array(flat, inner)
    return pa.ListArray.from_arrays(offsets, items, mask=mask).cast(kind)


@functools.lru_cache(16)
def _built(key: str, blob: bytes):
    make, args = pickle.loads(blob)  # noqa: S301  made by with_kernel in the driver of the same job
    return make(*args)


def build_once(make: Callable, args: tuple):
    """What make(*args) returns, made once for each worker process."""
    blob = pickle.dumps((make, args))
    return _built(hashlib.sha256(blob).hexdigest(), blob)


def with_kernel(df: DataFrame, column: str, schema: str, make: Callable, *args) -> DataFrame:
    """df with further columns: make(*args) is called once per worker, its result once per row.

    schema: DDL of the new columns; the function takes the bytes of ``column`` and returns a tuple
    of their values, structs in arrays being tuples; an object with ``many`` takes a list of sources
    and returns as many tuples, one with ``arrow`` (where it isn't None) a list with null sources in
    it and returns whole columns; ``most`` of such an object, if it has one, bounds the bytes of the
    sources that it is given at once (or one source). A null source gives nulls. New columns replace input columns of their names.
    """
    fields = T.StructType.fromDDL(schema).fields
    new = [f.name for f in fields]
    names = [c for c in df.columns if c not in new]
    source = "__source"
    while source in names:
        source = f"_{source}"
    rows = df.select(*[F.col(f"`{c}`") for c in names], to_bytes(df, column).alias(source))
    out = T.StructType([*[df.schema[c] for c in names], *[T.StructField(f.name, f.dataType, True) for f in fields]])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    usual = SLICE // 16 if any(isinstance(f.dataType, T.ArrayType) for f in fields) else SLICE
    bounded_batches(df.sparkSession)

    def run(batches: Iterable):
        import pyarrow as pa

        fn, at = build_once(make, args), len(names)
        most, empty = getattr(fn, "most", usual), (None,) * len(fields)
        for whole in batches:
            for part in slices(whole, at, most):
                sources = part.column(at).to_pylist()
                if hasattr(fn, "arrow"):
                    columns = [c.cast(k) for c, k in zip(fn.arrow(sources), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*names, *new])
                    continue
                if hasattr(fn, "many"):
                    found = iter(fn.many([b for b in sources if b is not None]))
                    values = [empty if b is None else next(found) for b in sources]
                else:
                    values = [empty if b is None else fn(b) for b in sources]
                columns = [to_arrow(v, k) for v, k in zip(zip(*values, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*names, *new])

    return rows.mapInArrow(run, out)


def flat_kernel(df: DataFrame, keys: list[str], column: str, schema: str, make: Callable, *args) -> DataFrame:
    """Rows of a kernel: keys, then the columns of each tuple that the function yields for a source.

    An object with ``columns`` takes a list of sources instead, and returns whole columns and how many rows each source has.
    """
    fields = T.StructType.fromDDL(schema).fields
    rows = df.select(*keys, to_bytes(df, column).alias("__source"))
    out = T.StructType([*[df.schema[c] for c in keys], *[T.StructField(f.name, f.dataType, True) for f in fields]])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    bounded_batches(df.sparkSession)

    def run(batches: Iterable):
        import pyarrow as pa

        fn, at = build_once(make, args), len(keys)
        for whole in batches:
            for part in slices(whole, at, SLICE // 4):
                if hasattr(fn, "columns"):
                    sources = part.column(at).to_pylist()
                    some = np.flatnonzero([b is not None for b in sources])
                    values, counts = fn.columns([sources[k] for k in some.tolist()])
                    if len(values):
                        owner = pa.array(np.repeat(some, counts))
                        yield pa.RecordBatch.from_arrays([*[c.take(owner) for c in part.columns[:at]], *[pa.array(v, k) for v, k in zip(values, kinds, strict=True)]], out.names)
                    continue
                values, counts = [], []
                for b in part.column(at).to_pylist():
                    got = [] if b is None else fn(b)
                    values += got
                    counts.append(len(got))
                if values:
                    owner = pa.array(np.repeat(np.arange(len(counts)), counts))
                    columns = [pa.array(v, k) for v, k in zip(zip(*values, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*[c.take(owner) for c in part.columns[:at]], *columns], out.names)

    return rows.mapInArrow(run, out)


def folded_kernel(df: DataFrame, column: str, schema: str, make: Callable, *args) -> DataFrame:
    """Rows that a kernel gives for each part of the input as a whole, to be aggregated further.

    The function takes a list of sources (nulls left out) and returns tuples.
    """
    fields = T.StructType.fromDDL(schema).fields
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterable):
        import pyarrow as pa

        fn = build_once(make, args)
        for whole in batches:
            for part in slices(whole, 0):
                values = fn([b for b in part.column(0).to_pylist() if b is not None])
                if values:
                    columns = [pa.array(v, k) for v, k in zip(zip(*values, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return df.select(to_bytes(df, column).alias("__source")).mapInArrow(run, T.StructType(fields))
