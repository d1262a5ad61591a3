"""Archives of files as tables: list, test, remove, restore; and codec sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_path(path: Column) -> Column:
    """Relative, without drive letters, empty, '.' or '..' parts, and without NUL."""
    parts = F.split(F.translate(path, "\\", "/"), "/", -1)
    return ~path.rlike("^(/|\\\\|[A-Za-z]:)") & ~F.contains(path, F.lit("\0")) & F.forall(parts, lambda p: ~p.isin("", ".", ".."))


def entries(files: DataFrame, root: str) -> DataFrame:
    """(path, size, crc32, content) of a binaryFile table, with paths relative to root."""
    path = F.regexp_replace("path", F.lit(f"^.*{root.strip('/')}/"), F.lit(""))
    return files.select(path.alias("path"), F.col("length").alias("size"), F.crc32("content").alias("crc32"), "content")


def test(archive: DataFrame) -> DataFrame:
    """(path, problem) of entries that are unsafe, repeated or don't agree with their size or CRC."""
    twice = archive.groupBy("path").count().where("count > 1").select(F.col("path").alias("__p"))
    rows = archive.join(twice, F.col("path") == F.col("__p"), "left")
    bad = (F.crc32("content") != F.col("crc32")) | (F.length("content") != F.col("size"))
    problem = F.when(~safe_path(F.col("path")), "unsafe path").when(F.col("__p").isNotNull(), "duplicate").when(bad, "corrupt")
    return rows.select("path", problem.alias("problem")).where("problem is not null")


def remove(archive: DataFrame, paths: DataFrame) -> DataFrame:
    """archive without the named entries and what is below them."""
    gone = paths.select(F.col("path").alias("__p")).distinct()
    parents = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
    hit = archive.select("path", F.explode(parents).alias("__p")).join(gone, "__p", "left_semi").select("path").distinct()
    return archive.join(hit, "path", "left_anti")


def write(archive: DataFrame, path: str, codec: str = "zstd") -> None:
    archive.write.option("compression", codec).parquet(path)


def restore(archive: DataFrame, root: str) -> DataFrame:
    """Write the entries below a folder that all executors see; (path, restored, problem) of each.

    Only entries that ``test`` finds nothing wrong with are written, each to a file beside its own
    and then renamed, so that a task that runs again changes nothing. The rows say what was done
    once they are read.
    """
    bad = test(archive).withColumnRenamed("path", "__p").dropDuplicates(["__p"])
    rows = archive.join(bad, F.col("path") == F.col("__p"), "left").select("path", "content", "problem")

    def run(batches):
        import pyarrow as pa

        store, base = _place(root)
        for batch in batches:
            for r in batch.to_pylist():
                if r["problem"] is None:
                    place = f"{base.rstrip('/')}/{r['path']}"
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    new = f"{place}.{uuid.uuid4().hex}"
                    with store.open_output_stream(new) as out:
                        out.write(r["content"])
                    store.move(new, place)
                yield pa.RecordBatch.from_pylist([{"path": r["path"], "restored": r["problem"] is None, "problem": r["problem"]}], schema)

    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("restored", pa.bool_()), ("problem", pa.string())])
    return rows.mapInArrow(run, "path string, restored boolean, problem string")


def _place(root: str):
    """File system and folder of a root."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def file_sizes(paths: DataFrame, root: str, name: str = "n_bytes") -> DataFrame:
    """paths, which has a column path, with the size of each file below a folder that all executors
    see; null where there is no such file, or the path is unsafe.

    Tasks ask for the files of their own rows, so that the driver doesn't hold a list of all of them.
    """
    rows = paths.drop(name).withColumn("__safe", F.coalesce(safe_path(F.col("path")), F.lit(False)))
    schema = paths.drop(name).schema.add(name, "long")

    def run(batches):
        import pyarrow as pa

        store, base = _place(root)
        for batch in batches:
            names, safe = batch.column("path").to_pylist(), batch.column("__safe").to_pylist()
            found = iter(store.get_file_info([f"{base.rstrip('/')}/{p}" for p, ok in zip(names, safe, strict=True) if ok]))
            sizes = [next(found).size if ok else None for ok in safe]  # of what isn't a file it is None
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def inspect(archive: DataFrame) -> DataFrame:
    """Number of entries, bytes, and the largest entry."""
    return archive.agg(F.count("*").alias("n_entries"), F.sum("size").alias("n_bytes"), F.max("size").alias("largest"))


def codec_sizes(df: DataFrame, column: str, codecs: tuple[str, ...] = ("gzip", "zlib", "bz2", "lzma")) -> DataFrame:
    """(codec, n_bytes, packed_bytes) of a column's values, each compressed on its own."""
    from ..plans.kernel import folded_kernel

    part = folded_kernel(df, column, "codec string, a bigint, b bigint", _compress, codecs)
    return part.groupBy("codec").agg(F.sum("a").alias("n_bytes"), F.sum("b").alias("packed_bytes"))


def _compress(codecs):
    import bz2
    import gzip
    import lzma
    import zlib

    known = {"gzip": lambda b: gzip.compress(b, mtime=0), "zlib": zlib.compress, "bz2": bz2.compress, "lzma": lambda b: lzma.compress(b, preset=0)}
    return lambda sources: [(c, sum(map(len, sources)), sum(len(known[c](s)) for s in sources)) for c in codecs]
