"""Tables of sources and of configuration, and what is written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native
from ..kernels.vocab import BPE, PackError, Vocabulary
from . import packs
from .formats import PackSource  # noqa: F401  readable from here as before



def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, source) of whole files as exact bytes."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", F.col("content").alias("source"))


def source_info(df: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys, n_bytes and sha256 of each source, natively."""
    data = F.encode(F.col(column), "UTF-8") if df.schema[column].dataType.simpleString() == "string" else F.col(column)
    return df.select(*keys, F.octet_length(data).cast("bigint").alias("n_bytes"), F.sha2(data, 256).alias("sha256"))


def tiktoken_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """(surface, rank) of lines of a base64 surface and a rank, natively."""
    parts = F.split(F.trim(column), "\\s+")
    return lines.where(F.trim(column) != "").select(F.try_to_binary(parts[0], F.lit("base64")).alias("surface"), F.get(parts, F.lit(1)).try_cast("bigint").alias("rank"))


def check_tiktoken(rows: DataFrame) -> DataFrame:
    """(problem, n) of a rank table: repeated surfaces or ranks, missing bytes, bad lines. Empty if it is good."""
    spark = rows.sparkSession
    single = spark.range(256).select(F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("surface"))
    found = [
        ("bad line", rows.where("surface is null or rank is null or rank < 0")),
        ("duplicate surface", rows.groupBy("surface").count().where("count > 1")),
        ("duplicate rank", rows.groupBy("rank").count().where("count > 1")),
        ("missing byte", single.join(rows.select("surface"), "surface", "left_anti")),
    ]
    out = None
    for name, bad in found:
        n = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = n if out is None else out.unionByName(n)
    return out.where("n > 0")


def import_tiktoken(spark: SparkSession, path: str) -> Vocabulary:
    """The vocabulary of a rank file; the driver holds as much as a vocabulary is."""
    rows = tiktoken_rows(spark.read.text(path))
    bad = check_tiktoken(rows).collect()
    if bad:
        raise PackError(", ".join(f"{r.problem} ({r.n})" for r in bad))
    return Vocabulary(tuple((r["rank"], r["rank"], bytes(r["surface"])) for r in rows.collect()), BPE)


def export_tiktoken(spark: SparkSession, vocabulary: Vocabulary, path: str) -> None:
    """Write a rank file (one part) whose ids are the ranks."""
    lines = packs.format_tiktoken(vocabulary).splitlines()
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(path)


def pack_ids(df: DataFrame, column: str = "ids") -> DataFrame:
    """df with packed_ids: an array of ids as little-endian 32-bit integers, natively."""
    swapped = F.transform(column, lambda i: F.concat(*[F.substring(F.lpad(F.hex(i), 8, "0"), k, 2) for k in (7, 5, 3, 1)]))
    return df.withColumn("packed_ids", F.unhex(F.array_join(swapped, "")))


def unpack_ids(df: DataFrame, column: str = "packed_ids") -> DataFrame:
    """df with ids of packed little-endian 32-bit integers; null if the size isn't a multiple of four."""
    n = F.octet_length(column)

    def unpacked(d):
        at = F.sequence(F.lit(0), (F.octet_length(d) / 4).cast("int") - 1)
        one = lambda i: F.concat(*[F.substring(d, 4 * i + k, F.lit(1)) for k in (4, 3, 2, 1)])
        return F.transform(at, lambda i: F.conv(F.hex(one(i)), 16, 10).cast("bigint"))

    ids = native.let(F.col(column), unpacked)
    return df.withColumn("ids", F.when(n % 4 != 0, F.lit(None)).when(n == 0, F.array().cast("array<bigint>")).otherwise(ids))


def inspect_packs(files: DataFrame, column: str = "source") -> DataFrame:
    """files with pack_status, sections and vocabulary size of containers in any store Spark reads."""
    from ..plans.kernel import with_kernel

    return with_kernel(files, column, "pack_status int, sections array<struct<kind:int,length:bigint>>, n_entries bigint, algorithm int", _inspect)


def _inspect():
    def fn(data):
        try:
            found = packs.scan(data)
            v = packs.read_vocabulary(data) if any(k == packs.VOCABULARY for k, _ in found) else None
        except PackError as e:
            return e.status, None, None, None
        return 0, [(k, len(s)) for k, s in found], len(v.rows) if v else None, v.algorithm if v else None

    return fn
