"""Unicode evidence of columns: clusters, scripts, security findings, normalised views."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import columns, text, unicode_tables
from ..plans.kernel import SLICE, flat_kernel, folded_kernel, lists, with_kernel

RANGES = "array<struct<start:bigint,length:bigint>>"
FINDINGS = "array<struct<kind:int,script_id:int,start:bigint,length:bigint>>"
UNITS = "array<struct<start:bigint,length:bigint,spans:array<struct<start:bigint,length:bigint>>>>"


#: Bytes of sources that are looked up in tables at once: each code point takes some hundred bytes meanwhile.
TABLE_SLICE = SLICE // 16


class _clusters:  # noqa: N801  a kernel over whole batches
    most = TABLE_SLICE

    def __init__(self, counted: bool, tables=None):
        self.counted, self.tables = counted, tables

    def arrow(self, sources):
        import pyarrow as pa

        missing = np.array([d is None for d in sources], bool)
        b = columns.Batch([d or b"" for d in sources])
        first = columns.clusters(b) if self.tables is None else unicode_tables.cluster_starts(self.tables, b)
        if self.counted:
            return [pa.array(b.per_source(first), mask=missing)]
        length = np.diff(np.append(b.starts[first], b.bounds[-1]))
        return [lists(b.per_source(first), {"start": b.local(first), "length": length}, missing)]


def graphemes(df: DataFrame, column: str = "text", tables=None) -> DataFrame:
    """df with graphemes: (start, length) in bytes of extended grapheme clusters.

    tables: ``ClusterTables`` of a container's section; without them those of the installed package decide.
    """
    return with_kernel(df, column, f"graphemes {RANGES}", _clusters, False, tables)


def grapheme_counts(df: DataFrame, column: str = "text", tables=None) -> DataFrame:
    return with_kernel(df, column, "n_graphemes bigint", _clusters, True, tables)


def script_table(spark: SparkSession) -> DataFrame:
    """(script_id, script) of all scripts."""
    return spark.createDataFrame(list(enumerate(text.script_names())), "script_id int, script string")


def _spans(scripts: np.ndarray):
    return lambda data: [(i, s, n) for s, n, i in text.script_spans(data, scripts)]


def script_spans(df: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys, script_id, start, length of maximal runs of a script; invalid bytes are UNKNOWN."""
    return flat_kernel(df, keys, column, "script_id int, start bigint, length bigint", _spans, text.script_table())


def _span_totals(scripts: np.ndarray):
    def fn(sources):
        b = columns.Batch(sources)
        ids = text.script_ids(b.cps, scripts)
        first, size, _ = b.runs(ids)
        n, n_bytes = np.bincount(ids[first]), np.bincount(ids[first], size)
        return [(int(k), int(n[k]), int(n_bytes[k])) for k in np.flatnonzero(n)]

    return fn


def script_totals(df: DataFrame, column: str = "text") -> DataFrame:
    """(script, n_spans, n_bytes) over all sources."""
    part = folded_kernel(df, column, "script_id int, a bigint, b bigint", _span_totals, text.script_table())
    out = part.groupBy("script_id").agg(F.sum("a").alias("n_spans"), F.sum("b").alias("n_bytes"))
    return out.join(F.broadcast(script_table(df.sparkSession)), "script_id").select("script", "n_spans", "n_bytes")


def _findings(scripts: np.ndarray, flags: np.ndarray):
    return lambda data: text.findings(data, scripts, flags)


def security_findings(df: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys, kind, script_id, start, length of each finding, read lazily: a limit stops the scan."""
    return flat_kernel(df, keys, column, "kind int, script_id int, start bigint, length bigint", _findings, text.script_table(), text.flag_table())


def _visited(most: int, scripts: np.ndarray, flags: np.ndarray):
    def fn(data):
        found = text.findings(data, scripts, flags)
        return found[:most], min(most, len(found)), len(found) > most

    return fn


class _table_findings:  # noqa: N801  a kernel over whole batches
    most = TABLE_SLICE

    def __init__(self, tables):
        self.tables = tables

    def arrow(self, sources):
        missing = np.array([d is None for d in sources], bool)
        found, per = unicode_tables.findings(self.tables, columns.Batch([d or b"" for d in sources]))
        return [lists(per, dict(zip(("kind", "script_id", "start", "length"), found, strict=True)), missing)]


def table_findings(df: DataFrame, tables, column: str = "text") -> DataFrame:
    """df with findings: (kind, script_id, start, length), by ``SecurityTables`` of a container's section.

    Script ids are those of the section, from 1 on; a null source has null findings.
    """
    return with_kernel(df, column, f"findings {FINDINGS}", _table_findings, tables)


def table_scripts(spark: SparkSession, tables) -> DataFrame:
    """(script_id, script) of a section's scripts."""
    return spark.createDataFrame([(k + 1, n) for k, n in enumerate(tables.names)], "script_id int, script string")


def security_visit(df: DataFrame, most: int, column: str = "text") -> DataFrame:
    """df with the first findings of each source, at most so many: findings, n_visited and stopped."""
    return with_kernel(df, column, f"findings {FINDINGS}, n_visited bigint, stopped boolean", _visited, most, text.script_table(), text.flag_table())


def _unit_count():
    def fn(data):
        _, cps, _, _ = text.units(data)
        return len(cps), int(text.is_invalid(cps).sum())

    return fn


def unit_counts(df: DataFrame, column: str = "text") -> DataFrame:
    """df with n_units (code points, and each byte that isn't UTF-8) and n_invalid."""
    return with_kernel(df, column, "n_units bigint, n_invalid bigint", _unit_count)


class _views:  # noqa: N801  a kernel over whole batches
    def __init__(self, mode: str):
        self.mode = mode

    def arrow(self, sources):
        import pyarrow as pa

        missing = np.array([d is None for d in sources], bool)
        out, per, (at, size), counts, (s, n) = columns.views(columns.Batch([d or b"" for d in sources]), self.mode)
        units = lists(per, {"start": at, "length": size, "spans": lists(counts, {"start": s, "length": n})}, missing)
        return [pa.array(out, pa.binary(), mask=missing), units]


class _by_tables:  # noqa: N801  a kernel over whole batches
    most = TABLE_SLICE

    def __init__(self, mode: str, tables, what: str):
        self.mode, self.tables, self.what = mode, tables, what

    def arrow(self, sources):
        import pyarrow as pa

        missing = np.array([d is None for d in sources], bool)
        b = columns.Batch([d or b"" for d in sources])
        if self.what != "view":
            out = unicode_tables.normalized_bytes(self.tables, self.mode, b)
            if self.what == "digest":
                return [pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string(), mask=missing)]
            return [pa.array(out, pa.binary(), mask=missing)]
        out, per, (at, size), counts, (s, n) = unicode_tables.views(self.tables, self.mode, b)
        units = lists(per, {"start": at, "length": size, "spans": lists(counts, {"start": s, "length": n})}, missing)
        return [pa.array(out, pa.binary(), mask=missing), units]


def _checked(mode: str) -> str:
    if mode not in text.MODES:
        raise ValueError(f"unknown mode {mode}")
    return mode


def normalized_view(df: DataFrame, mode: str, column: str = "text", tables=None) -> DataFrame:
    """df with normalized (bytes) and units: each output unit's place and the source spans it is made of.

    tables: ``NormalTables`` of a container's section; without them those of the interpreter decide.
    """
    schema = f"normalized binary, units {UNITS}"
    if tables is not None:
        return with_kernel(df, column, schema, _by_tables, _checked(mode), tables, "view")
    return with_kernel(df, column, schema, _views, _checked(mode))


def _plain(mode: str):
    return lambda data: (text.normalize(data, mode),)


def normalize(df: DataFrame, mode: str, column: str = "text", tables=None) -> DataFrame:
    """df with normalized: the bytes alone, without their provenance."""
    if tables is not None:
        return with_kernel(df, column, "normalized binary", _by_tables, _checked(mode), tables, "bytes")
    return with_kernel(df, column, "normalized binary", _plain, _checked(mode))


def _digest(mode: str):
    return lambda data: (hashlib.sha256(text.normalize(data, mode)).hexdigest(),)


def normalized_digests(df: DataFrame, mode: str, column: str = "text", tables=None) -> DataFrame:
    if tables is not None:
        return with_kernel(df, column, "normalized_sha256 string", _by_tables, _checked(mode), tables, "digest")
    return with_kernel(df, column, "normalized_sha256 string", _digest, _checked(mode))


def range_lookup(points: DataFrame, ranges: DataFrame, column: str = "cp") -> DataFrame:
    """points joined with (start, end, value) ranges, end exclusive, by an equi-join.

    Each distinct point that occurs is looked up once: ranges are cut into pages of 256 points,
    points join on the page, and the distinct ones join back.
    """
    paged = ranges.select("start", "end", "value", F.explode(F.sequence(F.shiftright("start", 8), F.shiftright(F.col("end") - 1, 8))).alias("__page"))
    some = points.select(F.col(column).alias("__cp")).distinct().withColumn("__page", F.shiftright("__cp", 8))
    found = some.join(paged, "__page").where("__cp >= start and __cp < end").select("__cp", "value")
    return points.join(found, F.col(column) == F.col("__cp"), "left").drop("__cp")
