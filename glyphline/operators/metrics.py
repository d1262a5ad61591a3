"""Counters and events of encoding, as rows: metadata only, never content."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import STATUS, Engine
from ..functions.native import over_limit


def limit_status(df: DataFrame, engine: Engine, column: str = "text") -> DataFrame:
    """df with status: 9 for a source over the input limit, else 0; natively."""
    data = F.encode(F.col(column), "UTF-8") if df.schema[column].dataType.simpleString() == "string" else F.col(column)
    return df.withColumn("status", over_limit(data, engine.limits.max_input_bytes))


def observed(encoded: DataFrame, column: str = "text", ids: str = "ids", status: str = "status") -> tuple[DataFrame, Observation]:
    """encoded, and an observation that holds the counters once an action has run."""
    seen = Observation("encode")
    counters = [
        F.count("*").alias("operations"),
        F.coalesce(F.sum((F.col(status) != 0).cast("long")), F.lit(0)).alias("failures"),
        F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0)).alias("input_bytes"),
        F.coalesce(F.sum(F.when(F.col(status) == 0, F.size(ids))), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum((F.col(status) == 9).cast("long")), F.lit(0)).alias("limit_rejections"),
    ]
    return encoded.observe(seen, *counters), seen


def observed_decode(decoded: DataFrame, column: str = "decoded", status: str = "decode_status") -> tuple[DataFrame, Observation]:
    """decoded, and an observation of its calls, failures and bytes out once an action has run."""
    seen = Observation("decode")
    counters = [
        F.count("*").alias("decode_operations"),
        F.coalesce(F.sum((F.col(status) != 0).cast("long")), F.lit(0)).alias("decode_failures"),
        F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0)).alias("output_bytes"),
    ]
    return decoded.observe(seen, *counters), seen


class Totals:
    """Counters of several observations, added up on the driver; ``reset`` begins anew."""

    def __init__(self):
        self.counters: dict[str, int] = {}

    def add(self, seen: Observation) -> Totals:
        for name, n in seen.get.items():
            self.counters[name] = self.counters.get(name, 0) + int(n)
        return self

    def reset(self) -> None:
        self.counters.clear()

    def snapshot(self) -> str:
        """The counters as canonical JSON."""
        return json.dumps(self.counters, sort_keys=True, separators=(",", ":"))


def status_texts(status: Column) -> Column:
    """The text of a status, natively."""
    known = F.get(F.array(*[F.lit(s) for s in STATUS]), status)
    return F.when(status.isNotNull(), F.coalesce(F.when(status >= 0, known), F.lit("unknown status")))


def events(encoded: DataFrame, key: str, column: str = "text", status: str = "status", mask: tuple[int, ...] | None = None) -> DataFrame:
    """(key, operation, status, status_text, input_bytes): one row for each operation, or of some statuses."""
    rows = encoded.where(F.col(status).isNotNull())
    if mask is not None:
        rows = rows.where(F.col(status).isin(*mask))
    return rows.select(key, F.lit("encode").alias("operation"), F.col(status).alias("status"), status_texts(F.col(status)).alias("status_text"), F.octet_length(F.col(column)).cast("bigint").alias("input_bytes"))


def prometheus(counters: dict[str, int], prefix: str = "glyphline") -> str:
    """Counters in the text form that monitoring reads."""
    return "".join(f"# TYPE {prefix}_{k}_total counter\n{prefix}_{k}_total {v}\n" for k, v in sorted(counters.items()))
