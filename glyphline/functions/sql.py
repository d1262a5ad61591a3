"""The engine's operators as temporary SQL functions, so that ``spark.sql`` can use them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import Engine
from ..kernels import text
from ..plans.kernel import build_once


def _bytes(x) -> bytes | None:
    return None if x is None else x.encode("utf-8", "surrogateescape") if isinstance(x, str) else bytes(x)


def _encoder(engine: Engine):
    return engine.encoder()


def register(spark: SparkSession, engine: Engine) -> None:
    """Register glyph_encode, glyph_count, glyph_decode, glyph_graphemes, glyph_normalize, glyph_language
    and the table function glyph_tokens. Nulls give nulls; an unknown id or mode fails the query.
    """

    @F.pandas_udf("array<bigint>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = build_once(_encoder, (engine,))
        for s in batches:
            yield pd.Series([None if x is None else e.encode(_bytes(x))[0] for x in s], dtype=object)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = build_once(_encoder, (engine,))
        for s in batches:
            yield pd.Series([None if x is None else len(e.encode(_bytes(x))[0]) for x in s], dtype="Int64")

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = build_once(_encoder, (engine,))
        for s in batches:
            yield pd.Series([None if x is None else e.decode(int(i) for i in x) for x in s], dtype=object)

    @F.pandas_udf("bigint")
    def graphemes(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else len(text.graphemes(_bytes(x))) for x in s], dtype="Int64")

    @F.pandas_udf("binary")
    def normalize(s: pd.Series, mode: pd.Series) -> pd.Series:
        if set(mode.dropna()) - set(text.MODES):
            raise ValueError("unknown mode")
        return pd.Series([None if x is None else text.normalize(_bytes(x), m) for x, m in zip(s, mode, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def language(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else engine.detector.detect(_bytes(x))[3] for x in s], dtype=object)

    class Tokens:
        """Rows of a text's tokens."""

        def __init__(self):
            self.encoder = build_once(_encoder, (engine,))

        def eval(self, source):
            if source is not None:
                at = 0
                for i, n in zip(*self.encoder.encode(_bytes(source)), strict=True):
                    yield i, at, n, self.encoder.base_cost[i]
                    at += n

    for name, fn in (("encode", encode), ("count", count), ("decode", decode), ("graphemes", graphemes), ("normalize", normalize)):
        spark.udf.register(f"glyph_{name}", fn)
    if engine.detector:
        spark.udf.register("glyph_language", language)
    spark.udtf.register("glyph_tokens", F.udtf(Tokens, returnType="id bigint, start bigint, length bigint, cost int"))
