"""Lexing of columns and the parts of what was lexed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import lexer
from ..kernels.vocab import LexProfile
from ..plans.kernel import flat_kernel, folded_kernel, with_kernel


def _tokens(profile: LexProfile):
    return lambda data: lexer.lex(profile, data)


def lex(df: DataFrame, profile: LexProfile, keys: list[str], column: str = "text") -> DataFrame:
    """keys, kind, start, length of the tokens that partition each source."""
    return flat_kernel(df, keys, column, "kind int, start bigint, length bigint", _tokens, profile)


def _totals(profile: LexProfile):
    def fn(sources):
        n, n_bytes = np.zeros(16, np.int64), np.zeros(16, np.int64)
        for data in sources:
            kind, ends = lexer.scan(profile, data)
            n += np.bincount(kind, minlength=16)
            n_bytes += np.bincount(kind, np.diff(ends, prepend=0), 16).astype(np.int64)
        return [(int(k), int(n[k]), int(n_bytes[k])) for k in np.flatnonzero(n)]

    return fn


def lex_totals(df: DataFrame, profile: LexProfile, column: str = "text") -> DataFrame:
    """(kind, n_tokens, n_bytes) over all sources."""
    part = folded_kernel(df, column, "kind int, a bigint, b bigint", _totals, profile)
    return part.groupBy("kind").agg(F.sum("a").alias("n_tokens"), F.sum("b").alias("n_bytes"))


def _columns(profile: LexProfile):
    def fn(data):
        tokens = lexer.lex(profile, data)
        return tokens, lexer.components(profile, data, tokens)

    return fn


def lex_columns(df: DataFrame, profile: LexProfile, column: str = "text") -> DataFrame:
    """df with lexical and semantic arrays."""
    schema = "lexical array<struct<kind:int,start:bigint,length:bigint>>, semantic array<struct<kind:int,lexical_index:bigint,start:bigint,length:bigint>>"
    return with_kernel(df, column, schema, _columns, profile)


def _parts(profile: LexProfile):
    def fn(data):
        tokens = lexer.lex(profile, data)
        return [(k, i, s, n, data[s : s + n]) for k, i, s, n in lexer.components(profile, data, tokens)]

    return fn


def semantic_components(df: DataFrame, profile: LexProfile, keys: list[str], column: str = "text") -> DataFrame:
    """keys, kind, lexical_index, start, length and the part's bytes."""
    return flat_kernel(df, keys, column, "kind int, lexical_index bigint, start bigint, length bigint, part binary", _parts, profile)
