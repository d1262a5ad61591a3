"""Repeated three-line windows across documents, removed natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, fresh, let, materialize, unique_join

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: Column, width: int) -> Column:
    """128-bit hashes of each run of ``width`` lines; a shorter text is one window of all its lines."""
    pairs = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("x"), F.hash(x, F.lit(7)).alias("y")))

    def hashed(p: Column) -> Column:
        def key(i: Column) -> Column:
            at = [F.get(p, i + k) for k in range(width)]
            return F.struct(
                F.xxhash64(*[q["x"] for q in at]).alias("a"),
                F.xxhash64(*[q["y"] for q in at], *[q["x"] for q in reversed(at)]).alias("b"),
            )

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - width, F.lit(0))), key)

    return let(pairs, hashed)


def _covered(starts: Column, width: int) -> tuple[Column, Column]:
    """First lines and ends of the runs of lines that windows at the sorted, distinct starts cover."""
    before, after = (lambda x, i: F.get(starts, i - 1) + width < x), (lambda x, i: x + width < F.get(starts, i + 1))
    first = F.filter(starts, lambda x, i: (i == 0) | before(x, i))
    last = F.filter(starts, lambda x, i: (i == F.size(starts) - 1) | after(x, i))
    return first, F.transform(last, lambda x: x + width)


def _rest(lines: Column, first: Column, end: Column) -> Column:
    """The lines outside of the runs: a slice before each run and one behind the last."""
    def part(i: Column) -> Column:
        a = F.when(i == 0, 0).otherwise(F.get(end, i - 1))
        z = F.when(i == F.size(first), F.size(lines)).otherwise(F.get(first, i))
        return F.slice(lines, a + 1, F.greatest(z - a, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(first)), part))


def dedup_lines(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that repeat earlier text removed, and how many were.

    Lines are what stands between line feeds. Every run of ``width`` consecutive lines is a window
    (a text of fewer lines is one window of all of them). Over all documents, in the order of
    (id, position), each window's first occurrence stays; the lines that any later occurrence
    covers are removed, overlapping occurrences being merged. The rest of the lines keep their
    order. New columns: n_lines, n_removed (longs); the text column is replaced.

    The windows are hashed to 128 bits, written once (28 bytes each, never lines) and grouped with
    partial aggregation, so that a window that a third of all documents share is one counter, not
    a list. Repeated windows are found again by a join in which the most frequent ones are
    broadcast (``unique_join``). What is left of a document's windows are the runs of lines to
    remove. If these are small by their counted size they are broadcast, and no text is shuffled
    at all; beyond that the documents that have an id and a text are joined with them by sorting,
    which spills, and the others pass as they are.

    Null text stays null and empty text empty, both without windows and with counts 0. A text that
    is removed altogether becomes empty; its row stays. Ids are whole numbers; rows with a null id
    pass unchanged. Rows that share an id count as one document to the ordering: equal rows both
    stay, and what is flagged at a position is removed from both. An empty table gives an empty
    result. Extra columns pass through; input columns n_lines and n_removed are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(names)
    some = F.col(id_col).isNotNull() & (F.coalesce(F.col(text_col), F.lit("")) != "")
    base = docs.where(some).select(F.col(id_col).cast("long").alias("id"), F.posexplode(_windows(_lines(F.col(text_col)), width)).alias("pos", "key"))
    windows = materialize(base.select("id", "pos", F.col("key.a").alias("a"), F.col("key.b").alias("b")), "windows")

    # (id, position) as one number, whose least is kept by a hash aggregate
    place = F.col("id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(12,0)") + F.col("pos")
    first = windows.withColumn("place", place.cast("decimal(38,0)")).groupBy("a", "b").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1"), "repeated")
    later = unique_join(windows, first, ["a", "b"], 64, "n").where(place.cast("decimal(38,0)") > F.col("first"))
    starts = later.groupBy("id").agg(F.array_sort(F.collect_set("pos")).alias("starts"))
    key, begin, end, kept = (fresh(names, c) for c in ("__id", "__begin", "__end", "__kept"))
    runs = starts.select(F.col("id").alias(key), *[c.alias(n) for c, n in zip(_covered(F.col("starts"), width), (begin, end), strict=True)])
    runs = materialize(runs, "runs")

    size = runs.select(F.sum(F.lit(64) + 8 * F.size(begin))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(runs), F.col(id_col) == F.col(key), "left")
    else:
        joined = docs.where(some).join(runs.hint("merge"), F.col(id_col) == F.col(key), "left")
        joined = joined.unionByName(docs.where(~some), allowMissingColumns=True)

    lines = _lines(F.col(text_col))
    hit = F.col(key).isNotNull() & (F.col(text_col) != "")
    joined = joined.withColumn(kept, F.when(hit, let(lines, lambda x: _rest(x, F.col(begin), F.col(end)))))
    n_lines = F.when(F.coalesce(F.col(text_col), F.lit("")) == "", 0).otherwise(F.size(lines))
    text = F.when(hit, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
        n_lines.cast("long").alias("n_lines"),
        F.when(hit, F.size(lines) - F.size(kept)).otherwise(0).cast("long").alias("n_removed"),
    )
