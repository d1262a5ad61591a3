"""Exact top-k by inner product: exhaustive term-at-a-time accumulation over candidate blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Rows of a candidate block; queries that one dense score array holds; queries of one broadcast, and their weights.
BLOCK, TILE, QUERY_BATCH, QUERY_WEIGHTS = 8192, 128, 100_000, 6_400_000
#: Squared length beyond which products might not fit 64 bits.
LONGEST = float(1 << 62)


def quantize(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, **also: Column) -> DataFrame:
    """(id, weights): floor(scale * x) of each component as a long, x as a double; ``also`` names further columns.

    Left out are rows whose id or vector is null, whose vector holds a null, infinite or NaN
    component, or whose weights' squares sum to more than 2^62: inner products of such wouldn't fit
    64 bits, while those of all others do.
    """
    x = F.col(vec_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("weights"), *[c.alias(n) for n, c in also.items()])
    return rows.where(F.aggregate("weights", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) <= LONGEST)


def _csr(ids, lists):
    """Ids, term numbers, weights and row starts of the non-zero weights in an Arrow batch."""
    import pyarrow.compute as pc

    ids = np.asarray(ids.to_numpy(zero_copy_only=False), np.int64)
    sizes = np.asarray(pc.list_value_length(lists).to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
    row = np.repeat(np.arange(len(ids)), sizes)
    start = np.concatenate(([0], np.cumsum(sizes)))
    term = np.arange(len(flat)) - start[row]
    keep = flat != 0
    return ids, row[keep], term[keep], flat[keep]


def _by_term(row, term, weight):
    """Postings: term -> (rows, weights)."""
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    cuts = np.flatnonzero(np.diff(term)) + 1
    return {int(t[0]): (r, w) for t, r, w in zip(np.split(term, cuts), np.split(row, cuts), np.split(weight, cuts), strict=True) if len(t)}


def _top(scores, ids, own, k):
    """The k best of each row of scores, without its own id: highest first, ties to the smaller id; short rows where fewer."""
    for s, mine in zip(scores, own, strict=True):
        pick = np.flatnonzero(ids != mine)
        if len(pick) > k:
            others = s if len(pick) == len(s) else s[pick]
            edge = np.partition(others, len(pick) - k)[len(pick) - k]
            pick = pick[others >= edge]
        yield pick[np.lexsort((ids[pick], -s[pick]))[:k]]


def _scorer(queries, k):
    """A function for mapInArrow: each candidate block's k best for each of the broadcast queries."""

    def run(batches):
        import pyarrow as pa

        q_ids, q_row, q_term, q_weight = queries.value
        starts = np.searchsorted(q_row, np.arange(0, len(q_ids) + TILE, TILE))
        limit = int(np.abs(q_weight).max(initial=0))
        for batch in (whole.slice(a, BLOCK) for whole in batches for a in range(0, whole.num_rows, BLOCK)):
            ids, row, term, weight = _csr(batch.column(0), batch.column(1))
            if not len(ids):
                continue
            n = len(ids)
            postings = _by_term(row, term, weight)
            width = max((len(np.unique(term)), 1))
            kind = np.int32 if limit * int(np.abs(weight).max(initial=0)) * width < 2**31 else np.int64
            out_q, out_v, out_s = [], [], []
            for t in range(0, len(q_ids), TILE):
                a, b = starts[t // TILE], starts[t // TILE + 1]
                m = min(TILE, len(q_ids) - t)
                scores = np.zeros((m, n), kind)
                for word, (rows, w) in _by_term(q_row[a:b] - t, q_term[a:b], q_weight[a:b]).items():
                    if word not in postings:
                        continue
                    docs, v = postings[word]
                    add = np.multiply.outer(w.astype(kind), v.astype(kind))
                    if len(docs) == n:  # every candidate has the term: the scatter is the whole row
                        if len(rows) == m:
                            scores += add
                        else:
                            scores[rows] += add
                    else:
                        scores[np.ix_(rows, docs)] += add
                for i, mine in enumerate(_top(scores, ids, q_ids[t : t + m], k)):
                    out_q.append(np.full(len(mine), q_ids[t + i]))
                    out_v.append(ids[mine])
                    out_s.append(scores[i, mine].astype(np.int64))
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, batch: int = QUERY_BATCH) -> DataFrame:
    """For each query the k candidates of the highest integer inner product, without itself.

    Both tables are (id long, weights array<long>) as ``quantize`` makes them. Columns: query_id,
    rank (from 1), vec_id, score; ties go to the smaller vec_id; fewer rows where there are fewer
    candidates. Weights are sparse: zero components make no postings, and vectors of different
    lengths score over the components they share. Products are summed in 64 bits.

    Queries go out in batches of about ``batch`` at most, and of ``QUERY_WEIGHTS`` weights (the bound of
    what is broadcast and of what the driver holds); each batch is scored against every candidate, block by block, in a map-only
    stage. Within a block the query's terms scatter their weighted postings into dense score
    arrays, a partition selection keeps the best, and a grouped limit merges the blocks.

    Repeated ids: a query matches no candidate of its own id; equal candidate rows stay apart and
    are returned as often as they occur; a repeated query id is one query per distinct vector,
    numbered together. Empty tables give an empty result.
    """
    spark = queries.sparkSession
    queries = queries.distinct()
    total, weights = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("weights")), F.lit(0))).first()
    parts = max(1, -(-total // batch), -(-weights // QUERY_WEIGHTS))
    schema = "query_id long, vec_id long, score long"
    merged = None
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    for i in range(parts):
        some = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i) if parts > 1 else queries
        got = some.toArrow().combine_chunks()
        if got.num_rows:
            got = got.sort_by("id")
            packed = _csr(got.column("id").combine_chunks(), got.column("weights").combine_chunks())
        else:
            none = np.zeros(0, np.int64)
            packed = (none, none, none, none)
        shared = spark.sparkContext.broadcast(packed)
        found = candidates.select("id", "weights").mapInArrow(_scorer(shared, k), schema)
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if parts > 1:  # written, so that the driver keeps one batch only
            found = materialize(found, "topk")
            shared.unpersist()
        merged = found if merged is None else merged.unionByName(found)
    return merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
