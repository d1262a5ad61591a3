"""Encoding and decoding of columns: ids, tokens, routes, languages. Map-only stages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LIMIT, OK, STATE, UNKNOWN_ID, Engine
from ..functions import native
from ..kernels import columns
from ..kernels import text as units
from ..kernels.automaton import Automaton
from ..kernels.vocab import PackError, count_overlapping
from ..plans.kernel import SLICE, flat_kernel, folded_kernel, lists, with_kernel

TOKENS = "array<struct<id:bigint,start:bigint,length:bigint,cost:int>>"


def _starts(lengths):
    at = 0
    for n in lengths:
        yield at
        at += n


class _ids:  # noqa: N801  a kernel over many sources at once
    def __init__(self, engine: Engine, tags):
        self.encoder, self.limits = engine.encoder(tags), engine.limits

    def many(self, sources):
        good = [d for d in sources if len(d) <= self.limits.max_input_bytes]
        ids, _, at = self.encoder.encode_many(good)
        parts = (ids[a:b] for a, b in zip(at, at[1:], strict=False))
        for data in sources:
            got = next(parts) if len(data) <= self.limits.max_input_bytes else None
            yield (OK, got) if got is not None and len(got) <= self.limits.max_output_tokens else (LIMIT, None)


def encode_ids(df: DataFrame, engine: Engine, column: str = "text", tags: list[str] | None = None) -> DataFrame:
    """df with status and ids; the deltas of all attached languages, or of ``tags``, apply.

    Null sources have null results; a source over the limits has status 9 and null ids.
    """
    return with_kernel(df, column, "status int, ids array<bigint>", _ids, engine, tags)


class _tokens:  # noqa: N801
    def __init__(self, engine: Engine, tags):
        self.encoder, self.limits = engine.encoder(tags), engine.limits
        table = sorted(self.encoder.base_cost.items())
        self.known, self.costs = (np.array(x, np.int64) for x in zip(*table, strict=True))

    def arrow(self, sources):
        import pyarrow as pa

        none = np.array([d is None for d in sources], bool)
        small = [d is not None and len(d) <= self.limits.max_input_bytes for d in sources]
        good = [d if ok else b"" for d, ok in zip(sources, small, strict=True)]
        ids, lengths, at = self.encoder.encode_many(good)
        counts = np.diff(at)
        fits = np.array(small, bool) & (counts <= self.limits.max_output_tokens)
        keep = np.repeat(fits, counts)
        bounds = np.cumsum([0, *map(len, good)])[:-1]
        starts = np.cumsum(lengths) - lengths - np.repeat(bounds, counts)
        ids = ids[keep]
        found = {"id": ids, "start": starts[keep], "length": lengths[keep], "cost": self.costs[np.searchsorted(self.known, ids)]}
        return [pa.array(np.where(fits, OK, LIMIT), mask=none), lists(np.where(fits, counts, 0), found, ~fits)]


def encode_tokens(df: DataFrame, engine: Engine, column: str = "text", tags: list[str] | None = None) -> DataFrame:
    """df with status and tokens (id, start, length in bytes, the vocabulary's own cost)."""
    return with_kernel(df, column, f"status int, tokens {TOKENS}", _tokens, engine, tags)


def _counted(engine: Engine, tags):
    encoder = engine.encoder(tags)

    def fn(sources):
        ids, counts = np.unique(encoder.encode_many(sources)[0], return_counts=True)
        return list(zip(ids.tolist(), counts.tolist(), strict=True))

    return fn


def token_counts(df: DataFrame, engine: Engine, column: str = "text", tags: list[str] | None = None) -> DataFrame:
    """(token_id, n_tokens) over all sources, counted before anything is shuffled."""
    part = folded_kernel(df, column, "token_id bigint, n bigint", _counted, engine, tags)
    return part.groupBy("token_id").agg(F.sum("n").alias("n_tokens"))


class _beam:  # noqa: N801  a kernel over whole batches
    def __init__(self, engine: Engine, width: int):
        self.encoder, self.width = engine.encoder(), width
        table = sorted(self.encoder.base_cost.items())
        self.known, self.costs = (np.array(x, np.int64) for x in zip(*table, strict=True))

    def arrow(self, sources):
        import pyarrow as pa

        none = np.array([d is None for d in sources], bool)
        good = [d or b"" for d in sources]
        totals, found = [], None
        for beams in (False, True):
            ids, _, at = self.encoder.encode_many(good, self.width if beams else None)
            paid = np.concatenate(([0], np.cumsum(self.costs[np.searchsorted(self.known, ids)])))[at]
            totals.append(pa.array(np.diff(paid), mask=none))
            found = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(none))
        return [found, totals[1], totals[0]]


def encode_beam(df: DataFrame, engine: Engine, column: str = "text", width: int = 16) -> DataFrame:
    """df with beam_ids, beam_cost and, to compare, the least cost there is."""
    return with_kernel(df, column, "beam_ids array<bigint>, beam_cost bigint, least_cost bigint", _beam, engine, width)


def decode(df: DataFrame, engine: Engine, column: str = "ids", limit: int | None = None) -> DataFrame:
    """df with decode_status and decoded: the surfaces of an array of ids, concatenated.

    An unknown id has status 6, a result over ``limit`` bytes (default: the input limit) status 9.
    """
    table, most = sorted((i, s) for i, _, s in engine.vocabulary.rows), limit or engine.limits.max_input_bytes
    known = np.array([i for i, _ in table], np.int64)
    bytes_ = np.frombuffer(b"".join(s for _, s in table), np.uint8)
    sizes = np.array([len(s) for _, s in table], np.int64)
    begins = np.cumsum(sizes) - sizes
    names = [c for c in df.columns if c not in ("decode_status", "decoded")]
    rows = df.select(*names)
    at = names.index(column)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                part = whole.slice(a, 256)
                lists = part.column(at)
                counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
                ids = np.asarray(lists.flatten().fill_null(-1), np.int64)
                k = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                owner = np.repeat(np.arange(len(counts)), counts)
                wrong = np.bincount(owner[known[k] != ids], minlength=len(counts)) > 0
                length = sizes[k]
                ends = np.cumsum(length)
                total = int(ends[-1]) if len(ends) else 0
                out = bytes_[np.arange(total) + np.repeat(begins[k] - ends + length, length)]
                stops = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
                status = np.where(wrong, UNKNOWN_ID, np.where(np.diff(stops) > most, LIMIT, OK)).astype(np.int32)
                none = np.asarray(lists.is_null())
                raw = out.tobytes()
                found = [None if no or st else raw[x:y] for no, st, x, y in zip(none, status, stops, stops[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(status, mask=none), pa.array(found, pa.binary())], [*names, "decode_status", "decoded"])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("decode_status", T.IntegerType()), T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def decode_joined(ids: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, decoded) of (key, pos, token_id) rows by a join with the vocabulary table.

    The relational form for ids that are rows already; an unknown id makes the result null.
    """
    rows = ids.join(vocabulary.select("token_id", "surface"), "token_id", "left")
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("surface").alias("h")))).alias("p"), F.count("*").alias("n"), F.count("surface").alias("m"))
    return got.select(key, F.when(F.col("n") == F.col("m"), F.unhex(F.array_join(F.col("p.h"), ""))).alias("decoded"))


class _trip:  # noqa: N801
    def __init__(self, engine: Engine):
        self.encoder = engine.encoder()
        known, begins, sizes, self.bytes = self.encoder.surfaces()
        self.place = None
        if known[-1] < 1 << 22:  # ids small enough for a table
            self.place = np.zeros(known[-1] + 1, np.int64)
            self.place[known] = np.arange(len(known))
        self.known, self.begins, self.sizes = known, begins, sizes

    def arrow(self, sources):
        import pyarrow as pa

        none = np.array([d is None for d in sources], bool)
        good = [d or b"" for d in sources]
        ids, lengths, at = self.encoder.encode_many(good)
        k = self.place[ids] if self.place is not None else np.searchsorted(self.known, ids)
        size = self.sizes[k]
        if np.array_equal(size, lengths):
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            back = self.bytes[np.arange(total) + np.repeat(self.begins[k] - ends + size, size)]
            source = np.frombuffer(b"".join(good), np.uint8)
            wrong = np.flatnonzero(back != source)
            bounds = np.cumsum([0, *map(len, good)])
            exact = np.bincount(np.searchsorted(bounds, wrong, "right") - 1, minlength=len(good)) == 0
        else:
            exact = np.array([self.encoder.decode(ids[a:b].tolist()) == d for a, b, d in zip(at, at[1:], good, strict=False)], bool)
        return [pa.array(np.diff(at), mask=none), pa.array(exact, mask=none)]


def round_trip(df: DataFrame, engine: Engine, column: str = "text") -> DataFrame:
    """df with n_tokens and exact: whether decoding the ids gives the source's bytes."""
    return with_kernel(df, column, "n_tokens int, exact boolean", _trip, engine)


def _edges(engine: Engine):
    encoder = engine.encoder()

    def fn(sources):
        out = {}
        for s, entries in encoder.entries.items():
            n = sum(data.count(s) if len(s) == 1 else count_overlapping(data, s) for data in sources)
            if n:
                out |= {i: n for _, i in entries}
        return sorted(out.items())

    return fn


def lattice_counts(df: DataFrame, engine: Engine, column: str = "text") -> DataFrame:
    """(token_id, n_edges): at how many places each token's surface stands in the sources."""
    part = folded_kernel(df, column, "token_id bigint, n bigint", _edges, engine)
    return part.groupBy("token_id").agg(F.sum("n").alias("n_edges"))


def _lattice(engine: Engine):
    encoder = engine.encoder()

    def fn(data):
        n = len(data)
        out = []
        for a in range(n):
            for size in reversed(encoder.lengths[data[a]]):
                if a + size <= n:
                    out += [(a, a + size, i, c) for c, i in encoder.entries.get(data[a : a + size], ())]
        return out

    return fn


def lattice(df: DataFrame, engine: Engine, keys: list[str], column: str = "text") -> DataFrame:
    """keys and start, end, token_id, cost of every place where a surface stands."""
    return flat_kernel(df, keys, column, "start bigint, end bigint, token_id bigint, cost bigint", _lattice, engine)


def _segments(engine: Engine):
    encoder = engine.encoder()

    def fn(data):
        cuts = encoder.boundaries(data)
        return len(cuts) - 1, max((b - a for a, b in zip(cuts, cuts[1:], strict=False)), default=0)

    return fn


def segments(df: DataFrame, engine: Engine, column: str = "text") -> DataFrame:
    """df with n_segments between forced boundaries and the longest one's bytes."""
    return with_kernel(df, column, "n_segments bigint, longest bigint", _segments, engine)


def segments_sql(df: DataFrame, engine: Engine, column: str = "text") -> DataFrame:
    """The relational form of ``segments``: pairs of bytes that no surface has, counted natively."""
    marks = bytearray(1 << 16)
    for _, _, surface in engine.vocabulary.rows:
        for k in range(len(surface) - 1):
            marks[surface[k] << 8 | surface[k + 1]] = 1
    n = F.octet_length(column)
    cuts = native.pairs_without(F.encode(F.col(column), "UTF-8"), bytes(marks))
    return df.withColumn("n_segments", F.when(n > 0, cuts + 1).otherwise(0).cast("bigint"))


class _dfa:  # noqa: N801  a kernel over whole batches
    #: Each byte takes some dozen bytes for each state meanwhile.
    most = SLICE // 8

    def __init__(self, transitions, accepts, start):
        self.automaton = Automaton(transitions, accepts, start)

    def arrow(self, sources):
        import pyarrow as pa

        good, token, cost = self.automaton.run([s or b"" for s in sources])
        missing = ~good | np.array([s is None for s in sources], bool)
        return [pa.array(token, mask=missing), pa.array(cost, mask=missing)]


def run_automaton(df: DataFrame, transitions: dict, accepts: dict, start: int = 0, column: str = "text") -> DataFrame:
    """df with dfa_token and dfa_cost, null where the automaton rejects the source."""
    return with_kernel(df, column, "dfa_token bigint, dfa_cost bigint", _dfa, transitions, accepts, start)


# --- languages and routes -----------------------------------------------------------------------


def vocabulary_table(spark: SparkSession, engine: Engine) -> DataFrame:
    """(entry_index, token_id, cost, surface, length, first_byte)."""
    rows = [(k, i, c, bytearray(s), len(s), s[0]) for k, (i, c, s) in enumerate(engine.vocabulary.rows)]
    return spark.createDataFrame(rows, "entry_index int, token_id bigint, cost int, surface binary, length int, first_byte int")


def language_table(spark: SparkSession, engine: Engine) -> DataFrame:
    """(tag, surface, delta) of the attached languages."""
    rows = [(x.tag, bytearray(s), d) for x in engine.languages for s, d in x.deltas]
    return spark.createDataFrame(rows, "tag string, surface binary, delta int")


def attach_deltas(vocabulary: DataFrame, deltas: DataFrame) -> DataFrame:
    """(token_id, cost, delta) of a vocabulary (token_id, cost, surface): the sum of all languages' (tag, surface, delta) by surface, 0 without any."""
    by_surface = deltas.groupBy("surface").agg(F.sum("delta").alias("d"))
    return vocabulary.join(by_surface, "surface", "left").select("token_id", "cost", F.coalesce("d", F.lit(0)).cast("bigint").alias("delta"))


def adjustments(spark: SparkSession, engine: Engine) -> DataFrame:
    """(token_id, cost, delta): sum of the attached languages' deltas by surface, 0 without any."""
    return attach_deltas(vocabulary_table(spark, engine), language_table(spark, engine))


def language_sizes(deltas: DataFrame) -> DataFrame:
    """(tag, status, n_deltas, total) of languages as rows (tag, surface, delta).

    Status 1 for a tag that isn't 1 to 63 ASCII letters, digits and hyphens, 3 for a surface that is there twice, else 0.
    """
    by_surface = deltas.groupBy("tag", "surface").agg(F.count("*").alias("n"), F.sum("delta").alias("d"))
    sizes = by_surface.groupBy("tag").agg(F.max("n").alias("most"), F.count("*").alias("n_deltas"), F.sum("d").alias("total"))
    good = F.coalesce(F.col("tag").rlike("^[0-9A-Za-z-]{1,63}$") & ~F.contains("tag", F.lit("\n")), F.lit(False))
    return sizes.select("tag", F.when(~good, 1).when(F.col("most") > 1, 3).otherwise(0).alias("status"), "n_deltas", "total")


def detect(df: DataFrame, engine: Engine, column: str = "text") -> DataFrame:
    """df with detection: struct(matched, available, score, margin, language) of a string column."""
    scores = native.detector_scores(F.col(column), engine.detector)
    out = native.detection(scores, engine.detector, engine.tags)
    return df.withColumn("detection", F.when(F.col(column).isNotNull(), out))


def detector_score_rows(df: DataFrame, engine: Engine, keys: list[str], column: str = "text") -> DataFrame:
    """keys, language and score: one row for each profile."""
    scores = native.detector_scores(F.col(column), engine.detector)
    tags = F.array(*[F.lit(t) for t, _, _ in engine.detector.profiles])
    return df.select(*keys, F.posexplode(scores).alias("__k", "score")).select(*keys, F.element_at(tags, F.col("__k") + 1).alias("language"), "score")


DETECTION = "matched boolean, available boolean, score bigint, margin bigint, language string"


def _detected(engine: Engine):
    def fn(data):
        matched, score, margin, tag = engine.detector.detect(data)
        return matched, matched and tag in engine.tags, score, margin, tag

    return fn


def detect_bytes(df: DataFrame, engine: Engine, column: str) -> DataFrame:
    """The columns of a detection for any bytes, UTF-8 or not."""
    return with_kernel(df, column, DETECTION, _detected, engine)


#: Short sources whose results a worker remembers, and their bytes at most.
MEMORY, MEMORY_BYTES = 100_000, 64


def remembered(fn):
    """fn of bytes, its results for short ones kept; whoever takes a result doesn't change it."""
    held = {}

    def known(data: bytes):
        found = held.get(data)
        if found is None:
            found = fn(data)
            if len(data) <= MEMORY_BYTES:
                if len(held) >= MEMORY:
                    held.clear()
                held[data] = found
        return found

    return known


class _routes:  # noqa: N801  a kernel over whole batches
    def __init__(self, engine: Engine):
        self.detect = remembered(_detected(engine))

    def columns(self, sources: list[bytes]):
        """Route spans of all sources, and how many each has."""
        kinds, starts, lengths, counts, b = spans_of(sources)
        data = b"".join(sources)
        whole = starts + np.repeat(b.bounds[:-1], counts)
        none, detect = (False, False, 0, 0, None), self.detect
        found = [detect(data[a : a + n]) if kind else none for kind, a, n in zip(kinds.tolist(), whole.tolist(), lengths.tolist(), strict=True)]
        return [kinds, starts, lengths, *zip(*found, strict=True)] if found else [], counts


def spans_of(sources: list[bytes]):
    """Class, start and length of the route spans of all sources, spans of each source, and the batch."""
    b = columns.Batch(sources)
    kinds = units.route_classes(b.cps)
    first, size, counts = b.runs(kinds)
    return kinds[first], b.local(first), size, counts, b


def span_routes(df: DataFrame, engine: Engine, keys: list[str], column: str = "text") -> DataFrame:
    """keys, class, start, length and the detection of each maximal run of a class; class 0 isn't detected."""
    return flat_kernel(df, keys, column, f"class int, start bigint, length bigint, {DETECTION}", _routes, engine)


def _route_totals(engine: Engine):
    def fn(sources):
        b = columns.Batch(sources)
        kinds = units.route_classes(b.cps)
        first, size, _ = b.runs(kinds)
        n, n_bytes = np.bincount(kinds[first]), np.bincount(kinds[first], size)
        return [(int(k), int(n[k]), int(n_bytes[k])) for k in np.flatnonzero(n)]

    return fn


def route_totals(df: DataFrame, engine: Engine, column: str = "text") -> DataFrame:
    """(class, n_spans, n_bytes) over all sources."""
    part = folded_kernel(df, column, "class int, a bigint, b bigint", _route_totals, engine)
    return part.groupBy("class").agg(F.sum("a").alias("n_spans"), F.sum("b").alias("n_bytes"))


class _Router:
    """Encoders by language, made when first needed."""

    def __init__(self, engine: Engine):
        self.engine, self.made = engine, {}

    def __call__(self, data: bytes, detected: bool = True):
        tag = self.engine.detector.detect(data)[3] if detected else None
        tag = tag if tag in self.engine.tags else None
        if tag not in self.made:
            self.made[tag] = self.engine.encoder([tag] if tag else [])
        return self.made[tag].encode(data)

    def plain(self, data: bytes):
        """Without a detected language."""
        return self(data, False)


class _auto:  # noqa: N801  a kernel over many sources at once
    def __init__(self, engine: Engine, spans: bool, full: bool):
        router = _Router(engine)
        self.parts, self.detect, self.spans = (remembered(router.plain), remembered(router)), _detected(engine), spans
        self.most_bytes = engine.limits.max_input_bytes
        self.cost = {i: c for i, c, _ in engine.vocabulary.rows} if full else None

    def many(self, sources):
        good = [d for d in sources if len(d) <= self.most_bytes]
        if self.spans:
            kinds, starts, lengths, counts, _ = spans_of(good)
            spans = list(zip(kinds.tolist(), starts.tolist(), lengths.tolist(), strict=True))
            ends = np.concatenate(([0], np.cumsum(counts))).tolist()
            cut = iter([spans[a:z] for a, z in zip(ends, ends[1:], strict=False)])
        else:
            cut = iter([[(1, 0, len(d))] for d in good])
        for data in sources:
            if len(data) > self.most_bytes:
                yield LIMIT, None, None
                continue
            ids, lengths = [], []
            for kind, start, n in next(cut):
                a, b = self.parts[kind > 0](data[start : start + n])
                ids += a
                lengths += b
            if self.cost is not None:
                ids = [(i, s, m, self.cost[i]) for i, s, m in zip(ids, _starts(lengths), lengths, strict=True)]
            m, available, score, margin, tag = self.detect(data)
            yield OK, ids, {"matched": m, "available": available, "score": score, "margin": margin, "language": tag}


_ROUTED = "detection struct<matched:boolean,available:boolean,score:bigint,margin:bigint,language:string>"


def encode_auto(df: DataFrame, engine: Engine, column: str = "text", full: bool = False) -> DataFrame:
    """df with status, ids (or tokens if ``full``) and detection: the detected language's deltas apply alone."""
    what = f"tokens {TOKENS}" if full else "ids array<bigint>"
    return with_kernel(df, column, f"status int, {what}, {_ROUTED}", _auto, engine, False, full)


def encode_span_auto(df: DataFrame, engine: Engine, column: str = "text", full: bool = False) -> DataFrame:
    """As encode_auto, but each route span is detected and encoded on its own."""
    what = f"tokens {TOKENS}" if full else "ids array<bigint>"
    return with_kernel(df, column, f"status int, {what}, {_ROUTED}", _auto, engine, True, full)


def encode_batch(df: DataFrame, engine: Engine, column: str = "text", max_items: int | None = None) -> DataFrame:
    """encode_ids for a sealed engine: a row that fails has its status and doesn't stop the others.

    An engine that isn't sealed has status 13. max_items: if given, more rows have status 9 (they
    are counted up to that number first).
    """
    if not engine.sealed:
        raise PackError("only a sealed engine encodes batches", STATE)
    if max_items is not None and df.limit(max_items + 1).count() > max_items:
        raise PackError("too many rows in a batch", LIMIT)
    return encode_ids(df, engine, column)
