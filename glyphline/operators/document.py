"""Token documents of columns: projections, block plans, packed and whole records, cache entries."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import INTEGRITY, LIMIT, OK, UNSUPPORTED, Engine
from ..kernels import columns, lexer, records, text
from ..kernels.records import GRAPHEMES, LEXICAL, MODEL, NORMALIZATION, SECURITY, SEMANTIC, BlockPolicy
from ..kernels.vocab import PackError
from ..plans.kernel import SLICE, flat_kernel, lists, with_kernel
from .store import CacheTable, read_cache_records  # noqa: F401  a cache's operators are of documents too
from .tokenize import _detected, _ids, _Router

#: Column of each projection, in the order of the flags.
PROJECTIONS = {
    MODEL: "tokens array<struct<id:bigint,start:bigint,length:bigint>>",
    GRAPHEMES: "graphemes array<struct<start:bigint,length:bigint>>",
    SECURITY: "findings array<struct<kind:int,script_id:int,start:bigint,length:bigint>>",
    NORMALIZATION: "normalized binary, units array<struct<start:bigint,length:bigint,spans:array<struct<start:bigint,length:bigint>>>>",
    LEXICAL: "lexical array<struct<kind:int,start:bigint,length:bigint>>",
    SEMANTIC: "semantic array<struct<kind:int,lexical_index:bigint,start:bigint,length:bigint>>",
}


#: Column whose rows are counted as each projection's size.
SIZED = {MODEL: "tokens", GRAPHEMES: "graphemes", SECURITY: "findings", NORMALIZATION: "units", LEXICAL: "lexical", SEMANTIC: "semantic"}


def check_flags(engine: Engine, flags: int) -> None:
    """An engine without what a flag needs: status 10; no or unknown flags: status 1."""
    if not flags or flags >> 6:
        raise PackError("no or unknown projections", 1)
    for flag, have in ((SECURITY, engine.security), (NORMALIZATION, engine.normalization), (LEXICAL | SEMANTIC, engine.lexer)):
        if flags & flag and not have:
            raise PackError("a projection needs what isn't attached", UNSUPPORTED)


class _Builder:
    """Makes the dict that a document record is written from."""

    def __init__(self, engine: Engine, flags: int, mode: str, auto: bool):
        check_flags(engine, flags)
        self.engine, self.flags, self.mode = engine, flags, mode
        self.router = _Router(engine) if auto else None
        self.detected = _detected(engine) if auto else None
        self.encoder = engine.encoder()
        self.print = engine.fingerprint()
        self.tables = (text.script_table(), text.flag_table()) if flags & SECURITY else None

    def __call__(self, data: bytes) -> dict:
        f, doc = self.flags, {"source": data, "flags": self.flags, "fingerprint": self.print, "mode": text.MODES.index(self.mode)}
        if self.detected:
            m, available, score, margin, tag = self.detected(data)
            doc["detection"] = (int(m), int(available), score, margin, tag)
        if f & MODEL:
            ids, lengths = self.router(data) if self.router else self.encoder.encode(data)
            at, tokens = 0, []
            for i, n in zip(ids, lengths, strict=True):
                tokens.append((i, at, n))
                at += n
            doc["tokens"] = tokens
        if f & GRAPHEMES:
            doc["graphemes"] = text.graphemes(data)
        if f & SECURITY:
            doc["findings"] = text.findings(data, *self.tables)
        if f & NORMALIZATION:
            doc["normalized"], doc["units"] = text.normalize_view(data, self.mode)
        if f & (LEXICAL | SEMANTIC):
            doc["lexical"] = lexer.lex(self.engine.lexer, data)
            if f & SEMANTIC:
                doc["semantic"] = lexer.components(self.engine.lexer, data, doc["lexical"])
        return doc


class _columns:  # noqa: N801  a kernel over whole batches
    def __init__(self, engine: Engine, flags: int, mode: str, auto: bool):
        self.build = _Builder(engine, flags, mode, auto)
        limits = engine.limits
        self.most_bytes = min(limits.max_input_bytes, limits.max_document_bytes)

    def arrow(self, sources):
        import pyarrow as pa

        build, f = self.build, self.build.flags
        good = np.array([d is not None and len(d) <= self.most_bytes for d in sources], bool)
        missing = ~good

        def rows(counts, fields):
            out = np.zeros(len(sources), np.int64)
            out[good] = counts
            return lists(out, fields, missing)

        found = _projections(build, columns.Batch([d for d, g in zip(sources, good, strict=True) if g]))
        status = pa.array(np.where(good, OK, LIMIT), mask=np.array([d is None for d in sources], bool))
        out = [status, pa.array([build.print if g else None for g in good], pa.binary())]
        for flag, name in ((MODEL, "tokens"), (GRAPHEMES, "graphemes"), (SECURITY, "findings")):
            if f & flag:
                out.append(rows(*found[name]))
        if f & NORMALIZATION:
            texts, (counts, units), (n_spans, spans) = iter(found["normalized"]), found["units"], found["spans"]
            out.append(pa.array([next(texts) if g else None for g in good], pa.binary()))
            out.append(rows(counts, units | {"spans": lists(n_spans, spans)}))
        for flag, name in ((LEXICAL, "lexical"), (SEMANTIC, "semantic")):
            if f & flag:  # tokens that only the semantic part needed stay hidden
                out.append(rows(*found[name]))
        return out


class _sizes(_columns):
    """Sizes of the same projections; the rows themselves stay in the task."""

    most = SLICE // 16

    def arrow(self, sources):
        import pyarrow as pa

        f = self.build.flags
        good = np.array([d is not None and len(d) <= self.most_bytes for d in sources], bool)
        found = _projections(self.build, columns.Batch([d for d, g in zip(sources, good, strict=True) if g]))
        out = [pa.array(np.where(good, OK, LIMIT), mask=np.array([d is None for d in sources], bool))]
        for flag, name in SIZED.items():
            if f & flag:
                counts = np.zeros(len(sources), np.int64)
                counts[good] = found[name][0]
                out.append(pa.array(counts, mask=~good))
        return out


def _projections(build: _Builder, b: columns.Batch) -> dict:
    """What the flags ask for, of all sources: by name how many rows each source has, and their columns."""
    f, out = build.flags, {}
    if f & MODEL:
        if build.router:
            found = [build.router(d) for d in b.sources]
            ids, lengths = (np.array([x for r in found for x in r[i]], np.int64) for i in (0, 1))
            at = np.concatenate(([0], np.cumsum([len(r[0]) for r in found]))).astype(np.int64)
        else:
            ids, lengths, at = build.encoder.encode_many(b.sources)
        counts = np.diff(at)
        out["tokens"] = counts, {"id": ids, "start": np.cumsum(lengths) - lengths - np.repeat(b.bounds[:-1], counts), "length": lengths}
    if f & GRAPHEMES:
        first = columns.clusters(b)
        out["graphemes"] = b.per_source(first), {"start": b.local(first), "length": np.diff(np.append(b.starts[first], b.bounds[-1]))}
    if f & SECURITY:
        found, counts = columns.findings(b, *build.tables)
        out["findings"] = counts, dict(zip(("kind", "script_id", "start", "length"), found, strict=True))
    if f & NORMALIZATION:
        out["normalized"], counts, units, n_spans, spans = columns.views(b, build.mode)
        out["units"] = counts, {"start": units[0], "length": units[1]}
        out["spans"] = n_spans, {"start": spans[0], "length": spans[1]}  # of each unit
    if f & (LEXICAL | SEMANTIC):
        found, counts, parts, n_parts = columns.lexed(build.engine.lexer, b.sources, bool(f & SEMANTIC))
        out["lexical"] = counts, dict(zip(("kind", "start", "length"), found, strict=True))
        if f & SEMANTIC:
            out["semantic"] = n_parts, dict(zip(("kind", "lexical_index", "start", "length"), parts, strict=True))
    return out


def token_documents(df: DataFrame, engine: Engine, flags: int, column: str = "text", mode: str = "NFC", auto: bool = False) -> DataFrame:
    """df with status, fingerprint and a column for each projection that ``flags`` asks for.

    Only what is asked for is computed. A source over the limits has status 9 and nulls.
    """
    check_flags(engine, flags)
    schema = ", ".join(["status int", "fingerprint binary", *[p for f, p in PROJECTIONS.items() if flags & f]])
    return with_kernel(df, column, schema, _columns, engine, flags, mode, auto)


def document_sizes(df: DataFrame, engine: Engine, flags: int, column: str = "text", mode: str = "NFC", auto: bool = False) -> DataFrame:
    """df with status and what ``document_info`` adds to ``token_documents``, whose rows don't leave the task that makes them."""
    check_flags(engine, flags)
    schema = ", ".join(["status int", *[f"n_{name} int" for f, name in SIZED.items() if flags & f]])
    return _digested(with_kernel(df, column, schema, _sizes, engine, flags, mode, auto), column)


def _digested(documents: DataFrame, column: str, *more) -> DataFrame:
    data = F.encode(F.col(column), "UTF-8") if documents.schema[column].dataType.simpleString() == "string" else F.col(column)
    return documents.select("*", F.octet_length(data).alias("n_bytes"), F.sha2(data, 256).alias("source_sha256"), *more)


def document_info(documents: DataFrame, flags: int, column: str = "text") -> DataFrame:
    """documents with the source's size and SHA-256 and the size of each projection, natively."""
    return _digested(documents, column, *[F.size(c).alias(f"n_{c}") for f, c in SIZED.items() if flags & f])


#: Form and names of the fields of each section of a record that has rows.
_ROWS = {
    "tokens": ("token", ("id", "start", "length")),
    "graphemes": ("span", ("start", "length")),
    "findings": ("finding", ("kind", "script", "start", "length")),
    "units": ("unit", ("start", "length", "first", "count")),
    "spans": ("span", ("start", "length")),
    "lexical": ("token", ("id", "start", "length")),
    "semantic": ("component", ("kind", "index", "start", "length")),
}


class _written:  # noqa: N801  a kernel over many sources at once
    #: A record has about a hundred bytes for each of its source.
    most = SLICE // 64

    def __init__(self, engine: Engine, flags: int, mode: str, auto: bool):
        self.build, limits = _Builder(engine, flags, mode, auto), engine.limits
        self.most_bytes = min(limits.max_input_bytes, limits.max_document_bytes)

    def many(self, sources):
        made = iter(self.records([d for d in sources if len(d) <= self.most_bytes]))
        for data in sources:
            yield (OK, next(made)) if len(data) <= self.most_bytes else (LIMIT, None)

    def records(self, sources):
        build, b = self.build, columns.Batch(sources)
        found = _projections(build, b)
        if "units" in found:
            counts, units = found["units"]
            n, spans = found["spans"]
            before = np.concatenate(([0], np.cumsum(n)))  # spans before each unit
            edge = before[np.concatenate(([0], np.cumsum(counts)))]
            found["units"] = counts, units | {"first": before[:-1] - np.repeat(edge[:-1], counts), "count": n}
            found["spans"] = np.diff(edge), spans
        parts = {}
        for name, (form, fields) in _ROWS.items():
            counts, values = found.get(name, (np.zeros(len(sources), np.int64), {}))
            whole = records.table_of(form, int(counts.sum()), **dict(zip(fields, values.values(), strict=False)))
            ends = np.concatenate(([0], np.cumsum(counts))) * whole.itemsize
            parts[name] = whole.tobytes(), ends.tolist()
        mode, views = text.MODES.index(build.mode), found.get("normalized")
        for k, data in enumerate(sources):
            body = lambda name: parts[name][0][parts[name][1][k] : parts[name][1][k + 1]]  # noqa: B023, E731
            view = views[k] if views is not None else b""
            bodies = [data, body("tokens"), body("graphemes"), body("findings"), view, *map(body, ("units", "spans", "lexical", "semantic"))]
            detection = None
            if build.detected:
                m, available, score, margin, tag = build.detected(data)
                detection = (int(m), int(available), score, margin, tag)
            yield records.document_record(bodies, build.flags, build.print, mode, detection)


def write_documents(df: DataFrame, engine: Engine, flags: int, column: str = "text", mode: str = "NFC", auto: bool = False) -> DataFrame:
    """df with status and record: the whole document as one canonical binary record."""
    check_flags(engine, flags)
    return with_kernel(df, column, "status int, record binary", _written, engine, flags, mode, auto)


def _read(ceiling: int):
    def fn(data):
        try:
            head, bodies = records.document_tables(data, ceiling)
        except records.RecordError as e:
            return e.status, None, None, None
        except (ValueError, IndexError, KeyError):
            return INTEGRITY, None, None, None
        return OK, bodies[0], head["flags"], len(bodies[1])

    return fn


def read_documents(df: DataFrame, column: str = "record", ceiling: int = 1 << 30) -> DataFrame:
    """df with read_status, source, flags and n_tokens of records; a bad record has its status alone."""
    return with_kernel(df, column, "read_status int, source binary, flags int, n_tokens bigint", _read, ceiling)


class _returned(_written):
    """Records are written and read where they are made: a hundred times their sources, they don't leave the task."""

    def __init__(self, engine: Engine, flags: int, mode: str, auto: bool, ceiling: int):
        super().__init__(engine, flags, mode, auto)
        self.read = _read(ceiling)

    def many(self, sources):
        for data, (status, record) in zip(sources, super().many(sources), strict=True):
            if record is None:
                yield status, None, None, None
                continue
            read_status, source, flags, _ = self.read(record)
            yield status, read_status, None if source is None else source == data, flags


def return_documents(df: DataFrame, engine: Engine, flags: int, column: str = "text", mode: str = "NFC", auto: bool = False, ceiling: int = 1 << 30) -> DataFrame:
    """df with status, read_status, exact and flags: what ``read_documents`` finds in the records of
    ``write_documents``, and whether the source that it reads is the one that was written."""
    check_flags(engine, flags)
    return with_kernel(df, column, "status int, read_status int, exact boolean, flags int", _returned, engine, flags, mode, auto, ceiling)


class _blocks:  # noqa: N801  a kernel over whole batches
    def __init__(self, engine: Engine, policy: BlockPolicy):
        self.encoder, self.own, self.policy = engine.encoder(), engine.fingerprint(), policy

    def columns(self, sources):
        _, lengths, at = self.encoder.encode_many(sources)
        rows, counts = [], []
        for data, a, z in zip(sources, at.tolist(), at[1:].tolist(), strict=False):
            found = self.rows(data, lengths[a:z])
            rows += found
            counts.append(len(found))
        return list(zip(*rows, strict=True)), counts

    def rows(self, data, lengths):
        policy, own = self.policy, self.own
        blocks, macros = records.block_plan(lengths, policy)
        if 0 < policy.max_blocks < len(blocks) or 0 < policy.max_macroblocks < len(macros):
            return [(None,) * 9 + (LIMIT,)]
        names = [records.block_identity(own, data[s : s + n]) for _, _, s, n, _ in blocks]
        macro = {b: m for m, (first, count, _) in enumerate(macros) for b in range(first, first + count)}
        whole = [records.macroblock_identity(own, names[first : first + count]) for first, count, _ in macros]
        return [(k, *b[:4], b[4], macro[k], name, whole[macro[k]], OK) for k, (b, name) in enumerate(zip(blocks, names, strict=True))]


def blocks(df: DataFrame, engine: Engine, policy: BlockPolicy, keys: list[str], column: str = "text") -> DataFrame:
    """keys and a row for each block: its tokens, bytes, macroblock and identities, and status 0.

    A source of more blocks or macroblocks than the policy allows is one row of status 9.
    """
    schema = "block int, first_token bigint, n_tokens bigint, start bigint, length bigint, oversize boolean, macroblock int, identity binary, macroblock_identity binary, status int"
    return flat_kernel(df, keys, column, schema, _blocks, engine, policy)


def with_cache_keys(df: DataFrame, namespace: int, version: int) -> DataFrame:
    """blocks with cache_key, natively: SHA-256 of domain, identity, namespace and version."""
    tail = F.lit(bytearray(namespace.to_bytes(4, "little") + version.to_bytes(4, "little")))
    data = F.concat(F.lit(bytearray(records.KEY_DOMAIN)), F.col("identity"), tail)
    return df.withColumn("cache_key", F.unhex(F.sha2(data, 256)))


def distinct_blocks(df: DataFrame) -> DataFrame:
    """(cache_key, n_blocks, length): content that is worked on once however often it occurs."""
    return df.groupBy("cache_key").agg(F.count("*").alias("n_blocks"), F.min("length").alias("length"))


class _packed:  # noqa: N801  a kernel over many sources at once
    def __init__(self, engine: Engine):
        self.encoder, self.own = engine.encoder(), engine.fingerprint()

    def many(self, sources):
        ids, lengths, at = self.encoder.encode_many(sources)
        for data, a, z in zip(sources, at.tolist(), at[1:].tolist(), strict=False):
            yield (records.pack_tokens(ids[a:z], lengths[a:z], hashlib.sha256(data).digest(), self.own),)


def pack(df: DataFrame, engine: Engine, column: str = "text") -> DataFrame:
    """df with packed: lengths and ids of its tokens in the compact form."""
    return with_kernel(df, column, "packed binary", _packed, engine)


def _unpacked():
    def fn(data):
        try:
            ids, lengths, head = records.unpacked_arrays(data)
        except records.RecordError as e:
            return e.status, None, None, None, None
        return OK, ids, lengths, head["id_bits"], head["source_length"]

    return fn


def unpack(df: DataFrame, column: str = "packed") -> DataFrame:
    """df with unpack_status, ids, lengths, id_bits and source_length of packed records."""
    return with_kernel(df, column, "unpack_status int, ids array<bigint>, lengths array<bigint>, id_bits int, source_length bigint", _unpacked)


class _repacked(_packed):
    """Records are packed, unpacked and compared where they are made; ids of eight bytes for each token don't leave the task."""

    most = SLICE // 16

    def __init__(self, engine: Engine):
        super().__init__(engine)
        self.fresh, self.unpack = _ids(engine, None), _unpacked()

    def many(self, sources):
        for (_, fresh), (record,) in zip(self.fresh.many(sources), super().many(sources), strict=True):
            status, ids, _, _, length = self.unpack(record)
            yield status, length, None if ids is None or fresh is None else np.array_equal(ids, fresh)


def return_packed(df: DataFrame, engine: Engine, column: str = "text") -> DataFrame:
    """df with unpack_status, source_length and exact: what ``unpack`` finds in the records of ``pack``,
    and whether its ids are those of ``encode_ids``, an encoding of its own."""
    return with_kernel(df, column, "unpack_status int, source_length bigint, exact boolean", _repacked, engine)


def _cache_written(key_prefix: bytes):
    def fn(data):
        key = records.sha256(key_prefix, data)
        return key, records.write_cache_record(key, data)

    return fn


def cache_records(df: DataFrame, column: str = "text", domain: bytes = b"") -> DataFrame:
    """df with cache_key (SHA-256 of domain and bytes) and cache_record, the authenticated entry."""
    return with_kernel(df, column, "cache_key binary, cache_record binary", _cache_written, domain)
