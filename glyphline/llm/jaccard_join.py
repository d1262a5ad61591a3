"""Near-duplicate groups by an exact n-gram Jaccard join over size-banded tiles.

1. Every text becomes its set of hashed word shingles. Equal sets are one class.
2. How many texts hold a shingle is counted over all of them, in ranges of the hash, as packed
   arrays (copies within a flush count once). A text that can link has to share one of its few rarest shingles with its partner (of
   n shingles, a partner holds 80 %, so that one of the n / 5 + 1 rarest of each is shared); if
   enough of them are its own alone, the text is done.
3. Classes that share one of those shingles in neighbouring size bands form a cluster (they meet
   by one shuffle, to which a task sends one class of each shingle and band), and a cluster is cut
   into tiles of bounded size.
4. In a tile, hashed bitmap signatures bound each pair's overlap from above by bit counts; what
   stays is decided by intersecting the sorted arrays. Pairs that are connected already need no
   further look, so that a tight group of m texts costs about m comparisons and no list of pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _slices
from .graph import components
from .shared import bounded_batches, fresh, materialize, mix, shingle_sets, small_side, unique_join

WIDTH, PERCENT = 5, 80
#: Shingles of a range of hashes; shingles and texts of a tile; shingles that a map task gathers.
RANGE, TILE_SHINGLES, TILE_TEXTS, FLUSH = 1_500_000, 1 << 20, 4096, 2 << 20
#: Parts of a tile's size that a cluster is cut into at first; blocks that a cluster may have in any case.
PARTS = 8
#: Bytes of text that are hashed at a time.
SLICE = 1 << 20
#: Bits of the map of candidates' ids, broadcast where their table is too large for that: 8 MB.
BITS = 1 << 26
#: A shingle that so many texts of one flush hold ranks behind all others.
FREQUENT = 32
_SALT = np.uint64(0xD6E8FEB86659FD93)
_HOT = 255
#: Kinds of rows: entries to be counted, entries that rank last anyway, and what the texts are.
_ENTRIES, _LAST, _DIRECTORY = 0, 1, 2
#: Band of a row that is a link already.
_LINK = -1


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    n = np.uint64(len(s))
    both = mix(np.array([mix(s).sum(dtype=np.uint64) + n, mix(s ^ _SALT).sum(dtype=np.uint64) + n], np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


def shingle_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, h1, h2): size and 128-bit hash of each text's shingle set."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for part in _slices(whole, 1, SLICE):
                n, h1, h2 = [], [], []
                for s in shingle_sets(part.column(1), width):
                    a, b = _set_hash(s)
                    n.append(len(s))
                    h1.append(a)
                    h2.append(b)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "n_shingles", "h1", "h2"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long")


# --- step 2: packed arrays by range of the shingle's hash, then by class ------------------------


def _ranges(n_ranges: int, width: int):
    """Map side: for each flush one row for each range of hashes, and a directory of its texts.

    An entry is a shingle's upper 48 bits (sorted, as differences) and its text's number in the
    flush; what else there is to know of a text (class and size) is sent once, in the directory.
    """
    schema = "part int, flush long, kind int, keys binary, docs binary, hot binary"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        task = TaskContext.get().partitionId() << 16
        held, classes, seen, turn, number = [], [], set(), 0, 0

        def rows(flush):
            nonlocal turn
            sizes = np.fromiter(map(len, held), np.int32, len(held))
            keys = np.concatenate(held) >> np.uint64(16)
            held.clear()
            docs = np.repeat(np.arange(len(sizes), dtype=np.uint32 if len(sizes) > 1 << 16 else np.uint16), sizes)
            order = np.argsort(keys)
            keys, docs = keys[order], docs[order]
            del order
            yield flush % n_ranges, flush, _DIRECTORY, np.array(classes, np.int64).tobytes(), sizes.tobytes(), b""
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            runs = np.diff(np.append(first, len(keys)))
            often = np.repeat(runs >= FREQUENT, runs)
            hot = keys[first[runs >= FREQUENT]]

            def row(part, kind, k, d, hot):
                delta = np.diff(k)
                if len(k) and int(delta.max(initial=0)) < 1 << 32:
                    packed = k[:1].tobytes() + delta.astype(np.uint32).tobytes()
                else:
                    packed = b"\1" + k.tobytes()
                return part, flush, kind, packed, d.tobytes(), hot.tobytes()

            step = np.uint64((1 << 48) // n_ranges + 1)
            edges = np.arange(n_ranges + 1, dtype=np.uint64) * step
            k, d = keys[~often], docs[~often]
            at, hot_at = np.searchsorted(k, edges), np.searchsorted(hot, edges)
            for p in range(n_ranges):
                if at[p] < at[p + 1] or hot_at[p] < hot_at[p + 1]:
                    yield row(p, _ENTRIES, k[at[p] : at[p + 1]], d[at[p] : at[p + 1]], hot[hot_at[p] : hot_at[p + 1]])
            k, d = keys[often], docs[often]
            for a in range(0, len(k), 1 << 16):  # rank last whatever others say: only passed on
                turn += 1
                yield row((flush + turn) % n_ranges, _LAST, k[a : a + (1 << 16)], d[a : a + (1 << 16)], hot[:0])

        def flush():
            nonlocal number
            got = []
            for r in rows(task | number):
                got.append(r)
                if len(got) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names)
                    got = []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names)
            number += 1
            classes.clear()
            seen.clear()

        total = 0
        for whole in batches:
            for part in _slices(whole, 1, SLICE):
                for s in shingle_sets(part.column(1), width):
                    h = _set_hash(s)
                    if not len(s) or h in seen:  # a copy of a text of this flush
                        continue
                    seen.add(h)
                    held.append(s)
                    classes.append(h[0])
                    total += len(s)
                    if total >= FLUSH or len(held) >= 1 << 21:
                        yield from flush()
                        total = 0
        if held:
            yield from flush()

    return run, schema


def _unpack(keys: bytes, docs: bytes):
    if len(keys) % 4 == 1:
        k = np.frombuffer(keys, np.uint64, offset=1)
    else:
        k = np.cumsum(np.concatenate((np.frombuffer(keys[:8], np.uint64), np.frombuffer(keys, np.uint32, offset=8).astype(np.uint64))), dtype=np.uint64)
    return k, np.frombuffer(docs, np.uint16 if len(docs) == 2 * len(k) else np.uint32)


def _refs(flush: int, docs: np.ndarray) -> np.ndarray:
    """A text's number over all flushes."""
    return (np.uint64(flush) << np.uint64(22)) | docs.astype(np.uint64)


def _counts(n_parts: int):
    """Of each range the shingles that several texts hold, ranked by how many, by part of the text."""
    schema = "part int, directory boolean, refs binary, counts binary, ranks binary"

    def batch(rows):
        import pyarrow as pa

        kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "directory", "refs", "counts", "ranks"])

    def by_text(refs, ranks):
        if not len(refs):
            return
        order = np.argsort(refs, kind="stable")
        refs, ranks = refs[order], ranks[order]
        first = np.flatnonzero(np.concatenate(([True], refs[1:] != refs[:-1])))
        count = np.diff(np.append(first, len(refs))).astype(np.int32)
        owner = mix(refs[first]) % np.uint64(n_parts)
        owners = np.repeat(owner, count)
        order, entries = np.argsort(owner, kind="stable"), np.argsort(owners, kind="stable")
        texts, count, ranks = refs[first][order], count[order], ranks[entries]
        yield from by_owner(False, owner[order], (texts, count), owners[entries], ranks)

    def by_owner(directory, owner, columns, owners, ranks):
        """Rows of arrays that are sorted by owner, cut where it changes."""
        cuts = np.append(np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))), len(owner))
        ends = np.append(np.searchsorted(owners, owner[cuts[:-1]]), len(owners))
        for at in range(0, len(cuts) - 1, 4096):
            yield batch([(int(owner[a]), directory, *(c[a:b].tobytes() for c in columns), ranks[x:y].tobytes()) for a, b, x, y in zip(cuts[at : at + 4096], cuts[at + 1 : at + 4097], ends[at : at + 4096], ends[at + 1 : at + 4097])])

    def run(batches):
        by_range: dict[int, list] = {}
        for arrived in batches:
            for r in arrived.to_pylist():
                if r["kind"] == _ENTRIES:
                    by_range.setdefault(r["part"], []).append((r["flush"], r["keys"], r["docs"], r["hot"]))
                elif r["kind"] == _LAST:
                    k, d = _unpack(r["keys"], r["docs"])
                    yield from by_text(_refs(r["flush"], d), k | np.uint64(_HOT << 48))
                else:
                    cls, size = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["docs"], np.int32)
                    refs = _refs(r["flush"], np.arange(len(cls)))
                    owner = mix(refs) % np.uint64(n_parts)
                    order = np.argsort(owner, kind="stable")
                    yield from by_owner(True, owner[order], (refs[order], size[order]), owner[order], cls[order])
        for part in list(by_range):
            rows = by_range.pop(part)
            hot = np.unique(np.concatenate([np.frombuffer(r[3], np.uint64) for r in rows]))
            keys, refs = [], []
            while rows:
                flush, k, d, _ = rows.pop()
                if d:
                    k, d = _unpack(k, d)
                    keys.append(k)
                    refs.append(_refs(flush, d))
            if not keys:
                continue
            keys, refs = np.concatenate(keys), np.concatenate(refs)
            order = np.argsort(keys)
            keys, refs = keys[order], refs[order]
            same = keys[1:] == keys[:-1]
            several = np.concatenate((same, [False])) | np.concatenate(([False], same))
            if len(hot):
                several |= np.isin(keys, hot)
            keys, refs = keys[several], refs[several]
            if not len(keys):
                continue
            order = np.lexsort((refs, keys))
            keys, refs = keys[order], refs[order]
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (refs[1:] != refs[:-1])))
            keys, refs = keys[new], refs[new]  # one entry for each text and shingle
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            count = np.diff(np.append(first, len(keys)))
            level = np.minimum(count, _HOT - 1).astype(np.uint64)
            if len(hot):
                level[np.isin(keys[first], hot)] = _HOT
            level = np.repeat(level, count)
            many = level > 1
            yield from by_text(refs[many], keys[many] | (level[many] << np.uint64(48)))

    return run, schema


def _leads(key: np.ndarray, band: np.ndarray, cls: np.ndarray):
    """One row (key, band, cls), of the smallest class, for each key and band; the distinct links (class, smallest)."""
    order = np.lexsort((cls, band, key))
    key, band, cls = key[order], band[order], cls[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (band[1:] != band[:-1])
    first = np.flatnonzero(new)
    lead = np.repeat(cls[first], np.diff(np.append(first, len(cls))))
    other = cls != lead
    a, b = cls[other], lead[other]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return (key[first], band[first], cls[first]), (a[new], b[new])


def _postings(percent: int):
    """Of each text the shingles, among its rarest, at which it can meet a partner.

    Of the classes of a part that share a shingle and a size band the smallest travels on for all of
    them, so that a shingle comes from a part once for each band; the links to it are rows
    (class, _LINK, smallest). Neighbouring bands: a partner is at most 1.25 times as large, so one band away.
    """

    def run(batches):
        import pyarrow as pa

        by_part: dict[int, list] = {}
        for arrived in batches:
            for r in arrived.to_pylist():
                by_part.setdefault(r["part"], []).append((r["directory"], r["refs"], r["counts"], r["ranks"]))
        for part in list(by_part):
            mine = by_part.pop(part)
            known = [r for r in mine if r[0]]
            mine = [r for r in mine if not r[0]]
            if not mine:
                continue
            names, sizes, classes = (np.concatenate([np.frombuffer(r[i], k) for r in known]) for i, k in ((1, np.uint64), (2, np.int32), (3, np.int64)))
            order = np.argsort(names)
            names, sizes, classes = names[order], sizes[order].astype(np.int64), classes[order]
            count = np.concatenate([np.frombuffer(r[2], np.int32) for r in mine])
            text = np.repeat(np.searchsorted(names, np.concatenate([np.frombuffer(r[1], np.uint64) for r in mine])), count)
            rank = np.concatenate([np.frombuffer(r[3], np.uint64) for r in mine])
            del mine, known
            order = np.lexsort((rank, text))
            text, rank = text[order], rank[order]
            first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            count = np.diff(np.append(first, len(text)))
            n = sizes[text[first]]
            # one more than needed: two shingles of a text may have the same 48 bits
            need = n + (-percent * n // 100) + 1 - (n - count) + 1
            place = np.arange(len(text)) - np.repeat(first, count)
            keep = place < np.repeat(need, count)
            text, rank = text[keep], rank[keep]
            keys = (rank & np.uint64((1 << 48) - 1)).astype(np.int64)
            bands = np.floor(np.log(sizes[text]) / np.log(126 / percent)).astype(np.int32)
            (keys, bands, leads), (a, b) = _leads(keys, bands, classes[text])
            rows = np.concatenate((keys, a)), np.concatenate((bands, np.full(len(a), _LINK, np.int32))), np.concatenate((leads, b))
            for i in range(0, len(rows[0]), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 65536]) for c in rows], ["key", "band", "cls"])

    return run, "key long, band int, cls long"


def _meet(batches):
    """Links (a, b) that connect the classes of each key in neighbouring bands, from all rows of these keys."""
    import pyarrow as pa

    held = [[np.asarray(c) for c in batch.columns] for batch in batches if batch.num_rows]
    if not held:
        return
    key, band, cls = (np.concatenate(c) for c in zip(*held, strict=True))
    held.clear()
    known = band == _LINK
    found = [(key[known], cls[known])]
    key, band, cls = key[~known], band[~known], cls[~known]
    found.append(_leads(np.tile(key, 2), np.concatenate((band, band + 1)), np.tile(cls, 2))[1])
    for a, b in found:
        for i in range(0, len(a), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 65536]), pa.array(b[i : i + 65536])], ["a", "b"])


# --- step 4: tiles ------------------------------------------------------------------------------


def tile_links(n: np.ndarray, sets: list[np.ndarray], group: np.ndarray, side: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (as places) that connect whatever is connected in a tile.

    n: sizes; group: what is known to be connected; side: if given, only pairs of different sides.
    """
    order = np.argsort(n, kind="stable")
    n, sets = n[order], [sets[i] for i in order]
    side = side[order] if side is not None else None
    root = np.unique(group[order], return_inverse=True)[1]
    m = len(n)
    bits = 256
    while bits < min(4096, 4 * int(n[-1] if m else 0)):
        bits *= 2
    marks = np.zeros((m, bits), bool)
    marks[np.repeat(np.arange(m), n), np.concatenate(sets).astype(np.int64) & (bits - 1) if m else []] = True
    maps = np.packbits(marks, axis=1).view(np.uint64)
    del marks
    links = []
    for i in range(m - 1):
        end = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
        js = np.arange(i + 1, end)
        js = js[root[js] != root[i]]
        if side is not None:
            js = js[side[js] != side[i]]
        if not len(js):
            continue
        need = -(-percent * (n[i] + n[js]) // (100 + percent))
        mine = n[i] - np.bitwise_count(maps[i] & ~maps[js]).sum(1, dtype=np.int64)
        others = n[js] - np.bitwise_count(maps[js] & ~maps[i]).sum(1, dtype=np.int64)
        for j in js[np.minimum(mine, others) >= need].tolist():
            if root[j] == root[i]:
                continue
            a, b = sets[i], sets[j]
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            common = int((b[at] == a).sum())
            if 100 * common >= percent * (len(a) + len(b) - common):
                root[root == root[j]] = root[i]
                links.append((int(order[i]), int(order[j])))
    return links


def _run_tiles(percent: int):
    """For rows (t1, t2, t3, cls, grp, side, n, arr) sorted by tile: the links of each tile."""

    def run(batches):
        import pyarrow as pa

        tile, rows = None, []

        def links():
            if len(rows) < 2:
                return
            sets = [np.frombuffer(r["arr"], np.uint64) for r in rows]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            side = np.array([r["side"] for r in rows]) if rows[0]["t3"] != rows[0]["t2"] and rows[0]["t3"] >= 0 else None
            found = tile_links(n, sets, np.array([r["grp"] for r in rows], np.int64), side, percent)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([rows[i]["cls"] for i in a], pa.int64()), pa.array([rows[i]["cls"] for i in b], pa.int64())], ["a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                if (now := (r["t1"], r["t2"], r["t3"])) != tile:
                    yield from links()
                    tile, rows = now, []
                rows.append(r)
        yield from links()

    return run


def _perhaps(docs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """docs without most of the rows whose key members lack, by a broadcast map of one bit for each hash of a key."""
    at = F.pmod(F.xxhash64(key), F.lit(BITS))
    slot, place = F.bitmap_bucket_number(at).alias("slot"), F.bitmap_bit_position(at).alias("place")
    maps = members.select(slot, place).groupBy("slot").agg(F.bitmap_construct_agg("place").alias("bits"))
    rows = docs.withColumns({"slot": slot, "place": place}).join(F.broadcast(materialize(maps, "maps")), "slot")
    byte = F.conv(F.hex(F.substring("bits", (F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.where(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1).select(docs.columns)


def _arrays(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """members (cls, cluster, star, stars, block, blocks, doc_id) with the sorted shingle hashes of each."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for part in _slices(whole, 1, SLICE):
                sets = list(shingle_sets(part.column(1), width))
                own = np.fromiter((_set_hash(s)[0] for s in sets), np.int64, len(sets)) == np.asarray(part.column(2))
                keep = pa.array(own)
                arr = pa.array([s.tobytes() for s, k in zip(sets, own, strict=True) if k], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(i).filter(keep) for i in range(2, part.num_columns)], arr], [*part.schema.names[2:], "arr"])

    few = small_side(members, 64)
    if few is members:  # the text is shuffled: that of few others with it
        docs = _perhaps(docs, members, "doc_id")
    rows = docs.join(few, "doc_id").select("doc_id", "text", "cls", "cluster", "star", "stars", "block", "blocks")
    out = rows.mapInArrow(run, "cls long, cluster long, star long, stars long, block long, blocks long, arr binary")
    return out.withColumn("n", (F.length("arr") / 8).cast("long"))


def _tiled(rows: DataFrame, percent: int) -> DataFrame:
    rows = rows.repartition("t1", "t2", "t3").sortWithinPartitions("t1", "t2", "t3", "cls")
    return rows.select("t1", "t2", "t3", "cls", "grp", "side", "arr").mapInArrow(_run_tiles(percent), "a long, b long")


def class_links(docs: DataFrame, sets: DataFrame, width: int = WIDTH, percent: int = PERCENT, tile_shingles: int = TILE_SHINGLES, tile_texts: int = TILE_TEXTS, range_size: int = RANGE) -> DataFrame:
    """Links (a, b) between classes (h1 values of ``sets``) that connect all that link."""
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    n_ranges = max(16, -(-total // range_size))
    n_parts = max(4, -(-n_ranges // 2))
    run, schema = _ranges(n_ranges, width)
    packed = docs.mapInArrow(run, schema).repartition(n_parts, "part")
    run, schema = _counts(2 * n_parts)
    packed = packed.mapInArrow(run, schema).repartition(n_parts, "part")
    run, schema = _postings(percent)
    near = packed.mapInArrow(run, schema).repartition(n_parts, "key").mapInArrow(_meet, "a long, b long")
    return linked_classes(docs, sets, near, width, percent, tile_shingles, tile_texts)


def linked_classes(docs: DataFrame, sets: DataFrame, near: DataFrame, width: int = WIDTH, percent: int = PERCENT, tile_shingles: int = TILE_SHINGLES, tile_texts: int = TILE_TEXTS) -> DataFrame:
    """Links (a, b) between classes that connect all that link within the clusters that candidates ``near`` (a, b) form."""
    clusters = components(near).withColumnRenamed("v", "cls").withColumnRenamed("label", "cluster")

    reps = sets.where("n_shingles > 0").groupBy(F.col("h1").alias("cls")).agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"))
    members = materialize(clusters.join(reps, "cls"), "clustered")

    def parts(texts: int, shingles: int):
        return F.greatest(F.ceil(F.col("m") / max(1, texts)), F.ceil(F.col("s") / max(1, shingles))).cast("long")

    stars = parts(tile_texts // PARTS, tile_shingles // PARTS)
    shape = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    shape = shape.select("cluster", "m", stars.alias("stars"), F.least(stars, F.greatest(parts(tile_texts, tile_shingles), F.lit(PARTS))).alias("blocks"))
    members = unique_join(members, materialize(shape, "shape"), ["cluster"], 48, "m")
    star, block = (F.pmod(F.xxhash64("cls"), F.col(c)).alias(c[:-1]) for c in ("stars", "blocks"))
    members = materialize(members.select("cls", "cluster", star, "stars", block, "blocks", "doc_id"), "members")

    sets_ = materialize(_arrays(docs, members, width), "arrays")
    # the cluster's first class goes into each of its tiles, so that a tight cluster of many holds together
    whole = F.sequence(F.lit(0).cast("long"), F.col("stars") - 1)
    rows = sets_.withColumn("star", F.explode(F.when(F.col("cls") == F.col("cluster"), whole).otherwise(F.array("star"))))
    first = rows.select(F.col("cluster").alias("t1"), F.col("star").alias("t2"), F.lit(-1).cast("long").alias("t3"), "cls", F.col("cls").alias("grp"), F.lit(0).alias("side"), "arr")
    links = materialize(_tiled(first, percent), "links")

    if not members.where("stars > 1").isEmpty():  # what a cluster's tiles left apart, block against block
        known = components(links).select(F.col("v").alias("cls"), F.col("label").alias("grp"))
        rows = unique_join(sets_.where("stars > 1"), known, ["cls"], 32, how="left").withColumn("grp", F.coalesce("grp", "cls"))
        rows = materialize(rows, "large")
        shape = rows.groupBy("cluster", "block").agg(F.min("grp").alias("g1"), F.max("grp").alias("g2"), F.min("n").alias("n1"), F.max("n").alias("n2"), F.max(F.col("stars") > F.col("blocks")).alias("coarse"))
        shape = materialize(shape, "shape")
        i, j = (shape.select("cluster", *[F.col(c).alias(f"{c}{x}") for c in ("block", "g1", "g2", "n1", "n2", "coarse")]) for x in "ij")
        pairs = i.join(j, "cluster").where("(blocki < blockj or (blocki = blockj and coarsei)) and not (g1i = g2i and g1j = g2j and g1i = g1j)")
        pairs = pairs.where((F.col("n1i") * percent <= F.col("n2j") * 100) & (F.col("n1j") * percent <= F.col("n2i") * 100))
        pairs = materialize(pairs.select("cluster", "blocki", "blockj"), "pairs")
        sides = [
            rows.join(pairs.where(f"blocki < blockj or {s} = 0").withColumn("block", F.col(f"block{x}")), ["cluster", "block"])
            .select(F.col("cluster").alias("t1"), F.col("blocki").alias("t2"), F.col("blockj").alias("t3"), "cls", "grp", F.when(F.col("blocki") == F.col("blockj"), -1).otherwise(s).alias("side"), "arr")
            for s, x in enumerate("ij")
        ]
        links = links.unionByName(_tiled(sides[0].unionByName(sides[1]), percent))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, **sizes) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs.

    A text's set holds the distinct shingles of ``width`` words (runs of bytes other than ASCII
    white space, A-Z lower-cased), with fewer words the whole sequence as one. Two texts link when
    100 * intersection >= percent * union. component_id is the smallest doc_id that links reach,
    the row's own included.

    Null and empty texts, and those without words, have an empty set and link with nothing. Rows
    with a null id have their set's size, a null component_id and no links. Repeated rows are
    copies of one another. An empty table gives an empty result. Other columns aren't used.

    Shingles are told apart by 64 bits of their hash, sets by 128 bits; ``sizes`` may give
    tile_shingles, tile_texts and range_size (bounds of memory, without influence on results).
    """
    bounded_batches(docs.sparkSession)
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    sets = materialize(shingle_table(docs, width=width), "sets")
    return document_components(sets, class_links(docs.where("doc_id is not null"), sets.where("doc_id is not null"), width, percent, **sizes))


def document_components(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of a table of sets, from the links between its classes."""
    known = sets.where("doc_id is not null")
    joined = components(links)
    classes = known.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    classes = classes.join(joined, F.col("h1") == F.col("v"), "left").withColumn("label", F.coalesce("label", "h1"))
    classes = materialize(classes, "classes")
    lowest = materialize(classes.where("v is not null").groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")), "lowest")
    # classes without links keep their own smallest id even if another has the same first 64 bits
    linked = unique_join(classes.where("v is not null"), lowest, ["label"], 32, "n").select("h1", "h2", "component_id")
    ids = linked.unionByName(classes.where("v is null").select("h1", "h2", F.col("rep").alias("component_id")))
    out = unique_join(sets, materialize(ids, "components"), ["h1", "h2"], 48, how="left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each group: that of the smallest id; rows with a null id stay."""
    groups = near_duplicates(docs, id_col, text_col, **how)
    name = fresh(docs.columns, "__drop")
    drop = materialize(groups.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "drop")
    return docs.join(small_side(drop, 16), F.col(id_col) == F.col(name), "left_anti")
