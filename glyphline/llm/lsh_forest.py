"""Near-duplicates by an LSH forest: several sorted orders of MinHash signatures.

1. Every text becomes its set of hashed word shingles and a signature of ``TREES * DEPTH`` MinHash
   values. Equal sets are one class; classes of one signature are candidates at once.
2. A tree is the order of all signatures by ``DEPTH`` values of its own, behind them by a sketch of
   one bit for each value of the whole signature. Classes with a common prefix stand together. A
   region is a run of classes that share a prefix; its depth is the least at which it has at most
   ``REGION`` classes, so that regions are deep where much is alike and shallow elsewhere.
3. Candidates are the classes of one region, and neighbours in the order (whose common prefix is
   the longest that there is), if their sketches agree in enough bits and their sizes allow a link.
4. Candidates that connect form clusters, in which links are confirmed on the full sets, tile by
   tile as in the n-gram Jaccard join.

A tree's prefixes that very many classes share are split at the next depth, over tasks too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _slices
from .jaccard_join import SLICE, _set_hash, document_components, linked_classes
from .shared import bounded_batches, fresh, materialize, mix, shingle_sets, small_side

WIDTH, PERCENT = 4, 80
#: Orders, and MinHash values that each sorts by.
TREES, DEPTH = 16, 8
#: Classes of a region at most; neighbours on one side that are looked at in any case.
REGION, NEIGHBOURS = 256, 4
#: Bits of 128 in which the sketches of candidates agree: four deviations below what a similarity of 0.8 gives.
AGREE = 102
#: Rows of a task that builds regions; texts whose prefixes are counted to find hot ones.
ROWS, SAMPLE = 400_000, 65_536
#: Signatures that a task remembers, so as to send each once.
SEEN = 1 << 20
_VALUES = TREES * DEPTH

_rng = np.random.default_rng(20250117)
_FACTOR = _rng.integers(0, 1 << 31, _VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, _VALUES, dtype=np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """Signature of a set of 64-bit hashes: the least value under each of 128 permutations of 32 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(_VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(best, (x[at : at + 4096, None] * _FACTOR + _SHIFT).min(0), out=best)
    return best


def signature_table(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, signature) of rows (doc_id, text): set size, 128-bit hash of the set, MinHash values."""

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_shingles", "h1", "h2", "signature"]
        for whole in batches:
            for part in _slices(whole, 1, SLICE):
                n, h1, h2, made = [], [], [], []
                for s in shingle_sets(part.column(1), width):
                    a, b = _set_hash(s)
                    n.append(len(s))
                    h1.append(a)
                    h2.append(b)
                    made.append(min_hashes(s).tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n, h1, h2)), pa.array(made, pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, signature binary")


def _signatures(column) -> np.ndarray:
    """A row of values for each signature of an Arrow column without empty ones."""
    _, _, data = column.buffers()
    size = 4 * _VALUES
    return np.frombuffer(data, np.uint32, len(column) * _VALUES, column.offset * size).reshape(-1, _VALUES)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """One bit of each value, as two 64-bit words a signature."""
    bits = ((signatures ^ (signatures >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)


def _prefixes(tree: int, values: np.ndarray, sketch: np.ndarray):
    """For each depth from 1 on, a 64-bit hash of the prefixes of this depth."""
    now = np.full(len(values), tree + 1, np.uint64)
    for c in (*values.T, *(w for b in sketch.T for w in (b >> np.uint64(32), b & np.uint64(0xFFFFFFFF)))):
        now = mix((now * _STEP) ^ c.astype(np.uint64))
        yield now


def _hot_prefixes(sets: DataFrame, region: int) -> np.ndarray:
    """Hashes of prefixes that more classes share than a task should get, found among about ``SAMPLE`` texts.

    A prefix counts as hot only if more than ``region`` different signatures of the sample share
    it, so that its region is split at the next depth whether or not it is found here.
    """
    total = sets.count()
    some = sets.sample(fraction=min(1.0, SAMPLE / max(1, total)), seed=19).select("signature").distinct().coalesce(8)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = _signatures(batch.column(0))
            marks = sketches(values)
            for t in range(TREES):
                alive = np.arange(len(values))
                for p in _prefixes(t, values[:, t * DEPTH : (t + 1) * DEPTH], marks):
                    keys, at, count = np.unique(p[alive], return_inverse=True, return_counts=True)
                    several = count > 1  # alone in its batch it adds too little
                    if not several.any():
                        break
                    yield pa.RecordBatch.from_arrays([pa.array(keys[several].view(np.int64)), pa.array(count[several])], ["prefix", "n"])
                    alive = alive[several[at]]

    counted = some.mapInArrow(run, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    edge = max(region, min(total, SAMPLE) // 256)
    found = counted.where(F.col("n") > edge).select("prefix").toArrow()  # at most 256 for each tree and depth
    return np.sort(np.asarray(found["prefix"]).astype(np.int64).view(np.uint64))


def _plant(hot):
    """Map side: a row for each signature and tree, and links between classes of one signature.

    Rows: part (hash of the prefix that a task gets whole), the tree's values and the sketch as 64-bit words, size, class. A
    link (class, smallest class) has no part.
    """
    names = ["part", "k1", "k2", "k3", "k4", "b1", "b2", "n", "cls"]

    def run(batches):
        import pyarrow as pa

        seen: dict[bytes, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            cls, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            values = _signatures(batch.column(2))
            lead = np.fromiter((seen.setdefault(v.tobytes(), c) for v, c in zip(values, cls.tolist(), strict=True)), np.int64, len(cls))
            new = np.zeros(len(cls), bool)
            new[np.unique(lead, return_index=True)[1]] = True
            new &= lead == cls
            other = lead != cls
            if other.any():
                pairs = np.unique(np.stack((cls[other], lead[other])), axis=1)
                zero = np.zeros(pairs.shape[1], np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(zero), pa.int64()), *(pa.array(x) for x in (pairs[1], *[zero] * 6, pairs[0]))], names)
            # a copy of a class that an earlier batch sent is sent again, and dropped behind the shuffle
            cls, n, values = cls[new], n[new], values[new]
            marks = sketches(values)
            for t in range(TREES):
                mine = values[:, t * DEPTH : (t + 1) * DEPTH]
                steps = _prefixes(t, mine, marks)
                part = next(steps)
                if len(hot.value):
                    deeper = np.isin(part, hot.value)
                    for p in steps:
                        if not deeper.any():
                            break
                        part = np.where(deeper, p, part)
                        deeper &= np.isin(p, hot.value)
                words = (mine[:, ::2].astype(np.uint64) << np.uint64(32)) | mine[:, 1::2]
                columns = part, *words.T, *marks.T
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns), pa.array(n), pa.array(cls)], names)
            if len(seen) > SEEN:
                seen.clear()

    return run, ", ".join(f"{c} long" for c in names)


def _find(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Roots of some places."""
    now = parent[at]
    while True:
        up = parent[now]
        if (up == now).all():
            return now
        now = up


def region_links(part: np.ndarray, key: np.ndarray, sketch: np.ndarray, n: np.ndarray, region: int = REGION, neighbours: int = NEIGHBOURS, agree: int = AGREE, percent: int = PERCENT):
    """Candidate pairs (places i < j) that connect what is connected by candidates.

    part, key (rows of components), sketch (rows of two words), n: sorted by part and key, all different.
    """
    m = len(part)
    none = np.zeros(0, np.int64)
    if m < 2:
        return none, none
    differs = np.concatenate((key[1:] != key[:-1], np.ones((m - 1, 1), bool)), axis=1)
    shared = np.where(part[1:] == part[:-1], differs.argmax(1), -1)  # components that a row shares with the one before it
    place = np.full(m, -1, np.int64)  # the region's number
    open_, given = np.ones(m, bool), 0
    for depth in range(1, key.shape[1] + 1):
        first = np.concatenate(([True], shared < depth))
        run = np.cumsum(first) - 1
        size = np.bincount(run)
        small = open_ & (size[run] <= region)
        place[small] = given + run[small]
        given += len(size)
        open_ &= ~small
        if not open_.any():
            break
    group = np.cumsum(np.concatenate(([True], shared < 1)))
    parent = np.arange(m)
    out = []
    active = np.arange(m - 1)
    for o in range(1, m):
        active = active[active + o < m]
        j = active + o
        near = place[active] == place[j]
        near &= place[active] >= 0
        if o <= neighbours:
            near |= group[active] == group[j]
        else:
            active = active[near]  # a region's rows stand together: what is apart stays apart
            near = near[near]
        i = active[near]
        if not len(i):
            if o > neighbours:
                break
            continue
        j = i + o
        same = 128 - np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64)
        fits = (same >= agree) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[fits], j[fits]
        apart = _find(parent, i) != _find(parent, j)
        for a, b in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            x, y = a, b
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            while parent[y] != y:
                parent[y] = parent[parent[y]]
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a, b))
    if not out:
        return none, none
    pairs = np.array(out, np.int64)
    return pairs[:, 0], pairs[:, 1]


def _regions(region: int, percent: int):
    """Reduce side: links (a, b) between the classes of the prefixes that a task gets."""

    def run(batches):
        import pyarrow as pa

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            given = np.asarray(batch.column(0).is_null())
            if given.any():
                a, b = np.asarray(batch.column(8))[given], np.asarray(batch.column(1))[given]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            rows = np.stack([np.asarray(batch.column(0).fill_null(0)), *(np.asarray(c) for c in batch.columns[1:])])
            held.append(rows[:, ~given])
        if not held:
            return
        rows = np.concatenate(held, axis=1)
        held.clear()
        order = np.argsort(rows[0], kind="stable")
        rows = rows[:, order]
        same = rows[0, 1:] == rows[0, :-1]
        rows = rows[:, np.concatenate((same, [False])) | np.concatenate(([False], same))]  # alone with its prefix
        if not rows.shape[1]:
            return
        unsigned = rows[:7].view(np.uint64)
        order = np.lexsort((rows[8], *unsigned[::-1]))
        rows = rows[:, order]
        unsigned = rows[:7].view(np.uint64)
        new = np.concatenate(([True], (unsigned[:, 1:] != unsigned[:, :-1]).any(0)))
        first = np.flatnonzero(new)
        lead = np.repeat(rows[8, first], np.diff(np.append(first, rows.shape[1])))
        other = lead != rows[8]
        links = [(rows[8, other], lead[other])]
        rows, unsigned = rows[:, first], unsigned[:, first]
        key = np.stack([w for k in unsigned[1:] for w in (k >> np.uint64(32), k & np.uint64(0xFFFFFFFF))], axis=1)
        i, j = region_links(rows[0], key, np.ascontiguousarray(unsigned[5:7].T), rows[7], region, percent=percent)
        links.append((rows[8, i], rows[8, j]))
        for a, b in links:
            for at in range(0, len(a), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 65536]), pa.array(b[at : at + 65536])], ["a", "b"])

    return run


def candidate_links(sets: DataFrame, region: int = REGION, percent: int = PERCENT) -> DataFrame:
    """Candidate links (a, b) between the classes (h1 values) of a signature table."""
    sets = sets.where("n_shingles > 0")
    hot = sets.sparkSession.sparkContext.broadcast(_hot_prefixes(sets, region))
    run, schema = _plant(hot)
    n_parts = max(4, -(-sets.count() * TREES // ROWS))
    rows = sets.select("h1", "n_shingles", "signature").mapInArrow(run, schema)
    # links have no part: they are dealt out by their class
    rows = rows.repartition(n_parts, F.coalesce("part", "cls"))
    return rows.mapInArrow(_regions(region, percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, region: int = REGION, **sizes) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs.

    A text's set holds the distinct shingles of ``width`` words (runs of bytes other than ASCII
    white space, A-Z lower-cased), with fewer words the whole sequence as one. Two texts link when
    100 * intersection >= percent * union, confirmed on the full sets. component_id is the smallest
    doc_id that found links reach, the row's own included; kept: whether that is the row's own.

    Null and empty texts, and those without words, have an empty set, link with nothing and are
    kept. Rows with a null id have their set's size, a null component_id and no links, and are
    kept. Repeated rows are copies of one another: if their id is the smallest, all of them are
    kept. Very long texts have larger sets and signatures of the same size. An empty table gives an
    empty result. Other columns aren't used.

    No candidate is dropped by number: a region that is too large is split by more of its
    signature. A link is missed only if no tree brings its texts together (two texts of similarity
    0.8 share a region of depth d with probability 0.8^d in each of 16 trees) or if their sketches agree
    in fewer than ``AGREE`` bits (about one in 10,000 such links), and then only if no other link connects them.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    made = materialize(signature_table(docs, width), "signatures")
    near = candidate_links(made.where("doc_id is not null"), region, percent)
    sets = made.drop("signature")
    links = linked_classes(docs.where("doc_id is not null"), sets.where("doc_id is not null"), near, width, percent, **sizes)
    out = document_components(sets, links)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each group: that of the smallest id; rows with a null id stay."""
    name = fresh(docs.columns, "__drop")
    drop = near_duplicates(docs, id_col, text_col, **how).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(small_side(materialize(drop, "drop"), 16), F.col(id_col) == F.col(name), "left_anti")
