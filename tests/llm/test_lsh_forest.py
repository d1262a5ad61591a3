"""LSH forest: signatures, regions and rows against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphline.llm import jaccard_join
from glyphline.llm import lsh_forest as lf
from tests.conftest import compare_with_duckdb

SCHEMA = "doc_id long, text string, n_shingles string, kept int"


def _sets(text, width=4):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", low) if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def _brute(rows, width=4, percent=80):
    sets = [_sets(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if None in (rows[i][0], rows[j][0]):
                continue
            both = len(sets[i] & sets[j])
            if (both and 100 * both >= percent * len(sets[i] | sets[j])) or rows[i][0] == rows[j][0]:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    out = [(d, len(s), None if d is None else low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    return sorted(((*r, r[0] == r[2]) for r in out), key=str)


def _corpus(rng):
    word = lambda: f"w{rng.randrange(4000)}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 120)))) for i in range(150)]
    passage = " ".join(word() for _ in range(60))
    rows += [(200 + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(150)]  # a third share a passage
    base = [word() for _ in range(150)]
    for i in range(180):  # one large group of near copies
        mine = list(base)
        for _ in range(rng.randrange(0, 4)):
            mine[rng.randrange(150)] = word()
        rows.append((500 + i, " ".join(mine)))
    for i in range(60):  # pairs around the threshold
        words = rows[rng.randrange(150)][1].split()
        k = rng.randrange(0, 1 + len(words) // 8)
        rows.append((800 + i, " ".join(words[k:]) + " Extra" * (i % 3)))
    rows += [(i + 1000, rows[i][1]) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "ONE"), (2005, "long word é " * 30_000), (2006, "Long word é " * 29_000), (None, rows[3][1]), (3, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("region", [lf.REGION, 12])
def test_against_brute_force(spark, monkeypatch, region):
    monkeypatch.setattr(lf, "ROWS", 1500)
    rows = _corpus(random.Random(6))
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(5)
    out = lf.near_duplicates(table, region=region)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()), key=str)
    want = _brute(rows)
    if region < lf.REGION:  # regions far below the bound: nothing that isn't linked, and nearly all that is
        group = {r[0]: r[2] for r in want}
        assert all(group[r[0]] == group[r[2]] for r in got if r[0] is not None)
        linked = [r[0] for r in want if r[0] is not None and not r[3]]
        assert sum(not r[3] for r in got) >= 0.98 * len(linked)
    else:
        assert [r for r in got if r[0] is not None] == [r for r in want if r[0] is not None]
    assert [(r[1], r[2], r[3]) for r in got if r[0] is None] == [(len(_sets(rows[[i for i, _ in rows].index(None)][1])), None, True)]
    kept = lf.keep_one(table, region=region)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, _, k in got if k)


def test_odd_tables(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert lf.near_duplicates(table).count() == 0 and lf.keep_one(table).count() == 0
    table = spark.createDataFrame([(1, None, None, None), (None, "a b", None, None), (2, "a b", None, None)], SCHEMA)
    assert sorted(map(str, (tuple(r) for r in lf.near_duplicates(table).collect()))) == ["(1, 0, 1, True)", "(2, 1, 2, True)", "(None, 1, None, True)"]


def test_min_hashes_estimate_similarity():
    rng = np.random.default_rng(3)
    for size, near in ((12, 8), (200, 160), (9000, 7200)):
        same, bits = [], []
        for _ in range(40):
            x = rng.integers(0, 1 << 63, 2 * size - near, dtype=np.uint64)
            a, b = lf.min_hashes(x[:size]), lf.min_hashes(x[size - near :])
            same.append((a == b).mean())
            s = lf.sketches(np.stack((a, b)))
            bits.append(128 - int(np.bitwise_count(s[0] ^ s[1]).sum()))
        want = near / (2 * size - near)
        assert abs(np.mean(same) - want) < 0.05 and abs(np.mean(bits) / 128 - (1 + want) / 2) < 0.03


def test_regions_connect_what_brute_force_connects():
    rng = np.random.default_rng(5)
    for region in (4, 16, 1000):
        key = rng.integers(0, 3, (400, 12)).astype(np.uint64)
        key = np.unique(key, axis=0)
        part = key[:, 0].astype(np.int64) + 7
        sketch = rng.integers(0, 1 << 63, (6, 2), dtype=np.uint64)[rng.integers(0, 6, len(key))]  # equal, or about half of the bits
        n = rng.integers(90, 110, len(key))
        i, j = lf.region_links(part, key, sketch, n, region, neighbours=2)
        fits = lambda a, b: (sketch[a] == sketch[b]).all() and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b])
        assert all(a < b and part[a] == part[b] and fits(a, b) for a, b in zip(i, j, strict=True))

        def regions(rows, depth):
            if len(rows) <= region:
                yield rows
            else:
                for v in np.unique(key[rows, depth]):
                    yield from regions(rows[key[rows, depth] == v], depth + 1)

        want = [(a, b) for p in np.unique(part) for r in regions(np.flatnonzero(part == p), 1) for a in r for b in r if a < b and fits(a, b)]
        want += [(a, b) for a in range(len(key)) for b in (a + 1, a + 2) if b < len(key) and part[a] == part[b] and fits(a, b)]

        def classes(pairs):
            root = list(range(len(key)))
            find = lambda x: x if root[x] == x else find(root[x])
            for a, b in pairs:
                root[find(a)] = find(b)
            return [min(y for y in range(len(key)) if find(y) == find(x)) for x in range(len(key))]

        assert classes(zip(i, j, strict=True)) == classes(want)


def test_layout_has_no_influence(spark, monkeypatch):
    """The same candidates' components from any partitioning, with and without hot prefixes known."""
    from glyphline.llm.graph import components

    rows = _corpus(random.Random(8))
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string")
    seen = []
    for parts, sample in ((1, 65_536), (7, 65_536), (3, 0)):
        monkeypatch.setattr(lf, "SAMPLE", sample)
        sets = lf.signature_table(docs.repartition(parts)).cache()
        seen.append(sorted(map(tuple, components(lf.candidate_links(sets, region=10)).collect())))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 200


def test_query_against_sql(spark):
    got, want = compare_with_duckdb(spark, "op13_minhash_dedup")
    assert got == want


def test_refactored_join_still_shares_its_end(spark):
    sets = jaccard_join.shingle_table(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string"))
    none = spark.createDataFrame([], "a long, b long")
    assert sorted(map(tuple, jaccard_join.document_components(sets, none).select("doc_id", F.col("component_id")).collect())) == [(1, 1), (2, 1)]
