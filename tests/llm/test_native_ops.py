"""Line dedup, decontamination and URL rules on small tables with every odd case."""

import pytest
from pyspark.sql import functions as F

from glyphline.llm import decontaminate, line_dedup, shared, url_filter

DOCS = "doc_id long, text string, n_lines int, extra string"


def test_line_dedup_windows(spark):
    rows = [
        (2, "x\na\nb\nc\ny", 7, "e"),
        (1, "a\nb\nc\nd", 7, None),
        (3, "a\nb\nc\nd\nz", 7, "e"),  # two overlapping windows
        (4, "short\none", 7, "e"),
        (5, "short\none", 7, "e"),
        (6, None, 7, "e"),
        (7, "", 7, "e"),
        (8, "r\nr\nr\nr\nr", 7, "e"),
        (None, "a\nb\nc", 7, "e"),
        (9, "short\none", 7, None),
        (9, "short\none", 7, None),
    ]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS))
    assert sorted(out.columns) == ["doc_id", "extra", "n_lines", "n_removed", "text"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
    want = [(1, "a\nb\nc\nd", 4, 0), (2, "x\ny", 5, 3), (3, "z", 5, 4), (4, "short\none", 2, 0), (5, "", 2, 2), (6, None, 0, 0), (7, "", 0, 0), (8, "r", 5, 4), (None, "a\nb\nc", 3, 0), (9, "", 2, 2), (9, "", 2, 2)]
    assert got == sorted(want, key=str)


def test_line_dedup_long_and_empty(spark):
    long = "\n".join(f"line {i}" for i in range(5000))
    out = line_dedup.dedup_lines(spark.createDataFrame([(1, long, 0, ""), (2, "head\n" + long, 0, "")], DOCS)).orderBy("doc_id").collect()
    assert (out[0].text, out[1].text, out[1].n_removed) == (long, "head", 5000)
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def dedup_oracle(rows, width=3):
    """Text of each id after windows in the order of (id, place); what later ones cover goes."""
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        lines = t.split("\n")
        gone = set()
        for k in range(max(1, len(lines) - width + 1)):
            window = tuple(lines[k : k + width])
            if window in seen:
                gone |= set(range(k, k + width))
            seen.add(window)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return {i: out.get(i, t) for i, t in rows}


@pytest.mark.parametrize("bound", [8 << 20, -1])
def test_line_dedup_against_brute_force(spark, monkeypatch, bound):
    """By broadcast, and beyond its bound by sorting, with a window that half of the texts hold."""
    import random

    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(shared, "HOT_KEYS", 20)
    rng = random.Random(5)
    line = lambda: rng.choice("abcdefg") * rng.randrange(1, 3)
    rows = []
    for i in range(300):
        lines = [line() if rng.random() < 0.5 else f"own {i} {k}" for k in range(rng.randrange(0, 30))]
        if i % 2:
            lines[len(lines) // 2 : len(lines) // 2] = ["the", "common", "passage", "here"]
        rows.append((i, "\n".join(lines) if i % 40 else None))
    table = spark.createDataFrame([(i, t, 1, "e") for i, t in rows] + [(None, "the\ncommon\npassage", 1, "e")], DOCS)
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(table).collect()}
    want = dedup_oracle(rows)
    assert got.pop(None) == ("the\ncommon\npassage", 0)
    assert {i: t for i, (t, _) in got.items()} == want
    assert sum(n for _, n in got.values()) > 300


def _contained(item, doc):
    def sh(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    a, b = sh(item), sh(doc)
    return bool(a) and 100 * len(a & b) >= 80 * len(a)


def test_decontamination_against_brute_force(spark):
    import random

    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 12, 30, 30, 60, 9])] + [(50, None), (51, ""), (None, "w1 w2 w3 w4 w5")]
    docs = []
    for d in range(120):
        words = [word() for _ in range(rng.randrange(0, 80))]
        if d % 3:
            part = rng.choice([t for _, t in items if t]).split()
            for _ in range(rng.randrange(0, 3)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() for w in part]
        docs.append((d, " ".join(words)))
    docs += [(500, None), (501, ""), (None, items[5][1]), (502, items[1][1]), (502, items[1][1])]
    want = {(d, i) for d, t in docs for i, x in items if d is not None and i is not None and _contained(x, t)}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("__hash", F.lit(1)).withColumn("item_id", F.lit("clash"))
    out = decontaminate.find_contained(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) > 20 and sorted((r.doc_id, r.item_id) for r in out) == sorted(want)
    kept = decontaminate.remove_contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns
    bad = {x for x, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x, _ in docs if x not in bad)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contained(d, none).count() == 0 and decontaminate.remove_contaminated(d, none).count() == d.count()


def test_url_rules(spark):
    rules = url_filter.rule_table(spark, [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", None, "/"), ("block", "Org", "/")])
    urls = [
        ("http://a.Example.COM/en/77?x", "a.example.com", "/en/77", "example.com/en/7", "allow"),
        ("http://b.com/en/", "b.com", "/en/", "com/en/", "block"),
        ("http://b.com/EN/", "b.com", "/EN/", None, "allow"),
        ("http://notcom/en/", "notcom", "/en/", None, "allow"),
        ("http://x.com", "x.com", "", None, "allow"),
        ("http://x.com?u=http://y.com/en/", "x.com", "", None, "allow"),
        ("no scheme com/en/", "", "", None, "allow"),
        ("http://x.org/a#b", "x.org", "/a", "Org/", "block"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://b.com/en/", "b.com", "/en/", "com/en/", "block"),
    ]
    pages = spark.createDataFrame([(i, u[0], "keep", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, __url string")
    out = url_filter.filter_urls(pages, rules).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule, r.verdict) for r in out] == urls
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0


def test_url_rules_beyond_broadcast(spark, monkeypatch):
    """Rows without a url, one url of most rows, and a host of very many labels."""
    import time

    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(url_filter, "HOT_KEYS", 4)
    rules = url_filter.rule_table(spark, [("block", "com", "/en/"), ("allow", "b.example.com", "/en/7")])
    urls = ["http://x.com/en/1"] * 300 + [None] * 200 + ["http://a.b.example.com/en/7"] * 3 + ["http://none.org/"] * 250 + [f"http://h{i}.com/de/" for i in range(20)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    want = {"http://x.com/en/1": ("com/en/", "block"), "http://a.b.example.com/en/7": ("b.example.com/en/7", "allow")}
    assert got == {i: want.get(u, (None, "allow")) for i, u in enumerate(urls)}
    long = [(0, "http://" + "a." * 50000 + "com/en/x"), (1, "http://x.com/en/" + "p" * 500000), (2, "://")]
    begin = time.time()
    out = url_filter.filter_urls(spark.createDataFrame(long, "page_id long, url string"), rules).orderBy("page_id").collect()
    assert [r.verdict for r in out] == ["block", "block", "allow"] and time.time() - begin < 30


def test_decontamination_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    item = " ".join(f"i{k}" for k in range(40))
    most = " ".join(f"i{k}" if k else "other" for k in range(40))
    half = " ".join(f"i{k}" if k % 12 else "other" for k in range(40))
    filler = " ".join(f"w{k % 977}" for k in range(60000))
    docs = [(1, f"{filler} {item} {filler}"), (2, f"{filler} {most}"), (3, f"{half} {filler}"), (4, filler)]
    out = decontaminate.find_contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.n_shared) for r in out.collect()) == [(1, 36), (2, 35)]


def test_decontamination_beyond_the_broadcast_bound(spark, monkeypatch):
    """An item and a shingle that a third of the documents hold: salted joins give what the broadcasts do."""
    common = " ".join(f"c{k}" for k in range(20))
    items = [(k, f"{common} " + " ".join(f"i{k}w{j}" for j in range(2 * (k % 2)))) for k in range(6)] + [(6, "a b c d e f"), (6, "a b c d e"), (7, None), (None, common)]
    docs = [(k, f"start{k} {common} end{k}" if k % 3 == 0 else f"word{k} other a b c d e f{k % 2} more words here {k}") for k in range(90)] + [(3, "again " + common), (None, common), (95, None)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontaminate.find_contained(d, i).collect()))
    assert len({r[0] for r in want}) >= 30 and len({r[1] for r in want}) == 7
    for name, value in (("BROADCAST_BYTES", -1), ("HOT_ROWS", 5), ("HOT_KEYS", 60), ("SALTS", 7)):
        monkeypatch.setattr(shared, name, value)
    assert sorted(map(tuple, decontaminate.find_contained(d, i).collect())) == want
    assert decontaminate.find_contained(d.limit(0), i).count() == 0 and decontaminate.find_contained(d, i.limit(0)).count() == 0


def test_salted_join(spark, monkeypatch):
    left = spark.createDataFrame([(k % 4 if k < 80 else 1, k) for k in range(200)] + [(None, 1), (9, 9)], "key long, a long")
    right = spark.createDataFrame([(k % 5, k) for k in range(15)] + [(1, 3), (1, 3), (None, 2)], "key long, b long")
    want = sorted(map(tuple, left.join(right, "key").collect()))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    for most in (0, 30, 10**9):
        monkeypatch.setattr(shared, "HOT_ROWS", most)
        assert sorted(map(tuple, shared.salted_join(left, right, "key", "a", 8).collect())) == want


@pytest.mark.parametrize("name", ["op1_exact_topk", "op2_ngram_jaccard", "op5_line_dedup", "op7_decontamination", "op9_url_filter"])
def test_sql(spark, name):
    from tests.conftest import compare_with_duckdb

    got, want = compare_with_duckdb(spark, name)
    assert got == want


def test_hosts_and_paths_of_any_length(spark):
    """Code points of one and of two UTF-16 units in turn, before, in and behind the host."""
    odd = "a\U0001f600" * 50_000
    rows = [(odd, "", ""), (f"{odd}://H{odd}/p", f"h{odd}", "/p"), (f"s://Host/{odd}?q", "host", f"/{odd}"), (f"s://h?{odd}/x", "h", ""), (f"s://h#/{odd}", "h", "")]
    rows += [("a://b://c/d", "b:", "//c/d"), ("://", "", ""), ("x://É.COM?q#/", "É.com", ""), (None, "", ""), ("http:/no", "", ""), ("s://h/a#b?c", "h", "/a"), ("s://h/a?b#c", "h", "/a"), ("s:///only/path", "", "/only/path")]
    table = spark.createDataFrame(rows, "url string, host string, path string")
    bad = table.where((url_filter.url_host(F.col("url")) != F.col("host")) | (url_filter.url_path(F.col("url")) != F.col("path")))
    assert bad.count() == 0
    judged = url_filter.filter_urls(table.select("url"), url_filter.rule_table(spark, [("block", "host", "/a")]))
    assert judged.where("verdict = 'block'").count() == 1
