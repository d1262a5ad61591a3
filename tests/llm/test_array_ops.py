"""The operators with array kernels, against brute force, round trips and held-out accuracy."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphline.llm import byte_bpe, graph, html_extract, jaccard_join, language_id, pack_tokens, shared, topk_search, toxicity
from glyphline.llm.queries import tokenizer


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(6)], "x") for i in range(300)]
    rows += [(300, rows[7][1], "x"), (301, rows[7][1], "x"), (302, None, "x"), (303, [1.0, None], "x"), (304, [float("nan")] * 6, "x"), (305, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x"), (306, [], "x"), (307, [0.5, 0.5], "x"), (7, rows[7][1], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    good = topk_search.quantize(table)
    q = [(r.id, r.weights) for r in good.collect()]
    want = []
    for i, a in {(i, tuple(a)) for i, a in q if i % 50 == 0 or i == 7}:
        best = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in q if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    picked = good.where("id % 50 = 0 or id = 7")
    for batch in (1000, 3):
        out = topk_search.top_k(picked, good, 5, batch=batch).collect()
        assert sorted(map(tuple, out)) == sorted(want)
    assert topk_search.top_k(good.limit(0), good).count() == 0
    assert topk_search.top_k(picked, good.limit(0)).count() == 0
    assert topk_search.top_k(good.where("id = 1"), good.where("id < 3")).count() == 2


def test_top_k_hot_id(spark):
    rows = [(1, [0.9, 0.1 * (i % 3)]) for i in range(50)] + [(i, [0.01 * i, 0.2]) for i in range(2, 40)]
    good = topk_search.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).coalesce(1)
    q = [(r.id, r.weights) for r in good.collect()]
    for picked in (good.where("id = 1").limit(1), good.where("id = 30")):
        i, a = picked.first()
        want = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in q if j != i)[:5]
        out = topk_search.top_k(picked, good, 5).orderBy("rank").collect()
        assert [(-r.score, r.vec_id) for r in out] == want


def test_top_k_repeats_in_small_blocks(spark, monkeypatch):
    """Ten repeats of the query among the candidates of blocks of eight, and more asked for than there are."""
    monkeypatch.setattr(topk_search, "BLOCK", 8)
    rows = [(50, [0.9, 0.4])] * 10 + [(i, [0.01 * (i % 7), 0.2, 0.1 * i]) for i in range(1, 20)] + [(99, [0.0] * 3), (98, [0.5] * 400)]
    good = topk_search.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).coalesce(1)
    q = [(r.id, r.weights) for r in good.collect()]
    for k in (5, 100):
        want = sorted((-sum(x * y for x, y in zip(dict(q)[50], b)), j) for j, b in q if j != 50)[:k]
        out = topk_search.top_k(good.where("id = 50"), good, k).orderBy("rank").collect()
        assert [(-r.score, r.vec_id) for r in out] == want and len(out) == min(k, 21)


def test_joins_and_components_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(shared, "HOT_KEYS", 5)
    left = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(120)], "k long, v long")
    right = spark.createDataFrame([(k, -k) for k in range(0, 200, 2)], "k long, w long")
    for how in ("inner", "left"):
        got = shared.unique_join(left, right, ["k"], 16, how=how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
    rng = random.Random(3)
    order = list(range(300))
    links = [(i, i + 1) for i in range(199)] + [(250, i) for i in range(251, 300)]
    rng.shuffle(order)
    for names in (list(range(300)), order):
        got = dict(map(tuple, graph.components(spark.createDataFrame([(names[a], names[b]) for a, b in links], "a long, b long")).collect()))
        groups = [{names[i] for i in range(200)}, {names[i] for i in range(250, 300)}]
        assert got == {x: min(g) for g in groups for x in g}


def _oracle_groups(docs, percent=80):
    sets = []
    for i, t in docs:
        w = [x for x in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if docs[a][0] is not None and docs[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted(((i, len(sets[k]), None if i is None else low[find(k)]) for k, (i, _) in enumerate(docs)), key=str)


@pytest.mark.parametrize("sizes", [{}, {"tile_texts": 4, "range_size": 500}])
def test_near_duplicates(spark, sizes):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(500)}é"
    passage = " ".join(word() for _ in range(30))
    docs = []
    for d in range(60):
        base = [word() for _ in range(rng.choice([1, 3, 5, 8, 20, 60, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.2:
                copy += [word() for _ in range(len(copy) // 6)]
            docs.append((len(docs) * 7 % 1009, " ".join(copy).upper() if rng.random() < 0.2 else "\t".join(copy)))
    docs += [(2000 + i, passage + " " + " ".join(word() for _ in range(i % 9))) for i in range(40)]
    docs += [(3000, None), (3001, ""), (3002, " \n\t "), (None, passage), (3003, passage), (3003, passage), (3003, "else " + passage)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h1", F.lit("clash")).withColumn("cls", F.lit(1))
    got = jaccard_join.near_duplicates(table, **sizes).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _oracle_groups(docs)


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(none).count() == 0
    some = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.near_duplicates(some).collect())) == [(1, 0, 1), (2, 0, 2)]
    assert jaccard_join.keep_one(spark.createDataFrame([(2, "a"), (1, "a"), (None, "a")], "doc_id long, text string")).count() == 2


def _shuffled(spark, action) -> int:
    """Rows that the stages of action write for shuffles."""
    context, jvm = spark.sparkContext, spark._jvm

    def total():
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))

    def settled():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        return total()

    before = settled()
    action()
    return settled() - before


def test_classes_meet_by_one_shuffle(spark, monkeypatch):
    """Beyond the broadcast bound too, what texts may share is sent once, and once for many that share it."""
    rng = random.Random(4)
    passages = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(150)) for _ in range(200)]
    docs = [(i, passages[i] + " " + passages[(i + 1) % 200]) for i in range(200)]
    docs += [(1000 + i, docs[3][1] + f" more{i}") for i in range(5)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    got = []
    rows = _shuffled(spark, lambda: got.extend(jaccard_join.near_duplicates(table).collect()))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _oracle_groups(docs)
    assert rows < 2 * sum(n // 5 + 2 for _, n, _ in _oracle_groups(docs))  # a text sends n / 5 + 2 of its shingles at most; the rest is small


def test_text_of_candidates_alone_is_shuffled(spark, monkeypatch):
    docs = shared.materialize(spark.createDataFrame([(i, f"a b c d e f{i}") for i in range(3000)], "doc_id long, text string"), "docs")
    some = jaccard_join.shingle_table(docs).where("doc_id % 100 = 7")
    some = shared.materialize(some.selectExpr("h1 as cls", "h1 as cluster", "0L as star", "1L as stars", "0L as block", "1L as blocks", "doc_id"), "some")
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    name, got = "spark.sql.autoBroadcastJoinThreshold", []
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        rows = _shuffled(spark, lambda: got.extend(jaccard_join._arrays(docs, some, 5).collect()))
    finally:
        spark.conf.set(name, before)
    assert sorted((r.cls, r.n) for r in got) == sorted((r.cls, 2) for r in some.collect())
    assert rows < 300


def test_tight_group_and_frequent_passage(spark):
    """Many texts that share a passage, and a large group, by way of the path for frequent shingles."""
    rng = random.Random(9)
    line = " ".join(f"c{i}" for i in range(20))
    docs = [(i, line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))) for i in range(300)]
    base = [f"b{i}" for i in range(80)]
    for i in range(200):
        copy = list(base)
        copy[rng.randrange(80)] = f"x{i}"
        docs.append((1000 + i, " ".join(copy)))
    got = jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _oracle_groups(docs)


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 102), (102, 101), (7, 7), (200, 201)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys((100, 101, 102), 100), 200: 200, 201: 200}


def test_bpe_chunks_and_round_trip(spark):
    import tiktoken

    ranks, pattern = tokenizer()
    text = byte_bpe.read_ranks(ranks)
    small, whole = byte_bpe.Codec(text, pattern, 20, 7), byte_bpe.codec(text, pattern)
    plain = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=whole.ranks, special_tokens={})
    rng = random.Random(2)
    bits = ["a", "b", " ", "  ", "\n", "é", "中", "'s", "'ll", "1", "?!", "word", "x" * 50, " " * 30, "<|endoftext|>", "\u00a0", "🙂"]
    cases = ["", " ", "\n\n", "y" * 3000, " " * 500 + "z"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in cases:
        ids = np.array(plain.encode_ordinary(t), "<u4").tobytes()
        assert small.encode(t) == ids and whole.encode(t) == ids, t
        assert whole.decode(ids) == t.encode()
    rows = [(i, t, "x") for i, t in enumerate(cases)] + [(None, None, "x"), (5, None, "x"), (5, "w " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.encode_digests(docs, ranks, pattern).collect()
    for r, (i, t, _) in zip(out, rows, strict=True):
        ids = np.array(plain.encode_ordinary(t or ""), "<u4").tobytes()
        assert tuple(r) == (i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    full = byte_bpe.encode(docs, ranks, pattern)
    assert full.columns == ["doc_id", "text", "ids", "decoded"]
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in full.collect())
    assert byte_bpe.encode_digests(docs.limit(0), ranks, pattern).count() == 0


def test_packing_is_lossless(spark):
    import tiktoken

    ranks, pattern = tokenizer()
    codec = byte_bpe.codec(byte_bpe.read_ranks(ranks), pattern)
    plain = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(4)
    docs = [(i, "word " * rng.randrange(0, 90)) for i in range(200)] + [(900, None), (901, ""), (902, "long " * 5000), (None, "no id")]
    rows = pack_tokens.pack(spark.createDataFrame(docs, "doc_id long, text string"), ranks, pattern, capacity=64, eos=50256, pad=9, buffer=3000).collect()
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64 and set(ids[r.n_tokens :]) <= {9}
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.pieces) == len(r.position_resets)
        at = pack_tokens.positions(r.cu_seqlens, 64)
        assert all(at[s] == 0 for s in r.position_resets) and (np.diff(at)[np.diff(at) != 1] < 0).all()
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert pieces.setdefault((d, p), ids[a:b].tolist()) == ids[a:b].tolist()
    for d, t in docs:
        got = [x for (i, _), v in sorted(((k, v) for k, v in pieces.items() if k[0] == d), key=str) for x in v] if d is None else sum((pieces[k] for k in sorted(k for k in pieces if k[0] == d)), [])
        assert got == ([*plain.encode_ordinary(t), 50256] if t else [])
    assert pack_tokens.pack(spark.createDataFrame([], "doc_id long, text string"), ranks, pattern).count() == 0


def test_packing_depends_on_documents_alone(spark):
    ranks, pattern = tokenizer()
    rng = random.Random(14)
    docs = [(rng.choice([7, 7, i]), " ".join(rng.choice(["word", "other", "x"]) for _ in range(rng.randrange(1, 90)))) for i in range(300)]
    docs += [docs[0]] * 3 + [(None, "no id"), (None, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("ids", F.lit(1))
    packed = [pack_tokens.pack(t, ranks, pattern, capacity=64, eos=50256, pad=50257, buffer=2000, shards=4) for t in (table.coalesce(1), table.repartition(7), table.orderBy(F.desc("text")).repartition(3))]
    rows = [sorted(map(str, p.collect())) for p in packed]
    assert rows[0] == rows[1] == rows[2]
    used = pack_tokens.utilisation(packed[0], 64).collect()
    assert len(used) == 4 and all(0.8 < r.used <= 1 for r in used)
    whole = [list(np.frombuffer(r.ids, "<u2")) for r in packed[0].collect()]
    assert sum(r.n_tokens for r in used) == sum(x != 50257 for w in whole for x in w) == sum(len(w) for w in whole) - sum(w.count(50257) for w in whole)


def test_bpe_long_texts_over_tasks(spark):
    """Texts of many chunks, whose pieces are dealt over tasks, against the library; some repeat."""
    ranks, pattern = tokenizer()
    codec = byte_bpe.codec(byte_bpe.read_ranks(ranks), pattern)
    rng = random.Random(13)
    bits = ["word ", "a", "  ", "\n", "\u00e9", "\u4e2d", "'ll", "12", "?!", " " * 40, "x" * 700, "\U0001f642"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randrange(200, 900))) for _ in range(12)] + ["y" * 5000, " " * 3000 + "z", "short", "", None]
    rows = [(i, t) for i, t in enumerate(cases)] + [(50, cases[0]), (50, cases[0]), (None, cases[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("clash"))
    out = byte_bpe.encode_digests(docs, ranks, pattern, long=600, chunk=500).collect()
    want = []
    for i, t in rows:
        ids = np.array(codec.encoding.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for capacity in (1, 7, 64, 2048):
        lengths = rng.integers(1, capacity + 1, 400)
        bins = pack_tokens.best_fit_decreasing(lengths, capacity)
        assert sorted(i for b in bins for i in b) == list(range(400)) and all(lengths[b].sum() <= capacity for b in bins)
        rooms, used = [], 0  # the same rule, searched one by one
        for n in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(capacity - n)
                used += 1
        assert len(bins) == used


def _labelled(n, rng):
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(["an", "or", "the", "in", "es"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(10, 120))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(2 + len(words) // 20):
                words.insert(rng.randrange(len(words)), "bo" + rng.choice(["oz", "zo"]) + rng.choice(["an", "es", "in"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = _labelled(1500, random.Random(6))
    odd = [(9001, None), (9002, ""), (9003, "... 123"), (None, "booz boozes"), (9004, "an or the " * 20000), (3, docs[3][1])]
    table = spark.createDataFrame(docs + odd, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(5))
    known = spark.createDataFrame(labels + [(None, 1, 1), (9001, None, None), (9002, 1, 1), (9003, 0, 7)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(table, known).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    truth = {i: y for i, _, y in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = toxicity.drop_toxic(table, known)
    assert kept.columns == table.columns
    blind = toxicity.toxicity(table, known.limit(0)).collect()
    assert {r.predicted for r in blind} == {0}
    assert toxicity.toxicity(table.limit(0), known).count() == 0


def test_toxicity_few_labels(spark):
    docs, labels = _labelled(300, random.Random(8))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    place = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(4))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    bad = {i for i, _, y in labels if y}
    for toxic in (known.where("toxic = 1").where(place != 0), known.where("toxic = 1").where(place == 0), known.where("toxic = 1").limit(1)):
        few = toxic.unionByName(known.where("toxic = 0"))
        assert toxicity.fit(table, few).models is not None
        if toxic.count() > 3:
            found = {r.doc_id for r in toxicity.toxicity(table, few).where("held_out and predicted = 1").collect()}
            assert len(found & bad) > len(found - bad)
    clean = known.where("toxic = 1")  # nothing to tell from
    assert toxicity.drop_toxic(table, clean).count() == len(docs)


def test_kneser_ney_sums_to_one():
    words = [b"an", b"ant", b"bee", b"b", b"anna"]
    m = toxicity.Models(words, np.array([3, 1, 0, 2, 1]), np.array([1, 0, 4, 1, 0]), order=4)
    # the probabilities of all next bytes after a context add up to one, whatever was seen after it
    for stem in (b"", b"a", b"an", b"ann", b"zz"):
        total = np.zeros(3)
        for c in [*range(4, 256), toxicity._END]:
            word = np.frombuffer(stem + bytes([c]), np.uint8)
            text, place, _ = toxicity._padded(word, np.array([0]), np.array([len(word)]))
            total += m.probabilities(text, place)[:, len(stem) + 1]
        assert np.allclose(total, 1, atol=0.05)


def test_language_network(spark):
    rng = random.Random(8)
    parts = {"aa": ["ba", "da", "ga"], "bb": ["lo", "mo", "ro"], "cc": ["ñi", "ti", "ki"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randrange(2, 60))), lang))
    rows += [(700, None, "aa"), (701, "", "bb"), (702, "12 %$ !", None), (None, "bada gada", "aa"), (703, "lomo ", None), (704, "ñiti " * 20000, "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1)).withColumn("held_out", F.lit(1))
    out = {r.doc_id: r for r in language_id.language_id(docs, steps=150).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    assert [out[i].lang_pred for i in (700, 701, 702, 704)] == ["und", "und", "und", "cc"]
    held = [r for r in rows[:600] if out[r[0]].held_out]
    assert len(held) > 100 and sum(out[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert language_id.language_id(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_gradient():
    net = language_id.Network(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 9, (6, 4)), np.array([0, 1, 1, 0])
    x[4:, 1] = language_id.PAD

    def loss():
        p = net._label(net._states(x, "f"), net._states(x, "b"))
        mask = x != language_id.PAD
        return -(np.log(p[:, y, np.arange(4)]) * mask).sum() / mask.sum()

    grads = net.gradient(x, y)
    for name, at in (("Uf", (2, 1)), ("Ub", (7, 0)), ("Ef", (4, int(x[0, 0]))), ("Wb", (1, 2)), ("b", (0, 0))):
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-2
        up = loss()
        net.p[name][at] = keep - 1e-2
        down = loss()
        net.p[name][at] = keep
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-4)


def test_language_network_by_loops():
    """Pooled probabilities against the network written out for single bytes."""
    import pyarrow as pa

    net = language_id.Network(["a", "b", "c"], seed=2, hidden=4)
    texts = ["", "x", "ab\u00e9 " * 70, "zz top", None, "q" * (2 * language_id.SPAN)]

    def gate(v):
        return 0.5 + 0.5 * v / (1 + abs(v))

    def states(window, d):
        h, out = np.zeros(4), {}
        for t in range(len(window)) if d == "f" else range(len(window) - 1, -1, -1):
            x, u = net.p[f"E{d}"][:, window[t]].astype(float), net.p[f"U{d}"].astype(float) @ h
            r, z = (np.array([gate(x[i] + u[i]) for i in range(k, k + 4)]) for k in (0, 4))
            c = x[8:] + r * u[8:]
            c = c / (1 + np.abs(c))
            h = z * h + (1 - z) * c
            out[t] = h
        return out

    got = net.pooled(pa.array(texts))
    for t, p in zip(texts, got, strict=True):
        data, total = (t or "").encode(), np.zeros(3)
        for a in range(0, len(data), language_id.SPAN):
            w = list(data[a : a + language_id.SPAN])
            n = len(w)
            w += [language_id.PAD] * (language_id.SPAN - n)
            f, b = states(w, "f"), states(w, "b")
            for k in range(n):
                y = net.p["Wf"].astype(float) @ f[k] + net.p["Wb"].astype(float) @ b[k] + net.p["b"][:, 0]
                total += np.exp(y - y.max()) / np.exp(y - y.max()).sum()
        assert np.allclose(p, total / max(1, len(data)), atol=1e-4)


def _page(i, body, main="article"):
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header>Site <b>name</b></header>"
        f"<nav><ul><li><a href='/a'>Menu {i}</a></li></ul></nav><div class='cookie-notice'>We use cookies {i}</div><!-- <p>no</p> -->"
        f"<{main}><h1>Head {i} &amp; more</h1>{body}<form><label>Mail</label><button>Send</button></form></{main}>"
        f"<aside class='sidebar'><p>Aside {i}</p></aside><div id='comments'><p>Reader {i}</p></div><footer>&copy; me</footer></body></html>"
    )


def test_html_text(spark):
    rows, want = [], {}
    for i in range(90):
        rows.append((i, f"http://h{i % 2}.com/{i}", _page(i, f"<p>One\n  {i} <b>bold</b> x&lt;y<br>next<p>Two {i}<ul><li>A</li><li>B&nbsp;{i}</ul>")))
        want[i] = f"Head {i} & more\nOne {i} bold x<y next\nTwo {i}\nA\nB {i}"
    for i in range(90, 100):  # no article element: the template tells
        rows.append((i, f"http://plain.com/{i}", f"<html><body><div><p>Welcome to us</p></div><div><p>Story {i}</p><p>Rest {i * 7}</p></div><div>All rights reserved</div></body></html>"))
        want[i] = f"Story {i}\nRest {i * 7}"
    rows += [(200, None, None), (201, "", ""), (202, "http://one.com", "<p>lone &eacute;</p><p>x"), (203, "http://h0.com/b", "<article><p>cut <a href='"), (205, "http://h0.com/c", "<main><p>crumbs</p><article class=post><p>in</p><ol class='commentlist'><li>me</ol></article></main>"), (204, "x://y", "a < b & c"), (None, "http://h1.com/", "<article>n</article>"), (0, rows[0][1], rows[0][2])]
    want |= {205: "in", 200: "", 201: "", 202: "lone é\nx", 203: "cut", 204: "a < b & c", None: "n"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(3)).withColumn("text", F.lit("clash"))
    out = html_extract.extract_text(pages).collect()
    assert len(out) == len(rows) and sum(r.page_id == 0 for r in out) == 2
    for r in out:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_html_text_template_on_every_page(spark):
    rows, want = [], {}
    for i in range(12):  # the template's texts around an article's own
        body = f"<p>Posted in news</p><h1>Head {i}</h1><p>Story {i}</p><h2>Background</h2><p>More {i}</p><p>Read our magazine</p>"
        rows.append((i, f"http://a.com/{i}", f"<html><body><p>Home</p><article>{body}</article></body></html>"))
        want[i] = f"Head {i}\nStory {i}\nBackground\nMore {i}"
    for i in range(12, 24):  # an article of a sidebar isn't the page's
        rows.append((i, f"http://b.com/{i}", f"<html><body><p>Home</p><div><p>Story {i}</p></div><aside><article><p>Teaser {i}</p></article></aside></body></html>"))
        want[i] = f"Story {i}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract_text(pages).collect()} == want


def test_html_text_template_of_most_pages(spark, monkeypatch):
    def page(i, end="<p>All rights reserved</p></body></html>"):
        return f"<html><body><div><p>Welcome to us</p><p>Reply</p></div><div class='c{i % 3}'><p>Story {i}</p><p>Rest {i * 7}</p></div><ul><li>Reply</li></ul>{end}"

    rows, want = [], {}

    def put(host, html, text):
        rows.append((len(rows), f"http://{host}/{len(rows)}", html))
        want[len(rows) - 1] = text

    for i in range(100):  # blocks with an error, a page cut short and one of another layout
        put("large.com", page(i), f"Story {i}\nRest {i * 7}")
    put("large.com", "<html><body><h1>404</h1></body></html>", "404")
    put("large.com", page(500).split("<p>Rest")[0], "Story 500")
    put("large.com", "<table><tr><td>Index</td></tr></table>", "Index")
    for i in range(100):  # most are copies
        put("copies.com", page(min(i, 3)), f"Story {min(i, 3)}\nRest {min(i, 3) * 7}")
    long = "A story that is told at some length, of what came to pass and of those to whom it did, number "
    for n in (2, 3):  # few pages
        for i in range(n):
            put(f"small{n}.com", page(i, f"<p>{long}{i}</p><p>All rights reserved</p>"), f"Story {i}\nRest {i * 7}\n{long}{i}")
    for i in range(2):  # near copies: nothing shows what is the site's
        put("near.com", f"<body><p>{long}</p><p>End {i}</p>", f"{long.strip()}\nEnd {i}")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract_text(pages).collect()} == want
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)  # templates are shuffled
    assert {r.page_id: r.text for r in html_extract.extract_text(pages).collect()} == want


def test_html_text_by_slots_alone(spark):
    """No name, class or role tells the article from what is around it; the text of each part differs from page to page."""
    rng = random.Random(21)
    words = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "nunc", "erat"]) for _ in range(n)) + f" {rng.randrange(10**6)}"
    rows, want = [], {}
    for i in range(60):
        story = [words(rng.randrange(20, 60)) for _ in range(rng.randrange(1, 6))]
        menu = "".join(f"<a href='/{k}'>{words(4)}</a>" for k in range(6))
        odd = "<div>" + words(8) + "</div>" if i % 9 == 0 else ""  # a notice on some pages, behind the article
        body = f"<div>{menu}</div><div>{words(9)}</div><div><h1>{words(3)}</h1>{''.join(f'<p>{x}</p>' for x in story)}</div><div>{words(6)}</div>{odd}"
        if i % 20 == 7:
            body = f"<table><tr><td>{words(5)}</td></tr></table>"
        rows.append((i, f"http://slots.com/{i}", f"<html><body>{body}</body></html>"))
        if i % 20 != 7:
            want[i] = body.split("<h1>")[1].split("</h1>")[0] + "\n" + "\n".join(story)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_text(pages).collect()}
    assert {i: got[i] for i in want} == want
    # and by brute force: the slots are the divisions of most text that isn't the same, ranked by it
    found = html_extract.slots(pages.selectExpr("'h' as host", "html")).collect()
    total = {}
    for _, _, h in rows:
        for d in html_extract.divisions(html_extract.tokenize(h)):
            total[d.key] = total.get(d.key, 0) + d.chars - d.links
    assert len(found) == 1 and found[0].slots[0] == max(total, key=total.get)


def test_html_long_and_broken_pages():
    import time

    page = "<html><body><div>" + "".join(f"<p class=c{i}>Line {i} of a very long page</p>" for i in range(20000)) + "</div></body></html>"
    pieces = ["<a \"", "<a '", "</script ", "<div>", "<b></i>", "<p", "<!-", "<a b=\"<\">", "&amp;<"]
    begin = time.time()
    assert html_extract.extract(html_extract.tokenize(page)).count("\n") == 19999
    for piece in pieces:
        html_extract.extract(html_extract.tokenize(piece * 20000))
    tags = [tuple(2 * k for k in range(1, 4001))] * 30 + [tuple(2 * k for k in range(4000, 0, -1))]
    html_extract.deduce(tags, {})
    assert time.time() - begin < 60
