"""What a query costs doesn't grow faster than its input: batches bounded, equal pieces worked on once."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphline.config import Limits
from glyphline.kernels import columns, lexer, records
from glyphline.kernels import text as kernel
from glyphline.kernels.encode import Encoder
from glyphline.kernels.vocab import LEX_PROFILES, Detector, LexProfile
from glyphline.operators import archive, document, store, tokenize, unicode
from glyphline.plans.kernel import with_kernel
from glyphline.queries import QUERIES, engine


def test_views_look_at_odd_pieces_alone(monkeypatch):
    """Plain text isn't normalised character by character; equal odd pieces are looked at once."""
    texts = [f"plain text {i} " * 20 + "éz" for i in range(50)]
    want = [kernel.normalize_view(t.encode(), "NFC") for t in texts]
    seen = []
    real = kernel.normalize_view
    monkeypatch.setattr(kernel, "normalize_view", lambda data, mode: seen.append(len(data)) or real(data, mode))
    views, units = unicode._views("NFC").arrow([*(t.encode() for t in texts), None])
    assert views.to_pylist() == [*(w[0] for w in want), None] and units[-1].as_py() is None
    assert [[(u["start"], u["length"], [(s["start"], s["length"]) for s in u["spans"]]) for u in x] for x in units.to_pylist()[:-1]] == [w[1] for w in want]
    assert sum(seen) < 10


def test_route_spans_are_detected_and_encoded_once(monkeypatch):
    """Spans repeat; equal ones are worked on once for each worker."""
    e, seen = engine("en", "hi", "ja"), []
    real = Detector.detect
    text = "the देखो token こんにちは the é " * 3
    source = text.encode()
    parts = [(kind, source[s : s + n]) for kind, s, n in kernel.routes(source)]
    router = tokenize._Router(e)
    want = [i for kind, x in parts for i in router(x, kind > 0)[0]]
    rows = [(kind, s, n, *(tokenize._detected(e)(source[s : s + n]) if kind else (False, False, 0, 0, None))) for kind, s, n in kernel.routes(source)]
    monkeypatch.setattr(Detector, "detect", lambda self, data: seen.append(data) or real(self, data))
    found = list(tokenize._auto(e, True, False).many([source, b""] * 50))
    assert [f[1] for f in found] == [want, []] * 50
    assert len(seen) <= 100 + len({x for kind, x in parts if kind}) + 1  # each whole source once, each different span once
    seen.clear()
    columns, counts = tokenize._routes(e).columns([source, b""] * 50)
    assert list(zip(*columns, strict=True)) == rows * 50 and list(counts) == [len(rows), 0] * 50
    assert len(seen) <= len({x for kind, x in parts if kind})


def test_beams_of_a_batch(monkeypatch):
    """Segments of all sources of a batch together; each different one is searched once."""
    e = engine("en")
    encoder, calls = e.encoder(), []
    sources = [b"hello tokenizer ", None, b"", "日本語 hello::::x".encode(), b"\xff\xfe"] * 20
    want = [None if d is None else (encoder.beam(d)[0], encoder.cost(encoder.beam(d)[0]), encoder.cost(encoder.encode(d)[0])) for d in sources]
    real = Encoder.beam
    monkeypatch.setattr(Encoder, "beam", lambda self, data, width=16: calls.append(data) or real(self, data, width))
    ids, beam, least = (c.to_pylist() for c in tokenize._beam(e, 16).arrow(sources))
    assert [None if i is None else (i, b, c) for i, b, c in zip(ids, beam, least, strict=True)] == want
    assert len(calls) == len(set(calls))


def _scanned_plan(lengths, policy):
    """The definition: all lengths from the minimum to the maximum are looked at."""
    out, t, start = [], 0, 0
    while t < len(lengths):
        best = (None, 1, lengths[t])
        for count in range(1, len(lengths) - t + 1):
            size = sum(lengths[t : t + count])
            if policy.minimum <= size <= policy.maximum and (best[0] is None or abs(size - policy.preferred) <= best[0]):
                best = (abs(size - policy.preferred), count, size)
        out.append((t, best[1], start, best[2], best[2] > policy.maximum))
        t, start = t + best[1], start + best[2]
    return out


def test_block_plans_by_bisection():
    rng = random.Random(5)
    for _ in range(300):
        lengths = [rng.choice((1, 2, 3, 7, 40)) for _ in range(rng.randrange(60))]
        policy = records.BlockPolicy(*sorted(rng.randrange(1, 60) for _ in range(4)))
        assert records.block_plan(lengths, policy)[0] == _scanned_plan(lengths, policy)
    e, policy = engine(), records.BlockPolicy(4, 8, 16, 32)
    made = document._blocks(e, policy)
    sources = [b"hello tokenizer hello world", b"", b"x" * 100]
    rows, counts = made.columns(sources)
    assert list(zip(*rows, strict=True)) == [r for d in sources for r in made.rows(d, e.encoder().encode(d)[1])] and counts[1] == 0


def test_packed_arrays():
    """Packing and unpacking work on arrays, for lengths beyond 127 and ids of 32 bits too."""
    for ids, lengths in (([], []), ([5], [300]), ([2**32 - 1, 0, 7], [1, 128, 70_000]), (list(range(1000)), [1 + k % 200 for k in range(1000)])):
        for kind in (list, np.array):
            packed = records.pack_tokens(kind(ids), kind(lengths), bytes(32), bytes(32))
            got, sizes, head = records.unpacked_arrays(packed)
            assert isinstance(got, np.ndarray) and (got.tolist(), sizes.tolist(), head["count"]) == (ids, lengths, len(ids))


class _Seen:
    most = 1 << 16

    def arrow(self, sources):
        return [pa.array([sum(map(len, sources))] * len(sources))]


def test_kernels_bound_what_they_are_given(spark):
    """Tables look up some hundred bytes for each code point: a batch's sources are a quarter of a megabyte."""
    rows = spark.range(60).selectExpr("id", "repeat('x', 10000) as text").coalesce(1)
    got = with_kernel(rows, "text", "n bigint", _Seen).agg({"n": "max"}).first()[0]
    assert got <= _Seen.most + 10000
    for made in (unicode._clusters, unicode._table_findings, unicode._by_tables):
        assert made.most <= 1 << 18
    assert tokenize._dfa.most <= 1 << 19


def test_cached_encoding_reads_its_texts_once(spark, tmp_path):
    """Pieces are staged: texts are cut once, and read once more to tell null from empty ones."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    table = store.CacheTable(spark, str(tmp_path / "c"), 1)
    df = spark.range(20).select("id", told(F.concat(F.lit("hello tokenizer "), F.col("id").cast("string"))).alias("text"))
    for encoded in (20, 0):
        read.value = 0
        out, counts = store.encode_cached(df, engine("en"), table, ["id"])
        assert counts["encoded"] == encoded and out.where("packed_ids is not null").count() == 20
        assert read.value <= 2 * 20


def test_sizes_are_those_of_the_projections(spark):
    """What is only counted doesn't leave the task; nulls and sources over the limits have no sizes."""
    every = 63
    rows = spark.createDataFrame([(1, "let x_1 = 0x1F.5; é café"), (2, None), (3, ""), (4, "y" * 500)], "id long, text string")
    e = engine("en", lexer="python", limits=Limits(400))
    names = ["id", "status", "n_bytes", "source_sha256", "n_tokens", "n_graphemes", "n_findings", "n_units", "n_lexical", "n_semantic"]
    want = document.document_info(document.token_documents(rows, e, every), every).select(names)
    got = document.document_sizes(rows, e, every).select(names)
    assert sorted(got.collect()) == sorted(want.collect()) and got.dtypes == want.dtypes


def test_words_are_lexed_in_whole_arrays(monkeypatch):
    """The scanner looks only where a comment, a string or a number may begin; tokens and parts are those of ``lex``."""
    rng, profiles = random.Random(1), dict(LEX_PROFILES)
    profiles["odd"] = LexProfile("odd", ("#", "--"), (("(*", "*)", True), ("/*", "end", False)), (('"', None), ("'", "\\")), frozenset(["if", "extraordinary"]), True)
    profiles["words"] = LexProfile("words", ("REM",), (), (('"', "\\"),), frozenset(["if"]))
    bits = [b"a", b"B", b"1", b"9", b"_", b"$", b" ", b"\t", b"\n", b"\r", b"\r\n", b"'", b'"', b'"""', b"#", b"/", b"//", b"/*", b"*/", b"(*", b"*)", b"end", b"--", b"\\", b".", b"e+", b"0x1F"]
    bits += [b"\xc3\xa9", b"\xff", b"\0", b"if", b"while", b"HTTPServer2x", b"continue", b"extraordinary", b"REM", b"_Static_assert"]
    for _ in range(300):
        sources = [b"".join(rng.choice(bits) for _ in range(rng.randrange(rng.choice((3, 12, 40))))) for _ in range(rng.randrange(6))]
        for p in profiles.values():
            tokens, n, parts, m = columns.lexed(p, sources, True)
            want = [lexer.lex(p, d) for d in sources]
            each = [lexer.components(p, d, t) for d, t in zip(sources, want, strict=True)]
            assert list(zip(*(c.tolist() for c in tokens), strict=True)) == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]
            assert list(zip(*(c.tolist() for c in parts), strict=True)) == [x for w in each for x in w] and m.tolist() == [len(w) for w in each]
    seen = []
    real = lexer.identifier_parts
    monkeypatch.setattr(lexer, "identifier_parts", lambda word: seen.append(word) or real(word))
    columns.lexed(profiles["python"], [b" ".join(b"word%d_neverSeen" % k for k in range(2000))], True)
    assert not seen


def test_records_that_are_read_again_stay_in_their_task(spark):
    """Records have a hundred bytes for each of their sources: one kernel writes and reads them."""
    every, e = 63, engine("en", limits=Limits(400))
    rows = spark.createDataFrame([(1, "let x_1 = 0x1F.5; é café"), (2, None), (3, ""), (4, "y" * 500)], "id long, text string")
    both = document.read_documents(document.write_documents(rows, e, every))
    want = both.select("id", "status", "read_status", (F.col("source") == F.encode("text", "UTF-8")).alias("exact"), "flags")
    got = document.return_documents(rows, e, every).select(want.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.dtypes == want.dtypes
    assert document.return_documents(rows, e, every, ceiling=10).first().read_status == 9
    plan = QUERIES["r09_document_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "record" not in plan


def test_packed_records_that_are_unpacked_again_stay_in_their_task(spark):
    """Ids take eight bytes for each token: one kernel packs, unpacks and compares them with a fresh encoding."""
    rows = spark.createDataFrame([(1, "hello tokenizer é"), (2, None), (3, ""), (4, "y" * 500)], "id long, text string")
    for e in (engine("en"), engine(limits=Limits(400))):
        both = document.unpack(document.pack(tokenize.encode_ids(rows, e).withColumnRenamed("ids", "fresh"), e))
        want = both.select("id", "unpack_status", "source_length", (F.col("ids") == F.col("fresh")).alias("exact"))
        got = document.return_packed(rows, e).select(want.columns)
        assert sorted(got.collect()) == sorted(want.collect()) and got.dtypes == want.dtypes
    made = document._repacked(engine())
    made.fresh = document._ids(engine("hi"), [])
    made.fresh.encoder.single = [i + 1 for i in made.fresh.encoder.single]
    assert [r[2] for r in made.many([b"\xff\xfe", b""])] == [False, True]
    plan = QUERIES["r60_packed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "packed" not in plan


def test_restored_files_are_looked_up_in_tasks(spark, tmp_path):
    """A list of all files doesn't fit the driver; each row's file is asked for where the row is."""
    (tmp_path / "in" / "a b").mkdir(parents=True)
    (tmp_path / "in" / "a b" / "é%20").write_bytes(b"abc")
    (tmp_path / "in" / "empty").write_bytes(b"")
    (tmp_path / "outside").write_bytes(b"x")
    rows = spark.createDataFrame([("a b/é%20", 1), ("empty", 2), ("a b", 3), ("gone", 4), ("../outside", 5), (None, 6)], "path string, k int")
    for root in (str(tmp_path / "in"), (tmp_path / "in").as_uri()):
        got = archive.file_sizes(rows, root)
        assert {r.k: r.n_bytes for r in got.collect()} == {1: 3, 2: 0, 3: None, 4: None, 5: None, 6: None}
    made = QUERIES["r11_archive_restore"](spark, "/root/testdata/sf0.001")
    assert not any("/restored-" in f for f in made.inputFiles())


def test_cached_encoding_stages_no_contents(spark, tmp_path, monkeypatch):
    """Numbers and keys of pieces are staged alone, and what isn't missing isn't encoded, however many keys there are."""
    rng = random.Random(6)
    df = spark.createDataFrame([(k, "".join(rng.choice("abc de\n") for _ in range(9000))) for k in range(20)] + [(20, ""), (21, None)], "id long, text string").repartition(3)
    table, own, cleanup = store.CacheTable(spark, str(tmp_path / "c"), 1), engine("en"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    want = {r.id: None if r.ids is None else np.array(r.ids, "<u4").tobytes() for r in tokenize.encode_ids(df, own).collect()}
    for few in (0, 100_000):
        monkeypatch.setattr(store, "FEW_KEYS", few)
        for some in (df.where("id < 5 or id > 19"), df, df):
            out, counts = store.encode_cached(some, own, table, ["id"])
            got = {r.id: None if r.packed_ids is None else bytes(r.packed_ids) for r in out.collect()}
            assert got == {k: want[k] for k in got} and len(got) == some.count()
        assert counts["encoded"] == 0
        table = store.CacheTable(spark, str(tmp_path / "d"), 1)
    staged = [d for d in (tmp_path / "c").iterdir() if d.name.startswith("staged-")]
    assert staged and sum(f.stat().st_size for d in staged for f in d.glob("*.parquet")) < 180_000 / 2
    assert all("content" not in spark.read.parquet(str(d)).columns for d in staged)
    assert spark.conf.get(cleanup, None) == before
    for data in (b"", b"abc", np.arange(5000, dtype="<u4").tobytes()):
        assert store.uncompressed(store.compressed(data)) == data
