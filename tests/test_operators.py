"""Operators on small tables with odd rows: nulls, empty and invalid bytes, limits, repeats, clashes."""

import hashlib
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphline.config import Engine, Limits
from glyphline.functions import native
from glyphline.kernels import columns, ed25519, lexer, records
from glyphline.kernels import text as kernel
from glyphline.kernels.records import GRAPHEMES, LEXICAL, MODEL, NORMALIZATION, SECURITY, SEMANTIC, BlockPolicy
from glyphline.kernels.vocab import LEX_PROFILES, PackError, base_detector, base_language, base_vocabulary, raw_bpe_vocabulary
from glyphline.operators import archive, document, lex, metrics, registry, tokenize, training, unicode
from glyphline.queries import engine, registry_table
from glyphline.sources import packs, readers
from glyphline.streaming import replay

ODD = [(1, b"hello tokenizer"), (2, None), (3, b""), (4, b"\xff\xfe a\xe2\x80"), (5, "こんにちは世界".encode()), (5, "こんにちは世界".encode()), (None, b"x" * 5000)]


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in ODD], "doc_id long, source binary").withColumn("ids", F.lit("clash")).withColumn("__source", F.lit(1))


def test_encode_odd_rows(spark, odd):
    e = engine("en", "ja", limits=Limits(1000, 1000, 1000))
    rows = tokenize.encode_ids(odd, e, "source").collect()
    assert [r.status for r in rows] == [0, None, 0, 0, 0, 0, 9] and rows[0].ids[-1] == 271 and rows[4].ids == [274] and rows[2].ids == []
    assert tokenize.encode_ids(odd.limit(0), e, "source").count() == 0
    got = tokenize.decode(tokenize.encode_ids(odd, e, "source"), e).collect()
    assert all(r.decoded is None if r.ids is None else bytes(r.decoded) == bytes(r.source) for r in got)
    bad = tokenize.decode(spark.createDataFrame([(1, [104, 999999]), (2, None), (3, [])], "k int, ids array<long>"), e).collect()
    assert [(r.decode_status, r.decoded) for r in bad] == [(6, None), (None, None), (0, b"")]
    tokens = tokenize.encode_tokens(odd, e, "source").where("doc_id = 1").first().tokens
    assert [t.start for t in tokens] == [0, 5, 6] and sum(t.length for t in tokens) == 15
    assert tokenize.detect_bytes(odd, e, "source").where("doc_id = 5").first().language == "ja"
    spans = tokenize.span_routes(odd, e, ["doc_id"], "source").where("doc_id = 4").orderBy("start").collect()
    assert [(r["class"], r.start, r.length) for r in spans] == [(4, 0, 2), (0, 2, 1), (1, 3, 1), (4, 4, 2)]
    edges = tokenize.lattice(odd.where("doc_id = 1"), e, ["doc_id"], "source")
    assert edges.where("token_id = 258").count() == 0 and edges.where("start = 6").count() == 3


def test_batches(spark, odd):
    e = engine(limits=Limits(1000))
    assert [r.status for r in tokenize.encode_batch(odd, e, "source", max_items=7).collect()] == [0, None, 0, 0, 0, 0, 9]
    for change, status in ((lambda: tokenize.encode_batch(odd, e, "source", max_items=6), 9), (lambda: tokenize.encode_batch(odd, Engine(base_vocabulary()), "source"), 13)):
        with pytest.raises(PackError) as err:
            change()
        assert err.value.status == status


def test_hindi_detected_but_not_attached(spark):
    df = spark.createDataFrame([("नमस्ते दुनिया",), ("tokenizer",), (None,)], "text string")
    e = Engine(base_vocabulary()).with_language(base_language("en")).with_detector(base_detector()).seal()
    rows = tokenize.encode_auto(df, e).collect()
    assert rows[0].ids == [265, 272] and rows[0].detection.matched and not rows[0].detection.available
    assert rows[1].ids == [271] and rows[1].detection.available and rows[2].ids is None
    native_rows = tokenize.detect(df, e).collect()
    assert [r.detection and tuple(r.detection) for r in native_rows[:2]] == [tuple(r.detection) for r in rows[:2]] and native_rows[2].detection is None
    spans = tokenize.encode_span_auto(spark.createDataFrame([("tokenizer नमस्ते दुनिया",)], "text string"), e).first()
    assert spans.ids[0] == 271


def test_native_parts(spark):
    df = spark.createDataFrame([(bytearray(b"\xad\x61"), "deserializeHTTP2Response", "0x1f", '"hello"')], "b binary, i string, n string, s string")
    bits = [native.bit_field(F.col("b"), F.lit(0), s, n, o) for s, n, o in ((0, 4, 0), (0, 4, 1), (4, 8, 0), (4, 16, 0), (9, 1, 0))]
    row = df.select(*[b.alias(f"b{k}") for k, b in enumerate(bits)], native.identifier_parts(F.col("i")).alias("i"), native.number_parts(F.col("n")).alias("n"), native.string_parts(F.col("s"), ['"', '"""']).alias("s"), native.byte_ids(F.col("b")).alias("ids")).first()
    assert [int(row[f"b{k}"].value) for k in range(3)] == [0xA, 0xD, 0xD6] and [row[f"b{k}"].status for k in (3, 4)] == [5, 1]
    assert row.i == ["deserialize", "HTTP", "2", "Response"] and [tuple(p) for p in row.n] == [(3, "0x"), (4, "1f")]
    assert [tuple(p) for p in row.s] == [(9, '"'), (9, '"'), (10, "hello")] and row.ids == [0xAD, 0x61]
    wide = df.select(native.bit_field(F.lit(bytearray(b"\xff" * 8)), F.lit(0), 0, 64).alias("v")).first().v.value
    assert int(wide) == 2**64 - 1


def test_unicode_odd_rows(spark, odd):
    rows = {r.doc_id: r for r in unicode.normalized_view(unicode.graphemes(odd, "source"), "NFC", "source").collect()}
    assert rows[2].graphemes is None and rows[3].graphemes == [] and [(g.start, g.length) for g in rows[4].graphemes] == [(k, 1) for k in range(6)]
    assert bytes(rows[4].normalized) == ODD[3][1]
    assert unicode.script_spans(odd, ["doc_id"], "source").where("doc_id = 4").count() >= 3
    mixed = spark.createDataFrame([(1, bytearray(bytes.fromhex("41D096E280AEE2808B")))], "k int, source binary")
    kinds = [r.kind for r in unicode.security_findings(mixed, ["k"], "source").orderBy("start", "kind").collect()]
    assert kinds == [5, 1, 2, 2]
    points = spark.createDataFrame([(65,), (0x416,), (65,), (None,)], "cp int")
    ranges = spark.createDataFrame([(0, 128, "ascii"), (0x400, 0x500, "cyrillic")], "start int, end int, value string")
    assert sorted(str(r.value) for r in unicode.range_lookup(points, ranges).collect()) == ["None", "ascii", "ascii", "cyrillic"]


def test_lex_and_semantic(spark, odd):
    parts = lex.lex(odd, LEX_PROFILES["c"], ["doc_id"], "source")
    assert parts.where("doc_id = 4").agg(F.sum("length")).first()[0] == 6 and parts.where("doc_id in (2, 3)").count() == 0
    row = lex.lex_columns(spark.createDataFrame([("httpCode = 0x1f;",)], "text string"), LEX_PROFILES["c"]).first()
    assert [p.kind for p in row.semantic] == [1, 1, 3, 4]


def test_token_documents(spark, odd):
    e = engine("en", limits=Limits(1000, 1000, 1000))
    every = MODEL | GRAPHEMES | SECURITY | NORMALIZATION | LEXICAL | SEMANTIC
    rows = document.token_documents(odd, e, every, "source", auto=True).collect()
    assert [r.status for r in rows] == [0, None, 0, 0, 0, 0, 9]
    hidden = document.token_documents(odd, e, SEMANTIC, "source")
    assert "lexical" not in hidden.columns and "semantic" in hidden.columns
    bare = Engine(base_vocabulary()).seal()
    for flags, status in ((SECURITY, 10), (0, 1), (64, 1)):
        with pytest.raises(PackError) as err:
            document.token_documents(odd, bare, flags, "source")
        assert err.value.status == status
    back = document.read_documents(document.write_documents(odd, e, every, "source", auto=True).drop("source")).collect()
    assert [r.read_status for r in back] == [0, None, 0, 0, 0, 0, None] and bytes(back[3].source) == ODD[3][1]
    broken = document.read_documents(spark.createDataFrame([(bytearray(b"no"),)], "record binary")).first()
    assert broken.read_status == 12
    blocks = document.blocks(odd, bare, BlockPolicy(4, 8, 16, 32), ["doc_id"], "source")
    assert blocks.where("doc_id = 5").agg(F.sum("length")).first()[0] == 42
    keyed = document.with_cache_keys(blocks, 1, 2)
    assert document.distinct_blocks(keyed).where("n_blocks >= 2").count() >= 1


def test_cache_table(spark, tmp_path, odd):
    cache = document.CacheTable(spark, str(tmp_path / "cache"))
    rows = document.cache_records(odd, "source").where("cache_key is not null")
    assert cache.get(rows).where("cache_status <> 11").count() == 0
    cache.put(rows)
    cache.put(rows)
    assert cache._read().count() == 5
    got = cache.get(rows.unionByName(rows.withColumn("cache_key", F.lit(bytearray(32))).limit(1)))
    assert sorted(r.cache_status for r in got.collect()) == [0, 0, 0, 0, 0, 11]
    cache.remove(rows.limit(1))
    assert cache._read().count() == 4


def test_registry(spark):
    table = registry_table(spark)
    need = lambda *rows: spark.createDataFrame(rows, "role string, publisher string, name string, constraint string")
    for rows, status in (([("a", "acme", "model", "*")], 1), ([("a", "acme", "model", "latest")], 1), ([("a", "acme", "model", "^9.0.0")], 11), ([("a", "acme", "model", "1.2.3")] * 2, 1)):
        with pytest.raises(PackError) as err:
            registry.resolve(table, need(*rows))
        assert err.value.status == status
    asked = need(("a", "acme", "model", "^1.0.0"), ("b", "acme", "lexer", ">=0.0.3,<0.3.0"))
    lock = registry.lock(table, asked)
    assert [p["version"] for p in lock["packs"]] == ["1.9.0", "0.2.9"]
    objects = table.select("sha256", F.col("sha256").alias("content_sha256"), "size")
    assert registry.verify_lock(lock, objects) == []
    assert registry.verify_lock({**lock, "schema": 2}, objects)[:2] == ["bad schema", "lock hash mismatch"]
    assert len(registry.verify_lock(lock, objects.limit(0))) == 2
    assert registry.catalog_hash(table) == registry.catalog_hash(table.repartition(3)) != registry.catalog_hash(table.limit(5))
    changed = table.limit(1).withColumn("sha256", F.lit("0" * 64))
    with pytest.raises(PackError) as err:
        registry.install(table, changed)
    assert err.value.status == 8
    with pytest.raises(PackError):
        registry.install(table, table.limit(1).withColumn("version", F.lit("1.0")))
    assert registry.garbage(table.limit(3), objects).count() == table.count() - 3


def test_trust(spark):
    sha = hashlib.sha256(b"pack").digest()
    seeds = [bytes([k]) * 32 for k in range(3)]
    record = [registry.signature_record(s, sha) for s in seeds]
    wrong = bytearray(record[0])
    wrong[100] ^= 1
    other = registry.signature_record(seeds[0], hashlib.sha256(b"other").digest())
    rows = [(0, record[0]), (10, None), (15, record[1]), (14, record[2]), (14, bytes(wrong)), (12, other), (1, b"short"), (12, record[0][:159] + b"x")]
    table = spark.createDataFrame([(w, sha.hex(), None if s is None else bytearray(s)) for w, s in rows], "want int, sha256 string, signature binary")
    known = [(registry.key_id(ed25519.public_key(s)).hex(), bytearray(ed25519.public_key(s)), revoked) for s, revoked in ((seeds[0], False), (seeds[1], True))]
    keys = spark.createDataFrame(known, "key_id string, public_key binary, revoked boolean")
    got = registry.trust(table, keys)
    assert got.columns == ["want", "sha256", "signature", "trust_code"]
    assert sorted((r.want, r.trust_code) for r in got.collect()) == sorted((w, w) for w, _ in rows)


def test_restore_and_ceilings(spark, tmp_path):
    rows = [("a/b.txt", 3, b"abc"), ("../x", 1, b"x"), ("c", 9, b"short"), ("d", 0, b"")]
    entries = spark.createDataFrame([(p, n, zlib.crc32(c), bytearray(c)) for p, n, c in rows], "path string, size bigint, crc32 bigint, content binary")
    for _ in range(2):  # again changes nothing
        got = {r.path: (r.restored, r.problem) for r in archive.restore(entries, str(tmp_path / "out")).collect()}
        assert got == {"a/b.txt": (True, None), "../x": (False, "unsafe path"), "c": (False, "corrupt"), "d": (True, None)}
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {"a/b.txt": b"abc", "d": b""}
    docs = spark.createDataFrame([(1, "ab " * 500), (2, "ab")], "doc_id long, text string")
    policy = BlockPolicy(64, 128, 256, 512, 2, 0)
    got = {r.doc_id: r.s for r in document.blocks(docs, engine(), policy, ["doc_id"]).groupBy("doc_id").agg(F.max("status").alias("s")).collect()}
    assert got == {1: 9, 2: 0}


def test_training_on_bytes(spark):
    """Binary sources, some of whose lines aren't UTF-8, against counting in plain Python."""
    import re
    from collections import Counter

    sources = [b"some text some\nmore text \xff\xfe raw raw \xff\xfe\n", "na\u00efve na\u00efve \u4e16\u754c\u4e16\u754c\u4e16\u754c\n".encode(), b"\xffx averyveryverylongword \xe9\n\n", b"", b"a\x0bb\x1cc \xc3"]
    want = Counter()
    for line in (x for d in sources for x in re.findall(rb"[^\n]*\n|[^\n]+", d)):
        try:
            parts = [m.encode() for m in re.findall(r"[^\W]+|[^\w\s]+|\s+", line.decode())]
        except UnicodeDecodeError:
            parts = re.findall(rb"[\x09-\x0d\x20]+|[^\x09-\x0d\x20]+", line)
        for i in range(len(parts)):
            for width in (1, 2, 3):
                if i + width <= len(parts):
                    want[b"".join(parts[i : i + width])] += 1
            if len(parts[i]) > 10:
                try:
                    word = parts[i].decode()
                except UnicodeDecodeError:
                    continue
                for k in range(1, min(len(word), 10) + 1):
                    want[word[:k].encode()] += 1
                    want[word[-k:].encode()] += 1
    df = spark.createDataFrame([(bytearray(d),) for d in sources] + [(None,)], "source binary")
    got = {bytes(r.surface): r.frequency for r in training.candidates(df, "source", 10).collect()}
    assert got == {s: n for s, n in want.items() if 2 <= len(s) <= 10}
    assert training.to_vocabulary(training.train(df, "source", vocab_size=300, max_bytes=10)).max_len > 1


def test_training_and_vocabulary(spark):
    docs = spark.createDataFrame([("the cat the cat\nthe cat",), (None,), ("",), ("z" * 40,)], "text string")
    got = {r.surface: r.frequency for r in training.candidates(docs, max_bytes=8).collect()}
    assert got["the"] == 3 and got["the "] == 3 and got["the cat"] == 3 and got[" cat"] == 3 and "cat\n" in got and "cat\nthe" not in got and got["z" * 8] == 2
    pieces = training.train(docs, vocab_size=258, max_bytes=8)
    assert pieces.count() == 2 and pieces.first().surface == "the cat"
    assert 256 in {i for i, _, _ in training.to_vocabulary(pieces).rows}
    assert training.train(docs.limit(0)).count() == 0
    with pytest.raises(PackError):
        training.train(docs, vocab_size=5)


def test_sources(spark, tmp_path):
    (tmp_path / "a.pack").write_bytes(packs.write_vocabulary(base_vocabulary()))
    spark.dataSource.register(readers.PackSource)
    rows = spark.read.format("glyphline_pack").load(str(tmp_path / "a.pack")).collect()
    assert [r.kind for r in rows] == [1, 2, 4] and rows[2].magic == "MSVC"
    files = readers.read_files(spark, str(tmp_path), "*.pack")
    assert readers.inspect_packs(files).first().n_entries == 275
    readers.export_tiktoken(spark, raw_bpe_vocabulary(), str(tmp_path / "ranks"))
    assert readers.import_tiktoken(spark, str(tmp_path / "ranks")) == raw_bpe_vocabulary()
    with pytest.raises(PackError):
        packs.format_tiktoken(base_vocabulary())
    ids = spark.createDataFrame([([1, 2**32 - 1],), ([],)], "ids array<long>")
    packed = readers.pack_ids(ids)
    assert [bytes(r.packed_ids) for r in packed.collect()] == [packs.pack_u32([1, 2**32 - 1]), b""]
    assert [r.ids for r in readers.unpack_ids(packed.drop("ids")).collect()] == [[1, 2**32 - 1], []]


def test_archive(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"a")
    (tmp_path / "in" / "d" / "b.txt").write_bytes(b"bb")
    rows = archive.entries(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path / "in")), str(tmp_path / "in"))
    archive.write(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert archive.test(back).count() == 0 and tuple(archive.inspect(back).first()) == (2, 3, 2)
    assert [r.path for r in archive.remove(back, spark.createDataFrame([("d",)], "path string")).collect()] == ["a.txt"]


def test_metrics(spark, odd):
    e = engine(limits=Limits(1000, 1000, 1000))
    rows, seen = metrics.observed(tokenize.encode_ids(odd, e, "source"), "source")
    rows.write.format("noop").mode("overwrite").save()
    got = seen.get
    assert (got["operations"], got["failures"], got["limit_rejections"]) == (7, 1, 1) and got["input_bytes"] == sum(len(b or b"") for _, b in ODD)
    assert "glyphline_operations_total 7" in metrics.prometheus(got)
    assert [r.status for r in metrics.limit_status(odd, e, "source").collect()] == [0, None, 0, 0, 0, 0, 9]


def test_replayed_edits(spark):
    rows = [(1, 0, 0, 0, "hello world"), (1, 1, 5, 1, "_"), (2, 0, 0, 0, None), (1, 2, 0, 2, "tokenizer " * 50)]
    df = spark.createDataFrame(rows, "doc long, n long, at long, gone long, text string")
    out = {k: sorted(map(tuple, replay.edits(df, engine("en"), "doc", "n", "at", "gone", "text", k, 16).collect())) for k in ("plain", "incremental", "resync")}
    assert [r[:5] for r in out["plain"]] == [r[:5] for r in out["incremental"]] == [r[:5] for r in out["resync"]] and len(out["plain"]) == 4


def test_structured_streams(spark, tmp_path):
    from glyphline.streaming import processors

    source, e = "hello world. tokenizer the नमस्ते दुनिया " * 20, engine("en")
    data = source.encode()
    chunks = [("s", k, bytearray(data[a : a + 37]), a + 37 >= len(data)) for k, a in enumerate(range(0, len(data), 37))]
    order = [*chunks[1::2], *chunks[::2], *chunks[:3]]  # early ones wait, repeats are left out
    folder = tmp_path / "chunks"
    schema = "stream string, seq long, chunk binary, last boolean"
    for part in range(3):
        spark.createDataFrame(order[part::3], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    run = processors.online_tokens(stream, e).writeStream.format("memory").queryName("tokens").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    got = spark.sql("select token_no, token_id, start, length from tokens order by token_no").collect()
    ids, lengths = e.encoder().encode(data)
    assert [(r.token_id, r.length) for r in got] == list(zip(ids, lengths, strict=True)) and [r.token_no for r in got] == list(range(len(ids)))

    edits = [("d", 0, 0, 0, bytearray(data)), ("d", 1, 600, 3, bytearray(b"ing")), ("e", 0, 0, 0, None)]
    schema = "doc string, seq long, start long, delete long, insert binary"
    folder = tmp_path / "edits"
    for row in edits:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).parquet(str(folder))
    run = processors.edited_documents(stream, e).writeStream.format("memory").queryName("edited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    run.processAllAvailable()
    run.stop()
    rows = spark.sql("select * from edited where doc = 'd' order by seq").collect()
    assert [r.length for r in rows] == [len(data), len(data)] and rows[1].reused > 500


def test_sql_functions(spark):
    from glyphline.functions import sql

    sql.register(spark, engine("en", "hi"))
    spark.createDataFrame([(1, "hello tokenizer"), (2, None), (3, "")], "k int, text string").createOrReplaceTempView("texts")
    rows = spark.sql("select k, glyph_encode(text) ids, glyph_count(text) n, glyph_graphemes(text) g, glyph_normalize(text, 'NFKC_CASEFOLD') f, glyph_language(text) l from texts order by k").collect()
    assert list(rows[0].ids)[-1] == 271 and rows[0].n == len(rows[0].ids) and rows[0].g == 15 and rows[0].l == "en"
    assert tuple(rows[1]) == (2, None, None, None, None, None) and rows[2].n == 0 and rows[2].l is None
    tokens = spark.sql("select k, t.* from texts, lateral glyph_tokens(text) t order by k, start").collect()
    assert [t.start for t in tokens] == [0, 5, 6]
    back = spark.sql("select glyph_decode(glyph_encode(text)) b from texts where k = 1").first().b
    assert bytes(back) == b"hello tokenizer"


def test_command_line(tmp_path, capsys):
    from glyphline import cli

    model, source, ids = (tmp_path / n for n in ("m", "s", "i"))
    model.write_bytes(packs.write_vocabulary(base_vocabulary()))
    source.write_bytes(b"hello tokenizer \xff")
    assert cli.main(["validate", str(model)]) == 0 and cli.main(["roundtrip", str(model), str(source)]) == 0
    assert cli.main(["encode-u32", str(model), str(source), str(ids)]) == 0 and cli.main(["decode-u32", str(model), str(ids), str(tmp_path / "o")]) == 0
    assert (tmp_path / "o").read_bytes() == source.read_bytes()
    for verb in (["encode", str(model), str(source)], ["fingerprint", str(model)], ["graphemes", str(source)], ["detect", "base", str(source)], ["routes", str(source)], ["security", str(source)], ["lexer", "c", str(source)], ["normalize", "NFC", str(source), str(tmp_path / "n")], ["analyze", str(model), str(source)]):
        assert cli.main(verb) == 0
    assert cli.main(["validate", str(source)]) == 3 and capsys.readouterr()
    en, det, prof = (str(tmp_path / n) for n in ("en", "det", "prof"))
    for path, data in ((en, packs.write_language(base_language("en"))), (det, packs.write_detector(base_detector())), (prof, packs.write_lexer(LEX_PROFILES["c"]))):
        with open(path, "wb") as f:
            f.write(data)
    m, x = str(model), str(source)
    tokens = {}
    for verb in (
        ["analyze-languages", m, x, en], ["analyze-auto", m, det, x, en], ["analyze-span-auto", m, det, x, en], ["analyze-security", m, x], ["analyze-lexer", m, prof, x], ["analyze-normalization", m, "NFC", x],
        ["roundtrip-auto", m, det, x, en], ["roundtrip-languages", m, x, en], ["fingerprint-auto", m, det, en], ["fingerprint-security", m], ["fingerprint-lexer", m, prof], ["fingerprint-languages", m, en], ["fingerprint-normalization", m], ["normalize-map", "NFD", x], ["detect", det, x], ["lexer", prof, x],
    ):
        assert cli.main(verb) == 0, verb
        tokens[verb[0]] = capsys.readouterr().out.split("\n")
    assert tokens["analyze-languages"][:3] == ["256 0 5 120", "262 5 1 40", "271 6 9 150"]
    assert len({v[0] for k, v in tokens.items() if k.startswith("fingerprint")}) == 5
    assert cli.main(["normalize-map", "NFX", x]) == 1


def test_empty_tables(spark):
    none, e = spark.createDataFrame([], "doc_id long, text string"), engine("en")
    for df in (tokenize.token_counts(none, e), tokenize.detect(none, e), tokenize.route_totals(none, e), unicode.script_totals(none), lex.lex_totals(none, LEX_PROFILES["c"]), document.token_documents(none, e, MODEL), replay.online(none, e, "doc_id", "doc_id"), document.pack(none, e)):
        assert df.count() == 0
    assert kernel.tables_version()


@pytest.mark.parametrize("module", ["queries", "state_queries", "table_queries"])
def test_a_worker_may_import_any_query_module_first(module):
    """Functions of kernels are unpickled by the name of their module, in a process that has imported nothing."""
    root = Path(__file__).parent.parent
    code = f"import glyphline.{module}; from glyphline import queries; print(len(queries.QUERIES))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 80


def test_records_of_a_batch_are_those_of_each_source(spark):
    """They are made from whole columns in small batches; lists of Python tuples for each character took an executor's memory."""
    e, every = engine("en", "hi"), MODEL | GRAPHEMES | SECURITY | NORMALIZATION | LEXICAL | SEMANTIC
    sources = [b"let x_1 = 0x1F.5e+3; // caf\xc3\xa9", b"", b"\xff\xfe a\xe2\x80", "éq̣̇ ‮한글 हिन्दी x".encode(), b"'open", b"y" * 3000]
    for flags, auto in ((every, True), (every, False), (SEMANTIC, False), (MODEL | NORMALIZATION, False)):
        build = document._Builder(e, flags, "NFC", auto)
        want = [records.write_document(build(d)) for d in sources]
        made = document._written(e, flags, "NFC", auto)
        assert [r for _, r in made.many(sources)] == want
        assert [document._read(1 << 30)(r)[1] for r in want] == sources
        assert made.most * 150 <= 16 << 20
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(256 << 20))
    document.read_documents(document.write_documents(spark.createDataFrame([("a",)], "text string"), e, every))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_words_seen_in_other_batches_cost_nothing():
    """Parts of words are turned into arrays once, not once for each batch."""
    p = LEX_PROFILES["python"]
    columns.lexed(p, [b" ".join(b"w%d_x" % i for i in range(3000))], True)
    columns.lexed(p, [b"some new_word"], True)
    assert not columns._words(p).parts
    found, counts, parts, n_parts = columns.lexed(p, [b"w7_x 3.5", b"", b"aB 'c'"], True)
    want = [lexer.components(p, d, lexer.lex(p, d)) for d in (b"w7_x 3.5", b"", b"aB 'c'")]
    assert list(zip(*(c.tolist() for c in parts), strict=True)) == [x for w in want for x in w] and n_parts.tolist() == [len(w) for w in want]
