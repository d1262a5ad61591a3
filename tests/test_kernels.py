"""Kernels against independent oracles: small, without Spark."""

import hashlib
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphline.config import Engine, Limits, status_text
from glyphline import oracles
from glyphline.kernels import columns, lexer, records, text
from glyphline.kernels.encode import Encoder, path_key, run_dfa
from glyphline.kernels.stream import IncrementalDocument, LimitError, OnlineStream, ResyncDocument
from glyphline.kernels.vocab import BPE, LEX_PROFILES, Language, PackError, Vocabulary, base_detector, base_language, base_vocabulary, build_vocabulary, raw_bpe_vocabulary
from glyphline.queries import PATHS
from glyphline.sources import packs

BASE = Encoder(base_vocabulary())
PIECES = [b"tokenizer", b"hello world", b" world", b"h", b"e", b"the", b"ing", b"er", " दुनिया".encode(), b"\xff", b"::->_id", "世界".encode()]


def all_paths(encoder, data):
    """Every tokenization, by trying them all: (cost, count, (-length, id) of each token)."""
    if not data:
        return [((), ())]
    out = []
    for size in range(1, min(encoder.max_len, len(data)) + 1):
        for cost, i in encoder.entries.get(data[:size], ()):
            out += [(((cost, -size, i), *rest), None) for rest, _ in all_paths(encoder, data[size:])]
    return out


def best_path(encoder, data):
    paths = [p for p, _ in all_paths(encoder, data)]
    return min(paths, key=lambda p: (sum(t[0] for t in p), len(p), [t[1:] for t in p]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=4), st.integers(-5, 12)), max_size=8), st.text("abc", max_size=9))
def test_shortest_path_and_segments(pieces, source):
    seen = {p.encode(): c for p, c in pieces if len(p) > 1}
    v = build_vocabulary([{"surface": s, "cost": c, "id": None} for s, c in seen.items()], 6)
    e, data = Encoder(v), source.encode()
    want = best_path(e, data)
    ids, lengths = e.encode(data)
    assert ids == [t[2] for t in want] and lengths == [-t[1] for t in want]
    assert e.decode(ids) == data
    stream = OnlineStream(e, 8)
    got = [t for k in range(0, len(data), 2) for t in stream.push(data[k : k + 2])] + stream.finish()
    assert got == list(zip(ids, lengths, strict=True))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=2, max_size=5), max_size=10), st.text("abcd", max_size=40))
def test_merges(pieces, source):
    ranks = {s.encode(): 256 + k for k, s in enumerate(sorted(pieces, key=lambda s: (len(s), s)))}
    v = Vocabulary(tuple((b, b, bytes([b])) for b in range(256)) + tuple((r, r, s) for s, r in ranks.items()), BPE)
    parts = [bytes([b]) for b in source.encode()]
    while True:
        pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            break
        k = min(pairs)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    assert Encoder(v).encode(source.encode())[0] == [ranks.get(p, p[0]) for p in parts]


def test_goldens():
    with_tags = lambda *tags: Encoder(base_vocabulary(), {s: d for t in tags for s, d in base_language(t).deltas})
    assert BASE.encode(b"tokenizer")[0] == [263, 264] and with_tags("en").encode(b"tokenizer")[0] == [271]
    hi, ja = "नमस्ते दुनिया".encode(), "こんにちは世界".encode()
    assert BASE.encode(hi)[0] == [265, 272] and with_tags("hi").encode(hi)[0] == [273]
    assert BASE.encode(ja)[0] == [267, 266] and with_tags("ja").encode(ja)[0] == [274]
    bpe = Encoder(raw_bpe_vocabulary())
    assert [bpe.encode(x)[0] for x in (b"abc", b"bc", b"abcbc")] == [[258], [257], [258, 257]]
    assert hashlib.sha256(packs.write_vocabulary(base_vocabulary())).hexdigest().startswith("5295e581cb87faa4")
    lesser = {n: "left" if path_key(a) < path_key(b) else "right" for n, a, b in PATHS}
    assert list(lesser.values()) == ["left", "left", "right", "right"]
    assert status_text(9) == "resource limit"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PIECES, b"q", b"\0", b"thethethethe"]), max_size=12), max_size=6))
def test_many_sources_at_once(sources):
    sources = [b"".join(s) for s in sources]
    for e in (BASE, Encoder(raw_bpe_vocabulary())):
        ids, lengths, at = e.encode_many(sources)
        assert [(ids[a:b].tolist(), lengths[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)] == [e.encode(s) for s in sources]


def test_beam_and_automaton():
    rng = random.Random(0)
    for _ in range(60):
        data = b"".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))
        ids, sizes = BASE.beam(data)
        assert sum(sizes) == len(data) and BASE.decode(ids) == data and BASE.cost(ids) == BASE.cost(BASE.encode(data)[0])
    steps = {(0, 97): (1, 5), (1, 98): (0, 7)}
    assert run_dfa(steps, {0: (3, 1)}, 0, b"abab") == (3, 25) and run_dfa(steps, {0: (3, 1)}, 0, b"aba") is None and run_dfa(steps, {0: (3, 1)}, 0, b"x") is None


def test_detector():
    d = base_detector()
    assert d.detect(b"hello tokenizer")[::3] == (True, "en") and d.detect(b"xyz") == (False, 0, 0, None) and not d.detect(b"")[0]
    mix = "hello tokenizer world नमस्ते दुनिया こんにちは 世界".encode()
    assert d.detect(mix)[1] == 250
    assert not d.detect("hello tokenizer नमस्ते दुनिया".encode())[0]  # 200 each: no margin
    assert packs.read_detector(packs.write_detector(d)).scores(mix) == d.scores(mix)


def test_streams_and_edits():
    rng = random.Random(1)
    for _ in range(120):
        data = b"".join(rng.choice(PIECES) for _ in range(rng.randrange(40)))
        stream, got, at = OnlineStream(BASE, 64), [], 0
        while at < len(data):
            n = rng.randrange(1, 20)
            got += stream.push(data[at : at + n])
            at += n
        got += stream.finish()
        assert list(zip(*BASE.encode(data), strict=True)) == got
        inc, res = IncrementalDocument(BASE, data), ResyncDocument(BASE, data, checkpoint=rng.choice([1, 7, 33]), max_pending=64)
        for _ in range(5):
            a = rng.randrange(len(inc.data) + 1)
            edit = (a, rng.randrange(0, min(9, len(inc.data) - a) + 1), b"".join(rng.choice(PIECES) for _ in range(rng.randrange(3))))
            inc.edit(*edit)
            res.edit(*edit)
            want = BASE.encode(inc.data)
            assert (inc.ids, inc.lengths) == want == res.encode() and inc.data == res.data
            assert inc.reprocessed + inc.reused == len(inc.data)
            assert res.reused_prefix + res.reused_suffix <= len(res.data)
    long = ResyncDocument(BASE, b"hello world. " * 3000, checkpoint=512)
    long.edit(20000, 3, b"tokenizer")
    assert long.resynchronized and long.reprocessed < 2000 and long.encode() == BASE.encode(long.data)
    with pytest.raises(PackError):
        OnlineStream(Encoder(raw_bpe_vocabulary()))
    with pytest.raises(ValueError):
        inc.edit(10**6, 0, b"")
    ties = Encoder(build_vocabulary([{"surface": b"a" * k, "cost": k, "id": None} for k in range(2, 6)], 1))
    with pytest.raises(LimitError) as e:
        OnlineStream(ties, 5).push(b"a" * 50)
    assert e.value.status == 9 and e.value.accepted >= 5


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aéßẠ̧̊́각가각ﬁ①ſẛ̈́‍क्ष🙂ΐ"), max_size=10))
def test_normalization(source):
    for mode in ("NFD", "NFC", "NFKD", "NFKC"):
        out, units = text.normalize_view(source.encode(), mode)
        assert out.decode() == unicodedata.normalize(mode, source) and text.normalize(source.encode(), mode) == out
        assert [u[0] for u in units] == [sum(v[1] for v in units[:k]) for k in range(len(units))]
    out, _ = text.normalize_view(source.encode(), "NFKC_CASEFOLD")
    assert text.normalize(source.encode(), "NFKC_CASEFOLD") == out


def test_unicode_of_any_bytes():
    data = b"A\xffe\xcc\x81" + bytes.fromhex("D096E280AEE2808B") + b"\xed\xa0\x80\r\n"
    out, units = text.normalize_view(data, "NFC")
    assert out.startswith(b"A\xff\xc3\xa9") and units[2] == (2, 2, [(2, 3)]) and text.normalize(data, "NFC") == out
    assert text.normalize_view(data, "PRESERVE")[0] == data
    spans = text.graphemes(data)
    assert records.partitions(spans, len(data)) and (2, 3) in spans and spans[-1] == (len(data) - 2, 2) and (13, 1) in spans
    scripts, flags = text.script_table(), text.flag_table()
    assert records.partitions([s[:2] for s in text.script_spans(data, scripts)], len(data))
    kinds = [k for k, *_ in text.findings(data, scripts, flags)]
    assert {text.BIDI, text.IGNORABLE, text.MIXED} <= set(kinds)
    assert records.partitions([r[1:] for r in text.routes(data)], len(data)) and text.routes("ab नम世!é".encode())[0] == (1, 0, 2)
    assert [r[0] for r in text.routes("ab नम世!é".encode())] == [1, 0, 2, 3, 0, 4]
    assert text.graphemes(b"") == text.routes(b"") == text.script_spans(b"", scripts) == []


def test_lexing_and_parts():
    rust, python, json_, c = (LEX_PROFILES[k] for k in ("rust", "python", "json", "c"))
    for p in (rust, python, json_, c):
        for data in (b"", b"\xff\x00 \r\n x", b"/* a /* b */ c */ d", b'"""a"b""" \'x\\\'y\' # z', b'"open \\', b"0x1f+12.5e-2 1'000 a$b"):
            assert records.partitions([t[1:] for t in lexer.lex(p, data)], len(data))
    assert [k for k, *_ in lexer.lex(rust, b"/* a /* b */ c */x")] == [lexer.COMMENT, lexer.IDENTIFIER]
    assert [k for k, *_ in lexer.lex(c, b"/* a /* b */ c")][0] == lexer.COMMENT and lexer.lex(rust, b"/* a /* b */ c")[0][0] == lexer.ERROR
    assert lexer.lex(json_, b'"open \\')[0] == (lexer.ERROR, 0, 7)
    assert lexer.lex(python, b'"""a"b""" if')[0] == (lexer.STRING, 0, 9) and lexer.lex(python, b"if")[0][0] == lexer.KEYWORD
    assert lexer.lex(c, b"12.5e-2+1")[0] == (lexer.NUMBER, 0, 7)
    word = b"deserializeHTTP2Response"
    assert [word[a : a + n] for a, n in lexer.identifier_parts(word)] == [b"deserialize", b"HTTP", b"2", b"Response"]
    parts = lambda w: [(k, w[a : a + n]) for k, a, n in lexer.number_parts(w)]
    assert parts(b"0x1e5") == [(3, b"0x"), (4, b"1"), (6, b"e"), (8, b"5")]
    assert parts(b"-12.5e+2") == [(2, b"-"), (4, b"12"), (5, b"5"), (6, b"e"), (7, b"+"), (8, b"2")]
    assert lexer.string_parts(python, b'"""a"""') == [(9, 0, 3), (9, 4, 3), (10, 3, 1)]


def test_records():
    own = bytes(range(32))
    for data in (b"", b"hello world", "नमस्ते".encode() + b"\xff" * 9):
        ids, lengths = BASE.encode(data)
        packed = records.pack_tokens(ids, lengths, hashlib.sha256(data).digest(), own)
        assert records.unpack_tokens(packed)[:2] == (ids, lengths)
        for k in range(0, len(packed), 7):
            bad = bytearray(packed)
            bad[k] ^= 1
            with pytest.raises(records.RecordError):
                records.unpack_tokens(bytes(bad))
        record = records.write_cache_record(own, data)
        assert records.read_cache_record(record, own) == data
        with pytest.raises(records.RecordError):
            records.read_cache_record(record[:-1] if data else record + b"x", own)
        with pytest.raises(records.RecordError):
            records.read_cache_record(record, bytes(32))
    with pytest.raises(records.RecordError):
        records.read_uleb(b"\x80\x00", 1)
    blocks, macros = records.block_plan([3] * 100, records.BlockPolicy(10, 20, 30, 60))
    assert blocks[0] == (0, 7, 0, 21, False) and sum(b[3] for b in blocks) == 300 and sum(m[1] for m in macros) == len(blocks)
    assert records.block_plan([50], records.BlockPolicy(10, 20, 30, 60))[0] == [(0, 1, 0, 50, True)]
    cache = records.LruCache(2, 100, 60)
    a, b, c = (bytes([k]) * 32 for k in range(3))
    assert cache.put(a, b"1") and cache.put(b, b"2") and cache.get(a) == b"1" and cache.put(c, b"3")
    assert cache.get(b) is None and len(cache) == 2 and not cache.put(a, b"x" * 61) and cache.stats["evictions"] == 1
    versions = [1, 1, 1, 1, 1, 1, 0]
    assert records.manifest_identity(b"d", versions, own, [(1, 0, own), (7, 0, own)]) != records.manifest_identity(b"e", versions, own, [(1, 0, own), (7, 0, own)])
    with pytest.raises(records.RecordError):
        records.manifest_identity(b"d", versions, own, [(7, 0, own), (1, 0, own)])


def test_packs():
    v = base_vocabulary()
    data = packs.write_vocabulary(v)
    assert packs.read_vocabulary(data) == v
    for k in range(0, len(data), 97):
        bad = bytearray(data)
        bad[k] ^= 0x41
        with pytest.raises(PackError):
            packs.read_vocabulary(bytes(bad))
    for bad in (b"", data[:-1], data + b"\0"):
        with pytest.raises(PackError):
            packs.scan(bad)
    en = base_language("en")
    assert packs.read_language(packs.write_language(en)).deltas == tuple(sorted(en.deltas))[::1] or dict(packs.read_language(packs.write_language(en)).deltas) == dict(en.deltas)
    assert packs.read_lexer(packs.write_lexer(LEX_PROFILES["rust"])) == LEX_PROFILES["rust"]
    assert packs.parse_tiktoken(packs.format_tiktoken(raw_bpe_vocabulary())) == raw_bpe_vocabulary()
    assert packs.unpack_u32(packs.pack_u32([0, 7, 2**32 - 1])) == [0, 7, 2**32 - 1]
    made = packs.from_json("model", '{"byte_cost": 50, "pieces": [{"text": "ab"}, {"hex": "6162ff", "cost": 3, "id": 300}]}')
    assert {r for r in made.rows if r[0] > 255} == {(256, 49, b"ab"), (300, 3, b"ab\xff")}
    with pytest.raises(PackError):
        packs.from_json("model", '{"pieces": [{"text": "a", "hex": "61"}]}')
    assert packs.from_json("detector", '{"profiles": {"en": {"features": [{"text": "a", "weight": 3}]}}}').scores(b"aaa") == [9]


def test_engine_states():
    e = Engine(base_vocabulary()).with_language(base_language("en")).with_detector(base_detector())
    for change, status in ((lambda: e.with_language(base_language("en")), 8), (lambda: e.with_detector(base_detector()), 8), (lambda: e.seal().with_security(), 13), (lambda: e.seal().with_detector(base_detector()), 13), (lambda: Limits(0), 1)):
        with pytest.raises(PackError) as err:
            change()
        assert err.value.status == status
    two = e.with_language(base_language("hi"))
    assert two.fingerprint() == Engine(base_vocabulary()).with_language(base_language("hi")).with_detector(base_detector()).with_language(base_language("en")).fingerprint() != e.fingerprint()
    assert e.runtime_identity() != e.with_limits(Limits(5)).runtime_identity() and e.capabilities()["detector"] and not e.capabilities()["security"]
    both = Engine(base_vocabulary()).with_language(Language("x", ((b"er", -5),))).with_language(Language("y", ((b"er", -6),)))
    assert both.deltas() == {b"er": -11} and both.deltas(["y"]) == {b"er": -6}


def test_document_record():
    from glyphline.operators.document import _Builder

    e = Engine(base_vocabulary()).with_detector(base_detector()).with_security().with_normalization().with_lexer(LEX_PROFILES["c"])
    build = _Builder(e, 63, "NFC", True)
    for data in (b"", b"int x = 0x1f; // hello\n", "Жa‮ é".encode() + b"\xff"):
        record = records.write_document(build(data))
        doc = records.read_document(record)
        assert doc["source"] == data and len(doc["tokens"]) == len(build(data)["tokens"]) and doc["units"] == build(data)["units"]
        for k in range(0, len(record), 31):
            bad = bytearray(record)
            bad[k] ^= 1
            with pytest.raises(records.RecordError):
                records.read_document(bytes(bad))
        with pytest.raises(records.RecordError):
            records.read_document(record, 10)


def test_columns_of_many_sources():
    rng = random.Random(4)
    bits = ["a", "b ", " ", "\n", "\r\n", "\r", "e\u0301", "\u00e9", "a\u0301\u0323", "\u4e2d", "\u1112\u1161\u11ab", "\ud55c", "\U0001f468\u200d\U0001f469", "\U0001f1e9\U0001f1ea", "\u202e", "\u200b"]
    bits += ["\u0915\u094d\u0937", "\u0928\u093f", "\u0600", "\u0301", "\u0416", *oracles.PLANTED, "0x1f ", "aB1 ", '"x" ', "// c\n", "/* "]
    sources = [b""]
    for _ in range(600):
        data = "".join(rng.choice(bits) for _ in range(rng.randrange(12))).encode()
        if rng.random() < 0.3:
            at = rng.randrange(len(data) + 1)
            data = data[:at] + bytes([rng.randrange(256)]) + data[at:]
        sources.append(data)

    def each(counts, *fields):
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends, strict=True):
            yield list(zip(*(f[a:b].tolist() for f in fields), strict=True))

    b = columns.Batch(sources)
    first = columns.clusters(b)
    got = each(b.per_source(first), b.local(first), np.diff(np.append(b.starts[first], b.bounds[-1])))
    assert list(got) == [text.graphemes(d) for d in sources]
    found, n = columns.findings(b, text.script_table(), text.flag_table())
    assert list(each(n, *found)) == [text.findings(d, text.script_table(), text.flag_table()) for d in sources]
    for mode in text.MODES:
        views, n, units, n_spans, spans = columns.views(b, mode)
        whole = list(each(n_spans, *spans))
        ends = np.cumsum(n)
        for d, view, a, z, some in zip(sources, views, ends - n, ends, each(n, *units), strict=True):
            assert (view, [(*u, s) for u, s in zip(some, whole[a:z], strict=True)]) == text.normalize_view(d, mode)
    for p in LEX_PROFILES.values():
        tokens, n, parts, m = columns.lexed(p, sources, True)
        want = [lexer.lex(p, d) for d in sources]
        assert list(each(n, *tokens)) == want
        assert list(each(m, *parts)) == [lexer.components(p, d, t) for d, t in zip(sources, want, strict=True)]


def test_beam_by_segments():
    rng = random.Random(9)
    v = base_vocabulary()
    encoder = Encoder(v)
    for _ in range(200):
        data = "".join(rng.choice(["hello", " world", "the", "ing", "er", " ", "token", "izer", "x", "::", "世界"]) for _ in range(rng.randrange(9))).encode()
        for width in (1, 3, 16):
            assert encoder.beam_segments(data, width) == encoder.beam(data, width)[0]
