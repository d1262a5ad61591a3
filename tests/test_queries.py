"""Every registered query against its SQL, and the queries without SQL against brute force."""

import hashlib

import pytest

from glyphline import queries as q
from glyphline.kernels import lexer, text
from glyphline.kernels.encode import Encoder
from glyphline.kernels.vocab import LEX_PROFILES, base_detector, base_language, base_vocabulary, raw_bpe_vocabulary
from tests.conftest import compare_with_duckdb

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, name):
    got, want = compare_with_duckdb(spark, name)
    assert got == want


def _texts(spark, name="documents", *keys):
    """Keys and texts that the queries see: whole tables with what is planted behind each text."""
    rows = q.planted_docs(spark, FOLDER) if name == "documents" else q.planted_turns(spark, FOLDER)
    return [tuple(r) for r in rows.select(*(keys or ("doc_id",)), "text").collect()]


def test_counts_of_tokens(spark):
    for name, v in (("r18_viterbi_counts", base_vocabulary()), ("r22_bpe_counts", raw_bpe_vocabulary())):
        encoder, total = Encoder(v), {}
        for _, t in _texts(spark):
            data = t.encode()
            ids, _ = encoder._solve(data) if len(data) < 3000 else encoder.encode(data)  # whole texts, without segments
            for i in ids:
                total[i] = total.get(i, 0) + 1
        assert dict(map(tuple, getattr(q, name)(spark, FOLDER).collect())) == total


def test_tokens_of_documents(spark):
    encoder = Encoder(base_vocabulary(), dict(base_language("en").deltas))
    want = {}
    for i, t in _texts(spark):
        ids, lengths = encoder.encode(t.encode())
        want[i] = (0, len(ids), sum(lengths), encoder.cost(ids))
    assert {r[0]: tuple(r[1:]) for r in q.r19_viterbi_tokens(spark, FOLDER).collect()} == want
    flagship = q.r18_tokens_by_language(spark, FOLDER).collect()
    every = Encoder(base_vocabulary(), {s: d for tag in ("en", "hi", "ja") for s, d in base_language(tag).deltas})
    assert sum(r.n_tokens for r in flagship) == sum(len(every.encode(t.encode())[0]) for _, t in _texts(spark)) and not any(r.n_inexact for r in flagship)
    assert all(r.beam_cost == r.least_cost for r in q.r20_beam(spark, FOLDER).collect())


def test_routed_encoding(spark):
    a = {(r.conv_id, r.turn): r.n_tokens for r in q.r34_encode_auto(spark, FOLDER).collect()}
    assert a == {(r.conv_id, r.turn): r.n_tokens for r in q.r35_tokens_auto(spark, FOLDER).collect()}
    found = base_detector()
    encoders = {tag: Encoder(base_vocabulary(), dict(base_language(tag).deltas) if tag else {}) for tag in (None, "en", "hi", "ja")}
    spans = {(r.conv_id, r.turn): r.n_tokens for r in q.r36_encode_span_auto(spark, FOLDER).collect()}
    for c, t, source in _texts(spark, "conversations", "conv_id", "turn"):
        data = source.encode()
        parts = [(kind, data[s : s + n]) for kind, s, n in text.routes(data)]
        assert spans[c, t] == sum(len(encoders[found.detect(x)[3] if kind else None].encode(x)[0]) for kind, x in parts)


def test_unicode_and_lexing(spark):
    want = {}
    for _, t in _texts(spark):
        for k, _, n in lexer.lex(LEX_PROFILES["rust"], t.encode()):
            c = want.setdefault(k, [0, 0])
            c[0] += 1
            c[1] += n
    assert {r.kind: [r.n_tokens, r.n_bytes] for r in q.r49_lex_documents(spark, FOLDER).collect()} == want
    folded = {r.doc_id: r.normalized_sha256 for r in q.r44_normalize_casefold(spark, FOLDER).collect()}
    for i, t in _texts(spark):
        assert folded[i] == hashlib.sha256(text.normalize_view(t.encode(), "NFKC_CASEFOLD")[0]).hexdigest()


def test_documents_and_blocks(spark):
    sizes = {i: len(t.encode()) for i, t in _texts(spark)}
    for r in q.r56_token_documents(spark, FOLDER).collect():
        assert r.status == 0 and r.n_bytes == sizes[r.doc_id] and r.n_tokens > 0 and r.n_graphemes <= r.n_bytes
    for r in q.r59_block_plan(spark, FOLDER).collect():
        assert r.n_bytes == sizes[r.doc_id] and r.largest <= 1024 and 1 <= r.n_macroblocks <= r.n_blocks
    keys = q.r61_block_cache_keys(spark, FOLDER).collect()
    assert any(r.n_blocks > 1 for r in keys)
    for r in q.r58_projections(spark, FOLDER).collect():
        assert r.n_bytes >= 2 * r.n
    got = {r.conv_id: r.n_bytes for r in q.r70_online_tokens(spark, FOLDER).collect()}
    total = {}
    for c, _, t in _texts(spark, "conversations", "conv_id", "turn"):
        total[c] = total.get(c, 0) + len((t or "").encode())
    assert got == {c: n for c, n in total.items() if n}
    assert all(r.reprocessed + r.reused_prefix + r.reused_suffix >= r.length for r in q.r73_resync_savings(spark, FOLDER).collect())
    assert all(r.smaller for r in q.r13_codec_sizes(spark, FOLDER).collect())
