"""Queries over the tables of a folder, by operator, and the SQL that says what they return."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, oracles
from .config import Engine, Limits
from .functions import native
from .kernels.records import GRAPHEMES, LEXICAL, MODEL, NORMALIZATION, SECURITY, SEMANTIC, BlockPolicy
from .kernels.vocab import LEX_PROFILES, base_detector, base_language, base_vocabulary, raw_bpe_vocabulary
from .operators import archive, document, lex, metrics, registry, tokenize, training, unicode
from .plans.kernel import folded_kernel, spread
from .sources import readers
from .streaming import replay

ALL = MODEL | GRAPHEMES | SECURITY | NORMALIZATION | LEXICAL | SEMANTIC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def planted(spark: SparkSession, sf_dir: str, name: str, number: str, *columns: str, column: str = "text") -> DataFrame:
    """columns and text of a whole table, each text with something behind it that operators find."""
    more = F.element_at(F.array(*[F.lit(p) for p in oracles.PLANTED]), (F.expr(number) % 8 + 1).cast("int"))
    return table(spark, sf_dir, name).select(*columns, F.concat(F.coalesce(column, F.lit("")), more).alias("text"))


def planted_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir, "documents", "doc_id", "doc_id", "lang")


def planted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted(spark, sf_dir, "conversations", "conv_id + turn", "conv_id", "turn")


POLICY = BlockPolicy(64, 256, 1024, 4096)
_DOCS = oracles.planted_sql("documents", "doc_id", "doc_id, lang")
_TURNS = oracles.planted_sql("conversations", "conv_id + turn", "conv_id, turn")


def engine(*tags: str, **more) -> Engine:
    """The built-in engine with some languages, detector, Unicode tables and lexer, sealed."""
    out = Engine(base_vocabulary())
    for tag in tags:
        out = out.with_language(base_language(tag))
    out = out.with_detector(base_detector()).with_security().with_normalization().with_lexer(LEX_PROFILES[more.get("lexer", "c")])
    return out.with_limits(more.get("limits", Limits())).seal()


def _folder(spark, name: str) -> str:
    """A new folder in the one that the cluster shares; in local mode a temporary one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    return f"{(shared or tempfile.mkdtemp(prefix='glyphline-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# --- encoding -----------------------------------------------------------------------------------


@query(oracles.tokens_sql(_DOCS, "doc_id", """,
m AS (SELECT doc_id, sum(n * len(ids)) AS m FROM segs JOIN solved USING (seg) GROUP BY doc_id)
SELECT lang, count(*) AS n_docs, sum(octet_length(encode(text)))::BIGINT AS n_bytes, sum(coalesce(m, 0))::BIGINT AS n_tokens, 0::BIGINT AS n_inexact
FROM src LEFT JOIN m USING (doc_id) GROUP BY lang""", "en,hi,ja"))
def r18_tokens_by_language(spark, sf_dir):
    """Tokens and bytes of documents by language: the flagship."""
    got = tokenize.round_trip(planted_docs(spark, sf_dir), engine("en", "hi", "ja"))
    got = got.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.octet_length("text").cast("bigint")).alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.sum((~F.col("exact")).cast("int")).alias("n_inexact"))
    return got


@query("SELECT doc_id, octet_length(encode(text)) AS n_bytes, sha256(text) AS sha256 FROM documents")
def r01_source_info(spark, sf_dir):
    return readers.source_info(documents(spark, sf_dir), ["doc_id"])


def _histogram():
    import numpy as np

    def fn(sources):
        counts = np.bincount(np.frombuffer(b"".join(sources), np.uint8), minlength=256)
        return [(int(b), int(counts[b])) for b in np.flatnonzero(counts)]

    return fn


@query("""
SELECT (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1 AS byte, count(*) AS n
FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY ALL""")
def r14_byte_projection(spark, sf_dir):
    """How often each byte (as token id) occurs."""
    part = folded_kernel(documents(spark, sf_dir), "text", "byte bigint, k bigint", _histogram)
    return part.groupBy("byte").agg(F.sum("k").alias("n"))


@query("SELECT item_id, (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1 AS token_id, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM benchmark) GROUP BY ALL")
def r14_byte_ids(spark, sf_dir):
    """The native form, a row for each byte of the benchmark's texts."""
    ids = table(spark, sf_dir, "benchmark").select("item_id", F.explode(native.byte_ids(F.encode("text", "UTF-8"))).alias("b"))
    return ids.groupBy("item_id", F.col("b").cast("bigint").alias("token_id")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, octet_length(encode(text)) AS n_leaves, octet_length(encode(text)) - 1 AS last_start FROM documents")
def r15_leaves(spark, sf_dir):
    at = native.leaves(F.encode("text", "UTF-8"))
    return documents(spark, sf_dir).select("doc_id", F.size(at).cast("bigint").alias("n_leaves"), F.element_at(at, -1).cast("bigint").alias("last_start"))


@query("""
SELECT doc_id, CASE WHEN n // 3 + 16 <= n THEN 0 ELSE 5 END AS status,
  CASE WHEN n // 3 + 16 <= n THEN substr(h, 2 * (n // 3) + 1, 32) END AS part
FROM (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents)""")
def r16_range_read(spark, sf_dir):
    data = F.encode("text", "UTF-8")
    got = native.read_range(data, F.floor(F.octet_length(data) / 3), F.lit(16))
    return documents(spark, sf_dir).select("doc_id", got["status"].alias("status"), F.hex(got["bytes"]).alias("part"))


_SURFACES = [(i, s) for i, _, s in base_vocabulary().rows if len(s) > 1]


def _lattice_sql() -> str:
    rows = ", ".join(f"({i}, '{s.decode()}')" for i, s in _SURFACES if s != b"::")
    return f"""
WITH b AS (
  SELECT (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1 AS byte, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY ALL),
s(token_id, surface) AS (VALUES {rows}),
m AS (
  SELECT token_id, sum((length(text) - length(replace(text, surface, ''))) // length(surface))::BIGINT AS n_edges
  FROM documents, s GROUP BY token_id),
c AS (SELECT 268 AS token_id, sum(list_sum(list_transform(regexp_extract_all(text, '::+'), lambda r: length(r) - 1)))::BIGINT AS n_edges FROM documents)
SELECT byte AS token_id, n AS n_edges FROM b UNION ALL SELECT 262, n FROM b WHERE byte = 32
UNION ALL SELECT token_id, n_edges FROM m WHERE n_edges > 0 UNION ALL SELECT * FROM c WHERE n_edges > 0"""


@query(_lattice_sql())
def r17_lattice(spark, sf_dir):
    """At how many places each surface stands, overlapping ones too."""
    return tokenize.lattice_counts(documents(spark, sf_dir), engine())


_COUNTED = "SELECT token_id, sum(n)::BIGINT AS n_tokens FROM (SELECT n, unnest(ids) AS token_id FROM segs JOIN solved USING (seg)) GROUP BY token_id"


@query(oracles.tokens_sql(_DOCS, "doc_id", _COUNTED))
def r18_viterbi_counts(spark, sf_dir):
    return tokenize.token_counts(planted_docs(spark, sf_dir), engine())


@query(oracles.tokens_sql(_DOCS, "doc_id", """,
m AS (SELECT doc_id, sum(n * len(ids)) AS m, sum(n * cost) AS c FROM segs JOIN solved USING (seg) GROUP BY doc_id)
SELECT doc_id, 0 AS status, coalesce(m, 0)::INT AS n_tokens, octet_length(encode(text))::BIGINT AS n_bytes, coalesce(c, 0)::BIGINT AS cost FROM src LEFT JOIN m USING (doc_id)""", "en"))
def r19_viterbi_tokens(spark, sf_dir):
    """Number, bytes and base cost of each document's tokens."""
    got = tokenize.encode_tokens(planted_docs(spark, sf_dir), engine("en"))
    cost = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t["cost"])
    size = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t["length"])
    return got.select("doc_id", "status", F.size("tokens").alias("n_tokens"), size.alias("n_bytes"), cost.alias("cost"))


@query(oracles.beam_sql(_DOCS, "doc_id"))
def r20_beam(spark, sf_dir):
    got = tokenize.encode_beam(planted_docs(spark, sf_dir), engine())
    return got.select("doc_id", "beam_cost", "least_cost", F.size("beam_ids").alias("n_tokens"))


#: (name, left, right) paths of edges (start, end, namespace, kind, id, cost); fixed values.
PATHS = [
    ("lower-cost-wins", [(0, 1, 7, 3, 1, 1)], [(0, 1, 7, 3, 2, 2)]),
    ("fewer-tokens-win-after-cost-tie", [(0, 3, 7, 3, 1, 2)], [(0, 1, 7, 3, 2, 1), (1, 3, 7, 3, 3, 1)]),
    ("longer-first-span-wins", [(0, 1, 7, 3, 1, 1), (1, 3, 7, 3, 2, 1)], [(0, 2, 7, 3, 3, 1), (2, 3, 7, 3, 4, 1)]),
    ("smaller-token-id-wins", [(0, 2, 7, 3, 8, 1), (2, 4, 7, 3, 9, 1)], [(0, 2, 7, 3, 7, 1), (2, 4, 7, 3, 10, 1)]),
]


@query(f"WITH RECURSIVE {oracles.segments_sql(_DOCS, 'doc_id', oracles.BPE_PIECES)}, {oracles.bpe_sql()} {_COUNTED}")
def r22_bpe_counts(spark, sf_dir):
    return tokenize.token_counts(planted_docs(spark, sf_dir), Engine(raw_bpe_vocabulary()).seal())


@query("""
WITH p AS (SELECT DISTINCT substr(hex(encode(surface)), 2 * k + 1, 4) AS pair
  FROM (SELECT surface, unnest(range(octet_length(encode(surface)) - 1)) AS k FROM (VALUES """ + ", ".join(f"('{s.decode()}')" for _, s in _SURFACES) + """) AS v(surface))),
h AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
c AS (SELECT doc_id, substr(h, 2 * i - 1, 4) AS pair FROM (SELECT doc_id, h, unnest(range(1, n)) AS i FROM h)),
k AS (SELECT doc_id, count(*) AS cuts FROM c WHERE pair NOT IN (SELECT pair FROM p) GROUP BY doc_id)
SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE 1 + coalesce(cuts, 0) END::BIGINT AS n_segments FROM h LEFT JOIN k USING (doc_id)""")
def r23_forced_boundaries(spark, sf_dir):
    return tokenize.segments(documents(spark, sf_dir), engine()).select("doc_id", "n_segments")


@query(SQL["r23_forced_boundaries"])
def r23_boundaries_native(spark, sf_dir):
    """The relational form: byte pairs that stand in no surface, counted natively."""
    return tokenize.segments_sql(documents(spark, sf_dir), engine()).select("doc_id", "n_segments")


@query("SELECT doc_id, sha256(text) AS decoded_sha256, 0 AS decode_status FROM documents")
def r25_decode(spark, sf_dir):
    ids = tokenize.encode_ids(documents(spark, sf_dir), engine("en"))
    got = tokenize.decode(ids.select("doc_id", "ids"), engine("en"))
    return got.select("doc_id", F.sha2("decoded", 256).alias("decoded_sha256"), "decode_status")


@query("SELECT item_id, sha256(text) AS decoded_sha256 FROM benchmark")
def r25_decode_joined(spark, sf_dir):
    """The relational form: ids as rows, joined with the vocabulary table."""
    ids = tokenize.encode_ids(table(spark, sf_dir, "benchmark").select("item_id", "text"), engine())
    rows = ids.select("item_id", F.posexplode("ids").alias("pos", "token_id"))
    got = tokenize.decode_joined(rows, tokenize.vocabulary_table(spark, engine()), "item_id")
    return got.select("item_id", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("SELECT doc_id, true AS exact FROM documents")
def r26_round_trip(spark, sf_dir):
    return tokenize.round_trip(documents(spark, sf_dir), engine("en", "hi", "ja")).select("doc_id", "exact")


@query("SELECT doc_id, CASE WHEN text LIKE '%.' THEN 7 ELSE 8 END AS dfa_token, octet_length(encode(text)) + length(text) - length(replace(text, '.', '')) AS dfa_cost FROM documents")
def r27_dfa(spark, sf_dir):
    """An automaton that tells texts that end in a full stop (token 7) from others (8); each byte costs 1, a stop 2."""
    steps = {(s, b): (1, 2) if b == 46 else (0, 1) for s in (0, 1) for b in range(256)}
    return tokenize.run_automaton(documents(spark, sf_dir), steps, {0: (8, 0), 1: (7, 0)}).select("doc_id", "dfa_token", "dfa_cost")


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 2048 THEN 9 ELSE 0 END AS status FROM documents")
def r28_batch(spark, sf_dir):
    """A batch with a ceiling: rows above it fail alone."""
    return tokenize.encode_batch(documents(spark, sf_dir), engine(limits=Limits(max_input_bytes=2048))).select("doc_id", "status")


# --- languages and routes -----------------------------------------------------------------------


@query(f"""SELECT doc_id, language, score FROM (SELECT doc_id, {oracles.score_sql()} FROM ({_DOCS})),
  LATERAL (SELECT unnest(['en', 'hi', 'ja']) AS language, unnest([en, hi, ja]) AS score)""")
def r31_detector_scores(spark, sf_dir):
    return tokenize.detector_score_rows(planted_docs(spark, sf_dir), engine("en"), ["doc_id"])


@query(f"""SELECT doc_id, language IS NOT NULL AS matched, coalesce(language IN ('en', 'hi'), false) AS available, score, margin, language
FROM (SELECT *, {oracles.LANGUAGE} AS language FROM (SELECT *, {oracles.BEST} FROM (SELECT doc_id, {oracles.score_sql()} FROM ({_DOCS}))))""")
def r32_detection(spark, sf_dir):
    return tokenize.detect(planted_docs(spark, sf_dir), engine("en", "hi")).select("doc_id", "detection.*")


@query("""
WITH s AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[\\x{0900}-\\x{097F}]+|[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}]+|[^\\x00-\\x7F\\x{0900}-\\x{097F}\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}]+|[\\x00-/:-@\\[-^`{-\\x7F]+')) AS s FROM (""" + _DOCS + """))
SELECT CASE WHEN regexp_matches(s, '^[A-Za-z0-9_]') THEN 1 WHEN regexp_matches(s, '^[\\x00-\\x7F]') THEN 0 WHEN regexp_matches(s, '^[\\x{0900}-\\x{097F}]') THEN 2
  WHEN regexp_matches(s, '^[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}]') THEN 3 ELSE 4 END AS class, count(*) AS n_spans, sum(octet_length(encode(s)))::BIGINT AS n_bytes
FROM s GROUP BY ALL""")
def r33_route_totals(spark, sf_dir):
    return tokenize.route_totals(planted_docs(spark, sf_dir), engine("en"))


_ROUTES = "[A-Za-z0-9_]+|[\\x{0900}-\\x{097F}]+|[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}]+|[^\\x00-\\x7F\\x{0900}-\\x{097F}\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}]+|[\\x00-/:-@\\[-^`{-\\x7F]+"


@query(f"""SELECT doc_id, count(*) AS n_spans, sum(octet_length(encode(text)))::BIGINT AS n_bytes, sum((score >= 100 AND margin >= 20)::INT)::BIGINT AS n_matched
FROM (SELECT *, {oracles.BEST} FROM (SELECT *, {oracles.score_sql()} FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_ROUTES}')) AS text FROM ({_DOCS})))) GROUP BY doc_id""")
def r33_span_routes(spark, sf_dir):
    routes = tokenize.span_routes(planted_docs(spark, sf_dir), engine("en"), ["doc_id"])
    return routes.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum("length").alias("n_bytes"), F.sum(F.col("matched").cast("bigint")).alias("n_matched"))


def _auto_rows(df: DataFrame, column: str) -> DataFrame:
    return df.select("conv_id", "turn", "status", F.size(column).alias("n_tokens"), "detection.matched", "detection.language")


@query(oracles.auto_sql(_TURNS, None))
def r34_encode_auto(spark, sf_dir):
    return _auto_rows(tokenize.encode_auto(planted_turns(spark, sf_dir), engine("en", "hi", "ja")), "ids")


@query(oracles.auto_sql(_TURNS, None))
def r35_tokens_auto(spark, sf_dir):
    return _auto_rows(tokenize.encode_auto(planted_turns(spark, sf_dir), engine("en", "hi", "ja"), full=True), "tokens")


@query(oracles.auto_sql(_TURNS, _ROUTES))
def r36_encode_span_auto(spark, sf_dir):
    return _auto_rows(tokenize.encode_span_auto(planted_turns(spark, sf_dir), engine("en", "hi", "ja")), "ids")


# --- Unicode ------------------------------------------------------------------------------------


@query(f"SELECT doc_id, length_grapheme(text) AS n_graphemes FROM ({_DOCS})")
def r38_graphemes(spark, sf_dir):
    return unicode.grapheme_counts(planted_docs(spark, sf_dir)).select("doc_id", "n_graphemes")


#: Scripts of the planted texts in the order of their numbers.
_SCRIPTS = ("Inherited", "Cyrillic", "Devanagari", "Han", "Hangul", "Hiragana", "Latin")
_RUNS = "|".join(f"\\p{{{x}}}+" for x in _SCRIPTS) + "|[^" + "".join(f"\\p{{{x}}}" for x in _SCRIPTS) + "]+"
_SCRIPT = "CASE " + " ".join(f"WHEN regexp_matches(s, '^\\p{{{x}}}') THEN '{x.upper()}'" for x in _SCRIPTS) + " ELSE 'COMMON' END"


@query(f"""SELECT {_SCRIPT} AS script, count(*) AS n_spans, sum(octet_length(encode(s)))::BIGINT AS n_bytes
FROM (SELECT unnest(regexp_extract_all(text, '{_RUNS}')) AS s FROM ({_DOCS})) GROUP BY ALL""")
def r40_script_totals(spark, sf_dir):
    return unicode.script_totals(planted_docs(spark, sf_dir))


@query(f"SELECT doc_id, count(*) AS n_spans FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_RUNS}')) FROM ({_DOCS})) GROUP BY doc_id")
def r40_script_spans(spark, sf_dir):
    spans = unicode.script_spans(planted_docs(spark, sf_dir), ["doc_id"])
    return spans.groupBy("doc_id").agg(F.count("*").alias("n_spans"))


_FLAGS = (
    (1, "[\\x{061C}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]"),
    (2, "[\\x{00AD}\\x{034F}\\x{061C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}\\x{FFF0}-\\x{FFF8}]"),
)


def _findings_sql(source: str, columns: str) -> str:
    """columns and n1, n2, n5: characters of a text by the kind of finding that they are."""
    flags = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS n{k}" for k, p in _FLAGS)
    counts = ", ".join(f"len(regexp_extract_all(text, '\\p{{{x}}}'))" for x in _SCRIPTS[1:])
    return f"SELECT *, list_sum(c) - list_max(c) AS n5 FROM (SELECT {columns}, {flags}, [{counts}] AS c FROM ({source}))"


@query(f"""SELECT kind, sum(n)::BIGINT AS n FROM (
  SELECT unnest([1, 2, 5]) AS kind, unnest([n1, n2, n5]) AS n FROM ({_findings_sql(f"SELECT text FROM ({_DOCS}) UNION ALL SELECT html FROM pages", "text")}))
GROUP BY kind HAVING sum(n) > 0""")
def r42_security(spark, sf_dir):
    """Findings of documents and pages by kind."""
    both = planted_docs(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    return unicode.security_findings(both, [], "text").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, sha256(nfc_normalize(text)) AS normalized_sha256 FROM ({_DOCS})")
def r44_normalize_nfc(spark, sf_dir):
    return unicode.normalized_digests(planted_docs(spark, sf_dir), "NFC").select("doc_id", "normalized_sha256")


@query(f"""SELECT doc_id, sha256(nfc_normalize(replace(replace(replace(lower(regexp_replace(text, '{_FLAGS[1][1]}', '', 'g')), 'ß', 'ss'), 'ﬁ', 'fi'), 'ａ', 'a'))) AS normalized_sha256
FROM ({_DOCS})""")
def r44_normalize_casefold(spark, sf_dir):
    return unicode.normalized_digests(planted_docs(spark, sf_dir), "NFKC_CASEFOLD").select("doc_id", "normalized_sha256")


@query(f"SELECT doc_id, octet_length(encode(nfc_normalize(text))) AS n_bytes, octet_length(encode(text)) AS n_source, length(nfc_normalize(text)) AS n_units FROM ({_DOCS})")
def r47_normalized_view(spark, sf_dir):
    """Bytes of the view and of the source that its units come from."""
    got = unicode.normalized_view(planted_docs(spark, sf_dir), "NFC")
    n = F.aggregate("units", F.lit(0).cast("bigint"), lambda a, u: a + F.aggregate(u["spans"], F.lit(0).cast("bigint"), lambda b, s: b + s["length"]))
    return got.select("doc_id", F.octet_length("normalized").cast("bigint").alias("n_bytes"), n.alias("n_source"), F.size("units").cast("bigint").alias("n_units"))


# --- lexing and parts ---------------------------------------------------------------------------


@query("""
WITH t AS (SELECT unnest(regexp_extract_all(props, '"(?:\\\\.|[^"\\\\])*"|[ \\t]+|[A-Za-z_]+[A-Za-z_0-9]*|[0-9][0-9A-Za-z_.]*|.')) AS t FROM events)
SELECT CASE WHEN t LIKE '"%' THEN 6 WHEN regexp_matches(t, '^[ \\t]') THEN 1 WHEN t IN ('true', 'false', 'null') THEN 4 WHEN regexp_matches(t, '^[A-Za-z_]') THEN 3
  WHEN regexp_matches(t, '^[0-9]') THEN 5 ELSE 8 END AS kind, count(*) AS n_tokens, sum(octet_length(encode(t)))::BIGINT AS n_bytes
FROM t GROUP BY ALL""")
def r49_lex_json(spark, sf_dir):
    return lex.lex_totals(table(spark, sf_dir, "events").select("props"), LEX_PROFILES["json"], "props")


_WORD = "[A-Za-z_[^\\x00-\\x7F]][0-9A-Za-z_[^\\x00-\\x7F]]*".replace("[A-Za-z_[^\\x00-\\x7F]]", "(?:[A-Za-z_]|[^\\x00-\\x7F])").replace("[0-9A-Za-z_[^\\x00-\\x7F]]", "(?:[0-9A-Za-z_]|[^\\x00-\\x7F])")
_STRING = '"(?:\\\\[\\s\\S]|[^"\\\\])*"|"[\\s\\S]*|\'\'(?:\\\\[\\s\\S]|[^\'\'\\\\])*\'\'|\'\'[\\s\\S]*'
_NUMBER = "[0-9](?:[eEpP][+-]|[0-9A-Za-z_.\'\'])*"


def _lex_sql(source: str, columns: str, comment: str, keywords: frozenset[str]) -> str:
    """columns, t and kind of the tokens of texts without block comments and triple quotes."""
    pattern = f"\\r\\n|\\r|\\n|[ \\t\\v\\f]+|{comment}[^\\r\\n]*|{_STRING}|{_WORD}|{_NUMBER}|[\\x00-\\x7F]"
    words = ", ".join(f"'{w}'" for w in sorted(keywords))
    return f"""SELECT {columns}, t, CASE WHEN regexp_matches(t, '^[\\r\\n]') THEN 2 WHEN regexp_matches(t, '^[ \\t\\v\\f]') THEN 1 WHEN starts_with(t, '{comment}') THEN 7
  WHEN regexp_matches(t, '^["\'\']') THEN CASE WHEN regexp_full_match(t, '"(?:\\\\[\\s\\S]|[^"\\\\])*"|\'\'(?:\\\\[\\s\\S]|[^\'\'\\\\])*\'\'') THEN 6 ELSE 9 END
  WHEN t IN ({words}) THEN 4 WHEN regexp_matches(t, '^(?:[A-Za-z_]|[^\\x00-\\x7F])') THEN 3 WHEN regexp_matches(t, '^[0-9]') THEN 5 ELSE 8 END AS kind
FROM (SELECT {columns}, unnest(regexp_extract_all(text, '{pattern}')) AS t FROM ({source}))"""


@query(f"SELECT kind, count(*) AS n_tokens, sum(octet_length(encode(t)))::BIGINT AS n_bytes FROM ({_lex_sql(_DOCS, 'doc_id', '//', LEX_PROFILES['rust'].keywords)}) GROUP BY kind")
def r49_lex_documents(spark, sf_dir):
    return lex.lex_totals(planted_docs(spark, sf_dir), LEX_PROFILES["rust"])


@query("SELECT part, count(*) AS n FROM (SELECT unnest(regexp_extract_all(c_name, '[0-9]+|[A-Z]?[^0-9A-Z_$]+|[A-Z]+')) AS part FROM customer) GROUP BY part")
def r51_identifier_parts(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.explode(native.identifier_parts(F.col("c_name"))).alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query("""
SELECT kind, part, count(*) AS n FROM (
  SELECT unnest([{'kind': 4, 'part': split_part(p, '.', 1)}, {'kind': 5, 'part': split_part(p, '.', 2)}], recursive := true)
  FROM (SELECT l_extendedprice::DECIMAL(18, 2)::VARCHAR AS p FROM lineitem)) GROUP BY ALL""")
def r52_number_parts(spark, sf_dir):
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    rows = table(spark, sf_dir, "lineitem").select(F.explode(native.number_parts(price)).alias("p"))
    return rows.select(F.col("p.kind").alias("kind"), F.col("p.text").alias("part")).groupBy("kind", "part").agg(F.count("*").alias("n"))


@query("""
SELECT kind, part, count(*) AS n FROM (
  SELECT 9 AS kind, '"' AS part FROM events, range(2) UNION ALL SELECT 10, event_type FROM events WHERE event_type <> '') GROUP BY ALL""")
def r53_string_parts(spark, sf_dir):
    word = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    rows = table(spark, sf_dir, "events").select(F.explode(native.string_parts(word, ['"', "'"])).alias("p"))
    return rows.select(F.col("p.kind").alias("kind"), F.col("p.text").alias("part")).groupBy("kind", "part").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT event_id, unnest(regexp_extract_all(props, '"(?:\\\\.|[^"\\\\])*"|[0-9][0-9A-Za-z_.]*')) AS t FROM events),
p AS (
  SELECT 9 AS kind FROM t, range(2) WHERE t LIKE '"%' UNION ALL SELECT 10 FROM t WHERE t LIKE '"%' AND length(t) > 2
  UNION ALL SELECT 4 FROM t WHERE t NOT LIKE '"%' UNION ALL SELECT 5 FROM t WHERE t NOT LIKE '"%' AND t LIKE '%.%')
SELECT kind, count(*) AS n FROM p GROUP BY kind""")
def r54_semantic(spark, sf_dir):
    parts = lex.semantic_components(table(spark, sf_dir, "events").select("event_id", "props"), LEX_PROFILES["json"], ["event_id"], "props")
    return parts.groupBy("kind").agg(F.count("*").alias("n"))


@query("""
WITH h AS (SELECT doc_id, octet_length(encode(text)) AS n, list_transform(regexp_extract_all(hex(encode(text)), '..'),
  lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16 + instr('0123456789ABCDEF', h[2]) - 1)[2:4] AS b FROM documents)
SELECT doc_id, CASE WHEN n >= 3 THEN 0 ELSE 5 END AS status,
  CASE WHEN n >= 3 THEN ((b[1] * 256 + b[2]) & 8191)::BIGINT END AS high,
  CASE WHEN n >= 3 THEN ((b[1] + b[2] * 256) >> 3)::BIGINT END AS low FROM h""")
def r55_bit_fields(spark, sf_dir):
    """13 bits from bit 3 of the second byte on, in both orders."""
    data = F.encode("text", "UTF-8")
    high, low = (native.bit_field(data, F.lit(1), 3, 13, o) for o in (native.MSB0, native.LSB0))
    return documents(spark, sf_dir).select("doc_id", high["status"].alias("status"), high["value"].cast("bigint").alias("high"), low["value"].cast("bigint").alias("low"))


# --- documents, blocks, records -----------------------------------------------------------------


#: Parts of identifiers, numbers and strings: a number for each kind.
_CUT = "t"
for _at, _to in (("([a-z])([A-Z])", "\\1 \\2"), ("([A-Z])([A-Z][a-z])", "\\1 \\2"), ("([^0-9 ])([0-9])", "\\1 \\2"), ("([0-9])([^0-9 ])", "\\1 \\2")):
    _CUT = f"regexp_replace({_CUT}, '{_at}', '{_to}', 'g')"
_GROUPS = "'^(0[xXbBoO])?([^.eEpP]*)(?:[.]([^eEpP]*))?(?:([eEpP])([+-])?([\\s\\S]*))?$'"
_PARTS = f"""CASE kind WHEN 3 THEN len(list_filter(regexp_split_to_array({_CUT}, '[ _$]+'), lambda x: x <> ''))
  WHEN 5 THEN {" + ".join(f"(regexp_extract(t, {_GROUPS}, {g}) <> '')::INT" for g in range(1, 7))}
  WHEN 6 THEN 2 + (length(t) > 2)::INT ELSE 0 END"""


@query(oracles.tokens_sql(_DOCS, "doc_id", f""",
m AS (SELECT doc_id, sum(n * len(ids)) AS m FROM segs JOIN solved USING (seg) GROUP BY doc_id),
lexed AS (SELECT doc_id, count(*) AS x, sum({_PARTS}) AS y FROM ({_lex_sql(_DOCS, "doc_id", "#", LEX_PROFILES["python"].keywords)}) GROUP BY doc_id),
seen AS (SELECT doc_id, n1 + n2 + n5 AS f FROM ({_findings_sql(_DOCS, "doc_id")}))
SELECT doc_id, 0 AS status, octet_length(encode(text)) AS n_bytes, sha256(text) AS source_sha256, coalesce(m, 0)::INT AS n_tokens, length_grapheme(text)::INT AS n_graphemes,
  f::INT AS n_findings, length(nfc_normalize(text))::INT AS n_units, coalesce(x, 0)::INT AS n_lexical, coalesce(y, 0)::INT AS n_semantic
FROM src LEFT JOIN m USING (doc_id) LEFT JOIN lexed USING (doc_id) JOIN seen USING (doc_id)""", "en"))
def r56_token_documents(spark, sf_dir):
    """Sizes of all projections of each document."""
    return document.document_sizes(planted_docs(spark, sf_dir), engine("en", lexer="python"), ALL).select("doc_id", "status", "n_bytes", "source_sha256", "n_tokens", "n_graphemes", "n_findings", "n_units", "n_lexical", "n_semantic")


@query(f"""SELECT doc_id, count(*) AS n, sum(octet_length(encode(g)))::BIGINT AS n_bytes
FROM (
  SELECT doc_id, substring_grapheme(s, k, 1) AS g FROM (SELECT doc_id, s, unnest(range(1, length_grapheme(s) + 1)) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[\\x00-\\x7F]?[^\\x00-\\x7F]+')) AS s FROM ({_DOCS}))))
WHERE octet_length(encode(g)) > 1 GROUP BY doc_id""")
def r58_projections(spark, sf_dir):
    """Graphemes of longer than one byte, read from documents as rows."""
    made = document.token_documents(planted_docs(spark, sf_dir), engine("en"), MODEL | GRAPHEMES)
    rows = made.select("doc_id", F.explode(F.filter("graphemes", lambda g: g["length"] > 1)).alias("g"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("g.length").alias("n_bytes"))





@query(oracles.blocks_sql(_DOCS, "doc_id", POLICY, """SELECT doc_id, count(*) AS n_blocks, max(macros + (total > 0)::INT)::INT AS n_macroblocks, sum(n)::BIGINT AS n_bytes, max(n) AS largest
FROM plan GROUP BY doc_id"""))
def r59_block_plan(spark, sf_dir):
    got = document.blocks(planted_docs(spark, sf_dir), engine(), POLICY, ["doc_id"])
    return got.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), (F.max("macroblock") + 1).alias("n_macroblocks"), F.sum("length").alias("n_bytes"), F.max("length").alias("largest"))


@query("SELECT doc_id, 0 AS unpack_status, octet_length(encode(text)) AS source_length, true AS exact FROM documents")
def r60_packed(spark, sf_dir):
    """Packed records, unpacked and compared with a fresh encoding."""
    return document.return_packed(documents(spark, sf_dir).select("doc_id", "text"), engine()).select("doc_id", "unpack_status", "source_length", "exact")


@query(oracles.blocks_sql(_DOCS, "doc_id", POLICY, """, b AS (SELECT n, count(*) AS n_blocks FROM plan JOIN hexed USING (doc_id) GROUP BY n, array_to_string(h[begin + 1:begin + n], ''))
SELECT n_blocks, count(*) AS n_keys, sum(n)::BIGINT AS n_bytes FROM b GROUP BY n_blocks"""))
def r61_block_cache_keys(spark, sf_dir):
    """Blocks that occur in several documents, by the size of their groups."""
    keys = document.with_cache_keys(document.blocks(planted_docs(spark, sf_dir), engine(), POLICY, ["doc_id"]), 7, 1)
    return document.distinct_blocks(keys).groupBy("n_blocks").agg(F.count("*").alias("n_keys"), F.sum("length").alias("n_bytes"))


@query("SELECT doc_id, 128 + octet_length(encode(text)) AS record_length, 0 AS cache_status, true AS exact FROM documents")
def r63_cache_records(spark, sf_dir):
    got = document.read_cache_records(document.cache_records(documents(spark, sf_dir)))
    return got.select("doc_id", F.octet_length("cache_record").cast("bigint").alias("record_length"), "cache_status", (F.col("cache_value") == F.encode("text", "UTF-8")).alias("exact"))


@query("SELECT doc_id, 0 AS status, 0 AS read_status, true AS exact, 63 AS flags FROM documents")
def r09_document_records(spark, sf_dir):
    """Whole documents written as records and read back."""
    return document.return_documents(documents(spark, sf_dir).select("doc_id", "text"), engine("en"), ALL).select("doc_id", "status", "read_status", "exact", "flags")


@query("SELECT sha256(text) AS content, count(*) AS n_docs FROM documents GROUP BY ALL HAVING count(*) > 1")
def r68_duplicates_by_hash(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("content")).agg(F.count("*").alias("n_docs")).where("n_docs > 1")


# --- streams and edits --------------------------------------------------------------------------


@query("SELECT conv_id, sum(octet_length(encode(text)))::BIGINT AS n_bytes, true AS equal FROM conversations GROUP BY conv_id")
def r69_stream_equals_whole(spark, sf_dir):
    """Turns as chunks of a stream: the online stream's ids are those of the joined text."""
    turns = table(spark, sf_dir, "conversations")
    a = replay.buffered(turns, engine("en"), "conv_id", "turn")
    b = replay.online_digest(turns, engine("en"), "conv_id", "turn").select("key", F.col("ids_sha256").alias("other"))
    return a.join(b, "key").select(F.col("key").alias("conv_id"), "n_bytes", (F.col("ids_sha256") == F.col("other")).alias("equal"))


@query(oracles.tokens_sql(f"SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM ({_TURNS}) GROUP BY conv_id", "conv_id", """
SELECT conv_id, sum(n * len(ids))::BIGINT AS n_tokens, sum(n * length(seg) // 2)::BIGINT AS n_bytes FROM segs JOIN solved USING (seg) GROUP BY conv_id""", "en"))
def r70_online_tokens(spark, sf_dir):
    got = replay.online(planted_turns(spark, sf_dir), engine("en"), "conv_id", "turn")
    return got.groupBy(F.col("key").alias("conv_id")).agg(F.count("*").alias("n_tokens"), F.sum("length").alias("n_bytes"))


def _edit_rows(spark, sf_dir) -> DataFrame:
    """Each turn is put in the middle of what its conversation's document is so far, over its last 5 bytes."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.octet_length(F.encode("text", "UTF-8")).alias("n"))
    before = F.coalesce(F.sum("n").over(w), F.lit(0))
    return turns.select("conv_id", "turn", "text", F.floor(before / 2).alias("at"), F.lit(0).alias("gone"))


_EDITED = "SELECT conv_id, turn AS seq, sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS length, true AS equal FROM conversations"


def _edited(spark, sf_dir, kind: str) -> DataFrame:
    rows = _edit_rows(spark, sf_dir)
    a = replay.edits(rows, engine("en"), "conv_id", "turn", "at", "gone", "text", kind, 256)
    b = replay.edits(rows, engine("en"), "conv_id", "turn", "at", "gone", "text", "plain").select("key", "seq", F.col("ids_sha256").alias("other"))
    return a.join(b, ["key", "seq"]).select(F.col("key").alias("conv_id"), "seq", "length", (F.col("ids_sha256") == F.col("other")).alias("equal"))


@query(_EDITED)
def r72_incremental_equals_whole(spark, sf_dir):
    return _edited(spark, sf_dir, "incremental")


@query(_EDITED)
def r73_resync_equals_whole(spark, sf_dir):
    return _edited(spark, sf_dir, "resync")


@query()
def r73_resync_savings(spark, sf_dir):
    got = replay.edits(_edit_rows(spark, sf_dir), engine("en"), "conv_id", "turn", "at", "gone", "text", "resync", 256)
    return got.groupBy(F.col("key").alias("conv_id")).agg(F.sum("reprocessed").alias("reprocessed"), F.sum("reused_prefix").alias("reused_prefix"), F.sum("reused_suffix").alias("reused_suffix"), F.sum("length").alias("length"))


# --- policy, training, registry -----------------------------------------------------------------


@query("SELECT CASE WHEN octet_length(encode(text)) > 4096 THEN 9 ELSE 0 END AS status, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents GROUP BY ALL")
def r75_limits(spark, sf_dir):
    got = metrics.limit_status(documents(spark, sf_dir), engine(limits=Limits(4096)))
    return got.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("bigint")).alias("n_bytes"))


@query("SELECT doc_id, 'encode' AS operation, 9 AS status, 'resource limit' AS status_text, octet_length(encode(text)) AS input_bytes FROM documents WHERE octet_length(encode(text)) > 4096")
def r79_events(spark, sf_dir):
    got = tokenize.encode_ids(documents(spark, sf_dir), engine(limits=Limits(4096)))
    return metrics.events(got, "doc_id", mask=(config.LIMIT,))


@query("""
WITH l AS (SELECT unnest(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+')) AS line FROM documents),
s AS (SELECT regexp_extract_all(line, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\v\\x1c-\\x1f\\x{85}\\p{Z}]+|[\\s\\v\\x1c-\\x1f\\x{85}\\p{Z}]+') AS s FROM l),
c AS (
  SELECT unnest(s) AS surface FROM s
  UNION ALL SELECT s[i] || s[i + 1] FROM (SELECT s, unnest(range(1, len(s))) AS i FROM s)
  UNION ALL SELECT s[i] || s[i + 1] || s[i + 2] FROM (SELECT s, unnest(range(1, len(s) - 1)) AS i FROM s)
  UNION ALL SELECT w[:k] FROM (SELECT w, unnest(range(1, least(length(w), 32) + 1)) AS k FROM (SELECT unnest(s) AS w FROM s) WHERE octet_length(encode(w)) > 32)
  UNION ALL SELECT right(w, k) FROM (SELECT w, unnest(range(1, least(length(w), 32) + 1)) AS k FROM (SELECT unnest(s) AS w FROM s) WHERE octet_length(encode(w)) > 32)),
f AS (SELECT surface, octet_length(encode(surface)) AS n, count(*) AS frequency FROM c WHERE octet_length(encode(surface)) BETWEEN 2 AND 32 GROUP BY ALL HAVING count(*) >= 2)
SELECT surface, frequency, (frequency * (n - 1))::BIGINT AS gain, greatest(1, 1000 - least(999, floor(80 * log2(frequency + 1) + 25 * (n - 1))))::INTEGER AS cost
FROM f ORDER BY gain DESC, frequency DESC, n DESC, encode(surface) LIMIT 744""")
def r81_training(spark, sf_dir):
    """Pieces of a vocabulary of 1000 entries trained on all documents."""
    return training.train(documents(spark, sf_dir), vocab_size=1000)


#: A small registry.
_VERSIONS = ["0.0.3", "0.0.4", "0.2.3", "0.2.9", "0.3.0", "1.2.3", "1.9.0", "2.0.0", "10.0.0"]


def registry_table(spark) -> DataFrame:
    rows = [("acme", n, v, hashlib_hex(f"{n}{v}"), 10, n, "1.2", "unverified", "") for n in ("model", "lexer") for v in _VERSIONS]
    return spark.createDataFrame(rows, registry.PACKS)


def hashlib_hex(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


@query("SELECT DISTINCT c_mktsegment AS name, 3 AS n_versions FROM customer")
def r82_install(spark, sf_dir):
    """One pack for each market segment, installed twice, then a new version."""
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    row = lambda v: names.select(F.lit("acme").alias("publisher"), "name", F.lit(v).alias("version"), F.sha2(F.concat("name", F.lit(v)).cast("binary"), 256).alias("sha256"), F.lit(1).cast("bigint").alias("size"), F.lit("model").alias("pack_class"), F.lit("1.2").alias("format"), F.lit("unverified").alias("trust_status"), F.lit("").alias("key_id"))
    base = row("1.0.0").unionByName(row("1.0.1"))
    out = registry.install(registry.install(base, base), row("1.1.0"))
    return out.groupBy("name").agg(F.count("*").cast("int").alias("n_versions"))


@query("SELECT 'missing' AS problem, count(*) AS n FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'corrupt', count(*) FROM documents WHERE doc_id % 7 = 1")
def r85_audit(spark, sf_dir):
    """Documents as packs of which every seventh object is gone and every seventh is changed."""
    docs = documents(spark, sf_dir)
    sha = F.sha2(F.encode(F.concat(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))), "UTF-8"), 256)
    packs_ = docs.select(F.lit("acme").alias("publisher"), F.col("doc_id").cast("string").alias("name"), F.lit("1.0.0").alias("version"), sha.alias("sha256"), F.lit(5).cast("bigint").alias("size"))
    objects = docs.where("doc_id % 7 <> 0").select(sha.alias("sha256"), F.when(F.col("doc_id") % 7 == 1, "other").otherwise(sha).alias("content_sha256"), F.lit(5).cast("bigint").alias("size"))
    return registry.audit(packs_, objects).groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT doc_id, ids FROM (SELECT doc_id, [doc_id, coalesce(n_chars, 0), 4294967295] AS ids FROM documents)")
def r08_packed_ids(spark, sf_dir):
    """Ids to packed 32-bit integers and back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array("doc_id", F.coalesce("n_chars", F.lit(0)), F.lit(4294967295)).alias("ids"))
    return readers.unpack_ids(readers.pack_ids(docs).drop("ids")).select("doc_id", "ids")


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN '../' ELSE '' END || 'a/' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'unsafe path' ELSE 'corrupt' END AS problem FROM documents WHERE doc_id % 5 IN (0, 1)")
def r12_archive_test(spark, sf_dir):
    """Documents as archive entries, some with unsafe paths, some changed."""
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = documents(spark, sf_dir).select(F.concat(F.when(F.col("doc_id") % 5 == 0, "../").otherwise(""), F.lit("a/"), F.col("doc_id").cast("string")).alias("path"), F.length(content).cast("bigint").alias("size"), (F.crc32(content) + (F.col("doc_id") % 5 == 1).cast("bigint")).alias("crc32"), content.alias("content"))
    return archive.test(rows)


@query("SELECT unnest(['gzip', 'zlib', 'bz2', 'lzma']) AS codec, sum(octet_length(encode(text)))::BIGINT AS n_bytes, true AS smaller FROM documents")
def r13_codec_sizes(spark, sf_dir):
    """Bytes of all documents, and whether each codec makes them fewer."""
    got = archive.codec_sizes(documents(spark, sf_dir), "text")
    return got.select("codec", "n_bytes", (F.col("packed_bytes") < F.col("n_bytes")).alias("smaller"))


# register their queries; they import from here alone, so that a worker may begin with any of the three
from . import state_queries, table_queries  # noqa: E402, F401
