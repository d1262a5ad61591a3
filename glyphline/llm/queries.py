"""Queries of this package over whole tables, and the SQL that says what they return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, fill_middle, hard_negatives, html_extract, jaccard_join, language_id, line_dedup, lsh_forest, pack_tokens, topk_search, toxicity, url_filter
from .shared import table

#: The rules that the URL query applies: verdict, host, path.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Path of the rank file and pattern; None: those of the public_tokenizers package.
RANKS_PATH: str | None = None
PATTERN: str | None = None
#: Ends a document; fills a row (an id beyond the vocabulary).
EOS, PAD = 50256, 50257


def tokenizer() -> tuple[str, str]:
    if RANKS_PATH and PATTERN:
        return RANKS_PATH, PATTERN
    import public_tokenizers

    return RANKS_PATH or public_tokenizers.path("byte_bpe_50k.tiktoken"), PATTERN or public_tokenizers.PATTERN


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.quantize(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(rows.where("id % 50 = 0"), rows, 5)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens.pack(table(spark, sf_dir, "documents"), *tokenizer(), eos=EOS, pad=PAD)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), *tokenizer())


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore_texts(fill_middle.fill_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantize(table(spark, sf_dir, "embeddings"), label=label)
    return hard_negatives.mine(rows, rows.where("id % 100 = 0"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_ngram_jaccard, op3_toxicity, op4_language_id, op5_line_dedup, op6_html_text, op7_decontamination, op8_token_packing, op9_url_filter, op10_byte_bpe, op11_fill_middle, op12_hard_negatives, op13_minhash_dedup)}

SQL = {
    "op1_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_ngram_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS sh
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)""",
    "op5_line_dedup": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''),
w AS (
  SELECT doc_id, p - 1 AS pos, lines[p:p + 2] AS win
  FROM (SELECT doc_id, lines, unnest(range(1, greatest(len(lines) - 2, 1) + 1)) AS p FROM l)),
f AS (SELECT win, min((doc_id, pos)) AS first FROM w GROUP BY win HAVING count(*) > 1),
c AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos
  FROM w JOIN f USING (win) WHERE (doc_id, pos) > first),
n AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos, len(lines) AS n FROM l),
k AS (
  SELECT n.doc_id, max(n) AS n_lines, count(c.pos) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY n.pos) FILTER (WHERE c.pos IS NULL), '') AS text
  FROM n LEFT JOIN c ON c.doc_id = n.doc_id AND c.pos = n.pos GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(k.text, d.text) AS text, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN k USING (doc_id)""",
    "op7_decontamination": """
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT DISTINCT kind, id, array_to_string(w[p:p + 4], ' ') AS sh
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM t WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id),
h AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS k
  FROM s i JOIN s d ON d.sh = i.sh AND d.kind = 0 WHERE i.kind = 1 GROUP BY ALL)
SELECT doc_id, item_id, n::BIGINT AS n_item, k::BIGINT AS n_shared, k / n AS containment
FROM h JOIN n ON n.id = item_id WHERE 100 * k >= 80 * n""",
    "op9_url_filter": """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (
  SELECT page_id, host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM h) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY ALL)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.host = h.host AND m.path = h.path""",
    "op11_fill_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, substr(t, 1, least(x, y)) AS p, substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m, substr(t, greatest(x, y) + 1) AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.w, c.w)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5""",
    "op13_minhash_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS sh
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)""",
}
