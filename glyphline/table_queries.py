"""Queries of configuration that is made of a table's rows: containers, rank files, languages, engines, registries."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from . import config
from .config import Engine, Limits
from .functions import native
from .kernels import ed25519
from .kernels.vocab import LEX_PROFILES, Language, PackError, base_detector, base_language, base_vocabulary, raw_bpe_vocabulary
from .operators import metrics, observer, registry, tokenize
from .plans.kernel import with_kernel
from .queries import _folder, documents, engine, query, table
from .sources import formats, packs, readers

#: Rows of a table that one container is made of.
GROUP = 32


# --- containers and rank files --------------------------------------------------------------------


def _compiled_language():
    def fn(text):
        x = packs.read_language(packs.write_language(packs.from_json("language", text.decode())))
        return x.tag, len(x.deltas), sum(d for _, d in x.deltas), sum(len(s) for s, _ in x.deltas)

    return fn


@query(f"""SELECT 'parts-' || g AS tag, count(*) AS n_deltas, -sum(n)::BIGINT AS total, sum(octet_length(encode(p_name)))::BIGINT AS n_bytes
FROM (SELECT p_partkey // {GROUP} AS g, p_name, count(*) AS n FROM part GROUP BY ALL) GROUP BY g""")
def r04_language_files(spark, sf_dir):
    """A language for each few parts, authored as JSON, compiled to a container in tasks and read back."""
    names = table(spark, sf_dir, "part").groupBy(F.expr(f"p_partkey div {GROUP}").alias("g"), "p_name").agg((-F.count("*")).alias("delta"))
    pieces = F.collect_list(F.struct(F.col("p_name").alias("text"), "delta")).alias("pieces")
    authored = names.groupBy(F.concat(F.lit("parts-"), F.col("g").cast("string")).alias("name")).agg(pieces)
    made = with_kernel(authored.select(F.to_json(F.struct(F.col("name").alias("tag"), "pieces")).alias("json")), "json", "tag string, n_deltas bigint, total bigint, n_bytes bigint", _compiled_language)
    return made.drop("json")


def _compiled_lexer():
    def fn(text):
        p = packs.read_lexer(packs.write_lexer(packs.from_json("lexer", text.decode())))
        return p.name, len(p.line_comments), len(p.strings), len(p.keywords), sum(map(len, p.keywords))

    return fn


@query(f"""SELECT 'parts-' || g AS name, g % 3 AS n_line, 1 + g % 2 AS n_string, count(*) AS n_keyword, sum(length(word))::BIGINT AS n_chars
FROM (SELECT DISTINCT p_partkey // {GROUP} AS g, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> '' GROUP BY g""")
def r95_lexer_files(spark, sf_dir):
    """A lexer for each few parts, with their words as keywords: a standalone container, read back."""
    words = table(spark, sf_dir, "part").select(F.expr(f"p_partkey div {GROUP}").alias("g"), F.explode(F.split("p_name", " ")).alias("word")).where("word <> ''")
    lists = words.groupBy("g").agg(F.collect_set("word").alias("keywords"))
    strings = F.transform(F.slice(F.array(F.lit('"'), F.lit("'")), F.lit(1), (F.col("g") % 2 + 1).cast("int")), lambda s: F.struct(s.alias("delimiter"), F.lit("\\").alias("escape")))
    comments = F.slice(F.array(F.lit("//"), F.lit("#")), F.lit(1), (F.col("g") % 3).cast("int"))
    profile = F.struct(F.concat(F.lit("parts-"), F.col("g").cast("string")).alias("name"), comments.alias("line_comments"), strings.alias("strings"), "keywords")
    made = with_kernel(lists.select(F.to_json(profile).alias("json")), "json", "name string, n_line bigint, n_string bigint, n_keyword bigint, n_chars bigint", _compiled_lexer)
    return made.drop("json")


_RANKS = """r AS (SELECT CASE WHEN c_custkey % 17 = 3 THEN NULL WHEN c_custkey < 256 THEN 'byte ' || c_custkey ELSE 'name ' || (c_custkey - (c_custkey % 13 = 0)::INT) END AS surface,
  CASE WHEN c_custkey % 7 = 2 THEN NULL ELSE c_custkey - (c_custkey % 11 = 0)::INT END AS rank FROM customer)"""


@query(f"""WITH {_RANKS} SELECT * FROM (
  SELECT 'bad line' AS problem, count(*) AS n FROM r WHERE surface IS NULL OR rank IS NULL OR rank < 0
  UNION ALL SELECT 'duplicate surface', count(*) FROM (SELECT surface FROM r GROUP BY surface HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate rank', count(*) FROM (SELECT rank FROM r GROUP BY rank HAVING count(*) > 1)
  UNION ALL SELECT 'missing byte', 256 - count(DISTINCT surface) FROM r WHERE surface LIKE 'byte %') WHERE n > 0""")
def r05_tiktoken(spark, sf_dir):
    """What is wrong with the lines of a rank file of one line for each customer; the first are single bytes."""
    key = F.col("c_custkey")
    name = F.encode(F.concat(F.lit("name "), (key - (key % 13 == 0).cast("int")).cast("string")), "UTF-8")
    surface = F.base64(F.when(key < 256, F.unhex(F.lpad(F.hex(key), 2, "0"))).otherwise(name))
    rank = F.when(key % 7 == 2, F.lit("x")).otherwise((key - (key % 11 == 0).cast("int")).cast("string"))
    lines = table(spark, sf_dir, "customer").select(F.concat(F.when(key % 17 == 3, "!").otherwise(""), surface, F.lit(" "), rank).alias("value"))
    return readers.check_tiktoken(readers.tiktoken_rows(lines))


@query("SELECT range AS token_id, lpad(hex(range), 2, '0') AS surface FROM range(256) UNION ALL SELECT 256 + c_custkey, hex(encode(c_name)) FROM customer")
def r06_rank_lines(spark, sf_dir):
    """Ranks of all bytes and customers written as a rank file under a commit; its lines are read again natively."""
    formats.register(spark)
    single = spark.range(256).select(F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("surface"), F.col("id").alias("rank"))
    names = table(spark, sf_dir, "customer").select(F.encode("c_name", "UTF-8").alias("surface"), (F.col("c_custkey") + 256).alias("rank"))
    folder = _folder(spark, "ranks")
    single.unionByName(names).write.format("glyphline_ranks").mode("append").save(folder)
    return readers.tiktoken_rows(spark.read.text(folder)).select(F.col("rank").alias("token_id"), F.hex("surface").alias("surface"))


def _compiled_vocabulary():
    def fn(text):
        kind, pieces = text.decode().split("\n", 1)
        return (packs.write_vocabulary(packs.from_json(kind, pieces)),)

    return fn


@query(f"""SELECT g, CASE WHEN g % 5 = 4 THEN 3 ELSE 0 END AS pack_status, CASE WHEN g % 5 = 4 THEN -1 ELSE 3 END AS n_sections,
  CASE WHEN g % 5 = 4 THEN -1 ELSE 256 + count(DISTINCT c_name) END AS n_entries, CASE WHEN g % 5 = 4 THEN -1 ELSE g % 2 END AS algorithm
FROM (SELECT c_custkey // {GROUP} AS g, c_name FROM customer) GROUP BY g""")
def r07_inspect_packs(spark, sf_dir):
    """A vocabulary for each few customers, weighted or of merges, written as a file; every fifth file is cut short."""
    formats.register(spark)
    names = table(spark, sf_dir, "customer").select(F.expr(f"c_custkey div {GROUP}").alias("g"), F.col("c_name").alias("text")).distinct()
    lists = names.groupBy("g").agg(F.collect_list(F.struct("text")).alias("pieces"))
    source = F.concat(F.when(F.col("g") % 2 == 1, "bpe\n").otherwise("model\n"), F.to_json(F.struct("pieces")))
    made = with_kernel(lists.select("g", source.alias("json")), "json", "content binary", _compiled_vocabulary)
    folder = _folder(spark, "vocabularies")
    content = F.when(F.col("g") % 5 == 4, F.substring("content", 1, 100)).otherwise(F.col("content"))
    made.select(F.concat(F.col("g").cast("string"), F.lit(".pack")).alias("path"), content.alias("content")).write.format("glyphline_files").mode("append").save(folder)
    got = readers.inspect_packs(readers.read_files(spark, folder, "*.pack"))
    n = F.when(F.col("sections").isNotNull(), F.size("sections")).otherwise(-1)
    g = F.regexp_extract("path", r"(\d+)[.]pack$", 1).cast("bigint")
    return got.select(g.alias("g"), "pack_status", n.alias("n_sections"), F.coalesce("n_entries", F.lit(-1)).alias("n_entries"), F.coalesce("algorithm", F.lit(-1)).alias("algorithm"))


# --- paths and languages --------------------------------------------------------------------------


@query("""WITH p AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber % 2 = 0 THEN [2 * l_linenumber, 2, -2, 7, l_suppkey, -4, 7, l_partkey] ELSE [l_linenumber, 1, -6, 7, l_partkey] END AS l,
  CASE WHEN l_quantity::BIGINT % 3 = 0 THEN [2 * (l_suppkey % 4 + 1), 2, -3, 7, l_suppkey, -3, 7, l_partkey] ELSE [l_suppkey % 4 + 1, 1, -6, 7, l_suppkey] END AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l < r THEN 'left' ELSE 'right' END AS winner FROM p""")
def r21_path_order(spark, sf_dir):
    """Which of two paths over six bytes, made of each line item, comes first."""
    def edge(a, z, token, cost):
        return F.struct(F.lit(a).alias("start"), F.lit(z).alias("end"), F.lit(7).alias("namespace"), F.lit(3).alias("kind"), token.alias("id"), cost.cast("bigint").alias("cost"))

    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    left = F.when(line % 2 == 0, F.array(edge(0, 2, supp, line), edge(2, 6, part, line))).otherwise(F.array(edge(0, 6, part, line)))
    cost = supp % 4 + 1
    right = F.when(F.col("l_quantity").cast("bigint") % 3 == 0, F.array(edge(0, 3, supp, cost), edge(3, 6, part, cost))).otherwise(F.array(edge(0, 6, supp, cost)))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", left.alias("left"), right.alias("right"))
    return rows.select("l_orderkey", "l_linenumber", F.when(native.path_less(F.col("left"), F.col("right")), "left").otherwise("right").alias("winner"))


@query("""SELECT c_custkey AS token_id, c_nationkey AS cost, -count(o_orderkey)::BIGINT AS delta
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey""")
def r29_adjustments(spark, sf_dir):
    """Customers as a vocabulary, and a language for each priority that makes those who order cheaper, attached to it."""
    customers = table(spark, sf_dir, "customer")
    vocabulary = customers.select(F.col("c_custkey").alias("token_id"), F.col("c_nationkey").alias("cost"), F.encode("c_name", "UTF-8").alias("surface"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("tag"), "o_custkey").agg((-F.count("*")).alias("delta"))
    deltas = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("tag", F.encode("c_name", "UTF-8").alias("surface"), "delta")
    return tokenize.attach_deltas(vocabulary, deltas)


@query("""SELECT lang AS tag, CASE WHEN regexp_full_match(lang, '[0-9A-Za-z-]{1,63}') THEN 0 ELSE 1 END AS status, count(DISTINCT word) AS n_deltas, -count(*) AS total
FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' AND lang IS NOT NULL GROUP BY lang""")
def r30_languages(spark, sf_dir):
    """A language for each one of documents, of whose words each is cheaper the more often it is there."""
    words = documents(spark, sf_dir).where("lang is not null").select(F.col("lang").alias("tag"), F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    deltas = words.groupBy("tag", F.encode("word", "UTF-8").alias("surface")).agg((-F.count("*")).alias("delta"))
    return tokenize.language_sizes(deltas)


# --- engines --------------------------------------------------------------------------------------


def _fingerprints():
    plain = Engine(base_vocabulary())

    def attached(*languages):
        out = plain
        for x in languages:
            out = out.with_language(x) if x.deltas else out
        return out

    def fn(text):
        rows = json.loads(text)
        even, odd = (Language(t, tuple((r["name"].encode(), -1) for r in rows if r["nation"] % 2 == k)) for k, t in enumerate(("even", "odd")))
        both, one = attached(even, odd), attached(even)
        limit = Limits() if sum(r["nation"] for r in rows) % 2 else Limits(4096)
        return both.fingerprint() == attached(odd, even).fingerprint(), both.fingerprint() != one.fingerprint(), both.runtime_identity() != both.with_limits(limit).runtime_identity()

    return fn


@query(f"""SELECT g, true AS same_for_any_order, bool_or(c_nationkey % 2 = 1) AS changes_with_languages, sum(c_nationkey) % 2 = 0 AS changes_with_limits
FROM (SELECT DISTINCT c_custkey // {GROUP} AS g, c_name, c_nationkey FROM customer) GROUP BY g""")
def r65_fingerprint(spark, sf_dir):
    """Identities of an engine for each few customers, whose names are two languages, one or none."""
    rows = table(spark, sf_dir, "customer").select(F.expr(f"c_custkey div {GROUP}").alias("g"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).distinct()
    lists = rows.groupBy("g").agg(F.to_json(F.collect_list(F.struct("name", "nation"))).alias("json"))
    return with_kernel(lists, "json", "same_for_any_order boolean, changes_with_languages boolean, changes_with_limits boolean", _fingerprints).drop("json")


def _changed():
    plain, en, detector = Engine(base_vocabulary()), base_language("en"), base_detector()

    def fn(key):
        k = int(key)
        e = plain.seal() if k % 2 else plain
        try:
            for _ in range(k // 2 % 3):
                e = e.with_language(en)
            for _ in range(k // 6 % 3):
                e = e.with_detector(detector)
            e.with_limits(Limits(0 if k // 18 % 4 == 0 else 1 << 20))
        except PackError as error:
            return (error.status,)
        return (config.OK,)

    return fn


@query("""SELECT o_orderkey, CASE WHEN s = 1 AND l + d > 0 THEN 13 WHEN l = 2 OR d = 2 THEN 8 WHEN z THEN 1 WHEN s = 1 THEN 13 ELSE 0 END AS status
FROM (SELECT o_orderkey, o_orderkey % 2 AS s, o_orderkey // 2 % 3 AS l, o_orderkey // 6 % 3 AS d, o_orderkey // 18 % 4 = 0 AS z FROM orders)""")
def r76_engine_states(spark, sf_dir):
    """What changing an engine says, by the steps that an order's key stands for: sealed, languages, detectors, limits."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key"))
    return with_kernel(rows, "key", "status int", _changed).select("o_orderkey", "status")


def _capable():
    viterbi, merges, detector, lexer, en = Engine(base_vocabulary()), Engine(raw_bpe_vocabulary()), base_detector(), LEX_PROFILES["c"], base_language("en")
    seen = {}

    def fn(key):
        k = int(key) % 32
        if k not in seen:
            e = merges if k & 4 else viterbi
            e = e.with_detector(detector) if k & 1 else e
            e = e.with_lexer(lexer) if k & 2 else e
            e = e.with_language(en) if k & 8 else e
            e = e.with_security() if k & 16 else e
            have = e.seal().capabilities()
            seen[k] = tuple(have[c] for c in ("detector", "lexer", "semantic", "online_streaming", "resync_document", "language_packs", "security", "span_routing"))
        return seen[k]

    return fn


@query("""SELECT o_orderkey, k & 1 > 0 AS detector, k & 2 > 0 AS lexer, k & 2 > 0 AS semantic, k & 4 = 0 AS online_streaming, k & 4 = 0 AS resync_document, k & 8 > 0 AS language_packs, k & 16 > 0 AS security, k & 1 > 0 AS span_routing
FROM (SELECT o_orderkey, o_orderkey % 32 AS k FROM orders)""")
def r77_capabilities(spark, sf_dir):
    """What an engine of the parts that an order's key stands for can do."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key"))
    names = "detector lexer semantic online_streaming resync_document language_packs security span_routing".split()
    return with_kernel(rows, "key", ", ".join(f"{n} boolean" for n in names), _capable).select("o_orderkey", *names)


@query("""SELECT status, text AS status_text, count(*) AS n FROM (SELECT (o_orderkey % 20 - 2)::INT AS status FROM orders) LEFT JOIN (VALUES """ + ", ".join(f"({k}, '{s}')" for k, s in enumerate(config.STATUS)) + """) AS t(k, text) ON k = status WHERE text IS NOT NULL GROUP BY ALL
UNION ALL SELECT (o_orderkey % 20 - 2)::INT, 'unknown status', count(*) FROM orders WHERE o_orderkey % 20 - 2 NOT BETWEEN 0 AND 15 GROUP BY ALL""")
def r93_status_texts(spark, sf_dir):
    status = (F.col("o_orderkey") % 20 - 2).cast("int").alias("status")
    rows = table(spark, sf_dir, "orders").select(status).groupBy("status").agg(F.count("*").alias("n"))
    return rows.select("status", metrics.status_texts(F.col("status")).alias("status_text"), "n")


# --- registries -----------------------------------------------------------------------------------


@query("""WITH p AS (SELECT c_custkey // 64 AS g, [c_custkey % 3, c_custkey % 7, c_custkey] AS v FROM customer),
b AS (SELECT g, arg_min(v, v[3]) AS lo, arg_max(v, v[3]) AS hi FROM p GROUP BY g),
f AS (SELECT g, v FROM p JOIN b USING (g) WHERE CASE g % 3
  WHEN 0 THEN v >= lo AND CASE WHEN lo[1] > 0 THEN v[1] = lo[1] WHEN lo[2] > 0 THEN v[1] = 0 AND v[2] = lo[2] ELSE v = lo END
  WHEN 1 THEN v <= lo ELSE v <= hi END)
SELECT 'role-' || g AS role, 'pack-' || g AS name, m[1] || '.' || m[2] || '.' || m[3] AS version FROM (SELECT g, max(v) AS m FROM f GROUP BY g)""")
def r83_resolve(spark, sf_dir):
    """Customers as versions of packs, one pack for 64 of them; a requirement of each pack by bounds that its first or last customer sets."""
    key = F.col("c_custkey")
    version = F.concat_ws(".", (key % 3).cast("string"), (key % 7).cast("string"), key.cast("string"))
    g = F.expr("c_custkey div 64")
    rows = table(spark, sf_dir, "customer").select(key, g.alias("g"), F.concat(F.lit("pack-"), g.cast("string")).alias("name"), version.alias("version"))
    columns = {"publisher": "acme", "pack_class": "model", "format": "1.2", "trust_status": "unverified", "key_id": ""}
    listed = rows.select("name", "version", F.sha2(F.concat("name", "version").cast("binary"), 256).alias("sha256"), F.lit(1).cast("bigint").alias("size"), *[F.lit(v).alias(c) for c, v in columns.items()])
    bounds = rows.groupBy("g", "name").agg(F.min_by("version", "c_custkey").alias("lo"), F.max_by("version", "c_custkey").alias("hi"))
    constraint = F.when(F.col("g") % 3 == 0, F.concat(F.lit("^"), "lo")).when(F.col("g") % 3 == 1, F.concat(F.lit("<="), "lo")).otherwise(F.concat(F.lit(">=0.0.0, <="), "hi"))
    asked = bounds.select(F.concat(F.lit("role-"), F.col("g").cast("string")).alias("role"), F.lit("acme").alias("publisher"), "name", constraint.alias("constraint"))
    return registry.resolve(listed, asked).select("role", "name", "version")


#: Cases of signatures by a supplier's key, with their codes.
TRUST_CASES = [("good", 0), ("unsigned", 10), ("other pack", 12), ("unknown key", 14), ("changed", 14), ("revoked", 15)]


def _seeds() -> list[bytes]:
    return [hashlib.sha256(bytes([k])).digest() for k in range(3)]


def _signed():
    good, revoked, unknown = _seeds()

    def fn(data):
        case, sha = data[0], data[1:]
        if case == 1:
            return (None,)
        record = registry.signature_record({3: unknown, 5: revoked}.get(case, good), bytes(32) if case == 2 else sha)
        return (record[:90] + bytes([record[90] ^ 1]) + record[91:] if case == 4 else record,)

    return fn


@query("SELECT s_suppkey, CASE s_suppkey % 6 " + " ".join(f"WHEN {k} THEN {c}" for k, (_, c) in enumerate(TRUST_CASES)) + " END AS trust_code FROM supplier")
def r87_trust(spark, sf_dir):
    """Signatures of a pack for each supplier, made and verified in tasks."""
    sha = F.sha2(F.encode("s_name", "UTF-8"), 256)
    case = F.unhex(F.lpad(F.hex(F.col("s_suppkey") % 6), 2, "0"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", sha.alias("sha256"), F.concat(case, F.unhex(sha)).alias("source"))
    rows = with_kernel(rows, "source", "signature binary", _signed).drop("source")
    keys = [(registry.key_id(ed25519.public_key(s)).hex(), bytearray(ed25519.public_key(s)), k == 1) for k, s in enumerate(_seeds()[:2])]
    return registry.trust(rows, spark.createDataFrame(keys, "key_id string, public_key binary, revoked boolean")).select("s_suppkey", "trust_code")


# --- events ---------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS n FROM documents)
SELECT doc_id, 1 AS sequence, 'encode' AS operation, CASE WHEN n > 4096 THEN 'resource' ELSE 'success' END AS kind, CASE WHEN n > 4096 THEN 9 ELSE 0 END AS status, n AS bytes FROM d
UNION ALL SELECT doc_id, 2, 'decode', 'success', 0, n FROM d WHERE n <= 4096
UNION ALL SELECT doc_id, CASE WHEN n > 4096 THEN 2 ELSE 3 END, 'detect', 'success', 0, n FROM d""")
def r79_operation_events(spark, sf_dir):
    """Numbered events of encoding under a ceiling, decoding and detection of each document; what a limit rejects isn't decoded."""
    limited = engine(limits=Limits(4096))
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = tokenize.detect(tokenize.decode(tokenize.encode_ids(docs, limited), limited), limited)
    n = F.octet_length("text")
    decoded = F.when(F.col("status") == 0, F.col("decode_status"))
    steps = [
        ("encode", F.col("status"), n, F.size("ids")),
        ("decode", decoded, F.size("ids"), F.octet_length("decoded")),
        ("detect", F.when(F.col("detection").isNotNull(), F.lit(0)), n, F.col("detection.matched").cast("int")),
    ]
    got = observer.operation_events(rows, ["doc_id"], steps)
    return got.select("doc_id", "sequence", "operation", "kind", "status", F.when(F.col("operation") == "decode", F.col("output_units")).otherwise(F.col("input_units")).alias("bytes"))
