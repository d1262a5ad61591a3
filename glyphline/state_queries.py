"""Queries of configuration files, stores, records and counters; registered with the others."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from .config import Engine, Limits
from .kernels import records
from .kernels.vocab import Language, PackError, base_vocabulary
from .operators import archive, document, metrics, registry, tokenize, unicode
from .operators import store as store_module
from .plans.kernel import with_kernel
from .queries import _DOCS, _FLAGS, SQL, _folder, documents, engine, planted_docs, query, table
from .sources import formats, packs, readers, unicode_build, unicode_sections


def _header():
    def fn(data):
        try:
            x = packs.parse_test_header(data)
        except PackError as e:
            return e.status, None, None
        return 0, x["sections"], x["test"]

    return fn


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) % 2 = 0 THEN 0 ELSE 3 END AS header_status, CASE WHEN octet_length(encode(text)) % 2 = 0 THEN doc_id % 7 ELSE -1 END AS sections FROM documents")
def r03_test_headers(spark, sf_dir):
    """A short header before each text; those of texts of an odd size name a wrong length."""
    le = lambda n, size: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), 2 * size, "0"), F.lit("(..)"))), ""))
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    n = F.octet_length(data)
    head = F.concat(F.lit(bytearray(packs.MAGIC)), le(F.lit(1), 2), le(F.lit(0), 2), le(F.lit(32), 2), le(F.lit(1), 2), le((n + 32 + n % 2).cast("bigint"), 8), le(F.col("doc_id") % 7, 4), le(F.lit(0), 4))
    rows = documents(spark, sf_dir).select("doc_id", F.concat(head, data).alias("source"))
    return with_kernel(rows, "source", "header_status int, sections bigint, test boolean", _header).select("doc_id", "header_status", F.coalesce("sections", F.lit(-1)).alias("sections"))


#: SHA-256 of the containers of the built-in languages; fixed values.
LANGUAGE_FILES = {
    "en": (372, "75179427e58eeade21cfa70d5ea1af127a497a849f55d6cb6e915a421c104551"),
    "hi": (373, "309fdd7db255d9dd5ba704c095805e7049a08fae0f9bb8655edaab100b142e9e"),
    "ja": (357, "7abcebfa000d09583190edd33bb6833245fa79c2c0977ba2743d83f3e83aa9e3"),
}


@query(f"""WITH h AS (SELECT doc_id, unhex(sha256(text)) AS h FROM ({_DOCS})), b AS (SELECT doc_id, unnest(regexp_extract_all(hex(h), '..')) AS b FROM h)
SELECT doc_id, count(*) AS n_tokens, sum((b = '20')::INT)::BIGINT AS n_spaces, max(instr('0123456789ABCDEF', b[1]) * 16 + instr('0123456789ABCDEF', b[2]) - 17)::BIGINT AS largest_byte FROM b GROUP BY doc_id""")
def r24_byte_fallback(spark, sf_dir):
    """Bytes that are in no surface are tokens of their own: the digest of each text, cut where anything longer could stand."""
    sha = F.sha2(F.encode("text", "UTF-8"), 256)
    rows = planted_docs(spark, sf_dir).select("doc_id", F.unhex(sha).alias("source"))
    only = base_vocabulary()
    only = type(only)(tuple(r for r in only.rows if len(r[2]) == 1), only.algorithm)
    got = tokenize.encode_tokens(rows, Engine(only).seal(), "source")
    byte = F.transform("tokens", lambda t: F.when(t["id"] == 262, F.lit(32).cast("bigint")).otherwise(t["id"]))
    spaces = F.size(F.filter("tokens", lambda t: t["id"] == 262)).cast("bigint")
    return got.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), spaces.alias("n_spaces"), F.array_max(byte).alias("largest_byte"))


@query(f"SELECT doc_id, length(text) + 2 AS n_units, 2::BIGINT AS n_invalid FROM ({_DOCS})")
def r37_units(spark, sf_dir):
    """Code points of each text between two bytes that aren't UTF-8."""
    odd = F.lit(bytearray(b"\xff"))
    rows = planted_docs(spark, sf_dir).select("doc_id", F.concat(odd, F.encode("text", "UTF-8"), F.lit(bytearray(b"\xc3"))).alias("source"))
    return unicode.unit_counts(rows, "source").select("doc_id", "n_units", "n_invalid")


_RANGES = [(0x30, 0x3A, "digit"), (0x41, 0x5B, "capital"), (0x61, 0x7B, "small"), (0xC0, 0x250, "latin"), (0x900, 0x980, "devanagari"), (0x3040, 0x3100, "kana")]


@query(f"""WITH c AS (SELECT unicode(unnest(string_split(text, ''))) AS cp FROM ({_DOCS}))
SELECT coalesce(value, 'none') AS value, count(*) AS n FROM c LEFT JOIN (VALUES {', '.join(f"({a}, {z}, '{v}')" for a, z, v in _RANGES)}) AS r(a, z, value) ON cp >= a AND cp < z GROUP BY ALL""")
def r39_range_lookup(spark, sf_dir):
    """Characters of all texts by the range that they are in, looked up once for each different one."""
    points = planted_docs(spark, sf_dir).select(F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy(F.ascii("c").alias("cp")).agg(F.count("*").alias("k"))
    ranges = spark.createDataFrame(_RANGES, "start int, end int, value string")
    got = unicode.range_lookup(points, ranges)
    return got.groupBy(F.coalesce("value", F.lit("none")).alias("value")).agg(F.sum("k").alias("n"))


@query(f"""SELECT doc_id, least(n, 1) AS n_visited, n > 1 AS stopped FROM (
  SELECT doc_id, len(regexp_extract_all(text, '{_FLAGS[0][1]}')) + len(regexp_extract_all(text, '{_FLAGS[1][1]}')) AS n FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F\\x{{00AD}}\\x{{200B}}\\x{{200D}}\\x{{202E}}]', '', 'g') AS text FROM ({_DOCS})))""")
def r43_security_visit(spark, sf_dir):
    """A visitor that stops after a text's first finding; only ASCII and what may be hidden in it is left of each text."""
    text = F.regexp_replace("text", "[^\\x00-\\x7F\\x{00AD}\\x{200B}\\x{200D}\\x{202E}]", "")
    rows = planted_docs(spark, sf_dir).select("doc_id", text.alias("text"))
    return unicode.security_visit(rows, 1).select("doc_id", "n_visited", "stopped")


@query("SELECT (doc_id % 3)::INT AS part, count(*) AS n_found FROM documents WHERE doc_id % 5 <> 0 GROUP BY ALL")
def r64_cache_table(spark, sf_dir):
    """Texts put into a cache table, every fifth removed again, the rest found by their keys."""
    cache = document.CacheTable(spark, _folder(spark, "cache"))
    docs = documents(spark, sf_dir).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    rows = document.cache_records(docs)
    cache.put(rows)
    cache.put(rows)
    cache.remove(rows.where("doc_id % 5 = 0"))
    found = cache.get(rows.select("cache_key")).where("cache_status = 0")
    part = F.element_at(F.split(F.decode("cache_value", "UTF-8"), " "), 1).cast("bigint") % 3
    return found.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n_found"))


@query("SELECT name, value FROM (SELECT unnest(['decode_failures', 'decode_operations', 'failures', 'input_bytes', 'limit_rejections', 'operations', 'output_bytes']) AS name, unnest([0, count(*), count(*) FILTER (n > 4096), sum(n), count(*) FILTER (n > 4096), count(*), sum(n) FILTER (n <= 4096)])::BIGINT AS value FROM (SELECT coalesce(octet_length(encode(text)), 0) AS n FROM documents))")
def r78_counters(spark, sf_dir):
    """Counters of encoding all documents under a ceiling and of decoding what was encoded."""
    limited = engine(limits=Limits(4096))
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    encoded, first = metrics.observed(tokenize.encode_ids(docs, limited))
    decoded, second = metrics.observed_decode(tokenize.decode(encoded.select("doc_id", "ids"), limited))
    decoded.write.format("noop").mode("overwrite").save()
    totals = json.loads(metrics.Totals().add(first).add(second).snapshot())
    totals["decode_operations"] = int(totals["decode_operations"])
    rows = sorted((k, v) for k, v in totals.items() if k != "output_tokens")
    return spark.createDataFrame(rows, "name string, value bigint")


@query("SELECT c_mktsegment AS name, count(*) AS n, sha256(string_agg(c_name, chr(10) ORDER BY c_name)) AS names_sha256 FROM customer GROUP BY c_mktsegment")
def r84_catalog_list(spark, sf_dir):
    """A catalog of one pack for each customer, listed by publisher; its hash doesn't depend on the order of rows."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("publisher"), F.col("c_name").alias("name"))
    return rows.groupBy(F.col("publisher").alias("name")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("name")), "\n"), 256).alias("names_sha256"))


@query("""WITH r AS (SELECT sha256(concat('{"name":"', c_name, '","publisher":"', c_mktsegment, '","version":"1.0.', c_custkey, '"}')) AS h FROM customer),
b AS (SELECT h[1:3] AS bucket, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM r GROUP BY ALL)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(concat(bucket, ':', digest), chr(10) ORDER BY concat(bucket, ':', digest))) AS catalog_sha256 FROM b""")
def r84_catalog_hash(spark, sf_dir):
    """The hash of a catalog of one pack for each customer, by a tree of digests."""
    version = F.concat(F.lit("1.0."), F.col("c_custkey").cast("string"))
    return registry.catalog_root(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("publisher"), version.alias("version")))


def _language_file():
    def fn(words):
        deltas = {}
        for line in words.decode().split("\n"):
            word, n = line.split("\t")
            deltas[word.encode()] = -int(n)
        return (packs.write_language(Language("brand", tuple(deltas.items()))),)

    return fn


def _language_sums():
    def fn(body):
        x = packs.read_language(packs.wrap(packs.LANGUAGE, body))
        return len(x.deltas), sum(d for _, d in x.deltas), max(len(s) for s, _ in x.deltas)

    return fn


@query("""WITH w AS (SELECT p_brand AS brand, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT brand, count(DISTINCT word) AS n_surfaces, -count(*) AS total, max(octet_length(encode(word))) AS longest FROM w WHERE word <> '' GROUP BY brand""")
def r02_pack_sections(spark, sf_dir):
    """A language container for each brand of parts, written in tasks under a commit; its sections read with a pushed kind."""
    formats.register(spark)
    words = table(spark, sf_dir, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("word")).where("word <> ''")
    counted = words.groupBy("p_brand", "word").agg(F.count("*").alias("n"))
    # a brand's row grows with its different words alone
    lists = counted.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", "word", F.col("n").cast("string")))), "\n").alias("words"))
    made = with_kernel(lists, "words", "content binary", _language_file)
    folder = _folder(spark, "packs")
    made.select(F.concat(F.regexp_replace("p_brand", "#", "-"), F.lit(".pack")).alias("path"), "content").write.format("glyphline_files").mode("append").save(folder)
    sections = spark.read.format("glyphline_pack").load(folder).where(F.col("kind") == packs.LANGUAGE)
    got = with_kernel(sections, "body", "n_surfaces bigint, total bigint, longest bigint", _language_sums)
    return got.select(F.regexp_replace(F.regexp_extract("path", "([^/]+)[.]pack$", 1), "-", "#").alias("brand"), "n_surfaces", "total", "longest")




def _fought(places: int):
    def fn(data):
        keys = [hashlib.sha256(bytes([k])).digest() for k in range(3)]
        cache = records.LruCache(places)
        for key in keys:
            cache.put(key, data[20:])
        got = cache.get(keys[int(data[:20]) % 3])
        return got is not None, None if got is None else hashlib.sha256(got).hexdigest()

    return fn


@query("SELECT doc_id, doc_id % 3 <> 0 AS found, CASE WHEN doc_id % 3 <> 0 THEN sha256(text) END AS value FROM documents WHERE text IS NOT NULL")
def r62_lru_cache(spark, sf_dir):
    """A bounded cache for each document, in which three entries fight for two places; the last two stay."""
    docs = documents(spark, sf_dir).where("text is not null")
    rows = docs.select("doc_id", F.encode(F.concat(F.lpad(F.col("doc_id").cast("string"), 20, "0"), "text"), "UTF-8").alias("source"))
    return with_kernel(rows, "source", "found boolean, value string", _fought, 2).select("doc_id", "found", "value")


@query("SELECT concat('d/', doc_id) AS path, true AS restored, octet_length(encode(text)) AS n_bytes FROM documents WHERE text IS NOT NULL AND doc_id % 4 <> 3 UNION ALL SELECT concat('d/', doc_id), false, -1 FROM documents WHERE text IS NOT NULL AND doc_id % 4 = 3")
def r11_archive_restore(spark, sf_dir):
    """Documents as archive entries written to files, but for those that don't agree with their CRC."""
    root, report = _folder(spark, "restored"), _folder(spark, "report")
    content = F.encode("text", "UTF-8")
    wrong = (F.col("doc_id") % 4 == 3).cast("bigint")
    rows = documents(spark, sf_dir).where("text is not null").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length(content).cast("bigint").alias("size"), (F.crc32(content) + wrong).alias("crc32"), content.alias("content"))
    archive.restore(rows, root).write.parquet(report)
    done = archive.file_sizes(spark.read.parquet(report).select("path", "restored"), root)
    return done.select("path", "restored", F.coalesce("n_bytes", F.lit(-1)).alias("n_bytes"))


def _from_packed():
    import numpy as np

    return lambda data: (np.frombuffer(data, "<u4").astype(np.int64),)


@query(f"""SELECT doc_id, octet_length(encode(text)) AS n_bytes, true AS exact, 0::BIGINT AS encoded_again FROM ({_DOCS})""")
def r64_cached_encoding(spark, sf_dir):
    """Texts encoded through a cache, twice: the second run encodes nothing, and its ids decode to the texts."""
    store, rows, own = document.CacheTable(spark, _folder(spark, "pieces")), planted_docs(spark, sf_dir), engine("en")
    store_module.encode_cached(rows.select("doc_id", "text"), own, store, ["doc_id"])
    out, counts = store_module.encode_cached(rows.select("doc_id", "text"), own, store, ["doc_id"])
    ids = with_kernel(out.select("doc_id", "packed_ids"), "packed_ids", "ids array<bigint>", _from_packed).select("doc_id", "ids")
    digest = lambda data: F.unhex(F.sha2(data, 256))  # noqa: E731  texts meet by their digests
    got = tokenize.decode(ids, own).select(F.col("doc_id").alias("__d"), digest(F.col("decoded")).alias("decoded"))
    data = F.encode("text", "UTF-8")
    both = rows.select("doc_id", F.octet_length(data).alias("n_bytes"), digest(data).alias("source")).join(got, F.col("doc_id") == F.col("__d"))
    return both.select("doc_id", "n_bytes", (F.col("decoded") == F.col("source")).alias("exact"), F.lit(counts["encoded"]).cast("bigint").alias("encoded_again"))


# --- Unicode tables of containers -----------------------------------------------------------------


def _clusters(spark):
    """Tables of clusters, written as a container and read back."""
    return unicode_sections.read_clusters(unicode_sections.write_clusters(unicode_build.cluster_tables(spark)))


def _normal(spark):
    return unicode_sections.read_normal(unicode_sections.write_normal(unicode_build.normal_tables(spark)))


@query(SQL["r38_graphemes"])
def r38_graphemes_tables(spark, sf_dir):
    """Clusters by the tables of a section, all rules over whole batches."""
    return unicode.grapheme_counts(planted_docs(spark, sf_dir), tables=_clusters(spark)).select("doc_id", "n_graphemes")


@query(SQL["r42_security"])
def r42_security_tables(spark, sf_dir):
    both = planted_docs(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    tables = unicode_sections.read_security(unicode_sections.write_security(unicode_build.security_tables(spark)))
    found = unicode.table_findings(both, tables).select(F.explode("findings.kind").alias("kind"))
    return found.groupBy("kind").agg(F.count("*").alias("n"))


@query(SQL["r44_normalize_nfc"])
def r44_nfc_tables(spark, sf_dir):
    return unicode.normalized_digests(planted_docs(spark, sf_dir), "NFC", tables=_normal(spark)).select("doc_id", "normalized_sha256")


@query(SQL["r44_normalize_casefold"])
def r44_casefold_tables(spark, sf_dir):
    return unicode.normalized_digests(planted_docs(spark, sf_dir), "NFKC_CASEFOLD", tables=_normal(spark)).select("doc_id", "normalized_sha256")
