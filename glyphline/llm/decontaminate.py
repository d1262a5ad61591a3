"""Benchmark items inside documents: size-partitioned MinHash containment search, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, let, materialize, salted_join, small_side, words

WIDTH, PERCENT = 5, 80


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Word shingles (words joined by one space, repeats included); fewer words make one shingle."""

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        return F.when(F.size(w) > 0, F.transform(at, lambda i: F.array_join(F.slice(w, i + 1, F.lit(width)), " "))).otherwise(F.array().cast("array<string>"))

    return let(words(text), of)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """The hashes that MinHash ranks shingles by, one for each place of ``shingles``."""

    def of(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0)))
        return F.when(F.size(h) > 0, F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Bottom-k MinHash sketches of the items: (item, need, hash) rows.

    Items are partitioned by set size into powers of two; an item of a partition whose sizes reach
    up to u keeps its k = floor(u * (100 - percent) / 100) + 1 smallest hashes. Of an item of n
    hashes at most floor(n * (100 - percent) / 100) can be missing from a text that contains
    ``percent`` of them, so that ``need``, the sketch's size less these, is the least number of its
    hashes that such a text holds: the search loses nothing, and k stays a fifth of the partition's
    size.
    """
    sets = items.select(F.col(id_col).alias("__item"), F.array_sort(F.array_distinct(shingle_hashes(F.col(text_col), width))).alias("__set"))
    sets = sets.where(F.size("__set") > 0)
    n = F.size("__set")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int")
    k = F.floor(upper * (100 - percent) / F.lit(100)).cast("int") + 1
    need = F.least(k, n) - F.floor(n * (100 - percent) / F.lit(100)).cast("int")
    rows = sets.select("__item", need.alias("__need"), F.explode(F.slice("__set", F.lit(1), k)).alias("__hash"))
    return rows.groupBy("__item", "__hash").agg(F.min("__need").alias("__need"))


def find_contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Pairs of a document and a test item of whose shingles it holds ``percent`` or more.

    Columns: doc_id, item_id, n_item (the item's distinct shingles), n_shared, containment.

    Every shingle of every document is looked up among the items' sketches (broadcast if their
    counted size allows, else a join on the hash, in which hashes of many places are salted); a
    document that holds as many of a sketch's hashes as its partition and size ask for is a
    candidate. Candidates are then verified by the exact intersection of the shingles' texts,
    documents being read again for candidates only; items of many candidates are salted likewise.

    Words are lower-cased runs between ASCII white space. A text of fewer words than ``width`` is a
    single shingle, so that such an item is found only in a text of the same words. Null and empty
    texts, and rows with a null id, match nothing. Rows that share an id are one document (or
    item): each of them is compared, and a pair's largest overlap is returned. Whole texts are
    searched, however long. Empty tables give an empty result. Other columns of the inputs are not
    used.
    """
    docs = docs.select(F.col(doc_id).alias("__doc"), F.col(text_col).alias("__text")).where("__doc is not null and __text is not null")
    items = items.select(F.col(item_id).alias("__item"), F.col(text_col).alias("__itext")).where("__item is not null and __itext is not null")
    keys = materialize(sketches(items, "__item", "__itext", width, percent), "sketches")

    hashes = docs.select("__doc", F.explode(shingle_hashes(F.col("__text"), width)).alias("__hash"))
    hits = salted_join(hashes, keys, "__hash", "__doc", 32)
    pairs = hits.groupBy("__doc", "__item", "__hash").agg(F.min("__need").alias("__need"))
    pairs = pairs.groupBy("__doc", "__item").agg(F.count("*").alias("__hits"), F.min("__need").alias("__need"))
    pairs = materialize(pairs.where("__hits >= __need").select("__doc", "__item"), "candidates")

    per_item = materialize(items.select("__item", F.array_distinct(shingles(F.col("__itext"), width)).alias("__iset")), "items")
    bytes_ = F.aggregate("__iset", F.lit(64).cast("long"), lambda a, x: a + 16 + F.octet_length(x))
    found = docs.join(small_side(pairs.select("__doc").distinct(), 16), "__doc", "left_semi")
    found = found.select("__doc", F.array_distinct(shingles(F.col("__text"), width)).alias("__dset"))
    both = salted_join(pairs, per_item, "__item", "__doc", bytes_).join(found, "__doc")
    both = both.select("__doc", "__item", F.size("__iset").alias("__n"), F.size(F.array_intersect("__iset", "__dset")).alias("__s"))
    both = both.where(F.col("__s") * 100 >= F.col("__n") * percent)
    both = both.groupBy("__doc", "__item").agg(F.max(F.struct(F.col("__s") / F.col("__n"), "__s", "__n")).alias("__m"))
    return both.select(
        F.col("__doc").alias("doc_id"),
        F.col("__item").alias("item_id"),
        F.col("__m.__n").cast("long").alias("n_item"),
        F.col("__m.__s").cast("long").alias("n_shared"),
        (F.col("__m.__s") / F.col("__m.__n")).alias("containment"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without those that hold a test item; rows with a null id stay."""
    bad = materialize(find_contained(docs, items, **how).select("doc_id").distinct(), "contaminated")
    key = how.get("doc_id", "doc_id")
    name = fresh(docs.columns, "__bad")
    bad = small_side(bad.select(F.col("doc_id").alias(name)), 16)
    return docs.join(bad, F.col(key) == F.col(name), "left_anti")
