"""The pipeline, each stage against a brute-force version of it on the rows that the stage before kept."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from glyphline.llm import byte_bpe
from glyphline.llm.queries import tokenizer
from tests.llm.test_array_ops import _labelled, _oracle_groups
from tests.llm.test_native_ops import _contained, dedup_oracle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _tables(spark, folder):
    rng = random.Random(12)
    docs, labels = _labelled(700, rng)
    docs = [(i, "\n".join(" ".join(t.split()[k : k + 12]) for k in range(0, len(t.split()), 12))) for i, t in docs]
    items = [(k, " ".join(f"i{rng.randrange(900)}" for _ in range(20))) for k in range(6)]
    extra, at = [], 1000
    for _, t in docs[:60]:  # copies, near copies, quoted lines and leaked items
        lines = t.split("\n")
        extra.append((at, t))
        extra.append((at + 1, f"anes ores {at}\n" + "\n".join(lines[:5])))
        changed = [*lines[:-1], lines[-1] + " once"]
        extra.append((at + 2, "\n".join(x + (" odd" if k % 3 == 0 else "") for k, x in enumerate(changed))))
        extra.append((at + 3, f"theor {at}\n{rng.choice(items)[1]} ines {at}"))
        at += 4
    rows = [(i, t, "en", "s", len(t)) for i, t in docs + extra] + [(5000, None, None, None, None), (5001, "", None, "s", 0), (5002, "x", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return labels, items


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path / "tables")
    labels, items = _tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs)
        if name != names[-1]:
            assert docs.columns == corpus_pipeline.COLUMNS
    first = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in kept[:4]]

    bad = lambda t: any(w.startswith(("booz", "bozo")) for w in (t or "").split())
    gone = {i for i, _ in first} - {i for i, _ in rows[0]}
    truth = {i for i, t in first if bad(t)}
    assert len(gone & truth) >= 0.95 * len(truth) and len(gone - truth) <= 0.02 * len(first)

    assert dict(rows[1]) == dedup_oracle(rows[0])
    sizes = {r.doc_id: r.n_chars for r in kept[1].collect()}
    assert all(sizes[i] == len(t) for i, t in rows[1] if t is not None)

    groups = _oracle_groups(rows[1])
    assert sorted(i for i, _ in rows[2]) == sorted(i for i, _, c in groups if i == c)
    assert len(rows[2]) < len(rows[1])

    leaked = {i for i, t in rows[2] if any(_contained(x, t) for _, x in items)}
    assert leaked and sorted(i for i, _ in rows[3]) == sorted(i for i, _ in rows[2] if i not in leaked)

    ranks, pattern = tokenizer()
    codec = byte_bpe.codec(byte_bpe.read_ranks(ranks), pattern)
    texts = dict(rows[3])
    last = kept[4].collect()
    assert sorted(r.doc_id for r in last) == sorted(texts)
    for r in last:
        text = texts[r.doc_id] or ""
        ids = np.array(codec.encoding.encode_ordinary(text), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest()) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    ran = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, last))


def test_stages_on_odd_tables(spark, tmp_path):
    """Null and repeated ids, equal rows, clashing columns, null and very long texts; then tables without rows."""
    import corpus_pipeline

    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "s", 48), (1, text, "en", "s", 48), (None, text, None, None, None), (2, None, "en", "s", None), (3, "", "en", "s", 0), (4, "long word " * 30000, "en", "s", 1), (5, text + " leaked item of the benchmark here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "leaked item of the benchmark here"), (None, "x"), (2, None), (2, "")], "item_id long, text string")
    for n, (d, lab, it) in enumerate(((docs, labels, items), (docs, labels.limit(0), items.limit(0)), (docs.limit(0), labels, items), (docs.limit(0), labels.limit(0), items.limit(0)))):
        folder = str(tmp_path / f"odd{n}")
        d.write.parquet(f"{folder}/documents.parquet")
        lab.write.parquet(f"{folder}/labels.parquet")
        it.write.parquet(f"{folder}/benchmark.parquet")
        odd = spark.read.parquet(f"{folder}/documents.parquet").withColumn("__drop", F.lit(1)).withColumn("score", F.lit("x")).withColumn("n_removed", F.lit("y"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, odd, folder).columns == corpus_pipeline.COLUMNS, name
        got = sorted((r.doc_id for r in corpus_pipeline.run(spark, folder).collect()), key=str)
        # the copy of 1 has the same id, so that both rows stay; a row without an id is never dropped
        assert got == {0: [1, 1, 2, 3, 4, None], 1: [1, 1, 2, 3, 4, 5, None]}.get(n, [])
