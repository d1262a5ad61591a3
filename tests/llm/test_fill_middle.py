"""Fill-in-middle: ropes against plain slices, rows against a direct computation, the way back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from glyphline.llm import fill_middle as fim
from tests.conftest import compare_with_duckdb

SCHEMA = "doc_id long, text string, output string, form string, n int"


def _units(text: str, unit: str) -> list[str]:
    return re.findall({"chars": r"(?s).", "words": r"^[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*", "lines": r"[^\n]*\n|[^\n]+"}[unit], text)


def _direct(doc_id, text, unit="chars"):
    """Form, sizes and output by slicing a list of units."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = text or ""
    units = _units(text, unit)
    n = len(units)
    if not text or any(m in text for m in fim.SENTINELS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", fim.UNITS)
def test_rope_splits_and_joins(unit):
    rng = random.Random(3)
    for k in range(60):
        text = "".join(rng.choice("ab é😀漢 \n\t") for _ in range(rng.randrange(1, 300)))
        units = _units(text, unit)
        rope = fim.Rope.of(text.encode(), unit, leaf=rng.choice((1, 3, 7, 64)))
        assert fim.Rope.counts(rope) == (len(units), len(text))
        for _ in range(5):
            a, b = sorted(rng.randrange(len(units) + 1) for _ in range(2))
            head, tail = rope.split(b)
            first, middle = head.split(a) if head else (None, None)
            assert [fim.Rope.text(x).decode() for x in (first, middle, tail)] == ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])], (k, text)
            rope = fim.Rope.concat(fim.Rope.concat(first, middle), tail)
            assert fim.Rope.text(rope).decode() == text and fim.Rope.counts(rope) == (len(units), len(text))
            assert rope.height <= 2 * len(text.encode()).bit_length() + 2  # stays balanced


@pytest.mark.parametrize("unit", fim.UNITS)
def test_rows_and_way_back(spark, unit):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("xy é😀\n<PSM>") for _ in range(rng.randrange(0, 90)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "a<P>b"), (503, "<M>"), (504, "<S"), (505, "word é😀 line\n" * 40_000), (None, "no id"), (1, rows[1][1]), (506, " "), (507, "<"), (508, "\u0000x")]
    docs = spark.createDataFrame([(i, t, "clash", "clash", 7) for i, t in rows], SCHEMA)
    made = fim.fill_middle(docs, unit=unit, leaf=64)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = fim.restore_texts(made.withColumn("restored", F.lit(1)).withColumn("extra", F.lit("kept")))
    got = back.collect()
    assert sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(str(_direct(i, t, unit)) for i, t in rows)
    texts = sorted((str(i), t or "") for i, t in rows)
    assert sorted((str(r.doc_id), r.restored) for r in got) == texts and all(r.extra == "kept" for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_sentinels_and_odd_outputs(spark):
    for bad in (("", "a", "b"), ("x", "x", "y"), ("<a>", "<a>b", "c"), ("aba", "x", "y"), ("xa", "ay", "z"), ("a", "b")):
        with pytest.raises(ValueError):
            fim.check_sentinels(bad)
    docs = spark.createDataFrame([(i, f"text {i} of é words <P>", None, None, 0) for i in range(50)], SCHEMA)
    own = ("⟨p⟩", "[s]", "{m}")
    made = fim.fill_middle(docs, sentinels=own, rate=100, suffix_first=50)
    assert {r.form for r in made.collect()} == {"psm", "spm"}
    assert all(r.restored == f"text {r.doc_id} of é words <P>" for r in fim.restore_texts(made, own).collect())
    odd = spark.createDataFrame([("psm", "no sentinel"), (None, "as it is"), ("spm", None), ("plain", "")], "form string, output string")
    assert {(r.form, r.output): r.restored for r in fim.restore_texts(odd).collect()} == {("psm", "no sentinel"): None, (None, "as it is"): "as it is", ("spm", None): None, ("plain", ""): ""}
    with pytest.raises(ValueError):
        fim.fill_middle(docs, unit="pages")
    assert fim.restore_texts(fim.fill_middle(docs.limit(0))).count() == 0


def test_query_against_sql(spark):
    got, want = compare_with_duckdb(spark, "op11_fill_middle")
    assert got == want
