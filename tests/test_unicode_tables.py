"""Unicode tables of containers: written, read, refused, and what they decide against other implementations."""

import hashlib
import random
import unicodedata

import numpy as np
import pytest

from glyphline.kernels import columns, text
from glyphline.kernels import unicode_tables as ut
from glyphline.kernels.vocab import PackError
from glyphline.operators import unicode
from glyphline.sources import packs
from glyphline.sources import unicode_build as ub
from glyphline.sources import unicode_sections as us


@pytest.fixture(scope="module")
def made(spark):
    """Tables as they come back from containers."""
    return (
        us.read_clusters(us.write_clusters(ub.cluster_tables(spark))),
        us.read_security(us.write_security(ub.security_tables(spark))),
        us.read_normal(us.write_normal(ub.normal_tables(spark))),
    )


def _texts(n, seed=1, longest=24):
    rng = random.Random(seed)
    pool = [*range(32, 0x3000), *range(0xAC00, 0xAC80), *range(0xF900, 0xFB50), *range(0x1D15E, 0x1D170), *[0x1F468, 0x200D, 0x1F1E6, 0x1F1E7, 0x1F3FB] * 8, *[0x300, 0x301, 0x323, 0x327, 0x345] * 40]
    pool += [*range(0xD8C, 0xDDF)] * 3 + [*range(0xCC0, 0xCD8)] * 3 + [*range(0x1100, 0x1200)] * 2 + [*range(0x915, 0x950)] * 3 + [10, 13] * 5
    pool = [c for c in pool if unicodedata.category(chr(c)) != "Cn"]
    return ["".join(chr(rng.choice(pool)) for _ in range(rng.randrange(1, longest))) for _ in range(n)]


def test_numbers_of_the_published_version(made):
    """Unicode 16: classes, mappings and pairs are as many as that version's tables have."""
    clusters, security, normal = made
    assert clusters.version == security.version == normal.version == (16, 0, 0)
    assert [len(x) for x in (normal.ccc, normal.canonical, normal.compatible, normal.folded, normal.pairs)] == [393, 2081, 5913, 10554, 961]
    assert [len(x) for x in security.flags] == [4, 17, 18, 8] and {"COMMON", "INHERITED", "UNKNOWN", "LATIN", "HAN"} <= set(security.names)


def test_containers_are_written_alike_and_checked(spark, made):
    for t, write, read, kind in zip(made, (us.write_clusters, us.write_security, us.write_normal), (us.read_clusters, us.read_security, us.read_normal), (5, 7, 8), strict=True):
        data = write(t)
        assert write(read(data)) == data and [k for k, _ in packs.scan(data)] == [1, 2, kind]
        section = packs.section(data, kind)
        rng = random.Random(kind)
        refused = 0
        for _ in range(60):  # bytes changed within the header and the first tables, in containers that are otherwise good
            at = rng.randrange(min(len(section), 600))
            bad = packs.wrap(kind, section[:at] + bytes([section[at] ^ 0xFF]) + section[at + 1 :])
            try:
                read(bad)
            except PackError:
                refused += 1
        assert refused > 25
        for cut in (0, 10, 60, len(section) - 1):
            with pytest.raises(PackError):
                read(packs.wrap(kind, section[:cut]))
        with pytest.raises(PackError):
            read(packs.wrap(9, section))


@pytest.mark.parametrize("mode", ["NFC", "NFD", "NFKC", "NFKD", "NFKC_CASEFOLD"])
def test_normalisation_against_the_library(spark, made, mode):
    texts = _texts(2000)
    n2 = spark._jvm.com.ibm.icu.text.Normalizer2
    one = {"NFC": n2.getNFCInstance, "NFD": n2.getNFDInstance, "NFKC": n2.getNFKCInstance, "NFKD": n2.getNFKDInstance, "NFKC_CASEFOLD": n2.getNFKCCasefoldInstance}[mode]()
    want = one.normalize("\x01" + "\x01".join(texts) + "\x01").split("\x01")[1:-1]
    got = ut.normalized_bytes(made[2], mode, columns.Batch([t.encode() for t in texts]))
    assert [g.decode() for g in got] == want


@pytest.mark.parametrize("mode", text.MODES)
def test_views_against_the_form_of_one_source(made, mode):
    sources = [t.encode() for t in _texts(150, 2)]
    sources += [s + b"\xff\xcc" + s[:3] for s in sources[:60]] + [b"", b"A\xffe\xcc\x81\xed\xa0\x80", "̣́x".encode()]
    out, per, (at, size), counts, (start, length) = ut.views(made[2], mode, columns.Batch(sources))
    unit = span = 0
    for k, data in enumerate(sources):
        want, units = text.normalize_view(data, mode)
        mine = []
        for _ in range(per[k]):
            c = counts[unit]
            mine.append((int(at[unit]), int(size[unit]), list(zip(start[span : span + c].tolist(), length[span : span + c].tolist(), strict=True))))
            unit, span = unit + 1, span + c
        assert (out[k], mine) == (want, units)


def test_clusters_against_the_library(spark, made):
    texts = [*_texts(300, 3), "क्ष", "👩‍👩‍👧", "🇦🇧🇨", "a\r\nb", "क्", "‍👩"]
    b = columns.Batch([t.encode() for t in texts])
    first = ut.cluster_starts(made[0], b)
    seek = spark._jvm.com.ibm.icu.text.BreakIterator.getCharacterInstance(spark._jvm.java.util.Locale.ROOT)
    for k, t in enumerate(texts):
        seek.setText(t)
        want = {0}
        while (p := seek.next()) != -1:
            want.add(p)
        place = np.concatenate(([0], np.cumsum([2 if ord(c) > 0xFFFF else 1 for c in t])))
        mine = first[(first >= b.edges[k]) & (first < b.edges[k + 1])] - b.edges[k]
        assert {int(place[i]) for i in mine} | {int(place[-1])} == want
    odd = columns.Batch([b"a\xffb\xcc\x81\xcc", b"", b"\xcc\x81"])
    assert odd.local(ut.cluster_starts(made[0], odd)).tolist() == [0, 1, 2, 5, 0]


def test_clusters_of_the_packages_tables(made):
    """The same rules with the tables of another version give what its own implementation gives."""
    b = columns.Batch([t.encode() for t in _texts(400, 4)] + [b"\xff\xcc\x81"])
    tables = us.read_clusters(us.write_clusters(ub.regex_cluster_tables((17, 0, 0))))
    assert tables.version == (17, 0, 0) and np.array_equal(ut.cluster_starts(tables, b), columns.clusters(b))


def test_findings(made):
    """Golden case: Latin and Cyrillic letters, a bidi control and an ignorable."""
    b = columns.Batch([b"A\xd0\x96\xe2\x80\xae\xe2\x80\x8b", b"plain", b"\xff", "￾ŉ".encode()])
    (kind, script, start, length), per = ut.findings(made[1], b)
    name = lambda k: made[1].names[k - 1]
    rows = [(int(k), name(s), int(a), int(n)) for k, s, a, n in zip(kind, script, start, length, strict=True)]
    # one unit of each script: the one of the lower id is the primary
    assert rows[:4] == [(5, "LATIN", 0, 1), (1, "COMMON", 3, 3), (2, "COMMON", 3, 3), (2, "COMMON", 6, 3)]
    assert rows[4:] == [(3, "UNKNOWN", 0, 3), (4, "LATIN", 3, 2)] and per.tolist() == [4, 0, 0, 2]


def test_operators(spark, made):
    clusters, security, normal = made
    rows = [(1, "é ﬁ"), (2, None), (3, ""), (4, "AЖ‮")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r for r in unicode.graphemes(df, tables=clusters).collect()}
    assert [tuple(x) for x in got[1].graphemes] == [(0, 3), (3, 1), (4, 3)] and got[2].graphemes is None and got[3].graphemes == []
    assert {r.id: r.n_graphemes for r in unicode.grapheme_counts(df, tables=clusters).collect()} == {1: 3, 2: None, 3: 0, 4: 3}
    view = {r.id: r for r in unicode.normalized_view(df, "NFKC", tables=normal).collect()}
    assert bytes(view[1].normalized) == "é fi".encode() and [[tuple(s) for s in u.spans] for u in view[1].units] == [[(0, 3)], [(3, 1)], [(4, 3)], [(4, 3)]]
    assert view[2].normalized is None and view[2].units is None and view[3].units == []
    assert {r.id: r.normalized_sha256 for r in unicode.normalized_digests(df, "NFC", tables=normal).collect()}[1] == hashlib.sha256("é ﬁ".encode()).hexdigest()
    assert bytes(unicode.normalize(df, "NFD", tables=normal).where("id = 1").first().normalized) == "é ﬁ".encode()
    found = {r.id: r.findings for r in unicode.table_findings(df, security).collect()}
    assert found[2] is None and found[3] == [] and sorted(f.kind for f in found[4]) == [1, 2, 5]
    names = {r.script_id: r.script for r in unicode.table_scripts(spark, security).collect()}
    assert {names[f.script_id] for f in found[4]} <= {"LATIN", "CYRILLIC", "COMMON"}
    with pytest.raises(ValueError):
        unicode.normalize(df, "NFX", tables=normal)
