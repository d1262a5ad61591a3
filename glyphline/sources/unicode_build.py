"""Unicode tables made from what is installed: the library in Spark's JVM, and the ``regex`` package.

Spark ships a Unicode library whose data gives normalisation, clusters and scripts of one version;
tables state that version. Only sets of code points and a few long strings cross to Python, so that
the driver makes a table in some calls.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from .unicode_sections import BOOLEANS, GCB, INCB, LIMIT_CP, ClusterTables, Mappings, NormalTables, Ranges, SecurityTables

#: Stands between the texts of many code points in one call: nothing composes or reorders across it.
_BETWEEN = "\x01"


def _library(spark: SparkSession):
    return spark._jvm.com.ibm.icu


def unicode_version(spark: SparkSession) -> tuple[int, int, int]:
    v = _library(spark).lang.UCharacter.getUnicodeVersion()
    return v.getMajor(), v.getMinor(), v.getMilli()


def _marked(spark: SparkSession, pattern: str) -> np.ndarray:
    """Whether each code point is in a set."""
    found = _library(spark).text.UnicodeSet(pattern)
    out = np.zeros(LIMIT_CP, bool)
    for k in range(found.getRangeCount()):
        out[found.getRangeStart(k) : found.getRangeEnd(k) + 1] = True
    return out


def _valued(spark: SparkSession, name: str, values: dict[str, int]) -> Ranges:
    per_cp = np.zeros(LIMIT_CP, np.int64)
    for value, number in values.items():
        per_cp[_marked(spark, f"[:{name}={value}:]")] = number
    return Ranges.of(per_cp)


def cluster_tables(spark: SparkSession) -> ClusterTables:
    return ClusterTables(_valued(spark, "GCB", GCB), _valued(spark, "InCB", INCB), Ranges.of(_marked(spark, "[:ExtPict:]").astype(np.int64)), unicode_version(spark))


def security_tables(spark: SparkSession) -> SecurityTables:
    """Scripts in order of name, with ids from 1 on; names have letters alone."""
    u = _library(spark).lang
    kind = u.UProperty.SCRIPT
    low, high = u.UCharacter.getIntPropertyMinValue(kind), u.UCharacter.getIntPropertyMaxValue(kind)
    long = {k: u.UCharacter.getPropertyValueName(kind, k, u.UProperty.NameChoice.LONG) for k in range(low, high + 1)}
    per_cp = np.zeros(LIMIT_CP, np.int64)
    found = {}
    for k, name in long.items():
        mark = _marked(spark, f"[:sc={name}:]")
        plain = "".join(c for c in name.upper() if c.isalpha())
        if mark.any() or plain in ("COMMON", "INHERITED", "UNKNOWN"):
            found[plain] = mark
    names = tuple(sorted(found))
    for k, name in enumerate(names):
        per_cp[found[name]] = k + 1
    per_cp[0xD800:0xE000] = 0
    flags = tuple(Ranges.of(_marked(spark, f"[:{x}:]").astype(np.int64)) for x in BOOLEANS)
    return SecurityTables(names, Ranges.of(per_cp), flags, unicode_version(spark))


def _mapped(cps: list[int], normalize) -> dict[int, tuple[int, ...]]:
    """What each code point becomes, from one call over all of them."""
    texts = normalize(_BETWEEN + _BETWEEN.join(map(chr, cps)) + _BETWEEN).split(_BETWEEN)[1:-1]
    return {c: tuple(map(ord, x)) for c, x in zip(cps, texts, strict=True) if x != chr(c)}


def normal_tables(spark: SparkSession) -> NormalTables:
    """Decompositions in full, composition pairs, combining classes and NFKC_Casefold mappings."""
    n2 = _library(spark).text.Normalizer2
    syllable = range(0xAC00, 0xD7A4)
    picked = lambda p: [c for c in np.flatnonzero(_marked(spark, p)).tolist() if c not in syllable and not 0xD800 <= c < 0xE000]
    canonical = _mapped(picked("[:^NFD_QC=Yes:]"), n2.getNFDInstance().normalize)
    compatible = _mapped(picked("[:^NFKD_QC=Yes:]"), n2.getNFKDInstance().normalize)
    folded = _mapped(picked("[:CWKCF:]"), n2.getNFKCCasefoldInstance().normalize)
    ccc = np.zeros(LIMIT_CP, np.int64)
    u = _library(spark).lang
    for k in range(1, u.UCharacter.getIntPropertyMaxValue(u.UProperty.CANONICAL_COMBINING_CLASS) + 1):
        if u.UCharacter.getPropertyValueName(u.UProperty.CANONICAL_COMBINING_CLASS, k, u.UProperty.NameChoice.SHORT) is not None:
            ccc[_marked(spark, f"[:ccc={k}:]")] = k
    pairs = {}
    nfc, nfd = n2.getNFCInstance(), n2.getNFDInstance()
    whole = [c for c in canonical if len(canonical[c]) > 1]
    composes = nfc.normalize(_BETWEEN + _BETWEEN.join(map(chr, whole)) + _BETWEEN).split(_BETWEEN)[1:-1]
    for c, x in zip(whole, composes, strict=True):
        if x == chr(c):  # others are excluded from composition
            raw = nfd.getRawDecomposition(c)
            pairs[ord(raw[0]) << 32 | ord(raw[1])] = c
    keys = sorted(pairs)
    return NormalTables(Ranges.of(ccc), Mappings.of(canonical), Mappings.of(compatible), Mappings.of(folded), np.array(keys, np.int64), np.array([pairs[k] for k in keys], np.int64), unicode_version(spark))


def regex_cluster_tables(version: tuple[int, int, int]) -> ClusterTables:
    """Tables of the installed ``regex`` package, whose Unicode version the caller states."""
    from ..kernels import text

    def valued(name: str, values: dict[str, int]) -> Ranges:
        per_cp = np.zeros(LIMIT_CP, np.int64)
        for value, number in values.items():
            per_cp[text._mark(rf"\p{{{name}={value}}}")] = number
        return Ranges.of(per_cp)

    return ClusterTables(valued("Grapheme_Cluster_Break", GCB), valued("Indic_Conjunct_Break", INCB), Ranges.of(text._mark(r"\p{Extended_Pictographic}").astype(np.int64)), version)
