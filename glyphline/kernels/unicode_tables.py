"""Clusters, scripts, findings and normalised views of many sources at once, from Unicode tables.

All sources of a batch are one array of code points; tables are looked up whole. What a
rule needs of what stands further away (the last consonant, how many regional indicators) is carried
along by running maxima and sums.
"""

from __future__ import annotations

import numpy as np

from . import text
from .columns import Batch

# Hangul syllables and the letters that they are made of.
_L, _V, _T, _S = 0x1100, 0x1161, 0x11A7, 0xAC00
_LS, _VS, _TS = 19, 21, 28
# End of fixed values.


def _edges(b: Batch) -> np.ndarray:
    """Whether a unit is its source's first."""
    out = np.zeros(len(b.cps), bool)
    out[b.edges[:-1][b.edges[:-1] < len(b.cps)]] = True
    return out


def _last(mark: np.ndarray) -> np.ndarray:
    """For each place the last one at or before it that is marked, -1 for none."""
    return np.maximum.accumulate(np.where(mark, np.arange(len(mark)), -1)) if len(mark) else np.zeros(0, np.int64)


def _before(values: np.ndarray, fill: int) -> np.ndarray:
    """Each place's predecessor."""
    return np.concatenate(([fill], values[:-1])) if len(values) else values


def cluster_starts(t, b: Batch) -> np.ndarray:
    """First units of the extended grapheme clusters of all sources, by the tables ``t``.

    A byte that isn't UTF-8 is a cluster of its own.
    """
    from ..sources.unicode_sections import GCB, INCB

    n = len(b.cps)
    if not n:
        return np.zeros(0, np.int64)
    bad, edge = text.is_invalid(b.cps), _edges(b)
    look = lambda r: np.where(bad, 0, r.look(b.cps))
    g, c, picture = look(t.gcb), look(t.incb), look(t.pictographic) > 0
    sets = {}

    def of(values, *names):
        if names not in sets:
            sets[names] = np.zeros(len(GCB) + 1, bool)
            sets[names][[GCB[x] for x in names]] = True
        return sets[names][values]

    a = _before(g, 0)
    first = np.flatnonzero(edge)[np.cumsum(edge) - 1]  # of the unit's source

    joined = of(a, "L") & of(g, "L", "V", "LV", "LVT") | of(a, "LV", "V") & of(g, "V", "T") | of(a, "LVT", "T") & of(g, "T")
    joined |= of(g, "Extend", "ZWJ", "SpacingMark") | of(a, "Prepend")
    # a consonant behind another, with linkers and extenders alone in between, one linker at least
    carried = np.isin(c, (INCB["Extend"], INCB["Linker"]))
    linkers = np.cumsum(c == INCB["Linker"])
    anchor = _before(_last(~carried), -1)
    safe = np.maximum(anchor, 0)
    joined |= (c == INCB["Consonant"]) & (anchor >= first) & (c[safe] == INCB["Consonant"]) & (_before(linkers, 0) > linkers[safe])
    # a pictograph behind a joiner whose extenders follow another pictograph
    base = _before(_before(_last(~of(g, "Extend")), -1), -1)
    joined |= picture & of(a, "ZWJ") & (base >= first) & picture[np.maximum(base, 0)]
    # regional indicators in pairs
    flag = of(g, "Regional_Indicator")
    run = np.maximum(_before(_last(~flag), -1), first - 1)
    joined |= flag & of(a, "Regional_Indicator") & ((np.arange(n) - 1 - run) % 2 == 1)

    hard = of(a, "Control", "CR", "LF") | of(g, "Control", "CR", "LF")
    joined = np.where(hard, of(a, "CR") & of(g, "LF"), joined) & ~bad & ~_before(bad, 0).astype(bool) & ~edge
    return np.flatnonzero(~joined)


def script_ids(t, b: Batch) -> np.ndarray:
    """Script id of each unit; 0 for bytes that aren't UTF-8 and code points of no range."""
    return np.where(text.is_invalid(b.cps), 0, t.scripts.look(b.cps))


def findings(t, b: Batch) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns kind, script id, start, length of all findings in order, and how many each source has."""
    ids, bad = script_ids(t, b), text.is_invalid(b.cps)
    n, width = len(b.sources), len(t.names) + 1
    other = [0, *(k + 1 for k, x in enumerate(t.names) if x in ("COMMON", "INHERITED", "UNKNOWN"))]
    real = ~np.isin(ids, other)
    counts = np.bincount(b.owner[real] * width + ids[real], minlength=n * width).reshape(n, width)
    several, primary = (counts > 0).sum(1) > 1, counts.argmax(1)
    mixed = real & several[b.owner] & (ids != primary[b.owner])
    hits = [np.flatnonzero((f.look(b.cps) > 0) & ~bad) for f in t.flags] + [np.flatnonzero(mixed)]
    kinds = np.repeat(np.arange(1, 6), [len(h) for h in hits])
    at = np.concatenate(hits)
    order = np.lexsort((kinds, at))
    at, kinds = at[order], kinds[order]
    return [kinds, ids[at], b.local(at), b.lengths[at]], b.per_source(at)


# --- normalisation --------------------------------------------------------------------------------


def _hangul(cps: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Syllables taken apart by arithmetic."""
    at = cps - _S
    hit = (at >= 0) & (at < _LS * _VS * _TS)
    if not hit.any():
        return cps, source
    tail = at % _TS
    size = np.where(hit, 2 + (tail > 0), 1)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    whole, s = np.repeat(hit, size), np.repeat(at, size)
    letters = np.choose(place, [_L + s // (_VS * _TS), _V + s % (_VS * _TS) // _TS, _T + s % _TS])
    return np.where(whole, letters, np.repeat(cps, size)), np.repeat(source, size)


def _pairs(t, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What a and b compose to, 0 for nothing."""
    out = np.zeros(len(a), np.int64)
    if len(t.pairs):
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
        out = np.where(t.pairs[at] == key, t.composed[at], 0)
    lead, vowel = a - _L, b - _V
    out = np.where((lead >= 0) & (lead < _LS) & (vowel >= 0) & (vowel < _VS), _S + (lead * _VS + vowel) * _TS, out)
    at, tail = a - _S, b - _T
    return np.where((at >= 0) & (at < _LS * _VS * _TS) & (at % _TS == 0) & (tail > 0) & (tail < _TS), a + tail, out)


def _seconds(t) -> np.ndarray:
    """Whether each code point can be the second of a pair."""
    if "seconds" not in t.cached:
        t.cached["seconds"] = np.zeros(0x110000, bool)
        t.cached["seconds"][np.concatenate((t.pairs & 0xFFFFFFFF, np.arange(_V, _V + _VS), np.arange(_T + 1, _T + _TS)))] = True
    return t.cached["seconds"]


def _compose(t, cps: np.ndarray, ccc: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composed code points, and for each unit the unit that it became a part of (itself, if none).

    In each round every starter takes the first unit behind its last one that isn't blocked and
    composes with it; what is a starter itself and is to be taken waits.
    """
    n = len(cps)
    cps, into = cps.copy(), np.arange(n)
    passed = np.full(n, -1)  # of a starter, the last unit that it took
    work = _seconds(t)[cps]
    if not work.any():
        return cps, into
    alive = np.arange(n)
    while True:
        c = ccc[alive]
        lead = _last(c == 0)  # including the unit itself, so that the one before it is asked
        starter = _before(lead, -1)
        ok = work[alive] & (starter >= 0)
        s = alive[np.maximum(starter, 0)]
        ok &= owner[s] == owner[alive]
        previous = np.where(_before(lead, -1) == np.arange(len(alive)) - 1, 0, _before(c, 0))
        ok &= ((previous < c) | (previous == 0)) & (alive > passed[s])
        place = np.flatnonzero(ok)
        made = _pairs(t, cps[s[place]], cps[alive[place]])
        place, made = place[made > 0], made[made > 0]
        if not len(place):
            break
        one = np.unique(starter[place], return_index=True)[1]  # a starter's first
        place, made = place[one], made[one]
        taken = np.zeros(len(alive), bool)
        taken[place] = True
        now = ~taken[starter[place]]
        place, made = place[now], made[now]
        units, heads = alive[place], s[place]
        cps[heads], into[units], passed[heads] = made, heads, units
        keep = np.ones(len(alive), bool)
        keep[place] = False
        alive = alive[keep]
    while (into[into] != into).any():
        into = into[into]
    return cps, into


def normalized(t, mode: str, b: Batch, traced: bool = True):
    """Code points, owner and, if ``traced``, provenance of the normalised units of all sources.

    Returns (cps, units of each source, unit of each span, spans' source units): a span is one source
    unit; spans of a unit are in order, without repeats.
    """
    if mode not in text.MODES:
        raise ValueError(f"unknown mode {mode}")
    cps, source = b.cps, np.arange(len(b.cps))
    if mode == "PRESERVE":
        return cps, np.diff(b.edges), source, source
    if mode == "NFKC_CASEFOLD":
        cps, source = t.folded.expand(cps, source)
    cps, source = _hangul(cps, source)
    cps, source = (t.compatible if mode in ("NFKD", "NFKC") else t.canonical).expand(cps, source)
    owner = b.owner[source] if len(source) else source
    ccc = np.where(text.is_invalid(cps), 0, t.ccc.look(cps))
    new = np.ones(len(cps), bool)
    new[1:] = (ccc[1:] == 0) | (owner[1:] != owner[:-1])
    if (~new[1:] & (ccc[1:] < ccc[:-1])).any():  # marks that stand in another order
        order = np.lexsort((ccc, np.cumsum(new)))
        cps, source, ccc = cps[order], source[order], ccc[order]
    into = np.arange(len(cps))
    if mode in ("NFC", "NFKC", "NFKC_CASEFOLD"):
        cps, into = _compose(t, cps, ccc, owner)
    left = into == np.arange(len(cps))
    per = np.bincount(owner[left], minlength=len(b.sources))
    if not traced:
        return cps[left], per, None, None
    number = np.cumsum(left) - 1
    unit = number[into]
    order = np.lexsort((source, unit))
    unit, source = unit[order], source[order]
    keep = np.ones(len(unit), bool)
    keep[1:] = (unit[1:] != unit[:-1]) | (source[1:] != source[:-1])
    return cps[left], per, unit[keep], source[keep]


def _encoded(cps: np.ndarray, per: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """UTF-8 of each source's units, bytes that aren't as they were; and the bytes of each unit."""
    size = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
    size[text.is_invalid(cps)] = 1
    whole = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(per)))]
    return [whole[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], size


def normalized_bytes(t, mode: str, b: Batch) -> list[bytes]:
    cps, per, _, _ = normalized(t, mode, b, traced=False)
    return _encoded(cps, per)[0]


def views(t, mode: str, b: Batch) -> tuple[list[bytes], np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Normalised bytes; units of each source; their starts and lengths; spans of each unit; theirs.

    Spans are in order, neighbours merged.
    """
    cps, per, unit, source = normalized(t, mode, b)
    out, size = _encoded(cps, per)
    start = np.cumsum(size) - size
    base = np.repeat(start[np.minimum(np.cumsum(per) - per, max(len(start) - 1, 0))], per) if len(start) else start
    at, length = b.local(source), b.lengths[source]
    new = np.ones(len(unit), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (at[1:] != at[:-1] + length[:-1])
    first = np.flatnonzero(new)
    lengths = np.add.reduceat(length, first) if len(first) else length
    return out, per, [start - base, size], np.bincount(unit[first], minlength=len(cps)), [at[first], lengths]
