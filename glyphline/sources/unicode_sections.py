"""Sections of Unicode tables in containers: clusters, security evidence, normalisation.

Tables are written from ranges and mappings and read back as arrays; a section states the Unicode
version that it was made from.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..kernels.vocab import PackError
from . import packs

LIMIT_CP = 0x110000
#: Code points beyond which a look-up makes a table of all of them.
MANY = 1 << 14
# Layout of the sections, and the values that the properties have.
CLUSTER_KIND, SECURITY_KIND, NORMAL_KIND = 5, 7, 8
CLUSTER_MAGIC, SECURITY_MAGIC, NORMAL_MAGIC = b"MSUC", b"MSSC", b"MSNM"
GCB = {"Control": 1, "LF": 2, "CR": 3, "Extend": 4, "Prepend": 5, "SpacingMark": 6, "L": 7, "V": 8, "T": 9, "ZWJ": 10, "LV": 11, "LVT": 12, "Regional_Indicator": 13}
INCB = {"Extend": 1, "Consonant": 2, "Linker": 3}
BOOLEANS = ("Bidi_Control", "Default_Ignorable_Code_Point", "Noncharacter_Code_Point", "Deprecated")
VALUED = np.dtype([("start", "<u4"), ("end", "<u4"), ("value", "u1"), ("zero", "V3")])
PLAIN = np.dtype([("start", "<u4"), ("end", "<u4")])
SCRIPTED = np.dtype([("start", "<u4"), ("end", "<u4"), ("value", "<u2"), ("zero", "V2")])
MAPPED = np.dtype([("cp", "<u4"), ("at", "<u4"), ("size", "<u2"), ("zero", "V2")])
COMPOSED = np.dtype([("first", "<u4"), ("second", "<u4"), ("cp", "<u4")])
# End of fixed values.


@dataclass(frozen=True, eq=False)
class Ranges:
    """Sorted ranges of code points, ends exclusive, with a value each; 0 where there is none."""

    start: np.ndarray
    end: np.ndarray
    value: np.ndarray
    dense: list = field(default_factory=list, repr=False)

    @staticmethod
    def of(per_cp: np.ndarray) -> Ranges:
        """Maximal ranges of one value other than 0 in an array of a value for each code point."""
        edges = np.flatnonzero(np.concatenate(([True], per_cp[1:] != per_cp[:-1])))
        ends, values = np.append(edges[1:], len(per_cp)), per_cp[edges]
        keep = values != 0
        return Ranges(edges[keep], ends[keep], values[keep].astype(np.int64))

    def __len__(self) -> int:
        return len(self.start)

    def look(self, cps: np.ndarray) -> np.ndarray:
        """The value of each code point: of few by binary search, of many from a table made once."""
        if not len(self.start):
            return np.zeros(len(cps), np.int64)
        if len(cps) > MANY or self.dense:
            if not self.dense:
                table = np.zeros(LIMIT_CP, np.int16)
                for a, z, v in zip(self.start.tolist(), self.end.tolist(), self.value.tolist(), strict=True):
                    table[a:z] = v
                self.dense.append(table)
            return self.dense[0][cps]
        at = np.searchsorted(self.start, cps, "right") - 1
        inside = (at >= 0) & (cps < self.end[np.maximum(at, 0)])
        return np.where(inside, self.value[np.maximum(at, 0)], 0)

    def check(self, most: int, what: str) -> Ranges:
        good = (self.start < self.end).all() and (self.end <= LIMIT_CP).all() and (self.start[1:] >= self.end[:-1]).all()
        if not good or (self.value == 0).any() or (self.value > most).any():
            raise PackError(f"bad {what} range")
        return self


@dataclass(frozen=True, eq=False)
class Mappings:
    """Sequences of code points by the code point that they stand for."""

    cps: np.ndarray
    first: np.ndarray  # where each sequence begins in ``flat``, and the end
    flat: np.ndarray

    @staticmethod
    def of(known: dict[int, tuple[int, ...]]) -> Mappings:
        cps = sorted(known)
        sizes = [len(known[c]) for c in cps]
        return Mappings(np.array(cps, np.int64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), np.array([x for c in cps for x in known[c]], np.int64))

    def __len__(self) -> int:
        return len(self.cps)

    def expand(self, cps: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points with the mapped ones replaced by their sequences, and the source of each."""
        if not len(self.cps) or not len(cps):
            return cps, source
        at, high = np.zeros(len(cps), np.int64), np.flatnonzero(cps >= self.cps[0])
        at[high] = np.minimum(np.searchsorted(self.cps, cps[high]), len(self.cps) - 1)
        hit = self.cps[at] == cps
        if not hit.any():
            return cps, source
        size = np.where(hit, self.first[at + 1] - self.first[at], 1)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        from_table = np.repeat(hit, size)
        out = np.repeat(cps, size)
        out[from_table] = self.flat[(np.repeat(self.first[at], size) + place)[from_table]]
        return out, np.repeat(source, size)


@dataclass(frozen=True, eq=False)
class ClusterTables:
    gcb: Ranges
    incb: Ranges
    pictographic: Ranges
    version: tuple[int, int, int] = (17, 0, 0)


@dataclass(frozen=True, eq=False)
class SecurityTables:
    """names: of script ids from 1 on. flags: bidi controls, ignorables, noncharacters, deprecated ones."""

    names: tuple[str, ...]
    scripts: Ranges
    flags: tuple[Ranges, Ranges, Ranges, Ranges]
    version: tuple[int, int, int] = (17, 0, 0)


@dataclass(frozen=True, eq=False)
class NormalTables:
    """pairs: composed code point by (first << 32 | second), sorted; sequences are decomposed in full."""

    ccc: Ranges
    canonical: Mappings
    compatible: Mappings
    folded: Mappings
    pairs: np.ndarray
    composed: np.ndarray
    version: tuple[int, int, int] = (16, 0, 0)
    cached: dict = field(default_factory=dict, compare=False, repr=False)


# --- writing --------------------------------------------------------------------------------------


def _rows(kind: np.dtype, **columns) -> bytes:
    out = np.zeros(len(next(iter(columns.values()))), kind)
    for name, c in columns.items():
        out[name] = c
    return out.tobytes()


def _valued(r: Ranges, kind: np.dtype = VALUED) -> bytes:
    return _rows(kind, start=r.start, end=r.end, value=r.value)


def _plain(r: Ranges) -> bytes:
    return _rows(PLAIN, start=r.start, end=r.end)


def _layout(size: int, tables: list[bytes], align: int = 4) -> tuple[list[int], bytes]:
    """Places of tables behind a header of ``size`` bytes, and their bytes."""
    out = packs._Layout(size)
    return [out.add(t, align) for t in tables], bytes(out.body)


def write_clusters(t: ClusterTables) -> bytes:
    tables = [t.gcb, t.incb, t.pictographic]
    places, body = _layout(48, [_valued(t.gcb), _valued(t.incb), _plain(t.pictographic)])
    head = struct.pack("<4s2H4H6IQ", CLUSTER_MAGIC, 1, 0, *t.version, 0, *map(len, tables), *places, 0)
    return packs.wrap(CLUSTER_KIND, head + body)


def write_security(t: SecurityTables) -> bytes:
    names = [n.encode() for n in t.names]
    at = np.concatenate(([0], np.cumsum([len(n) for n in names]))).astype(int)
    meta = b"".join(struct.pack("<IHH", a, len(n), k + 1) for k, (a, n) in enumerate(zip(at, names, strict=False)))
    tables = [meta, _valued(t.scripts, SCRIPTED), *map(_plain, t.flags), b"".join(names)]
    places, body = _layout(72, tables)
    head = struct.pack("<4s2H4H14I", SECURITY_MAGIC, 1, 72, *t.version, 0, len(names), len(t.scripts), *map(len, t.flags), *places, 0)
    return packs.wrap(SECURITY_KIND, head + body)


def write_normal(t: NormalTables) -> bytes:
    maps = [t.canonical, t.compatible, t.folded]
    base = np.cumsum([0, *(len(m.flat) for m in maps)])
    mapped = [_rows(MAPPED, cp=m.cps, at=m.first[:-1] + b, size=np.diff(m.first)) for m, b in zip(maps, base, strict=False)]
    pairs = _rows(COMPOSED, first=t.pairs >> 32, second=t.pairs & 0xFFFFFFFF, cp=t.composed)
    tables = [_valued(t.ccc), *mapped, pairs, np.concatenate([m.flat for m in maps]).astype("<u4").tobytes()]
    places, body = _layout(80, tables)
    head = struct.pack("<4s2H4H12I16x", NORMAL_MAGIC, 1, 80, *t.version, 0, len(t.ccc), *map(len, maps), len(t.pairs), base[-1], *places)
    return packs.wrap(NORMAL_KIND, head + body)


# --- reading --------------------------------------------------------------------------------------


class _Tables:
    """Tables that follow one another behind a header, with nothing but zeros between."""

    def __init__(self, data: bytes, header: int, what: str):
        self.regions, self.what = packs._Regions(data, header, what), what

    def rows(self, place: int, count: int, kind: np.dtype, last: bool = False) -> np.ndarray:
        take = self.regions.last if last else self.regions.take
        out = np.frombuffer(take(place, count * kind.itemsize), kind)
        if "zero" in (kind.names or ()) and out["zero"].tobytes().strip(b"\0"):
            raise PackError(f"bad {self.what} row")
        return out

    def ranges(self, place: int, count: int, kind: np.dtype, most: int = 1, last: bool = False) -> Ranges:
        r = self.rows(place, count, kind, last)
        value = r["value"] if "value" in kind.names else np.ones(count)
        return Ranges(*(np.asarray(c, np.int64) for c in (r["start"], r["end"], value))).check(most, self.what)


def _head(data: bytes, kind: int, magic: bytes, size: int, layout: str, what: str):
    """(version, numbers) of a section's header."""
    s = packs.section(data, kind)
    if len(s) < size:
        raise PackError(f"bad {what} header")
    found, version, _, a, b, c, zero, *numbers = struct.unpack_from(layout, s)
    if (found, version, zero) != (magic, 1, 0):
        raise PackError(f"bad {what} header")
    return s, (a, b, c), numbers


def read_clusters(data: bytes) -> ClusterTables:
    s, version, n = _head(data, CLUSTER_KIND, CLUSTER_MAGIC, 48, "<4s2H4H6IQ", "cluster")
    if sum(n[:3]) > 100_000 or n[3] != 48 or n[6]:
        raise PackError("bad cluster layout")
    t = _Tables(s, 48, "cluster")
    return ClusterTables(t.ranges(n[3], n[0], VALUED, max(GCB.values())), t.ranges(n[4], n[1], VALUED, max(INCB.values())), t.ranges(n[5], n[2], PLAIN, last=True), version)


def read_security(data: bytes) -> SecurityTables:
    s, version, n = _head(data, SECURITY_KIND, SECURITY_MAGIC, 72, "<4s2H4H14I", "security")
    if not 0 < n[0] <= 1024 or n[1] > 200_000 or max(n[2:6]) > 10_000 or n[6] != 72 or n[13]:
        raise PackError("bad security layout")
    t = _Tables(s, 72, "security")
    meta = np.frombuffer(t.regions.take(n[6], 8 * n[0]), np.dtype([("at", "<u4"), ("size", "<u2"), ("id", "<u2")]))
    scripts = t.ranges(n[7], n[1], SCRIPTED, n[0])
    flags = tuple(t.ranges(place, count, PLAIN) for place, count in zip(n[8:12], n[2:6], strict=True))
    blob = t.regions.last(n[12], len(s) - n[12])
    if (meta["id"] != np.arange(1, n[0] + 1)).any():
        raise PackError("bad script ids")
    try:
        names = tuple(packs._piece(blob, int(m["at"]), int(m["size"])).decode("ascii") for m in meta)
    except UnicodeDecodeError as e:
        raise PackError("bad script name") from e
    if not {"COMMON", "INHERITED", "UNKNOWN"} <= set(names) or any(not x.isalpha() or not x.isupper() for x in names):
        raise PackError("bad script names")
    return SecurityTables(names, scripts, flags, version)


def read_normal(data: bytes) -> NormalTables:
    s, version, n = _head(data, NORMAL_KIND, NORMAL_MAGIC, 80, "<4s2H4H12I16x", "normalisation")
    counts, places = n[:6], n[6:]
    if counts[0] > 10_000 or max(counts[1:5]) > 100_000 or counts[5] > 1_000_000 or places[0] != 80 or any(s[64:80]):
        raise PackError("bad normalisation layout")
    t = _Tables(s, 80, "normalisation")
    ccc = t.ranges(places[0], counts[0], VALUED, 255)
    maps = [t.rows(p, c, MAPPED) for p, c in zip(places[1:4], counts[1:4], strict=True)]
    pairs = t.rows(places[4], counts[4], COMPOSED)
    flat = t.rows(places[5], counts[5], np.dtype("<u4"), last=True).astype(np.int64)
    scalar = lambda c: ((c < 0xD800) | (c > 0xDFFF)) & (c < LIMIT_CP)
    key = (pairs["first"].astype(np.int64) << 32) | pairs["second"]
    if not scalar(flat).all() or not all(scalar(pairs[c].astype(np.int64)).all() for c in pairs.dtype.names) or (np.diff(key) <= 0).any():
        raise PackError("bad composition")
    found = []
    for m in maps:
        at, size, cps = (m[c].astype(np.int64) for c in ("at", "size", "cp"))
        if not scalar(cps).all() or (np.diff(cps) <= 0).any() or (at + size > len(flat)).any():
            raise PackError("bad mapping")
        first = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(at - first[:-1], size) + np.arange(int(size.sum()))
        found.append(Mappings(cps, first, flat[place]))
    return NormalTables(ccc, *found, key, pairs["cp"].astype(np.int64), version)
