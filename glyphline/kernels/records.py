"""Block plans and binary records: packed tokens, whole documents, cache entries, identities."""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np

# Magics and sizes of the record formats.
PACKED_MAGIC, PACKED_HEADER = b"MSTKPK01", 160
DOCUMENT_MAGIC, DOCUMENT_HEADER, SECTION_ENTRY, SECTIONS = b"MSTIRD01", 256, 32, 9
CACHE_MAGIC, CACHE_HEADER = b"MSCACHR1", 128
SECTION_WIDTH = (1, 24, 16, 24, 1, 24, 16, 24, 32)
# End of fixed values.
SEMANTICS = 2
#: Domains of our own identities.
BLOCK_DOMAIN, MACRO_DOMAIN, KEY_DOMAIN = b"glyphline-block-v1\0", b"glyphline-macroblock-v1\0", b"glyphline-cache-key-v1\0"


class RecordError(ValueError):
    """A record that isn't whole."""

    def __init__(self, message: str, status: int = 12):
        super().__init__(message)
        self.status = status


def sha256(*parts: bytes) -> bytes:
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.digest()


@dataclass(frozen=True)
class BlockPolicy:
    minimum: int = 16 << 10
    preferred: int = 64 << 10
    maximum: int = 256 << 10
    macroblock: int = 4 << 20
    #: Ceilings of a source's blocks and macroblocks; 0: none.
    max_blocks: int = 0
    max_macroblocks: int = 0

    def __post_init__(self):
        if not 0 < self.minimum <= self.preferred <= self.maximum <= self.macroblock:
            raise ValueError("block sizes must be ordered")
        if min(self.max_blocks, self.max_macroblocks) < 0:
            raise ValueError("ceilings can't be negative")


def block_plan(lengths: list[int], policy: BlockPolicy) -> tuple[list[tuple[int, int, int, int, bool]], list[tuple[int, int, int]]]:
    """Blocks (first token, tokens, start, length, oversize) and macroblocks (first block, blocks, length).

    From a token on, a block ends where its length is nearest to the preferred one among lengths
    from minimum to maximum (the larger of two that are as near); where none is, it is one token.
    """
    # where each token ends; they grow, so that of the blocks from a token on the nearest two are found by bisection
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    blocks, t, start, n = [], 0, 0, len(ends)
    while t < n:
        above = bisect_left(ends, start + policy.preferred, t)
        best = (t, False)
        if above < n and ends[above] - start <= policy.maximum:
            best = (above, True)
        if above > t and ends[above - 1] - start >= policy.minimum and not (best[1] and ends[above] - start - policy.preferred <= policy.preferred - ends[above - 1] + start):
            best = (above - 1, True)
        last = best[0]
        size = ends[last] - start
        blocks.append((t, last + 1 - t, start, size, size > policy.maximum))
        t, start = last + 1, ends[last]
    macros, first, total = [], 0, 0
    for i, b in enumerate(blocks):
        total += b[3]
        if total >= policy.macroblock or i == len(blocks) - 1:
            macros.append((first, i + 1 - first, total))
            first, total = i + 1, 0
    return blocks, macros


def block_identity(fingerprint: bytes, data: bytes) -> bytes:
    return sha256(BLOCK_DOMAIN, fingerprint, data)


def macroblock_identity(fingerprint: bytes, identities: list[bytes]) -> bytes:
    return sha256(MACRO_DOMAIN, fingerprint, *identities)


def cache_key(identity: bytes, namespace: int, version: int) -> bytes:
    return sha256(KEY_DOMAIN, identity, struct.pack("<II", namespace, version))


def uleb(values) -> bytes:
    """Unsigned LEB128 of each value."""
    values = np.asarray(values, np.uint64)
    if not len(values) or values.max() < 0x80:
        return values.astype(np.uint8).tobytes()
    out = bytearray()
    for v in values.tolist():
        while v >= 0x80:
            out.append(v & 0x7F | 0x80)
            v >>= 7
        out.append(v)
    return bytes(out)


def read_uleb(data: bytes, count: int) -> list[int]:
    """count values that take up data exactly, each in its shortest form."""
    if len(data) == count and data.isascii():
        return list(data)
    out, at = [], 0
    for _ in range(count):
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise RecordError("a length is cut off")
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                break
        if not b and shift > 7:
            raise RecordError("a length isn't in its shortest form")
        out.append(value)
    if at != len(data):
        raise RecordError("bytes behind the lengths")
    return out


def _sealed(record: bytearray, at: int) -> bytes:
    """The record with its hash, taken while the hash's place is zero."""
    record[at : at + 32] = bytes(32)
    record[at : at + 32] = sha256(bytes(record))
    return bytes(record)


def _whole(record: bytes, at: int) -> bool:
    return sha256(record[:at], bytes(32), record[at + 32 :]) == record[at : at + 32]


def pack_tokens(ids, lengths, source_hash: bytes, fingerprint: bytes) -> bytes:
    """Lengths as LEB128, then ids of just enough bits, the lowest bit first."""
    ids = np.asarray(ids, np.uint64)
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 0
    sizes = uleb(lengths)
    flags = np.unpackbits(ids.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=bits) if bits else np.zeros(0, np.uint8)
    packed = np.packbits(flags.ravel(), bitorder="little").tobytes()
    head = struct.pack("<8sHHIQQIIQQ32s32s", PACKED_MAGIC, 1, PACKED_HEADER, 0, len(ids), int(np.sum(lengths)), bits, 0, len(sizes), len(packed), source_hash, fingerprint)
    return _sealed(bytearray(head.ljust(PACKED_HEADER, b"\0") + sizes + packed), 120)


def unpack_tokens(record: bytes) -> tuple[list[int], list[int], dict]:
    """(ids, lengths, header) of a packed record; anything out of place raises RecordError."""
    ids, lengths, head = unpacked_arrays(record)
    return ids.tolist(), lengths.tolist(), head


def unpacked_arrays(record: bytes) -> tuple[np.ndarray, np.ndarray, dict]:
    """``unpack_tokens`` with arrays."""
    if len(record) < PACKED_HEADER:
        raise RecordError("too short", 3)
    magic, version, header, r1, count, source, bits, r2, n_sizes, n_ids, source_hash, fingerprint = struct.unpack_from("<8sHHIQQIIQQ32s32s", record)
    if (magic, version, header, r1, r2) != (PACKED_MAGIC, 1, PACKED_HEADER, 0, 0) or any(record[152:160]):
        raise RecordError("not a packed record", 3)
    if (count == 0) != (bits == 0) or bits > 32 or n_ids != (count * bits + 7) // 8 or PACKED_HEADER + n_sizes + n_ids != len(record):
        raise RecordError("sizes don't agree", 3)
    if not _whole(record, 120):
        raise RecordError("the hash doesn't agree")
    sizes = record[PACKED_HEADER : PACKED_HEADER + n_sizes]
    if n_sizes == count and sizes.isascii():
        lengths = np.frombuffer(sizes, np.uint8).astype(np.int64)
        total = int(lengths.sum())
    else:
        lengths = read_uleb(sizes, count)
        total = sum(lengths)
    if 0 in lengths or total != source:
        raise RecordError("lengths don't agree")
    flags = np.unpackbits(np.frombuffer(record, np.uint8, n_ids, PACKED_HEADER + n_sizes), bitorder="little")
    if flags[count * bits :].any():
        raise RecordError("bits behind the ids")
    ids = np.zeros(count, np.int64)
    for k in range(bits):
        ids |= flags[k : count * bits : bits].astype(np.int64) << k
    return ids, np.asarray(lengths, np.int64 if source < 1 << 63 else object), {"count": count, "id_bits": bits, "source_length": source, "source_sha256": source_hash, "fingerprint": fingerprint}


MODEL, GRAPHEMES, SECURITY, NORMALIZATION, LEXICAL, SEMANTIC = (1 << k for k in range(6))


_FORMS = {
    "token": np.dtype([("id", "<u4"), ("zero", "<u4"), ("start", "<u8"), ("length", "<u8")]),
    "span": np.dtype([("start", "<u8"), ("length", "<u8")]),
    "finding": np.dtype([("kind", "<u4"), ("script", "<u2"), ("zero", "<u2"), ("start", "<u8"), ("length", "<u8")]),
    "unit": np.dtype([("start", "<u8"), ("length", "<u8"), ("first", "<u4"), ("count", "<u4")]),
    "component": np.dtype([("kind", "<u4"), ("zero", "<u4"), ("index", "<u8"), ("start", "<u8"), ("length", "<u8")]),
}


def table_of(form: str, size: int, **columns) -> np.ndarray:
    """Rows of numbers as records; fields that no column names are zero."""
    out = np.zeros(size, _FORMS[form])
    for name, values in columns.items():
        out[name] = values
    return out


def _table(form: str, rows, *columns: str) -> bytes:
    rows = list(rows)
    return table_of(form, len(rows), **dict(zip(columns, zip(*rows, strict=True), strict=True) if rows else ())).tobytes()


def write_document(doc: dict) -> bytes:
    """A document record. doc: source, flags, fingerprint, mode, detection and the projections.

    Projections: tokens (id, start, length), graphemes (start, length), findings (kind, script,
    start, length), normalized bytes with units (start, length, spans), lexical (kind, start,
    length) and semantic (kind, index, start, length).
    """
    units = doc.get("units") or []
    spans = [s for u in units for s in u[2]]
    firsts = np.cumsum([0, *(len(u[2]) for u in units)])
    bodies = [
        doc["source"],
        _table("token", doc.get("tokens") or [], "id", "start", "length"),
        _table("span", doc.get("graphemes") or [], "start", "length"),
        _table("finding", doc.get("findings") or [], "kind", "script", "start", "length"),
        doc.get("normalized") or b"",
        _table("unit", ((u[0], u[1], f, len(u[2])) for u, f in zip(units, firsts.tolist(), strict=False)), "start", "length", "first", "count"),
        _table("span", spans, "start", "length"),
        _table("token", doc.get("lexical") or [], "id", "start", "length"),
        _table("component", doc.get("semantic") or [], "kind", "index", "start", "length"),
    ]
    return document_record(bodies, doc["flags"], doc["fingerprint"], doc.get("mode", 0), doc.get("detection"))


def document_record(bodies: list[bytes], flags: int, fingerprint: bytes, mode: int, detection: tuple | None = None) -> bytes:
    """The record of the nine sections' bytes, the first of which is the source."""
    source = bodies[0]
    at, table, out = DOCUMENT_HEADER + SECTIONS * SECTION_ENTRY, [], bytearray()
    for number, (body, width) in enumerate(zip(bodies, SECTION_WIDTH, strict=True), 1):
        offset = -(-(at + len(out)) // 8) * 8 if body else 0
        if body:
            out += bytes(offset - at - len(out))
            out += body
        table.append(struct.pack("<IIQQQ", number, 0, offset, len(body), len(body) // width))
    matched, available, score, margin, language = detection or (0, 0, 0, 0, "")
    head = struct.pack("<8sIIIIQQII32s32s32s", DOCUMENT_MAGIC, 1, DOCUMENT_HEADER, flags, mode, at + len(out), len(source), SEMANTICS, SECTIONS, sha256(source), fingerprint, bytes(32))
    head += struct.pack("<IIqq64s", matched, available, score, margin, (language or "").encode())
    return _sealed(bytearray(head.ljust(DOCUMENT_HEADER, b"\0") + b"".join(table) + out), 112)


def document_tables(record: bytes, ceiling: int = 1 << 30) -> tuple[dict, list]:
    """Header fields, and the nine sections: bytes, or arrays of records; a record that isn't whole raises RecordError."""
    data_start = DOCUMENT_HEADER + SECTIONS * SECTION_ENTRY
    if len(record) > ceiling:
        raise RecordError("over the ceiling", 9)
    if len(record) < data_start:
        raise RecordError("too short")
    magic, version, header, flags, mode, total, n, semantics, sections, source_hash, fingerprint, _ = struct.unpack_from("<8sIIIIQQII32s32s32s", record)
    if (magic, version, header, total, semantics, sections) != (DOCUMENT_MAGIC, 1, DOCUMENT_HEADER, len(record), SEMANTICS, SECTIONS) or flags >> 6 or not _whole(record, 112):
        raise RecordError("header or hash doesn't agree")
    bodies, at = [], data_start
    for k, width in enumerate(SECTION_WIDTH):
        kind, zero, offset, length, count = struct.unpack_from("<IIQQQ", record, DOCUMENT_HEADER + k * SECTION_ENTRY)
        expected = -(-at // 8) * 8 if length else 0
        if kind != k + 1 or zero or length != count * width or offset != expected or offset + length > len(record) or (length and any(record[at:offset])):
            raise RecordError("a section is out of place")
        form = _SECTION_FORMS[k]
        bodies.append(record[offset : offset + length] if form is None else np.frombuffer(record, _FORMS[form], count, offset))
        at = offset + length if length else at
    if at != len(record):
        raise RecordError("bytes behind the sections")
    matched, available, score, margin, language = struct.unpack_from("<IIqq64s", record, 144)
    detection = (matched, available, score, margin, language.rstrip(b"\0").decode())
    if n != len(bodies[0]) or sha256(bodies[0]) != source_hash:
        raise RecordError("the source doesn't agree")
    tokens, graphemes, lexical, semantic = (bodies[k] for k in (1, 2, 7, 8))
    for flag, key, rows in ((MODEL, "tokens", tokens), (GRAPHEMES, "graphemes", graphemes), (LEXICAL | SEMANTIC, "lexical", lexical)):
        if flags & flag and not _follow(rows, n):
            raise RecordError(f"{key} don't partition the source")
    if len(semantic) and not _inside(semantic, lexical):
        raise RecordError("a component is outside its token")
    return {"flags": flags, "mode": mode, "fingerprint": fingerprint, "detection": detection}, bodies


_SECTION_FORMS = (None, "token", "span", "finding", None, "unit", "span", "token", "component")


def _follow(rows: np.ndarray, n: int) -> bool:
    """``partitions`` of records."""
    start, length = rows["start"], rows["length"]
    if not len(rows):
        return n == 0
    if (start > n).any() or (length > n).any() or not length.all():
        return False
    ends = start + length
    return bool(start[0] == 0 and (start[1:] == ends[:-1]).all() and ends[-1] == n)


def _inside(components: np.ndarray, lexical: np.ndarray) -> bool:
    """Whether each component lies within the lexical token of its index."""
    if (components["index"] >= len(lexical)).any():
        return False
    own = lexical[components["index"].astype(np.int64)]
    values = [own["start"], own["length"], components["start"], components["length"]]
    if any((v >> np.uint64(62)).any() for v in values):  # sums beyond 64 bits
        values = [v.astype(object) for v in values]
    a, m, s, k = values
    return bool(((a <= s) & (s + k <= a + m)).all())


def read_document(record: bytes, ceiling: int = 1 << 30) -> dict:
    """The dict that write_document takes; a record that isn't whole raises RecordError."""
    doc, (source, tokens, graphemes, findings, normalized, units, spans, lexical, semantic) = document_tables(record, ceiling)
    rows = lambda table, *names: list(zip(*(table[x].tolist() for x in names), strict=True))
    spans = rows(spans, "start", "length")
    return doc | {
        "source": source,
        "tokens": rows(tokens, "id", "start", "length"),
        "graphemes": rows(graphemes, "start", "length"),
        "findings": rows(findings, "kind", "script", "start", "length"),
        "normalized": normalized,
        "units": [(s, m, spans[f : f + c]) for s, m, f, c in rows(units, "start", "length", "first", "count")],
        "lexical": rows(lexical, "id", "start", "length"),
        "semantic": rows(semantic, "kind", "index", "start", "length"),
    }


def partitions(spans, n: int) -> bool:
    """Whether (start, length) spans follow one another without a gap from 0 to n."""
    at = 0
    for start, length in spans:
        if start != at or not length:
            return False
        at += length
    return at == n


def write_cache_record(key: bytes, value: bytes) -> bytes:
    head = struct.pack("<8sHHIQ32s32s", CACHE_MAGIC, 1, CACHE_HEADER, 0, len(value), key, sha256(value))
    return _sealed(bytearray(head.ljust(CACHE_HEADER, b"\0") + value), 88)


def read_cache_record(record: bytes, key: bytes | None = None) -> bytes:
    """The value, after all checks; key: if given, the one that the record has to have."""
    if len(record) < CACHE_HEADER:
        raise RecordError("too short")
    magic, version, header, zero, n, own, digest = struct.unpack_from("<8sHHIQ32s32s", record)
    value = record[CACHE_HEADER:]
    if (magic, version, header, zero, n) != (CACHE_MAGIC, 1, CACHE_HEADER, 0, len(value)) or any(record[120:128]) or not _whole(record, 88) or sha256(value) != digest:
        raise RecordError("the record doesn't agree")
    if key is not None and own != key:
        raise RecordError("another key's record")
    return value


def fingerprint(vocabulary: bytes, tables: str, languages: list[bytes], optional: dict[str, bytes]) -> bytes:
    """Identity of what encoding depends on; languages in any order, optional parts by name."""
    parts = [b"glyphline-runtime\0", vocabulary, sha256(tables.encode()), struct.pack(">I", len(languages)), *sorted(languages)]
    for name in ("detector", "security", "normalization", "lexer"):
        if name in optional:
            parts += [name.encode() + b"\0", optional[name]]
    return sha256(*parts)


def manifest_identity(domain: bytes, versions: list[int], policy: bytes, packs: list[tuple[int, int, bytes]]) -> bytes:
    """Identity of an execution manifest: seven versions, policy hash, packs (role, ordinal, hash) in order."""
    keys = [p[:2] for p in packs]
    if len(versions) != 7 or not any(policy) or any(not any(p[2]) for p in packs) or keys != sorted(set(keys)):
        raise RecordError("the manifest isn't canonical", 3)
    return sha256(domain, struct.pack("<7I", *versions), policy, struct.pack("<I", len(packs)), *(struct.pack("<HH", r, o) + h for r, o, h in packs))


class LruCache:
    """Bounded map from 32-byte keys to bytes; what was used longest ago goes first."""

    def __init__(self, max_entries: int = 1024, max_bytes: int = 64 << 20, max_value: int = 8 << 20):
        if min(max_entries, max_bytes, max_value) < 1:
            raise ValueError("limits must be positive")
        self.max_entries, self.max_bytes, self.max_value = max_entries, max_bytes, max_value
        self._held: dict[bytes, bytes] = {}
        self.bytes = 0
        self.stats = {"hits": 0, "misses": 0, "insertions": 0, "evictions": 0, "rejections": 0}

    def put(self, key: bytes, value: bytes) -> bool:
        if len(key) != 32:
            raise ValueError("keys have 32 bytes")
        if len(value) > min(self.max_value, self.max_bytes):
            self.stats["rejections"] += 1
            return False
        self.remove(key)
        while self._held and (len(self._held) >= self.max_entries or self.bytes + len(value) > self.max_bytes):
            self.remove(next(iter(self._held)))
            self.stats["evictions"] += 1
        self._held[key] = value
        self.bytes += len(value)
        self.stats["insertions"] += 1
        return True

    def get(self, key: bytes) -> bytes | None:
        value = self._held.pop(key, None)
        self.stats["misses" if value is None else "hits"] += 1
        if value is not None:
            self._held[key] = value
        return value

    def remove(self, key: bytes) -> bool:
        value = self._held.pop(key, None)
        self.bytes -= len(value or b"")
        return value is not None

    def clear(self) -> None:
        self._held.clear()
        self.bytes = 0

    def __len__(self) -> int:
        return len(self._held)
