"""Configuration files: a hashed container of sections, rank files and id files.

The container is little-endian: a 96-byte header with a SHA-256 of the file (taken while its own
place is zero), a directory of 32-byte entries and sections on 8-byte places with zeros between.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct

from ..kernels.vocab import BPE, VITERBI, Detector, Language, LexProfile, PackError, Vocabulary, build_vocabulary

# Magics, versions and kinds of the container format.
MAGIC, HEADER, ENTRY = b"MOSPACK\0", 96, 32
MANIFEST, LOCK, DFA, VOCABULARY, LANGUAGE, DETECTOR, SECURITY, NORMALIZATION, LEXER = range(1, 10)
SECTION_MAGIC = {MANIFEST: b"MSMF", LOCK: b"MSLK", DFA: b"MSDF", VOCABULARY: b"MSVC", DETECTOR: b"MSDT", SECURITY: b"MSSC", NORMALIZATION: b"MSNM", LEXER: b"MSLX"}
MINOR = {VOCABULARY: 2, LANGUAGE: 2, DETECTOR: 3, SECURITY: 2, NORMALIZATION: 2, LEXER: 8}
TEST_HEADER, TEST_FLAG = 32, 1
# End of fixed values.


def _pad(out: bytearray, to: int) -> int:
    out += bytes(-len(out) % to)
    return len(out)


def wrap(kind: int, section: bytes) -> bytes:
    """A container of a manifest, an empty lock and one section."""
    lock = struct.pack("<4sHHII", SECTION_MAGIC[LOCK], 1, 48, 0, 0)
    manifest = struct.pack("<4sHH5I", SECTION_MAGIC[MANIFEST], 1, 0, 1, 1, 1, 1, 1)
    manifest += struct.pack("<I", 0) + hashlib.sha256(lock).digest()
    sections = [(MANIFEST, manifest), (LOCK, lock), (kind, section)]
    at, directory, body = HEADER + ENTRY * len(sections), b"", bytearray()
    for k, data in sections:
        _pad(body, 8)
        directory += struct.pack("<IIQQIHBB", k, 0, at + len(body), len(data), 0, 0, 3, 0)
        body += data
    total = at + len(body)
    head = struct.pack("<8sHHHHQIHHQII", MAGIC, 1, MINOR[kind], HEADER, 0, total, len(sections), ENTRY, 1, HEADER, 0, 1)
    head = bytearray(head.ljust(HEADER, b"\0"))
    out = head + directory + body
    out[48:80] = hashlib.sha256(bytes(out)).digest()
    return bytes(out)


def scan(data: bytes) -> list[tuple[int, bytes]]:
    """(kind, bytes) of each section; anything out of place raises PackError."""
    if len(data) < HEADER or data[:8] != MAGIC:
        raise PackError("not a container")
    major, _, header, flags = struct.unpack_from("<4H", data, 8)
    total, count, entry, algorithm, directory, manifest, lock = struct.unpack_from("<QIHHQII", data, 16)
    if (major, header, flags, entry, algorithm, directory) != (1, HEADER, 0, ENTRY, 1, HEADER) or any(data[80:HEADER]):
        raise PackError("bad header")
    if total != len(data) or not 0 < count <= 1024 or HEADER + ENTRY * count > total:
        raise PackError("bad length")
    if hashlib.sha256(data[:48] + bytes(32) + data[80:]).digest() != data[48:80]:
        raise PackError("bad hash")
    out, at = [], HEADER + ENTRY * count
    for k in range(count):
        kind, zero, offset, length, _, _, align, reserved = struct.unpack_from("<IIQQIHBB", data, HEADER + ENTRY * k)
        if zero or reserved or offset % 8 or align > 12 or offset != -(-at // 8) * 8 or offset + length > total or any(data[at:offset]):
            raise PackError(f"section {k} is out of place")
        at = offset + length
        out.append((kind, data[offset:at]))
    if at != total or manifest >= count or lock >= count or out[manifest][0] != MANIFEST or out[lock][0] != LOCK:
        raise PackError("bad sections")
    if out[manifest][1][32:64] != hashlib.sha256(out[lock][1]).digest():
        raise PackError("the manifest is for another lock")
    return out


def parse_test_header(data: bytes) -> dict:
    """The short header of early test containers: version, flags, length and number of sections."""
    if len(data) < TEST_HEADER or data[:8] != MAGIC:
        raise PackError("not a container")
    major, minor, header, flags, total, count, reserved = struct.unpack_from("<4HQII", data, 8)
    if header != TEST_HEADER or total != len(data) or reserved:
        raise PackError("bad header")
    return {"major": major, "minor": minor, "flags": flags, "length": total, "sections": count, "test": bool(flags & TEST_FLAG)}


def section(data: bytes, kind: int) -> bytes:
    found = [s for k, s in scan(data) if k == kind]
    if len(found) != 1:
        raise PackError(f"one section of kind {kind} is needed")
    return found[0]


def write_vocabulary(v: Vocabulary) -> bytes:
    blob, entries = bytearray(), b""
    for i, cost, s in v.rows:
        entries += struct.pack("<IiIHH", i, cost, len(blob), len(s), 0)
        blob += s
    n = len(v.rows)
    by_id = sorted(range(n), key=lambda k: v.rows[k][0])
    first, k = [], 0
    for b in range(257):
        while k < n and v.rows[k][2][0] < b:
            k += 1
        first.append(k)
    ids_at = 40 + 16 * n
    first_at = ids_at + 4 * n
    blob_at = -(-(first_at + 4 * 257) // 8) * 8
    out = struct.pack("<4sHHIHHIIIIII", b"MSVC", 1, 0, n, 16, 0, 40, ids_at, first_at, blob_at, len(blob), v.algorithm)
    out += entries + struct.pack(f"<{n}I", *by_id) + struct.pack("<257I", *first)
    return wrap(VOCABULARY, out.ljust(blob_at, b"\0") + bytes(blob))


def read_vocabulary(data: bytes) -> Vocabulary:
    s = section(data, VOCABULARY)
    magic, version, _, n, width, _, at, ids_at, first_at, blob_at, size, algorithm = struct.unpack_from("<4sHHIHHIIIIII", s)
    if (magic, version, width) != (b"MSVC", 1, 16) or n < 256 or algorithm not in (VITERBI, BPE) or blob_at + size != len(s) or at + 16 * n > len(s):
        raise PackError("bad vocabulary")
    rows = []
    for k in range(n):
        i, cost, offset, length, zero = struct.unpack_from("<IiIHH", s, at + 16 * k)
        if zero or not length or offset + length > size:
            raise PackError("bad vocabulary entry")
        rows.append((i, cost, s[blob_at + offset : blob_at + offset + length]))
    if [(r[2], r[0]) for r in rows] != sorted({(r[2], r[0]) for r in rows}):
        raise PackError("surfaces aren't sorted")
    v = Vocabulary(tuple(rows), algorithm)
    if write_vocabulary(v) != data:
        raise PackError("bad vocabulary index")
    return v


class _Layout:
    """A section under construction: regions behind a header, each at a multiple of its alignment."""

    def __init__(self, header: int):
        self.header, self.body = header, bytearray()

    def add(self, region: bytes, align: int = 8) -> int:
        self.body += bytes(-(self.header + len(self.body)) % align)
        at = self.header + len(self.body)
        self.body += region
        return at


class _Regions:
    """A section that is read: its regions have to follow one another with nothing but zeros between."""

    def __init__(self, data: bytes, header: int, what: str):
        self.data, self.at, self.what = data, header, what

    def take(self, offset: int, length: int) -> bytes:
        if offset < self.at or offset + length > len(self.data) or any(self.data[self.at : offset]):
            raise PackError(f"bad {self.what} regions")
        self.at = offset + length
        return self.data[offset : self.at]

    def last(self, offset: int, length: int) -> bytes:
        blob = self.take(offset, length)
        if self.at != len(self.data):
            raise PackError(f"bad {self.what} length")
        return blob


def _piece(blob: bytes, offset: int, length: int) -> bytes:
    if not length or offset + length > len(blob):
        raise PackError("a surface is out of place")
    return blob[offset : offset + length]


def _ascending(surfaces: list[bytes]) -> None:
    if any(a >= b for a, b in zip(surfaces, surfaces[1:], strict=False)):
        raise PackError("surfaces aren't sorted")


# Headers and rows of the language and lexer sections.
_LANGUAGE_HEAD, _LANGUAGE_ROW = struct.Struct("<4sHHIHHIIIIII"), struct.Struct("<IHHii")
_LEXER_HEAD, _LEXER_WORD, _LEXER_BLOCK, _LEXER_STRING = struct.Struct("<4sHHIIIIIIIIIHHIIII"), struct.Struct("<IHH"), struct.Struct("<IIHHHH"), struct.Struct("<IHBBI")
LANGUAGE_MAGIC = b"MSLG"
# End of fixed values.


def write_language(x: Language) -> bytes:
    """A container of one language: rows of surfaces in order with their deltas, the tag, the surfaces."""
    deltas = sorted(x.deltas)
    if any(not 0 < len(s) <= 65535 or not -(2**31) < d < 2**31 for s, d in deltas):
        raise PackError("a surface or delta is out of range")
    ends, rows = 0, b""
    for s, d in deltas:
        rows += _LANGUAGE_ROW.pack(ends, len(s), 0, d, 0)
        ends += len(s)
    out, tag = _Layout(_LANGUAGE_HEAD.size), x.tag.encode()
    places = out.add(rows), out.add(tag, 1), out.add(b"".join(s for s, _ in deltas))
    head = _LANGUAGE_HEAD.pack(LANGUAGE_MAGIC, 1, 0, len(deltas), _LANGUAGE_ROW.size, len(tag), *places, ends, max((len(s) for s, _ in deltas), default=0), 0)
    return wrap(LANGUAGE, head + bytes(out.body))


def read_language(data: bytes) -> Language:
    s = section(data, LANGUAGE)
    if len(s) < _LANGUAGE_HEAD.size:
        raise PackError("bad language")
    magic, version, zero, count, width, tag_size, rows_at, tag_at, blob_at, blob_size, longest, end = _LANGUAGE_HEAD.unpack_from(s)
    if (magic, version, zero, width, rows_at, end) != (LANGUAGE_MAGIC, 1, 0, _LANGUAGE_ROW.size, _LANGUAGE_HEAD.size, 0) or not 0 < tag_size < 64 or count > 1 << 20:
        raise PackError("bad language header")
    regions = _Regions(s, _LANGUAGE_HEAD.size, "language")
    rows, tag, blob = regions.take(rows_at, count * width), regions.take(tag_at, tag_size), regions.last(blob_at, blob_size)
    deltas = []
    for offset, length, flags, delta, more in _LANGUAGE_ROW.iter_unpack(rows):
        if flags or more or delta == -(2**31):
            raise PackError("bad language row")
        deltas.append((_piece(blob, offset, length), delta))
    _ascending([p for p, _ in deltas])
    if longest != max((len(p) for p, _ in deltas), default=0):
        raise PackError("bad longest surface")
    try:
        return Language(tag.decode("ascii"), tuple(deltas))
    except UnicodeDecodeError as e:
        raise PackError("bad language tag") from e


def write_detector(d: Detector) -> bytes:
    blob, tags, features = bytearray(), b"", []
    for tag, least, _ in d.profiles:
        tags += struct.pack("<IHHii", len(blob), len(tag), 0, least, 0)
        blob += tag.encode()
    for k, (_, _, found) in enumerate(d.profiles):
        for s, w in found:
            features.append((s, k, w, len(blob)))
            blob += s
    features.sort()
    first, k = [], 0
    for b in range(257):
        while k < len(features) and features[k][0][0] < b:
            k += 1
        first.append(k)
    features_at = -(-(48 + len(tags)) // 8) * 8
    first_at = features_at + 16 * len(features)
    blob_at = -(-(first_at + 4 * 257) // 8) * 8
    longest = max((len(f[0]) for f in features), default=0)
    out = struct.pack("<4sHHIIHHIIIIIII", b"MSDT", 1, 0, len(d.profiles), len(features), 16, 16, 48, features_at, first_at, blob_at, len(blob), longest, d.min_margin)
    out = out.ljust(48, b"\0") + tags
    out = out.ljust(features_at, b"\0") + b"".join(struct.pack("<IHHii", at, len(s), k, w, 0) for s, k, w, at in features)
    out += struct.pack("<257I", *first)
    return wrap(DETECTOR, out.ljust(blob_at, b"\0") + bytes(blob))


def read_detector(data: bytes) -> Detector:
    s = section(data, DETECTOR)
    magic, version, _, n, m, w1, w2, at, features_at, _, blob_at, size, _, margin = struct.unpack_from("<4sHHIIHHIIIIIII", s)
    if (magic, version, w1, w2) != (b"MSDT", 1, 16, 16) or not 0 < n <= 256 or blob_at + size != len(s) or features_at + 16 * m > len(s):
        raise PackError("bad detector")
    text = lambda offset, length: s[blob_at + offset : blob_at + offset + length]
    found: list[list[tuple[bytes, int]]] = [[] for _ in range(n)]
    for k in range(m):
        offset, length, profile, weight, _ = struct.unpack_from("<IHHii", s, features_at + 16 * k)
        if profile >= n or weight <= 0 or not length or offset + length > size:
            raise PackError("bad detector feature")
        found[profile].append((text(offset, length), weight))
    profiles = []
    for k in range(n):
        offset, length, _, least, _ = struct.unpack_from("<IHHii", s, at + 16 * k)
        profiles.append((text(offset, length).decode("ascii"), least, tuple(found[k])))
    return Detector(tuple(profiles), margin)


def write_lexer(p: LexProfile) -> bytes:
    """A container of one lexer: comment, string and keyword rows and their surfaces, each kept once."""
    blob, known = bytearray(), {}

    def place(surface: bytes) -> tuple[int, int]:
        if not 0 < len(surface) <= 65535:
            raise PackError("a delimiter or keyword is out of range")
        if surface not in known:
            known[surface] = len(blob)
            blob.extend(surface)
        return known[surface], len(surface)

    raw = lambda words: sorted({w.encode() for w in words})
    blocks = sorted((a.encode(), z.encode(), int(nested)) for a, z, nested in p.block_comments)
    strings = sorted((d.encode(), e.encode()) for d, e in p.strings)
    if not 0 < len(p.name.encode()) < 64 or any(len(e) > 1 for _, e in strings):
        raise PackError("a name or escape is out of range")
    words = lambda found: b"".join(_LEXER_WORD.pack(*place(w), 0) for w in found)
    tables = [words(raw(p.line_comments))]
    rows = []
    for start, stop, nested in blocks:
        (a, m), (b, n) = place(start), place(stop)
        rows.append(_LEXER_BLOCK.pack(a, b, m, n, nested, 0))
    tables.append(b"".join(rows))
    tables.append(b"".join(_LEXER_STRING.pack(*place(d), e[0] if e else 0, 0, 0) for d, e in strings))
    tables.append(words(raw(p.keywords)))
    name = place(p.name.encode())
    out = _Layout(_LEXER_HEAD.size)
    places = [out.add(t) for t in tables]
    blob_at = out.add(bytes(blob))
    longest = max((len(x) for x in [*raw(p.line_comments), *(x for a, z, _ in blocks for x in (a, z)), *(d for d, _ in strings)]), default=0)
    counts = (len(raw(p.line_comments)), len(blocks), len(strings), len(raw(p.keywords)))
    head = _LEXER_HEAD.pack(SECTION_MAGIC[LEXER], 1, 0, *counts, *places, *name, int(p.dollar), blob_at, len(blob), longest, 0)
    return wrap(LEXER, head + bytes(out.body))


def read_lexer(data: bytes) -> LexProfile:
    s = section(data, LEXER)
    if len(s) < _LEXER_HEAD.size:
        raise PackError("bad lexer")
    magic, version, zero, *rest = _LEXER_HEAD.unpack_from(s)
    counts, places, (name_at, name_size, flags, blob_at, blob_size, longest, end) = rest[:4], rest[4:8], rest[8:]
    if (magic, version, zero, places[0], end) != (SECTION_MAGIC[LEXER], 1, 0, _LEXER_HEAD.size, 0) or flags > 1 or not 0 < name_size < 64:
        raise PackError("bad lexer header")
    if any(n > most for n, most in zip(counts, (64, 32, 32, 4096), strict=True)):
        raise PackError("too many lexer rows", 9)
    regions = _Regions(s, _LEXER_HEAD.size, "lexer")
    kinds = (_LEXER_WORD, _LEXER_BLOCK, _LEXER_STRING, _LEXER_WORD)
    line, block, string, keyword = (list(k.iter_unpack(regions.take(at, n * k.size))) for k, n, at in zip(kinds, counts, places, strict=True))
    blob = regions.last(blob_at, blob_size)
    if any(r[-1] for r in (*line, *block, *string, *keyword)) or any(r[4] > 1 for r in block) or any(r[3] for r in string):
        raise PackError("bad lexer row")
    comments, words = ([_piece(blob, r[0], r[1]) for r in rows] for rows in (line, keyword))
    blocks = [(_piece(blob, r[0], r[2]), _piece(blob, r[1], r[3]), bool(r[4])) for r in block]
    strings = [(_piece(blob, r[0], r[1]), bytes([r[2]]) if r[2] else b"") for r in string]
    for found in (comments, [b[0] for b in blocks], [x[0] for x in strings], words):
        _ascending(found)
    if longest != max((len(x) for x in (*comments, *(x for b in blocks for x in b[:2]), *(x[0] for x in strings))), default=0):
        raise PackError("bad longest delimiter")
    try:
        return LexProfile(
            _piece(blob, name_at, name_size).decode(),
            tuple(x.decode() for x in comments),
            tuple((a.decode(), z.decode(), n) for a, z, n in blocks),
            tuple((d.decode(), e.decode()) for d, e in strings),
            frozenset(w.decode() for w in words),
            bool(flags),
        )
    except UnicodeDecodeError as e:
        raise PackError("a lexer's text isn't UTF-8") from e


def read_dfa(s: bytes) -> tuple[dict[tuple[int, int], tuple[int, int]], dict[int, tuple[int, int]], int]:
    """Transitions, accepting states and start of a JSON automaton (our own layout)."""
    x = json.loads(s)
    return {(a, b): (c, d) for a, b, c, d in x["transitions"]}, {a: (b, c) for a, b, c in x["accepts"]}, x["start"]


def from_json(kind: str, text: str):
    """Author a configuration from JSON: model, bpe, language, detector or lexer."""
    x = json.loads(text)

    def surface(p) -> bytes:
        if ("text" in p) == ("hex" in p):
            raise PackError("a piece has either text or hex")
        return p["text"].encode() if "text" in p else bytes.fromhex(p["hex"])

    if kind == "model":
        pieces = [{"surface": surface(p), "id": p.get("id"), "cost": p.get("cost")} for p in x["pieces"]]
        return build_vocabulary(pieces, x.get("byte_cost", 1000))
    if kind == "bpe":
        rows, free = [(b, b, bytes([b])) for b in range(256)], 256
        taken = {p["rank"] for p in x["pieces"] if p.get("rank") is not None}
        for p in sorted(x["pieces"], key=surface):
            rank = p.get("rank")
            if rank is None:
                while free in taken:
                    free += 1
                rank, free = free, free + 1
            rows.append((p.get("id", rank), rank, surface(p)))
        return Vocabulary(tuple(rows), BPE)
    if kind == "language":
        return Language(x["tag"], tuple((surface(p), int(p["delta"])) for p in x["pieces"]))
    if kind == "detector":
        profiles = tuple((tag, int(c.get("min_score", 1)), tuple((surface(f), int(f["weight"])) for f in c.get("features", []))) for tag, c in sorted(x["profiles"].items()))
        return Detector(profiles, int(x.get("min_margin", 20)))
    if kind == "lexer":
        blocks = tuple((b["start"], b["end"], bool(b.get("nested", False))) for b in x.get("block_comments", []))
        strings = tuple((s["delimiter"], s.get("escape") or "") for s in x.get("strings", []))
        return LexProfile(x["name"], tuple(x.get("line_comments", [])), blocks, strings, frozenset(x.get("keywords", [])), bool(x.get("dollar_identifiers", False)))
    raise PackError(f"unknown kind {kind}", 1)


def parse_tiktoken(text: str) -> Vocabulary:
    """A BPE vocabulary from lines of a base64 surface and a rank."""
    rows = []
    for line in text.splitlines():
        if line.strip():
            try:
                a, b = line.split()
                rows.append((int(b), int(b), base64.b64decode(a, validate=True)))
            except ValueError as e:
                raise PackError(f"bad line {line!r}") from e
    return Vocabulary(tuple(rows), BPE)


def format_tiktoken(v: Vocabulary) -> str:
    if v.algorithm != BPE or any(i != c for i, c, _ in v.rows):
        raise PackError("ids and ranks differ")
    return "".join(f"{base64.b64encode(s).decode()} {i}\n" for i, _, s in sorted(v.rows))


def pack_u32(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def unpack_u32(data: bytes) -> list[int]:
    if len(data) % 4:
        raise PackError("ids have four bytes", 1)
    return list(struct.unpack(f"<{len(data) // 4}I", data))
