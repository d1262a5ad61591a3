"""Unicode evidence over bytes that need not be UTF-8: units, clusters, scripts, findings, views.

Offsets are bytes. A byte that isn't part of well-formed UTF-8 is a unit of its own. Property tables
are those of the installed ``regex`` package, decompositions those of ``unicodedata``; both versions
are part of a table set's name.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import regex

INVALID = 0xDC80
BIDI, IGNORABLE, NONCHARACTER, DEPRECATED, MIXED = 1, 2, 3, 4, 5
_PROPERTIES = ("Bidi_Control", "Default_Ignorable_Code_Point", "Noncharacter_Code_Point", "Deprecated")
_CLUSTER = regex.compile(r"\X")
MODES = ("PRESERVE", "NFD", "NFC", "NFKD", "NFKC", "NFKC_CASEFOLD")


def tables_version() -> str:
    return f"regex-{regex.__version__}/unicodedata-{unicodedata.unidata_version}"


def units(data: bytes) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Text (invalid bytes as lone surrogates), code points, and byte starts and lengths of its units."""
    text = data.decode("utf-8", "surrogateescape")
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000)
    lengths[(cps >= 0xDC80) & (cps <= 0xDCFF)] = 1
    starts = np.cumsum(lengths) - lengths
    return text, cps, starts, lengths


def is_invalid(cps: np.ndarray) -> np.ndarray:
    return (cps >= 0xDC80) & (cps <= 0xDCFF)


@functools.cache
def _everything() -> str:
    return "".join(chr(c) if not 0xD800 <= c < 0xE000 else "￾" for c in range(0x110000))


def _mark(pattern: str) -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for m in regex.finditer(f"{pattern}+", _everything()):
        out[m.start() : m.end()] = True
    out[0xD800:0xE000] = False
    return out


@functools.cache
def script_names() -> list[str]:
    """Names by script id: COMMON 0, INHERITED 1, UNKNOWN 2, then the others in order of name."""
    from regex import _regex_core

    values = _regex_core.PROPERTIES["SCRIPT"][1]
    long = {}
    for name, number in values.items():
        # codes have four letters, names mostly not
        if (len(name) != 4, len(name)) > (len(long.get(number, "")) not in (0, 4), len(long.get(number, ""))):
            long[number] = name
    rest = sorted(set(long.values()) - {"COMMON", "INHERITED", "UNKNOWN"})
    return ["COMMON", "INHERITED", "UNKNOWN", *rest]


@functools.cache
def script_table() -> np.ndarray:
    """Script id of each code point."""
    out = np.full(0x110000, 2, np.uint8)
    some = np.flatnonzero(_mark(r"\P{Script=Unknown}"))  # a quarter of all; each script is looked for among them
    among, ids = some.astype("<u4").tobytes().decode("utf-32-le"), np.full(len(some), 2, np.uint8)
    for number, name in enumerate(script_names()):
        if number == 2:
            continue
        for m in regex.finditer(rf"\p{{Script={name}}}+", among):
            part = ids[m.start() : m.end()]
            part[part == 2] = number
    out[some] = ids
    return out


@functools.cache
def flag_table() -> np.ndarray:
    """Bits of the four security properties of each code point."""
    out = np.zeros(0x110000, np.uint8)
    for k, name in enumerate(_PROPERTIES):
        out[_mark(rf"\p{{{name}}}")] |= 1 << k
    out[0xD800:0xE000] = 0
    ends = np.arange(0xFFFE, 0x110000, 0x10000)
    out[np.concatenate((ends, ends + 1, np.arange(0xFDD0, 0xFDF0)))] |= 1 << 2
    out[0xFFFE] |= 1 << 2
    return out


def script_ids(cps: np.ndarray, scripts: np.ndarray) -> np.ndarray:
    out = scripts[np.minimum(cps, 0x10FFFF)].astype(np.int64)
    out[is_invalid(cps)] = 2
    return out


def script_spans(data: bytes, scripts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, script id) of maximal runs; invalid bytes count as UNKNOWN."""
    _, cps, starts, lengths = units(data)
    if not len(cps):
        return []
    ids = script_ids(cps, scripts)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    ends = np.append(starts[first[1:]], len(data))
    return list(zip(starts[first].tolist(), (ends - starts[first]).tolist(), ids[first].tolist(), strict=True))


def findings(data: bytes, scripts: np.ndarray, flags: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(kind, script id, start, length) of each finding: by unit, then by kind.

    Mixed script: the unit's script is significant (not COMMON, INHERITED or UNKNOWN), several are
    in the text, and it isn't the primary one (most units, at equal count the lowest id).
    """
    _, cps, starts, lengths = units(data)
    if not len(cps):
        return []
    ids = script_ids(cps, scripts)
    bits = flags[np.minimum(cps, 0x10FFFF)].copy()
    bits[is_invalid(cps)] = 0
    counts = np.bincount(ids[ids > 2], minlength=3)
    mixed = np.zeros(len(cps), bool)
    if (counts > 0).sum() > 1:
        mixed = (ids > 2) & (ids != int(counts.argmax()))
    out = []
    for k in np.flatnonzero((bits > 0) | mixed).tolist():
        at = (int(ids[k]), int(starts[k]), int(lengths[k]))
        out += [(kind, *at) for kind in (BIDI, IGNORABLE, NONCHARACTER, DEPRECATED) if bits[k] >> (kind - 1) & 1]
        if mixed[k]:
            out.append((MIXED, *at))
    return out


def graphemes(data: bytes) -> list[tuple[int, int]]:
    """(start, length) of extended grapheme clusters; an invalid byte is one of its own."""
    if data.isascii():
        if b"\r\n" not in data:
            return [(i, 1) for i in range(len(data))]
        text, size = data.decode(), len
    else:
        text = data.decode("utf-8", "surrogateescape")

        def size(s: str) -> int:
            return len(s.encode("utf-8", "surrogateescape"))

    out, at = [], 0
    for run in regex.split("([\udc80-\udcff])", text):
        if len(run) == 1 and INVALID <= ord(run) <= 0xDCFF:
            out.append((at, 1))
            at += 1
            continue
        for m in _CLUSTER.finditer(run):
            n = size(m.group())
            out.append((at, n))
            at += n
    return out


# --- normalization ------------------------------------------------------------------------------


@functools.lru_cache(200_000)
def _decomposed(ch: str, mode: str) -> str:
    if mode == "NFKC_CASEFOLD":
        return unicodedata.normalize("NFD", _folded(ch))
    return unicodedata.normalize("NFKD" if "K" in mode else "NFD", ch)


def _folded(ch: str) -> str:
    """NFKC_Casefold of one character: fold and normalise until nothing changes, drop ignorables."""
    ignorable = regex.compile(r"\p{Default_Ignorable_Code_Point}")
    now = ignorable.sub("", ch)
    for _ in range(4):
        new = unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", now).casefold())
        new = ignorable.sub("", new)
        if new == now:
            break
        now = new
    return now


@functools.lru_cache(200_000)
def _composed(a: str, b: str) -> str | None:
    pair = unicodedata.normalize("NFC", a + b)
    return pair if len(pair) == 1 and unicodedata.normalize("NFD", pair) == unicodedata.normalize("NFD", a + b) else None


def normalize(data: bytes, mode: str) -> bytes:
    """The normalised bytes alone; invalid bytes stay and nothing composes across them."""
    if mode == "PRESERVE" or (data.isascii() and mode != "NFKC_CASEFOLD"):
        return data
    out = []
    for run in regex.split("([\udc80-\udcff])", data.decode("utf-8", "surrogateescape")):
        if len(run) == 1 and INVALID <= ord(run) <= 0xDCFF:
            out.append(run)
        elif mode == "NFKC_CASEFOLD":
            out.append(unicodedata.normalize("NFC", "".join(_decomposed(c, mode) for c in run)))
        else:
            out.append(unicodedata.normalize(mode, run))
    return "".join(out).encode("utf-8", "surrogateescape")


def normalize_view(data: bytes, mode: str) -> tuple[bytes, list[tuple[int, int, list[tuple[int, int]]]]]:
    """Normalised bytes and, for each unit of theirs, (start, length, source spans).

    Spans are sorted, without repeats, neighbours merged.
    """
    text, _, starts, lengths = units(data)
    if mode == "PRESERVE" or (mode != "NFKC_CASEFOLD" and unicodedata.is_normalized(mode, text)):  # every unit is its own source
        return data, [(s, n, [(s, n)]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    out: list[tuple[str, int, list[tuple[int, int]]]] = []  # character, combining class, spans
    barrier = 0  # nothing is reordered or composed before this place

    def finish() -> None:
        run = out[barrier:]
        i = 0
        while i < len(run):
            j = i
            while j < len(run) and run[j][1]:
                j += 1
            run[i:j] = sorted(run[i:j], key=lambda u: u[1])
            i = max(j, i) + 1
        if mode in ("NFC", "NFKC", "NFKC_CASEFOLD"):
            kept: list[tuple[str, int, list[tuple[int, int]]]] = []
            starter, last = None, 0
            for ch, ccc, spans in run:
                if starter is not None and (last < ccc or last == 0) and (last == 0 or ccc):
                    joined = _composed(kept[starter][0], ch) if last < ccc or starter == len(kept) - 1 else None
                    if joined:
                        kept[starter] = (joined, 0, kept[starter][2] + spans)
                        continue
                if ccc == 0:
                    starter = len(kept)
                last = ccc
                kept.append((ch, ccc, spans))
            run = kept
        out[barrier:] = run

    for ch, start, length in zip(text, starts.tolist(), lengths.tolist(), strict=True):
        span = [(start, length)]
        if INVALID <= ord(ch) <= 0xDCFF:
            finish()
            out.append((ch, 0, span))
            barrier = len(out)
        else:
            out += [(c, unicodedata.combining(c), span) for c in _decomposed(ch, mode)]
    finish()
    view, at, parts = [], 0, []
    for ch, _, spans in out:
        raw = ch.encode("utf-8", "surrogateescape")
        merged: list[tuple[int, int]] = []
        for s, n in sorted(set(spans)):
            if merged and merged[-1][0] + merged[-1][1] == s:
                merged[-1] = (merged[-1][0], merged[-1][1] + n)
            else:
                merged.append((s, n))
        view.append((at, len(raw), merged))
        at += len(raw)
        parts.append(raw)
    return b"".join(parts), view


# --- routes -------------------------------------------------------------------------------------


def route_classes(cps: np.ndarray) -> np.ndarray:
    """Class of each unit: 1 ASCII letter, digit or underscore; 2 Devanagari; 3 kana and Han; 4 other
    beyond ASCII, invalid bytes too; 0 the rest."""
    kind = np.where(cps >= 0x80, 4, 0)
    kind[((cps >= 48) & (cps <= 57)) | ((cps >= 65) & (cps <= 90)) | ((cps >= 97) & (cps <= 122)) | (cps == 95)] = 1
    kind[(cps >= 0x900) & (cps <= 0x97F)] = 2
    kind[((cps >= 0x3040) & (cps <= 0x30FF)) | ((cps >= 0x3400) & (cps <= 0x9FFF))] = 3
    return kind


def routes(data: bytes) -> list[tuple[int, int, int]]:
    """(class, start, length) of maximal runs of a class."""
    _, cps, starts, _ = units(data)
    if not len(cps):
        return []
    kind = route_classes(cps)
    first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    ends = np.append(starts[first[1:]], len(data))
    return list(zip(kind[first].tolist(), starts[first].tolist(), (ends - starts[first]).tolist(), strict=True))
