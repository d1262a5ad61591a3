"""Evidence of many sources at once, as whole columns.

A batch's texts are decoded each for itself and laid one behind the other; what a neighbourhood of
plain characters decides is decided for whole arrays, and only the few places that need more go
through the functions for one source.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

from . import lexer, text
from .vocab import LexProfile


class Batch:
    """Code points of all sources, the bytes that each takes and where; ``edges`` and ``bounds`` are
    each source's first unit and first byte, and the ends."""

    def __init__(self, sources: list[bytes]):
        self.sources = sources
        texts = [d.decode("utf-8", "surrogateescape") for d in sources]
        self.text = "".join(texts)
        self.edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        self.bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, sources), np.int64, len(sources)))))
        self.cps = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        c = self.cps
        self.lengths = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        self.lengths[text.is_invalid(c)] = 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.edges))

    def local(self, units: np.ndarray) -> np.ndarray:
        """Byte places of units within their own sources."""
        return self.starts[units] - self.bounds[self.owner[units]]

    def runs(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First units of the maximal runs of one value within a source, their bytes, and runs of each source."""
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        new[self.edges[:-1][self.edges[:-1] < len(values)]] = True
        first = np.flatnonzero(new)
        return first, np.diff(np.append(self.starts[first], self.bounds[-1])), self.per_source(first)

    def per_source(self, units: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner[units], minlength=len(self.sources))


@functools.cache
def _alone() -> np.ndarray:
    """0: may join its neighbours in a cluster; 1: doesn't join another such; 2: never joins."""
    out = np.zeros(0x110000, np.uint8)
    out[_others()] = 1
    out[text._mark(r"\p{Grapheme_Cluster_Break=Control}")] = 2
    out[[10, 13]] = 0
    out[0xD800:0xE000] = 0
    out[0xDC80:0xDD00] = 2
    return out


def _others() -> np.ndarray:
    return text._mark(r"\p{Grapheme_Cluster_Break=Other}") & ~text._mark(r"\p{Extended_Pictographic}") & ~text._mark(r"\p{Indic_Conjunct_Break=Consonant}")


def clusters(b: Batch) -> np.ndarray:
    """First units of the extended grapheme clusters of all sources."""
    kind = _alone()[np.minimum(b.cps, 0x10FFFF)]
    sure = np.ones(len(kind), bool)
    sure[1:] = (kind[1:] > 0) & (kind[:-1] > 0) | (kind[1:] == 2) | (kind[:-1] == 2)
    sure[1:] |= (b.cps[1:] < 0x80) & (b.cps[1:] != 10) & (b.cps[:-1] < 0x80)
    sure[b.edges[:-1][b.edges[:-1] < len(kind)]] = True
    first = np.flatnonzero(sure)
    size = np.diff(np.append(first, len(kind)))
    for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        for m in _cut(b.text[a : a + n]):
            sure[a + m] = True
    return np.flatnonzero(sure)


@functools.lru_cache(100_000)
def _cut(run: str) -> tuple[int, ...]:
    return tuple(m.start() for m in text._CLUSTER.finditer(run))


def findings(b: Batch, scripts: np.ndarray, flags: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns kind, script id, start, length of all findings, and how many each source has."""
    ids = text.script_ids(b.cps, scripts)
    bits = flags[np.minimum(b.cps, 0x10FFFF)].copy()
    bits[text.is_invalid(b.cps)] = 0
    n, width = len(b.sources), int(ids.max(initial=2)) + 1
    real = ids > 2
    counts = np.bincount(b.owner[real] * width + ids[real], minlength=n * width).reshape(n, width)
    several, primary = (counts > 0).sum(1) > 1, counts.argmax(1)
    mixed = real & several[b.owner] & (ids != primary[b.owner])
    at, kinds = [], []
    for kind in (text.BIDI, text.IGNORABLE, text.NONCHARACTER, text.DEPRECATED):
        hit = np.flatnonzero(bits >> (kind - 1) & 1)
        at.append(hit)
        kinds.append(np.full(len(hit), kind))
    at.append(np.flatnonzero(mixed))
    kinds.append(np.full(len(at[-1]), text.MIXED))
    at, kinds = np.concatenate(at), np.concatenate(kinds)
    order = np.lexsort((kinds, at))
    at = at[order]
    return [kinds[order], ids[at], b.local(at), b.lengths[at]], b.per_source(at)


_PIECE = regex.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")


def views(b: Batch, mode: str) -> tuple[list[bytes], np.ndarray, list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Normalised bytes; units of each source; their starts and lengths; spans of each unit; theirs.

    Nothing is reordered or composed across the place before an ASCII character, so that only
    pieces of one such and what isn't ASCII behind it are looked at, those that aren't normalised
    already once for each worker.
    """
    if mode == "NFKC_CASEFOLD":
        return _each(b, mode)
    size, span_size, start, span = b.lengths.copy(), np.ones(len(b.cps), np.int64), b.local(np.arange(len(b.cps))), None
    out, per, units, spans = [], [], [[], []], [[], []]
    span_counts = []
    for k, data in enumerate(b.sources):
        a, z = int(b.edges[k]), int(b.edges[k + 1])
        odd = [] if mode == "PRESERVE" or data.isascii() else [m.span() for m in _PIECE.finditer(b.text, a, z) if not _is_normal(mode, m.group())]
        if not odd:
            out.append(data)
            per.append(z - a)
            for x, whole in zip((*units, *spans), (start, size, start, size), strict=True):
                x.append(whole[a:z])
            span_counts.append(span_size[a:z])
            continue
        parts, made, at, now = [], 0, 0, a
        for x, y in [*odd, (z, z)]:
            plain = slice(now, x)
            raw = data[int(start[now]) if now < z else len(data) : int(start[x]) if x < z else len(data)]
            parts.append(raw)
            shift = at - (int(start[now]) if now < z else len(data))
            units[0].append(start[plain] + shift)
            units[1].append(size[plain])
            spans[0].append(start[plain])
            spans[1].append(size[plain])
            span_counts.append(span_size[plain])
            made += x - now
            at += len(raw)
            if x < y:
                view, us, ul, counts, ss, sl = _view(mode, b.text[x:y])
                parts.append(view)
                units[0].append(us + at)
                units[1].append(ul)
                spans[0].append(ss + int(start[x]))
                spans[1].append(sl)
                span_counts.append(counts)
                made += len(us)
                at += len(view)
            now = y
        out.append(b"".join(parts))
        per.append(made)
    join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    return out, np.array(per, np.int64), [join(x) for x in units], join(span_counts), [join(x) for x in spans]


@functools.lru_cache(100_000)
def _is_normal(mode: str, piece: str) -> bool:
    import unicodedata

    return unicodedata.is_normalized(mode, piece)


@functools.lru_cache(50_000)
def _view(mode: str, piece: str):
    view, units = text.normalize_view(piece.encode("utf-8", "surrogateescape"), mode)
    return view, *_flat(units)


def _flat(units):
    whole = lambda x: np.array(x, np.int64)
    return whole([u[0] for u in units]), whole([u[1] for u in units]), whole([len(u[2]) for u in units]), whole([s[0] for u in units for s in u[2]]), whole([s[1] for u in units for s in u[2]])


def _each(b: Batch, mode: str):
    found = [text.normalize_view(d, mode) for d in b.sources]
    flat = [_flat(units) for _, units in found]
    join = lambda i: np.concatenate([np.zeros(0, np.int64), *(x[i] for x in flat)])
    return [v for v, _ in found], np.array([len(u) for _, u in found], np.int64), [join(0), join(1)], join(2), [join(3), join(4)]


class _Words:
    """Parts of numbers and strings that were seen, numbered: kinds, places and sizes of all of them in three columns.

    Only what is new since the last call is turned into arrays, so that a batch costs what is in it.
    """

    MOST = 200_000

    def __init__(self, p: LexProfile):
        self.profile = p
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[int, dict[bytes, int]] = {k: {} for k in (lexer.NUMBER, lexer.STRING)}
        self.count = self.done = 0  # parts, and those that are in ``whole``
        self.first, self.parts = [0], []
        self.whole, self.firsts = np.zeros((1024, 3), np.int64), np.zeros(1024, np.int64)
        self.known = 0  # of ``first``, those that are in ``firsts``

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """First part of each word and the end; kind, place and size of each part."""
        self.firsts, self.known = _appended(self.firsts, self.known, self.first[self.known :])
        self.whole, self.done = _appended(self.whole, self.done, self.parts)
        self.parts.clear()
        return self.firsts[: self.known], self.whole[: self.done]

    def number(self, kind: int, word: bytes) -> int:
        for k, _, start, n in lexer.components(self.profile, word, [(kind, 0, len(word))]):
            self.parts.append((k, start, n))
            self.count += 1
        self.first.append(self.count)
        number = self.numbers[kind][word] = len(self.first) - 2
        return number


def _appended(held: np.ndarray, n: int, rows: list) -> tuple[np.ndarray, int]:
    """held, whose first n rows count, with more rows; it is made twice as large where they don't fit."""
    more = n + len(rows)
    if more > len(held):
        old, held = held, np.zeros((max(more, 2 * len(held)), *held.shape[1:]), held.dtype)
        held[:n] = old[:n]
    if rows:
        held[n:more] = rows
    return held, more


@functools.lru_cache(8)
def _words(p: LexProfile) -> _Words:
    return _Words(p)


def lexed(p: LexProfile, sources: list[bytes], parts: bool) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray], np.ndarray]:
    """Columns kind, start, length of all lexical tokens, and how many each source has; then kind,
    lexical index, start and length of all parts if asked for, and how many each source has.

    Identifiers are cut in whole arrays; the parts of numbers and strings are remembered.
    """
    kinds, first, per = lexer.scan_many(p, sources)
    data = b"".join(sources)
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, sources), np.int64, len(sources)))))
    owner, ends = np.repeat(np.arange(len(sources)), per), np.append(first, len(data))
    sizes = np.diff(ends)
    out = [kinds, first - bounds[owner], sizes]
    if not parts:
        return out, per, [np.zeros(0, np.int64)] * 4, np.zeros(len(sources), np.int64)
    begin = np.zeros(len(data), bool)
    begin[first] = True
    inside = np.repeat(kinds == lexer.IDENTIFIER, sizes)
    cut, none = lexer.identifier_cuts(np.frombuffer(data, np.uint8), begin)
    cuts = np.flatnonzero(cut & inside | begin)
    named = (inside & ~none)[cuts]
    at, size = cuts[named], np.diff(np.append(cuts, len(data)))[named]
    kind, token = np.full(len(at), lexer.PART, np.int64), np.searchsorted(first, at, "right") - 1
    some = np.flatnonzero((kinds == lexer.NUMBER) | (kinds == lexer.STRING))
    if len(some):
        words = _words(p)
        if len(words.first) > words.MOST:
            words.clear()
        found, numbers = words.numbers, []
        for k, a, z in zip(kinds[some].tolist(), first[some].tolist(), ends[some + 1].tolist(), strict=True):
            word = data[a:z]
            number = found[k].get(word)
            numbers.append(words.number(k, word) if number is None else number)
        (start, seen), which = words.arrays(), np.array(numbers, np.int64)
        n = np.diff(start)[which]
        more = seen[np.repeat(start[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        token = np.concatenate((token, np.repeat(some, n)))
        order = np.argsort(token, kind="stable")
        token = token[order]
        kind = np.concatenate((kind, more[:, 0]))[order]
        at = np.concatenate((at, np.repeat(first[some], n) + more[:, 1]))[order]
        size = np.concatenate((size, more[:, 2]))[order]
    of = owner[token]
    return out, per, [kind, token - (np.cumsum(per) - per)[of], at - bounds[of], size], np.bincount(of, minlength=len(sources)).astype(np.int64)
