"""Declarative lexing of bytes and the parts of identifiers, numbers and strings."""

from __future__ import annotations

import functools
import re

import numpy as np

from .vocab import LexProfile

SPACE, NEWLINE, IDENTIFIER, KEYWORD, NUMBER, STRING, COMMENT, PUNCTUATION, ERROR = range(1, 10)
PART, SIGN, RADIX, INTEGER, FRACTION, EXP_MARK, EXP_SIGN, EXP_DIGITS, DELIMITER, CONTENT = range(1, 11)


@functools.cache
def _scanner(p: LexProfile) -> tuple[re.Pattern[bytes], list[tuple[int, object]], frozenset[bytes]]:
    """One alternation in order of precedence (longer delimiters first), and what each branch means."""
    esc = lambda s: re.escape(s.encode())
    first = b"A-Za-z_\\x80-\\xff" + (b"$" if p.dollar else b"")
    branches: list[tuple[bytes, int, object]] = [(b"\\r\\n|\\r|\\n", NEWLINE, None), (b"[ \\t\\v\\f]+", SPACE, None)]
    branches += [(esc(x) + b"[^\\r\\n]*", COMMENT, None) for x in sorted(p.line_comments, key=len, reverse=True)]
    for start, end, nested in sorted(p.block_comments, key=lambda b: len(b[0]), reverse=True):
        branches.append((esc(start), COMMENT, (start.encode(), end.encode(), nested)))
    for mark, escape in sorted(p.strings, key=lambda s: len(s[0]), reverse=True):
        d, e = esc(mark), esc(escape) if escape else None
        inner = b"(?:" + (e + b"[\\s\\S]|(?!" + e + b")" if e else b"") + b"(?!" + d + b")[\\s\\S])*"
        branches += [(d + inner + d, STRING, None), (d + b"[\\s\\S]*", ERROR, None)]
    branches.append((b"[" + first + b"][" + first + b"0-9]*", IDENTIFIER, None))
    branches.append((b"[0-9](?:[0-9A-Za-z_.']|(?<=[eEpP])[+-])*", NUMBER, None))
    branches.append((b"[\\s\\S]", PUNCTUATION, None))
    pattern = re.compile(b"|".join(b"(" + b + b")" for b, _, _ in branches))
    return pattern, [(k, x) for _, k, x in branches], frozenset(k.encode() for k in p.keywords)


def lex(p: LexProfile, data: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, length) tokens that partition data."""
    pattern, branches, keywords = _scanner(p)
    out, at, n = [], 0, len(data)
    while at < n:
        m = pattern.match(data, at)
        kind, block = branches[m.lastindex - 1]
        end = m.end()
        if block is not None:
            end, closed = _block_end(data, end, *block)
            kind = COMMENT if closed else ERROR
        elif kind == IDENTIFIER and m.group() in keywords:
            kind = KEYWORD
        out.append((kind, at, end - at))
        at = end
    return out


@functools.cache
def _fast(p: LexProfile) -> tuple[re.Pattern[bytes], np.ndarray]:
    """One pattern of which every match is a token, where no block comment begins; kinds by branch."""
    _, branches, keywords = _scanner(p)
    pattern = _scanner(p)[0].pattern
    first = b"A-Za-z_\\x80-\\xff" + (b"$" if p.dollar else b"")
    if not keywords:
        return re.compile(pattern), np.array([0, *(k for k, _ in branches)], np.int64)
    words = b"|".join(re.escape(k) for k in sorted(keywords, key=len, reverse=True))
    place = next(i for i, (k, _) in enumerate(branches) if k == IDENTIFIER)
    at = pattern.index(b"([" + first + b"][" + first + b"0-9]*)")
    pattern = pattern[:at] + b"((?:" + words + b")(?![" + first + b"0-9]))|" + pattern[at:]
    kinds = [k for k, _ in branches]
    return re.compile(pattern), np.array([0, *kinds[:place], KEYWORD, *kinds[place:]], np.int64)


def scan(p: LexProfile, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and ends of the tokens of ``lex``."""
    if any(start.encode() in data for start, _, _ in p.block_comments):
        found = np.array(lex(p, data), np.int64).reshape(-1, 3)
        return found[:, 0], found[:, 1] + found[:, 2]
    pattern, kinds = _fast(p)
    found = np.array([m.end() << 8 | m.lastindex for m in pattern.finditer(data)], np.int64)  # fewer branches than 256
    return kinds[found & 255], found >> 8


@functools.cache
def _classes(p: LexProfile) -> tuple[np.ndarray, np.ndarray] | None:
    """Kind of a token that begins with each byte, and where a comment or a string may begin; None where one of those begins as other tokens do."""
    kinds, odd = np.full(256, PUNCTUATION, np.uint8), np.zeros(256, bool)
    kinds[[10, 13]], kinds[[9, 11, 12, 32]], kinds[48:58] = NEWLINE, SPACE, NUMBER
    kinds[[95, *range(65, 91), *range(97, 123), *range(128, 256), *([36] if p.dollar else [])]] = IDENTIFIER
    for mark in (*p.line_comments, *(start for start, _, _ in p.block_comments), *(mark for mark, _ in p.strings)):
        if not mark or kinds[mark.encode()[0]] != PUNCTUATION:
            return None
        odd[mark.encode()[0]] = True
    return kinds, odd


def scan_many(p: LexProfile, sources: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds and begins of the tokens of ``lex`` of all sources, laid one behind the other, and tokens of each source.

    Spaces, newlines, words and punctuation follow from a byte and the one before it, for whole
    arrays; the scanner looks only where a comment, a string or a number may begin.
    """
    lengths = np.fromiter(map(len, sources), np.int64, len(sources))
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    if _classes(p) is None:
        found = [scan(p, d) for d in sources]
        starts = [np.concatenate(([a], a + e))[:-1] for a, (_, e) in zip(bounds.tolist(), found, strict=False)]
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        return join(k for k, _ in found), join(starts), np.array([len(k) for k, _ in found], np.int64)
    pattern, branches, keywords = _scanner(p)
    (kinds, odd), b = _classes(p), np.frombuffer(b"".join(sources), np.uint8)
    kind = kinds[b]
    word, space, begin = (kind == IDENTIFIER) | (kind == NUMBER), kind == SPACE, np.ones(len(b), bool)
    begin[1:] = ~(word[1:] & word[:-1] | space[1:] & space[:-1] | (b[1:] == 10) & (b[:-1] == 13))
    begin[bounds[:-1][lengths > 0]] = True
    look = np.flatnonzero(odd[b] | begin & (kind == NUMBER))
    done = 0
    for place, owner in zip(look.tolist(), (np.searchsorted(bounds, look, "right") - 1).tolist(), strict=True):
        if place < done:
            continue
        base, data = int(bounds[owner]), sources[owner]
        at, n = place - base, len(data)
        while True:
            m = pattern.match(data, at)
            one, block = branches[m.lastindex - 1]
            end = m.end()
            if block is not None:
                end, closed = _block_end(data, end, *block)
                one = COMMENT if closed else ERROR
            begin[base + at + 1 : base + end] = False
            kind[base + at] = one
            at = end
            if at < n:
                begin[base + at] = True
            if at >= n or not 48 <= data[at] < 58:
                break
        done = base + at
    first = np.flatnonzero(begin)
    found, size = kind[first].astype(np.int64), np.diff(np.append(first, len(b)))
    named = found == IDENTIFIER
    for n in {len(k) for k in keywords}:
        at = np.flatnonzero(named & (size == n))
        if n and len(at):
            same = np.ascontiguousarray(b[first[at][:, None] + np.arange(n)]).view(f"S{n}").ravel()
            found[at[np.isin(same, np.array([k for k in keywords if len(k) == n]))]] = KEYWORD
    return found, first, np.diff(np.searchsorted(first, bounds))


def identifier_cuts(b: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``identifier_parts`` cuts tokens that begin at some bytes, were they all identifiers, and which bytes are of no part."""
    digit, upper, lower = (b >= 48) & (b < 58), (b >= 65) & (b < 91), (b >= 97) & (b < 123)
    after = np.zeros(len(b), bool)
    after[:-1] = lower[1:] & ~begin[1:]
    none = (b == 95) | (b == 36)
    cut = none | begin
    cut[1:] |= none[:-1] | (digit[1:] != digit[:-1]) | upper[1:] & (lower[:-1] | upper[:-1] & after[1:])
    return cut, none


def _block_end(data: bytes, at: int, start: bytes, end: bytes, nested: bool) -> tuple[int, bool]:
    """Where a comment ends whose opening delimiter ends at a place, and whether it does."""
    depth = 1
    while depth:
        close = data.find(end, at)
        opens = data.find(start, at) if nested else -1
        if 0 <= opens and (close < 0 or opens <= close):
            depth, at = depth + 1, opens + len(start)
        elif close >= 0:
            depth, at = depth - 1, close + len(end)
        else:
            return len(data), False
    return at, True


def identifier_parts(word: bytes) -> list[tuple[int, int]]:
    """(start, length) of parts: cut at _ and $, digits, camelCase and the last capital of an acronym."""
    out, begin = [], 0

    def close(end: int) -> None:
        if end > begin:
            out.append((begin, end - begin))

    for i in range(len(word)):
        c = word[i : i + 1]
        if c in b"_$":
            close(i)
            begin = i + 1
        elif i > begin:
            before, after = word[i - 1 : i], word[i + 1 : i + 2]
            new = c.isdigit() != before.isdigit() or (c.isupper() and (before.islower() or (before.isupper() and after.islower())))
            if new:
                close(i)
                begin = i
    close(len(word))
    return out


_NUMBER = re.compile(rb"([+-])?(0[xXbBoO])?([^.eEpP]*)(?:(\.)([^eEpP]*))?(?:([eEpP])([+-])?([\s\S]*))?")


def number_parts(word: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, length): sign, radix, integer, fraction, exponent mark, sign and digits; none empty."""
    m = _NUMBER.match(word)
    kinds = {1: SIGN, 2: RADIX, 3: INTEGER, 5: FRACTION, 6: EXP_MARK, 7: EXP_SIGN, 8: EXP_DIGITS}
    return [(k, m.start(g), m.end(g) - m.start(g)) for g, k in kinds.items() if m[g]]


def string_parts(p: LexProfile, word: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, length): opening delimiter, closing one, content."""
    marks = sorted((s.encode() for s, _ in p.strings), key=len, reverse=True)
    mark = next((d for d in marks if word.startswith(d)), None)
    if mark is None:
        return []
    n, size = len(word), len(mark)
    out = [(DELIMITER, 0, size)]
    end = n
    if n - size >= size and word.endswith(mark):
        end = n - size
        out.append((DELIMITER, end, size))
    if end > size:
        out.append((CONTENT, size, end - size))
    return out


def components(p: LexProfile, data: bytes, tokens: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, index of the lexical token, start, length) of all parts."""
    out = []
    for index, (kind, start, length) in enumerate(tokens):
        word = data[start : start + length]
        if kind == IDENTIFIER:
            out += [(PART, index, start + a, n) for a, n in identifier_parts(word)]
        elif kind == NUMBER:
            out += [(k, index, start + a, n) for k, a, n in number_parts(word)]
        elif kind == STRING:
            out += [(k, index, start + a, n) for k, a, n in string_parts(p, word)]
    return out
