"""Vocabularies, language deltas, detector and lexer profiles as plain Python values."""

from __future__ import annotations

from dataclasses import dataclass, field

VITERBI, BPE = 0, 1

# The built-in vocabulary, language deltas, detector features and lexer profiles.
BASE_PIECES = (
    (256, 120, "hello"),
    (257, 110, " world"),
    (258, 220, "hello world"),
    (259, 75, "the"),
    (260, 60, "ing"),
    (261, 55, "er"),
    (262, 40, " "),
    (263, 65, "token"),
    (264, 65, "izer"),
    (265, 100, "नमस्ते"),
    (266, 100, "世界"),
    (267, 90, "こんにちは"),
    (268, 55, "::"),
    (269, 55, "->"),
    (270, 70, "_id"),
    (271, 150, "tokenizer"),
    (272, 100, " दुनिया"),
    (273, 230, "नमस्ते दुनिया"),
    (274, 210, "こんにちは世界"),
)
BYTE_COST = 100
RAW_BPE_PIECES = ((256, "ab"), (257, "bc"), (258, "abc"), (259, "cab"), (260, "abcab"))
LANGUAGE_DELTAS = {
    "en": (("tokenizer", -40), ("hello world", -10)),
    "hi": (("नमस्ते दुनिया", -60),),
    "ja": (("こんにちは世界", -60),),
}
DETECTOR_PROFILES = {
    "en": (100, (("tokenizer", 120), ("hello", 80), ("world", 50))),
    "hi": (100, (("नमस्ते", 120), ("दुनिया", 80))),
    "ja": (100, (("こんにちは", 120), ("世界", 80))),
}
DETECTOR_MIN_MARGIN = 20
C_KEYWORDS = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while"
PYTHON_KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
RUST_KEYWORDS = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while"
JSON_KEYWORDS = "false null true"
# End of fixed values.


class PackError(ValueError):
    """Configuration that is not valid; ``status`` says why."""

    def __init__(self, message: str, status: int = 3):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Vocabulary:
    """Rows (token id, cost or rank, surface). All 256 single bytes have to be there.

    Weighted vocabularies may give a surface several ids.
    """

    rows: tuple[tuple[int, int, bytes], ...]
    algorithm: int = VITERBI

    def __post_init__(self):
        ids, surfaces = {r[0] for r in self.rows}, {r[2] for r in self.rows}
        if len(ids) != len(self.rows):
            raise PackError("token ids must be unique")
        if len(surfaces) != len(self.rows) and self.algorithm == BPE:
            raise PackError("surfaces must be unique")
        if any(bytes([b]) not in surfaces for b in range(256)):
            raise PackError("a single byte is missing")
        if any(not 0 < len(s) <= 65535 for s in surfaces) or any(not 0 <= i < 2**32 for i in ids):
            raise PackError("a surface or id is out of range")
        if self.algorithm == BPE:
            ranks = [r[1] for r in self.rows]
            if len(set(ranks)) != len(ranks) or min(ranks) < 0:
                raise PackError("ranks must be unique and not negative")
        object.__setattr__(self, "rows", tuple(sorted(self.rows, key=lambda r: (r[2], r[0]))))

    @property
    def max_len(self) -> int:
        return max(len(r[2]) for r in self.rows)


def build_vocabulary(pieces, byte_cost: int = 1000) -> Vocabulary:
    """Vocabulary of weighted pieces {surface, id?, cost?}: missing ids from 256 on in surface order."""
    rows = [(b, byte_cost, bytes([b])) for b in range(256)]
    taken = set(range(256)) | {p["id"] for p in pieces if p.get("id") is not None}
    free = 256
    for p in sorted(pieces, key=lambda p: p["surface"]):
        number = p.get("id")
        if number is None:
            while free in taken:
                free += 1
            number = free
            taken.add(number)
        rows.append((number, p["cost"] if p.get("cost") is not None else byte_cost - 1, p["surface"]))
    return Vocabulary(tuple(rows))


def base_vocabulary() -> Vocabulary:
    return Vocabulary(tuple((b, BYTE_COST, bytes([b])) for b in range(256)) + tuple((i, c, s.encode()) for i, c, s in BASE_PIECES))


def raw_bpe_vocabulary() -> Vocabulary:
    return Vocabulary(tuple((b, b, bytes([b])) for b in range(256)) + tuple((i, i, s.encode()) for i, s in RAW_BPE_PIECES), BPE)


@dataclass(frozen=True)
class Language:
    tag: str
    deltas: tuple[tuple[bytes, int], ...]

    def __post_init__(self):
        if not 0 < len(self.tag) < 64 or not all(c.isascii() and (c.isalnum() or c == "-") for c in self.tag):
            raise PackError(f"invalid language tag {self.tag!r}")
        if len({s for s, _ in self.deltas}) != len(self.deltas):
            raise PackError("a surface has two deltas")


def base_language(tag: str) -> Language:
    return Language(tag, tuple((s.encode(), d) for s, d in LANGUAGE_DELTAS[tag]))


@dataclass(frozen=True)
class Detector:
    """profiles: (tag, least score, ((surface, weight), ...)), in the order of their index."""

    profiles: tuple[tuple[str, int, tuple[tuple[bytes, int], ...]], ...]
    min_margin: int = DETECTOR_MIN_MARGIN

    def scores(self, data: bytes) -> list[int]:
        """Weighted counts of all occurrences, overlapping ones too."""
        return [sum(w * count_overlapping(data, s) for s, w in features) for _, _, features in self.profiles]

    def decide(self, scores: list[int]) -> tuple[bool, int, int, str | None]:
        """(matched, score, margin, tag): equal scores go to the lower index."""
        best = max(range(len(scores)), key=lambda k: (scores[k], -k))
        second = max((s for k, s in enumerate(scores) if k != best), default=0)
        margin = scores[best] - second
        tag, least, _ = self.profiles[best]
        matched = scores[best] >= least and margin >= self.min_margin
        return matched, scores[best], margin, tag if matched else None

    def detect(self, data: bytes) -> tuple[bool, int, int, str | None]:
        return self.decide(self.scores(data))


def count_overlapping(data: bytes, surface: bytes) -> int:
    n, at = 0, data.find(surface)
    while at >= 0:
        n += 1
        at = data.find(surface, at + 1)
    return n


def base_detector() -> Detector:
    return Detector(tuple((tag, least, tuple((s.encode(), w) for s, w in features)) for tag, (least, features) in sorted(DETECTOR_PROFILES.items())))


@dataclass(frozen=True)
class LexProfile:
    name: str
    line_comments: tuple[str, ...] = ()
    block_comments: tuple[tuple[str, str, bool], ...] = ()
    strings: tuple[tuple[str, str], ...] = ()
    keywords: frozenset[str] = field(default_factory=frozenset)
    dollar: bool = False


LEX_PROFILES = {
    "c": LexProfile("c", ("//",), (("/*", "*/", False),), (('"', "\\"), ("'", "\\")), frozenset(C_KEYWORDS.split())),
    "json": LexProfile("json", (), (), (('"', "\\"),), frozenset(JSON_KEYWORDS.split())),
    "python": LexProfile("python", ("#",), (), (('"""', "\\"), ("'''", "\\"), ('"', "\\"), ("'", "\\")), frozenset(PYTHON_KEYWORDS.split())),
    "rust": LexProfile("rust", ("//",), (("/*", "*/", True),), (('"', "\\"), ("'", "\\")), frozenset(RUST_KEYWORDS.split())),
}
