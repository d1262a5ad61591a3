"""Fill-in-middle rearrangement of texts held as ropes.

A text is a balanced tree over leaves of its UTF-8 bytes; every node caches how many units and code
points stand under it. A cut at a rank of units walks down from the root and splits one leaf; the
three subtrees are concatenated in another order with sentinels between them. The way back builds
a rope of the rearranged text and splits it at the sentinels' ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import _slices
from .shared import IS_SPACE, bounded_batches

#: Bytes of a leaf at most, but for the rest of its last code point.
LEAF = 1 << 14
#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts, how many are rearranged, and of 100 of these, how many begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
UNITS = ("chars", "words", "lines")


def unit_starts(data: np.ndarray, before: int, unit: str) -> np.ndarray:
    """Places of data at which a unit starts; before: the byte in front of data, -1 at the text's start.

    chars: code points. words: a run of other than ASCII white space with the white space behind it
    (white space that begins a text is a unit). lines: up to and including a line feed.
    """
    if unit == "chars":
        return np.flatnonzero((data & 0xC0) != 0x80)
    previous = np.empty(len(data), np.int16)
    previous[0], previous[1:] = before, data[:-1]
    if unit == "lines":
        starts = previous == 10
    else:
        starts = IS_SPACE[previous] & ~IS_SPACE[data]
    starts[0] = starts[0] and before >= 0 or before < 0
    return np.flatnonzero(starts)


class Rope:
    """A node of a height-balanced tree: a leaf of bytes, or two ropes. Nodes are never changed.

    starts: places of a leaf at which units start. A unit belongs to the leaf in which it starts.
    """

    __slots__ = ("data", "height", "left", "points", "right", "size", "starts", "units")

    def __init__(self, data: np.ndarray | None, starts: np.ndarray | None = None, left: Rope | None = None, right: Rope | None = None):
        self.data, self.starts, self.left, self.right = data, starts, left, right
        if data is not None:
            self.height, self.size, self.units = 0, len(data), len(starts)
            self.points = int(np.count_nonzero((data & 0xC0) != 0x80))
        else:
            self.height = 1 + max(left.height, right.height)
            self.size, self.units, self.points = left.size + right.size, left.units + right.units, left.points + right.points

    @staticmethod
    def of(text: bytes, unit: str = "chars", leaf: int = LEAF) -> Rope | None:
        """The rope of a text, None if it is empty. Leaves end where code points do."""
        data, cuts = np.frombuffer(text, np.uint8), [0]
        while cuts[-1] < len(text):
            end = min(cuts[-1] + leaf, len(text))
            while end < len(text) and data[end] & 0xC0 == 0x80:
                end += 1
            cuts.append(end)
        return Rope.build([Rope(data[a:b], unit_starts(data[a:b], int(data[a - 1]) if a else -1, unit)) for a, b in pairwise(cuts)])

    @staticmethod
    def build(ropes: list[Rope]) -> Rope | None:
        """A balanced tree over leaves in order."""
        while len(ropes) > 1:
            ropes = [Rope(None, None, *ropes[i : i + 2]) if i + 1 < len(ropes) else ropes[i] for i in range(0, len(ropes), 2)]
        return ropes[0] if ropes else None

    @staticmethod
    def concat(a: Rope | None, b: Rope | None) -> Rope | None:
        """a followed by b: the lower tree is hung in at its height on the other's inner edge."""
        if a is None or b is None:
            return a or b
        if a.height > b.height + 1:
            return Rope._balanced(a.left, Rope.concat(a.right, b))
        if b.height > a.height + 1:
            return Rope._balanced(Rope.concat(a, b.left), b.right)
        return Rope(None, None, a, b)

    @staticmethod
    def _balanced(a: Rope, b: Rope) -> Rope:
        if b.height > a.height + 1:
            if b.left.height > b.right.height:
                return Rope(None, None, Rope(None, None, a, b.left.left), Rope(None, None, b.left.right, b.right))
            return Rope(None, None, Rope(None, None, a, b.left), b.right)
        if a.height > b.height + 1:
            if a.right.height > a.left.height:
                return Rope(None, None, Rope(None, None, a.left, a.right.left), Rope(None, None, a.right.right, b))
            return Rope(None, None, a.left, Rope(None, None, a.right, b))
        return Rope(None, None, a, b)

    def split(self, rank: int) -> tuple[Rope | None, Rope | None]:
        """What stands before the unit of this rank (from 0), and the rest; all and nothing beyond the last."""
        if self.data is not None:
            at = int(self.starts[rank]) if rank < self.units else self.size
            return self._cut(0, at), self._cut(at, self.size)
        if rank < self.left.units:
            a, b = self.left.split(rank)
            return a, Rope.concat(b, self.right)
        a, b = self.right.split(rank - self.left.units)
        return Rope.concat(self.left, a), b

    def _cut(self, a: int, b: int) -> Rope | None:
        if a == b:
            return None
        lo, hi = np.searchsorted(self.starts, (a, b))
        return Rope(self.data[a:b], self.starts[lo:hi] - a)

    def leaves(self) -> Iterator[np.ndarray]:
        held = [self]
        while held:
            rope = held.pop()
            if rope.data is not None:
                yield rope.data
            else:
                held += (rope.right, rope.left)

    @staticmethod
    def text(rope: Rope | None) -> bytes:
        return b"".join(rope.leaves()) if rope else b""

    @staticmethod
    def counts(rope: Rope | None) -> tuple[int, int]:
        """Units and code points."""
        return (rope.units, rope.points) if rope else (0, 0)


def check_sentinels(sentinels: tuple[str, str, str]) -> list[bytes]:
    """UTF-8 of three sentinels that can be found again wherever they were put.

    They are not empty and differ, none is within another, and none begins as another (or itself)
    ends, since such a one could arise where a sentinel and a text meet.
    """
    marks = [s.encode() for s in sentinels]
    if len(marks) != 3 or not all(marks) or len(set(marks)) != 3:
        raise ValueError("three different sentinels that aren't empty")
    for a in marks:
        for b in marks:
            if (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")
    return marks


def rearrange(text: bytes, draws: tuple[int, int, int, int], marks: list[bytes], unit: str = "chars", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, leaf: int = LEAF):
    """(units, form, code points of prefix and of middle or None, output) of one text."""
    rope = Rope.of(text, unit, leaf)
    n = rope.units if rope else 0
    if not n or draws[2] % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    head, suffix = rope.split(b)
    prefix, middle = head.split(a) if head else (None, None)
    p, s, m = (Rope.of(x) for x in marks)
    form = "spm" if draws[3] % 100 < suffix_first else "psm"
    out = None
    for part in (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle):
        out = Rope.concat(out, part)
    return n, form, Rope.counts(prefix)[1], Rope.counts(middle)[1], Rope.text(out)


def restore(output: bytes, form: str, marks: list[bytes], leaf: int = LEAF) -> bytes:
    """The text that was rearranged: the rope of the output is split at the sentinels' ranks."""
    if form == "plain":
        return output
    order = (1, 0, 2) if form == "spm" else (0, 1, 2)
    data, rest, parts = np.frombuffer(output, np.uint8), Rope.of(output, "chars", leaf), {}
    for k in reversed(order):  # the last part is split off first
        rank = int(np.count_nonzero((data[: output.index(marks[k])] & 0xC0) != 0x80))
        rest, part = rest.split(rank)
        parts[k] = part.split(len(marks[k].decode()))[1]
    return Rope.text(Rope.concat(Rope.concat(parts[0], parts[2]), parts[1]))


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "chars", seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of docs.

    A text is cut into n units: code points, words or lines (``unit_starts``). h1 to h4 are the
    first four groups of 8 hex digits of the SHA-256 of ``seed:doc_id``. The prefix ends after the
    smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after the larger, the rest is the
    suffix. form: plain, the text as it is, if it is empty or holds a sentinel or h3 % 100 >= rate;
    otherwise spm if h4 % 100 < suffix_first (suffix, prefix, middle), else psm (prefix, suffix,
    middle), each part behind its sentinel. prefix_chars and middle_chars count code points and are
    null where the form is plain.

    Null text is as empty text. A null id is as an empty one in the hash. Equal rows give equal
    rows; a row depends on no other. Very long texts cost as much as they are long: a cut splits
    one leaf. Bytes that aren't UTF-8 are kept as they are, since only leaves' ends follow code
    points. An empty table gives an empty result. Other columns of docs aren't used.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    marks = check_sentinels(sentinels)
    bounded_batches(docs.sparkSession)
    seen = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *[F.conv(F.substring(seen, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])

    def run(batches):
        import pyarrow as pa

        for whole in (x for x in batches if x.num_rows):
            for part in _slices(whole, 1):
                draws = zip(*(c.to_pylist() for c in part.columns[2:]), strict=True)
                out = [rearrange(t, h, marks, unit, rate, suffix_first, leaf) for t, h in zip(part.column(1).to_pylist(), draws, strict=True)]
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restore_texts(rearranged: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, form_col: str = "form", output_col: str = "output", name: str = "restored") -> DataFrame:
    """rearranged with a column ``name``: the exact text, from the output and the form alone.

    A null output gives null, and a null form counts as plain. A row whose output lacks a sentinel
    of its form, which ``fill_middle`` never makes, gives null. A column that is called ``name``
    already is replaced; other columns stay.
    """
    marks = check_sentinels(sentinels)
    kept = rearranged.drop(name)
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.BinaryType())])
    at, form_at = names.index(output_col), names.index(form_col)

    def one(output: bytes | None, form: str | None) -> bytes | None:
        if output is None:
            return None
        try:
            return restore(output, form or "plain", marks)
        except ValueError:
            return None

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for part in _slices(whole, at):
                texts, forms = part.column(at).cast(pa.binary()).to_pylist(), part.column(form_at).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(one, texts, forms), pa.binary())], [*names, name])

    return kept.mapInArrow(run, schema).withColumn(name, F.col(name).cast("string"))
