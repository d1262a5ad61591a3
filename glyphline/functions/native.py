"""Column functions that stay in Catalyst: bytes, leaves, ranges, bit fields, parts, detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels.vocab import Detector

MSB0, LSB0 = 0, 1


def let(value: Column, body) -> Column:
    """body of a value that is computed once per row, also where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte_at(data: Column, place: Column) -> Column:
    """Value of the byte at a place counted from 1."""
    return F.conv(F.hex(F.substring(data, place, F.lit(1))), 16, 10).cast("int")


def byte_ids(data: Column) -> Column:
    """Each byte as a token id; data is computed once, so that the work grows with its bytes."""

    def ids(d: Column) -> Column:
        n = F.octet_length(d)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: byte_at(d, i))).otherwise(F.when(d.isNotNull(), F.array().cast("array<int>")))

    return let(data, ids)


def pairs_without(data: Column, marks: bytes) -> Column:
    """How many neighbouring bytes of data have no mark; marks has a byte for each pair, 0 for none."""
    known = F.lit(marks)

    def count(d: Column) -> Column:
        pair = lambda i: F.conv(F.hex(F.substring(d, i, F.lit(2))), 16, 10).cast("int")
        n = F.octet_length(d)
        return F.when(n > 1, F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.substring(known, pair(i) + 1, F.lit(1)) == F.lit(b"\0")))).otherwise(0)

    return let(data, count)


def leaves(data: Column) -> Column:
    """The gapless partition into single bytes: their starts."""
    n = F.octet_length(data)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.when(data.isNotNull(), F.array().cast("array<int>")))


def read_range(data: Column, start: Column, length: Column) -> Column:
    """struct(status, bytes): bytes [start, start + length), or status 5 where they aren't all there."""
    good = (start >= 0) & (length >= 0) & (start + length <= F.octet_length(data))
    found = F.when(good, F.substring(data, (start + 1).cast("int"), length.cast("int")))
    return F.struct(F.when(data.isNull(), F.lit(None)).when(good, 0).otherwise(5).cast("int").alias("status"), found.alias("bytes"))


def bit_field(data: Column, byte_start: Column, start_bit: int, bits: int, order: int = MSB0) -> Column:
    """struct(status, value): up to 64 bits of the bytes from byte_start on.

    MSB0: bits from the left, the first is the value's highest; LSB0: from the lowest bit of the
    first byte, the first is the value's lowest. Status 5: the bytes aren't all there.
    """
    if not (0 <= start_bit <= 7 and 1 <= bits <= 64):
        return F.struct(F.lit(1).alias("status"), F.lit(None).cast("decimal(20,0)").alias("value"))
    need = (start_bit + bits + 7) // 8
    good = (byte_start >= 0) & (byte_start + need <= F.octet_length(data))
    part = F.substring(data, (byte_start + 1).cast("int"), F.lit(need))
    octets = [F.lpad(F.conv(F.hex(F.substring(part, k + 1, 1)), 16, 2), 8, "0") for k in range(need)]
    if order == MSB0:
        text = F.substring(F.concat(*octets), start_bit + 1, bits)
    else:
        text = F.substring(F.concat(*reversed(octets)), 8 * need - start_bit - bits + 1, bits)
    value = F.when(good, F.conv(text, 2, 10).cast("decimal(20,0)"))
    return F.struct(F.when(data.isNull(), F.lit(None)).when(good, 0).otherwise(5).cast("int").alias("status"), value.alias("value"))


def identifier_parts(word: Column) -> Column:
    """Parts of an identifier: cut at _ and $, at digits, in camelCase and before an acronym's last capital."""
    cuts = "[_$]|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[^0-9])|(?<=[^0-9_$])(?=[0-9])"
    return F.filter(F.split(word, cuts), lambda p: p != "")


def number_parts(word: Column) -> Column:
    """array of struct(kind, text): sign 2, radix 3, integer 4, fraction 5, exponent mark 6, its sign 7 and digits 8."""
    pattern = r"^([+-])?(0[xXbBoO])?([^.eEpP]*)(?:\.([^eEpP]*))?(?:([eEpP])([+-])?(.*))?$"
    parts = [F.struct(F.lit(k).alias("kind"), F.regexp_extract(word, pattern, g).alias("text")) for g, k in zip(range(1, 8), (2, 3, 4, 5, 6, 7, 8), strict=True)]
    return F.filter(F.array(*parts), lambda p: p["text"] != "")


def string_parts(word: Column, delimiters: list[str]) -> Column:
    """array of struct(kind, text): the longest opening delimiter 9, a closing one 9, the content 10."""
    out = F.array().cast("array<struct<kind:int,text:string>>")
    for d in sorted(delimiters, key=len):
        n = len(d)
        closed = word.endswith(d) & (F.length(word) >= 2 * n)
        inner = F.when(closed, F.substring(word, F.lit(n + 1), F.length(word) - 2 * n)).otherwise(F.substring(word, F.lit(n + 1), F.length(word)))
        pair = lambda k, t: F.struct(F.lit(k).alias("kind"), t.alias("text"))
        parts = F.array(pair(9, F.lit(d)), pair(9, F.when(closed, F.lit(d)).otherwise("")), pair(10, inner))
        out = F.when(word.startswith(d), F.filter(parts, lambda p: p["text"] != "")).otherwise(out)
    return out


def detector_scores(text: Column, detector: Detector) -> Column:
    """array<long> of each profile's score over valid text; overlapping occurrences count each."""

    def one(surface: bytes) -> Column:
        return F.regexp_count(text, F.lit(f"(?=\\Q{surface.decode()}\\E)")).cast("long")

    total = lambda features: sum((one(s) * w for s, w in features), F.lit(0).cast("long"))
    return F.array(*[total(f) for _, _, f in detector.profiles])


def detection(scores: Column, detector: Detector, attached: list[str]) -> Column:
    """struct(matched, available, score, margin, language) of a text's scores; ties to the first profile."""

    def decide(s: Column) -> Column:
        best = F.array_max(s)
        place = F.array_position(s, best).cast("int")
        rest = F.filter(s, lambda _, i: i != place - 1)
        margin = best - F.coalesce(F.array_max(rest), F.lit(0))
        tag = F.element_at(F.array(*[F.lit(t) for t, _, _ in detector.profiles]), place)
        least = F.element_at(F.array(*[F.lit(m) for _, m, _ in detector.profiles]), place)
        matched = (best >= least) & (margin >= detector.min_margin)
        return F.struct(
            matched.alias("matched"),
            (matched & (tag.isin(attached) if attached else F.lit(False))).alias("available"),
            best.alias("score"),
            margin.alias("margin"),
            F.when(matched, tag).alias("language"),
        )

    return let(scores, decide)


def over_limit(data: Column, most: int) -> Column:
    """Status 9 for a source of more than ``most`` bytes, else 0."""
    return F.when(F.octet_length(data) > most, 9).otherwise(F.when(data.isNotNull(), 0)).cast("int")


def path_less(left: Column, right: Column) -> Column:
    """Whether a path of edges (start, end, namespace, kind, id, cost structs) comes before another."""

    def key(p: Column) -> Column:
        cost = F.aggregate(p, F.lit(0).cast("long"), lambda a, e: a + e["cost"])
        return F.struct(cost, F.size(p), F.transform(p, lambda e: F.struct(e["start"] - e["end"], e["namespace"], e["id"])))

    return key(left) < key(right)
