"""Vocabulary training over a corpus: candidates mined, counted and ranked natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.native import let
from ..kernels.vocab import PackError, Vocabulary

_W = r"\p{L}\p{N}_"
_S = r"\s\x1c-\x1f\x85\p{Z}"
#: Runs of word characters, of other visible ones and of white space.
SEGMENTS = f"[{_W}]+|[^{_W}{_S}]+|[{_S}]+"


def records_of(text: Column) -> Column:
    """Lines with their line feeds."""
    return F.filter(F.split(text, "(?<=\n)", -1), lambda r: r != "")


#: Segments of lines that aren't UTF-8: runs of ASCII white space and what is between.
RAW_SEGMENTS = "[\\x09-\\x0d\\x20]+|[^\\x09-\\x0d\\x20]+"


def _joined(s: Column, width: int) -> Column:
    n = F.size(s)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.concat(*[F.get(s, i + k) for k in range(width)]))).otherwise(F.array().cast("array<string>"))


def _affixes(x: Column, most: int) -> Column:
    ends = F.sequence(F.lit(1), F.least(F.length(x), F.lit(most)))
    return F.concat(F.transform(ends, lambda k: F.left(x, k)), F.transform(ends, lambda k: F.right(x, k)))


def candidates(df: DataFrame, column: str = "text", max_bytes: int = 32) -> DataFrame:
    """(surface, frequency) of all candidate pieces of the corpus.

    Within each line: segments of 2 to ``max_bytes`` bytes, joins of two and three neighbouring
    segments within the bound, and of longer segments the prefixes and suffixes within it. A binary
    column gives binary surfaces; a line of it that isn't UTF-8 is cut at ASCII white space, and
    affixes are of its longer segments that are UTF-8.
    """
    rows = df.where(F.col(column).isNotNull())
    if df.schema[column].dataType.simpleString() == "binary":
        return _byte_candidates(rows, column, max_bytes)
    lines = rows.select(F.explode(records_of(F.col(column))).alias("line"))
    found = lines.select(F.explode(_pieces("line", max_bytes)).alias("surface")).where(F.octet_length("surface").between(2, max_bytes))
    return found.groupBy("surface").agg(F.count("*").alias("frequency"))


def _pieces(line: str, max_bytes: int) -> Column:
    def of(s: Column) -> Column:
        long = F.filter(s, lambda x: F.octet_length(x) > max_bytes)
        every = F.concat(s, _joined(s, 2), _joined(s, 3), F.flatten(F.transform(long, lambda x: _affixes(x, max_bytes))))
        return F.filter(every, lambda x: F.octet_length(x).between(2, max_bytes))  # before they become rows

    return let(F.regexp_extract_all(line, F.lit(SEGMENTS), 0), of)


def _byte_candidates(rows: DataFrame, column: str, max_bytes: int) -> DataFrame:
    """Lines as strings of one character for each byte, those that are UTF-8 as text."""
    latin = lambda x: F.decode(x, "ISO-8859-1")
    raw = lambda x: F.encode(x, "ISO-8859-1")
    is_text = lambda x: F.is_valid_utf8(raw(x).cast("string"))
    lines = rows.select(F.explode(records_of(latin(F.col(column)))).alias("line"))
    text = lines.where(is_text(F.col("line"))).select(raw(F.col("line")).cast("string").alias("line"))
    text = text.select(F.explode(_pieces("line", max_bytes)).alias("surface")).select(F.encode("surface", "UTF-8").alias("surface"))

    def of(s: Column) -> Column:
        long = F.filter(s, lambda x: (F.length(x) > max_bytes) & is_text(x))
        ends = F.flatten(F.transform(long, lambda x: F.transform(_affixes(raw(x).cast("string"), max_bytes), lambda y: latin(F.encode(y, "UTF-8")))))
        return F.concat(s, _joined(s, 2), _joined(s, 3), ends)

    other = lines.where(~is_text(F.col("line")))
    other = other.select(F.explode(let(F.regexp_extract_all("line", F.lit(RAW_SEGMENTS), 0), of)).alias("surface")).select(raw(F.col("surface")).alias("surface"))
    found = text.unionByName(other).where(F.octet_length("surface").between(2, max_bytes))
    return found.groupBy("surface").agg(F.count("*").alias("frequency"))


def train(df: DataFrame, column: str = "text", vocab_size: int = 4096, max_bytes: int = 32, min_frequency: int = 2, byte_cost: int = 1000) -> DataFrame:
    """(surface, frequency, gain, cost) of the pieces of the greatest gain.

    gain = frequency * (bytes - 1); ties: frequency, bytes, then the surface's bytes. The cost
    favours frequent and long pieces a little.
    """
    if not 256 <= vocab_size <= 1_000_000 or not 2 <= max_bytes <= 65535 or min_frequency < 1:
        raise PackError("a bound is out of range", 1)
    n = F.octet_length("surface")
    rows = candidates(df, column, max_bytes).where(F.col("frequency") >= min_frequency)
    rows = rows.withColumn("gain", F.col("frequency") * (n - 1))
    bonus = F.floor(80 * F.log2((F.col("frequency") + 1).cast("double")) + 25 * (n - 1)).cast("int")
    rows = rows.withColumn("cost", F.greatest(F.lit(1), byte_cost - F.least(F.lit(byte_cost - 1), bonus)))
    binary = rows.schema["surface"].dataType.simpleString() == "binary"
    order = [F.col("gain").desc(), F.col("frequency").desc(), n.desc(), F.col("surface") if binary else F.encode("surface", "UTF-8")]
    return rows.orderBy(*order).limit(max(0, vocab_size - 256)).select("surface", "frequency", "gain", "cost")


def to_vocabulary(pieces: DataFrame, byte_cost: int = 1000) -> Vocabulary:
    """A vocabulary of trained pieces: at most as many rows as it was trained for."""
    from ..kernels.vocab import build_vocabulary

    rows = pieces.select("surface", "cost").collect()
    return build_vocabulary([{"surface": r.surface.encode() if isinstance(r.surface, str) else bytes(r.surface), "cost": r.cost} for r in rows], byte_cost)
