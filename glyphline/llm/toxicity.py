"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts.

A model gives the probability of a word letter by letter (bytes within the word, up to ``ORDER``
at a time), so that spellings and endings that were never seen still have the probability of their
stem. After each context a class has its own counts, absolutely discounted, and backs off to a
Kneser-Ney model of both classes together (absolute discounting, continuation counts in the lower
orders), so that what is rare in either class is about as likely in both. What the class level backs
off by is the discounted mass and ``STRENGTH`` counts more, a Dirichlet prior that plain Kneser-Ney
smoothing hasn't; the classes share the lower orders instead of each having its own. A text's evidence
is the difference of its two log-likelihoods, each distinct word counting once, over the square root
of the number of these words, which is how a sum of so many words varies; one rising logistic curve,
fitted on labelled rows that the models haven't seen, turns it into a score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _slices
from .shared import LOWER_ASCII, bounded_batches, crc_fold, hash_words, materialize, mix, small_side, text_buffer, word_spans

ORDER, DISCOUNT = 5, 0.75
#: What the shared distribution weighs in each context of a class, in counts.
STRENGTH = 8.0
#: Share of a toxic text's words that the toxic model draws.
SHARE = 0.02
#: Labelled rows of each class that are learned from at most (those of the smallest hash).
TOXIC_ROWS, ORDINARY_ROWS = 4000, 8000
#: Distinct words that are counted at a time.
WORDS = 1 << 17
#: Words whose ratios a worker remembers at most.
MEMORY = 1 << 20
#: Bytes of text that are scored at a time.
SLICE = 1 << 20
THRESHOLD = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_START, _END = 2, 3


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 (in UTF-8) in lower case."""
    low = LOWER_ASCII[data]
    if len(data) > 1:
        second = data[1:]
        capital = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        low[1:][capital] += 0x20
    return low


def _padded(data, starts, ends):
    """The spans' bytes, each between a start and an end mark; place within the word and the word's number."""
    size = ends - starts + 2
    first = np.concatenate(([0], np.cumsum(size)))
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(first[-1]) - first[word]
    out = np.full(first[-1], _END, np.uint8)
    out[first[:-1]] = _START
    inner = (place > 0) & (place < size[word] - 1)
    out[inner] = data[(starts[word] + place - 1)[inner]]
    return out, place, word


def _grams(text, place, order):
    """For k = 1 .. order the key of the k bytes that end at each place, 0 where the word has fewer."""
    byte = text.astype(np.uint64) + np.uint64(1)
    now = byte.copy()
    yield now
    for k in range(2, order + 1):
        # the last byte lowest: dropping the first byte is a mask, dropping the last one a shift
        longer = np.zeros(len(text), np.uint64)
        longer[k - 1 :] = now[k - 1 :] + (byte[: len(text) - k + 1] << np.uint64(9 * (k - 1)))
        longer[place < k - 1] = 0
        now = longer
        yield now


class Models:
    """The two models: for each order sorted keys with counts, and sums and types as contexts.

    Row 0 and 1 of the class tables are toxic and ordinary text; the pooled tables hold continuation
    counts of both together (counts, for what stands at a word's start and for the highest order).
    """

    def __init__(self, words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray, order: int = ORDER):
        self.order = order
        self._known, self._ratio = np.zeros(0, np.uint64), np.zeros(0)
        none = np.zeros(0, np.uint64)
        self.keys, self.counts, self.pooled = [none] * order, [np.zeros((2, 0))] * order, []
        for first in range(0, len(words), WORDS):  # a part of the words at a time, to bound memory
            part = slice(first, first + WORDS)
            lengths = np.fromiter(map(len, words[part]), np.int64)
            ends = np.cumsum(lengths)
            text, place, word = _padded(np.frombuffer(b"".join(words[part]), np.uint8), ends - lengths, ends)
            weights = [x[part].astype(float)[word] for x in (toxic, ordinary)]
            for k, grams in enumerate(_grams(text, place, order)):
                at = grams > 0
                all_keys = np.concatenate((self.keys[k], grams[at]))
                keys, inverse = np.unique(all_keys, return_inverse=True)
                counts = [np.bincount(inverse, np.concatenate((c, w[at])), len(keys)) for c, w in zip(self.counts[k], weights, strict=True)]
                self.keys[k], self.counts[k] = keys, np.array(counts)
        for k in range(order):
            keys, pooled = self.keys[k], self.counts[k].sum(0)
            if k + 1 < order:
                into = np.searchsorted(keys, self.keys[k + 1] & np.uint64((1 << (9 * (k + 1))) - 1))
                begins = (keys >> np.uint64(9 * k)) == _START + 1
                pooled = np.where(begins, pooled, np.bincount(into, minlength=len(keys)))
            self.pooled.append(pooled)
        self.sums, self.types, self.pooled_sums, self.pooled_types = [], [], [], []
        for k in range(order - 1):  # contexts of k + 1 bytes
            context, n = np.searchsorted(self.keys[k], self.keys[k + 1] >> np.uint64(9)), len(self.keys[k])
            self.sums.append(np.array([np.bincount(context, c, n) for c in self.counts[k + 1]]))
            self.types.append(np.array([np.bincount(context, c > 0, n) for c in self.counts[k + 1]]))
            self.pooled_sums.append(np.bincount(context, self.pooled[k + 1], n))
            self.pooled_types.append(np.bincount(context, minlength=n))
        first = np.where(self.keys[0] == _START + 1, 0, self.pooled[0])
        self.unigram = (first + 1) / (first.sum() + 257)
        self.unseen = 1 / (first.sum() + 257)

    def probabilities(self, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each byte after what stands before it in its word: rows toxic, ordinary, pooled."""
        p = np.zeros((3, len(text)))
        before = None
        for k, keys in enumerate(_grams(text, place, self.order)):
            at = np.searchsorted(self.keys[k], keys)
            at[at == len(self.keys[k])] = 0
            at[self.keys[k][at] != keys] = -1
            if k == 0:
                p[2] = np.where(at >= 0, self.unigram[at], self.unseen)
                p[0] = p[1] = p[2]
            else:
                context = np.concatenate(([-1], before[:-1]))
                context[place < k] = -1
                here = np.flatnonzero(context >= 0)
                h, g = context[here], at[here]
                seen = g >= 0
                total = self.pooled_sums[k - 1][h]
                known = total > 0
                count = np.where(seen, self.pooled[k][g], 0)
                p[2, here] = np.where(known, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * self.pooled_types[k - 1][h] * p[2, here]) / np.where(known, total, 1), p[2, here])
                for c in range(2):
                    count = np.where(seen, self.counts[k][c][g], 0)
                    back = (STRENGTH + DISCOUNT * self.types[k - 1][c][h]) * p[2, here]
                    p[c, here] = (np.maximum(count - DISCOUNT, 0) + back) / (self.sums[k - 1][c][h] + STRENGTH)
                out = np.flatnonzero((context < 0) & (place >= k))  # a context of neither class: what is shared
                p[0, out] = p[1, out] = p[2, out]
            before = at
        return p

    def word_ratios(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each span."""
        if not len(starts):
            return np.zeros(0)
        text, place, word = _padded(data, starts, ends)
        p = self.probabilities(text, place)
        ratio = np.log(p[0]) - np.log(p[1])
        ratio[place == 0] = 0
        return np.bincount(word, ratio, len(starts))

    def remembered(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """word_ratios of words whose sorted, distinct hashes are known; what was asked before is looked up."""
        at = np.searchsorted(self._known, keys)
        at[at == len(self._known)] = 0
        new = np.flatnonzero(self._known[at] != keys) if len(self._known) else np.arange(len(keys))
        out = self._ratio[at] if len(self._known) else np.zeros(len(keys))
        if len(new):
            out[new] = self.word_ratios(data, starts[new], ends[new])
            if len(self._known) + len(new) > MEMORY:
                self._known, self._ratio = keys[:MEMORY], out[:MEMORY]
            else:
                known = np.concatenate((self._known, keys[new]))
                order = np.argsort(known, kind="stable")
                self._known, self._ratio = known[order], np.concatenate((self._ratio, out[new]))[order]
        return out

    def evidence(self, column) -> np.ndarray:
        """(log-likelihood difference, number of words) of each text's distinct words.

        A toxic text is ordinary text with a share of words that the toxic model draws: its words'
        likelihood is (1 - SHARE) * ordinary + SHARE * toxic.
        """
        data, offsets = text_buffer(column)
        low = fold_case(data)
        starts, ends, first = word_spans(_LETTER[low], offsets)
        keys, one, inverse = np.unique(hash_words(low, starts, ends), return_index=True, return_inverse=True)
        ratio = self.remembered(keys, low, starts[one], ends[one])
        ratio = np.log1p(SHARE * np.expm1(np.minimum(ratio, 30)))
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        doc, word = np.divmod(np.unique(doc * max(1, len(one)) + inverse), max(1, len(one)))
        n = len(offsets) - 1
        return np.stack((np.bincount(doc, ratio[word], n), np.bincount(doc, minlength=n).astype(float)), 1)


def _features(evidence: np.ndarray) -> np.ndarray:
    """One, and the difference over the square root of the number of words."""
    total, n = evidence[:, 0], np.maximum(evidence[:, 1], 1)
    return np.stack((np.ones(len(n)), total / np.sqrt(n)), 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a weighted logistic regression, by Newton steps on scaled features."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x = x / scale
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * w[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta / scale


class Scorer:
    """Models and curve; without rows of both classes the share of toxic ones."""

    def __init__(self, models: Models | None, beta: np.ndarray | None, prior: float):
        self.models, self.beta, self.prior = models, beta, prior

    def __call__(self, column) -> np.ndarray:
        if self.models is None:
            return np.full(len(column), self.prior)
        return 1 / (1 + np.exp(-np.clip(_features(self.models.evidence(column)) @ self.beta, -30, 30)))


def _both_parts(rows: DataFrame) -> DataFrame:
    """rows with learn and curve so that each class has a document in both parts: where one holds
    none of it the document of the least place moves there, and an only document is in both."""
    learn, curve = ~F.col("curve"), F.col("curve")
    for y, least, most, every, some in rows.groupBy("toxic").agg(F.min("place"), F.max("place"), F.min("curve"), F.max("curve")).collect():
        mine = (F.col("toxic") == y) & (F.col("place") == least)
        if least == most:
            learn, curve = learn | mine, curve | mine
        elif every:
            learn, curve = learn | mine, curve & ~mine
        elif not some:
            learn, curve = learn & ~mine, curve | mine
    return rows.select("text", "toxic", learn.alias("learn"), curve.alias("curve"))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Learn from labelled rows whose crc32(id as text) mod 4 is not 2.

    Of each class at most ``toxic_rows`` or ``ordinary_rows`` rows are used, those whose ids have
    the smallest hash. A quarter of them sets the curve, in which each class weighs as much as it
    does among all labelled rows; the others give the counts. Both hold a document of each class,
    an only one being in both. Labels other than 0 and 1, and rows
    with a null id or text, aren't used; a document with both labels counts as toxic.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_fold(F.col("doc_id")) != 2))
    known = materialize(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    sizes = dict(known.groupBy("toxic").count().collect())
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    order = F.xxhash64("doc_id", F.lit(11))
    parts = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(n) for y, n in ((1, toxic_rows), (0, ordinary_rows))]
    chosen = materialize(parts[0].unionByName(parts[1]), "chosen").withColumnRenamed("doc_id", "__id")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where("text is not null")
    place = F.xxhash64("__id", F.lit(23))
    rows = rows.join(small_side(chosen, 16), "__id").select("text", "toxic", place.alias("place"), (F.pmod(place, F.lit(4)) == 0).alias("curve"))
    rows = materialize(rows, "labelled")
    rows = _both_parts(rows)

    def count(batches):
        import pyarrow as pa

        for whole in batches:
            for part in _slices(whole, 0, SLICE):
                data, offsets = text_buffer(part.column(0))
                low = fold_case(data)
                starts, ends, first = word_spans(_LETTER[low], offsets)
                toxic = np.repeat(np.asarray(part.column(1)), np.diff(first)).astype(np.int64)
                hashed = hash_words(low, starts, ends)
                pair = mix(hashed + np.uint64(3) * np.concatenate((np.zeros(1, np.uint64), hashed[:-1]))[: len(hashed)])
                _, one, inverse = np.unique(pair, return_index=True, return_inverse=True)
                seen = [np.bincount(inverse, toxic == y, len(one)) > 0 for y in (1, 0)]
                raw = low.tobytes()
                found = [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(pair[one].view(np.int64)), *map(pa.array, seen)], ["word", "pair", "n1", "n0"])

    # continuation counts: how many different words a word follows, so that copies of a text count once
    words = rows.where("learn").select("text", "toxic").mapInArrow(count, "word binary, pair long, n1 boolean, n0 boolean")
    words = words.groupBy("word", "pair").agg(F.max("n1").cast("long").alias("n1"), F.max("n0").cast("long").alias("n0"))
    words = words.groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).toArrow().sort_by("word")
    n1, n0 = (np.asarray(words.column(c)) for c in ("n1", "n0"))
    if not n1.sum() or not n0.sum():
        return Scorer(None, None, prior)
    models = Models(words.column("word").to_pylist(), n1, n0)
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def weigh(batches):
        import pyarrow as pa

        for whole in batches:
            for part in _slices(whole, 0, SLICE):
                e = shared.value.evidence(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), part.column(1)], ["total", "n", "toxic"])

    seen = rows.where("curve").select("text", "toxic").mapInArrow(weigh, "total double, n double, toxic int").toArrow().sort_by([("total", "ascending"), ("n", "ascending")])
    y = np.asarray(seen.column("toxic")).astype(float)
    if not 0 < y.sum() < len(y):
        return Scorer(None, None, prior)
    x = _features(np.stack((np.asarray(seen.column("total")), np.asarray(seen.column("n"))), 1))
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    beta = _logistic(x, y, weight)
    if beta[1] <= 0:  # the curve never falls: without use of the evidence it is flat
        beta = np.array([np.log(prior / (1 - prior)), 0.0])
    return Scorer(models, beta, prior)


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1, higher: likelier toxic) and predicted (1 if score >= threshold).

    Map-only; whole texts; nothing but the text is looked at. Null and empty texts, and those
    without letters, have the score of no evidence. Repeated rows and extra columns pass through;
    input columns named score or predicted are replaced.
    """
    bounded_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(names)
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for part in _slices(whole, at, SLICE):
                s = shared.value(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs.

    held_out: crc32(doc_id as text) mod 4 is 2, so that the row's label wasn't learned from; false
    for a null id. Repeated rows are kept and scored alike; other columns aren't used, whatever their
    names. An empty table of documents gives an empty result; without labels of both
    classes every score is the share of toxic labels (0 without any).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_fold(F.col(id_col)) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return score(rows, fit(docs, labels, id_col=id_col, text_col=text_col, **bounds)).drop("text")


def drop_toxic(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """docs that aren't predicted toxic, with the columns they came with; all where nothing could be learned."""
    scorer = fit(docs, labels, **bounds)
    if scorer.models is None or not scorer.beta[1]:
        return docs
    return score(docs, scorer).where("predicted = 0").select(docs.columns)
