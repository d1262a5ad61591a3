"""Language of a text by a bidirectional gated recurrent network over its bytes, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import _slices
from .shared import bounded_batches, crc_fold, fresh, materialize, small_side, text_buffer

HIDDEN, SPAN, PAD = 8, 96, 256
#: Documents of each language, and windows of each document, that are learned from at most.
DOCS, WINDOWS = 160, 16
STEPS, BATCH, TRAIN_SPAN, RATE = 500, 192, 48, 0.02
#: Windows that run side by side.
LANES = 2048


def _gate(x: np.ndarray) -> np.ndarray:
    """A sigmoid made of x / (1 + |x|), in place."""
    np.divide(x, 1 + np.abs(x), out=x)
    x *= 0.5
    x += 0.5
    return x


def _bend(x: np.ndarray) -> np.ndarray:
    return np.divide(x, 1 + np.abs(x), out=x)


class Network:
    """Two recurrent layers (one for each direction) and a softmax at every byte.

    Arrays have a row for each unit and a column for each window. For a byte x and state h:
    r, z = gate(Ex + Uh), c = bend(Ex + r * Uh), h' = z * h + (1 - z) * c.
    """

    def __init__(self, languages: list[str], seed: int = 5, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        n = max(1, len(languages))
        self.p = {}
        for d in "fb":
            self.p[f"E{d}"] = rng.normal(0, 0.5, (3 * hidden, PAD + 1)).astype(np.float32)
            self.p[f"U{d}"] = rng.normal(0, 0.7 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
            self.p[f"W{d}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (n, hidden)).astype(np.float32)
        self.p["b"] = np.zeros((n, 1), np.float32)

    def _states(self, bytes_: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of shape (time, hidden, windows); keep gets what the gradient needs."""
        H, (T, B) = self.hidden, bytes_.shape
        E, U = self.p[f"E{d}"], self.p[f"U{d}"]
        h = np.zeros((H, B), np.float32)
        out = np.empty((T, H, B), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            x = np.take(E, bytes_[t], axis=1)
            u = U @ h
            gates = _gate(x[: 2 * H] + u[: 2 * H])
            r, z = gates[:H], gates[H:]
            c = _bend(x[2 * H :] + r * u[2 * H :])
            if keep is not None:
                keep.append((t, h, r, z, c, u[2 * H :]))
            h = c + z * (h - c)
            out[t] = h
        return out

    def _label(self, hf: np.ndarray, hb: np.ndarray) -> np.ndarray:
        """Probabilities of shape (time, languages, windows)."""
        y = np.matmul(self.p["Wf"], hf) + np.matmul(self.p["Wb"], hb) + self.p["b"]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def learn(self, windows: np.ndarray, truth: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 6) -> None:
        """Adam on the cross-entropy of every place's label, by backpropagation through time."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(truth == k) for k in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(g, -(-batch // len(groups))) for g in groups])
            grads = self.gradient(windows[pick].T, truth[pick])
            size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g *= min(1.0, 1 / max(size, 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def gradient(self, bytes_: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        H, (T, B) = self.hidden, bytes_.shape
        kept = {d: [] for d in "fb"}
        h = {d: self._states(bytes_, d, kept[d]) for d in "fb"}
        mask = (bytes_ != PAD)[:, None, :]
        dy = self._label(h["f"], h["b"])
        dy[:, truth, np.arange(B)] -= 1
        dy *= mask / max(1, mask.sum())
        out = {"b": dy.sum(axis=(0, 2))[:, None]}
        for d in "fb":
            U = self.p[f"U{d}"]
            out[f"W{d}"] = np.einsum("tlb,thb->lh", dy, h[d])
            back = np.matmul(self.p[f"W{d}"].T, dy)
            dU, dx = np.zeros_like(U), np.zeros((T, 3 * H, B), np.float32)
            dh = np.zeros((H, B), np.float32)
            for t, before, r, z, c, u in reversed(kept[d]):
                dh += back[t]
                dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
                dz = dh * (before - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dr = dc * u * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                du = np.concatenate((dr, dz, dc * r))
                dx[t] = np.concatenate((dr, dz, dc))
                dU += du @ before.T
                dh = dh * z + U.T @ du
            out[f"U{d}"] = dU
            flat = bytes_.ravel()
            out[f"E{d}"] = np.array([np.bincount(flat, dx[:, i, :].ravel(), PAD + 1) for i in range(3 * H)], np.float32)
        return out

    def pooled(self, column) -> np.ndarray:
        """Each text's mean over all its bytes of the labels' probabilities: (texts, languages)."""
        data, offsets = text_buffer(column)
        size = np.diff(offsets)
        count = -(-size // SPAN)
        owner = np.repeat(np.arange(len(size)), count)
        first = np.concatenate(([0], np.cumsum(count)))
        start = offsets[owner] + SPAN * (np.arange(len(owner)) - first[owner])
        stop = offsets[owner + 1] if len(owner) else start
        total = np.zeros((len(size), len(self.languages)))
        padded = np.append(data, np.zeros(SPAN, np.uint8))
        for a in range(0, len(owner), LANES):
            s = start[a : a + LANES]
            at = s[None, :] + np.arange(SPAN)[:, None]
            bytes_ = padded[at].astype(np.int64)
            bytes_[at >= stop[a : a + LANES][None, :]] = PAD
            p = self._label(self._states(bytes_, "f"), self._states(bytes_, "b"))
            p *= (bytes_ != PAD)[:, None, :]
            np.add.at(total, owner[a : a + LANES], p.sum(0).T)
        return total / np.maximum(size, 1)[:, None]


def _windows(data: bytes, most: int = WINDOWS, span: int = TRAIN_SPAN) -> list[bytes]:
    """Windows of a text at even distances, all of them if there are few."""
    n = max(1, -(-len(data) // span))
    take = range(n) if n <= most else (n * i // most for i in range(most))
    return [data[span * i : span * (i + 1)] for i in take]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_each: int = DOCS, windows_each: int = WINDOWS, steps: int = STEPS) -> Network | None:
    """Learn from documents with a language whose crc32(id as text) mod 4 is not 2.

    Of each language at most ``docs_each`` documents (of the smallest hash of the id) and of each
    of these at most ``windows_each`` windows of its text are used. None if there is no such
    document. The driver holds these windows only.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where((F.col("text") != "") & F.col("lang").isNotNull() & (crc_fold(F.col("__id")) != 2) & F.regexp_like("text", F.lit("\\p{L}")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("__id", F.lit(3)), "__id")
    chosen = rows.select("__id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_each).select("__id").distinct()
    chosen = materialize(chosen, "chosen")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            lang, found = [], []
            for text, name in zip(batch.column(0).cast("binary").to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in _windows(text, windows_each):
                    found.append(w)
                    lang.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(lang, pa.string())], ["w", "lang"])

    got = rows.join(small_side(chosen, 16), "__id").select("text", "lang").mapInArrow(cut, "w binary, lang string").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("lang", "ascending"), ("w", "ascending")])
    names = got.column("lang").to_pylist()
    network = Network(sorted(set(names)))
    windows = np.full((len(names), TRAIN_SPAN), PAD, np.int64)
    for line, w in zip(windows, got.column("w").to_pylist(), strict=True):
        line[: len(w)] = np.frombuffer(w, np.uint8)
    number = {x: i for i, x in enumerate(network.languages)}
    network.learn(windows, np.array([number[x] for x in names]), steps)
    return network


def identify(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (its pooled probability).

    Map-only. Every byte of a text is labelled, in windows of ``SPAN`` bytes (of ``TRAIN_SPAN`` in
    training), at each of which both directions' states start anew, a short window's from padding;
    the document's probabilities are the mean over its bytes, however many. Null and empty texts, and those without a letter,
    are ``und`` with score 0, as is every text where no language was learned. Nothing but the text
    is looked at. Repeated rows and extra columns pass through; input columns named lang_pred or
    score are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kind = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(names).schema)
    rows = docs.select(*names, F.coalesce(F.regexp_like(text_col, F.lit("\\p{L}")), F.lit(False)).alias(fresh(names, "__letter")))
    at = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        import pyarrow as pa

        net = shared.value
        for whole in batches:
            for part in _slices(whole, at):
                letter = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)
                if net is None:
                    best, top, known = np.zeros(part.num_rows, int), np.zeros(part.num_rows), np.array(["und"])
                else:
                    p = net.pooled(part.column(at))
                    best, top, known = p.argmax(1), p.max(1), np.array(net.languages, object)
                lang = np.where(letter, known[best], "und")
                score = np.where(letter, np.clip(top, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang.astype(object), pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, f"{kind}, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs.

    held_out: crc32(doc_id as text) mod 4 is 2, so that the row wasn't learned from; false for a
    null id. Repeated rows are kept and labelled alike. Null and empty texts are ``und``. An empty
    table gives an empty result. Other columns aren't used, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    network = fit(docs, id_col, text_col, lang_col, **bounds)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_fold(F.col(id_col)) == 2, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, network).drop("text")
