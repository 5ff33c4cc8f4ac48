"""Language identification by a byte convolutional network, trained in numpy and applied to fixed-length windows of whole texts.

Input: windows of WINDOW bytes.  A filter of width w is a weight for each byte at each of its w places; filters of several widths
slide over the window, the best place of each counts (max pooling), and a softmax over the languages reads those maxima.  Training
learns filters and softmax together by Adam with the gradient passing through the winning places.  Applying: a text is cut into
windows from its first byte to its last, all windows of a batch go through the network at once, and a text's probabilities are the
mean over its windows, each counted by the bytes it holds.

Training sees about FIT_ROWS rows and twice that at most (one for each language at least), those of the smallest hashes, with equal
shares for the languages: the documented bound of this classifier.  Of each row it sees FIT_WINDOWS windows at places that a hash of the id
chooses, because neighbouring windows of one text teach less than windows of other texts.  Only text and lang are read in training,
only text in prediction.  Windows go through the network in blocks of one size and sums run in one order, so a text's score does not
depend on the rows beside it.

Defined results: null texts and texts without a letter are `und` with score 0; windows of any text length are covered; repeated rows
get equal results; without any labelled row everything is `und`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 16
FIT_ROWS, FIT_WINDOWS, BLOCK = 8000, 2, 256
UNKNOWN = "und"


def windows(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (zero-padded rows) of texts side by side, the text of each, and the bytes it holds."""
    sizes = np.diff(bounds)
    count = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[:-1][owner] + nth * WINDOW
    held = np.minimum(WINDOW, bounds[1:][owner] - start)
    padded = np.concatenate([raw, np.zeros(WINDOW, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start] if len(start) else np.zeros((0, WINDOW), np.uint8)
    short = np.flatnonzero(held < WINDOW)
    if len(short):
        out[short] *= np.arange(WINDOW) < held[short, None]
    return out, owner, held


class Network:
    """filters[w]: (w, 256, FILTERS); dense: (features, langs); bias."""

    def __init__(self, langs: list[str], seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.filters = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        for f in self.filters.values():
            f[:, 0] = -0.5  # padding
        self.dense = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.bias, self.pairs = np.zeros(len(langs), np.float32), None

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        best, at = [], []
        for w, f in self.filters.items():
            n = x.shape[1] - w + 1
            y = f[0][x[:, :n]]
            for k in range(1, w):
                y += f[k][x[:, k : k + n]]
            if places:
                at.append(y.argmax(1))
            best.append(y.max(1))
        return np.maximum(np.concatenate(best, 1), 0), at

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 9, batch: int = 64, rate: float = 0.01, seed: int = 2) -> "Network":
        rng, step, self.pairs = np.random.default_rng(seed), 0, None
        params = [*self.filters.values(), self.dense, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        share = np.bincount(y, minlength=len(self.langs)) / max(len(y), 1)
        weight = (1 / np.maximum(share, 1e-9) / np.count_nonzero(share)).astype(np.float32)
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                h, places = self.pooled(x[at], True)
                p = softmax(h @ self.dense + self.bias)
                p[np.arange(len(at)), y[at]] -= 1
                p *= (weight[y[at]] / len(at))[:, None]
                dh = (p @ self.dense.T) * (h > 0)
                grads = []
                for i, (w, f) in enumerate(self.filters.items()):
                    g, d = np.zeros_like(f), dh[:, i * FILTERS : (i + 1) * FILTERS]
                    rows, cols = np.broadcast_to(np.arange(len(at))[:, None], d.shape), np.broadcast_to(np.arange(FILTERS), d.shape)
                    for k in range(w):
                        place = x[at][rows, places[i] + k].astype(np.int64) * FILTERS + cols
                        g[k] = np.bincount(place.ravel(), d.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                    grads.append(g)
                grads += [h.T @ p, p.sum(0)]
                step += 1
                now = rate * (1 - 0.8 * epoch / epochs)
                for p_, g, m_, v_ in zip(params, grads, m, v, strict=True):
                    m_ += 0.1 * (g - m_)
                    v_ += 0.01 * (g * g - v_)
                    p_ -= now * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.99**step)) + 1e-8)
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of windows; in blocks that stay in a core's cache, the last one filled up.  Neighbouring bytes are looked up in pairs."""
        if self.pairs is None:
            self.pairs = {w: [(f[k][:, None] + f[k + 1][None] if k + 1 < w else f[k]).reshape(-1, FILTERS) for k in range(0, w, 2)] for w, f in self.filters.items()}
        out = np.empty((len(x), len(self.langs)), np.float32)
        for a in range(0, len(x), BLOCK):
            part = x[a : a + BLOCK]
            held = len(part)
            if held < BLOCK:
                part = np.concatenate([part, np.zeros((BLOCK - held, x.shape[1]), x.dtype)])
            both = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            best = []
            for w, tables in self.pairs.items():
                n = part.shape[1] - w + 1
                y = None
                for i, t in enumerate(tables):
                    z = t[(both if t.shape[0] > 256 else part)[:, 2 * i : 2 * i + n]]
                    y = z if y is None else np.add(y, z, out=y)
                best.append(y.max(1))
            h = np.maximum(np.concatenate(best, 1), 0)
            z = self.bias + np.zeros((BLOCK, 1), np.float32)
            for k in range(h.shape[1]):
                z += h[:, k : k + 1] * self.dense[k]
            out[a : a + held] = softmax(z)[:held]
        return out

    def predict(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text."""
        x, owner, held = windows(raw, bounds)
        p = self.probabilities(x) * held[:, None]
        total = np.stack([np.bincount(owner, p[:, k], len(bounds) - 1) for k in range(len(self.langs))], 1)
        return total / np.maximum(np.bincount(owner, held, len(bounds) - 1), 1)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Network | None:
    """A network from about `rows` labelled rows; None if there is none."""
    usable = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    counts = {r["l"]: r["count"] for r in usable.groupBy("l").count().collect()}
    if not counts:
        return None
    langs, each = sorted(counts), max(1, rows // len(counts))
    share = F.create_map(*[F.lit(x) for n in langs for x in (n, int(min(1.0, 1.1 * each / counts[n]) * (1 << 30)))])
    # Windows are cut at places that a hash of the id chooses, so that openings do not dominate; characters, at most four bytes each.
    spots = [F.substring(F.col("t"), (F.pmod(F.xxhash64(F.lit(i), "k"), F.greatest(F.lit(1), F.length("t") - WINDOW)) + 1).cast("int"), F.lit(WINDOW)) for i in range(FIT_WINDOWS)]
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(11), "k"), F.lit(1 << 30)) < share[F.col("l")])
    sample = chosen.select("l", F.array(*spots).alias("w"), F.xxhash64("k", "t").alias("h")).orderBy("h", "l", "w").limit(2 * max(rows, len(counts))).toPandas()
    cut = [(w.encode("utf-8", "surrogatepass")[:WINDOW], n) for ws, n in zip(sample["w"], sample["l"], strict=True) for w in ws]
    cut = [(w, n) for w, n in cut if w]
    x = np.zeros((len(cut), WINDOW), np.uint8)
    for i, (w, _) in enumerate(cut):
        x[i, : len(w)] = np.frombuffer(w, np.uint8)
    # Short texts must be known too: some windows are shortened.
    for i in range(0, len(cut), 4):
        x[i, 8 + i * 7 % (WINDOW - 8) :] = 0
    place = {n: i for i, n in enumerate(langs)}
    return Network(langs).train(x, np.array([place[n] for _, n in cut], np.int64))


def lettered(text: str | None) -> bool:
    if not text:
        return False
    return text[:1].isalpha() or any(map(str.isalpha, text))


def _scored(batch: pa.RecordBatch, text: str, net: Network | None) -> tuple[list[str], np.ndarray]:
    ts = common.texts(batch, text)
    known = np.array([lettered(t) for t in ts], bool) if net else np.zeros(len(ts), bool)
    if not net or not known.any():
        return [UNKNOWN] * len(ts), np.zeros(len(ts))
    p = net.predict(*common.utf8(batch, text))
    best = p.argmax(1)
    names = [net.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
    return names, np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)


def predicted(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text", held_out: "F.Column | None" = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            names, score = _scored(batch, "text", sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"))
    return common.mapped(source, run, "doc_id long, held_out boolean, lang_pred string, score double")


def kept(docs: DataFrame, net: Network | None, text: str = "text", least: float = 0.3, langs: list[str] | None = None) -> DataFrame:
    """The documents whose language is known (and among langs, if given) with a score of `least` at least; all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            names, score = _scored(batch, text, sent.value)
            yield batch.filter(pa.array([n != UNKNOWN and s >= least and (langs is None or n in langs) for n, s in zip(names, score.tolist(), strict=True)], pa.bool_()))

    return common.mapped(docs, run, docs.schema)
