"""Quality classifier: a generalised additive model with pairwise interactions, on features of the whole text.

Each feature is cut into bins at quantiles of the training rows.  Cyclic boosting visits one feature after another: a shallow tree of
few leaves, grown on the histogram of gradients over that feature's bins, is added to the feature's lookup table at a small rate.
Then the pairs of features whose quadrant trees reduce the remaining loss most are boosted the same way into two-way tables.  What
remains of all trees are tables, so a score is the intercept plus one table entry per feature and per pair: vectorised bin additions.

Training reads at most FIT_ROWS labelled rows, chosen by a hash of the id (the documented bound of this classifier; of more rows than twice
that, as ids with very many labels make, those of the smallest hashes).

Defined results: a null text counts as empty; the empty text has zero features and gets the score of those; texts of any length are
measured whole; repeated rows get equal scores; conflicting labels of one id all count; without any labelled row every score is 0.5;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FIT_ROWS, BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAVES = 12000, 32, 120, 6, 40, 0.15, 4
NAMES = ("chars", "words", "lines", "word_len", "upper", "digit", "symbol", "punctuation", "distinct", "repeat_run", "line_dup", "top_word", "short_line", "stop_end", "rare_symbol_word", "upper_word")
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b".,;:?"
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _MARKS)


def measure(text: str | None) -> list[float]:
    """The features of one text, in the order of NAMES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    words = text.split()
    m = len(words) or 1
    lines = text.split("\n")
    upper, digit, mark, symbol = (n - len(raw.translate(None, s)) for s in (_UPPER, _DIGITS, _MARKS, _SYMBOLS))
    seen = Counter(words)
    full = [x for x in lines if x]
    return [
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        n / m,
        upper / n,
        digit / n,
        symbol / n,
        mark / n,
        len(seen) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m,
        1 - len(set(full)) / max(len(full), 1),
        max(seen.values(), default=0) / m,
        sum(len(x) < 40 for x in lines) / len(lines),
        sum(x[-1] in ".!?" for x in full) / max(len(full), 1),
        sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in words) / m,
        sum(map(str.isupper, words)) / m,
    ]


class Additive:
    """Tables of bins: edges[f], one[f][bin], two[(f, g)][bin of f, bin of g]; and an intercept."""

    def __init__(self) -> None:
        self.edges, self.one, self.two, self.base = [], [], {}, 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)

    def raw(self, b: np.ndarray) -> np.ndarray:
        z = np.full(len(b), self.base)
        for f, t in enumerate(self.one):
            z += t[b[:, f]]
        for (f, g), t in self.two.items():
            z += t[b[:, f], b[:, g]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray) -> "Additive":
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        self.one = [np.zeros(len(e) + 1) for e in self.edges]
        b = self.bins(x)
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(mean / (1 - mean)))
        z = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, table in enumerate(self.one):
                g, h = slopes(z, y)
                k = len(table)
                add = RATE * tree(np.bincount(b[:, f], g, k), np.bincount(b[:, f], h, k), LEAVES)
                table += add
                z += add[b[:, f]]
        g, h = slopes(z, y)
        gains = []
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                gains.append((quadrants(*grid(b, i, j, g, h, self.one))[1], i, j))
        for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
            self.two[i, j] = np.zeros((len(self.one[i]), len(self.one[j])))
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in self.two.items():
                g, h = slopes(z, y)
                add = RATE * quadrants(*grid(b, i, j, g, h, self.one))[0]
                table += add
                z += add[b[:, i], b[:, j]]
        return self


def slopes(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-z))
    return y - p, np.maximum(p * (1 - p), 1e-6)


def grid(b: np.ndarray, i: int, j: int, g: np.ndarray, h: np.ndarray, one: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    m, n = len(one[i]), len(one[j])
    at = b[:, i] * n + b[:, j]
    return np.bincount(at, g, m * n).reshape(m, n), np.bincount(at, h, m * n).reshape(m, n)


def tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float = 2.0) -> np.ndarray:
    """Values by bin of a tree on one ordered feature, grown best leaf first."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        cut = np.arange(a + 1, b)
        lg, lh, tg, th = cg[cut] - cg[a], ch[cut] - ch[a], cg[b] - cg[a], ch[b] - ch[a]
        gain = lg**2 / (lh + ridge) + (tg - lg) ** 2 / (th - lh + ridge) - tg**2 / (th + ridge)
        k = int(gain.argmax())
        return float(gain[k]), int(cut[k])

    parts = [(0, len(g), *best(0, len(g)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][2])
        a, b, gain, cut = parts[k]
        if gain <= 1e-9:
            break
        parts[k : k + 1] = [(a, cut, *best(a, cut)), (cut, b, *best(cut, b))]
    out = np.zeros(len(g))
    for a, b, *_ in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, float]:
    """Values by bin pair of the best tree with one cut in each of two features, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    if g.shape[0] < 2 or g.shape[1] < 2:
        return np.zeros_like(g), 0.0
    a, ha = cg[:-1, :-1], ch[:-1, :-1]
    b, hb = cg[:-1, -1:] - a, ch[:-1, -1:] - ha
    c, hc = cg[-1:, :-1] - a, ch[-1:, :-1] - ha
    d, hd = tg - a - b - c, th - ha - hb - hc
    gain = a**2 / (ha + ridge) + b**2 / (hb + ridge) + c**2 / (hc + ridge) + d**2 / (hd + ridge) - tg**2 / (th + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for rows, cols, q, hq in ((slice(0, i + 1), slice(0, j + 1), a, ha), (slice(0, i + 1), slice(j + 1, None), b, hb), (slice(i + 1, None), slice(0, j + 1), c, hc), (slice(i + 1, None), slice(j + 1, None), d, hd)):
        out[rows, cols] = q[i, j] / (hq[i, j] + ridge)
    return out, float(gain[i, j])


def measured(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """Columns carry of docs, and features array<double>."""
    source = docs.select(*carry, F.col(text).alias(name := common.fresh("text", carry)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, name):
            x = [measure(t) for t in common.texts(batch, name)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*carry, "features"])

    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carry)
    return common.mapped(source, run, f"{kinds}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, fold: "F.Column | None" = None, rows: int = FIT_ROWS) -> Additive | None:
    """A model of labels.quality from rows of both tables that meet by doc_id and pass fold; None without any.

    The labels that are used are about `rows`, twice that at most (an id of very many labels must not undo the bound), so they are sent to
    the documents' tasks, not the texts to theirs."""
    known = labels.select("doc_id", "quality").where("quality is not null and doc_id is not null")
    known = known if fold is None else known.where(fold)
    sample = common.bounded_sample(known, "doc_id", rows, known.count()).orderBy(F.xxhash64("doc_id", "quality"), "doc_id", "quality").limit(2 * rows)
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = measured(met, ["doc_id", "quality"]).orderBy(F.xxhash64("doc_id", "quality", "features"), "doc_id", "quality", "features").limit(2 * rows).toPandas()
    if not len(found):
        return None
    return Additive().train(np.array(found["features"].tolist()), (found["quality"].to_numpy() > 0).astype(float))


def scored(docs: DataFrame, model: Additive | None, held_out: "F.Column | None" = None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            x = np.array([measure(t) for t in common.texts(batch, "text")]).reshape(batch.num_rows, len(NAMES))
            s = np.full(len(x), 0.5) if sent.value is None else sent.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id"), F.col("text"), (F.lit(None).cast("boolean") if held_out is None else held_out).alias("held_out"))
    return common.mapped(source, run, "doc_id long, held_out boolean, score double, predicted int")
