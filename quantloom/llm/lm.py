"""Masked pseudo-likelihood: how well a small bidirectional network predicts every token of a text from both of its sides.

Tokens are the bytes of the UTF-8 text; the network sees RADIUS tokens on either side of a masked one (the symbol PAD beyond the
ends).  Each place has a table of hidden vectors; their sum goes through tanh and a softmax over the 256 bytes.  A document's score is
the sum of the log-probabilities of its tokens.

Statistics: every window of every document is counted (context and token, packed into one integer), pre-aggregated in each task and
summed by a shuffle over all documents; that table grows with the corpus.  Training: the table is dealt by hash into shards of about
SHARD_ROWS windows (SHARDS of them at least); each shard takes Adam steps in numpy over all its windows, each weighted by its count,
from the common parameters; the shards' parameters are averaged by their counts, and so on for ROUNDS.  Averages of MERGED groups of
shards are made by tasks, so no more than MERGED parameter vectors come to the driver.  Scoring: the distinct windows of a batch go
through the network once, and each token takes its window's value.

Defined results: a null or empty text has no tokens, sum 0 and a null mean; texts of any length are scored whole; repeated rows are
counted each and get equal scores; an empty table trains nothing and gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RADIUS, HIDDEN, PAD = 2, 32, 0
SHARDS, SHARD_ROWS, MERGED, ROUNDS, RATE = 12, 2_000_000, 16, 6, 0.02
#: Distinct windows that a task gathers before it merges equal ones.
GATHERED = 2_000_000
#: Bytes of text that are taken at a time.
SLICE = 2 << 20


def packed(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each byte's window, first place highest: RADIUS before, the token, RADIUS after.  Byte 0 does not differ from PAD."""
    n, width = len(raw), 2 * RADIUS + 1
    if not n:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    start, end = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    wide = np.concatenate([np.zeros(RADIUS, np.uint8), raw, np.zeros(RADIUS, np.uint8)])
    code = np.zeros(n, np.uint64)
    for k in range(width):
        part = wide[k : k + n]
        d = k - RADIUS
        if d:
            part = np.where((at + d >= start) if d < 0 else (at + d < end), part, PAD)
        code = (code << np.uint64(8)) | part
    return code


def unpacked(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (a row of places each) and tokens."""
    width = 2 * RADIUS + 1
    places = np.stack([(code >> np.uint64(8 * (width - 1 - k))).astype(np.uint8) for k in range(width)], 1)
    return np.delete(places, RADIUS, 1), places[:, RADIUS]


class Network:
    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.params = [
            rng.normal(0, 0.3, (2 * RADIUS, 256, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            rng.normal(0, 0.1, (HIDDEN, 256)).astype(np.float32),
            np.zeros(256, np.float32),
        ]

    def hidden(self, context: np.ndarray) -> np.ndarray:
        table, bias = self.params[0], self.params[1]
        h = np.repeat(bias[None], len(context), 0)
        for k in range(2 * RADIUS):
            h += table[k][context[:, k]]
        return np.tanh(h)

    def logs(self, code: np.ndarray, block: int = 8192) -> np.ndarray:
        """The log-probability of each window's token."""
        out = np.empty(len(code))
        for a in range(0, len(code), block):
            context, token = unpacked(code[a : a + block])
            z = self.hidden(context) @ self.params[2] + self.params[3]
            top = z.max(1)
            out[a : a + block] = z[np.arange(len(z)), token] - top - np.log(np.exp(z - top[:, None]).sum(1))
        return out

    def train(self, code: np.ndarray, count: np.ndarray, seed: int, rate: float = RATE) -> "Network":
        """One pass of Adam over all windows in an order of the seed, each weighted by its count within its batch."""
        rng, n = np.random.default_rng(seed), len(code)
        size = int(min(4096, max(256, n // 64)))
        m, v = [np.zeros_like(p) for p in self.params], [np.zeros_like(p) for p in self.params]
        for step, at in enumerate(np.array_split(rng.permutation(n), max(1, n // size)), 1):
            context, token = unpacked(code[at])
            weight = (count[at] / count[at].sum()).astype(np.float32)[:, None]
            h = self.hidden(context)
            z = h @ self.params[2] + self.params[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(p)), token] -= 1
            p *= weight
            dh = (p @ self.params[2].T) * (1 - h * h)
            g = np.zeros_like(self.params[0])
            for k in range(2 * RADIUS):
                order = np.argsort(context[:, k], kind="stable")
                rows = context[order, k]
                first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                g[k][rows[first]] = np.add.reduceat(dh[order], first, 0)
            for p_, g_, m_, v_ in zip(self.params, [g, dh.sum(0), h.T @ p, p.sum(0)], m, v, strict=True):
                m_ += 0.1 * (g_ - m_)
                v_ += 0.01 * (g_ * g_ - v_)
                p_ -= rate * (m_ / (1 - 0.9**step)) / (np.sqrt(v_ / (1 - 0.99**step)) + 1e-7)
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params])

    def load(self, flat: np.ndarray) -> "Network":
        at = 0
        for i, p in enumerate(self.params):
            self.params[i] = np.asarray(flat[at : at + p.size], np.float32).reshape(p.shape)
            at += p.size
        return self


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, counts, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        place, kinds = pd.factorize(np.concatenate(codes))
        return kinds, np.bincount(place, np.concatenate(counts), len(kinds)).astype(np.int64)

    for batch in common.slices(batches, "text", size=SLICE):
        place, kinds = pd.factorize(packed(*common.utf8(batch, "text")))
        if len(kinds):
            codes.append(kinds)
            counts.append(np.bincount(place, minlength=len(kinds)))
            held += len(kinds)
        if held > GATHERED:
            one = merged()
            codes, counts, held = [one[0]], [one[1]], len(one[0])
            if held > GATHERED // 2:  # mostly distinct: the shuffle merges the rest
                yield _counted(*one)
                codes, counts, held = [], [], 0
    if codes:
        yield _counted(*merged())


def _counted(kinds: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(counts, pa.int64())], ["win", "n"])


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """win, n: how often each window occurs in all documents."""
    return common.mapped(docs.select(F.col(text).alias("text")), _count, "win long, n long").groupBy("win").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> Network:
    """The network that the windows of all documents train."""
    spark = docs.sparkSession
    table = common.settled(counted(docs, text))
    shards = max(shards, table.count() // SHARD_ROWS + 1)
    table = common.settled(table.repartition(shards, "win"))
    net = Network()
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(net.flat())
        trained = common.mapped(table, _trainer(sent, turn), "flat binary, weight double")  # a row for each shard
        if shards > MERGED:
            dealt = trained.withColumn("shard", F.spark_partition_id()).repartition(MERGED, "shard").sortWithinPartitions("shard")
            trained = common.mapped(dealt.select("flat", "weight"), _merge, "flat binary, weight double")
        rows = trained.collect()
        if not rows:
            break
        weights = np.array([r["weight"] for r in rows])
        mean = np.average([np.frombuffer(r["flat"], np.float32) for r in rows], axis=0, weights=weights)
        net.load(mean)
    return net


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all rows of a task: the average by weight."""
    total, weight = None, 0.0
    for batch in batches:
        for flat, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(flat, np.float32).astype(np.float64) * w
            total, weight = part if total is None else total + part, weight + w
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary()), pa.array([weight])], ["flat", "weight"])


def _trainer(sent, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if parts:
            code = np.concatenate([p[0] for p in parts]).astype(np.uint64)
            count = np.concatenate([p[1] for p in parts]).astype(np.float64)
            order = np.argsort(code)  # rows come in any order; training depends on it no longer
            net = Network().load(sent.value).train(code[order], count[order], seed=turn, rate=RATE / (1 + turn) ** 0.5)
            yield pa.RecordBatch.from_arrays([pa.array([net.flat().tobytes()], pa.binary()), pa.array([count.sum()])], ["flat", "weight"])

    return run


def scored(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, pll (the sum of log-probabilities), pll_mean of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", size=SLICE):
            raw, bounds = common.utf8(batch, "text")
            place, kinds = pd.factorize(packed(raw, bounds))
            each = sent.value.logs(kinds)[place] if len(kinds) else np.zeros(0)
            n = np.diff(bounds)
            pll = [float(each[a:b].sum()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            mean = [p / k if k else None for p, k in zip(pll, n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(pll, pa.float64()), pa.array(mean, pa.float64())], ["doc_id", "n_tokens", "pll", "pll_mean"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return common.mapped(source, run, "doc_id long, n_tokens long, pll double, pll_mean double")
