"""Benchmark decontamination by a broadcast hash set of normalised word n-grams.

Text is lower-cased (A-Z only) and cut into words; a benchmark window is WINDOW consecutive words of one item, or all words of a
shorter, non-empty item.  Windows are sent to every executor as sorted hashes and the places of the numbered words they stand for; what
is sent is measured, and a benchmark beyond the bound is sent in blocks of items, one scan of the documents for each block, and the
hits of the blocks are united per row.  Documents are
scanned a batch at a time in numpy: rolling window hashes that meet the set are verified word by word, so a hash collision never
counts.

Defined results: a null or word-free text has no words and no hits; an item without words has no windows; repeated items count each
by their id; a null item_id takes part in hits but not in n_items (it has no id to list); repeated rows are judged each on its own;
an empty benchmark hits nothing.  Other columns of the inputs pass through `clean` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Bytes of windows and words, as measured, that are sent to executors at once (one item may exceed it); bytes of text that are read at once.
BLOCK_BYTES = TEXT_BYTES = 32 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The normalised words, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WindowSet:
    """Windows of a block of items: numbered words, all items' words in a row, and by window length the sorted hashes and places."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW) -> None:
        self.vocab, self.items, flat, starts = {}, [], [], []
        for item, text in items:
            if words := words_of(text):
                self.items.append(item)
                starts.append(len(flat))
                flat += [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
        self.flat, self.starts = np.array(flat, np.int32), np.array(starts, np.int64)
        size = np.diff(np.append(self.starts, len(flat)))
        own = np.minimum(size, window)
        left = np.repeat(self.starts + size, size) - np.arange(len(flat))  # words of the item from each on
        self.by_length = []
        for n in np.unique(own).tolist():
            at = np.flatnonzero(left >= n) if n == window else self.starts[own == n]
            codes = self._hash(self.flat, n)[at]
            order = np.argsort(codes, kind="stable")
            self.by_length.append((n, codes[order], at[order].astype(np.int32)))

    def sent_bytes(self) -> int:
        """What the arrays and the vocabulary take in memory."""
        return self.flat.nbytes + self.starts.nbytes + 64 * len(self.items) + sum(map(len, self.vocab)) + 150 * len(self.vocab) + sum(c.nbytes + a.nbytes for _, c, a in self.by_length)

    @staticmethod
    def _hash(ids: np.ndarray, n: int) -> np.ndarray:
        """A polynomial hash of every n consecutive ids."""
        out = np.zeros(max(len(ids) - n + 1, 0), np.uint64)
        mixed = common.mix64(ids)
        for k in range(n):
            out = out * _BASE + mixed[k : k + len(out)]
        return out

    def scan(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[int, set]]:
        """ids: the words of many texts in a row, 0 outside the vocabulary; a 0 also parts the texts.  Hit flags by word, and
        the items met by each text (its index among starts)."""
        hit, met = np.zeros(len(ids) + 1, np.int32), {}
        known = ids != 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        runs = edges.reshape(-1, 2)  # of words in the vocabulary
        for n, codes, places in self.by_length:
            for a, b in runs[runs[:, 1] - runs[:, 0] >= n]:
                found = self._hash(ids[a:b], n)
                low = np.searchsorted(codes, found)
                for k in np.flatnonzero(codes[np.minimum(low, len(codes) - 1)] == found).tolist():
                    i, high = a + k, int(np.searchsorted(codes, found[k], "right"))
                    at = places[low[k] : high].astype(np.int64)
                    at = at[(self.flat[at[:, None] + np.arange(n)] == ids[i : i + n]).all(1)]
                    if len(at):
                        hit[i] += 1
                        hit[i + n] -= 1
                        owners = np.searchsorted(self.starts, at, "right") - 1
                        met.setdefault(int(np.searchsorted(starts, i, "right")) - 1, set()).update(self.items[o] for o in owners.tolist())
        return np.cumsum(hit[:-1]) > 0, met


def scanned(batch: pa.RecordBatch, text: str, windows: WindowSet) -> Iterator[tuple[int, np.ndarray, set]]:
    """For each row: its number of words, the indexes of the hit ones, and the items met."""
    get, ids, starts, counts = windows.vocab.get, [], [], []
    for t in common.texts(batch, text):
        found = [get(w, 0) for w in words_of(t)]
        starts.append(len(ids))
        counts.append(len(found))
        ids += found
        ids.append(0)
    bounds = np.array(starts, np.int64)
    hits, met = windows.scan(np.array(ids, np.int64), bounds)
    at = np.flatnonzero(hits)
    cuts = np.searchsorted(at, np.append(bounds, len(ids)))
    for k, n in enumerate(counts):
        yield n, at[cuts[k] : cuts[k + 1]] - bounds[k], met.get(k, set())


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", limit: int = BLOCK_BYTES, window: int = WINDOW) -> Iterator[WindowSet]:
    """The window sets of the benchmark, one at a time, each of `limit` bytes at most or of one item."""

    def parted(items: list[tuple]) -> Iterator[WindowSet]:
        made = WindowSet(items, window)
        if made.sent_bytes() <= limit or len(items) < 2:
            yield made
        else:
            del made
            yield from parted(items[: len(items) // 2])
            yield from parted(items[len(items) // 2 :])

    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    parts = max(1, -(-total // TEXT_BYTES))
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield from parted([(r["i"], r["t"]) for r in part.collect()])


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(w) for w in blocks(benchmark, limit=limit, window=window)]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if len(sent) == 1:
        return common.mapped(source, _report(sent[0]), "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
    # Each block's scan meets the others' at the row: its id and a number given before the scans.
    rows = common.settled(source.withColumn("row", F.monotonically_increasing_id()))
    spans = None
    for windows in sent:
        part = common.mapped(rows, _spans(windows), "row long, doc_id long, n_words long, hit array<long>, items array<string>")
        spans = part if spans is None else spans.unionByName(part)
    united = spans.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return united.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


def _listed(items: set) -> list[str]:
    return sorted({str(i) for i in items if i is not None})


def _report(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = [(n, len(at), _listed(items)) for n, at, items in scanned(batch, "text", sent.value)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([h for _, h, _ in found], pa.int64()),
                    pa.array([len(i) for _, _, i in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for _, _, i in found], pa.string()),
                    pa.array([h > 0 for _, h, _ in found], pa.bool_()),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return run


def _spans(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = list(scanned(batch, "text", sent.value))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2).cast(pa.int64()),
                    batch.column(0).cast(pa.int64()),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([at.tolist() for _, at, _ in found], pa.list_(pa.int64())),
                    pa.array([_listed(i) for _, _, i in found], pa.list_(pa.string())),
                ],
                ["row", "doc_id", "n_words", "hit", "items"],
            )

    return run


def cut(text: str, hit: np.ndarray) -> str:
    """text without its hit words and what stands between two hit words; the rest stays as it is."""
    if not len(hit):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], folded.view(np.int8), [0])))).reshape(-1, 2)
    drop = np.zeros(len(raw), bool)
    breaks = np.flatnonzero(np.diff(hit) > 1)
    for a, b in zip(hit[np.concatenate(([0], breaks + 1))], hit[np.concatenate((breaks, [len(hit) - 1]))], strict=True):
        drop[edges[a, 0] : edges[b, 1]] = True
    return np.frombuffer(raw, np.uint8)[~drop].tobytes().decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_share: float = 0.5, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """docs without contamination: hit spans leave the texts; documents with more than max_share of their words hit go.

    All columns of docs stay; where a text changes and there is an integer column n_chars, it is counted anew."""
    sent = [docs.sparkSession.sparkContext.broadcast(w) for w in blocks(benchmark, limit=limit, window=window)]
    if len(sent) == 1:
        return common.mapped(docs, _cleaner(sent[0], text, max_share), docs.schema)
    # Every block scans the text as it was; the hits of all meet at the row, which is cut and judged once.
    row, hit = common.fresh("row", docs.columns), common.fresh("hit", docs.columns)
    rows = common.settled(docs.withColumn(row, F.monotonically_increasing_id()))
    source = rows.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(row).alias("row"))
    spans = None
    for windows in sent:
        part = common.mapped(source, _spans(windows), "row long, doc_id long, n_words long, hit array<long>, items array<string>").where(F.size("hit") > 0).select("row", "hit")
        spans = part if spans is None else spans.unionByName(part)
    united = spans.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit")))).alias(hit))
    met = rows.join(united, row, "left").select(*docs.columns, hit)
    return common.mapped(met, _cutter(text, max_share), docs.schema)


def replaced(batch: pa.RecordBatch, text: str, new: list[str | None]) -> pa.RecordBatch:
    """batch with new texts, and with n_chars counted anew where there is such an integer column and the text changed."""
    at, columns = batch.schema.get_field_index(text), list(batch.columns)
    old = columns[at].to_pylist()
    columns[at] = pa.array(new, batch.schema.field(at).type)
    if (k := batch.schema.get_field_index("n_chars")) >= 0 and pa.types.is_integer(batch.schema.field(k).type):
        columns[k] = pa.array([c if a == b or b is None else len(b) for a, b, c in zip(old, new, columns[k].to_pylist(), strict=True)], batch.schema.field(k).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def _kept(batch: pa.RecordBatch, text: str, counts: list[int], hit: list[np.ndarray], max_share: float) -> pa.RecordBatch:
    """batch with its hit words cut, less the rows of which too many are hit.  counts: the words of each row."""
    new = [cut(t, at) if len(at) else t for t, at in zip(common.texts(batch, text), hit, strict=True)]
    keep = pa.array([len(at) <= max_share * n for n, at in zip(counts, hit, strict=True)])
    return replaced(batch, text, new).filter(keep)


def _cleaner(sent, text: str, max_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            found = list(scanned(batch, text, sent.value))
            if any(len(at) for _, at, _ in found):
                batch = _kept(batch, text, [n for n, _, _ in found], [at for _, at, _ in found], max_share)
            yield batch

    return run


def _cutter(text: str, max_share: float):
    """The last column holds the numbers of the hit words, in order, or null; it is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            hit = [np.array(at or [], np.int64) for at in batch.column(batch.num_columns - 1).to_pylist()]
            batch = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
            if any(len(at) for at in hit):
                counts = [len(words_of(t)) if len(at) else 0 for t, at in zip(common.texts(batch, text), hit, strict=True)]
                batch = _kept(batch, text, counts, hit, max_share)
            yield batch

    return run
