"""SentencePiece vocabularies: exact cuts, token counts without ids, and sampled lossless encoding.

Both operators rest on one property of the vocabulary, which is checked when it is loaded: no piece crosses the start of a run of
spaces, nor a line feed.  Texts can then be cut there into pre-tokens.

Token counts: (1) every task counts the pre-tokens of its texts, and a shuffle of these counts makes the corpus's table of distinct
pre-tokens; (2) the library encodes each once, and only the number of its pieces is kept, in a table in the shared folder; (3) each
document becomes its pre-token frequencies, which are joined to that table and summed.  The most frequent pre-tokens, as many as HEAD_BYTES
hold, are sent to all tasks and joined there; the rest, which occur seldom, are joined by a shuffle of (row, pre-token, frequency).
Sampling: pieces weigh as their rank (weight 1 / (rank + 2)); forward filtering sums the weights of all segmentations of a part up to
each position, backward sampling draws one piece at a time from the end, with random numbers made from the row key and the position,
so that a row gives the same pieces in any partition, batch or run.  Characters outside the vocabulary, and the space mark itself,
become byte pieces; hence decoding gives the text back exactly.

Defined results: a null or empty text has 0 tokens and no pieces; texts of any length are worked on whole; equal rows give equal
results; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
#: Distinct pre-tokens that a task gathers before it hands them on.
GATHERED = 300_000
#: Memory that the pre-tokens sent to all tasks may take, each its own bytes and ENTRY.
HEAD_BYTES, ENTRY = 64 << 20, 120
#: Bytes of text whose pieces are drawn at a time.
SLICE = 1 << 19
_UNITS = re.compile(r" +[^ ]*")


@functools.cache
def processor(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    sp.cuts = all(SPACE not in p.lstrip(SPACE) and "\n" not in p for p in map(sp.id_to_piece, range(sp.get_piece_size())))
    return sp


def pretokens(sp, text: str | None) -> list[str]:
    """The pre-tokens of a text: the pieces of the text are those of its pre-tokens (pieces_of).

    A word stands for itself with one space before it, one that a line feed precedes holds it; those that begin with NUL stand for the rest of
    them as a text of its own."""
    t = (text or "").replace(SPACE, " ")  # the library takes the mark for a space
    if not t:
        return []
    if "\x00" in t or not sp.cuts:
        return ["\x00" + t]
    if "  " not in t and t[0] != " " and t[-1] != " " and " \n" not in t:
        return t.replace("\n", " \n").split(" ")
    return ["\x00" + u[1:] if u[1:2] == "\n" else u[1:] for u in _UNITS.findall(" " + t)]


def pieces_of(sp, found: list[str]) -> list[int]:
    """How many pieces each pre-token has; the library's own leading mark before a line feed is none of them, and alone it is one."""
    ids = sp.encode([k[1:] if k[:1] == "\x00" else k for k in found], num_threads=1)
    return [len(i) - (k[:1] == "\n") if k else 1 for i, k in zip(ids, found, strict=True)]


def pretoken_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """key, freq, pieces: each distinct pre-token of all documents, how often it occurs, and how many pieces it has."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, found = processor(path), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["key", "freq"])
        for batch in common.slices(batches, "text"):
            for t in common.texts(batch, "text"):
                found.update(pretokens(sp, t))
            if len(found) > GATHERED:
                yield out()
                found.clear()
        if found:
            yield out()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for batch in common.slices(batches, "key"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces_of(sp, batch.column(0).to_pylist()), pa.int64())], ["key", "freq", "pieces"])

    each = common.mapped(docs.select(F.col(text).alias("text")), gather, "key string, freq long")
    return common.mapped(each.groupBy("key").agg(F.sum("freq").alias("freq")), encode, "key string, freq long, pieces long")


def frequent(table: DataFrame, limit: int) -> tuple[dict[str, int], int]:
    """The pieces of the pre-tokens that occur so often, and how often that is: the lowest power of two that the limit allows."""
    size = F.sum(F.octet_length("key") + ENTRY)
    classes = table.groupBy(F.floor(F.log2("freq")).alias("c")).agg(size.alias("size")).collect()  # 64 rows at most
    held, least = 0, 64
    for c, n in sorted(((r["c"], r["size"]) for r in classes), reverse=True):
        held += n
        if held > limit:
            break
        least = c
    if least == 64:
        return {}, 1 << 62
    found = table.where(F.col("freq") >= 1 << least).select("key", "pieces").toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)), 1 << least


def token_counts(docs: DataFrame, path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text", head: int = HEAD_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_tokens as the library's encode would give, over_limit."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    pretoken_table(source, path).write.parquet(where := f"{common.shared_dir(spark)}/pretokens-{uuid.uuid4().hex}")
    table = spark.read.parquet(where)
    known, least = frequent(table, head)
    sent = spark.sparkContext.broadcast(known)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with the sum over its frequent pre-tokens, and one for each of its others."""
        sp, get = processor(path), sent.value.get
        for batch in common.slices(batches, "text"):
            rows, keys, counts, own = [], [], [], []
            for row, t in zip(batch.column(3).to_pylist(), common.texts(batch, "text"), strict=True):
                total = 0
                for k, n in Counter(pretokens(sp, t)).items():
                    if (one := get(k)) is not None:
                        total += n * one
                    else:
                        rows.append(row)
                        keys.append(k)
                        counts.append(n)
                own.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0), batch.column(2), pa.array(map(str, batch.column(3).to_pylist()), pa.string()), pa.array([0] * len(own), pa.int32()), pa.array(own, pa.int64())], names)
            if rows:
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), none, none, pa.array(keys, pa.string()), pa.array([1] * len(rows), pa.int32()), pa.array(counts, pa.int64())], names)

    names = ["row", "doc_id", "n_bytes", "key", "open", "n"]
    each = common.mapped(source.withColumn("row", F.monotonically_increasing_id()), frequencies, "row long, doc_id long, n_bytes long, key string, open int, n long")
    rest = table.where(F.col("freq") < least).select("key", "pieces", F.lit(1).alias("open"))
    met = each.join(rest, ["key", "open"], "left").select("row", "doc_id", "n_bytes", (F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n"))
    out = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    out = common.settled(out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
    common.delete(spark, where)
    return out


class Lattice:
    """The pieces as a trie read from their ends, in arrays; and the lattices of the distinct parts of a slice of texts.

    A lattice has a node for each place of a part, numbered in a row over all parts; of nodes, the first arc into them and their weight;
    of arcs, by the node that they end in, their weight, length and piece (a character outside the vocabulary: minus it, less 1)."""

    #: Parts up to this length are filtered together; longer ones one by one, with weights that are raised before they vanish.
    SHORT = 40

    def __init__(self, path: str) -> None:
        sp = processor(path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i).replace(SPACE, " "): i for i in ids}
        self.longest = max(map(len, pieces), default=1)
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.cuts = sp.cuts
        children, at = {}, {}
        for p, i in pieces.items():
            state = 0
            for c in reversed(p):
                state = children.setdefault(state << 21 | ord(c), len(children) + 1)
            at[state] = i
        self.piece_at = np.full(len(children) + 1, -1, np.int32)
        self.piece_at[list(at)] = list(at.values())
        self.weight_at = 1.0 / (self.piece_at + 2.0)
        # An open-addressed table of the children: slots by a multiplicative hash, the next ones on collision.
        self.shift = np.uint64(64 - (4 * len(children)).bit_length())
        self.key = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.child = np.full(len(self.key), -1, np.int32)
        keys, states = np.array(list(children), np.int64), np.arange(1, len(children) + 1, dtype=np.int32)
        slot = self.slots(keys)
        while len(keys):
            free = self.key[slot] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            put = first[free[first]]
            self.key[slot[put]], self.child[slot[put]] = keys[put], states[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, states, slot = keys[rest], states[rest], (slot[rest] + 1) % len(self.key)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each state for each character; -1 without one."""
        keys = state.astype(np.int64) << 21 | char
        slot = self.slots(keys)
        seen = self.key[slot]
        out = np.where(seen == keys, self.child[slot], np.int32(-1))
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.key)
            seen = self.key[slot[open_]]
            same = seen == keys[open_]
            out[open_[same]] = self.child[slot[open_[same]]]
            open_ = open_[~same & (seen >= 0)]
        return out

    def filtered(self, parts: list[str]) -> tuple[np.ndarray, ...]:
        """Forward filtering of all parts: last node and length of each part; first arc and weight of each node; weight, length and piece
        of each arc."""
        size = np.array([len(p) for p in parts], np.int64)
        char = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(parts)), size)
        place = np.arange(len(char)) - start[owner]  # of a character in its part; a node's place is one more
        ends, lengths, states = [], [], []
        live, state = np.arange(len(char)), np.zeros(len(char), np.int32)
        for d in range(self.longest):
            inside = place[live] >= d
            live, state = live[inside], state[inside]
            state = self.step(state, char[live - d])
            found = state >= 0
            live, state = live[found], state[found]
            if not len(live):
                break
            whole = np.flatnonzero(self.piece_at[state] >= 0)
            ends.append(live[whole])
            lengths.append(np.full(len(whole), d + 1, np.int32))
            states.append(state[whole])
        end, back, state = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ends, lengths, states))
        piece, weight = self.piece_at[state], self.weight_at[state]
        alone = np.flatnonzero(np.bincount(end, minlength=len(char)) == 0)
        end, back = np.concatenate([end, alone]), np.concatenate([back, np.ones(len(alone), np.int32)])
        piece, weight = np.concatenate([piece, -char[alone] - 1]), np.concatenate([weight, np.full(len(alone), 1e-6)])
        order = np.argsort(end, kind="stable")
        end, back, piece, weight = end[order], back[order], piece[order].astype(np.int32), weight[order]
        node = end + owner[end] + 1
        first = np.searchsorted(end, np.arange(len(char)))  # of each character's arcs
        count = np.diff(np.append(first, len(end)))
        total = np.zeros(len(char) + len(parts))
        total[start + np.arange(len(parts))] = 1.0
        first_of = np.zeros(len(total), np.int64)
        first_of[np.arange(len(char)) + owner + 1] = first
        first_of[start + np.arange(len(parts))] = first[start]  # no arcs end there: those of the node before stop here
        short = size[owner] <= self.SHORT
        by_place = np.argsort(np.where(short, place, 1 << 40), kind="stable")  # characters, those of one place together
        cuts = np.searchsorted(place[by_place][: int(short.sum())], np.arange(self.SHORT + 1))
        for j in range(self.SHORT):
            chars = by_place[cuts[j] : cuts[j + 1]]
            if not len(chars):
                break
            n = count[chars]
            begin = np.cumsum(n) - n
            arcs = np.repeat(first[chars] - begin, n) + np.arange(n.sum())
            weight[arcs] *= total[node[arcs] - back[arcs]]
            total[chars + owner[chars] + 1] = np.add.reduceat(weight[arcs], begin)
        for k in np.flatnonzero(size > self.SHORT).tolist():
            self.filter_long(int(start[k]), int(size[k]), first, count, back, weight, total, int(start[k]) + k)
        return start + np.arange(len(parts)) + size, size, first_of, total, weight, back, piece

    @staticmethod
    def filter_long(start: int, size: int, first, count, back, weight, total, base: int) -> None:
        """The same for one part, in place: weights that later places need are raised together before they vanish."""
        upto = [1.0]
        for j in range(size):
            a = int(first[start + j])
            s = 0.0
            for k in range(a, a + int(count[start + j])):
                weight[k] *= upto[j + 1 - back[k]]
                s += weight[k]
            upto.append(s)
            total[base + j + 1] = s
            if s < 1e-150:
                for i in range(max(0, j - 32), j + 2):
                    upto[i] *= 1e150

    def parts(self, text: str) -> list[str]:
        """text, with a space before it, cut where no piece can cross; each part without its first space."""
        if not text:
            return []
        if not self.cuts:
            return [text] if text[0] != "\n" else ["", text]
        if "  " not in text and text[0] not in " \n" and text[-1] != " " and " \n" not in text:
            return text.replace("\n", " \n").split(" ")
        out = []
        for u in _UNITS.findall(" " + text):
            first, *rest = u[1:].split("\n")
            out += [first, *("\n" + r for r in rest)]
        return out

    def sample(self, texts: list[str | None], keys: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text, drawn backwards with random numbers of its key and the place in the text."""
        number: dict[str, int] = {}
        found, owner = [], []
        for t in texts:
            parts = self.parts(t or "")
            found += [number.setdefault(p, len(number)) for p in parts]
            owner.append(len(parts))
        if not found:
            return [np.zeros(0, np.int32)] * len(texts)
        ends, sizes, first_arc, total, weight, back, piece = self.filtered([p if p[:1] == "\n" else " " + p for p in number])
        part = np.array(found, np.int64)
        node, lens = ends[part], sizes[part]
        owner = np.repeat(np.arange(len(texts)), owner)
        first = node - lens
        at = np.cumsum(lens)  # the place of the node in all texts, in a row
        spans = np.bincount(owner, lens, len(texts)).astype(np.int64)
        offset = at - (np.cumsum(spans) - spans)[owner]  # in its own text
        seed = common.mix64(keys.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))[owner]
        drawn, none = np.empty(int(spans.sum()) + 1, np.int32), np.iinfo(np.int32).min
        drawn[:] = none
        last_arc = np.append(first_arc[1:], len(weight)) - 1
        while len(node):
            left = (common.mix64(seed + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(12)).astype(np.float64) * (total[node] * 2.0**-52)
            arc = first_arc[node]
            late = np.flatnonzero(left >= weight[arc])
            while len(late):
                left[late] -= weight[arc[late]]
                late = late[arc[late] < last_arc[node[late]]]  # rounding must not leave the node
                arc[late] += 1
                late = late[left[late] >= weight[arc[late]]]
            drawn[at] = piece[arc]
            step = back[arc]
            more = np.flatnonzero(node - step > first)
            step = step[more]
            node, at, offset, first, seed = node[more] - step, at[more] - step, offset[more] - step, first[more], seed[more]
        where = np.flatnonzero(drawn != none)
        what = drawn[where]
        if (odd := np.flatnonzero(what < 0)).size:
            table = {c: [self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in (-np.unique(what[odd]).astype(np.int64) - 1).tolist()}
            wide = [table[-w - 1] for w in what[odd].tolist()]
            reps = np.ones(len(what), np.int64)
            reps[odd] = [len(w) for w in wide]
            at_odd = (np.cumsum(reps) - reps)[odd]
            where, what = np.repeat(where, reps), np.repeat(what, reps)
            for a, w in zip(at_odd.tolist(), wide, strict=True):
                what[a : a + len(w)] = w
        bounds = np.searchsorted(where, np.cumsum(spans), "right")
        return np.split(what, bounds[:-1])


class Decoder:
    """Piece ids back to text."""

    def __init__(self, path: str) -> None:
        sp = processor(path)
        self.raw = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(sp.get_piece_size())]

    def text(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


@functools.cache
def lattice_of(path: str) -> Lattice:
    return Lattice(path)


def sampled(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_pieces, pieces (with digest: pieces_sha256 of the little-endian int32 ids), lossless
    (whether the pieces decoded to the very text).  The key of a row is its doc_id; a null one counts as -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, decoder = lattice_of(path), Decoder(path)
        for batch in common.slices(batches, "text", size=SLICE):
            ts = common.texts(batch, "text")
            keys = np.array([-1 if k is None else k for k in batch.column(0).cast(pa.int64()).to_pylist()], np.int64)
            ids = lattice.sample(ts, keys)
            same = [decoder.text(i.tolist()) == (t or "") for i, t in zip(ids, ts, strict=True)]
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            bounds = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
            out = pa.array([hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids], pa.string()) if digest else pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(i) for i in ids], pa.int64()), out, pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "pieces_sha256" if digest else "pieces", "lossless"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return common.mapped(source, run, f"doc_id long, n_pieces long, {'pieces_sha256 string' if digest else 'pieces array<int>'}, lossless boolean")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([decoder.text(i or []) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return common.mapped(encoded.select("doc_id", "pieces"), run, "doc_id long, text string")
