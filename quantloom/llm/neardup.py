"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

1. Each text becomes its set of distinct 5-word shingles, a digest of that set and a signature of COORDS minima.  Equal sets are one
   node from here on, however many rows share it, so copies never meet each other.
2. Nodes are posted under each coordinate-value pair; pairs that only one node has cannot collide and fall away.
3. Prefix: two nodes that agree in m coordinates must share one among the COORDS - m + 1 rarest of either, so only those
   are posted; frequent values, such as those of passages that many documents quote, are rarely among them.
4. Skip merging: a posting list is never expanded into its pairs.  First each list compares its nodes with a hub, the one that has
   most in common with all: as many comparisons as postings.  Links found join nodes into components, and pairs inside one are skipped.
5. What is left open in a list are the pairs of different components without the hub.  For the nodes of such lists it is counted how
   many of their shingles no other such node has (alone), and how many of the others (common) have a hash in each of BUCKETS.  The
   symmetric difference of x and y has at least alone_x + alone_y + sum over the buckets |common_x - common_y| elements, so a node with
   too many shingles of its own leaves its lists, and the rest meet only where this bound allows a link: lists are parted into bands of
   the sum of common, each node outside its list's largest component looks up the bands that it can reach, and a pair is made in the
   first list that both are in.
6. A pair first counts its matching coordinates; those with m or more are confirmed on the full shingle sets.

m follows from the percentage that links (matches): with COORDS = 32 it is 17 at 85 % and 14 at 80 %, where a pair at just that
similarity is missed with a probability of 3.5e-6 and 1.2e-6, closer ones with less.

Defined results: null, empty and word-free texts have an empty set and are linked with nothing; fewer than 5 words are one shingle;
repeated rows and repeated ids belong to the component of their text; a null doc_id takes part in links, never names a component
(one of nulls only has a null name and keeps nothing; deduplicated leaves one row of it); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE, COORDS = 5, 32
#: Link where 100 * intersection >= percent * union, by default.
PERCENT = 85
#: Largest probability with which a pair at just the percentage may agree in too few coordinates.
MISSED = 4e-6
#: Ratio of neighbouring bands.
BAND = 1.02
#: Parts of the shingles whose numbers are compared before the sets are.
BUCKETS = 32
#: Rows of links or postings for each partition, where a step makes far fewer rows than it has partitions.
EDGES = 50_000
#: Bytes of text that are hashed at a time; each takes some ten times as much memory.
SLICE = 1 << 20

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0xD6E8FEB86659FD93)
_PLACE = common.mix64(np.arange(1, SHINGLE + 1)) | np.uint64(1)
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2**64, and of its inverse."""
    inverse = pow(int(_ODD), -1, 1 << 64)
    both = []
    for base in (int(_ODD), inverse):
        out = np.ones(n, np.uint64)
        if n > 1:
            out[1:] = np.uint64(base)
            np.multiply.accumulate(out, out=out)
        both.append(out)
    return both[0], both[1]


_BUCKET_BITS = 20
_POWER: list[np.ndarray] = list(_powers(1 << 12))


def shingle_sets(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (64-bit hashes, sorted within a text) of texts side by side, and the bounds of each text's."""
    n = len(bounds) - 1
    if len(raw) + 1 > len(_POWER[0]):
        _POWER[:] = _powers(len(raw) + len(raw) // 8 + 1)
    word = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    # A text's end also ends a word.
    cut = bounds[1:-1]
    inner = cut[(cut > 0) & (cut < len(raw))]
    inner = np.unique(inner[word[inner - 1] & word[inner]]) if len(inner) else inner
    starts, ends = np.sort(np.concatenate([edge[::2], inner])), np.sort(np.concatenate([edge[1::2], inner]))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_FOLD[raw] + np.uint64(1)) * _POWER[0][: len(raw)], out=total[1:])
    words = common.mix64((total[ends] - total[starts]) * _POWER[1][starts] + (ends - starts).astype(np.uint64) * _PLACE[0])
    at = np.searchsorted(starts, bounds)  # of each text, its first word
    count = np.diff(at)
    gram = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    for k in range(SHINGLE):
        gram += words[k : k + len(gram)] * _PLACE[k]
    gram = common.mix64(gram)
    sets = []
    for i in np.arange(n):
        a, c = at[i], count[i]
        if c >= SHINGLE:
            g = np.sort(gram[a : a + c - SHINGLE + 1])
            sets.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif c:
            sets.append(common.mix64((words[a : a + c] * _PLACE[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            sets.append(gram[:0])
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else gram[:0], np.concatenate(([0], np.cumsum(sizes)))


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The minima of each set under COORDS hash functions, 32 bits each; zero for empty sets."""
    out = np.zeros((len(bounds) - 1, COORDS), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for j in range(COORDS):
            h = ((flat * _MUL[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32)
            out[full, j] = np.minimum.reduceat(h, bounds[full])
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text", size=SLICE):
        flat, bounds = shingle_sets(*common.utf8(batch, "text"))
        sig = signatures(flat, bounds)
        node = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        sigs = pa.FixedSizeListArray.from_arrays(pa.array(sig.view(np.int32).ravel()), COORDS).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(node, pa.binary()), sigs], ["doc_id", "n_shingles", "node", "sig"])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, node (digest of the set; null if empty) and sig of each row."""
    return common.mapped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), _digest, "doc_id long, n_shingles long, node binary, sig array<int>")


def sent(df: DataFrame, row_bytes: int, limit: int = common.BROADCAST_BYTES) -> DataFrame:
    """df, to be sent to all tasks if its counted rows are within the limit; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def matches(percent: int) -> int:
    """Of COORDS coordinates, how many must agree: as many as miss a pair at just percent with a probability of MISSED at most."""
    p, missed = percent / 100, 0.0
    for m in range(COORDS + 1):
        missed += math.comb(COORDS, m) * p**m * (1 - p) ** (COORDS - m)
        if missed > MISSED:
            return max(m, 1)
    return COORDS


def prefixes(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """nid, n, weight, keys: of each node those of its coordinate-value pairs that are in its prefix, rarest first, of those that another
    node has too; weight: how much the node has in common with others, most for the member of a group that the others vary."""
    each = nodes.select("nid", F.posexplode("sig").alias("coord", "value"))
    each = each.select("nid", (F.col("coord").cast("long") * (1 << 32) + F.col("value").cast("long").bitwiseAND((1 << 32) - 1)).alias("key"))
    shared = common.settled(each.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    held = each.join(sent(shared, 32), "key")
    # Rarest first; a node's values that no other has come before all of them.  A node holds at most COORDS.
    ranked = held.groupBy("nid").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys"))
    room = F.size("keys") - (matches(percent) - 1)
    weight = F.aggregate("keys", F.lit(0).cast("long"), lambda s, k: s + k["df"])
    kept = ranked.where(room > 0).select("nid", weight.alias("weight"), F.slice("keys", F.lit(1), room)["key"].alias("keys"))
    out = common.settled(kept.join(nodes.select("nid", F.col("n_shingles").alias("n")), "nid").select("nid", "n", "weight", "keys"))
    common.dropped(shared)
    return out


def _alike(na: str, nb: str, percent: int) -> str:
    """Whether sets of these sizes can be similar enough."""
    return f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb})"


def hub_lists(posted: DataFrame) -> DataFrame:
    """key, hub, hub_n, members: of each list of two nodes or more, the node of the greatest weight."""
    hub = posted.groupBy("key").agg(F.max(F.struct("weight", "nid", "n")).alias("h"), F.count("*").alias("members"))
    return hub.where("members > 1").select("key", F.col("h.nid").alias("hub"), F.col("h.n").alias("hub_n"), "members")


def _likely(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs that agree in enough coordinates."""
    signs = sent(signs, 64 + 4 * COORDS)
    x = pairs.join(signs.select(F.col("nid").alias("a"), F.col("sig").alias("sa")), "a").join(signs.select(F.col("nid").alias("b"), F.col("sig").alias("sb")), "b")
    same = F.aggregate(F.zip_with("sa", "sb", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return common.settled(x.where(same >= matches(percent)).select("a", "b"))


def _confirmed(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough.  The set of a goes to the place of b: one set travels for each pair."""
    inside = sets.join(sent(likely.select(F.explode(F.array("a", "b")).alias("nid")).distinct(), 32), "nid", "left_semi")
    x = likely.join(inside.select(F.col("nid").alias("a"), F.col("shingles").alias("xa")), "a")
    x = x.join(inside.select(F.col("nid").alias("b"), F.col("shingles").alias("xb")), "b")
    both = F.size(F.array_intersect("xa", "xb")).cast("long")
    return common.settled(x.withColumn("both", both).where(f"100 * both >= {percent} * (size(xa) + size(xb) - both)").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """nid, comp (the smallest node that it reaches) of every node of edges (a, b): large-star and small-star steps in turn, until
    each component is a star.  Each pair of steps at least halves the longest distance to a star's middle.  Only counts come to the driver."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = common.settled(edges)
    # Few edges are held in few partitions (one needs no shuffles at all); the steps are the same.
    parts = edges.count() // EDGES + 1
    bad = 1
    while bad:
        held = edges.coalesce(parts)
        # Large star: the larger neighbours of each node go to its smallest one.
        both = held.select(F.inline(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: the smaller neighbours of each node, and itself, go to its smallest one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))))
        new = common.settled(small.where("a <> b").distinct())
        # Stars: no node is both a larger and a smaller end, and none has two smaller ends.
        odd = new.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        bad = odd.where("n > 1").limit(1).count() or new.select("a").join(new.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        common.dropped(edges)
        edges = new
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("nid"), F.col("b").alias("comp")), F.struct(F.col("b").alias("nid"), F.col("b").alias("comp"))))).distinct()


def distinct_sets(rows: DataFrame) -> DataFrame:
    """node, n_shingles, sig and least (the smallest doc_id) of each non-empty set of rows, numbered by nid."""
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.min("doc_id").alias("least"))
    return common.settled(nodes.withColumn("nid", F.monotonically_increasing_id()))


def linked(docs: DataFrame, rows: DataFrame, nodes: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """nid, comp of the nodes that have links with other nodes."""
    prefix = prefixes(nodes, percent)
    # Few postings are held in few partitions.
    posted = prefix.select("nid", "n", "weight", F.explode("keys").alias("key")).coalesce(prefix.agg(F.sum(F.size("keys"))).first()[0] // EDGES + 1 if prefix.limit(1).count() else 1)
    lists = common.settled(hub_lists(posted))
    signs = nodes.select("nid", "sig").join(sent(prefix.select("nid"), 32), "nid", "left_semi")
    met = posted.join(lists, "key").where("nid <> hub and " + _alike("n", "hub_n", percent))
    likely = _likely(met.select(F.least("nid", "hub").alias("a"), F.greatest("nid", "hub").alias("b")).distinct(), signs, percent)
    # What needs full sets: those pairs, and the nodes of lists in which a pair without the hub exists.
    wide = posted.join(lists.where("members > 2").select("key"), "key", "left_semi").select("nid")
    needed = common.settled(likely.select(F.explode(F.array("a", "b")).alias("nid")).union(wide).distinct())
    sets = full_sets(docs, rows, nodes.join(sent(needed, 32), "nid", "left_semi"), doc_id, text)
    links = _confirmed(likely, sets, percent)
    comp = common.settled(components(links))
    pairs = open_pairs(posted, prefix, lists, comp, sets, percent)
    more = _confirmed(_likely(pairs, signs, percent), sets, percent)
    if more.limit(1).count():
        comp = common.settled(components(links.union(more)))
    common.dropped(prefix, lists, likely, needed, sets, links, pairs, more)
    return comp


def open_pairs(posted: DataFrame, prefix: DataFrame, lists: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs that share a list, are in different components, do not hold the list's hub, and can be similar enough by the
    sizes of their sets and by the shingles that no other node of such lists has; once each."""
    comp = sent(comp, 48)
    now = posted.join(lists.where("members > 2").select("key", "hub"), "key").where("nid <> hub").select("key", "nid")
    # Written between the joins by key and the sums by key, so that a long list is summed in parts before it meets in one task.
    wide = common.settled(now.join(comp, "nid", "left").select("key", "nid", F.coalesce("comp", "nid").alias("comp")))
    open_keys = wide.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    now = common.settled(wide.join(sent(open_keys, 32), "key", "left_semi"))
    common.dropped(wide)
    each = sets.join(sent(now.select("nid").distinct(), 32), "nid", "left_semi").select("nid", F.explode("shingles").alias("shingle"))
    own = each.groupBy("shingle").agg(F.count("*").alias("df"), F.min("nid").alias("nid")).where("df = 1").withColumn("bucket", _bucket("shingle"))
    own = own.groupBy("nid").agg(F.count("*").alias("alone"), F.array(*[F.count_if(F.col("bucket") == i) for i in range(BUCKETS)]).alias("own"))
    none = F.array_repeat(F.lit(0).cast("long"), BUCKETS)
    bound = prefix.select("nid", "n", "keys").join(sets.select("nid", "buckets").join(sent(now.select("nid").distinct(), 32), "nid", "left_semi"), "nid").join(own, "nid", "left")
    bound = bound.select("nid", "n", "keys", F.coalesce("alone", F.lit(0).cast("long")).alias("alone"), F.zip_with("buckets", F.coalesce("own", none), lambda p, q: (p - q).cast("int")).alias("common"))
    bound = common.settled(bound.where(f"100 * alone <= {100 - percent} * n"))
    held = now.join(sent(bound, 64 + 8 * COORDS + 4 * BUCKETS), "nid").withColumn("shared", F.col("n") - F.col("alone"))
    sizes = held.groupBy("key", "comp").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("comps"))
    held = held.join(sent(sizes.where("comps > 1").select("key", "main"), 48), "key").withColumn("out", F.col("comp") != F.col("main")).drop("main")
    band = lambda c: F.floor(F.log(c) / math.log(BAND))  # noqa: E731  c >= 1: alone is less than n
    reach = F.expr(f"{100 - percent} * n / {percent} - alone")
    low, high = F.greatest(F.col("shared") - reach, F.lit(1.0)), F.col("shared") + reach
    x = held.where("out").withColumn("band", F.explode(F.sequence(band(low), band(high))))
    y = held.withColumn("band", band(F.col("shared").cast("double")))
    x = x.select("key", "band", *[F.col(c).alias(f"{c}_a") for c in ("nid", "n", "alone", "shared", "common", "comp", "keys")])
    y = y.select("key", "band", *[F.col(c).alias(f"{c}_b") for c in ("nid", "n", "alone", "shared", "common", "comp", "keys", "out")])
    new = F.expr(f"comp_a <> comp_b and (not out_b or nid_a < nid_b) and {_alike('n_a', 'n_b', percent)}")
    fits = F.expr(f"{100 + percent} * (alone_a + alone_b + abs(shared_a - shared_b)) <= {100 - percent} * (n_a + n_b)")
    first = F.element_at(F.array_intersect("keys_a", "keys_b"), 1) == x["key"]
    apart = " + ".join(f"abs(common_a[{i}] - common_b[{i}])" for i in range(BUCKETS))
    near = F.expr(f"{100 + percent} * (alone_a + alone_b + {apart}) <= {100 - percent} * (n_a + n_b)")
    met = x.join(y, (x["key"] == y["key"]) & (x["band"] == y["band"]) & new & fits & near & first)
    out = common.settled(met.select(F.least("nid_a", "nid_b").alias("a"), F.greatest("nid_a", "nid_b").alias("b")))
    common.dropped(now, bound)
    return out


def full_sets(docs: DataFrame, rows: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """nid, shingles and buckets of nodes, made again from their texts."""
    nodes = common.settled(nodes.select("nid", "node", "least"))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    members = nodes.where("least is not null").select(F.col("least").alias("doc_id"), "nid", "node")
    texts = source.join(sent(members, 96), "doc_id").select("node", "nid", "text")
    lone = nodes.where("least is null").select("node", "nid")
    if lone.limit(1).count():  # sets of rows without an id alone are found by their digests
        tagged = common.mapped(source.where("doc_id is null"), _tagged("text", "node"), T.StructType([*source.schema.fields, T.StructField("node", T.BinaryType())]))
        texts = texts.unionByName(tagged.join(sent(lone, 64), "node").select("node", "nid", "text").dropDuplicates(["nid"]))
    sets = common.mapped(texts, _sets, "nid long, shingles array<long>, buckets array<int>")
    if rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["nid"])  # ids of several rows
    sets = common.settled(sets)
    common.dropped(nodes)
    return sets


def _bucket(shingle: str) -> "F.Column":
    return F.shiftrightunsigned(shingle, _BUCKET_BITS) % BUCKETS


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """nid, shingles, buckets (how many are in each); without texts other than the one that the node stands for (of an id that several texts share)."""
    for batch in common.slices(batches, "text", size=SLICE):
        flat, bounds = shingle_sets(*common.utf8(batch, "text"))
        keep = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() == n for a, b, n in zip(bounds[:-1].tolist(), bounds[1:].tolist(), batch.column(0).to_pylist(), strict=True)]
        full = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))
        row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        place = row * BUCKETS + ((flat >> np.uint64(_BUCKET_BITS)) % np.uint64(BUCKETS)).astype(np.int64)
        count = np.bincount(place, minlength=batch.num_rows * BUCKETS).astype(np.int32)
        buckets = pa.FixedSizeListArray.from_arrays(pa.array(count), BUCKETS).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(1), full, buckets], ["nid", "shingles", "buckets"]).filter(pa.array(keep, pa.bool_()))


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    return _grouped(docs, doc_id, text, percent).drop("node", "first")


def _grouped(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """grouped with node, and first: whether the component counts from this node, which stands for it where no id does."""
    rows = common.settled(digests(docs, doc_id, text))
    nodes = distinct_sets(rows)
    comp = linked(docs, rows, nodes, doc_id, text, percent)
    joined = comp.join(nodes.select("nid", "node", "least"), "nid")
    named = joined.join(joined.groupBy("comp").agg(F.min("least").alias("name")), "comp").select("node", "name", (F.col("nid") == F.col("comp")).alias("first"))
    names = nodes.select("node", "least").join(sent(named, 96), "node", "left").select("node", F.coalesce("name", "least").alias("name"), F.coalesce("first", F.lit(True)).alias("first"))
    out = rows.select("doc_id", "n_shingles", "node").join(names, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("name"))
    return out.select("node", "first", "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = common.BROADCAST_BYTES, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group: a row whose text is in the component that its doc_id names; of several, one.

    Rows with a null doc_id go where an id names their component; of a component of such rows only, one stays, and those with an
    empty set stay.  The ids that go are sent to the documents if they are few, else joined."""
    found = common.settled(_grouped(docs, doc_id, text, percent))
    if not found.where("doc_id is null").limit(1).count():
        return _with_ids(docs, found, doc_id, text, limit)
    node = common.fresh("node", docs.columns)
    lone = common.mapped(docs.where(F.col(doc_id).isNull()), _tagged(text, node), T.StructType([*docs.schema.fields, T.StructField(node, T.BinaryType())]))
    stays = common.settled(found.where("doc_id is null and component_id is null and first").select(F.col("node").alias(node)).distinct())
    one = lone.join(sent(stays, 48, limit), node, "left_semi").groupBy(node).agg(F.min_by(F.struct(*docs.columns), F.coalesce(text, F.lit(""))).alias("one")).select("one.*")
    empty = lone.where(F.octet_length(node) == 0).select(*docs.columns)
    return _with_ids(docs.where(F.col(doc_id).isNotNull()), found, doc_id, text, limit).select(*docs.columns).unionByName(one).unionByName(empty)


def _with_ids(docs: DataFrame, found: DataFrame, doc_id: str, text: str, limit: int) -> DataFrame:
    """deduplicated for the rows that have an id."""
    gone = common.settled(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias(doc_id)).distinct())
    twice = common.settled(found.where("doc_id is not null").groupBy(F.col("doc_id").alias(doc_id)).count().where("count > 1").select(doc_id))
    if not twice.limit(1).count():
        return docs.join(sent(gone, 32, limit), doc_id, "left_anti")
    # Ids of several rows: these rows are told apart by their texts' digests.
    gone = gone.join(sent(twice, 32, limit), doc_id, "left_anti")
    once = docs.join(sent(twice, 32, limit), doc_id, "left_anti").join(sent(gone, 32, limit), doc_id, "left_anti")
    node, nth = common.fresh("node", docs.columns), common.fresh("nth", docs.columns)
    again = docs.join(sent(twice, 32, limit), doc_id, "left_semi").select(*docs.columns)
    again = common.mapped(again, _tagged(text, node), T.StructType([*docs.schema.fields, T.StructField(node, T.BinaryType())]))
    stays = found.where("kept").select(F.col("doc_id").alias(doc_id), F.coalesce("node", F.lit(b"")).alias(node)).distinct()
    first = again.join(stays, [doc_id, node], "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(doc_id, node).orderBy(text))).where(F.col(nth) == 1)
    return once.select(*docs.columns).unionByName(first.select(*docs.columns))


def _tagged(text: str, node: str):
    """Rows with the digest of their text's set; empty bytes for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text, size=SLICE):
            flat, bounds = shingle_sets(*common.utf8(batch, text))
            tags = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() if b > a else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tags, pa.binary())], [*batch.schema.names, node])

    return run
