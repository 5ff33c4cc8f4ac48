from collections import Counter

import numpy as np
import pytest

from quantloom.llm import pieces


@pytest.mark.parametrize("head", [pieces.HEAD_BYTES, 700, 0])
def test_counts_are_the_library_s(spark, docs_of, vocabulary, odd, head):
    """With all pre-tokens sent, some, and none."""
    sp = pieces.processor(vocabulary)
    rows = [*enumerate(odd), (3, odd[3]), (None, "a b a b")]
    docs = docs_of([t for _, t in rows], [i for i, _ in rows])
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_bytes"], r["over_limit"]) for r in pieces.token_counts(docs, vocabulary, limit=100, head=head).collect())
    want = [(i is None, i or 0, n := len(sp.encode(t or "")), len((t or "").encode()), n > 100) for i, t in rows]
    assert got == sorted(want)
    assert pieces.token_counts(docs_of([]), vocabulary, head=head).count() == 0


def test_each_pretoken_is_encoded_once(spark, docs_of, vocabulary):
    docs = docs_of(["a b a", "b a c", "c c c", None]).repartition(3)
    table = pieces.pretoken_table(docs, vocabulary).collect()
    assert sorted((r["key"], r["freq"]) for r in table) == [("a", 3), ("b", 2), ("c", 4)]
    assert pieces.frequent(spark.createDataFrame(table), 2 * pieces.ENTRY + 10) == ({"c": len(pieces.processor(vocabulary).encode("c"))}, 4)


def test_counts_on_the_tables(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sp = pieces.processor(vocabulary)
    want = {r["doc_id"]: len(sp.encode(r["text"])) for r in docs.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in pieces.token_counts(docs, vocabulary).collect()} == want


def test_sampling_is_lossless_and_decodes(spark, docs_of, vocabulary, odd):
    docs = docs_of(odd)
    out = pieces.sampled(docs, vocabulary).persist()
    assert out.where("not lossless").count() == 0 and out.count() == len(odd)
    assert {r["doc_id"]: r["text"] for r in pieces.decoded(out, vocabulary).collect()} == {i: t or "" for i, t in enumerate(odd)}
    assert pieces.sampled(docs_of([]), vocabulary).count() == 0


def test_sampling_depends_on_the_row_alone(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r["doc_id"]: r["pieces_sha256"] for r in pieces.sampled(docs.repartition(7), vocabulary, digest=True).collect()}
    two = {r["doc_id"]: r["pieces_sha256"] for r in pieces.sampled(docs.coalesce(1), vocabulary, digest=True).collect()}
    assert one == two and len(one) == 200


def test_draws_follow_the_lattice(vocabulary):
    """Shares of all segmentations of two words against their weights, counted by brute force."""
    sp = pieces.processor(vocabulary)
    known = {sp.id_to_piece(i).replace("▁", " "): i for i in range(259, sp.get_piece_size())}

    def all_of(x):
        if not x:
            yield (), 1.0
        for k in range(1, len(x) + 1):
            if x[:k] in known:
                for rest, p in all_of(x[k:]):
                    yield (known[x[:k]], *rest), p / (known[x[:k]] + 2)

    lattice, n = pieces.Lattice(vocabulary), 20000
    drawn = lattice.sample(["than thanon"] * n, np.arange(n))
    want = Counter()
    for a, p in all_of(" than"):
        for b, q in all_of(" thanon"):
            want[a + b] += p * q
    total = sum(want.values())
    got = Counter(tuple(i.tolist()) for i in drawn)
    assert set(got) <= set(want)
    assert max(abs(got[k] / n - v / total) for k, v in want.items()) < 0.02
    assert len(got) > 3


def test_long_parts_do_not_vanish(vocabulary):
    lattice, decoder = pieces.Lattice(vocabulary), pieces.Decoder(vocabulary)
    text = "thanonti" * 4000 + "漢" * 500
    assert decoder.text(lattice.sample([text], np.array([5]))[0].tolist()) == text
