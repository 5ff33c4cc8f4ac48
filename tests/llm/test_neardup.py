import random
import re
from collections import Counter

from quantloom.llm import neardup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """component by row number, from all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    lists = {}
    for i, s in enumerate(sets):
        for g in s:
            lists.setdefault(g, []).append(i)
    both = Counter((a, b) for m in lists.values() for x, a in enumerate(m) for b in m[x + 1 :])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            names[r] = min(names.get(r, d), d)
    return [(d, len(s), names.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.grouped(docs).collect())
    assert got == Counter(brute(rows))


def family(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_small_and_odd(spark, odd):
    texts = [*odd, "a b", "A B", "a b c d e f", "A\tB c D e\nf", "a b c d e f g", "one two three four", "one two three four"]
    check(spark, list(enumerate(texts)))
    assert neardup.grouped(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_families_and_passages(spark):
    rng = random.Random(1)
    rows = []
    for f in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([40, 120, 300]))]
        rows += family(rng, base, 12, 6)
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    check(spark, list(enumerate(rows)))


def test_a_group_that_is_half_alike(spark):
    """Many open pairs: the bound leaves few of them, and no link is lost."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    check(spark, list(enumerate(family(rng, base, 150, 12))))


def test_repeated_ids_and_null_ids(spark):
    t = " ".join(f"x{i}" for i in range(50))
    rows = [(5, t), (5, t), (5, "another text that is not the same at all"), (None, t), (2, t + " end"), (None, "alone here with nobody else near it"), (9, "")]
    check(spark, rows)


def test_near_copies_without_ids(spark, docs_of):
    """A text that only rows without an id have is confirmed too: it is linked, and it links others; deduplication leaves one."""
    t = " ".join(f"x{i}" for i in range(50))
    a, n, b = (" ".join(f"y{i}" for i in range(k, k + 90)) for k in (0, 5, 10))
    u = " ".join(f"z{i}" for i in range(60))
    rows = [(1, t), (None, t + " x"), (None, t + " x"), (7, a), (None, n), (8, b), (None, u), (None, u + " x"), (None, u.upper()), (None, ""), (None, None)]
    check(spark, rows)
    docs = docs_of([t for _, t in rows], [i for i, _ in rows])
    for limit in (0, 1 << 20):
        out = neardup.deduplicated(docs, limit=limit)
        assert out.columns == docs.columns
        left = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert sorted(i for i, _ in left if i is not None) == [1, 7]
        lone = [x for i, x in left if i is None]
        assert len(lone) == 3 and {None, ""} < set(lone) and any(x and x.lower().startswith(u) for x in lone)


def test_deduplicated_keeps_one_of_each_group(spark, docs_of):
    t = " ".join(f"x{i}" for i in range(80))
    docs = docs_of([t, t, t + " more", "something else entirely, five words", None, ""], [3, 1, 2, 4, 6, 5])
    for limit in (0, 1 << 20):
        out = neardup.deduplicated(docs, limit=limit)
        assert out.columns == docs.columns
        assert sorted(r["doc_id"] for r in out.collect()) == [1, 4, 5, 6]
    twice = docs_of([t, t, t, "other words stand here, five"], [1, 1, 2, 2])
    assert sorted((r["doc_id"], r["text"]) for r in neardup.deduplicated(twice).collect()) == [(1, t), (2, "other words stand here, five")]


def test_deduplicated_at_80_percent(spark, docs_of):
    """Similarities 0.82 and 0.79: copies from 80 % on are the first pair alone, from 85 % on neither."""
    t = [f"x{i}" for i in range(104)]  # 100 shingles
    at = lambda n: " ".join(t[: n + 4])
    docs = docs_of([at(100), at(82), "other words stand here, five", " ".join(f"y{i}" for i in range(104)), " ".join(f"y{i}" for i in range(83))])
    assert sorted(r["doc_id"] for r in neardup.deduplicated(docs, percent=80).collect()) == [0, 2, 3, 4]
    assert {r["doc_id"] for r in neardup.grouped(docs, percent=85).where("kept").collect()} == {0, 1, 2, 3, 4}
    assert (neardup.matches(85), neardup.matches(80)) == (17, 14)


def test_families_at_80_percent(spark):
    """Against all pairs."""
    rng = random.Random(3)
    rows = list(enumerate(family(rng, [f"w{i}" for i in range(150)], 80, 8)))
    sets = [shingles(t) for _, t in rows]
    name = [i for i, _ in rows]
    for _ in rows:
        name = [min(name[b] for b in range(len(rows)) if 100 * len(s & sets[b]) >= 80 * len(s | sets[b])) for s in sets]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.grouped(docs, percent=80).collect()} == dict(enumerate(name))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["nid"]: r["comp"] for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
