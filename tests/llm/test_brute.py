"""Operators that SQL cannot say against plain versions, and the edge cases of all."""

import bisect
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_neardup import brute, family
from test_text import brute_hits

from quantloom.llm import common, decontaminate, langid, lm, media, neardup, pieces, pii, quality

DOCS = "/root/testdata/sf0.001/documents.parquet"


def utf8(*texts):
    return common.utf8(pa.RecordBatch.from_pydict({"t": list(texts)}), "t")


# --- language ---------------------------------------------------------------------------------------------------------------------------------


def plain_language(net, text):
    """Probabilities by one window, filter and place after the other."""
    raw, total = text.encode(), np.zeros(len(net.langs))
    for a in range(0, len(raw), langid.WINDOW):
        part = raw[a : a + langid.WINDOW]
        w = part + b"\0" * (langid.WINDOW - len(part))
        h = [max(0.0, max(sum(float(f[k, w[i + k], c]) for k in range(n)) for i in range(len(w) - n + 1))) for n, f in net.filters.items() for c in range(langid.FILTERS)]
        z = np.array([float(net.bias[j]) + sum(x * float(net.dense[i, j]) for i, x in enumerate(h)) for j in range(len(net.langs))])
        p = np.exp(z - z.max())
        total += len(part) * p / p.sum()
    return total / max(len(raw), 1)


def test_language_is_the_plain_network():
    net = langid.Network(["a", "b", "c"])
    texts = ["of the and", "é" * 150, "x"]
    got = net.predict(*utf8(*texts))
    for g, t in zip(got, texts, strict=True):
        assert np.allclose(g, plain_language(net, t), atol=1e-5)


def test_language_scores_do_not_depend_on_the_batch():
    net = langid.Network(["a", "b", "c", "d"])
    texts = ["".join(chr(97 + (i * k) % 26) for k in range(40 + 37 * i)) for i in range(60)]
    whole = net.predict(*utf8(*texts))
    for i, t in enumerate(texts):
        assert (net.predict(*utf8(t)) == whole[i]).all()


def test_many_languages_are_all_learned(spark):
    rows = [(i, f"word{i % 300} " * 20, f"l{i % 300}") for i in range(600)]
    assert len(langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=600).langs) == 300


# --- quality ----------------------------------------------------------------------------------------------------------------------------------


def test_quality_is_the_sum_of_its_tables():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, len(quality.NAMES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.Additive().train(x, y)
    for row, s in zip(x[:50], model.score(x[:50]), strict=True):
        b = [bisect.bisect_right(e.tolist(), v) for e, v in zip(model.edges, row.tolist(), strict=True)]
        z = model.base + sum(t[k] for t, k in zip(model.one, b, strict=True)) + sum(t[b[i]][b[j]] for (i, j), t in model.two.items())
        assert s == pytest.approx(1 / (1 + math.exp(-z)))
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_best_tree_of_two_leaves():
    """Against every cut."""
    rng = np.random.default_rng(4)
    g, h = rng.normal(size=12), rng.uniform(0.1, 1, 12)
    gain = lambda a: g[:a].sum() ** 2 / (h[:a].sum() + 2) + g[a:].sum() ** 2 / (h[a:].sum() + 2)
    a = max(range(1, 12), key=gain)
    assert np.allclose(quality.tree(g, h, 2), [g[:a].sum() / (h[:a].sum() + 2)] * a + [g[a:].sum() / (h[a:].sum() + 2)] * (12 - a))


# --- language model ---------------------------------------------------------------------------------------------------------------------------


def test_pseudo_likelihood_is_the_plain_sum(spark, docs_of):
    net, text = lm.Network(), "the cäsar sat"
    table, bias, out, last = (p.astype(float) for p in net.params)
    raw, want = text.encode(), 0.0
    for i, token in enumerate(raw):
        around = [raw[j] if 0 <= j < len(raw) else lm.PAD for j in range(i - lm.RADIUS, i + lm.RADIUS + 1) if j != i]
        h = [math.tanh(bias[c] + sum(table[k, b, c] for k, b in enumerate(around))) for c in range(lm.HIDDEN)]
        z = [last[v] + sum(x * out[c, v] for c, x in enumerate(h)) for v in range(256)]
        want += z[token] - math.log(sum(map(math.exp, z)))
    row = lm.scored(docs_of([text, text]), net).collect()
    assert row[0]["pll"] == row[1]["pll"] == pytest.approx(want, rel=1e-5) and row[0]["n_tokens"] == len(raw)


# --- audio ------------------------------------------------------------------------------------------------------------------------------------


def plain_resampled(pcm, half=8):
    """Twice the rate, sample by sample."""
    out = []
    for i in range(2 * len(pcm)):
        at, taps = i / 2, []
        for k in range(math.floor(at) - half + 1, math.floor(at) + half + 1):
            x = k - at
            s = 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
            taps.append((k, s * (0.5 + 0.5 * math.cos(math.pi * max(-1, min(1, x / half))))))
        total = sum(w for _, w in taps)
        out.append(sum(w / total * (pcm[k] if 0 <= k < len(pcm) else 0) for k, w in taps))
    return out


def test_features_of_stored_payloads(spark, docs_of):
    """All codings, decoded byte by byte, resampled sample by sample, against the stored PCM and its features."""
    texts = [f"text number {i}, éa " * (1 + i % 3) for i in range(9)] + ["", None]
    rows = media.stored_payloads(docs_of(texts), files=True).collect()
    assert {r["coding"] for r in rows} == {media.MULAW, media.ALAW, media.IMA}
    for r in rows:
        payload = (texts[r["doc_id"]] or "").encode()
        payload += b"\xff" * (-len(payload) % 576 if payload else 576)
        form, _, block, data = media.unwav(bytes(r["media"]))
        assert (data, form) == (payload, media.CODINGS[zlib.crc32(payload) % 3])
        if form == media.MULAW:
            pcm = [int(media.MULAW_PCM[b]) for b in payload]
        elif form == media.ALAW:
            pcm = [int(media.ALAW_PCM[b]) for b in payload]
        else:
            pcm = [int(v) for a in range(0, len(payload), block) for v in media.ima_blocks(np.frombuffer(payload[a : a + block], np.uint8)[None])[0]]
        want = np.clip(np.array(plain_resampled(pcm)), -32768, 32767)
        got = np.frombuffer(media.unwav(bytes(r["pcm_wav"]))[3], "<i2").astype(float)
        assert len(got) == len(want) and np.abs(got - want).max() <= 1
        x = dict(f.split("=") for f in r["feature"].split(";"))
        assert (int(x["n"]), int(x["peak"])) == (len(got), int(np.abs(got).max()))
        assert float(x["rms"]) == pytest.approx(math.sqrt(sum(v * v for v in got) / len(got)), abs=2e-3)
        assert float(x["zcr"]) == pytest.approx(sum((a < 0) != (b < 0) for a, b in zip(got, got[1:])) / (len(got) - 1), abs=2e-6)
        assert float(x["step"]) == pytest.approx(sum(abs(b - a) for a, b in zip(got, got[1:])) / (len(got) - 1), abs=2e-3)
    digests = {r["doc_id"]: r for r in media.stored_payloads(docs_of(texts)).collect()}
    for r in rows:
        d = digests[r["doc_id"]]
        for kind in ("media", "pcm"):
            raw = bytes(r["media" if kind == "media" else "pcm_wav"])
            assert (d[f"{kind}_bytes"], d[f"{kind}_sha256"]) == (len(raw), hashlib.sha256(raw).hexdigest())


# --- personal data ----------------------------------------------------------------------------------------------------------------------------


def test_addresses_are_the_pattern_s():
    rng, plain = random.Random(6), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(3000):
        t = "".join(rng.choice("123..x ") for _ in range(rng.randrange(40)))
        assert list(pii._addresses(t)) == [(m.start(), m.end()) for m in plain.finditer(t)], t


def test_long_digit_runs_are_read_in_linear_time():
    for t in ("7" * 10_000_000, "1." * 1_000_000, "1.2.3 " * 300_000, "@a" * 500_000, "+1(" * 300_000):
        start = time.time()
        pii.spans(t)
        assert time.time() - start < 60, t[:10]


# --- decontamination --------------------------------------------------------------------------------------------------------------------------


def test_what_is_sent_is_measured():
    items = [(i, " ".join(f"w{(i * k) % 5000}" for k in range(200))) for i in range(200)]
    made = decontaminate.WindowSet(items)
    assert made.sent_bytes() < 12 * sum(len(t) for _, t in items)
    assert made.sent_bytes() > sum(c.nbytes + a.nbytes for _, c, a in made.by_length) > 0


# --- near-duplicates --------------------------------------------------------------------------------------------------------------------------


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Compared pairs grow in proportion to the group, and most are not between members that are too far apart."""
    made, real = [], neardup._confirmed
    monkeypatch.setattr(neardup, "_confirmed", lambda likely, *a: made.append(likely.count()) or real(likely, *a))
    base = [f"w{i}" for i in range(140)]
    pairs = {}
    for n in (400, 1600):
        made.clear()
        rows = list(enumerate(family(random.Random(n), base, n, 16)))
        got = neardup.grouped(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()
        assert len(got) == n
        pairs[n] = sum(made)
    assert pairs[1600] < 8 * pairs[400] and pairs[1600] < 1600 * 20


# --- every operator: empty tables, nulls, repeated rows, clashing columns -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def models(spark):
    docs = spark.read.parquet(DOCS)
    return {"lang": langid.fit(docs, rows=200), "lm": lm.Network(), "quality": quality.fit(docs, spark.read.parquet(DOCS.replace("documents", "labels")))}


def applied(docs, bench, vocabulary, models):
    return {
        "pieces": pieces.sampled(docs, vocabulary, digest=True), "lm": lm.scored(docs, models["lm"]), "hits": decontaminate.hits(docs, bench),
        "pii": pii.found(docs), "tokens": pieces.token_counts(docs, vocabulary), "language": langid.predicted(docs, models["lang"]),
        "quality": quality.scored(docs, models["quality"]), "media": media.stored_payloads(docs), "near": neardup.grouped(docs),
    }


def test_edge_cases_of_all(spark, docs_of, vocabulary, models, odd):
    bench = spark.createDataFrame([(1, "word word word"), (None, None)], "item_id long, text string")
    for name, out in applied(docs_of([]), bench, vocabulary, models).items():
        assert out.count() == 0, name
    ids = [*range(len(odd)), *range(len(odd)), None]
    docs = docs_of([*odd, *odd, "a null id"], ids)
    for name, out in applied(docs, bench, vocabulary, models).items():
        rows = [tuple(r) for r in out.collect()]
        assert len(rows) == len(ids), name
        assert sum(r[0] is None for r in rows) == 1, name
        by = {}
        for r in rows:
            by.setdefault(r[0], set()).add(r)
        assert all(len(v) == 1 for v in by.values()), name  # repeated rows, equal results


# --- the pipeline against plain stages ----------------------------------------------------------------------------------------------------------


def plain_cut(text, items):
    """text without hit words, or None if more than half of its words are hit; by character."""
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    words = [(m.start(), m.end(), fold(m[0])) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))]
    hit = set()
    for t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t or ""))
        n = min(10, len(w))
        wins = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(x[2] for x in words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
    if len(hit) > 0.5 * len(words):
        return None
    out, at, k = [], 0, 0
    while k < len(words):
        if k in hit:
            end = k
            while end + 1 in hit:
                end += 1
            out.append(text[at : words[k][0]])
            at, k = words[end][1], end
        k += 1
    return "".join([*out, text[at:]])


def test_pipeline_stages_are_the_plain_ones(spark, tmp_path, vocabulary):
    import corpus_pipeline

    base = spark.read.parquet(DOCS).orderBy("doc_id").limit(60).collect()
    rows = [(r["doc_id"], r["text"][:3000], r["lang"], r["source"], r["n_chars"], "x") for r in base]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(DOCS.replace("documents", "benchmark")).collect()]
    rows += [(900 + i, t, None, "hot", None, None) for i, t in enumerate([None, "", "123 456", rows[0][1], rows[1][1] + " more", "Of the " + bench[0][1] + " and the " + rows[2][1]])]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages, d = dict(corpus_pipeline.STAGES), str(tmp_path)

    net = langid.fit(docs)
    first = stages["language_id"](spark, docs, d)
    kept = {r["doc_id"] for r in first.collect()}
    for i, t, *_ in rows:
        if t and len(t) < 1200:
            assert (i in kept) == (any(map(str.isalpha, t)) and plain_language(net, t).max() >= 0.3), t[:80]
    assert not kept & {900, 901, 902} and first.columns == docs.columns

    texts = [(r["doc_id"], r["text"]) for r in first.collect()]
    second = {r["doc_id"]: r["text"] for r in stages["near_duplicates"](spark, first, d).collect()}
    assert set(second) == {i for i, _, name in brute(texts) if name == i}

    third = {r["doc_id"]: r["text"] for r in stages["decontamination"](spark, docs.where("text is not null"), d).collect()}
    want = {i: plain_cut(t, [b for _, b in bench]) for i, t, *_ in rows if t is not None}
    assert third == {i: t for i, t in want.items() if t is not None} and any(third[i] != t for i, t, *_ in rows if i in third)
    assert {i for i, h in brute_hits([(i, t) for i, t, *_ in rows if t is not None], bench).items() if not h[4]} <= set(third)

    fourth = {r["doc_id"]: r["text"] for r in stages["personal_data"](spark, docs, d).collect()}
    for i, t, *_ in rows:
        left = fourth[i]
        assert (left is None) == (t is None) and (not t or not any(s.kind in pii.BASE for s in pii.spans(left)))
        assert pii.spans(t) or left == t

    last = stages["piece_encoding"](spark, docs, d)
    assert {r["doc_id"]: r["text"] for r in pieces.decoded(last, vocabulary).collect()} == {i: t or "" for i, t, *_ in rows}
    done = {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()}
    assert done and done <= set(second)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(DOCS)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(DOCS.replace("documents", "benchmark")).limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
