"""Decontamination, personal data, extraction, language, quality, audio and the language model."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import common, decontaminate, extract, langid, lm, media, pii, quality
from quantloom.llm import queries as Q

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- decontamination -----------------------------------------------------------------------------------------------------------------------


def brute_hits(docs, items):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, met = WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    met |= own
        ids = ",".join(sorted(str(i) for i in met if i is not None))
        out[d] = (len(w), len(hit), len({i for i in met if i is not None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Éa", "9x"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 10, 11, 30])))) for i in range(25)] + [(100, None), (101, " .,"), (7, "w1 w2 w3"), (102, "W1, w2; w3")]
    docs = []
    for d in range(80):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(items)[1] or ""
            parts.insert(rng.randrange(len(parts) + 1), t.upper().replace(" ", ", ") if rng.random() < 0.5 else t)
        docs.append((d, " . ".join(parts)))
    return [*docs, (200, None), (201, ""), (202, "..."), (203, "w1 w2"), (204, "word " * 30000)], items


@pytest.mark.parametrize("limit", [decontaminate.BLOCK_BYTES, 300])
def test_hits(spark, leaks, limit):
    docs, items = leaks
    got = decontaminate.hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), limit=limit)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()} == brute_hits(docs, items)


def test_hits_of_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(docs_of(["some words"]), none).first()["n_hit"] == 0
    assert decontaminate.hits(docs_of([]), none).count() == 0


def test_clean_cuts_and_drops(spark, docs_of):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    before, after = "alpha beta gamma delta " * 4, "omega psi chi phi " * 4
    docs = docs_of([f"{before}{item.upper()}, {after}", item, "clean text", None, ""])
    out = {r["doc_id"]: r for r in decontaminate.clean(docs, bench).collect()}
    assert set(out) == {0, 2, 3, 4} and out[0]["text"] == f"{before}, {after}" and out[0]["n_chars"] == len(out[0]["text"]) and out[0]["node"] == "x"
    assert (out[2]["text"], out[3]["text"], out[4]["text"]) == ("clean text", None, "")


def test_clean_of_many_blocks_is_that_of_one(spark, leaks, docs_of):
    """A short item inside a long one, passages side by side, and a share that no block reaches alone."""
    words = [f"v{i}" for i in range(60)]
    long, short = " ".join(words[:20]), " ".join(words[8:11])
    left, right = " ".join(words[20:32]), " ".join(words[30:42])
    items = [(1, long), (2, short), (3, left), (4, right)] + leaks[1]
    rest = lambda n: " ".join(f"z{i}" for i in range(n))
    texts = [f"{rest(30)} {long} {rest(9)}", f"{rest(30)} {' '.join(words[20:42])} end", f"{long} {rest(16)} {left}", *(t for _, t in leaks[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = Counter(tuple(r) for r in decontaminate.clean(docs_of(texts), bench).collect())
    many = decontaminate.clean(docs_of(texts), bench, limit=300)
    assert many.columns == docs_of([]).columns and Counter(tuple(r) for r in many.collect()) == one
    kept = {r[0]: r[1] for r in one}
    assert kept[0] == f"{rest(30)}  {rest(9)}" and kept[1] == f"{rest(30)}  end" and 2 not in kept


# --- personal data --------------------------------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(t):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x[-9:]) <= 255 and not x[:-9].strip("0") for x in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum((x * 2 - 9 * (x > 4)) if i % 2 else x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = [(m.start(), k, m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if good(k, m[0])]
    return [f"{k}:{a}:{b}" for a, k, b in sorted(found, key=lambda x: (x[0], list(PATTERNS).index(x[1])))]


def test_base_spans_are_the_patterns(spark, docs_of, odd):
    rng = random.Random(6)
    bits = ["a.b@c-d.example", "@", "x@y@z.co", "é@a.b", "1.2.3.4", "256.1.1.1", "001.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "+1 (603) 555-8791", "+12", "+44.20.7946.0958", "0" * 5000, "9" * 5000 + ".1.1.1", "...@a..b", "a@b.", " ", "\n", "word", "call", ".", "-", "12-34", "ü"]
    texts = [*odd, *("".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(1, 15))) for _ in range(400))]
    for r in pii.found(docs_of(texts)).collect():
        want = brute_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]
        assert set(want) <= set(r["spans"].split(","))


def test_added_spans_and_scores():
    kinds = lambda t: [s.kind for s in pii.spans(t)]
    assert "iban" in kinds("bank DE89 3704 0044 0532 0130 00 now") and "iban" not in kinds("bank DE88 3704 0044 0532 0130 00 now")
    assert kinds("his SSN is 078-05-1120.") == ["national"] and kinds("item 078-05-1120.") == []
    plain, near = pii.spans("+1 603 555 8791")[0].score, pii.spans("call +1 603 555 8791")[0].score
    assert near > plain > pii.spans("order +1 603 555 8791")[0].score


def test_redaction(spark, docs_of):
    out = pii.redacted(docs_of(["mail a@b.co or 1.2.3.4", None, "", "clean"]))
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["mail [EMAIL] or [IP]", None, "", "clean"]
    assert out.columns == docs_of([]).columns and pii.redacted(docs_of([])).count() == 0


# --- extraction -----------------------------------------------------------------------------------------------------------------------------

SOUP = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><div id="site-header"><a href="/">Home</a></div>
<div class="menu"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><div class="post-content"><h1>Big title</h1>
<p>First paragraph of the text, long enough to be con<b>tent</b>, with commas.<p>Short.<div class="ad">Buy now!</div>
<p>Another paragraph with <a href="x>y">a link</a> in it, and &quot;quotes &amp; more&quot;.</p></div>
<div class="cookie-notice">We use cookies. Accept?</div><form>Search <button>Go</button></form><!-- <p>no</p> -->
<div id=comments><p>I like this article a lot, it is the best thing I ever read.</p></div><script>var t="</p>";</script><div class="footer">Copyright</div>"""


def test_main_text(spark):
    want = 'Big title First paragraph of the text, long enough to be content, with commas. Short. Another paragraph with a link in it, and "quotes & more".'
    rows = [(1, "u", SOUP), (2, None, None), (3, "u", ""), (4, "u", "<nav><a>x</a></nav>"), (5, "u", "<article><p>one<p>two</article>"), (1, "u", SOUP), (6, "u", "<div>" * 3000 + "<article>deep" * 2)]
    out = extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r["text"] for r in out}
    assert by == {1: want, 2: "", 3: "", 4: "", 5: "one two", 6: "deep deep"} and len(out) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_of_the_tables(spark):
    import html

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert extract.main_text(r["html"])[0] == " ".join(p for p in parts if p)


def test_elements_without_an_end_and_long_attributes():
    article = "<article><p>The first paragraph stands here, long enough to be read.</p></article>"
    want = "The first paragraph stands here, long enough to be read."
    long = "data:image/svg+xml," + "<path>" * 2000
    for before in ("<video src=a>", "<select><option>A", "<div><canvas></div>", f'<img src="{long}">', "<svg><g><path d='x'/></g></svg>", "<video><p>no</p></video>"):
        assert extract.main_text(f"<body>{before}{article}</body>")[0] == want, before
    assert extract.main_text("<article><p>where <math><mi>x</mi></math> is a number <svg><path d=a></svg>and more.</p></article>")[0] == "where x is a number and more."
    assert extract.main_text("<article><p>a</article>" + "<b title=\"x'>" * 20001 + "<")[0].startswith("a")


def test_cut_is_minimal():
    """Against the cost of every labelling of small graphs."""
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randrange(2, 8)
        odds = [round(rng.uniform(-3, 3), 2) for _ in range(n)]
        edges = [(a, b, round(rng.uniform(0, 2), 2)) for a in range(n) for b in range(a) if rng.random() < 0.6]
        flow = extract.Flow(odds)
        for a, b, w in edges:
            flow.join(a, b, w)
        cost = lambda on: sum(max(o, 0) if not x else max(-o, 0) for o, x in zip(odds, on)) + sum(w for a, b, w in edges if on[a] != on[b])
        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(flow.source_side()) == pytest.approx(best)


# --- language, quality ----------------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    out = Q.op7(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97 and out["score"].between(0, 1).all() and len(out) > 2000
    assert (out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2).all()


def test_language_of_odd_texts(spark, docs_of, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs)
    out = {r["doc_id"]: r for r in langid.predicted(docs_of(odd), net).collect()}
    for i, t in enumerate(odd):
        assert (out[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= out[i]["score"] <= 1
    assert {r["lang_pred"] for r in langid.predicted(docs_of(["abc"]), None).collect()} == {"und"}
    kept = langid.kept(docs_of(["123", None, "of the and that", ""]), net)
    assert [r["doc_id"] for r in kept.collect()] == [2] and kept.columns == docs_of([]).columns
    assert langid.fit(docs_of([])) is None


def test_windows_cover_every_byte():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 500, "", None, "é" * 100, "x"]})
    raw, bounds = common.utf8(batch, "t")
    x, owner, held = langid.windows(raw, bounds)
    assert [int(held[owner == i].sum()) for i in range(5)] == [500, 0, 0, 200, 1]
    assert b"".join(bytes(w[:h]) for w, h in zip(x, held)) == raw.tobytes() and all((w[h:] == 0).all() for w, h in zip(x, held))


def test_paired_tables_are_the_network():
    net = langid.Network(["a", "b", "c"])
    x = np.random.default_rng(0).integers(0, 256, (5000, langid.WINDOW), dtype=np.uint8)
    assert np.allclose(net.probabilities(x)[:50], net.probabilities(x[:50]), atol=1e-5)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    out = Q.op8(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.97 and out["score"].between(0, 1).all() and len(out) > 500
    assert (out["predicted"] == (out["score"] >= 0.3)).all()


def test_quality_of_odd_texts(spark, docs_of, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    out = quality.scored(docs_of(odd), model).collect()
    assert len(out) == len(odd) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality.scored(docs_of(["a", None]), None).collect()} == {0.5}
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")) is None


# --- audio ----------------------------------------------------------------------------------------------------------------------------------


def test_expansion_tables():
    assert media.MULAW_PCM[[0x00, 0x80, 0x7F, 0xFF]].tolist() == [-32124, 32124, 0, 0]
    assert media.ALAW_PCM[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]


def test_ima_is_the_scalar_decoder():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (20, 64), dtype=np.uint8)
    blocks[:, 2] %= 89

    def scalar(b):
        s = int.from_bytes(bytes(b[:2]), "little", signed=True)
        k, out = int(b[2]), [s]
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                code, step = int(code), int(media.IMA_STEPS[k])
                d = step >> 3
                d += step * bool(code & 4) + (step >> 1) * bool(code & 2) + (step >> 2) * bool(code & 1)
                s = max(-32768, min(32767, s - d if code & 8 else s + d))
                k = max(0, min(88, k + int(media.IMA_MOVES[code & 7])))
                out.append(s)
        return out

    assert media.ima_blocks(blocks).tolist() == [scalar(b) for b in blocks]


def test_payloads(spark, docs_of, odd):
    for r in media.stored_payloads(docs_of(odd)).collect():
        raw = (odd[r["doc_id"]] or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert r["media_bytes"] > len(want)


def test_to_pcm(spark):
    tone = (8000 * np.sin(np.arange(1600) / 8000 * 2 * np.pi * 440)).astype("<i2")
    ima = bytes(np.random.default_rng(2).integers(0, 80, 3 * 256 + 100, dtype=np.uint8))
    rows = [(1, media.wav(tone.tobytes(), media.PCM)), (2, media.wav(bytes(range(256)), media.ALAW)), (3, media.wav(ima, media.IMA, block=256)), (4, None), (5, b"RIFFxxxx"), (6, media.wav(b"", media.MULAW))]
    out = {r["id"]: r for r in media.to_pcm(spark.createDataFrame(rows, "id long, audio binary"), "id", "audio").collect()}
    assert (out[1]["n_samples"], out[2]["n_samples"], out[3]["n_samples"]) == (3200, 512, 2 * (3 * 505 + 193))
    assert out[4]["pcm_wav"] is None and out[5]["feature"] is None and out[6]["n_samples"] == 0
    form, rate, _, data = media.unwav(bytes(out[1]["pcm_wav"]))
    again = np.frombuffer(data, "<i2").astype(float)
    assert (form, rate) == (media.PCM, 16000) and np.abs(again[::2] - tone).max() <= 1
    ideal = 8000 * np.sin(np.arange(3200) / 16000 * 2 * np.pi * 440)
    assert np.abs(again[100:-100] - ideal[100:-100]).max() < 40


# --- language model --------------------------------------------------------------------------------------------------------------------------


def test_windows_and_counts(spark, docs_of):
    texts = ["abcab", "é", None, "", "abcab"]
    raw, bounds = common.utf8(pa.RecordBatch.from_pydict({"t": texts}), "t")
    context, token = lm.unpacked(lm.packed(raw, bounds))
    assert bytes(token) == "abcabéabcab".encode() and context[0].tolist() == [0, 0, 98, 99] and context[4].tolist() == [99, 97, 0, 0]
    n = lm.counted(docs_of(texts)).toPandas()
    assert n["n"].sum() == len(raw) and n["win"].is_unique and n["n"].max() == 2


def test_scores_prefer_what_was_seen(spark, docs_of, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = lm.fit(docs)
    text = docs.orderBy("doc_id").first()["text"]
    shuffled = "".join(random.Random(1).sample(text, len(text)))
    out = {r["doc_id"]: r for r in lm.scored(docs_of([text, shuffled, None, "", text, *odd]), net).collect()}
    assert out[0]["pll_mean"] > out[1]["pll_mean"] + 0.5 and out[0]["pll"] == out[4]["pll"]
    assert out[2]["pll"] == 0 and out[2]["pll_mean"] is None and out[3]["n_tokens"] == 0
    code = lm.packed(*common.utf8(pa.RecordBatch.from_pydict({"t": [text]}), "t"))
    assert out[0]["pll"] == pytest.approx(float(net.logs(code).sum())) and out[0]["pll_mean"] > -np.log(256) / 2
    assert lm.scored(docs_of([]), net).count() == 0 and isinstance(lm.fit(docs_of([])), lm.Network)


def test_network_gradient():
    """A step down the analytic gradient lowers the loss on its batch."""
    rng = np.random.default_rng(5)
    code = lm.packed(np.frombuffer(b"the cat sat on the mat and the dog sat too " * 20, np.uint8), np.array([0, 860]))
    kinds, count = np.unique(code, return_counts=True)
    net = lm.Network()
    before = (net.logs(kinds) * count).sum()
    for k in range(5):
        net.train(kinds, count.astype(float), seed=k)
    assert (net.logs(kinds) * count).sum() > before + 100 and rng is not None


# --- pipeline --------------------------------------------------------------------------------------------------------------------------------


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = Q.op10(spark, d).collect()
    dirty = {r["doc_id"] for r in Q.op4(spark, d).where("contaminated").collect()}
    first = {r["doc_id"] for r in groups if r["kept"]}
    assert set(out) <= first and {i for i in first - dirty if any(c.isalpha() for c in texts[i] or "")} <= set(out)
    assert all(r["lossless"] for r in out.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "piece_encoding"]
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, d)
        assert step.columns == docs.columns
