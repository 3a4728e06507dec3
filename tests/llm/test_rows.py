"""Operators that look at one row at a time."""

import hashlib
import random
import re

import numpy as np
import plain
import pyarrow as pa
import pytest

from sensorframe.llm.html_text import extract_text, main_text
from sensorframe.llm.licenses import TEMPLATES, patience, scan_licenses
from sensorframe.llm.linear import fit_logistic, fit_platt, minimise
from sensorframe.llm.pii import base_spans, find_spans, scrub
from sensorframe.llm.quality import SCALE, QualityModel, _features, _unpacked, _vectors, judge_quality, train_quality
from sensorframe.llm.tagger import KINDS, WINDOW, _gradients, char_classes, decode, labelled_text, trained_tagger
from sensorframe.llm.urls import judge_urls
from sensorframe.llm.words import Splitter, pieces

EDGES = [(1, None), (2, ""), (3, " \n \n "), (4, "one\none\none"), (5, "#é| <b>\n\n\n#é| <b>"), (6, "ab " * 20_000), (None, "x y z x y z"), (7, "x"), (7, "x"), (8, "a\r\nb\r\nb\r\n"), (9, "w" * 200_000)]


@pytest.fixture(scope="module")
def tagger():
    return trained_tagger()


def docs(spark, rows):
    return spark.createDataFrame([(d, t, 0.5, True) for d, t in rows], "doc_id long, text string, score double, spans boolean")


def test_quality_counts(spark):
    rng = random.Random(1)
    rows = EDGES + [(100 + i, "".join(rng.choice(["ab", "c", " ", "  ", "\n", "é", "#", "&", "\x0b"]) for _ in range(rng.randint(0, 120)))) for i in range(40)]
    model = QualityModel(np.zeros(1 << 16, np.float32), 1.0, 1.0, 0.0)
    got = judge_quality(docs(spark, rows), model).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key)
    assert have == sorted(((d, *plain.quality_counts(t)) for d, t in rows), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_quality_vectors_are_small_and_exact():
    rng = random.Random(5)
    texts = [t for _, t in EDGES] + ["".join(rng.choice("abcdefghij  ") for _ in range(n)) for n in (3, 300, 3000, 30_000)]
    entries = size = 0
    for row, to, data, offsets in pieces(pa.array(texts)):
        words = Splitter()(data, offsets)
        stored = _vectors(words)
        at, slot, value = _unpacked(stored)
        want = np.zeros((to - row, 1 << 16, 3))
        for kind, (found, first) in enumerate(_features(words)):
            for d in range(to - row):
                own = found[first[d] : first[d + 1]]
                want[d, :, kind] = SCALE * np.bincount(own, minlength=1 << 16) / max(len(own), 1)
        have = np.zeros((to - row, 1 << 16))
        np.add.at(have, (at, slot), value)
        assert np.allclose(have, want.sum(2), rtol=1e-12) and len(at) == np.count_nonzero(want)
        entries += len(at)
        size += stored.nbytes
    # Two bytes an entry, and what is fixed: every batch's offsets, sizes and few wide numbers.
    assert size < 3 * entries + 100 * len(texts)


def test_quality_learns_and_carries(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = [(i, " ".join(word() for _ in range(80)) + ".") for i in range(60)]
    bad = [(i, " ".join(word() + "!!" for _ in range(80))) for i in range(60, 120)]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (4, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = train_quality(docs(spark, good + bad), labels)
    frame = docs(spark, good + bad)
    got = judge_quality(frame, model, carry=True)
    assert got.columns[:4] == frame.columns
    assert {r.doc_id: r.kept for r in got.collect()} == {i: i < 60 for i in range(120)}
    none = train_quality(docs(spark, []), labels.where("false"))
    assert judge_quality(docs(spark, []), none).count() == 0 and judge_quality(frame, none).count() == 120


def test_quality_is_fitted_on_every_labelled_row(spark, monkeypatch):
    from sensorframe.llm import quality
    from sensorframe.llm.words import Splitter

    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(["ab", "cde", "é", "fgh!", "x" * 600]) for _ in range(rng.randint(0, 30)))) for i in range(3000)]
    texts += [(5000, "ab " * 70_000), (5001, ""), (5002, None)]
    label = {i: rng.randint(0, 1) for i, _ in texts}
    labels = spark.createDataFrame([(i, v, 0) for i, v in label.items()] + [(7, 1 - label[7], 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "minimise", lambda loss, at: seen.append(loss(at + 0.01)) or at)
    train_quality(docs(spark, texts), labels)

    ids = spark.createDataFrame([(i,) for i, t in texts if i != 7 and t is not None], "doc_id long")
    fitted = {r.doc_id for r in ids.where("pmod(xxhash64(doc_id, 'part'), 5) < 3").collect()}
    rows = [(t, label[i]) for i, t in texts if i in fitted]
    n = [sum(v == k for _, v in rows) for k in (0, 1)]
    assert min(n) > 800
    value, grad = 0.0, np.zeros((1 << 16) + 1)
    for t, v in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        x = np.zeros((1 << 16) + 1)
        for slot, _ in quality._features(Splitter()(data, np.array([0, len(data)]))):
            np.add.at(x, slot, quality.SCALE / max(len(slot), 1))
        x[-1] = 1
        z = 0.01 * x.sum()
        value += 0.5 / n[v] * (np.log1p(np.exp(z)) - v * z)
        grad += 0.5 / n[v] * (1 / (1 + np.exp(-z)) - v) * x
    at = np.append(np.full(1 << 16, 0.01), 0.0)
    assert np.isclose(seen[0][0], value + quality.RIDGE * (at @ at) / 2, rtol=1e-6)
    assert np.abs(seen[0][1] - grad - quality.RIDGE * at).max() < 1e-6


def test_minimise_reaches_the_optimum():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(400, 12)), rng.integers(0, 2, 400)

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + w @ w / 2, x.T @ (1 / (1 + np.exp(-z)) - y) + w

    at = minimise(loss, np.zeros(12), tolerance=1e-7)
    assert np.abs(loss(at)[1]).max() < 1e-4
    assert minimise(loss, at, most=1) is at


def test_logistic_and_platt():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    rows = [(np.array([int(v), 2 + int(rng.integers(0, 5))]), np.ones(2)) for v in y]
    weight, bias = fit_logistic(rows, y, 8)
    assert weight[1] > weight[0]
    score = rng.normal(size=400)
    label = (rng.random(400) < 1 / (1 + np.exp(-(2 * score - 1)))).astype(int)
    slope, offset = fit_platt(score, label)
    p = 1 / (1 + np.exp(-(slope * score + offset)))
    assert abs((p - label).mean()) < 0.02 and slope > 0
    assert fit_platt(score, np.ones(400)) == (1.0, 0.0)


def test_patience():
    assert patience(list("abcxdef"), list("abcydef")) == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (6, 6)]
    assert patience([], list("a")) == [] and patience(list("aa"), list("bb")) == []
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_licenses(spark):
    mit = TEMPLATES["MIT"]
    worn = mit.replace("free of charge, ", "").replace("sublicense", "relicense")
    rows = [*EDGES, (20, f"x y\n{mit}\nand {TEMPLATES['MIT notice']} again {TEMPLATES['MIT notice'].upper()}"), (21, worn), (22, "the license of the free software is the work to the public"), (20, TEMPLATES["MIT notice"])]
    got = [(r.doc_id, r.license, r.start_word, r.matched, round(r.coverage, 2)) for r in scan_licenses(docs(spark, rows)).collect()]
    n = len(re.findall(r"\w+", mit))
    assert (20, "MIT", 2, n, 1.0) in got and [g[0] for g in got].count(20) == 4
    assert [(g[0], g[1]) for g in got if g[0] == 21] == [(21, "MIT")] and all(g[4] > 0.9 for g in got if g[0] == 21)
    assert {g[0] for g in got} == {20, 21}
    assert scan_licenses(docs(spark, rows), {}).count() == 0


def test_personal_data_patterns():
    rng = random.Random(4)
    for _ in range(20_000):
        t = "".join(rng.choice("1234.@a-+ (%é5") for _ in range(rng.randint(0, 40)))
        assert base_spans(t) == plain.personal(t)
    assert base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    assert base_spans("1" * 200_000) == [] and base_spans("a" * 200_000 + "@") == []


def test_tagger_gradient(tagger):
    rng = np.random.default_rng(1)
    made = [labelled_text(rng, 12) for _ in range(3)]
    x, y = np.stack([char_classes(s) for s, _ in made]), np.stack([g for _, g in made])
    import copy

    model = copy.deepcopy(tagger)
    for name in ("gate", "recur", "out", "move", "first"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    _, grads = _gradients(model, x, y)
    for part, grad in zip(model.parts(), grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = part[at]
        losses = []
        for step in (1e-3, -1e-3):
            part[at] = old + step
            losses.append(_gradients(model, x, y)[0])
        part[at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - grad[at]) < 1e-3 + 0.05 * abs(grad[at])


def test_tagger_on_held_out_text(tagger):
    rng = np.random.default_rng(77)
    made = [labelled_text(rng, WINDOW) for _ in range(200)]
    tags = decode(tagger, np.stack([char_classes(s) for s, _ in made]))
    assert (tags == np.stack([g for _, g in made])).mean() > 0.97


def test_personal_data(spark, tagger):
    both = "call +1 (269) 555-3296 4524132264652876 and on " * 3  # the patterns drop both numbers
    rows = [*EDGES, (30, both), (31, "x" * 90 + " me.01@mail7.example.com, 10.20.30.40"), (32, "1" * 50_000), (33, 'token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" v 3.0')]
    got = {}
    for r in find_spans(docs(spark, rows), tagger).collect():
        base = [(s.kind, s.start, s.end) for s in r.spans if s.base]
        assert base == plain.personal(r.text)
        assert [s.kind for s in r.spans] == sorted((s.kind for s in r.spans), key=KINDS.index)
        got[r.doc_id] = [r.text[s.start : s.end] for s in r.spans]
    assert got[30] == ["4524132264652876"] * 3 + ["+1 (269) 555-3296"] * 3
    assert got[31] == ["me.01@mail7.example.com", "10.20.30.40"] and got[33] == got[32] == []
    clean = scrub(docs(spark, rows), tagger)
    assert clean.columns == ["doc_id", "text", "score", "spans"]
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[1] is None and text[2] == "" and text[31] == "x" * 90 + " <email>, <ip>"
    assert find_spans(docs(spark, []), tagger).count() == 0


def test_pii_query_counts_the_patterns_spans(spark, tagger, tmp_path):
    from sensorframe.llm.queries import QUERIES

    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("+0123456789 -().@ab") for _ in range(rng.randint(20, 90)))) for i in range(300)] + [(900, None), (901, "a@b.cd 1.2.3.4")]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op5_pii"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and any(len([s for s in r.spans.split(",") if s]) > r.n_email + r.n_ip + r.n_card + r.n_phone for r in got.values())
    for d, t in rows:
        base = base_spans(t or "")
        assert [got[d][f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in KINDS]
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def test_urls(spark):
    urls = [
        ("https://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
        ("http://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"),
        ("http://x.net/es/?q=://y", "x.net", "/es/", "net/es/", "block"),
        ("x://com", "com", "", None, None),
        ("http://x.net?/fr/", "x.net", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("http://é.org/ü\nü#z", "é.org", "/ü\nü", None, None),
        ("http://cheap-pills.example.org/en/77", "cheap-pills.example.org", "/en/77", None, "block"),
        ("http://lessons.example.org/en/77", "lessons.example.org", "/en/77", None, "allow"),
    ]
    frame = spark.createDataFrame([(i, u[0], 1, "v") for i, u in enumerate(urls)], "page_id long, url string, score int, verdict string")
    for r in judge_urls(frame).collect():
        _, host, path, rule, verdict = urls[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert judge_urls(frame.where("false")).count() == 0


def test_html(spark):
    long = "Text &amp; more&nbsp;text here. " * 12
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><header><h1>Site</h1></header>"
        f"<div id=cookie-banner>We use cookies</div><article><h1>Title</h1><p><b>{long}<br><p>Short.<ul><li>One<li>Two</ul>"
        f"<div class='comments'><p>{'bad comment ' * 30}</div></article><aside>{'aside ' * 50}</aside><form>Name <input></form><footer>&copy; me</footer>"
    )
    clean = " ".join("Text & more text here.".split() * 12)
    want = f"Title\n\n{clean}\n\nShort.\n\nOne\n\nTwo"
    rows = [(1, "u", page, 1), (1, "u", page, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", "<p>", 1), (None, "u", "plain", 1), (5, "u", "<article><p>" + "é " * 100_000, 1), (6, "u", "<script>x", 1)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 8 and text[1] == want and text[2] == text[3] == text[4] == text[6] == "" and text[None] == "plain" and len(text[5]) == 199_999
    assert main_text("<div>" * 3000 + "deep") == "deep"


LONG = "A long paragraph of the article, with enough words to count as content on any page at all. " * 2


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="content-sidebar-wrap"><article><p>{LONG}</p></article></div>', [LONG]),
        (f'<div class="page no-sidebar"><main><p>{LONG}</p></main></div>', [LONG]),
        (f'<article class="post has-comments"><p>{LONG}</p></article>', [LONG]),
        (f'<article><p>{LONG}</p><section id="related-work"><p>{LONG}</p></section><h2 id="cookies">Cookies</h2><p id="search">{LONG}</p></article>', [LONG, LONG, "Cookies", LONG]),
        (f'<div class="comments"><article><p>{LONG}</p></article></div><article><p>{LONG}x</p></article>', [LONG + "x"]),
        (f'<article><p>{LONG}</p><div id="comments"><p>{LONG}</p></div><div class="related-posts"><p>{LONG}</p></div></article>', [LONG]),
        (f"<div><a>Home</a></div><div><div>{LONG}</div><div>Short one.</div><div>{LONG}</div></div><div>Foot</div>", [LONG, "Short one.", LONG]),
        (f'<div class="sidebar"><p>{LONG}</p></div><div><p>{LONG}y</p></div>', [LONG + "y"]),
    ],
)
def test_articles_in_marked_elements(page, want):
    assert main_text(f"<html><body>{page}</body></html>") == "\n\n".join(w.strip() for w in want)
