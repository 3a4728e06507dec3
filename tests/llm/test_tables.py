"""Mixing, packing, neighbours, the registered queries and the pipeline."""

import math
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import plain
import public_tokenizers
import pytest
from compare import mismatch
from conftest import SF_DIR
from tokenizers import Tokenizer

import corpus_pipeline
from sensorframe.llm.mixing import find_temperature, mix_sources
from sensorframe.llm.neighbours import nearest
from sensorframe.llm.packing import Packer, pack
from sensorframe.llm.queries import ORACLE_SQL, QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert mismatch(QUERIES[name](spark, SF_DIR), con, ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_whole_tables(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def sources(spark, sizes, **more):
    rows = [(f"{s}{i}", "w " * n, s, 7, "z") for s, (count, n) in sizes.items() for i in range(count)]
    return spark.createDataFrame(rows, "doc_id string, text string, source string, quota int, s string")


def exponent(shares, good):
    """Bisection in plain Python: the least exponent that is good."""
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        w = [p**mid for p in shares]
        lo, hi = (lo, mid) if good([x / sum(w) for x in w]) else (mid, hi)
    return hi


def test_temperature(spark):
    tokens = [800, 150, 50]
    shares = [t / 1000 for t in tokens]
    frame = spark.createDataFrame([(p,) for p in shares], "share double")
    got = find_temperature(frame, 1000.0, 1000.0, None, 2.0)
    assert abs(got.exponent - exponent(shares, lambda w: max(x / p for x, p in zip(w, shares)) <= 2)) < 1e-9 and got.repeats <= 2
    entropy = lambda w: -sum(x * math.log(x) for x in w)
    got = find_temperature(frame, 1000.0, 1000.0, 0.9, None)
    assert abs(got.exponent - exponent(shares, lambda w: entropy(w) <= 0.9)) < 1e-9 and abs(got.entropy - 0.9) < 1e-6
    assert find_temperature(frame, 1000.0, 1000.0, 0.1, None).exponent == 1.0
    assert find_temperature(frame, 1000.0, 1000.0, 5.0, None).exponent == 0.0


def test_mix(spark):
    frame = sources(spark, {"a": (3000, 4), "b": (300, 7), "c": (40, 1), None: (5, 30), "e": (3, 0)})
    mixed = mix_sources(frame, budget="total", most_repeats=2.0)
    assert mixed.columns == [*frame.columns, "mix_epoch", "mix_block", "mix_place"]
    rows = mixed.collect()
    have = {"a": 12000, "b": 2100, "c": 40, None: 150}
    total = sum(have.values())
    shares = {s: n / total for s, n in have.items()}
    t = exponent(list(shares.values()), lambda w: max(x / p for x, p in zip(w, shares.values())) <= 2)
    z = sum(p**t for p in shares.values())
    drawn = Counter()
    for r in rows:
        drawn[r.source] += len(plain.words(r.text))
    size = {"a": 4, "b": 7, "c": 1, None: 30}
    for s, p in shares.items():
        assert 0 <= drawn[s] - round(total * p**t / z) < size[s]
    assert "e" not in {r.source for r in rows}
    seen = Counter((r.doc_id, r.mix_epoch) for r in rows)
    assert max(seen.values()) == 1 and all(0 <= r.mix_place <= 1 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(frame.repartition(5), budget="total", most_repeats=2.0).collect()))


def test_mix_keeps_every_document(spark):
    frame = sources(spark, {"a": (500, 3), "b": (20, 5), "c": (1, 2)})
    rows = mix_sources(frame, budget=None, most_repeats=1.5).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in frame.collect()}
    words = Counter()
    for r in rows:
        words[r.source] += len(plain.words(r.text))
    assert words["a"] == 1500 and 100 <= words["b"] <= 155 and words["c"] >= 2
    assert mix_sources(frame.where("false")).count() == 0
    assert mix_sources(sources(spark, {"e": (3, 0)})).count() == 0


def check_pieces(docs, pieces, size):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for d, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want[(d, len(ids), zlib.crc32(array("I", ids).tobytes()))] += 1
    by_doc, by_sequence, padding = defaultdict(list), defaultdict(list), 0
    for r in pieces:
        assert len(r.ids) == 4 * r.length
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    have = Counter()
    for (d, n), rows in by_doc.items():
        rows.sort(key=lambda r: r.start)
        parts = defaultdict(list)
        if sum(r.length for r in rows) == n:
            assert [r.start for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
            parts[0] = rows
        else:  # rows that repeat
            for r in rows:
                assert r.length == n
                parts[len(parts)] = [r]
        for p in parts.values():
            have[(d, n, zlib.crc32(b"".join(bytes(r.ids) for r in p)))] += 1
    assert have == want
    for spans in by_sequence.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]
        fill = sum(n for _, n in spans)
        assert 0 < fill <= size
        padding += size - fill if fill & (fill - 1) else 0
    return padding


def test_pack(spark):
    rows = [(1, None), (2, ""), (3, "don't it's WE'LL. x.y,z 12,5 —foo <|endoftext|> Abc <|ENDOFTEXT|>"), (4, "A\u0301 J\u030c ΑΣ İ éü### Ñé!! " * 50), (5, "word " * 3000), (None, "x"), (7, "a b"), (7, "a b"), (8, "w" * 5000)]
    rows += [(100 + i, " ".join(f"tok{j}" for j in range(i % 37))) for i in range(200)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, length int")
    for size, most in ((64, 4096), (64, 3), (2048, 4096)):
        assert check_pieces(rows, pack(frame, TOKENIZER, size=size, max_open=most).collect(), size) == 0
    assert pack(frame.where("false"), TOKENIZER).count() == 0


def test_sum_of_squares_choice():
    rng = np.random.default_rng(0)
    packer = Packer(32, 10**6, 0)
    for n in rng.integers(1, 32, 400):
        level = packer.level.copy()

        def cost(fill):
            after = level.copy()
            if fill:
                after[fill] -= 1
            if fill + n < 32:
                after[fill + n] += 1
            return int((after[1:32] ** 2).sum())

        fits = [0] + [f for f in range(1, 33 - n) if level[f]]
        assert cost(packer._best(int(n))) == min(map(cost, fits))
        packer.add(0, b"\0\0\0\0" * int(n))


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(60)]
    odd = [(None, [1.0] * 8), (2000, None), (2001, []), (2002, [0.0] * 8), (2003, [None] + [1.0] * 7), (2004, [float("nan")] * 8), (2005, [float("inf")] * 8), (2020, [1.0, 2.0]), (3, x[3].tolist())]
    frame = spark.createDataFrame([(i, v, 1, "b") for i, v in rows + odd], "vec_id long, embedding array<double>, rank int, bucket string")
    got = defaultdict(list)
    for r in nearest(frame, "vec_id % 20 = 0", probes=300).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = wanted = 0
    for q, v in rows:
        if q % 20:
            continue
        score = {i: float(np.dot(v, w)) for i, w in rows if i != q}
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:20]
        have = sorted(got[q])
        assert [r for r, _, _ in have] == list(range(1, 21)) and all(abs(score[i] - s) < 1e-9 for _, i, s in have)
        hits += len(set(best) & {i for _, i, _ in have})
        wanted += 20
    assert hits / wanted > 0.97 and 2020 not in got
    assert nearest(frame.where("false"), "vec_id % 20 = 0").count() == 0


def test_pipeline_against_plain_loops(spark, monkeypatch):
    """Every stage on what its predecessor kept, and the whole run in the same shape."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    raw = {r.doc_id: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["quality"](spark, docs, SF_DIR).cache()
    assert kept.columns == docs.columns
    good = {r.doc_id: r for r in kept.collect()}
    assert all(good[d] == raw[d] for d in good)
    for d, r in raw.items():
        n, _, _, _, repeat = plain.quality_counts(r.text)
        assert d not in good or not (n < 50 or 100 * repeat > 50 * n)

    one = stage["near_duplicates"](spark, kept, SF_DIR).cache()
    want = {c for _, _, c in plain.groups([(d, r.text) for d, r in good.items()])}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == want

    clean = stage["pii"](spark, one, SF_DIR).cache()
    assert clean.columns == docs.columns and clean.count() == one.count()
    for r in clean.collect():
        assert plain.personal(r.text) == [] and r.n_chars == len(r.text)
        assert plain.personal(good[r.doc_id].text) or r.text == good[r.doc_id].text or "<" in r.text

    mixed = stage["mixing"](spark, clean, SF_DIR).cache()
    assert mixed.columns == docs.columns and set(mixed.toPandas().doc_id) == want
    rows = [(r.doc_id, r.text) for r in mixed.collect()]
    total = sum(len(Tokenizer.from_file(TOKENIZER).encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    packed = stage["packing"](spark, mixed, SF_DIR).collect()
    assert sum(r.length for r in packed) == total and {r.doc_id for r in packed} == want
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert sum(r.length for r in whole.collect()) == total


def test_near_duplicates_keep_documents_without_id_or_with_a_repeated_one(spark):
    """Of each group of texts one row stays, whatever the ids; the same rows in another order give the same result."""
    text = lambda name, end="x": " ".join([f"{name}{i}" for i in range(40)] + [end])
    rows = [(None, text("a")), (None, text("b")), (None, text("b", "y")), (None, text("c")), (4, text("c", "y")), (4, text("d")), (4, text("e")), (2, text("e", "y")), (4, text("d")), (1, text("f")), (3, text("f", "y"))]
    near = corpus_pipeline.near_duplicates

    def kept(rows):
        docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return Counter((r.doc_id, r.text) for r in near(spark, docs, SF_DIR).collect())

    got = kept(rows)
    assert got == kept(rows[::-1])
    either = [(None, text("b")), (None, text("b", "y"))]
    assert sum(got[r] for r in either) == 1
    assert got - Counter(either) == Counter([(None, text("a")), (4, text("c", "y")), (4, text("d")), (2, text("e", "y")), (1, text("f"))])


@pytest.mark.parametrize("norms", ["equal", "one of 5", "one of 100", "uneven"])
def test_neighbours_with_production_settings(spark, norms, monkeypatch):
    """Recall against brute force over weak clusters, and no query that returns short, in several chunks and parts."""
    monkeypatch.setattr("sensorframe.llm.neighbours.CHUNK", 20)
    rng = np.random.default_rng(7)
    x = 0.5 * rng.normal(size=(40, 64))[rng.integers(0, 40, 1000)] + rng.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "uneven":
        x *= np.exp(0.8 * rng.normal(size=(1000, 1)))
    elif norms != "equal":
        x[501] *= int(norms.split()[-1])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nearest(frame, "vec_id % 20 = 0").collect():
        got[r.query_id].add(r.vec_id)
    assert len(got) == 50 and {len(v) for v in got.values()} == {20}
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(found & set(np.argsort(-score)[:20].tolist()))
    assert hits / 1000 >= 0.9


def test_neighbours_of_queries_that_meet_few(spark):
    """One probe of many cells meets next to nothing: such queries still have the best 20."""
    x = np.random.default_rng(8).normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest(frame, "vec_id % 100 = 0", tables=1, hashes=8, probes=1, width=0.1).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 600, 100):
        score = x @ x[q]
        score[q] = -np.inf
        assert got[q] == np.argsort(-score)[:20].tolist()
