"""Runs of words, the Merkle manifest and repeated bytes, against plain loops."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import suffixes
from sensorframe.llm.kept import kept
from sensorframe.llm.manifest import BLOCK, build_manifest, digest, field, fold, proof_digest
from sensorframe.llm.packing import word_ids
from sensorframe.llm.queries import plant
from sensorframe.llm.runs import Positions, periodic_runs, seeds
from sensorframe.llm.suffixes import cuts, drop_repeated_bytes
from sensorframe.llm.words import Splitter

SCHEMA = "doc_id long, text string, runs int, g string, n long, row long"


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in rows], SCHEMA)


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def plain_runs(w, shortest=6, times=4):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(shortest, times * q):
                s = w[i : i + n]
                if not any(all(s[k] == s[k + p] for k in range(n - p)) for p in range(1, q)):
                    out.append((i, n, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_loops():
    rng = random.Random(1)
    for _ in range(800):
        shortest, times = rng.choice([(6, 4), (6, 4), (2, 2), (5, 3), (10, 2)])
        docs, ids, begins, used = [], [0], [], 1
        for _ in range(rng.randint(1, 3)):
            w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 40))]
            if w and rng.random() < 0.5:
                w = w[: rng.randint(0, 5)] + w[: rng.randint(1, len(w))] * rng.randint(2, 6) + w[:3]
            known = {}
            begins.append(len(ids))
            ids += [known.setdefault(x, used + len(known)) for x in w]
            used += len(known)
            ids.append(used)
            used += 1
            docs.append(w)
        want = [(s + b, n, q) for b, w in zip(begins, docs) for s, n, q in plain_runs(w, shortest, times)]
        assert sorted(seeds(np.array(ids), shortest, times)) == sorted(want)


def test_ordered_positions():
    rng = random.Random(2)
    order = rng.sample(range(5000), 3000)
    own, seen = Positions(order[0]), {order[0]}
    for x in order[1:]:
        got = own.put(x)
        assert got == (max((y for y in seen if y < x), default=-1), min((y for y in seen if y > x), default=-1))
        seen.add(x)
    assert list(own) == sorted(order)


def test_runs_of_documents(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b " * 30), (4, "a b " * 30), (None, "x " * 7), (5, "w " * 50_000), (6, "é ß " * 9 + "end"), (7, "a" * 100_000), (8, "a b c d")]
    got = periodic_runs(table(spark, rows)).collect()
    want = []
    for d, t in rows:
        w = (t or "").split()
        runs = [(0, len(w), 1)] if d == 5 else plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((d, len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted_rows([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]) == sorted_rows(want)
    assert periodic_runs(table(spark, [])).count() == 0
    assert plant(None, [b"a"]) == [b"a"] and plant(3, []) == []


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof) by building every level in a list."""

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            out += [x for j, x in enumerate(level[i // 3 * 3 : i // 3 * 3 + 3]) if j != i % 3]
            i //= 3
        return out

    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], h(*map(f, r))))
    trees = {}
    for g in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = own, grow([leaf for _, leaf in own])
    top = grow([levels[-1][0] for _, levels in trees.values()])
    out = []
    for place, (own, levels) in enumerate(trees.values()):
        for i, (d, leaf) in enumerate(own):
            out.append((d, leaf, levels[-1][0], top[-1][0], h(*siblings(levels, i), *siblings(top, place))))
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, None: 4, "": 1}, {"a": 10, "b": 1, "é": 28, "Z": 2}, {"hot": BLOCK * 3 + 5, "a": BLOCK, "b": 2}, {f"s{i}": 1 for i in range(30)}])
def test_manifest_against_lists(spark, sizes):
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.02 else rng.randrange(4 * n), s, rng.choice(["x", None, "a\nb", "ü" * 30])) for s, n in sizes.items() for _ in range(n)]
    rows += rows[:2]
    frame = spark.createDataFrame([(*r, 1, "path", "n") for r in rows], "doc_id long, source string, text string, h int, node string, i string")
    leaf = digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("text")))
    got = build_manifest(frame, leaf, F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "path_": F.col("h")})
    got = got.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof"), fold(F.col("leaf"), F.col("path")).alias("folded"))
    found = got.collect()
    assert all(r.folded == r.root for r in found)
    assert sorted_rows([tuple(r)[:5] for r in found]) == sorted_rows(plain_manifest(rows))


def test_manifest_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, source string")
    assert build_manifest(frame, digest(field(F.col("doc_id"))), F.col("source"), F.col("doc_id")).count() == 0


def plain_bytes(docs, k=400):
    starts = {}
    for i, (_, t) in enumerate(docs):
        b = (t or "").encode()
        for at in range(len(b) - k + 1):
            starts.setdefault(b[at : at + k], []).append((i, at))
    gone = [np.zeros(len((t or "").encode()) + 1, int) for _, t in docs]
    for places in starts.values():
        if len(places) > 1:
            for i, at in places:
                gone[i][at] += 1
                gone[i][at + k if at + k < len(gone[i]) else -1] -= 1
    out = []
    for (d, t), edge in zip(docs, gone):
        b = (t or "").encode()
        cover = np.cumsum(edge[:-1]) > 0
        kept = bytes(x for x, c in zip(b, cover) if not c)
        n_spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out.append((d, len(b), int(cover.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def made_texts(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefghij éß\n") for _ in range(n))
    passages = [text(n) for n in (399, 400, 401, 520, 900, 2500)]
    docs = [(1, None), (2, ""), (3, "short"), (None, text(700))]
    for d in range(4, 30):
        parts = [text(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randint(0, len(p) // 2)])
            parts += [p[a : rng.choice([len(p), len(p), rng.randint(a, len(p))])], text(rng.randint(0, 200))]
        docs.append((d, "".join(parts)))
    docs += [docs[10], docs[10], (10, text(1000)), (None, docs[12][1])]
    docs += [(40, "ab" * 700), (41, "a" * 1200), (42, text(90) * 14), (43, "x" + "ab" * 300 + "y")]
    near = list(docs[20][1] * 2 + text(3000))
    for at in rng.sample(range(len(near)), 6):
        near[at] = "#"
    return docs + [(44, docs[20][1] * 2), (45, "".join(near))]


@pytest.mark.parametrize("seed", [5, 6])
def test_repeated_bytes_against_loops(spark, seed):
    docs = made_texts(seed)
    got = drop_repeated_bytes(table(spark, docs).repartition(3)).collect()
    assert sorted_rows([(r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), r.kept_sha256) for r in got]) == sorted_rows(plain_bytes(docs))


def test_repeated_bytes_in_stretches(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdef ") for _ in range(6000))
    docs = [(1, long), (2, long[1000:2200] + "#" + long[4000:4500]), (3, "")]
    monkeypatch.setattr(suffixes, "STRETCH", 700)
    got = drop_repeated_bytes(table(spark, docs)).collect()
    assert sorted_rows([(r.doc_id, r.n_bytes, sum(s.length for s in r.spans), len(r.spans), r.kept_sha256) for r in got]) == sorted_rows(plain_bytes(docs))
    assert drop_repeated_bytes(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        drop_repeated_bytes(table(spark, docs), length=100)


def test_cuts_depend_on_what_is_near():
    rng = np.random.default_rng(4)
    shared = rng.integers(97, 123, 1000).astype(np.uint8)
    one = np.concatenate((rng.integers(97, 123, 333).astype(np.uint8), shared, rng.integers(97, 123, 50).astype(np.uint8)))
    two = np.concatenate((rng.integers(97, 123, 71).astype(np.uint8), shared, rng.integers(97, 123, 400).astype(np.uint8)))
    reach = len(shared) - 2 * suffixes.SPACING - suffixes.GRAM
    a, b = (sorted(c - s for c in cuts(x) if 0 <= c - s <= reach) for x, s in ((one, 333), (two, 71)))
    assert a == b and len(a) > 10 and max(np.diff(a)) <= suffixes.SPACING


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_long_words_that_polynomials_confuse(spark):
    from sensorframe.llm.ngram_join import jaccard_components
    from sensorframe.llm.substring import drop_repeats
    from sensorframe.llm.words import Splitter

    one, two = thue_morse(1024, 0), thue_morse(1024, 1)
    raw = np.frombuffer(f"{one} {two} {one.upper()}".encode(), np.uint8)
    found = Splitter(lower=True)(raw, np.array([0, len(raw)])).hash
    assert found[0] == found[2] != found[1]
    words = [f"w{i}" for i in range(12)]
    docs = [(1, " ".join([*words, one])), (2, " ".join([*words, two])), (3, " ".join([*words, one]))]
    removed = {r.doc_id: r.n_removed for r in drop_repeats(table(spark, docs)).collect()}
    assert removed == {1: 0, 2: 0, 3: 13}
    short = [(1, f"a b c d {one}"), (2, f"a b c d {two}"), (3, f"a b c d {one}")]
    assert {r.doc_id: r.component_id for r in jaccard_components(table(spark, short)).collect()} == {1: 1, 2: 2, 3: 1}


def test_cached_words_go_when_another_operator_begins():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = word_ids(path)
    assert word_ids(path) is words
    kept(("splitter",), Splitter)
    assert word_ids(path) is not words
