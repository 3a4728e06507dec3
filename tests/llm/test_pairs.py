"""Near duplicates and repeated passages against plain loops."""

import random

import plain
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import ngram_join, substring
from sensorframe.llm.graph import components
from sensorframe.llm.ngram_join import jaccard_components
from sensorframe.llm.substring import drop_repeats

SCHEMA = "doc_id long, text string, n int, shingle string, key long, comp long"


def table(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in rows], SCHEMA)


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("aeiou") * rng.randint(1, 3)
    passage = " ".join(word() for _ in range(30))
    rows = []
    for d in range(n):
        kind = rng.random()
        if kind < 0.35 and rows:
            w = plain.words(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = word()
            text = rng.choice([" ", "\n", " \t"]).join(w)
        elif kind < 0.5:
            text = " ".join(word() for _ in range(20)) + " " + passage + "\n" + " ".join(word() for _ in range(20))
        else:
            text = " ".join(word() for _ in range(rng.choice([0, 1, 3, 4, 5, 13, 14, 60, 200])))
        rows.append((d * 3 - 7, text))
    return rows


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, "One two"), (7, "one two"), (8, "é " * 40), (9, "e " * 40), (10, "w" * 300_000), (11, "a b c d e"), (12, "A B C D E")]


@pytest.mark.parametrize("rows", [made(1), made(2), EDGES, []], ids=["random 1", "random 2", "edges", "empty"])
def test_groups(spark, rows):
    got = jaccard_components(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain.groups(rows)


def test_groups_of_many_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 4)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    got = jaccard_components(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain.groups(rows)


def test_rows_that_repeat(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (3, text), (5, "other words entirely here now"), (9, "Other words entirely here now"), (None, text)]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(table(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (3, 3), (5, 3), (9, 3), (None, 3)], key=str)


def test_components_of_a_long_chain(spark):
    n = 70
    edges = spark.range(n).select((F.col("id") * 11 % n).alias("a"), ((F.col("id") + 1) * 11 % n).alias("b")).where("a <> 0")
    found = {r.node: r.component for r in components(edges.union(spark.createDataFrame([(500, 501), (501, 500), (7, 7)], "a long, b long"))).collect()}
    assert {found[i] for i in range(n)} == {0} and found[501] == 500


@pytest.mark.parametrize("rows", [made(4, 90), made(5, 90), EDGES, []], ids=["random 1", "random 2", "edges", "empty"])
def test_repeats(spark, rows, monkeypatch):
    monkeypatch.setattr(substring, "GROUP_BYTES", 2000)  # several groups and buckets
    got = drop_repeats(table(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256)).collect()
    assert sorted(map(tuple, got)) == sorted(plain.without_repeats(rows))


def test_repeats_of_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(2, text), (2, text), (1, "a " + text), (None, text), (2, "b " + text)]
    got = drop_repeats(table(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain.without_repeats(rows), key=str)


def test_groups_of_long_texts(spark, monkeypatch):
    """Large sets also pass the wide bitmaps, of equal and of different width."""
    monkeypatch.setattr(ngram_join, "WIDE_FROM", 100)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(250)]
    rows = []
    for d in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w + [f"t{i}" for i in range(rng.choice([0, 0, 10, 40]))])))
    got = jaccard_components(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain.groups(rows)


def near_copies(*ends):
    """Texts of 41 words: 40 by name and one at the end, so that those of one name are near copies."""
    return [(d, " ".join([f"{name}{i}" for i in range(40)] + [end])) for d, name, end in ends]


@pytest.mark.parametrize("large", [64, 1])
def test_near_copies_with_every_row_doubled(spark, monkeypatch, large):
    """Repeated rows leave no trace in the marks by which shingles with equal members are told."""
    monkeypatch.setattr(ngram_join, "LARGE", large)
    rows = near_copies((1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, "b", "y"), (5, "c", "x"), (6, "c", "y"))
    got = jaccard_components(table(spark, rows * 2)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain.groups(rows * 2)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}


def test_near_copies_of_an_id_with_several_texts(spark):
    """Documents 8 and 9 each have two near copies of a text of document 1: none cancels the other in the marks."""
    rows = near_copies((1, "a", "x"), (9, "a", "y"), (9, "a", "z"), (1, "b", "x"), (8, "b", "y"), (8, "b", "z"))
    got = jaccard_components(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain.groups(rows)
