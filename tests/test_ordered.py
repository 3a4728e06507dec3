"""Tiled scans, lookups, dense ids and quantiles against plain loops, hot keys included."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sensorframe.operators import ordered as o
from sensorframe.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds two thirds of the rows; some values are null."""
    rnd = random.Random(7)
    data = []
    for i in range(900):
        key = "hot" if rnd.random() < 0.66 else f"k{rnd.randrange(5)}"
        data.append((key, i, rnd.choice([None, *range(20)])))
    return data, spark.createDataFrame(data, "k string, i long, v long")


@pytest.mark.parametrize("tile", [1, 7, 64, 10_000])
def test_scan_equals_loop_for_any_tile(hot, tile):
    data, df = hot
    v = F.col("v")
    got = o.ordered_scan(
        df,
        ["k"],
        ["i"],
        o.row_tile("i", tile),
        {
            "prev": o.previous(v),
            "nxt": o.following(v),
            "lastv": o.last_valid(v),
            "nextv": o.next_valid(v),
            "total": o.running_sum(v),
            "top": o.running_max(v),
            "pos": o.row_position(),
            "all": o.group_total(v),
            "first": o.group_first(v),
        },
    )
    want = []
    for key in {r[0] for r in data}:
        vs = [(r[1], r[2]) for r in data if r[0] == key]
        for n, (i, x) in enumerate(vs):
            past = [y for _, y in vs[: n + 1] if y is not None]
            ahead = [y for _, y in vs[n:] if y is not None]
            known = [y for _, y in vs if y is not None]
            want.append(
                (
                    key,
                    i,
                    x,
                    vs[n - 1][1] if n else None,
                    vs[n + 1][1] if n + 1 < len(vs) else None,
                    past[-1] if past else None,
                    ahead[0] if ahead else None,
                    sum(past),
                    max(past) if past else None,
                    n + 1,
                    sum(known),
                    known[0],
                )
            )
    assert rows(got) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_scan_with_measured_tiles(spark, hot):
    data, df = hot
    tiled = o.with_value_tile(df, "i", 16)
    got = o.ordered_scan(tiled, ["k"], ["i"], "_tile", {"pos": o.row_position()})
    want = [(k, i, v, sum(1 for r in data if r[0] == k and r[1] <= i)) for k, i, v in data]
    assert sorted(rows(got), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])


def test_scan_plan_has_no_window_over_whole_groups(hot):
    """Every window over rows is partitioned by the tile as well."""
    _, df = hot
    plan = o.ordered_scan(df, ["k"], ["i"], o.row_tile("i", 64), {"p": o.previous(F.col("v"))})
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    over_rows = [x for x in text.splitlines() if "Window [" in x and "_l_p" in x and "_c_p" not in x]
    assert over_rows and all("_tile" in x for x in over_rows)


def test_lookup_join_keeps_every_row_with_hot_key_and_copies(spark):
    big = spark.createDataFrame([("a", 1)] * 500 + [("b", 2)] * 3 + [("z", 3)], "k string, x long")
    small = spark.createDataFrame([("a", 10), ("b", 20)], "k string, f long")
    for salt in ([], ["x"]):
        assert o.lookup_join(big, small, ["k"], salt_on=salt).count() == 503
        left = o.lookup_join(big, small, ["k"], "left", salt_on=salt)
        assert left.count() == 504 and left.where("f IS NULL").count() == 1


def test_dense_ids_are_consecutive_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(9)
    got = o.dense_ids(df, ["x"], "n").collect()
    assert sorted((r["x"], r["n"]) for r in got) == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_quantiles_match_numpy(spark, p):
    rnd = np.random.default_rng(3)
    groups = {"a": rnd.normal(size=501), "b": np.repeat([1.0, 2.0, 2.0, 9.0], 5), "c": np.array([-4.5])}
    data = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "x", {"q": p}).collect()}
    for g, xs in groups.items():
        assert got[g] == pytest.approx(np.percentile(xs, 100 * p), abs=1e-12)


def test_ratio_tile_never_decreases(spark):
    xs = sorted({float(x) for x in np.concatenate([np.geomspace(1e-9, 1e9, 500), -np.geomspace(1e-9, 1e9, 500), [0.0]])})
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", o.ratio_tile("x").alias("t"))
    tiles = [r["t"] for r in sorted(df.collect())]
    assert tiles == sorted(tiles)
