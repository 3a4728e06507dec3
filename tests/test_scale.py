"""Probes for all folds at once, runs in one scan, refined quantiles, panes, keyed resampling."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.operators import calibrate, folds, models, probes, windows
from sensorframe.operators import quantiles as qt
from sensorframe.operators.align import resample, target_grid
from sensorframe.operators.ordered import row_tile
from sensorframe.operators.quantiles import exact_quantiles
from sensorframe.operators.segments import mark_runs
from sensorframe.operators.shape import explode_range
from sensorframe.operators.vectors import robust_scale


def vectors(spark, n=240, d=5, n_folds=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 5, 0.1, 2, 1] + [0, 10, 0, -3, 1]
    y = (x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=n) > -2).astype(int)
    rows = [(k, ("train", "train", "val", "test")[(i + k) % 4], i, int(y[i]), [float(v) for v in x[i]]) for k in range(1, n_folds + 1) for i in range(n)]
    return spark.createDataFrame(rows, "fold_id long, split string, id long, y long, x array<double>")


def plain_fit(x, y, penalty):
    """Newton's method on one model."""
    z = np.c_[(x - x.mean(0)) / x.std(0), np.ones(len(y))]
    w = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    pull = penalty * np.r_[np.ones(x.shape[1]), 0]
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z.T * (w * p * (1 - p) / w.sum())) @ z + np.diag(pull), z.T @ (w * (p - y)) / w.sum() + pull * beta)
    return beta


def test_linear_fits_of_all_folds_and_penalties(spark):
    df = vectors(spark)
    train = df.where("split = 'train'")
    grid = [0.01, 0.3, 2.0]
    fits = probes.fit_linear(train, grid, "x", "y")
    assert fits.converged.all() and fits.steps <= 12
    for i, k in enumerate(fits.facts.folds):
        own = train.where(F.col("fold_id") == k).toPandas()
        x, y = np.array(own["x"].tolist()), own["y"].to_numpy()
        for g, penalty in enumerate(grid):
            want = plain_fit(x, y, penalty)
            assert np.allclose(np.r_[fits.weight[i, g], fits.intercept[i, g]], want, atol=1e-7)


def test_jobs_do_not_grow_with_folds_and_grid(spark):
    sc = spark.sparkContext

    def jobs(n_folds, grid):
        train = vectors(spark, n_folds=n_folds).where("split = 'train'")
        sc.setJobGroup(f"probe-{n_folds}-{len(grid)}", "probe")
        fits = probes.fit_linear(train, grid, "x", "y", most_steps=4, tolerance=0.0)
        found = len(sc.statusTracker().getJobIdsForGroup(f"probe-{n_folds}-{len(grid)}"))
        sc.setJobGroup("", "")
        return found, fits.steps

    assert jobs(2, [0.1]) == jobs(6, [0.01, 0.1, 1.0, 2.0])


def test_separable_and_single_class_folds(spark):
    rows = [(1, "train", i, int(i > 9), [float(i), 0.0]) for i in range(20)] + [(2, "train", i, 1, [float(i), 1.0]) for i in range(5)]
    rows += [(1, "val", 50, 1, [30.0, 0.0]), (1, "test", 51, 0, [-5.0, 0.0]), (2, "test", 52, 1, [2.0, 1.0]), (1, "train", 99, None, [1.0, 1.0]), (1, "train", 98, 1, None)]
    df = spark.createDataFrame(rows, "fold_id long, split string, id long, y long, x array<double>")
    got = {r["id"]: r["score"] for r in models.linear_probe(df, [1, 2], "x", "y").where("id > 40 and x is not null").collect()}
    assert got[50] > 0.99 and got[51] < 0.01 and got[52] > 0.5


def test_search_takes_the_best_point(spark):
    df = vectors(spark, seed=3)
    grid = [{"reg": r} for r in (0.01, 100.0)]
    best, scored = models.search_then_evaluate(df, [1, 2, 3], "x", "y", grid)
    alone = models.linear_probe(df, [1, 2, 3], "x", "y", reg=best["reg"])
    a, b = ({(r["fold_id"], r["id"]): r["score"] for r in s.collect()} for s in (scored, alone))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-7


def test_networks_learn_what_lines_cannot(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, size=(400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    rows = [(k, "train" if i % 2 else "test", i, int(y[i]), [float(v) for v in x[i]]) for k in (1, 2) for i in range(400)]
    df = spark.createDataFrame(rows, "fold_id long, split string, id long, y long, x array<double>")
    got = models.mlp_probe(df, [1, 2], "x", "y", "id", iterations=80).where("split = 'test'").collect()
    assert len(got) == 400 and np.mean([(r["score"] > 0.5) == (r["y"] == 1) for r in got]) > 0.85


def test_resample_inside_groups(spark):
    rows = [(k, i, int(i < 5)) for k in (1, 2) for i in range(100 * k)] + [(3, 7, 1), (3, 8, None)]
    df = spark.createDataFrame(rows, "fold_id long, id long, y long")
    got = folds.balanced_resample(df, "id", "y", keys=["fold_id"]).collect()
    for k in (1, 2):
        own = [r["y"] for r in got if r["fold_id"] == k]
        assert len(own) == 100 * k and 0.3 < np.mean(own) < 0.7
    assert sorted((r["draw_id"], r["id"]) for r in got if r["fold_id"] == 3) == [(7, 7), (8, 7)]


def test_platt_state_stored_or_broadcast(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"g{g}", int(rng.random() < s), s) for g in range(4) for s in [rng.random() for _ in range(60)]] + [("one", 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, y long, s double")
    few = {r["g"]: r for r in calibrate.platt_fit(df, ["g"], "y", "s").collect()}
    monkeypatch.setattr(calibrate, "BROADCAST_GROUPS", 0)
    many = {r["g"]: r for r in calibrate.platt_fit(df, ["g"], "y", "s").collect()}
    assert few.keys() == many.keys() and few["one"]["status"] == "skipped_val_single_class"
    for g in ("g0", "g1", "g2", "g3"):
        assert few[g]["status"] == many[g]["status"] == "ok" and abs(few[g]["platt_coef"] - many[g]["platt_coef"]) < 1e-9


def test_runs_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(f"s{k}", i * 3 + k, rng.choice(["a", "a", "a", "b", None, ""])) for k in range(3) for i in range(rng.choice([1, 50, 90]))]
    rows += [("long", i, "a") for i in range(60)] + [(None, 1, "a"), ("null", None, "a")]
    df = spark.createDataFrame(rows, "s string, i long, label string")
    got = {(r["s"], r["i"]): (r["pos"], r["run_start"]) for r in mark_runs(df, ["s"], "i", "label", row_tile("i", 7)).collect()}
    want = {}
    for s in ("s0", "s1", "s2", "long"):
        start, last = 0, object()
        for pos, (_, i, label) in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: r[1]), 1):
            if (label or "") != last:
                start, last = pos, label or ""
            want[s, i] = (pos, start)
    assert got == want


def test_runs_take_three_exchanges(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("s"), F.col("id").alias("i"), (F.col("id") % 7).cast("string").alias("label"))
    marked = mark_runs(df, ["s"], "i", "label", row_tile("i", 100))
    assert marked.where("run_start > 0").count() == 5000
    marked.collect()
    final = marked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count(" Exchange ") - final.count("ReusedExchange") <= 3


def test_quantiles_of_a_narrow_band(spark, monkeypatch):
    n = 1_000_000
    df = spark.range(n).select(F.lit("g").alias("g"), (1.0 + F.pmod(F.col("id") * 7919, F.lit(n)) * 1e-8).alias("v"))
    seen = []
    chosen = qt._chosen
    monkeypatch.setattr(qt, "_chosen", lambda counts, *rest: seen.append(counts.agg(F.max("_n")).head()[0]) or chosen(counts, *rest))
    got = exact_quantiles(df, ["g"], "v", {"a": 0.02, "b": 0.5, "c": 0.98}).head()
    values = np.sort(1.0 + (np.arange(n) * 7919 % n) * 1e-8)
    assert np.allclose([got["a"], got["b"], got["c"]], np.percentile(values, [2, 50, 98]), rtol=0, atol=1e-12)
    assert seen[-1] <= 0.05 * n  # what one task sorts or counts as a range


def test_quantiles_of_odd_values(spark, monkeypatch):
    monkeypatch.setattr(qt, "SORTED_ROWS", 8)
    rng = random.Random(6)
    groups = {
        "ties": [3.0] * 500,
        "two": [0.0, -0.0] * 20 + [5e-324] * 9,
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(300)],
        "near": [1.0 + k * 2.0**-52 for k in range(400)],
        "one": [7.5],
        "mixed": [rng.gauss(0, 1) for _ in range(200)] + [float("nan"), None],
        "endless": [float("-inf"), 1.0, 2.0, 3.0, float("inf")],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("none", None)], "g string, v double")
    got = {r["g"]: (r["a"], r["b"]) for r in exact_quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.95}).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        known = np.array([v for v in vs if v is not None and v == v])
        want = (float(np.percentile(known, 50)), None if g == "endless" else float(np.percentile(known, 95)))
        assert got[g][0] == pytest.approx(want[0], rel=1e-12) and (want[1] is None or got[g][1] == pytest.approx(want[1], rel=1e-12))
    assert exact_quantiles(df.where("g = 'ties'"), [], "v", {"q": 0.3}).head()["q"] == 3.0


def test_robust_scale_without_finite_pixels(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0, 4.0]), (1, [float("nan"), -4.0, 0.0]), (2, [None, float("inf"), float("nan")])], "w long, px array<double>")
    for signed in (True, False):
        plan = robust_scale(df, ["w"], "px", signed)
        assert "percentile" not in plan._jdf.queryExecution().analyzed().toString()
        got = plan.collect()
        assert len(got) == 3 and {r["w"] for r in got} == {1, 2}


def test_panes_equal_copied_rows(spark):
    rng = random.Random(7)
    value = lambda: rng.choice([None, rng.gauss(9.8, 0.05), rng.gauss(0, 3), 0.0])
    rows = [(s, p, value(), rng.gauss(0, 1)) for s, n in (("a", 200), ("b", 64), ("c", 63), ("d", 97)) for p in range(n)] + [("e", p, None, float(p)) for p in range(70)]
    df = spark.createDataFrame(rows, "s string, p long, u double, v double")
    key = ["s", "window_no", "signal"]
    a = windows.pane_features(df, ["s"], "p", ["u", "v"], 64, 16)
    b = windows.window_features(windows.assign_windows(df, "p", 64, 16), ["s", "window_no"], "p", ["u", "v"], 64)
    assert "Expand" not in a._jdf.queryExecution().optimizedPlan().toString()
    a, b = ({tuple(r[k] for k in key): r for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() and len(a) == 2 * (9 + 1 + 3 + 1)
    for k in a:
        for c in windows.FEATURES:
            assert a[k][c] == pytest.approx(b[k][c], rel=1e-8, abs=1e-8), (k, c)


def test_mask_panes_equal_copied_rows(spark):
    rng = random.Random(8)
    rows = [(t, i, rng.randrange(3), rng.choice([None, float("nan"), rng.random()]), rng.randrange(-1, 20), rng.choice([None, 1, 2])) for t, n in (("a", 200), ("b", 32), ("c", 31)) for i in range(n)]
    rows += [("d", i, 0, None, -1, None) for i in range(40)]
    df = spark.createDataFrame(rows, "t string, i long, mask_source int, mask_area_fraction double, mask_age_frames int, yolo_box_count int")
    a, b = ({(r["t"], r["window_no"]): r for r in f(df, ["t"], "i", 32, 16).collect()} for f in (windows.mask_window_stats, windows._mask_stats_by_rows))
    assert a.keys() == b.keys() and len(a) == 11 + 1 + 1
    for k in a:
        for c in set(b[k].asDict()) - {"t"}:
            assert (a[k][c] is None) == (b[k][c] is None) and (a[k][c] is None or a[k][c] == pytest.approx(b[k][c], rel=1e-9, abs=1e-12)), (k, c)


def test_normalisation_report_scores_test_rows(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in range(12):
        shift = rng.normal() * 4
        split = ("train", "train", "val", "test")[s % 4]
        for i in range(2 if s == 3 else 30):
            y = i % 2
            rows.append((1, split, f"p{s}", 100 * s + i, y, [float(shift + y + 0.2 * rng.normal()), float(rng.normal())]))
    df = spark.createDataFrame(rows, "fold_id long, split string, subject string, window_id long, y long, x array<double>")
    got = {r["strategy"]: r for r in models.normalisation_report(df, "subject", "window_id", "x", "y").collect()}
    pop, own = got["population_norm"], got["subject_norm"]
    assert pop["n_windows"] == own["n_windows"] == 62 and pop["n_fallback_subjects"] == own["n_fallback_subjects"] == 1
    assert pop["threshold"] == own["threshold"] and own["auc"] > 0.9 > pop["auc"]


def test_ranges_in_blocks(spark):
    df = spark.createDataFrame([(1, -5, 12), (2, 3, 3), (3, 4, 3), (4, None, 3), (5, 8, 15)], "id long, a long, b long")
    got = sorted((r["id"], r["n"]) for r in explode_range(df, F.col("a"), F.col("b"), "n", block=4).collect())
    assert got == sorted([(1, n) for n in range(-5, 13)] + [(2, 3)] + [(5, n) for n in range(8, 16)])


def test_long_pauses(spark):
    year = 365 * 86400.0
    df = spark.createDataFrame([("a", 0.0, year, 1.0, "x"), ("a", year, year, 3.0, "y")], "s string, t double, e double, v double, label string")
    got = resample(df, ["s"], "t", ["v"], "label", 0.5, tile_width=1e6)
    total = got.agg(F.count(F.lit(1)).alias("n"), F.max("sample_idx").alias("last"), F.countDistinct("sample_idx").alias("d")).head()
    assert total["n"] == total["d"] == year / 2 + 1 and total["last"] == year / 2
    assert target_grid(df.limit(1), "t", "e", 2.0).agg(F.max("sample_idx")).head()[0] == year * 2 - 1
