"""Registered queries: probes, search, calibration, audits, user encoders."""

from pyspark.sql import functions as F

from sensorframe.catalog.folds import FOLDS_SQL
from sensorframe.catalog.metrics import (
    CMET_SQL,
    CONF_SQL,
    FOLD,
    KEYS,
    RANK_SQL,
    BEST_SQL,
    _r,
    _rsql,
)
from sensorframe.catalog.registry import query
from sensorframe.operators import calibrate as ca
from sensorframe.operators import folds as fo
from sensorframe.operators import models as mo
from sensorframe.operators import probes as pr
from sensorframe.operators import vectors as ve
from sensorframe.operators.metrics import best_threshold
from sensorframe.session import materialise
from sensorframe.sources.tables import DIMS_SQL, FRAMES_SQL, PREDICTIONS_SQL

K = 3


def pooled(t):
    """One vector per window with subject and label."""
    f = t.frames()
    facts = f.groupBy("window_id").agg(F.min("subject").alias("subject"), F.min("y").alias("y"))
    return ve.mean_pool(f, ["window_id"], "px").join(facts, "window_id")


def fold_rows(t):
    """Pooled windows once per fold, checkpointed because every fold reads them."""
    p = pooled(t)
    splits = fo.subject_splits(fo.grouped_folds(p, "subject", K), "subject", K)
    return materialise(fo.fold_table(p, splits, "subject"))


def _scores(df):
    return df.select("fold_id", "split", "window_id", "subject", F.col("y").alias("label"), F.round("score", 6).alias("score"))


@query("m6_linear_probe")
def m6(t):
    return _scores(mo.linear_probe(fold_rows(t), range(1, K + 1), "px", "y", reg=0.01))


# The folds of the pooled windows, as the twins see them.
POOLED_SQL = (
    FRAMES_SQL
    + ", base AS (SELECT window_id, min(subject) AS subject, min(y) AS y FROM frames GROUP BY window_id), sizes AS"
    + FOLDS_SQL.split("sizes AS", 1)[1].replace("(r // 5) % 2", f"(r // {K}) % 2").replace("r % 5", f"r % {K}").replace("ELSE 4 -", f"ELSE {K - 1} -").replace("range(1, 6)", f"range(1, {K + 1})")
)


@query(
    "m6_probe_gradient",
    f"""WITH {POOLED_SQL}, tr AS (SELECT fold_id, window_id FROM base JOIN splits USING (subject) WHERE split = 'train'),
    dims AS (SELECT DISTINCT generate_subscripts(px, 1) - 1 AS dim FROM frames)
    SELECT fold_id, CAST(dim AS BIGINT) AS dim, count(*) AS n_train, 0.0 + 0 * CAST(count(*) AS DOUBLE) AS gradient FROM tr, dims GROUP BY fold_id, dim""",
)
def m6_gradient(t):
    """At a fitted probe the gradient of its penalised loss vanishes in every dimension."""
    train = fold_rows(t).where(F.col("split") == "train")
    fits = pr.fit_linear(train, [0.01], "px", "y")
    weights = pr.linear_weights(t.spark, fits, "fold_id", "bigint")
    scored = train.join(F.broadcast(weights), "fold_id").select("fold_id", "y", "px", pr.linear_score("px").alias("score"))
    pulls = [(int(k), d, 0.01 * float(w)) for i, k in enumerate(fits.facts.folds) for d, w in enumerate(fits.weight[i, 0])]
    got = pr.probe_gradient(scored, t.spark.createDataFrame(pulls, "fold_id bigint, dim int, pull double"), "px", "y")
    return got.select("fold_id", F.col("dim").cast("long").alias("dim"), "n_train", (F.round("gradient", 6) + 0.0).alias("gradient"))


@query("m7_mlp_probe")
def m7(t):
    return _scores(mo.mlp_probe(fold_rows(t), range(1, K + 1), "px", "y", "window_id"))


GRID = [{"reg": r} for r in (0.001, 0.1, 1.0)]


@query("m8_search_then_evaluate")
def m8(t):
    best, scores = mo.search_then_evaluate(fold_rows(t), range(1, K + 1), "px", "y", GRID)
    return _scores(scores).withColumn("reg", F.lit(best["reg"]))


@query(
    "m8_choice",
    f"""WITH {POOLED_SQL}, n AS (SELECT count(*) AS n_val FROM base JOIN splits USING (subject) WHERE split = 'val' AND fold_id = 1)
    SELECT CAST(unnest([0.001, 0.1, 1.0]) AS DOUBLE) AS reg, n_val, 0.0 + 0 * CAST(n_val AS DOUBLE) AS apart, CAST(0 AS BIGINT) AS better_than_chosen FROM n""",
)
def m8_choice(t):
    """Each grid point fitted alone gives the quality it had in the joint fit, and none is better than the chosen one."""
    rows = fold_rows(t)
    best, _ = mo.search_then_evaluate(rows, [1], "px", "y", GRID)
    fits = pr.fit_linear(rows.where((F.col("fold_id") == 1) & (F.col("split") == "train")), [g["reg"] for g in GRID], "px", "y")
    joint = mo.grid_quality(rows, fits, 1, "px", "y")
    chosen = joint[GRID.index(best)]
    out = None
    for g, value in zip(GRID, joint):
        val = mo.linear_probe(rows, [1], "px", "y", reg=g["reg"]).where(F.col("split") == "val")
        alone = best_threshold(val, ["fold_id"], "y", "score").join(val.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n_val")), "fold_id")
        one = alone.select(F.lit(g["reg"]).alias("reg"), "n_val", (F.round(F.col("best_score") - value, 6) + 0.0).alias("apart"), F.lit(int(value > chosen)).cast("long").alias("better_than_chosen"))
        out = one if out is None else out.unionByName(one)
    return out


# Newton's method on the score histogram of every group, as a recursive query.
_F = ", ".join(FOLD)
PLATT_SQL = f"""hist AS (SELECT {_F}, ln(p / (1.0 - p)) AS x, CAST(count(*) FILTER (label = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (label = 0) AS DOUBLE) AS neg
      FROM (SELECT *, least(greatest(score, 1e-6), 1.0 - 1e-6) AS p FROM predictions WHERE split = 'val') GROUP BY {_F}, x),
    sz AS (SELECT {_F}, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM hist GROUP BY {_F}),
    wh AS (SELECT {_F}, x, pos * (n_pos + n_neg) / (2.0 * n_pos) AS w1, neg * (n_pos + n_neg) / (2.0 * n_neg) AS w0 FROM hist JOIN sz USING ({_F}) WHERE n_pos > 0 AND n_neg > 0),
    newton(step, {_F}, a, b) AS (
      SELECT 0, {_F}, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM sz WHERE n_pos > 0 AND n_neg > 0
      UNION ALL
      SELECT step + 1, {_F}, a - damp * da, b - damp * db FROM (
        SELECT *, CASE WHEN da * da + db * db > 25 THEN 5.0 / sqrt(da * da + db * db) ELSE 1.0 END AS damp FROM (
          SELECT *, (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS da, (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS db FROM (
            SELECT step, {_F}, a, b, sum(w1 * (p - 1) + w0 * p) AS ga, sum((w1 * (p - 1) + w0 * p) * x) + b AS gb,
              sum((w1 + w0) * p * (1 - p)) + 1e-12 AS haa, sum((w1 + w0) * p * (1 - p) * x) AS hab, sum((w1 + w0) * p * (1 - p) * x * x) + 1.0 AS hbb
            FROM (SELECT n.*, x, w1, w0, 1.0 / (1.0 + exp(-(a + b * x))) AS p FROM newton n JOIN wh USING ({_F}) WHERE step < 40)
            GROUP BY step, {_F}, a, b)))),
    pf AS (SELECT {_F}, a, b FROM newton WHERE step = 40)"""


def _fits(t):
    p = t.predictions()
    return ca.platt_fit(p.where(F.col("split") == "val"), FOLD, "label", "score")


@query(
    "m9_platt_calibration",
    f"""WITH RECURSIVE {PREDICTIONS_SQL}, {PLATT_SQL}
    SELECT {_F}, n_pos, n_neg, CASE WHEN a IS NULL THEN 'skipped_val_single_class' ELSE 'ok' END AS status,
      round(b, 6) + 0.0 AS platt_coef, round(a, 6) + 0.0 AS platt_intercept FROM sz LEFT JOIN pf USING ({_F})""",
)
def m9(t):
    got = _fits(t)
    return got.select(*FOLD, "n_pos", "n_neg", "status", *[(F.round(c, 6) + 0.0).alias(c) for c in ("platt_coef", "platt_intercept")])


SK = KEYS + ", strategy"


def _swept(name: str, score: str, src: str) -> str:
    """WITH items: thresholds between the 5th and 95th percentile of validation scores, and the best of them per fold."""
    return f"""{name}d AS (SELECT {_F}, quantile_cont({score}, 0.05) AS lo, quantile_cont({score}, 0.95) AS hi FROM {src} WHERE split = 'val' GROUP BY {_F}),
    {name}g AS (SELECT {_F}, i, CASE WHEN i = 99 THEN hi ELSE i * ((hi - lo) / 99.0) + lo END AS thr FROM (SELECT *, unnest(range(100)) AS i FROM {name}d)),
    {name}h AS (SELECT {_F}, {score} AS score, sum(label) AS pos, sum(1 - label) AS neg FROM {src} WHERE split = 'val' GROUP BY ALL),
    {name} AS ({BEST_SQL.format(keys=_F, src=f'{name}h JOIN {name}g USING ({_F})')})"""


# Every prediction once per strategy, its metrics per fold and split, and the same per run.
AUDIT_SQL = f"""{PREDICTIONS_SQL}, {PLATT_SQL},
    cal AS (SELECT p.*, 1.0 / (1.0 + exp(-(a + b * ln(c / (1.0 - c))))) AS cscore FROM (SELECT *, least(greatest(score, 1e-6), 1.0 - 1e-6) AS c FROM predictions) p JOIN pf USING ({_F})),
    {_swept('ba', 'score', 'predictions')}, {_swept('bc', 'cscore', 'cal')},
    st AS (SELECT {KEYS}, label, score, 'current_saved_threshold' AS strategy, prediction AS pred FROM predictions
      UNION ALL SELECT {KEYS}, label, score, 'val_adaptive_threshold', CASE WHEN score >= best_threshold THEN 1 ELSE 0 END FROM predictions JOIN ba USING ({_F})
      UNION ALL SELECT {KEYS}, label, round(cscore, 9), 'val_platt_lr_0p5', CASE WHEN cscore >= 0.5 THEN 1 ELSE 0 END FROM cal
      UNION ALL SELECT {KEYS}, label, round(cscore, 9), 'val_platt_lr_val_threshold', CASE WHEN cscore >= best_threshold THEN 1 ELSE 0 END FROM cal JOIN bc USING ({_F})),
    {RANK_SQL.format(keys=SK).replace('FROM predictions', 'FROM st')}, cf AS ({CONF_SQL.format(keys=SK, pred='pred', src='st')}), cm AS ({CMET_SQL.format(src='cf')}),
    au AS (SELECT * EXCLUDE (tp, fp, tn, fn) FROM cm JOIN rk USING ({SK}))"""


@query(
    "m10_strategy_audit",
    f"WITH RECURSIVE {AUDIT_SQL} SELECT {SK}, n_windows, {_rsql(['auc', 'avg_precision', 'balanced_accuracy', 'f1_macro', 'mcc'], 6)} FROM au",
)
def m10(t):
    p = t.predictions()
    audited = ca.audit_predictions(p, FOLD, materialise(ca.calibrator_table(p, FOLD)), digits=9)
    got = ca.audit_metrics(audited, FOLD)
    return got.select(*FOLD, "split", "strategy", "n_windows", *_r(["auc", "avg_precision", "balanced_accuracy", "f1_macro", "mcc"], 6))




@query(
    "m10_saved_and_adaptive",
    f"""WITH {PREDICTIONS_SQL}, {RANK_SQL.format(keys=KEYS)},
    bd AS (SELECT {KEYS}, quantile_cont(score, 0.05) AS lo, quantile_cont(score, 0.95) AS hi FROM predictions WHERE split = 'val' GROUP BY {KEYS}),
    gr AS (SELECT *, unnest(range(100)) AS i FROM bd), gt AS (SELECT {KEYS}, i, CASE WHEN i = 99 THEN hi ELSE i * ((hi - lo) / 99.0) + lo END AS thr FROM gr),
    b AS ({BEST_SQL.format(keys=KEYS, src=f'h JOIN gt USING ({KEYS})')}),
    s AS (SELECT {KEYS}, label, score, 'current_saved_threshold' AS strategy, prediction AS pred FROM predictions UNION ALL
          SELECT {', '.join('p.' + k for k in FOLD)}, p.split, label, score, 'val_adaptive_threshold', CASE WHEN score >= best_threshold THEN 1 ELSE 0 END FROM predictions p JOIN b USING ({', '.join(FOLD)})),
    cf AS ({CONF_SQL.format(keys=SK, pred='pred', src='s')}), cm AS ({CMET_SQL.format(src='cf')})
    SELECT {SK}, n_windows, {_rsql(['auc', 'avg_precision', 'balanced_accuracy', 'f1_macro', 'mcc'])} FROM cm JOIN rk USING ({KEYS})""",
)
def m10_saved(t):
    from sensorframe.operators.metrics import adaptive_threshold

    p = t.predictions()
    found = adaptive_threshold(p.where(F.col("split") == "val"), FOLD, "label", "score")
    none = F.lit(None).cast("double")
    cal = found.select(
        *FOLD,
        F.col("best_threshold").alias("adaptive_val_threshold"),
        none.alias("platt_coef"),
        none.alias("platt_intercept"),
        none.alias("platt_val_threshold"),
    )
    got = ca.audit_metrics(ca.audit_predictions(p, FOLD, cal, ca.STRATEGIES[:2]), FOLD)
    return got.select(*FOLD, "split", "strategy", "n_windows", *_r(["auc", "avg_precision", "balanced_accuracy", "f1_macro", "mcc"]))


@query("m11_normalisation_comparison")
def m11(t):
    got = mo.normalisation_report(fold_rows(t), "subject", "window_id", "px", "y")
    return got.select("fold_id", "strategy", "threshold", "n_windows", "n_fallback_subjects", *_r(["auc", "avg_precision", "balanced_accuracy", "mcc"], 6))


# An encoder of four outputs: tanh of the frame against sine waves.
ENCODED_SQL = DIMS_SQL + """, enc AS (
  SELECT window_id, frame_idx, j, tanh(sum(v * sin(d * (j + 1.0)))) AS e FROM dims, range(4) r(j) GROUP BY window_id, frame_idx, j)"""


def _encode(frames):
    import numpy as np

    d = np.arange(frames.shape[1], dtype=float)
    return np.tanh(frames @ np.sin(d[:, None] * (np.arange(4) + 1.0)))


@query(
    "m12_frame_encoder",
    f"WITH {ENCODED_SQL} SELECT window_id, frame_idx, {', '.join(f'round(max(e) FILTER (j = {j}), 6) + 0.0 AS e{j}' for j in range(4))} FROM enc GROUP BY window_id, frame_idx",
)
def m12(t):
    got = mo.score_frames(t.frames(), ["window_id", "frame_idx"], "px", _encode, micro_batch=64, kind="double")
    return got.select("window_id", "frame_idx", *[(F.round(F.col("embedding")[j], 6) + 0.0).alias(f"e{j}") for j in range(4)])


@query(
    "m12_pooled_encoder",
    f"WITH {ENCODED_SQL} SELECT window_id, {', '.join(f'round(avg(e) FILTER (j = {j}), 6) + 0.0 AS e{j}' for j in range(4))} FROM enc GROUP BY window_id",
)
def m12_pooled(t):
    got = mo.score_frames(t.frames(), ["window_id", "frame_idx"], "px", _encode, micro_batch=64, pool=["window_id"], kind="double")
    return got.select("window_id", *[(F.round(F.col("embedding")[j], 6) + 0.0).alias(f"e{j}") for j in range(4)])
