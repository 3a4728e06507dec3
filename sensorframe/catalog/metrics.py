"""Registered queries: confusion and ranking metrics, thresholds, summaries."""

from pyspark.sql import functions as F

from sensorframe.catalog.registry import query
from sensorframe.operators import metrics as me
from sensorframe.sources.tables import PREDICTIONS_SQL

RUN = ["run_name", "encoder", "feature"]
FOLD = [*RUN, "fold_id"]
SPLIT = [*FOLD, "split"]
KEYS = ", ".join(SPLIT)
RUN_KEYS = ", ".join(RUN)

CONF_SQL = """SELECT {keys}, count(*) AS n_windows, count(*) FILTER (label = 1 AND {pred} = 1) AS tp, count(*) FILTER (label = 0 AND {pred} = 1) AS fp,
  count(*) FILTER (label = 0 AND {pred} = 0) AS tn, count(*) FILTER (label = 1 AND {pred} = 0) AS fn FROM {src} GROUP BY {keys}"""
CMET_SQL = """SELECT *, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE tn / (tn + fp) END AS balanced_accuracy,
  CASE WHEN tp + fp + fn > 0 AND tn + fp + fn > 0 THEN (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2
       WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 2 * tn / (2 * tn + fp + fn) END AS f1_macro,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS sensitivity, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS specificity,
  CASE WHEN (tp + fp) > 0 AND (tp + fn) > 0 AND (tn + fp) > 0 AND (tn + fn) > 0
       THEN (tp * tn - fp * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END AS mcc FROM {src}"""
RANK_SQL = """h AS (SELECT {keys}, score, sum(label) AS pos, sum(1 - label) AS neg FROM predictions GROUP BY {keys}, score),
  hc AS (SELECT *, sum(pos) OVER (PARTITION BY {keys} ORDER BY score) AS cp, sum(neg) OVER (PARTITION BY {keys} ORDER BY score) AS cn,
         sum(pos) OVER (PARTITION BY {keys}) AS p, sum(neg) OVER (PARTITION BY {keys}) AS n FROM h),
  rk AS (SELECT {keys}, CAST(max(p) AS BIGINT) AS n_stress, CAST(max(n) AS BIGINT) AS n_nonstress,
         CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * (cn - neg / 2)) / max(p) / max(n) END AS auc,
         CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * ((p - cp + pos) / (p - cp + pos + n - cn + neg))) / max(p) END AS avg_precision FROM hc GROUP BY {keys})"""
ALL_SQL = (
    PREDICTIONS_SQL
    + ", "
    + RANK_SQL.format(keys=KEYS)
    + f", cf AS ({CONF_SQL.format(keys=KEYS, pred='prediction', src='predictions')}), cm AS ({CMET_SQL.format(src='cf')})"
    + f", pf AS (SELECT * EXCLUDE (tp, fp, tn, fn) FROM cm JOIN rk USING ({KEYS}))"
)


def _r(names, digits=9):
    return [F.round(n, digits).alias(n) for n in names]


def _rsql(names, digits=9):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


CM = ["balanced_accuracy", "f1_macro", "sensitivity", "specificity", "mcc"]


def per_fold(t):
    return me.metric_table(t.predictions(), SPLIT, "label", "score", "prediction")


@query(
    "a10_confusion_metrics",
    f"WITH {PREDICTIONS_SQL}, cf AS ({CONF_SQL.format(keys=KEYS, pred='prediction', src='predictions')}), cm AS ({CMET_SQL.format(src='cf')}) SELECT {KEYS}, n_windows, tp, fp, tn, fn, {_rsql(CM)} FROM cm",
)
def a10(t):
    got = me.confusion_table(t.predictions(), SPLIT, "label", "prediction")
    return got.select(*SPLIT, "n_windows", "tp", "fp", "tn", "fn", *_r(CM))


@query("a11_roc_auc", f"WITH {PREDICTIONS_SQL}, {RANK_SQL.format(keys=KEYS)} SELECT {KEYS}, n_stress, n_nonstress, {_rsql(['auc'])} FROM rk")
def a11(t):
    return me.ranking_metrics(t.predictions(), SPLIT, "label", "score").select(*SPLIT, "n_stress", "n_nonstress", *_r(["auc"]))


LABEL_SQL = """predictions AS (SELECT lang AS g, quality AS label, n_chars / 1000.0 AS score FROM labels JOIN documents USING (doc_id))"""


@query(
    "a11_roc_auc_documents",
    f"WITH {LABEL_SQL}, {RANK_SQL.format(keys='g')} SELECT g, n_stress, n_nonstress, {_rsql(['auc', 'avg_precision'])} FROM rk",
)
def a11_docs(t):
    p = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select(
        F.col("lang").alias("g"), F.col("quality").alias("label"), (F.col("n_chars") / 1000.0).alias("score")
    )
    return me.ranking_metrics(p, ["g"], "label", "score", measured_tiles=64).select(
        "g", "n_stress", "n_nonstress", *_r(["auc", "avg_precision"])
    )


@query("a12_average_precision", f"WITH {PREDICTIONS_SQL}, {RANK_SQL.format(keys=KEYS)} SELECT {KEYS}, {_rsql(['avg_precision'])} FROM rk")
def a12(t):
    return me.ranking_metrics(t.predictions(), SPLIT, "label", "score").select(*SPLIT, *_r(["avg_precision"]))


FOLD_AGG_SQL = (
    f"SELECT {RUN_KEYS}, "
    + ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in me.METRICS)
    + f", count(DISTINCT fold_id) AS n_folds, avg(n_windows) AS mean_windows_per_fold FROM pf WHERE split = 'test' GROUP BY {RUN_KEYS}"
)


def summary(t):
    return me.fold_aggregates(per_fold(t).where(F.col("split") == "test"), RUN, me.METRICS)


MEANS = [f"{m}_{s}" for m in me.METRICS for s in ("mean", "std")]


@query("a13_fold_aggregates", f"WITH {ALL_SQL}, fa AS ({FOLD_AGG_SQL}) SELECT {RUN_KEYS}, n_folds, mean_windows_per_fold, {_rsql(MEANS)} FROM fa")
def a13(t):
    return summary(t).select(*RUN, "n_folds", "mean_windows_per_fold", *_r(MEANS))


@query(
    "p14_mean_std_text",
    f"WITH {ALL_SQL}, fa AS ({FOLD_AGG_SQL}) SELECT {RUN_KEYS}, "
    + ", ".join(f"printf('%.3f', {m}_mean) || '±' || printf('%.3f', {m}_std) AS {m}_fmt" for m in me.METRICS)
    + " FROM fa",
)
def p14(t):
    return summary(t).select(*RUN, *[f"{m}_fmt" for m in me.METRICS])


WIDE = [f"{s}_{m}" for s in ("train", "val", "test") for m in ("balanced_accuracy_mean", "balanced_accuracy_std", "f1_macro_mean", "auc_mean")]


@query(
    "a14_split_summary",
    f"WITH {ALL_SQL}, w AS (SELECT {RUN_KEYS}, "
    + ", ".join(
        f"avg(balanced_accuracy) FILTER (split = '{s}') AS {s}_balanced_accuracy_mean, stddev_pop(balanced_accuracy) FILTER (split = '{s}') AS {s}_balanced_accuracy_std, avg(f1_macro) FILTER (split = '{s}') AS {s}_f1_macro_mean, avg(auc) FILTER (split = '{s}') AS {s}_auc_mean"
        for s in ("train", "val", "test")
    )
    + f" FROM pf GROUP BY {RUN_KEYS}) SELECT {RUN_KEYS}, {_rsql(WIDE)} FROM w",
)
def a14(t):
    return me.split_summary(per_fold(t), RUN).select(*RUN, *_r(WIDE))


DELTA = ["auc_mean", "balanced_accuracy_mean", "mcc_mean"]
DELTA_COLS = [f"{m}_{x}" for m in DELTA for x in ("run_O", "run_F", "delta")]


@query(
    "j13_strategy_delta",
    f"WITH {ALL_SQL}, fa AS ({FOLD_AGG_SQL}), d AS (SELECT encoder, feature, "
    + ", ".join(f"a.{m} AS {m}_run_O, b.{m} AS {m}_run_F, a.{m} - b.{m} AS {m}_delta" for m in DELTA)
    + f" FROM fa a JOIN fa b USING (encoder, feature) WHERE a.run_name = 'run_O' AND b.run_name = 'run_F') SELECT encoder, feature, {_rsql(DELTA_COLS)} FROM d",
)
def j13(t):
    return me.strategy_delta(summary(t), ["encoder", "feature"], "run_name", "run_O", "run_F", DELTA).select(
        "encoder", "feature", *_r(DELTA_COLS)
    )


@query(
    "a24_best_per_group",
    f"WITH {ALL_SQL}, fa AS ({FOLD_AGG_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY encoder, feature ORDER BY auc_mean DESC, run_name) AS k FROM fa) SELECT encoder, feature, run_name, {_rsql(['auc_mean'])} FROM r WHERE k = 1",
)
def a24(t):
    s = summary(t).select("encoder", "feature", "run_name", "auc_mean")
    return me.best_per_group(s, ["encoder", "feature"], "auc_mean", ["run_name"]).select("encoder", "feature", "run_name", *_r(["auc_mean"]))


@query(
    "t8_leaderboard",
    f"WITH {ALL_SQL}, fa AS ({FOLD_AGG_SQL}) SELECT {RUN_KEYS}, {_rsql(['auc_mean', 'balanced_accuracy_mean'])} FROM fa ORDER BY auc_mean DESC, balanced_accuracy_mean DESC",
)
def t8(t):
    s = summary(t).select(*RUN, "auc_mean", "balanced_accuracy_mean")
    return me.leaderboard(s, ["auc_mean", "balanced_accuracy_mean"], RUN).select(*RUN, *_r(["auc_mean", "balanced_accuracy_mean"]))


CONCISE = ["test_balanced_accuracy_mean", "test_auc_mean", "test_mcc_mean", "test_avg_precision_mean", "test_f1_macro_mean"]


@query(
    "a27_concise_table",
    f"""WITH {ALL_SQL}, fa AS ({FOLD_AGG_SQL}) SELECT encoder || '_probe_' || run_name AS model_name, feature AS input_mode,
    encoder || ':' || feature || ':probe:' || run_name AS representation_equation, 'validation-only threshold audit' AS sequence_pooling,
    CAST(0 AS BIGINT) AS search_trials, n_folds, round(balanced_accuracy_mean, 9) AS test_balanced_accuracy_mean, round(auc_mean, 9) AS test_auc_mean,
    round(mcc_mean, 9) AS test_mcc_mean, round(avg_precision_mean, 9) AS test_avg_precision_mean, round(f1_macro_mean, 9) AS test_f1_macro_mean FROM fa""",
)
def a27(t):
    s = summary(t).withColumn("model_family", F.lit("probe")).withColumnRenamed("run_name", "strategy")
    got = me.concise_table(s)
    return got.select(*[c for c in got.columns if c not in CONCISE], *_r(CONCISE))


GRID_SQL = f"grid AS (SELECT unnest(range({me.GRID_POINTS})) AS i, unnest([{', '.join(f'CAST({v!r} AS DOUBLE)' for v in me.fixed_grid())}]) AS thr)"
BEST_SQL = """SELECT {keys}, thr AS best_threshold, ba AS best_score FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ba DESC, i) AS k FROM (
      SELECT {keys}, i, thr, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN (sum(CASE WHEN score >= thr THEN pos ELSE 0 END) / sum(pos) + sum(CASE WHEN score < thr THEN neg ELSE 0 END) / sum(neg)) / 2
             WHEN sum(pos) > 0 THEN sum(CASE WHEN score >= thr THEN pos ELSE 0 END) / sum(pos) ELSE sum(CASE WHEN score < thr THEN neg ELSE 0 END) / sum(neg) END AS ba
      FROM {src} GROUP BY {keys}, i, thr)) WHERE k = 1"""


@query(
    "t6_threshold_fixed",
    f"WITH {PREDICTIONS_SQL}, {RANK_SQL.format(keys=KEYS)}, {GRID_SQL}, b AS ({BEST_SQL.format(keys=KEYS, src='h CROSS JOIN grid')}) SELECT {KEYS}, {_rsql(['best_threshold', 'best_score'])} FROM b",
)
def t6(t):
    return me.best_threshold(t.predictions(), SPLIT, "label", "score").select(*SPLIT, *_r(["best_threshold", "best_score"]))


@query(
    "t7_threshold_adaptive",
    f"""WITH {PREDICTIONS_SQL}, {RANK_SQL.format(keys=KEYS)},
    bd AS (SELECT {KEYS}, quantile_cont(score, 0.05) AS lo, quantile_cont(score, 0.95) AS hi FROM predictions GROUP BY {KEYS}),
    gr AS (SELECT *, unnest(range(100)) AS i FROM bd),
    gt AS (SELECT {KEYS}, i, CASE WHEN i = 99 THEN hi ELSE i * ((hi - lo) / 99.0) + lo END AS thr FROM gr),
    b AS ({BEST_SQL.format(keys=KEYS, src=f'h JOIN gt USING ({KEYS})')}) SELECT {KEYS}, {_rsql(['best_threshold', 'best_score'])} FROM b""",
)
def t7(t):
    return me.adaptive_threshold(t.predictions(), SPLIT, "label", "score").select(*SPLIT, *_r(["best_threshold", "best_score"]))


@query(
    "m13_per_fold_evaluation",
    f"""WITH {PREDICTIONS_SQL}, {RANK_SQL.format(keys=KEYS)}, {GRID_SQL}, b AS ({BEST_SQL.format(keys=KEYS, src='h CROSS JOIN grid')}),
    v AS (SELECT {', '.join(FOLD)}, best_threshold FROM b WHERE split = 'val'),
    pp AS (SELECT p.*, best_threshold, CASE WHEN score >= best_threshold THEN 1 ELSE 0 END AS pred FROM predictions p JOIN v USING ({', '.join(FOLD)})),
    cf AS ({CONF_SQL.format(keys=KEYS + ', best_threshold', pred='pred', src='pp')}), cm AS ({CMET_SQL.format(src='cf')})
    SELECT {KEYS}, round(best_threshold, 9) AS threshold, n_windows, {_rsql(['balanced_accuracy', 'f1_macro', 'auc'])} FROM cm JOIN rk USING ({KEYS})""",
)
def m13(t):
    from sensorframe.operators.models import evaluate_folds

    got = evaluate_folds(t.predictions(), FOLD, "split", "label", "score")
    return got.select(*SPLIT, F.round("threshold", 9).alias("threshold"), "n_windows", *_r(["balanced_accuracy", "f1_macro", "auc"]))


@query(
    "w15_best_epoch",
    """WITH h AS (SELECT l_suppkey % 50 AS run, year(l_shipdate) * 12 + month(l_shipdate) AS epoch, round(avg(l_discount + l_tax), 12) AS score FROM lineitem GROUP BY 1, 2),
    g AS (SELECT *, row_number() OVER w AS n, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM h WINDOW w AS (PARTITION BY run ORDER BY epoch)),
    s AS (SELECT *, n - max(CASE WHEN top IS NULL OR score > top THEN n END) OVER (PARTITION BY run ORDER BY epoch) AS since FROM g),
    x AS (SELECT *, max(CASE WHEN since >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM s)
    SELECT run, round(max(score), 9) AS best_score, arg_min(epoch, (-score, epoch)) AS best_epoch, max(epoch) AS last_epoch FROM x WHERE coalesce(stopped, 0) = 0 GROUP BY run""",
)
def w15(t):
    h = t.lineitem.groupBy(
        (F.col("l_suppkey") % 50).alias("run"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("epoch")
    ).agg(F.round(F.avg(F.col("l_discount") + F.col("l_tax")), 12).alias("score"))
    return me.best_epoch(h, ["run"], "epoch", "score", 6).withColumn("best_score", F.round("best_score", 9))


@query(
    "p15_score_logit",
    f"""WITH {PREDICTIONS_SQL}, d AS (SELECT score, count(*) AS n FROM predictions GROUP BY score)
    SELECT round(score, 9) AS score, n, round(ln(least(greatest(score, 1e-6), 1.0 - 1e-6) / (1.0 - least(greatest(score, 1e-6), 1.0 - 1e-6))), 9) + 0.0 AS logit FROM d""",
)
def p15(t):
    from sensorframe.functions.scalars import logit

    d = t.predictions().groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.round("score", 9).alias("score"), "n", (F.round(logit(F.col("score")), 9) + 0.0).alias("logit"))


@query(
    "p16_threshold_apply",
    f"WITH {PREDICTIONS_SQL} SELECT run_name, fold_id, CAST(CASE WHEN score >= 0.35 THEN 1 ELSE 0 END AS BIGINT) AS prediction, count(*) AS n FROM predictions GROUP BY ALL",
)
def p16(t):
    from sensorframe.functions.scalars import above

    p = t.predictions().withColumn("prediction", above(F.col("score"), 0.35))
    return p.groupBy("run_name", "fold_id", "prediction").agg(F.count(F.lit(1)).alias("n"))
