"""Registered queries: pairing, enrichment, coverage, quality checks."""

from pyspark.sql import functions as F

from sensorframe.catalog.registry import query
from sensorframe.operators import pairing as pa
from sensorframe.operators import quality as qu
from sensorframe.operators.ordered import row_tile
from sensorframe.sources.tables import FRAMES_SQL, PREDICTIONS_SQL, SAMPLES_SQL

TILE = 4096
SIDES_SQL = SAMPLES_SQL + """, l AS (SELECT subject, 't' || (row_idx % 3) AS task, row_idx AS left_id, us AS left_us, CAST(row_idx % 2 AS BIGINT) AS y FROM samples WHERE label NOT IN ('click', 'error')),
  r AS (SELECT subject, 't' || (row_idx % CASE WHEN CAST(substr(subject, 2) AS BIGINT) % 5 = 0 THEN 4 ELSE 3 END) AS task, row_idx AS right_id, us AS right_us, CAST(row_idx % 5 > 2 AS BIGINT) AS y FROM samples WHERE label IN ('click', 'error'))"""


def sides(t):
    """All sensor rows, dealt to two sides by label; a fifth of the subjects has a task that only the right side knows."""
    s = t.samples()
    i = F.col("row_idx")
    right_side = F.col("label").isin("click", "error")
    tasks = F.when(F.substring("subject", 2, 9).cast("long") % 5 == 0, 4).otherwise(3)
    left = s.where(~right_side).select(
        "subject", F.concat(F.lit("t"), (i % 3).cast("string")).alias("task"), i.alias("left_id"), F.col("us").alias("left_us"), (i % 2).alias("y")
    )
    right = s.where(right_side).select(
        "subject", F.concat(F.lit("t"), (i % tasks).cast("string")).alias("task"), i.alias("right_id"), F.col("us").alias("right_us"), (i % 5 > 2).cast("long").alias("y")
    )
    return left, right


def pairs(t):
    left, right = sides(t)
    return pa.positional_pairs(
        left, right.drop("right_us"), ["subject", "task"], "left_id", "right_id", row_tile("left_id", TILE), row_tile("right_id", TILE), "y"
    )


PAIRS_SQL = SIDES_SQL + """, ln AS (SELECT *, row_number() OVER (PARTITION BY subject, task ORDER BY left_id) AS pos FROM l), rn AS (SELECT *, row_number() OVER (PARTITION BY subject, task ORDER BY right_id) AS pos FROM r),
  pairs AS (SELECT ln.subject, ln.task, ln.pos, left_id, right_id, ln.y, ln.y <> rn.y AS label_mismatch FROM ln JOIN rn ON ln.subject = rn.subject AND ln.task = rn.task AND ln.pos = rn.pos)"""


@query("j10_positional_pairs", f"WITH {PAIRS_SQL} SELECT * FROM pairs")
def j10(t):
    return pairs(t).drop("left_us")


@query(
    "j10_time_pairs",
    f"""WITH {SIDES_SQL}, k AS (SELECT l.subject, l.task, left_id, left_us, right_id, right_us, row_number() OVER (PARTITION BY left_id ORDER BY abs(left_us - right_us), right_us, right_id) AS k
    FROM l JOIN r USING (subject, task)) SELECT subject, task, left_id, right_id, abs(left_us - right_us) AS gap_us FROM k WHERE k = 1 AND abs(left_us - right_us) <= 86400000000""",
)
def j10_time(t):
    left, right = sides(t)
    got = pa.timed_pairs(
        left, right, ["subject", "task"], "left_id", "right_id", "left_us", "right_us", 86_400_000_000, 5 * 86_400_000_000
    )
    return got.select("subject", "task", "left_id", "right_id", F.col("gap").alias("gap_us"))


@query("a22_pair_coverage", f"WITH {PAIRS_SQL} SELECT subject, count(*) AS n_pairs, CAST(sum(y) AS BIGINT) AS n_stress, round(100 * sum(y) / count(*), 1) AS pct_stress FROM pairs GROUP BY subject")
def a22(t):
    return pa.pair_coverage(pairs(t), "subject", "y")


@query(
    "a23_alignment_stats",
    f"""WITH {SIDES_SQL}, a AS (SELECT subject, task, count(*) AS na FROM l GROUP BY 1, 2), b AS (SELECT subject, task, count(*) AS nb FROM r GROUP BY 1, 2),
    j AS (SELECT coalesce(a.subject, b.subject) AS subject, na, nb FROM a FULL JOIN b ON a.subject = b.subject AND a.task = b.task)
    SELECT count(*) AS n_groups, count(*) FILTER (nb IS NULL) AS n_left_only, count(*) FILTER (na IS NULL) AS n_right_only, count(*) FILTER (na <> nb) AS n_mismatch,
      CAST(sum(least(na, nb)) FILTER (na IS NOT NULL AND nb IS NOT NULL) AS BIGINT) AS n_pairs, count(DISTINCT subject) FILTER (na IS NOT NULL AND nb IS NOT NULL) AS n_subjects_covered FROM j""",
)
def a23(t):
    left, right = sides(t)
    return pa.alignment_stats(left, right, "subject", ["subject", "task"])


META_SQL = "meta AS (SELECT o_custkey + CAST(o_custkey % 3 = 0 AS BIGINT) AS wid, 't' || (o_orderkey % 4) AS task_id FROM orders)"


def metadata(t):
    """A task per order; customers divisible by three have none, their orders go to the next one."""
    c = F.col("o_custkey")
    return t.orders.select((c + (c % 3 == 0).cast("long")).alias("wid"), F.concat(F.lit("t"), (F.col("o_orderkey") % 4).cast("string")).alias("task_id"))


@query(
    "j11_metadata_enrich",
    f"WITH {META_SQL}, m AS (SELECT wid, min(task_id) AS task_id FROM meta GROUP BY wid) SELECT c_custkey AS wid, c_name, task_id FROM customer JOIN m ON wid = c_custkey",
)
def j11(t):
    good, _ = pa.enrich(t.customer.select(F.col("c_custkey").alias("wid"), "c_name"), metadata(t), "wid", ["task_id"])
    return good


@query(
    "j11_unmatched_count",
    f"WITH {META_SQL} SELECT count(*) AS n_total, count(*) FILTER (c_custkey NOT IN (SELECT wid FROM meta)) AS n_missing FROM customer",
)
def j11_missing(t):
    good, bad = pa.enrich(t.customer.select(F.col("c_custkey").alias("wid")), metadata(t), "wid", ["task_id"])
    tagged = good.select(F.lit(0).alias("m")).unionByName(bad.select(F.lit(1).alias("m")))
    return tagged.agg(F.count(F.lit(1)).alias("n_total"), F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("n_missing"))


@query(
    "j15_lookup_or_zero",
    """SELECT o_orderkey, round(coalesce(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 0.0), 8) + 0.0 AS total, coalesce(len(embedding), 64) AS width
    FROM orders LEFT JOIN embeddings ON vec_id = o_custkey""",
)
def j15(t):
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("vec_id"))
    got = pa.lookup_or_zero(o, t.embeddings, "vec_id", "embedding", 64)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return got.select("o_orderkey", (F.round(total, 8) + 0.0).alias("total"), F.size("embedding").cast("long").alias("width"))


@query(
    "j16_row_count_check",
    """WITH a AS (SELECT o_orderkey % 200 AS store, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderkey % 200 + CAST(o_orderkey % 10 = 3 AS BIGINT) AS store, count(*) AS n FROM orders GROUP BY 1)
    SELECT coalesce(a.store, b.store) AS store, coalesce(a.n, 0) AS n_cache, coalesce(b.n, 0) AS n_labels, coalesce(a.n, 0) = coalesce(b.n, 0) AS agrees FROM a FULL JOIN b ON a.store = b.store""",
)
def j16(t):
    o = F.col("o_orderkey")
    cache = t.orders.select((o % 200).alias("store"))
    labels = t.orders.select((o % 200 + (o % 10 == 3).cast("long")).alias("store"))
    return pa.row_count_check({"cache": cache, "labels": labels}, ["store"])


V1_SQL = """arr AS (SELECT l_orderkey AS task, CASE l_partkey % 9 WHEN 0 THEN 'depth' WHEN 1 THEN 'depth_frame_indices' WHEN 2 THEN 'depth_source_timestamps' WHEN 3 THEN 'rgb' WHEN 4 THEN 'rgb_frame_indices'
    WHEN 5 THEN 'rgb_source_timestamps' WHEN 6 THEN 'target_timestamps' WHEN 7 THEN 'extra_a' ELSE 'extra_b' END AS name, l_suppkey FROM lineitem),
  arrays AS (SELECT task % 1500 + CAST(task % 1500 % 23 = 0 AS BIGINT) AS task, name, max(10 + CAST(l_suppkey > 97 AS BIGINT)) AS length, max(CASE WHEN name = 'rgb' THEN 4 WHEN l_suppkey = 7 THEN 2 ELSE 3 END) AS ndim, max(3) AS last_dim FROM arr GROUP BY 1, 2),
  attrs AS (SELECT DISTINCT o_orderkey % 1500 AS task, unnest(CASE WHEN o_orderkey % 1500 % 17 = 0 THEN ['group', 'task_id'] ELSE ['base_subject_id', 'group', 'stress_label', 'task_id', 'view_type'] END) AS attr FROM orders),
  stamps AS (SELECT o_orderkey % 1500 AS task, o_orderkey AS idx, CAST(o_orderkey // 1500 AS DOUBLE) * (CASE WHEN o_orderkey % 1500 % 11 = 0 THEN 0.5 ELSE 0.25 END) AS ts FROM orders)"""


def v1_inputs(t):
    p = F.col("l_partkey") % 9
    name = F.lit("extra_b")
    for i, n in enumerate(
        ("depth", "depth_frame_indices", "depth_source_timestamps", "rgb", "rgb_frame_indices", "rgb_source_timestamps", "target_timestamps", "extra_a")
    ):
        name = F.when(p == i, n).otherwise(name)
    key = F.col("l_orderkey") % 1500
    # Tasks divisible by 23 have no arrays: their rows go to the next task.
    arr = t.lineitem.select((key + (key % 23 == 0).cast("long")).alias("task"), name.alias("array"), "l_suppkey")
    arrays = arr.groupBy("task", "array").agg(
        F.max(10 + (F.col("l_suppkey") > 97).cast("long")).alias("length"),
        F.max(F.when(F.col("array") == "rgb", 4).when(F.col("l_suppkey") == 7, 2).otherwise(3)).alias("ndim"),
        F.max(F.lit(3)).alias("last_dim"),
    )
    o = F.col("o_orderkey")
    task = (o % 1500).alias("task")
    few, full = F.array(F.lit("group"), F.lit("task_id")), F.array(*[F.lit(a) for a in qu.REQUIRED_ATTRS])
    attrs = t.orders.select(task, F.explode(F.when(o % 1500 % 17 == 0, few).otherwise(full)).alias("attr")).distinct()
    ts = F.floor(o / 1500).cast("double") * F.when(o % 1500 % 11 == 0, 0.5).otherwise(0.25)
    return arrays, attrs, t.orders.select(task, o.alias("idx"), ts.alias("ts"))


@query(
    "v1_task_validation",
    f"""WITH {V1_SQL}, ha AS (SELECT task, list(DISTINCT name) AS names, max(length) FILTER (name = 'rgb') AS rn, max(ndim) FILTER (name = 'rgb') AS rd, max(length) FILTER (name = 'depth') AS dn,
      max(ndim) FILTER (name = 'depth') AS dd, max(length) FILTER (name = 'target_timestamps') AS tn FROM arrays GROUP BY task), hb AS (SELECT task, list(DISTINCT attr) AS attrs FROM attrs GROUP BY task),
    st AS (SELECT task, median(d) AS med FROM (SELECT task, ts - lag(ts) OVER (PARTITION BY task ORDER BY idx) AS d FROM stamps) GROUP BY task),
    m AS (SELECT task, array_to_string(list_sort(list_filter(['depth', 'depth_frame_indices', 'depth_source_timestamps', 'rgb', 'rgb_frame_indices', 'rgb_source_timestamps', 'target_timestamps'], lambda x: NOT list_contains(coalesce(names, []), x))), ',') AS missing_arrays,
      array_to_string(list_sort(list_filter(['base_subject_id', 'group', 'stress_label', 'task_id', 'view_type'], lambda x: NOT list_contains(coalesce(attrs, []), x))), ',') AS missing_attrs, rn, rd, dn, dd, tn, med
      FROM (SELECT task FROM arrays UNION SELECT task FROM attrs UNION SELECT task FROM stamps) LEFT JOIN ha USING (task) LEFT JOIN hb USING (task) LEFT JOIN st USING (task)),
    s AS (SELECT *, CASE WHEN missing_arrays <> '' OR missing_attrs <> '' THEN 'incomplete' WHEN abs(med - 0.25) > 0.05 THEN 'bad_timestamp_step' WHEN rn <> dn OR rn <> tn THEN 'length_mismatch' WHEN rd <> 4 OR dd <> 3 THEN 'bad_shape' ELSE 'complete' END AS status FROM m)
    SELECT task, status, missing_arrays, missing_attrs, CASE WHEN status <> 'incomplete' THEN rn END AS num_samples, CASE WHEN status <> 'incomplete' THEN med END AS timestamp_step_median,
      CASE WHEN status <> 'incomplete' THEN abs(med - 0.25) END AS timestamp_step_error FROM s""",
)
def v1(t):
    return qu.validate_tasks(*v1_inputs(t), "task", 0.25, tile=row_tile("idx", TILE))


@query(
    "v2_required_splits",
    f"""WITH {PREDICTIONS_SQL}, p AS (SELECT * EXCLUDE (split), CASE WHEN split = 'val' AND CAST(substr(subject, 2) AS BIGINT) % 4 = 0 THEN 'train' ELSE split END AS split FROM predictions)
    SELECT run_name, subject, CASE WHEN count(*) FILTER (split = 'test') = 0 AND count(*) FILTER (split = 'val') = 0 THEN 'test,val' WHEN count(*) FILTER (split = 'test') = 0 THEN 'test' WHEN count(*) FILTER (split = 'val') = 0 THEN 'val' ELSE '' END AS missing_splits,
      count(*) FILTER (split = 'test') > 0 AND count(*) FILTER (split = 'val') > 0 AS ok FROM p GROUP BY run_name, subject""",
)
def v2(t):
    """Prediction rows under the whole contract of columns; subjects divisible by four have their validation rows in training."""
    p = t.predictions().withColumn("model_family", F.lit("probe")).withColumn("source_index", F.monotonically_increasing_id())
    p = p.withColumn("window_id", F.col("source_index")).withColumn("base_subject_id", F.col("subject"))
    qu.require_columns(p, qu.PREDICTION_COLUMNS)
    moved = (F.col("split") == "val") & (F.substring("subject", 2, 9).cast("long") % 4 == 0)
    return qu.split_presence(p.withColumn("split", F.when(moved, "train").otherwise(F.col("split"))), ["run_name", "subject"])


READY_SQL = FRAMES_SQL + """, prs AS (SELECT a.window_id, a.frame_idx, a.subject, a.y, a.px AS lv, b.px AS rv FROM frames a JOIN frames b ON a.window_id = b.window_id AND a.frame_idx = 9 - b.frame_idx)"""


def ready_pairs(t):
    """Every frame with the one that stands as far from its window's other end."""
    f = t.frames()
    b = f.select("window_id", (9 - F.col("frame_idx")).alias("frame_idx"), F.col("px").alias("rv"))
    return f.select("window_id", "frame_idx", "subject", "y", F.col("px").alias("lv")).join(b, ["window_id", "frame_idx"])


@query(
    "v3_pair_readiness",
    f"""WITH {READY_SQL} SELECT subject, count(*) AS n_pairs, CAST(sum(y) AS BIGINT) AS n_stress, min(len(lv)) AS left_dim, min(len(rv)) AS right_dim,
    count(*) FILTER (len(list_filter(lv, lambda x: isnan(x) OR isinf(x))) > 0) AS left_not_finite, count(*) FILTER (len(list_filter(rv, lambda x: isnan(x) OR isinf(x))) > 0) AS right_not_finite FROM prs GROUP BY subject""",
)
def v3(t):
    return qu.pair_readiness(ready_pairs(t), "subject", "y", "lv", "rv")


@query(
    "v3_probe_sample",
    f"""WITH {READY_SQL}, p AS (SELECT window_id, frame_idx, subject, y, row_number() OVER (ORDER BY window_id, frame_idx) - 1 AS position, count(*) OVER () AS n FROM prs),
    w AS (SELECT DISTINCT CAST(round_even(i * (n - 1.0) / (least(10, n) - 1), 0) AS BIGINT) AS position FROM (SELECT max(n) AS n FROM p), range(10) r(i) WHERE i < n)
    SELECT window_id, frame_idx, subject, CAST(y AS BIGINT) AS y, position, true AS left_finite, true AS right_finite FROM p SEMI JOIN w USING (position)""",
)
def v3_probe(t):
    return qu.probe_pairs(ready_pairs(t), ["window_id", "frame_idx"], 10, "lv", "rv")


@query("v4_fail_fast", "SELECT l_orderkey, l_quantity FROM lineitem")
def v4(t):
    li = t.lineitem.select("l_orderkey", "l_quantity")
    return qu.fail_fast(li, F.col("l_quantity") < 0, F.concat(F.lit("negative quantity in order "), F.col("l_orderkey").cast("string")))
