"""Registered queries: entity resolution."""

from pyspark.sql import functions as F

from sensorframe.catalog.registry import query
from sensorframe.operators import resolve as re_

RES_SQL = """files AS (SELECT 'G' || (c_custkey % 5) AS grp, 'c' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN 'v2' ELSE '' END AS stem,
    CASE WHEN c_custkey % 11 <> 0 THEN CAST(floor(800000000 + c_acctbal * 10000) AS BIGINT) END AS first_time FROM customer),
  cx0 AS (SELECT 'G' || (c_custkey % 5) AS grp, 'p' || c_custkey AS participant_id, 'c' || c_custkey || CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN 'v2' ELSE '' END AS stem,
    CASE c_custkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'false' ELSE 'YES' END AS approved, CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'low' END AS confidence
    FROM customer WHERE c_custkey % 7 <> 0),
  crosswalk AS (SELECT * FROM cx0 UNION ALL SELECT * FROM cx0 WHERE CAST(substr(participant_id, 2) AS BIGINT) % 5 = 0),
  approved AS (SELECT DISTINCT grp, participant_id, stem, confidence FROM crosswalk WHERE lower(approved) IN ('true', '1', 'yes')),
  mapped AS (SELECT files.*, participant_id, confidence FROM files LEFT JOIN approved USING (grp, stem)),
  manifest AS (SELECT 'G' || (o_custkey % 5) AS grp, 'p' || o_custkey AS pid, CASE WHEN o_orderkey % 2 = 0 THEN 'c' || o_custkey ELSE 'n' || o_orderkey END AS norm,
    CASE WHEN o_orderkey % 4 < 2 THEN 'front' WHEN o_orderkey % 4 = 3 THEN 'side' END AS view_type, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS ts,
    'depth_' || o_orderkey || '.h5' AS file_name, o_orderkey % 3 = 0 AS second FROM orders)"""

PAIRS_SQL = RES_SQL + """, pairs AS (SELECT m.*, f.stem, f.participant_id, f.first_time FROM mapped f JOIN manifest m ON f.grp = m.grp AND (f.participant_id = m.pid OR f.stem = m.norm)
    WHERE f.participant_id IS NOT NULL)"""

NEAREST_SQL = PAIRS_SQL + """, ranked AS (SELECT *, abs(ts - first_time) AS gap, count(*) OVER (PARTITION BY grp, stem) AS total, count(*) OVER (PARTITION BY grp, stem, view_type) AS per_view,
    row_number() OVER (PARTITION BY grp, stem, view_type ORDER BY abs(ts - first_time) NULLS LAST, file_name) AS rk
    FROM (SELECT * REPLACE (coalesce(view_type, '') AS view_type) FROM pairs)),
  sessions AS (SELECT grp, stem, view_type, file_name, gap AS session_time_diff_seconds, total AS session_candidate_count_total, per_view AS session_candidate_count_for_view,
    rk AS session_candidate_rank_for_view, per_view - 1 AS session_dropped_candidate_count_for_view, coalesce(gap <= 2592000, false) AS session_within_threshold FROM ranked WHERE rk = 1)"""


def files(t):
    k = F.col("c_custkey")
    return t.customer.select(
        F.concat(F.lit("G"), (k % 5).cast("string")).alias("grp"),
        F.concat(F.lit("c"), k.cast("string"), F.when(k % 4 == 0, "v2").otherwise("")).alias("stem"),
        F.when(k % 11 != 0, F.floor(F.lit(800000000) + F.col("c_acctbal") * 10000).cast("long")).alias("first_time"),
    )


def crosswalk(t):
    k = F.col("c_custkey")
    c = t.customer.where(k % 7 != 0).select(
        F.concat(F.lit("G"), (k % 5).cast("string")).alias("grp"),
        F.concat(F.lit("p"), k.cast("string")).alias("participant_id"),
        F.concat(F.lit("c"), k.cast("string"), F.when((k % 4 == 0) & (k % 8 != 0), "v2").otherwise("")).alias("stem"),
        F.when(k % 3 == 0, "True").when(k % 3 == 1, "false").otherwise("YES").alias("approved"),
        F.when(k % 2 == 0, "high").otherwise("low").alias("confidence"),
    )
    again = c.where(F.substring("participant_id", 2, 20).cast("long") % 5 == 0)
    return c.unionByName(again)


def mapped(t):
    keys = ["grp", "stem"]
    return re_.map_files(files(t), re_.approved_mapping(crosswalk(t), keys), keys)


def manifest(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        F.concat(F.lit("G"), (c % 5).cast("string")).alias("grp"),
        F.concat(F.lit("p"), c.cast("string")).alias("pid"),
        F.when(o % 2 == 0, F.concat(F.lit("c"), c.cast("string"))).otherwise(F.concat(F.lit("n"), o.cast("string"))).alias("norm"),
        F.when(o % 4 < 2, "front").when(o % 4 == 3, "side").alias("view_type"),
        F.when(o % 13 != 0, F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000000).cast("long").alias("ts"),
        F.concat(F.lit("depth_"), o.cast("string"), F.lit(".h5")).alias("file_name"),
        (o % 3 == 0).alias("second"),
    )


def sessions(t):
    known = mapped(t).where(F.col("participant_id").isNotNull())
    return re_.nearest_sessions(
        known, manifest(t), "grp", "stem", ("participant_id", "stem"), ("pid", "norm"), "view_type", "first_time", "ts", "file_name", 30 * 86400
    )


@query("j1_left_mapping", f"WITH {RES_SQL} SELECT * FROM mapped")
def j1(t):
    return mapped(t)


@query(
    "j2_override_join",
    f"""WITH {RES_SQL}, o(grp, stem, ov) AS (VALUES ('G2', 'c7', 'x7'), ('G4', 'c14', 'x14'), ('G3', 'c3', 'x3'))
    SELECT grp, stem, first_time, coalesce(participant_id, ov) AS participant_id, CASE WHEN participant_id IS NULL AND ov IS NOT NULL THEN 'manual_override' ELSE confidence END AS confidence
    FROM mapped LEFT JOIN o USING (grp, stem)""",
)
def j2(t):
    fixed = [("G2", "c7", "x7"), ("G4", "c14", "x14"), ("G3", "c3", "x3")]
    return re_.apply_overrides(mapped(t), fixed, ["grp", "stem"], "participant_id", "confidence", "manual_override")


@query("j3_or_key_join", f"WITH {PAIRS_SQL} SELECT grp, stem, participant_id, pid, norm, file_name FROM pairs")
def j3(t):
    known = mapped(t).where(F.col("participant_id").isNotNull())
    got = re_.or_key_join(known, manifest(t), "grp", ("participant_id", "stem"), ("pid", "norm"))
    return got.select("grp", "stem", "participant_id", "pid", "norm", "file_name")


@query(
    "j4_suffix_fallback",
    f"""WITH {RES_SQL}, b AS (SELECT *, substr(stem, 1, length(stem) - 2) AS base_stem FROM mapped WHERE participant_id IS NULL AND stem LIKE '%v2'),
    h AS (SELECT b.grp, b.stem, b.base_stem, m.pid, m.file_name, m.second, bool_or(m.second) OVER (PARTITION BY b.grp, b.stem) AS any2
          FROM b JOIN manifest m ON b.grp = m.grp AND (b.base_stem = m.pid OR b.base_stem = m.norm))
    SELECT grp, stem, base_stem, pid, file_name, second FROM h WHERE second OR NOT any2""",
)
def j4(t):
    unmapped = mapped(t).where(F.col("participant_id").isNull()).select("grp", "stem")
    got = re_.session2_fallback(unmapped, manifest(t), "grp", "stem", "pid", "norm", "second")
    return got.select("grp", "stem", "base_stem", "pid", "file_name", "second")


@query(
    "j5_missing_report",
    f"""WITH {PAIRS_SQL} SELECT grp, stem, 'no_approved_mapping' AS issue FROM mapped WHERE participant_id IS NULL
    UNION ALL SELECT grp, stem, 'approved_mapping_but_no_manifest_rows' FROM mapped m WHERE participant_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.grp = m.grp AND p.stem = m.stem)""",
)
def j5(t):
    m = mapped(t)
    known = m.where(F.col("participant_id").isNotNull())
    keys = ["grp", "stem"]
    a = re_.missing_mapping(m.select(*keys), known, keys, "no_approved_mapping")
    hit = re_.or_key_join(known, manifest(t), "grp", ("participant_id", "stem"), ("pid", "norm"))
    b = re_.missing_mapping(known.select(*keys), hit, keys, "approved_mapping_but_no_manifest_rows")
    return a.unionByName(b)


@query("j6_nearest_session", f"WITH {NEAREST_SQL} SELECT * FROM sessions")
def j6(t):
    return sessions(t)


@query(
    "a6_mapping_summary",
    f"""WITH {NEAREST_SQL}, s AS (SELECT count(*) AS a, count(DISTINCT grp || stem) AS b, coalesce(sum(session_dropped_candidate_count_for_view), 0) AS c,
      count(*) FILTER (NOT session_within_threshold) AS d FROM sessions)
    SELECT 'num_session_manifest_rows' AS metric, CAST(a AS BIGINT) AS value FROM s UNION ALL SELECT 'num_unique_files_with_sessions', CAST(b AS BIGINT) FROM s
    UNION ALL SELECT 'num_duplicate_candidates_dropped', CAST(c AS BIGINT) FROM s UNION ALL SELECT 'num_session_rows_outside_threshold', CAST(d AS BIGINT) FROM s""",
)
def a6(t):
    return re_.mapping_summary(
        sessions(t),
        {
            "num_session_manifest_rows": F.count(F.lit(1)),
            "num_unique_files_with_sessions": F.countDistinct("grp", "stem"),
            "num_duplicate_candidates_dropped": F.coalesce(F.sum("session_dropped_candidate_count_for_view"), F.lit(0)),
            "num_session_rows_outside_threshold": F.count_if(~F.col("session_within_threshold")),
        },
    )


@query(
    "p22_suggestions",
    f"""WITH {RES_SQL}, miss AS (SELECT DISTINCT grp, stem FROM mapped WHERE participant_id IS NULL),
    h AS (SELECT m.grp, m.stem, CASE WHEN c.stem = m.stem THEN 1 WHEN c.participant_id = m.stem THEN 2 WHEN starts_with(c.stem, substr(m.stem, 1, 3)) THEN 3 ELSE 4 END AS tier,
                 c.participant_id, c.stem AS proposed, c.approved, c.confidence FROM miss m JOIN crosswalk c ON c.grp = m.grp),
    b AS (SELECT *, min(tier) OVER (PARTITION BY grp, stem) AS best,
                 row_number() OVER (PARTITION BY grp, stem, tier ORDER BY participant_id, proposed, approved, confidence) AS r FROM h)
    SELECT grp, stem, CAST(tier AS BIGINT) AS tier, participant_id,
           '{{"participant_id":"' || participant_id || '","proposed":"' || proposed || '","approved":"' || approved || '","confidence":"' || confidence || '"}}' AS suggestion
    FROM b WHERE tier = best AND (tier < 3 OR r <= 10)""",
)
def p22(t):
    missing = mapped(t).where(F.col("participant_id").isNull())
    cand = crosswalk(t).select("grp", "participant_id", F.col("stem").alias("proposed"), "approved", "confidence")
    return re_.suggestions(missing, cand, "grp", "stem", "participant_id", "proposed", top=10)


@query(
    "p23_existence_issue",
    f"""WITH {RES_SQL}, inv AS (SELECT 'd/' || file_name AS path FROM manifest WHERE NOT second UNION ALL SELECT 'r/' || file_name FROM manifest WHERE view_type = 'front'),
    s AS (SELECT file_name, 'd/' || file_name AS depth_path, 'r/' || file_name AS rgb_path FROM manifest)
    SELECT * FROM (SELECT *, CASE WHEN depth_path NOT IN (SELECT path FROM inv) AND rgb_path NOT IN (SELECT path FROM inv) THEN 'missing_depth_and_rgb'
      WHEN depth_path NOT IN (SELECT path FROM inv) THEN 'missing_depth_file' WHEN rgb_path NOT IN (SELECT path FROM inv) THEN 'missing_rgb_file' END AS issue FROM s) WHERE issue IS NOT NULL""",
)
def p23(t):
    m = manifest(t)
    d, r = F.concat(F.lit("d/"), "file_name"), F.concat(F.lit("r/"), "file_name")
    inv = m.where(~F.col("second")).select(d.alias("path")).unionByName(m.where(F.col("view_type") == "front").select(r.alias("path")))
    s = m.select("file_name", d.alias("depth_path"), r.alias("rgb_path"))
    return re_.existence_issue(s, inv, "depth_path", "rgb_path").select("file_name", "depth_path", "rgb_path", "issue")
