"""Registered queries: scalar functions, shaping, set operations, sources."""

from pyspark.sql import functions as F

from sensorframe.catalog.registry import query
from sensorframe.functions import scalars as sc
from sensorframe.operators import shape
from sensorframe.operators.ordered import dense_ids
from sensorframe.sources import io
from sensorframe.sources.tables import FRAMES_SQL


@query("s1_projected_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity >= 40")
def s1(t):
    return io.projected(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_extendedprice", "l_quantity"]).where(
        F.col("l_quantity") >= 40
    ).drop("l_quantity")


@query(
    "s4_store_catalogue",
    f"""WITH {FRAMES_SQL}, s AS (SELECT 'enc' || (window_id % 3) AS encoder, 'feat' || (window_id % 2) AS feature, * FROM frames),
    meta AS (SELECT DISTINCT encoder, feature FROM s WHERE window_id % 5 = 1)
    SELECT encoder, feature, count(DISTINCT window_id) AS num_windows, count(*) AS num_frames, CAST(max(len(px)) AS BIGINT) AS embedding_dim,
           count(DISTINCT frame_idx) AS frames_per_window FROM s SEMI JOIN meta USING (encoder, feature) GROUP BY encoder, feature""",
)
def s4(t):
    w = F.col("window_id")
    s = t.frames().withColumn("encoder", F.concat(F.lit("enc"), (w % 3).cast("string"))).withColumn(
        "feature", F.concat(F.lit("feat"), (w % 2).cast("string"))
    )
    return io.store_catalogue(s, s.where(w % 5 == 1), ["encoder", "feature"], "px", "window_id", "frame_idx")


@query(
    "s8_dead_letters",
    """SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity > 45 THEN 'too_large' WHEN l_discount = 0 THEN 'no_discount' WHEN l_returnflag = 'N' THEN 'not_returned' END AS skip_reason
    FROM lineitem WHERE l_quantity > 45 OR l_discount = 0 OR l_returnflag = 'N'""",
)
def s8(t):
    rules = [
        (F.col("l_quantity") > 45, "too_large"),
        (F.col("l_discount") == 0, "no_discount"),
        (F.col("l_returnflag") == "N", "not_returned"),
    ]
    _, bad = io.dead_letters(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"), rules)
    return bad.select("l_orderkey", "l_linenumber", "l_quantity", "skip_reason")


@query(
    "s9_multi_run_union",
    """SELECT l_suppkey AS k, count(*) AS n, CAST(NULL AS DOUBLE) AS top, 'run_O' AS run_dir FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1
    UNION ALL SELECT l_suppkey, count(*), max(l_extendedprice), 'run_F' FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1""",
)
def s9(t):
    li = t.lineitem
    k = F.col("l_suppkey").alias("k")
    a = li.where(F.col("l_linestatus") == "O").groupBy(k).agg(F.count(F.lit(1)).alias("n"))
    b = li.where(F.col("l_linestatus") == "F").groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("top"))
    return io.union_runs({"run_O": a, "run_F": b})


@query(
    "s10_hash_shard",
    "SELECT c_name, CAST('0x' || substr(md5(c_name), 1, 12) AS BIGINT) % 7 AS shard FROM customer",
)
def s10(t):
    return io.shard(t.customer.select("c_name"), "c_name", 7)


@query(
    "s12_boundaries_long",
    """SELECT o_orderkey, 'jelly' AS task, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice END AS "start", CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice + 30 END AS "end" FROM orders
    UNION ALL SELECT o_orderkey, 'stroop', CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice + 60 END, CASE WHEN o_custkey % 3 <> 0 THEN o_totalprice + 90 END FROM orders""",
)
def s12(t):
    c, p = F.col("o_custkey"), F.col("o_totalprice")
    absent = F.lit(-1.0)
    wide = t.orders.select(
        "o_orderkey",
        F.when(c % 5 != 0, p).otherwise(absent).alias("start_jelly"),
        F.when(c % 5 != 0, p + 30).otherwise(absent).alias("end_jelly"),
        F.when(c % 3 != 0, p + 60).otherwise(absent).alias("start_stroop"),
        F.when(c % 3 != 0, p + 90).otherwise(absent).alias("end_stroop"),
    )
    return io.boundaries_long(wide, ["o_orderkey"], ["jelly", "stroop"])


@query(
    "p1_numeric_coercion",
    "SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'x' || user_id WHEN event_id % 7 = 1 THEN '' ELSE user_id || '.5' END AS DOUBLE) AS v FROM events",
)
def p1(t):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    text = F.when(e % 7 == 0, F.concat(F.lit("x"), u)).when(e % 7 == 1, "").otherwise(F.concat(u, F.lit(".5")))
    return t.events.select("event_id", sc.to_number(text).alias("v"))


@query("p2_label_default", "SELECT event_id, coalesce(CASE WHEN event_type <> 'signup' THEN event_type END, 'None') AS label FROM events")
def p2(t):
    return t.events.select("event_id", F.coalesce(F.when(F.col("event_type") != "signup", F.col("event_type")), F.lit("None")).alias("label"))


@query(
    "p3_lenient_boolean",
    "SELECT c_custkey, coalesce(lower(CASE c_custkey % 6 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'yes' WHEN 2 THEN '0' WHEN 3 THEN 'No' WHEN 4 THEN '1' END) IN ('true', '1', 'yes'), false) AS approved FROM customer",
)
def p3(t):
    k = F.col("c_custkey") % 6
    text = F.when(k == 0, "TRUE").when(k == 1, "yes").when(k == 2, "0").when(k == 3, "No").when(k == 4, "1")
    return t.customer.select("c_custkey", sc.truthy(text).alias("approved"))


@query(
    "p4_canonical_subject",
    """WITH s AS (SELECT c_custkey, 'p' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN 'v2' WHEN 1 THEN 'v10' WHEN 2 THEN 'V2' ELSE '' END AS id FROM customer)
    SELECT c_custkey, regexp_replace(id, 'v\\d+$', '') AS by_suffix, regexp_replace(id, '[vV]2$', '') AS by_v2 FROM s""",
)
def p4(t):
    k = F.col("c_custkey")
    suffix = F.when(k % 4 == 0, "v2").when(k % 4 == 1, "v10").when(k % 4 == 2, "V2").otherwise("")
    sid = F.concat(F.lit("p"), k.cast("string"), suffix)
    return t.customer.select("c_custkey", sc.canonical_id(sid).alias("by_suffix"), sc.canonical_id(sid, "v2").alias("by_v2"))


@query(
    "p5_label_mapping",
    "SELECT event_id, CAST(CASE WHEN event_type IN ('view', 'click') THEN 0 WHEN event_type IN ('purchase', 'error') THEN 1 END AS BIGINT) AS y FROM events",
)
def p5(t):
    return t.events.select("event_id", sc.binary_label(F.col("event_type"), ("view", "click"), ("purchase", "error")).alias("y"))


@query(
    "p6_filename_timestamp",
    """WITH n AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'cam_20241345_250000_a.h5' WHEN event_id % 9 = 1 THEN 'cam.h5' ELSE 'cam_' || strftime(ts, '%Y%m%d_%H%M%S') || '_a.h5' END AS name FROM events)
    SELECT event_id, epoch(try_strptime(regexp_extract(name, '(\\d{8}_\\d{6})', 1), '%Y%m%d_%H%M%S')) AS epoch_s FROM n""",
)
def p6(t):
    e = F.col("event_id")
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    name = F.when(e % 9 == 0, "cam_20241345_250000_a.h5").when(e % 9 == 1, "cam.h5").otherwise(F.concat(F.lit("cam_"), stamp, F.lit("_a.h5")))
    return t.events.select("event_id", sc.filename_epoch(name).alias("epoch_s"))


@query("p7_path_rebase", "SELECT page_id, '/data/rgb/' || string_split(url, '/')[-1] AS rgb_path FROM pages")
def p7(t):
    return t.pages.select("page_id", sc.rebase_path(F.col("url"), "/data/rgb").alias("rgb_path"))


@query(
    "p8_safe_name",
    """WITH c AS (SELECT page_id, url, regexp_replace(regexp_replace(CASE WHEN page_id % 10 = 0 THEN '///' ELSE url END, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM pages)
    SELECT page_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS safe, regexp_replace(url, '[^\\pL\\pN_-]', '_', 'g') AS slug FROM c""",
)
def p8(t):
    raw = F.when(F.col("page_id") % 10 == 0, "///").otherwise(F.col("url"))
    return t.pages.select("page_id", sc.safe_name(raw).alias("safe"), sc.slug(F.col("url")).alias("slug"))


@query(
    "p9_composite_key",
    "SELECT o_orderkey, concat_ws('__', o_orderstatus, 'c' || o_custkey, printf('%02d', o_orderkey % 150)) AS task_record_id FROM orders",
)
def p9(t):
    return t.orders.select(
        "o_orderkey",
        sc.record_key(F.col("o_orderkey") % 150, F.col("o_orderstatus"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias(
            "task_record_id"
        ),
    )


@query(
    "p12_prefix_flatten",
    """SELECT l_suppkey, min(l_quantity) FILTER (l_linestatus = 'O') AS depth_lo, max(l_quantity) FILTER (l_linestatus = 'O') AS depth_hi,
    min(l_quantity) FILTER (l_linestatus = 'F') AS rgb_lo, max(l_quantity) FILTER (l_linestatus = 'F') AS rgb_hi FROM lineitem GROUP BY l_suppkey""",
)
def p12(t):
    def span(status):
        q = F.when(F.col("l_linestatus") == status, F.col("l_quantity"))
        return F.struct(F.min(q).alias("lo"), F.max(q).alias("hi"))

    nested = t.lineitem.groupBy("l_suppkey").agg(span("O").alias("depth"), span("F").alias("rgb"))
    return shape.flatten(nested, ["depth", "rgb"])


@query("p13_integer_time", "SELECT o_orderkey, o_totalprice - floor(o_totalprice) <= 1e-9 AS whole FROM orders")
def p13(t):
    return t.orders.select("o_orderkey", sc.is_whole(F.col("o_totalprice")).alias("whole"))


STATUS_SQL = """st AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 11 WHEN 0 THEN 'error' WHEN 1 THEN 'not_inspected' WHEN 2 THEN 'missing' WHEN 3 THEN 'partial' ELSE 'complete' END AS d,
  CASE l_suppkey % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'partial' ELSE 'complete' END AS r FROM lineitem), cs AS (
  SELECT *, CASE WHEN 'error' IN (d, r) THEN 'error' WHEN 'not_inspected' IN (d, r) THEN 'not_inspected' WHEN 'missing' IN (d, r) THEN 'missing' WHEN 'partial' IN (d, r) THEN 'partial' ELSE 'complete' END AS status FROM st)"""


def _statuses(t):
    p, s = F.col("l_partkey") % 11, F.col("l_suppkey") % 7
    d = F.when(p == 0, "error").when(p == 1, "not_inspected").when(p == 2, "missing").when(p == 3, "partial").otherwise("complete")
    r = F.when(s == 0, "missing").when(s == 1, "partial").otherwise("complete")
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", d.alias("d"), r.alias("r"))
    return li.withColumn("status", sc.combined_status(F.col("d"), F.col("r")))


@query("p18_status_precedence", f"WITH {STATUS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, status FROM cs")
def p18(t):
    return _statuses(t).select("l_orderkey", "l_linenumber", "l_partkey", "status")


@query(
    "p17_processable",
    f"WITH {STATUS_SQL} SELECT l_orderkey, l_linenumber, l_partkey, status FROM cs WHERE d <> 'missing' AND r <> 'missing' AND status IN ('complete', 'partial')",
)
def p17(t):
    overlap = (F.col("d") != "missing") & (F.col("r") != "missing")
    return _statuses(t).where(sc.processable(overlap, F.col("status"))).select("l_orderkey", "l_linenumber", "l_partkey", "status")


@query("a5_value_counts", f"WITH {STATUS_SQL} SELECT status, count(*) AS count FROM cs GROUP BY status")
def a5(t):
    return shape.value_counts(_statuses(t), "status")


@query(
    "p21_key_filters",
    """SELECT event_id, 'S' || user_id || CASE WHEN event_id % 2 = 0 THEN 'v2' ELSE '' END AS subject, event_type AS task FROM events
    WHERE user_id IN (1, 2, 3, 5, 8) AND event_type IN ('view', 'error') ORDER BY event_id LIMIT 40""",
)
def p21(t):
    s = F.concat(F.lit("S"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "v2").otherwise(""))
    e = t.events.select("event_id", s.alias("subject"), F.col("event_type").alias("task"))
    return shape.select_keys(e, ["S1", "S2", "S3", "S5", "S8"], ["view", "error"], first=40, order=["event_id"])


@query("a4_group_size", "SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS group_size FROM orders")
def a4(t):
    return shape.with_group_size(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"])


@query(
    "t1_text_sort",
    "SELECT c_custkey, row_number() OVER (ORDER BY CAST(c_nationkey AS VARCHAR), CAST(c_custkey AS VARCHAR)) - 1 AS place FROM customer",
)
def t1(t):
    c = t.customer.select("c_custkey", "c_nationkey")
    return dense_ids(c, [F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")], "place").drop("c_nationkey")


@query(
    "t5_evenly_spaced",
    """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders),
    w AS (SELECT DISTINCT CAST(round_even(i * (n - 1.0) / 36, 0) AS BIGINT) AS position FROM (SELECT max(n) AS n FROM p), range(37) r(i))
    SELECT o_orderkey, position FROM p SEMI JOIN w USING (position)""",
)
def t5(t):
    return shape.evenly_spaced(t.orders.select("o_orderkey"), ["o_orderkey"], 37)


@query(
    "t5_offsets_in_window",
    """WITH o AS (SELECT o_orderkey, o_custkey AS s, o_custkey + o_orderkey % 23 AS e FROM orders WHERE o_orderkey % 23 > 0), c AS (SELECT *, e - s AS n, least(6, e - s) AS c FROM o),
    i AS (SELECT *, unnest(range(c)) AS i FROM c)
    SELECT o_orderkey, s + CASE WHEN c > 1 THEN CAST(round_even(i * (n - 1) / (c - 1), 0) AS BIGINT) ELSE 0 END AS frame_index FROM i""",
)
def t5_offsets(t):
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("s"), (F.col("o_custkey") + F.col("o_orderkey") % 23).alias("e"))
    return shape.offsets_in_window(o, "s", "e", 6).select("o_orderkey", "frame_index")


@query(
    "u1_union_by_name",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS bal FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
)
def u1(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u2_distinct", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def u2(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").dropDuplicates()


@query(
    "u3_set_difference",
    "SELECT 'c' || c_custkey AS key FROM customer EXCEPT SELECT 'c' || (o_custkey + CAST(o_custkey % 3 = 0 AS BIGINT)) FROM orders",
)
def u3(t):
    need = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"))
    c = F.col("o_custkey")
    have = t.orders.select(F.concat(F.lit("c"), (c + (c % 3 == 0).cast("long")).cast("string")).alias("key"))
    return shape.set_difference(need, have, "key")


KEYSET_SQL = """l AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), r AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1)"""


@query(
    "u5_key_comparison",
    f"""WITH {KEYSET_SQL} SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.event_type, r.event_type) AS event_type,
    CASE WHEN r.user_id IS NULL THEN 'left_only' WHEN l.user_id IS NULL THEN 'right_only' ELSE 'both' END AS side
    FROM l FULL JOIN r ON l.user_id = r.user_id AND l.event_type = r.event_type""",
)
def u5(t):
    e = t.events
    return shape.compare_keys(e.where(F.col("event_id") % 2 == 0), e.where(F.col("event_id") % 2 == 1), ["user_id", "event_type"])
