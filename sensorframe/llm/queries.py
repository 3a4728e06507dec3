"""One registered query per operator, over whole tables and with production settings, and its SQL twin where there is one."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.llm.html_text import extract_text
from sensorframe.llm.licenses import scan_licenses
from sensorframe.llm.manifest import build_manifest, digest, field, fold, proof_digest
from sensorframe.llm.mixing import mix_sources
from sensorframe.llm.neighbours import nearest
from sensorframe.llm.ngram_join import jaccard_components
from sensorframe.llm.packing import pack
from sensorframe.llm.pii import find_spans
from sensorframe.llm.quality import judge_quality, train_quality
from sensorframe.llm.runs import periodic_runs
from sensorframe.llm.substring import drop_repeats
from sensorframe.llm.suffixes import drop_repeated_bytes
from sensorframe.llm.tagger import KINDS
from sensorframe.llm.urls import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return wrap


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query(
    "op7_ngram_jaccard_join",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM documents),
    s AS (
      SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (
      SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
      WHERE 100 * both_have >= 80 * (a.n + b.n - both_have)),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
    JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: five-word shingles, similarity 0.8 or more."""
    return jaccard_components(_read(spark, sf_dir, "documents"))


@query(
    "op8_substring_dedup",
    r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    g AS (
      SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
    f AS (SELECT g, min(doc_id) AS first_doc FROM g GROUP BY g),
    c AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS i FROM g JOIN f ON f.g = g.g WHERE f.first_doc < g.doc_id),
    a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
    k AS (SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.i) AS kept FROM a LEFT JOIN c ON c.doc_id = a.doc_id AND c.i = a.i WHERE c.i IS NULL GROUP BY a.doc_id),
    r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
    FROM w LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 13-word passages that a document with a smaller id holds."""
    kept = drop_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    pieces = pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, probability and verdict for every document."""
    docs = _read(spark, sf_dir, "documents")
    return judge_quality(docs, train_quality(docs, _read(spark, sf_dir, "labels")))


@query("op4_url_filters")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: rules first, else the classifier."""
    return judge_urls(_read(spark, sf_dir, "pages"))


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document. Counts and digest are of the patterns' spans; ``spans`` also lists those that the tagger adds."""
    found = find_spans(_read(spark, sf_dir, "documents"))
    listed = "concat_ws(',', transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)))"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    base = F.expr(listed.format("filter(spans, s -> s.base)"))
    return found.select("doc_id", *counts, F.sha2(F.encode(base, "utf-8"), 256).alias("base_sha256"), F.expr(listed.format("spans")).alias("spans"))


@query("op6_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every row whose id is divisible by 20, among all rows."""
    return nearest(_read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op2_license_scans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license text or notice in every document, with its coverage."""
    return scan_licenses(_read(spark, sf_dir, "documents"))


@query(
    "op3_mixing",
    r"""
    WITH RECURSIVE f AS (
      SELECT doc_id, source, coalesce('=' || source, 'null') AS s, coalesce(CAST(doc_id AS VARCHAR), 'null') AS d,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS tokens FROM documents),
    g AS (SELECT s, CAST(sum(tokens) AS BIGINT) AS every, count(*) AS n FROM f GROUP BY s HAVING sum(tokens) > 0),
    p AS (SELECT *, every / CAST((SELECT sum(every) FROM g) AS DOUBLE) AS share FROM g),
    b(i, lo, hi, l) AS (
      SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), (SELECT list(share) FROM p)
      UNION ALL
      SELECT i + 1, CASE WHEN most > 2 THEN mid ELSE lo END, CASE WHEN most > 2 THEN hi ELSE mid END, l
      FROM (SELECT i, lo, hi, l, (lo + hi) / 2 AS mid,
              list_max(list_transform(l, lambda x: pow(x, (lo + hi) / 2) / x)) / list_sum(list_transform(l, lambda x: pow(x, (lo + hi) / 2))) AS most FROM b WHERE i < 42)),
    t AS (SELECT CASE WHEN 1 / (len(l) * list_min(l)) <= 2 THEN 0 ELSE hi END AS t FROM b WHERE i = 42),
    q0 AS (SELECT s, every, n, pow(share, t) AS w FROM p, t),
    q1 AS (SELECT s, every, greatest(CAST(round(w * ((SELECT sum(every) FROM g) / (SELECT sum(w) FROM q0))) AS BIGINT), 1) AS quota, (n + 511) // 512 AS blocks FROM q0),
    q AS (SELECT *, quota // every AS whole, quota % every AS rest FROM q1),
    d AS (
      SELECT f.*, q.every, q.quota, q.whole, q.rest, CAST('0x' || substr(md5('17|' || f.s || '|' || d), 1, 12) AS BIGINT) % blocks AS block,
        CAST('0x' || substr(md5('17|place|' || f.s || '|' || d), 1, 12) AS BIGINT) AS spot FROM f JOIN q USING (s)),
    k0 AS (SELECT s, block, whole, rest, sum(tokens) AS tokens FROM d GROUP BY ALL),
    k1 AS (SELECT *, sum(tokens) OVER (PARTITION BY s ORDER BY CAST('0x' || substr(md5('17|turn|' || s || '|' || block || '|' || whole), 1, 12) AS BIGINT), block) - tokens AS before FROM k0),
    k AS (SELECT *, greatest(least(rest - before, tokens), 0) AS take FROM k1),
    c0 AS (
      SELECT d.s, d.block, d.spot, k.take, coalesce(sum(d.tokens) OVER (PARTITION BY d.s, d.block ORDER BY d.spot RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS drawn
      FROM d JOIN k ON k.s = d.s AND k.block = d.block WHERE k.take > 0 AND k.take < k.tokens),
    c AS (SELECT s, block, max(spot) AS cut FROM c0 WHERE drawn < take GROUP BY s, block),
    r AS (
      SELECT d.doc_id, d.source, d.block, d.every, d.quota, k.before,
        d.whole + CASE WHEN d.spot <= CASE WHEN k.take <= 0 THEN -1 WHEN k.take < k.tokens THEN coalesce(c.cut, -1) ELSE 281474976710656 END THEN 1 ELSE 0 END AS copies
      FROM d JOIN k ON k.s = d.s AND k.block = d.block LEFT JOIN c ON c.s = d.s AND c.block = d.block),
    e AS (SELECT *, unnest(range(copies)) AS epoch FROM r WHERE copies > 0)
    SELECT doc_id, source, CAST(epoch AS BIGINT) AS mix_epoch, CAST(block AS BIGINT) AS mix_block,
      least(CAST(epoch * every + before AS DOUBLE) / CAST(quota AS DOUBLE), 1.0) AS mix_place FROM e
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens spent again on evened-out sources: none repeats more than twice."""
    mixed = mix_sources(_read(spark, sf_dir, "documents"), budget="total", most_repeats=2.0)
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_place")


def plant(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by the crc32 of its id repeats one of its phrases to its end; null ids stay as they are."""
    if doc_id is None or not words:
        return words
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return words
    a, n = g % len(words), len(words)
    phrase = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (phrase * (-(-(n - a) // len(phrase))))[: n - a]


#: Unsigned crc32 of a decimal number's text ``{}``, bit by bit.
CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"""


def _leaf_sql(text: str) -> str:
    names = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in names) + ")"


@query(
    "op12_merkle_manifest",
    f"""
    WITH RECURSIVE d AS (
      SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS g, {_leaf_sql("text")} AS leaf,
        CASE WHEN {CRC32.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS forged FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM d),
    t(g, lvl, i, h, m) AS (
      SELECT g, 0, i, leaf, m FROM r
      UNION ALL SELECT g, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((m + 2) // 3) FROM t WHERE m > 1 GROUP BY g, lvl, i // 3),
    s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM t WHERE m = 1),
    u(lvl, i, h, m) AS (
      SELECT 0, i, subroot, m FROM s
      UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((m + 2) // 3) FROM u WHERE m > 1 GROUP BY lvl, i // 3),
    ts AS (
      SELECT a.g, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
      FROM t a JOIN t b ON a.g = b.g AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.m > 1 GROUP BY ALL),
    us AS (
      SELECT a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
      FROM u a JOIN u b ON a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.m > 1 GROUP BY ALL),
    f(id, g, lvl, i, cur, proof) AS (
      SELECT id, g, 0, i, forged, '' FROM r
      UNION ALL SELECT f.id, f.g, f.lvl + 1, f.i // 3, sha256(ts.l || f.cur || ts.r), f.proof || ts.l || ts.r FROM f JOIN ts ON ts.g = f.g AND ts.lvl = f.lvl AND ts.i = f.i),
    e AS (SELECT id, g, arg_max(cur, lvl) AS cur, arg_max(proof, lvl) AS proof FROM f GROUP BY id, g),
    v(id, lvl, i, cur, proof) AS (
      SELECT e.id, 0, s.i, e.cur, e.proof FROM e JOIN s ON s.g = e.g
      UNION ALL SELECT v.id, v.lvl + 1, v.i // 3, sha256(us.l || v.cur || us.r), v.proof || us.l || us.r FROM v JOIN us ON us.lvl = v.lvl AND us.i = v.i),
    w AS (SELECT id, arg_max(cur, lvl) AS folded, arg_max(proof, lvl) AS proof FROM v GROUP BY id)
    SELECT d.doc_id, d.leaf, s.subroot, u.h AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = u.h AS verified
    FROM d JOIN s ON s.g = d.g JOIN w ON w.id = d.id JOIN u ON u.m = 1
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, and which rows verify once the line breaks of every second one are gone."""
    docs = _read(spark, sf_dir, "documents")

    def leaf(text):
        return digest(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)])

    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    forged = F.when(tampered, leaf(F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf(F.col("text")))
    rows = build_manifest(docs, leaf(F.col("text")), F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "_forged": forged})
    folded = rows.withColumn("folded_root", fold(F.col("_forged"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _runs_sql(levels: int = 20) -> str:
    """Runs by equal grams: inside a run of period d a gram of d to 3 d words occurs again exactly d words on."""
    out = ["g0 AS MATERIALIZED (SELECT id, i, dense_rank() OVER (ORDER BY w) AS c FROM x)"]
    for k in range(1, levels):
        out.append(
            f"g{k} AS MATERIALIZED (SELECT id, i, dense_rank() OVER (ORDER BY c, e) AS c FROM "
            f"(SELECT *, lead(c, {1 << (k - 1)}) OVER (PARTITION BY id ORDER BY i) AS e FROM g{k - 1}) WHERE e IS NOT NULL)"
        )
    for k in range(levels):
        out.append(
            f"m{k} AS (SELECT id, i, j - i AS d, {1 << k} AS g FROM (SELECT id, i, lead(i) OVER (PARTITION BY id, c ORDER BY i) AS j FROM g{k}) "
            f"WHERE j - i <= {1 << k} AND {1 << k} <= 3 * (j - i))"
        )
    return ",\n    ".join(out)


@query(
    "op11_periodic_runs",
    f"""
    WITH d AS (
      SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
        {CRC32.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
    p0 AS (SELECT id, doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, h // 10 AS g, (h // 10) % greatest(len(ws), 1) AS a FROM d),
    p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM p0),
    x AS MATERIALIZED (
      SELECT id, i, ws[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS w
      FROM (SELECT *, unnest(range(n)) AS i FROM p WHERE n > 0)),
    {_runs_sql()},
    m AS (SELECT *, i - row_number() OVER (PARTITION BY id, g, d ORDER BY i) AS isle FROM ({" UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(20))})),
    r AS (
      SELECT DISTINCT id, s, l, d FROM (SELECT id, min(i) AS s, count(*) + d + g - 1 AS l, d FROM m GROUP BY id, g, d, isle)
      WHERE l >= greatest(6, 4 * d)),
    gone AS (SELECT DISTINCT id, unnest(range(s + d, s + l)) AS i FROM r),
    k AS (SELECT x.id, string_agg(x.w, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN gone ON gone.id = x.id AND gone.i = x.i GROUP BY x.id),
    a AS (SELECT id, count(*) AS n, string_agg(s || ',' || l || ',' || d || chr(10), '' ORDER BY s, d) AS listed FROM r GROUP BY id),
    b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY l DESC, s, d) = 1)
    SELECT p.doc_id, coalesce(a.n, 0) AS n_runs, b.s AS start, b.l AS length, b.d AS period, 1000 * b.l // b.d AS exponent_milli,
      sha256(coalesce(a.listed, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
    FROM p LEFT JOIN a ON a.id = p.id LEFT JOIN b ON b.id = p.id LEFT JOIN k ON k.id = p.id
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of six words and four periods or more in every document, a tenth of which repeats a phrase to its end."""
    found = periodic_runs(_read(spark, sf_dir, "documents"), rewrite=plant)
    longest = F.expr("array_min(transform(runs, r -> struct(-r.length as length, r.start as start, r.period as period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    top = found.select("doc_id", "runs", "collapsed", longest.alias("top"), listed.alias("listed"))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        (-F.col("top.length")).alias("length"),
        "top.period",
        F.expr("1000 * -top.length div top.period").alias("exponent_milli"),
        F.sha2(F.encode("listed", "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )


@query(
    "op13_suffix_dedup",
    """
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, encode(coalesce(text, '')) AS b FROM documents),
    w AS MATERIALIZED (
      SELECT id, i, md5(b[i:i + 399]) AS h FROM (SELECT id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d WHERE octet_length(b) >= 400)),
    r AS MATERIALIZED (SELECT id, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
    s0 AS (SELECT *, lag(i) OVER (PARTITION BY id ORDER BY i) AS p FROM r),
    s1 AS (SELECT *, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS span FROM s0),
    s AS (SELECT id, span, min(i) AS a, max(i) + 399 AS z FROM s1 GROUP BY id, span),
    k0 AS (SELECT id, a, coalesce(lag(z) OVER (PARTITION BY id ORDER BY a), 0) + 1 AS f FROM s
           UNION ALL SELECT id, max(octet_length(b)) + 1, coalesce(max(z), 0) + 1 FROM d LEFT JOIN s USING (id) GROUP BY id),
    k AS (SELECT k0.id, unhex(string_agg(hex(b[f:a - 1]), '' ORDER BY f)) AS kept FROM k0 JOIN d ON d.id = k0.id AND a > f GROUP BY k0.id),
    c AS (SELECT id, count(*) AS n, CAST(sum(z - a + 1) AS BIGINT) AS gone FROM s GROUP BY id)
    SELECT d.doc_id, octet_length(d.b) AS n_bytes, coalesce(c.gone, 0) AS n_removed, coalesce(c.n, 0) AS n_spans,
      sha256(coalesce(k.kept, encode(''))) AS kept_sha256
    FROM d LEFT JOIN c USING (id) LEFT JOIN k USING (id)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that start elsewhere too."""
    kept = drop_repeated_bytes(_read(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.length)").alias("n_removed")
    return kept.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
