"""Nearest neighbours by largest inner product: multiprobe p-stable hashing.

Vectors are dealt into bands of norms, scaled by the largest norm of their band and given one more coordinate that makes
all of length one; queries get a zero there. Then, in a band, the largest inner product is the least Euclidean distance, and Gaussian projections cut into cells of
one width are a p-stable hash. Each table concatenates a few of them. A query visits its own bucket and then buckets
with some cells moved by one, in the order of the squared distances to the cell borders it would have to cross, which is
the order of estimated success. It does so in every band; a band of few vectors is one bucket that all queries visit.
A query that meets fewer than ``k`` vectors so is compared with all vectors of its length.

Vectors and probes meet by table and bucket. A large bucket is dealt out in chunks and its probes in parts, and each part
meets each chunk. Every meeting returns its best exact scores per query; the tables' candidates are merged per query. Of equal vectors only the
``k + 1`` with the smallest ids can be in an answer, so a vector that a third of all rows share costs no more than others.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.store import materialise, release
from sensorframe.llm.words import mix, numbers

#: Tables, hashes per table, probes per table and cell width; set for a recall of 0.95 on weakly clustered unit vectors.
TABLES, HASHES, PROBES, WIDTH = 3, 5, 40, 2.0
#: Vectors, and probes, of a bucket that are held at once.
CHUNK = 4096
#: Norms of one band differ by this factor at most; a band of no more than so many vectors is one bucket.
BAND, WHOLE = 1.5, 256


class _Hashes:
    """The projections of all tables for vectors of one length; equal arguments give equal hashes everywhere."""

    def __init__(self, dims: int, tables: int, hashes: int, width: float, seed: int = 3):
        rng = np.random.default_rng([seed, dims])
        self.width, self.tables, self.hashes = width, tables, hashes
        self.lines = rng.normal(size=(dims, tables * hashes))
        self.shift = rng.uniform(0, width, tables * hashes)
        self.factor = numbers(hashes, 41) | np.uint64(1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.lines + self.shift) / self.width).reshape(len(x), self.tables, self.hashes)

    def key(self, cell: np.ndarray) -> np.ndarray:
        return mix((cell.astype(np.int64).view(np.uint64) * self.factor).sum(-1)).view(np.int64)

    def probes(self, part: np.ndarray, most: int) -> np.ndarray:
        """Moves (probes, hashes) of one query in one table; ``part`` is its place inside each cell, 0 to 1."""
        k = self.hashes
        gap = np.concatenate([part, 1 - part]) ** 2
        order = np.argsort(gap, kind="stable")
        gap = gap[order].tolist()
        sets, heap = [()], [(gap[0], (0,))]
        while heap and len(sets) < most:
            cost, chosen = heapq.heappop(heap)
            if len({order[j] % k for j in chosen}) == len(chosen):
                sets.append(chosen)
            last = chosen[-1]
            if last + 1 < 2 * k:
                heapq.heappush(heap, (cost + gap[last + 1], (*chosen, last + 1)))
                heapq.heappush(heap, (cost - gap[last] + gap[last + 1], (*chosen[:-1], last + 1)))
        moves = np.zeros((len(sets), k), np.int64)
        for row, chosen in enumerate(sets):
            for j in chosen:
                moves[row, order[j] % k] = -1 if order[j] < k else 1
        return moves


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, at: int):
    lengths = np.diff(batch.column(at).offsets.to_numpy()) if len(batch) else np.empty(0, int)
    for n in np.unique(lengths):
        yield int(n), batch.take(pa.array(np.flatnonzero(lengths == n)))


def _packed(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _best(table: pa.Table, k: int) -> pa.Table:
    """Per query of one chunk the ``k`` largest exact inner products; ties go to smaller ids."""
    side, ids = table["side"].to_numpy(), table["id"].to_numpy()
    raw = np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(len(ids), -1)
    v_at, q_at = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    query, found, score = [], [], []
    if len(v_at) and len(q_at):
        v_at = v_at[np.argsort(ids[v_at], kind="stable")]
        v, v_id = raw[v_at], ids[v_at]
        for i in range(0, len(q_at), 256):
            q = raw[q_at[i : i + 256]]
            near = q @ v.T
            near[ids[q_at[i : i + 256]][:, None] == v_id[None, :]] = -np.inf
            n = min(k, len(v_at))
            edge = np.partition(near, len(v_at) - n, axis=1)[:, len(v_at) - n]
            row, col = np.nonzero((near >= (edge - 1e-9 * (1 + np.abs(edge)))[:, None]) & np.isfinite(near))
            exact = (q[row] * v[col]).sum(1)  # the same sum for equal vectors, whatever chunk they are in
            order = np.lexsort((v_id[col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            use = rank < k
            query.append(ids[q_at[i : i + 256]][row[use]])
            found.append(v_id[col[use]])
            score.append(exact[use])
    query = np.concatenate(query) if query else np.empty(0, np.int64)
    found = np.concatenate(found) if found else np.empty(0, np.int64)
    score = np.concatenate(score) if score else np.empty(0)
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, np.int64)
    items = pa.StructArray.from_arrays([pa.array(-score), pa.array(found)], ["less", "vec_id"])
    return pa.table({"query_id": query[first], "best": pa.ListArray.from_arrays(pa.array(np.append(first, len(query)), pa.int32()), items)})


def nearest(
    vectors: DataFrame,
    is_query: str,
    k: int = 20,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
    width: float = WIDTH,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products found for each row that ``is_query`` (SQL) selects.

    All rows but the query's own are candidates. Null ids, null or empty or zero vectors and those with a null or
    non-finite component take no part; vectors meet only those of their own length. Rows that repeat an id and vector count
    once. An empty table gives an empty result. Other columns of ``vectors`` are ignored.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x"), F.expr(is_query).alias("q"))
    sound = "id is not null and size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(x, v -> v <> 0)"
    rows = rows.where(sound).dropDuplicates(["id", "x"])
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    band = F.coalesce(F.round(F.log(norm) / float(np.log(BAND))), F.lit(-9999)).cast("int")  # no logarithm where the squares vanish
    same = Window.partitionBy("x").orderBy("id")
    index = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("id", "x", band.alias("band"), norm.alias("norm"))
    index = materialise(index)
    bands: dict[int, dict[int, tuple[bool, float]]] = {}
    for r in index.groupBy(F.size("x").alias("dims"), "band").agg(F.count("*").alias("n"), F.max("norm").alias("norm")).collect():
        bands.setdefault(r.dims, {})[r.band] = (r.n <= WHOLE, r.norm if 0 < r.norm < float("inf") else 1.0)

    def rows_of(table, n, key, ids, vectors):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), (table << 32) + n, np.int64)), pa.array(key), ids, vectors], ["tab", "bucket", "id", "vector"])

    def in_band(key, b):
        return key ^ mix(np.array([b], np.int64).view(np.uint64)).view(np.int64)

    def place(batches):
        for batch in batches:
            for n, every in _by_length(batch, 1):
                of = every.column(2).to_numpy()
                for b in np.unique(of):
                    part = every.take(pa.array(np.flatnonzero(of == b)))
                    x = _matrix(part.column(1))
                    whole, longest = bands[n][int(b)]
                    if whole:
                        yield rows_of(tables, n, np.full(len(x), b, np.int64), part.column(0), _packed(x))
                        continue
                    unit = x / longest
                    rest = np.sqrt(np.maximum(1 - (unit * unit).sum(1, keepdims=True), 0))
                    h = _Hashes(n + 1, tables, hashes, width)
                    key = in_band(h.key(np.floor(h.cells(np.hstack([unit, rest])))), b)
                    for t in range(tables):
                        yield rows_of(t, n, key[:, t], part.column(0), _packed(x))

    def visit(batches):
        for batch in batches:
            for n, every in _by_length(batch, 1):
                h = _Hashes(n + 1, tables, hashes, width)
                for i in range(0, every.num_rows, 512):
                    part = every.slice(i, 512)
                    x = _matrix(part.column(1))
                    packed, ids = _packed(x), part.column(0)
                    for b in (b for b, (whole, _) in bands[n].items() if whole):
                        yield rows_of(tables, n, np.full(len(x), b, np.int64), ids, packed)
                    hashed = [b for b, (whole, _) in bands[n].items() if not whole]
                    if not hashed:
                        continue
                    cells = h.cells(np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))]))
                    floor = np.floor(cells)
                    for t in range(tables):
                        moves = [h.probes(cells[r, t] - floor[r, t], probes) for r in range(len(x))]
                        row = pa.array(np.repeat(np.arange(len(x)), [len(m) for m in moves]))
                        key = h.key(np.repeat(floor[:, t], [len(m) for m in moves], axis=0) + np.concatenate(moves))
                        for b in hashed:
                            yield rows_of(t, n, in_band(key, b), ids.take(row), packed.take(row))

    def scan(batches):
        for batch in batches:
            for n, part in _by_length(batch, 1):
                yield rows_of(tables + 1, n, np.zeros(len(part), np.int64), part.column(0), _packed(_matrix(part.column(1))))

    def met(placed, sent):
        """query_id and best: the ``k`` best of all vectors that share a bucket with the query."""
        sizes = placed.groupBy("tab", "bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        sent = materialise(sent.join(sizes, ["tab", "bucket"]))
        shares = sent.groupBy("tab", "bucket", "chunks").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
        held = placed.join(shares, ["tab", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asked = sent.join(shares.drop("chunks"), ["tab", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        columns = ["tab", "bucket", "chunk", "part", "side", "id", "vector"]
        both = held.withColumn("side", F.lit(0)).select(*columns).unionByName(asked.withColumn("side", F.lit(1)).select(*columns))
        best = both.groupBy("tab", "bucket", "chunk", "part").applyInArrow(lambda t: _best(t, k), "query_id long, best array<struct<less:double,vec_id:long>>")
        # Each table gives a vector once at most, so the first k * tables hold the k best.
        first = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k * tables)
        merged = materialise(best.groupBy("query_id").agg(first.alias("best")).withColumn("best", F.slice(F.array_distinct("best"), 1, k)))
        release(sent)
        return merged

    kind = "tab long, bucket long, id long, vector binary"
    placed = materialise(index.select("id", "x", "band").mapInArrow(place, kind))
    queries = rows.where("q").select("id", "x")
    merged = met(placed, queries.mapInArrow(visit, kind).dropDuplicates(["tab", "bucket", "id", "vector"]))
    # Where all bands are whole, all vectors are seen already.
    partly = [n for n, of in bands.items() if not all(whole for whole, _ in of.values())]
    enough = merged.where(F.size("best") >= k)
    short = materialise(queries.where(F.size("x").isin(partly)).join(enough, F.col("id") == F.col("query_id"), "left_anti"))
    if not short.isEmpty():
        again = met(index.where(F.size("x").isin(partly)).select("id", "x").mapInArrow(scan, kind), short.mapInArrow(scan, kind))
        merged = merged.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    ranked = materialise(merged.select("query_id", F.posexplode("best").alias("at", "b")))
    for table in (placed, index, short):
        release(table)
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", (-F.col("b.less")).alias("score"))
