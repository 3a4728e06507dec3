"""Similarity self-join on word shingles and the groups it forms.

Two texts link when their sets of distinct shingles have a Jaccard similarity of ``percent`` in a hundred or
more. Texts with equal sets are one node from the start. Then

1. one pass counts shingles in a fixed number of hashed counters, so that common ones come last in the global
   order. The order only decides how much work there is, never what is found;
2. each set sends its first ``n - ceil(t * n) + 1`` shingles of that order; two linked sets share one of them.
   Shingles that only one set sends are dropped;
3. the rest meet in tiles: bands of set sizes a factor ``1 / t`` wide. A set goes to its own band and to the
   one below, so every linkable pair meets in the band of its smaller member. A pair must pass the bound on sizes and
   the bound from parity bitmaps (``popcount(x ^ y)`` bounds the symmetric difference from below, so the overlap from
   above), for large sets with wider ones too, before its sorted arrays are intersected exactly;
4. a shingle with more than ``LARGE`` members, as groups of thousands of near copies have, is not paired in full. Star
   rounds verify one pair per group and turn and merge what links; then only pairs between different groups remain,
   and these are all tested as in step 3.

No pair is left out: a pair is skipped only where it cannot link or is connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.graph import components
from sensorframe.llm.kept import kept
from sensorframe.llm.store import if_small, materialise, release, tasks_of
from sensorframe.llm.words import Splitter, mix, numbers, pieces

#: Hashed counters of the common-shingle pass, in slices that travel as one row each.
SLOTS, SLICE = 1 << 20, 1 << 12
#: Deviations above the mean counter from which its shingles are common; a flag in error only moves a shingle in the order.
DEVIATIONS = 3
#: 64-bit words of a parity bitmap.
BITMAP = 16
#: Sets with more shingles than this also have a bitmap of two to four bits per shingle, of a power of two in width.
WIDE_FROM = 1000
#: A shingle with more senders is merged by star rounds before pairs are tested.
LARGE = 64
#: Star rounds end when a round links less than this share of the pairs it tried.
WORTH = 0.05


def shingle_sets(column: pa.Array, k: int, splitter: Splitter) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of all distinct shingles row by row, offsets) for each piece of a text column.

    Fewer than ``k`` words make one shingle of all words; no words make none.
    """
    for row, to, data, offsets in pieces(column):
        words = splitter(data, offsets)
        hashed, first = words.windows(k)
        n_words = np.diff(words.first)
        sets = []
        for d in range(to - row):
            if n_words[d] >= k:
                h = np.sort(hashed[first[d] : first[d + 1]])
                if len(h) > 1:
                    h = h[np.concatenate(([True], h[1:] != h[:-1]))]
                sets.append(h)
            elif n_words[d]:
                w = words.hash[words.first[d] : words.first[d + 1]]
                factor = numbers(len(w), 12) | np.uint64(1)
                sets.append(mix(np.array([(w * factor).sum()], np.uint64) + np.uint64(n_words[d])))
            else:
                sets.append(np.empty(0, np.uint64))
        yield row, np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))


def common_slots(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """One flag per hashed counter over all shingles of all documents: ``DEVIATIONS`` above the mean or not.

    Each task counts into ``SLOTS`` counters and sends them as slices; a second stage adds slice by slice. What
    reaches the driver is ``SLOTS`` numbers, however large the input.
    """
    n_slices = SLOTS // SLICE

    def count(batches):
        total, splitter = np.zeros(SLOTS, np.int64), kept(("splitter", "lower"), lambda: Splitter(lower=True))
        for batch in batches:
            for _, hashed, _ in shingle_sets(batch.column(0), k, splitter):
                total += np.bincount((hashed >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
        if total.any():
            parts = total.reshape(n_slices, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(range(n_slices), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[s] = sums.get(s, 0) + np.frombuffer(c, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "counts"])

    kind = "slice int, counts binary"
    rows = docs.select(text).mapInArrow(count, kind).repartition(min(16, tasks_of(docs.sparkSession)), "slice").mapInArrow(add, kind).collect()
    total = np.zeros(SLOTS, np.int64)
    for s, c in rows:
        total[s * SLICE : (s + 1) * SLICE] = np.frombuffer(c, np.int64)
    return np.packbits(total > total.mean() + DEVIATIONS * np.sqrt(total.mean()) + 4)


def _needed(n: np.ndarray | int, percent: int):
    """Least overlap of a set of ``n`` with a linked one."""
    return -(-n * percent // 100)


def signatures(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, the set's two fingerprints, its parity bitmap and the shingles it sends."""
    fields = ["doc_id long", "n_shingles long", "f1 long", "f2 long", *(f"s{i} long" for i in range(BITMAP)), "wide binary", "sent array<long>"]

    def sign(batches):
        splitter, is_common = kept(("splitter", "lower"), lambda: Splitter(lower=True)), np.unpackbits(common).astype(bool)
        seeds = numbers(2, 13)
        for batch in batches:
            ids = batch.column(0)
            for row, hashed, offsets in shingle_sets(batch.column(1), k, splitter):
                n = np.diff(offsets)
                rows = np.repeat(np.arange(len(n)), n)
                prints = []
                for s in seeds:
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashed ^ s))))
                    prints.append(mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64)).view(np.int64))
                place = (mix(hashed) >> np.uint64(64 - 10)).astype(np.int64)
                bits = (np.bincount(rows * (64 * BITMAP) + place, minlength=len(n) * 64 * BITMAP) & 1).astype(np.uint8)
                bits = np.packbits(bits.reshape(len(n), 64 * BITMAP), axis=1).view(np.int64)
                late = is_common[(hashed >> np.uint64(44)).astype(np.int64)]
                order = np.lexsort((hashed, late, rows))
                rank = np.arange(len(rows)) - np.repeat(offsets[:-1], n)
                take = n - _needed(n, percent) + (n > 0)
                sent = hashed[order][rank < np.repeat(take, n)].view(np.int64)
                sizes = np.concatenate(([0], np.cumsum(take)))
                wide = [_wide(hashed[a:b]) if b - a > WIDE_FROM else None for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(n)), pa.array(n), *map(pa.array, prints), *(pa.array(bits[:, i]) for i in range(BITMAP)), pa.array(wide, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(sent))],
                    [f.split()[0] for f in fields],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(sign, ", ".join(fields))


def _wide(shingles: np.ndarray) -> bytes:
    """Parity bitmap; the one of half the width is the exclusive or of its even and odd bits."""
    width = 1 << (int(len(shingles)).bit_length() + 1)
    place = (mix(shingles) >> np.uint64(64 - (width.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=width) & 1).astype(np.uint8)).tobytes()


def _may_link(x: np.ndarray, y: np.ndarray, n: int, percent: int) -> bool:
    """The bitmap bound for packed wide bitmaps of sets with ``n`` shingles together."""
    x, y = np.unpackbits(x), np.unpackbits(y)
    while len(x) != len(y):
        x, y = (x, y[0::2] ^ y[1::2]) if len(x) < len(y) else (x[0::2] ^ x[1::2], y)
    return (100 + percent) * (n - int(np.count_nonzero(x != y))) >= 2 * percent * n


def _of_pairs(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b) with the columns of both members, as x_ and y_. Few pairs go to the table, so that only their rows move."""
    pairs = if_small(pairs)
    x = table.select(F.col("doc_id").alias("a"), *(F.col(c).alias(f"x_{c}") for c in columns)).join(pairs, "a")
    y = table.select(F.col("doc_id").alias("b"), *(F.col(c).alias(f"y_{c}") for c in columns)).join(pairs, "b")
    return x.join(y, ["a", "b"]).select("a", "b", *(f"x_{c}" for c in columns), *(f"y_{c}" for c in columns))


def _bound(x: str, y: str, percent: int) -> str:
    """The bounds from sizes and from parity bitmaps, on columns with the prefixes ``x`` and ``y``."""
    n, m = f"{x}n_shingles", f"{y}n_shingles"
    differ = " + ".join(f"bit_count({x}s{i} ^ {y}s{i})" for i in range(BITMAP))
    sizes = f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"
    # overlap <= (n + m - differ) / 2 and union = n + m - overlap
    return f"{sizes} and {100 + percent} * ({n} + {m} - ({differ})) >= {2 * percent} * ({n} + {m})"


def _bounded(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Those of the stored pairs (a, b) that pass the bounds from sizes, bitmaps and wide bitmaps."""
    met = _of_pairs(pairs, facts, ["n_shingles", *(f"s{i}" for i in range(BITMAP))]).where(_bound("x_", "y_", percent))
    return _refined(materialise(met.select("a", "b")), facts, percent)


def _refined(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Those of the stored pairs (a, b) that also pass the bound from wide bitmaps, where both members have one."""

    def test(batches):
        for batch in batches:
            a, b, n, x, m, y = (batch.column(i) for i in range(6))
            total = np.asarray(n) + np.asarray(m)
            keep = [i for i in range(len(a)) if _may_link(np.frombuffer(x[i].as_buffer(), np.uint8), np.frombuffer(y[i].as_buffer(), np.uint8), int(total[i]), percent)]
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], ["a", "b"])

    wide = facts.where("wide is not null").select("doc_id", "n_shingles", "wide")
    both = facts.groupBy("doc_id").agg(F.min(F.col("wide").isNotNull()).alias("all")).where("all").select("doc_id")
    judged = pairs.join(both.withColumnRenamed("doc_id", "a"), "a", "left_semi").join(both.withColumnRenamed("doc_id", "b"), "b", "left_semi").select("a", "b")
    judged = materialise(judged)
    passed = _of_pairs(judged, wide, ["n_shingles", "wide"]).mapInArrow(test, "a long, b long")
    return materialise(pairs.join(judged, ["a", "b"], "left_anti").unionByName(passed))


def _sets(docs: DataFrame, doc_id: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """Sorted distinct shingles, as packed 64-bit values, of the documents in the stored table ``wanted``."""

    def make(batches):
        splitter = kept(("splitter", "lower"), lambda: Splitter(lower=True))
        for batch in batches:
            for row, hashed, offsets in shingle_sets(batch.column(1), k, splitter):
                packed = [hashed[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(packed)), pa.array(packed, pa.binary())], ["doc_id", "shingles"])

    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(if_small(wanted), "doc_id", "left_semi")
    return some.mapInArrow(make, "doc_id long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the stored pairs (a, b) whose exact overlap makes a link."""

    def test(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = []
            for p, q in zip(x, y):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], ["a", "b"])

    return _of_pairs(pairs, sets, ["shingles"]).mapInArrow(test, "a long, b long")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Null or wordless text: no shingles, a component of its own. Rows that repeat a doc_id are the same document,
    so their links join. A row without doc_id takes the component of the texts it equals, if any. Other columns
    of ``docs`` are ignored.
    """
    common = common_slots(docs, text, k)
    signed = materialise(signatures(docs, doc_id, text, k, percent, common))
    firsts = signed.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("first"))
    own = signed.select("doc_id", "n_shingles", "f1", "f2").join(firsts, ["f1", "f2"], "left")
    own = materialise(own.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")).alias("first")))

    # One sender per distinct set: a row that gave the set its first doc_id; of rows that repeat it, one.
    bits = [f"s{i}" for i in range(BITMAP)]
    senders = signed.where("n_shingles > 0").join(firsts.withColumnRenamed("first", "doc_id"), ["f1", "f2", "doc_id"], "left_semi")
    senders = senders.dropDuplicates(["f1", "f2", "doc_id"])
    group = Window.partitionBy("shingle")
    # A doc_id with several texts sends a shingle once: a second one would cancel the first in the marks.
    sent = senders.select("doc_id", F.explode("sent").alias("shingle")).repartition("shingle").dropDuplicates(["doc_id", "shingle"])
    marks = [F.bit_xor(F.xxhash64("doc_id", F.lit(i))).over(group).alias(f"g{i}") for i in (0, 1)]
    shared = materialise(sent.select("doc_id", "shingle", F.count("*").over(group).alias("n"), *marks).where("n > 1"))
    # Shingles with the same members lead to the same pairs: one of them is enough.
    same_members = shared.groupBy("n", "g0", "g1").agg(F.min("shingle").alias("shingle")).select("shingle")
    every, shared = shared, materialise(shared.drop("g0", "g1").join(same_members, "shingle", "left_semi"))
    release(every)
    facts = materialise(senders.select("doc_id", "n_shingles", *bits, "wide").join(shared.select("doc_id").distinct(), "doc_id", "left_semi"))
    release(signed)

    few = shared.where(F.col("n") <= LARGE).select("doc_id", "shingle")
    many = materialise(shared.where(F.col("n") > LARGE).select("doc_id", "shingle"))
    pairs = _refined(materialise(_plausible(few.withColumn("comp", F.col("doc_id")), facts, bits, percent)), facts, percent)
    wanted = materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(many.select("doc_id")).distinct())
    sets = materialise(_sets(docs, doc_id, text, k, wanted))
    links = materialise(_verified(pairs, sets, percent))
    same = own.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    if not many.isEmpty():
        label, found = _star_rounds(many, facts, sets, percent)
        pairs = _refined(materialise(_plausible(many.join(label, "doc_id"), facts, bits, percent)), facts, percent)
        links = links.unionByName(found).unionByName(_verified(pairs, sets, percent))
    found = components(links.unionByName(same))
    return own.join(found.withColumnRenamed("node", "first"), "first", "left").select("doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id"))


def _star_rounds(member: DataFrame, facts: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, comp) after star rounds, and the links (a, b) found: documents with one comp are connected by them.

    Each turn tries, per component, one member against one of a lower component that it shares a shingle with, and a
    component whose try links takes the lower one's name. Members are picked anew each turn. How many turns run decides only
    how many pairs are left for the full test.
    """
    label = materialise(member.select("doc_id", F.col("doc_id").alias("comp")).distinct())
    links, turn = None, 0
    while True:
        pick = F.min_by("doc_id", F.xxhash64("doc_id", F.lit(turn))).alias("doc_id")
        one = member.join(label, "doc_id").groupBy("shingle", "comp").agg(pick)
        hub = one.groupBy("shingle").agg(F.min_by(F.struct("comp", "doc_id"), "comp").alias("h"))
        tries = one.join(hub, "shingle").where("comp > h.comp").groupBy("comp", F.col("doc_id").alias("a"), F.col("h.doc_id").alias("b"), F.col("h.comp").alias("to")).count()
        best = F.max_by(F.struct("a", "b", "to"), F.struct("count", F.xxhash64("a", "b", F.lit(turn)))).alias("p")
        tries = materialise(tries.groupBy("comp").agg(best).select("comp", "p.a", "p.b", "p.to"))
        good = materialise(_verified(_bounded(tries.select("a", "b"), facts, percent), sets, percent))
        n_tried, n_good = tries.count(), good.count()
        links = good if links is None else links.unionByName(good)
        if n_good:
            moved = tries.join(good, ["a", "b"]).select("comp", "to")
            label = materialise(label.join(moved, "comp", "left").select("doc_id", F.coalesce("to", "comp").alias("comp")))
        turn += 1
        if n_good <= WORTH * n_tried:
            return label, links


def _plausible(member: DataFrame, facts: DataFrame, bits: list[str], percent: int) -> DataFrame:
    """Distinct pairs (a < b) of different components that share a shingle in a tile and pass the two bounds.

    ``member`` is doc_id, shingle, comp. The largest component of a shingle is never paired with itself: one side of
    the join holds only members outside it.
    """
    sizes = member.groupBy("shingle", "comp").count().groupBy("shingle").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    member = member.join(sizes.select("shingle", "main"), "shingle").join(facts.drop("wide"), "doc_id")
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100 / percent)) + F.lit(1e-9)).cast("int")
    member = member.withColumn("band", band).withColumn("tile", F.explode(F.array(F.col("band") - 1, F.col("band"))))
    columns = ("doc_id", "comp", "n_shingles", "band", *bits)
    b = member.select("tile", "shingle", "main", *(F.col(c).alias(f"b_{c}") for c in columns))
    a = member.where("comp <> main").select("tile", "shingle", *(F.col(c).alias(f"a_{c}") for c in columns))
    bound = f"a_comp <> b_comp and (b_comp = main or a_doc_id < b_doc_id) and tile = least(a_band, b_band) and {_bound('a_', 'b_', percent)}"
    met = a.join(b, ["tile", "shingle"]).where(bound)
    return met.select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b")).distinct()
