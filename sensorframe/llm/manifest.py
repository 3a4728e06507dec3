"""Merkle manifest of a table: one digest over all rows, and for every row the proof that it belongs to it.

Rows of a group stand in a total order. Every three consecutive nodes of a level become the digest of their
concatenation, until one node, the group's subroot, is left; the subroots in the order of their groups become the root alike.

The rank of a row is written in base three. Six digits make a block of 729 rows, which is hashed to one place; there the
digit columns are grouped away one after the other, each grouping nesting the structs of the one before, so a block
ends as one row that holds its small tree. Blocks are the leaves of the next round, and so on: a block is all that a task
ever holds of a group. On the way back a transform over the nested structs hands every node its siblings and an explode
turns them into rows. A block meets what lies above it by a grouping of both, so proofs need no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.store import if_small, materialise, release

#: Digits of a rank that one block holds.
DIGITS = 6
BLOCK = 3**DIGITS
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts, one after the other, as UTF-8."""
    return F.sha2(F.encode(F.concat(*parts), "utf-8"), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["left"], node, level["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level from the leaf to the root, left to right."""
    return F.sha2(F.encode(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""), "utf-8"), 256)


def _ranked(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """Stored rows with ``i``, the place inside the group, and ``n``, the group's size.

    One range sort over all groups, stored; a group's places then follow from how many of its rows every
    partition holds. ``rows`` must be stored, and ``order`` total up to equal rows.
    """
    ordered = materialise(rows.orderBy(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    by_part = Window.partitionBy(group)  # at most one row per partition of the sort
    held = ordered.groupBy(part, group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(by_part.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialise(held.select("_part", group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(by_part).alias("n")))
    placed = ordered.withColumn("_part", F.shiftright("_at", 33)).join(if_small(starts), ["_part", group])
    return placed.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("i"), "n")


def _nested(nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
    """One row per block of ``nodes`` (g, n, i, h and payload): g, n, block and the nested struct ``node``."""
    digits = [(F.floor(F.col("i") / 3**level) % 3).cast("int").alias(f"_d{level}") for level in range(DIGITS)]
    cell = ["g", "n", "block"]
    rows = nodes.select("g", "n", F.floor(F.col("i") / BLOCK).alias("block"), *digits, F.struct("h", *payload).alias("node"))
    rows = rows.repartition("g", "block")
    for level in range(DIGITS):
        left = [f"_d{d}" for d in range(level + 1, DIGITS)]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"_d{level}").alias("d"), "node")))
        rows = rows.groupBy(*cell, *left).agg(F.transform(kids, lambda x: x["node"]).alias("kids"))
        together = F.sha2(F.encode(F.array_join(F.transform("kids", lambda k: k["h"]), ""), "utf-8"), 256)
        # A level with a single node is the group's top: it is not hashed again.
        top = F.when(F.col("n") > 3**level, together).otherwise(F.col("kids")[0]["h"])
        rows = rows.select(*cell, *left, F.struct(top.alias("h"), "kids").alias("node"))
    return rows


def _grow(nodes: DataFrame, payload: Sequence[str], most: int) -> list[DataFrame]:
    """Stored block tables from the leaves up; the last has one block per group."""
    grown = [materialise(_nested(nodes, payload))]
    while most > BLOCK:
        most = -(-most // BLOCK)
        up = grown[-1].select("g", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("i"), F.col("node.h").alias("h"))
        grown.append(materialise(_nested(up, ["i"])))
    return grown


def _unfold(node: Column, path: Column, level: int, payload: Sequence[str]) -> Column:
    """All leaves below a node of ``level``, as structs of their payload, digest and path."""
    if level == 0:
        return F.array(F.struct(*[node[p].alias(p) for p in payload], node["h"].alias("h"), path.alias("path")))

    def kid(k: Column, at: Column) -> Column:
        kids = node["kids"]
        join = lambda part: F.array_join(F.transform(part, lambda x: x["h"]), "")
        level_here = F.struct(join(F.slice(kids, F.lit(1), at)).alias("left"), join(F.slice(kids, at + 2, F.lit(3))).alias("right"))
        here = F.when(F.col("n") > 3 ** (level - 1), F.array(level_here)).otherwise(F.array().cast(PATH))
        return _unfold(k, F.concat(here, path), level - 1, payload)

    return F.flatten(F.transform(node["kids"], kid))


def _descend(grown: list[DataFrame], above: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Leaves with their paths; ``above`` has g, path and further facts of every group."""
    facts = [c for c in above.columns if c not in ("g", "path")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for depth, blocks in reversed(list(enumerate(grown))):
        here = payload if depth == 0 else ["i"]
        both = blocks.select("g", "block", "n", "node").unionByName(above, allowMissingColumns=True)
        met = both.groupBy("g", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "path", *facts)])
        leaves = met.select("g", *facts, F.explode(_unfold(F.col("node"), F.col("path"), DIGITS, here)).alias("leaf"))
        above = leaves.select("g", *facts, "leaf.*")
        if depth:
            above = above.select("g", *facts, "path", F.col("i").alias("block"))
    return above


def build_manifest(docs: DataFrame, leaf: Column, group: Column, order: Column, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: the columns of ``carry``, leaf, subroot, root and path.

    ``path`` lists the levels from the leaf to the root; each holds the digests of the siblings on the left and on the
    right, concatenated. ``fold(leaf, path)`` gives the root. Groups are told apart and ordered by ``group`` as
    text, null first; rows of a group ascend by ``order``, null first, then by leaf, so rows that repeat an order value
    have a defined place, and rows equal in both may change places without a change of any result. A table without
    rows gives no rows. Names of other columns of ``docs`` do not matter.

    The call stores narrow tables (digests, order values, carried columns) in the checkpoint folder; text is read once.
    """
    carry = carry or {}
    payload = [f"_c{i}" for i in range(len(carry))]
    key = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    rows = docs.select(key.alias("g"), order.alias("_order"), leaf.alias("h"), *[c.alias(p) for p, c in zip(payload, carry.values())])
    # Rows equal in all of this could still be a third of the table: a place of their own lets the sort cut between them.
    rows = materialise(rows.withColumn("_tie", F.monotonically_increasing_id()))
    ranked = _ranked(rows, "g", [F.col("_order").asc_nulls_first(), F.col("h"), F.col("_tie")])
    most = ranked.agg(F.max("n").alias("m")).head().m or 0
    grown = _grow(ranked, payload, most)
    subroots = materialise(grown[-1].select("g", F.col("node.h").alias("h")))
    tops = _ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("_group"), "h"), "g", [F.col("_group")])
    upper = _grow(tops, ["_group"], tops.count())
    release(rows)
    root = upper[-1].select("g", F.col("node.h").alias("root"), F.array().cast(PATH).alias("path"))
    groups = _descend(upper, root, ["_group"]).select(F.col("_group").alias("g"), F.col("h").alias("subroot"), "root", "path")
    leaves = _descend(grown, groups, payload)
    return leaves.select(*[F.col(p).alias(name) for p, name in zip(payload, carry)], F.col("h").alias("leaf"), "subroot", "root", "path")
