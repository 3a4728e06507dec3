"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power ``t``, normalised. ``t = 1`` keeps the shares, ``t = 0`` makes
sources equal; entropy and repetition grow as ``t`` falls. Bisection finds the ``t`` that meets a target entropy or the
smallest that keeps the most repeated source within a limit. The weights are realised on a budget of tokens:
a source is dealt into blocks by a hash, each epoch visits its blocks in an order of its own, and the last epoch
stops where the source's quota is met.

All of it is DataFrame operations. A hot source spreads over as many groups as it has blocks; the running sums go over
block totals per source, then over the documents of the one block per source in which the quota ends. Text is not moved
to decide: rows look their block's decision up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.store import if_small, materialise

#: Documents of a block, on average.
BLOCK_ROWS = 512
#: Midpoints of the exponent evaluated by one job: six bisection steps at once; and the number of such jobs.
LEVELS, JOBS = 6, 7


@dataclass
class Temperature:
    """The exponent found, with the entropy (nats) and the largest repetition it gives."""

    exponent: float
    entropy: float
    repeats: float


def _hash(*parts: Column) -> Column:
    """48 bits of an MD5 as a long, equal on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")


def _measured(shares: DataFrame, exponents: list[float], budget: float | None, total: float) -> dict[float, tuple[float, float]]:
    """exponent -> (entropy, largest repetition), all in one aggregation."""
    p = shares.select("share", F.explode(F.array(*map(F.lit, exponents))).alias("t"))
    p = p.withColumn("w", F.pow("share", F.col("t")))
    sums = p.groupBy("t").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.col("t") * F.log("share")).alias("e"), F.max(F.col("w") / F.col("share")).alias("most"), F.min(F.col("w") / F.col("share")).alias("least"))
    out = {}
    for r in sums.collect():  # one row per exponent
        repeats = r.most / r.least if budget is None else budget / total * r.most / r.z
        out[r.t] = (math.log(r.z) - r.e / r.z, float(repeats))
    return out


def find_temperature(shares: DataFrame, total: float, budget: float | None, target_entropy: float | None, most_repeats: float | None) -> Temperature:
    """The exponent in [0, 1]: the largest that reaches ``target_entropy``, but none so small that a source repeats more
    than ``most_repeats`` times. Each job evaluates a whole tree of midpoints, so a few jobs give 42 bisection steps.
    ``budget`` of None means that the least repeated source is used exactly once.
    """

    def flat_enough(m):
        return target_entropy is None or m[0] >= target_entropy

    def within(m):
        return most_repeats is None or m[1] <= most_repeats

    def bisect(good, low, high):
        """The largest exponent that is good, if goodness ends somewhere between ``low`` (good) and ``high``."""
        for _ in range(JOBS):
            step = (high - low) / 2**LEVELS
            grid = [low + step * i for i in range(1, 2**LEVELS)]
            seen = _measured(shares, grid, budget, total)
            last = max((t for t in grid if good(seen[t])), default=low)
            low, high = last, min((t for t in grid if t > last), default=high)
        return low, high

    ends = _measured(shares, [0.0, 1.0], budget, total)
    if target_entropy is not None:
        t = 1.0 if flat_enough(ends[1.0]) else bisect(flat_enough, 0.0, 1.0)[0] if flat_enough(ends[0.0]) else 0.0
    else:
        t = 0.0
    if not within(_measured(shares, [t], budget, total)[t]):
        # Repetition falls as the exponent grows: the bracket's upper end is within the limit, if anything is.
        t = bisect(lambda m: not within(m), t, 1.0)[1] if within(ends[1.0]) else 1.0
    entropy, repeats = _measured(shares, [t], budget, total)[t]
    return Temperature(t, entropy, repeats)


def mix_sources(
    docs: DataFrame,
    budget: int | str | None = "total",
    target_entropy: float | None = None,
    most_repeats: float | None = 2.0,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` as drawn, a row per draw, with epoch, block and place (0 to 1, the order of the mix) added as
    mix_epoch, mix_block and mix_place.

    ``budget`` is a number of tokens (words), ``"total"`` for as many as there are, or None for the least with which every
    document is drawn at least once. Null text has no tokens; a null source is a source of its own; a source without
    tokens has no weight and is not drawn. Draws follow doc_id, so rows that repeat a doc_id are drawn together. A
    source's draws end with the document that meets its quota. Columns of ``docs`` stay as they are.
    """
    tokens = F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    label = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    facts = materialise(docs.select(name.alias("s"), label.alias("d"), tokens.alias("tokens")))
    sums = materialise(facts.groupBy("s").agg(F.sum("tokens").alias("all"), F.count("*").alias("n")).where("all > 0"))
    total = sums.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("t")).head().t
    added = {"mix_epoch": F.lit(0).cast("long"), "mix_block": F.lit(0).cast("long"), "mix_place": F.lit(0.0)}
    if not total:
        return docs.where("false").withColumns(added)
    shares = sums.withColumn("share", F.col("all") / F.lit(float(total)))
    amount = None if budget is None else float(total if budget == "total" else budget)
    t = find_temperature(shares, float(total), amount, target_entropy, most_repeats).exponent
    weight = F.pow("share", F.lit(t))
    fixed = shares.agg(F.sum(weight).alias("z"), F.min(weight / F.col("all")).alias("least")).head()
    scale = 1 / fixed.least if amount is None else amount / fixed.z  # quota = scale * share ** t
    quota = F.greatest(F.round(weight * F.lit(scale)).cast("long"), F.lit(1))
    plan = shares.select("s", "all", quota.alias("quota"), F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"))
    plan = materialise(plan.withColumn("whole", F.expr("quota div all")).withColumn("rest", F.expr("quota % all")))

    salt = F.lit(str(seed))

    def block(s: Column, d: Column) -> Column:
        return F.pmod(_hash(salt, s, d), F.col("blocks"))

    placed = facts.join(if_small(plan), "s").withColumn("block", block(F.col("s"), F.col("d")))
    totals = placed.groupBy("s", "block", "whole", "rest").agg(F.sum("tokens").alias("tokens"))
    turn = Window.partitionBy("s").orderBy(_hash(salt, F.lit("turn"), "s", F.col("block").cast("string"), F.col("whole").cast("string")), "block")
    totals = totals.withColumn("before", F.sum("tokens").over(turn) - F.col("tokens"))
    # Blocks of the last epoch: drawn in full, in part (one per source), or not at all.
    totals = materialise(totals.select("s", "block", "whole", "before", F.greatest(F.least(F.col("rest") - F.col("before"), F.col("tokens")), F.lit(0)).alias("take"), "tokens"))
    inside = placed.select("s", "block", "d", "tokens").join(if_small(materialise(totals.where("take > 0 and take < tokens").select("s", "block", "take"))), ["s", "block"])
    place = _hash(salt, F.lit("place"), F.col("s"), F.col("d"))
    inside = inside.select("s", "block", "take", "tokens", place.alias("at"))
    run = Window.partitionBy("s", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    cut = inside.withColumn("drawn", F.coalesce(F.sum("tokens").over(run), F.lit(0))).where("drawn < take").groupBy("s", "block").agg(F.max("at").alias("cut"))
    decided = if_small(materialise(totals.join(cut, ["s", "block"], "left").select("s", "block", "before", F.when(F.col("take") <= 0, F.lit(-1)).when(F.col("take") < F.col("tokens"), F.coalesce("cut", F.lit(-1))).otherwise(F.lit(1 << 48)).alias("cut"))))

    own = {"_mix_s": name, "_mix_d": label}
    rows = docs.withColumns(own).join(if_small(plan).select(*(F.col(c).alias(f"_mix_{c}") for c in ("s", "all", "quota", "blocks", "whole"))), "_mix_s")
    rows = rows.withColumn("_mix_block", F.pmod(_hash(salt, F.col("_mix_s"), F.col("_mix_d")), F.col("_mix_blocks")))
    rows = rows.join(decided.select(F.col("s").alias("_mix_s"), F.col("block").alias("_mix_block"), F.col("before").alias("_mix_before"), F.col("cut").alias("_mix_cut")), ["_mix_s", "_mix_block"])
    at = _hash(salt, F.lit("place"), F.col("_mix_s"), F.col("_mix_d"))
    copies = F.col("_mix_whole") + F.when(at <= F.col("_mix_cut"), 1).otherwise(0)
    rows = rows.withColumn("_mix_copies", copies).where("_mix_copies > 0").withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_copies") - 1)))
    within = F.least((F.col("_mix_epoch") * F.col("_mix_all") + F.col("_mix_before")) / F.col("_mix_quota"), F.lit(1.0))
    return rows.select(*docs.columns, F.col("_mix_epoch").alias("mix_epoch"), F.col("_mix_block").alias("mix_block"), within.alias("mix_place"))
