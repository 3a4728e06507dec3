"""Stretches of a text that repeat one phrase over and over, and the text without the repeats.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) that no neighbouring
word extends. Two positions ``i < j`` of a run that lie one period apart share ``LCP(i, j)`` words; positions with equal
prefixes of some length form a suffix class. Classes are united by decreasing length of the prefix they share
(Kruskal on neighbours in suffix order, with union-find), each class keeping its positions in order. Two positions
that become neighbours in such a set at distance ``d`` have ``d`` as the smallest period of the stretch from ``i``
to ``j + LCP``: a smaller one would have put a position between them before. So neighbours with enough common
words, at whose left the words differ, are exactly the starts of runs.

Documents are independent. Those of a batch are handled together, each ended by a number of its own, so no common prefix
crosses documents; what a task holds is a batch of some hundred thousand words, or one longer document.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words handled at once; a longer document is handled alone.
BATCH_WORDS = 200_000
#: Positions in one part of an ordered set.
PART = 512
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Positions:
    """Ordered set of positions in parts of bounded size: an insertion costs little however large the set is."""

    __slots__ = ("parts", "firsts", "size")

    def __init__(self, position: int):
        self.parts, self.firsts, self.size = [[position]], [position], 1

    def __iter__(self):
        for part in self.parts:
            yield from part

    def put(self, x: int) -> tuple[int, int]:
        """Insert and return both neighbours, -1 where there is none."""
        parts = self.parts
        at = max(bisect_right(self.firsts, x) - 1, 0)
        part = parts[at]
        j = bisect_right(part, x)
        before = part[j - 1] if j else parts[at - 1][-1] if at else -1
        after = part[j] if j < len(part) else parts[at + 1][0] if at + 1 < len(parts) else -1
        part.insert(j, x)
        self.firsts[at] = part[0]
        self.size += 1
        if len(part) > PART:
            parts[at : at + 1] = [part[: PART // 2], part[PART // 2 :]]
            self.firsts.insert(at + 1, part[PART // 2])
        return before, after


def suffix_neighbours(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order and the common prefix of each with the one before it.

    Only positions that share ``shortest`` words (a power of two) with another are listed; a prefix of 0 starts a new
    class. ``ids`` are small numbers, and every document ends with one that occurs once. Ranks are refined by doubling
    the prefix they stand for, only where they are still tied; the ranks of every doubling give the common prefixes.
    """
    n = len(ids)
    counts = np.bincount(ids)
    rank = (np.cumsum(counts) - counts)[ids].astype(np.int32)
    tied = np.flatnonzero(counts[ids] > 1)
    ranks, width, listed = [rank], 1, tied
    while len(tied):
        if width == shortest:
            listed = tied
        key = rank[tied].astype(np.int64) * n + rank[tied + width]
        order = np.argsort(key, kind="stable")
        key, place = key[order], tied[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.flatnonzero(new)
        old = key // n
        group = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        size = np.diff(np.concatenate((head, [len(key)])))
        within = head - group[np.searchsorted(group, head, side="right") - 1]
        rank = rank.copy()
        rank[place] = np.repeat(old[head] + within, size)
        tied = place[np.repeat(size > 1, size)]
        width *= 2
        ranks.append(rank)
    if width <= shortest:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = listed[np.argsort(rank[listed], kind="stable")]
    common = np.zeros(len(place), np.int64)
    x, y = place[:-1].copy(), place[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        step = (ranks[level][x] == ranks[level][y]) * (1 << level)
        common[1:] += step
        x += step
        y += step
    common[common < shortest] = 0
    return place, common


def _promising(place: np.ndarray, common: np.ndarray, least: int, times: int) -> np.ndarray:
    """Indices of ``place`` in classes whose closest positions could lie a period of a run apart."""
    new = common < least
    new[:1] = True
    cls = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    order = np.lexsort((place, cls))
    gap = np.full(len(place), np.iinfo(np.int64).max)
    same = cls[order][1:] == cls[order][:-1]
    gap[1:][same] = np.diff(place[order])[same]
    closest = np.minimum.reduceat(gap, head)
    longest = np.maximum.reduceat(np.where(new, 0, common), head)
    return np.flatnonzero((closest <= longest // (times - 1))[cls])


def seeds(ids: np.ndarray, shortest_run: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``shortest_run`` words and ``times`` periods.

    ``ids`` begins with a number that occurs once, and every document ends with one.
    """
    # A run of period 1 shares shortest_run - 1 words with itself one word on; one of period d shares (times - 1) d.
    least = min(max(shortest_run - d, (times - 1) * d) for d in range(1, shortest_run + 1))
    place, common = suffix_neighbours(ids, 1 << (least.bit_length() - 1))
    if not len(place):
        return []
    use = _promising(place, common, least, times)
    if not len(use):
        return []
    joined = use[common[use] >= least]
    joined = joined[np.argsort(-common[joined], kind="stable")]
    word, at = ids.tolist(), place.tolist()
    root = {}
    sets = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    found = []

    def meet(i: int, j: int, shared: int) -> None:
        d = j - i
        if shared >= (times - 1) * d and shared + d >= shortest_run and word[i - 1] != word[j - 1]:
            found.append((i, shared + d, d))

    for k, shared in zip(joined.tolist(), common[joined].tolist()):
        a, b = find(k - 1), find(k)
        large = sets.pop(a, None) or Positions(at[a])
        small = sets.pop(b, None) or Positions(at[b])
        if large.size < small.size:
            large, small = small, large
        root[b] = a
        sets[a] = large
        previous, after = -1, -1
        for x in list(small):  # ascending, so what stands before x is final; what stands after x is so unless x's successor comes first
            if previous >= 0 and after >= 0 and after < x:
                meet(previous, after, shared)
            before, after = large.put(x)
            if before >= 0 and before != previous:
                meet(before, x, shared)
            previous = x
        if after >= 0:
            meet(previous, after, shared)
    return sorted(found, key=lambda r: (r[0], r[2]))


def _worker(shortest_run: int, times: int, rewrite: Callable | None):
    def handle(docs, words, kind):
        total = sum(map(len, words)) + len(words) + 1
        ids = np.empty(total, np.int64)
        ids[0], at, used, begins = 0, 1, 1, []
        for w in words:
            known: dict[bytes, int] = {}
            ids[at : at + len(w)] = [known.setdefault(x, used + len(known)) for x in w]
            used += len(known)
            begins.append(at)
            at += len(w)
            ids[at] = used
            used, at = used + 1, at + 1
        begins = np.array(begins, np.int64)
        runs = [[] for _ in words]
        found = seeds(ids, shortest_run, times)
        if found:
            owner = np.searchsorted(begins, [r[0] for r in found], side="right") - 1
            for d, (start, length, period) in zip(owner.tolist(), found):
                runs[d].append({"start": start - int(begins[d]), "length": length, "period": period})
        kept = []
        for w, own in zip(words, runs):
            if own:
                stay = bytearray(b"\1") * len(w)
                for r in own:
                    from_, to = r["start"] + r["period"], r["start"] + r["length"]
                    stay[from_:to] = bytes(to - from_)
                w = compress(w, stay)
            kept.append(b" ".join(w))
        return pa.RecordBatch.from_arrays(
            [pa.array(docs, kind), pa.array([len(w) for w in words], pa.int64()), pa.array(runs, _RUNS), pa.array(kept, pa.binary()).cast(pa.large_string())],
            ["doc_id", "n_words", "runs", "collapsed"],
        )

    def work(batches):
        docs, words, held, kind = [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = text.as_buffer().to_pybytes().split() if text.is_valid else []  # at exactly the six bytes that part words
                if rewrite is not None:
                    w = rewrite(doc, w)
                if held and held + len(w) > BATCH_WORDS:
                    yield handle(docs, words, kind)
                    docs, words, held = [], [], 0
                docs.append(doc)
                words.append(w)
                held += len(w) + 8
        if docs:
            yield handle(docs, words, kind)

    return work


def periodic_runs(
    docs: DataFrame,
    shortest_run: int = 6,
    times: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """doc_id, n_words, runs and collapsed (the text without a run's words after its first period) of every row.

    ``runs`` lists all runs of at least ``shortest_run`` words and ``times`` (two or more) periods by start, then period; words are
    counted from 0. Runs may overlap; a word stays unless some run holds it after that run's first period. Kept words are
    joined by one space. ``rewrite`` (id, words as bytes) may change the words first. Null and empty texts have no words,
    no runs and an empty text. Rows are judged one by one, so repeated and null ids stay as they are, and other
    columns do not matter. Nothing is shuffled.
    """
    if times < 2 or shortest_run < 2:
        raise ValueError("a run has at least two periods and two words")
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_worker(shortest_run, times, rewrite), f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")
