"""Quality rules: counted rules first, then a calibrated classifier trained on labelled rows.

Features are hashed word n-grams (one and two words) and character n-grams (four bytes of UTF-8), each kind as shares
of its own total. The logistic regression is fitted on all labelled rows but those held out, calibrated by Platt's
method on held-out ones, and travels to the executors as one table of 65,536 weights, whatever the input's size. Scoring
and counting run over whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.kept import kept
from sensorframe.llm.linear import minimise, newton_platt
from sensorframe.llm.store import materialise, release
from sensorframe.llm.words import Splitter, Words, mix, numbers, pieces

#: Slots of the hashed features; a factor on the shares, so that weights stay of order one.
WIDTH_BITS, SCALE = 16, 20.0
#: Penalty on the squared weights; unit of the fit's sums; tasks that send sums to the driver; vector entries read at once;
#: 64-bit words of the bitmap of ids.
RIDGE, EXACT, SUM_TASKS, ENTRIES, BITMAP_WORDS = 1e-5, 2.0**22, 32, 1 << 18, 1 << 18
#: Thresholds a model may take, and the share of held-out good rows it may reject at most.
THRESHOLDS, MOST_REJECTED = (0.5, 0.4, 0.3, 0.2, 0.1, 0.05), 0.005

#: A stored vector; the byte that stands for a number of this size or more.
VECTOR, WIDE = "sizes binary, steps binary, wide_steps binary, counts binary, wide_counts binary", 255

COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass
class QualityModel:
    """Weights over hashed features, the calibration of the score, and the probability from which a row is kept."""

    weight: np.ndarray
    bias: float
    slope: float
    offset: float
    keep_from: float = 0.5


def _features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slot of each n-gram, first n-gram of each document), one pair per kind of n-gram."""
    shift = np.uint64(64 - WIDTH_BITS)
    out = [((mix(words.hash + np.uint64(101)) >> shift).astype(np.int64), words.first)]
    two, first = words.windows(2, seed=23)
    out.append(((two >> shift).astype(np.int64), first))
    b = words.data.astype(np.uint32)
    size = np.maximum(np.diff(words.offsets) - 3, 0)
    first = np.concatenate(([0], np.cumsum(size)))
    if len(b) >= 4:
        gram = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
        gram = gram * np.uint32(0x9E3779B1)
        gram = (gram ^ gram >> np.uint32(15)) * np.uint32(0x85EBCA77) >> np.uint32(32 - WIDTH_BITS)
        inside = np.ones(len(gram), bool)
        for back in (1, 2, 3):
            cut = words.offsets[1:-1] - back
            inside[cut[(cut >= 0) & (cut < len(gram))]] = False
        out.append((gram[inside].astype(np.int64), _inside_first(inside, words.offsets)))
    else:
        out.append((np.empty(0, np.int64), first * 0))
    return out


def _inside_first(inside: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(inside)))
    return total[np.minimum(offsets, len(inside))]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def _scores(words: Words, model: QualityModel) -> np.ndarray:
    z = np.full(len(words.offsets) - 1, model.bias)
    for slot, first in _features(words):
        z += SCALE * _sums(model.weight[slot], first) / np.maximum(np.diff(first), 1)
    return model.slope * z + model.offset


def _vectors(words: Words) -> pa.RecordBatch:
    """Each document's distinct slots per kind of n-gram, as their steps, with their counts: a byte each, ``WIDE`` for those listed apart."""
    n_docs = len(words.offsets) - 1
    kinds = _features(words)
    # One sort for all: document, kind, slot.
    keys = [((np.repeat(np.arange(n_docs), np.diff(first)) * len(kinds) + k) << WIDTH_BITS) + slot for k, (slot, first) in enumerate(kinds)]
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    cuts = np.searchsorted(key, np.arange(n_docs * len(kinds) + 1) << WIDTH_BITS)
    slot = key & ((1 << WIDTH_BITS) - 1)
    step = np.diff(slot, prepend=0)
    starts = cuts[:-1][np.diff(cuts) > 0]
    step[starts] = slot[starts]
    by_doc = cuts[:: len(kinds)].astype(np.int64)

    def column(values: np.ndarray, at: np.ndarray) -> pa.Array:
        at = at * values.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n_docs, [None, pa.py_buffer(at), pa.py_buffer(values.tobytes())]).cast(pa.binary())

    def bytewise(values: np.ndarray) -> list[pa.Array]:
        wide = np.flatnonzero(values >= WIDE)
        return [column(np.minimum(values, WIDE).astype(np.uint8), by_doc), column(values[wide].astype("<u4"), np.searchsorted(wide, by_doc))]

    sizes = np.diff(cuts).astype("<u4")
    kinds_at = pa.array([sizes[i : i + len(kinds)].tobytes() for i in range(0, len(sizes), len(kinds))], pa.binary())
    return pa.RecordBatch.from_arrays([kinds_at, *bytewise(step), *bytewise(n)], VECTOR.replace(" binary", "").split(", "))


def _bytes(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _widened(column: pa.Array, wide: pa.Array) -> np.ndarray:
    values = _bytes(column, np.uint8).astype(np.int64)
    values[values == WIDE] = _bytes(wide, "<u4")
    return values


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``ENTRIES`` entries, one row at least."""
    for batch in batches:
        ends, row = np.cumsum(np.append(0, pc.binary_length(batch["steps"]).to_numpy(zero_copy_only=False))), 0
        while row < batch.num_rows:
            to = max(int(np.searchsorted(ends, ends[row] + ENTRIES, side="right")) - 1, row + 1)
            yield batch.slice(row, to - row)
            row = to


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of every entry of a batch of ``_vectors``."""
    sizes = _bytes(batch["sizes"], "<u4").astype(np.int64)
    step = _widened(batch["steps"], batch["wide_steps"])
    counts = _widened(batch["counts"], batch["wide_counts"]).astype(float)
    ends = np.cumsum(sizes)
    run, seen = np.cumsum(np.append(0, step)), np.cumsum(np.append(0, counts))
    slot = run[1:] - np.repeat(run[ends - sizes], sizes)
    value = SCALE * counts / np.repeat(seen[ends] - seen[ends - sizes], sizes)
    per_row = len(sizes) // max(batch.num_rows, 1)
    row = np.repeat(np.arange(batch.num_rows), sizes.reshape(-1, max(per_row, 1)).sum(1))
    return row, slot, value


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """Part (0 to 4, by a hash of the id), label and text of every document with a label."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    known = known.agg(F.min(label).cast("int").alias("label"), F.max(label).alias("other")).where("label = other").select("doc_id", "label")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Texts whose id is not in a bitmap of hashed ids (a bounded table, no id missed) are not sent to the join.
    bit = F.xxhash64("doc_id")
    word, mask = F.pmod(F.shiftright(bit, 6), F.lit(BITMAP_WORDS)), F.expr("shiftleft(1L, cast(xxhash64(doc_id) & 63 as int))")
    bitmap = known.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    rows = rows.withColumn("_word", word).join(F.broadcast(bitmap), "_word").where(mask.bitwiseAND(F.col("_bits")) != 0)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)).cast("int")
    return rows.join(known.hint("merge"), "doc_id").select(part.alias("part"), "label", "text")


def _gradient(rows: DataFrame, point: np.ndarray, importance: tuple[float, float]) -> tuple[float, np.ndarray]:
    """Weighted log loss of all rows and its gradient; the last number of ``point`` is the bias.

    Terms are whole multiples of 2^-22, so that sums are exact in any order and reruns agree to the bit.
    """
    width, most = len(point) - 1, max(importance)

    def sums(batches):
        grad, loss = np.zeros(width + 1), 0.0
        for batch in _slices(batches):
            row, slot, value = _unpacked(batch)
            y = batch["label"].to_numpy(zero_copy_only=False).astype(float)
            z = np.bincount(row, value * point[slot], minlength=len(y)) + point[-1]
            share = np.where(y > 0, importance[1], importance[0]) / most
            miss = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
            grad[:-1] += np.bincount(slot, np.rint(value * miss[row] * EXACT), minlength=width)
            grad[-1] += np.rint(miss * EXACT).sum()
            loss += np.rint(share * (np.logaddexp(0, z) - y * z) * EXACT).sum()
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad.tobytes()], pa.binary())], ["loss", "grad"])

    # One row per task, of at most SUM_TASKS tasks, whatever the input's size.
    got = rows.coalesce(SUM_TASKS).mapInArrow(sums, "loss double, grad binary").collect()
    by = most / EXACT
    return sum(r.loss for r in got) * by, sum((np.frombuffer(r.grad) for r in got), np.zeros(width + 1)) * by


def _scored(rows: DataFrame, weight: np.ndarray, bias: float) -> DataFrame:
    def score(batches):
        for batch in _slices(batches):
            row, slot, value = _unpacked(batch)
            z = np.bincount(row, value * weight[slot], minlength=batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([batch["part"], batch["label"], pa.array(z, pa.float64())], ["part", "label", "score"])

    return rows.mapInArrow(score, "part int, label int, score double")


def _platt(scored: DataFrame) -> tuple[float, float]:
    """``fit_platt`` with its sums taken by Spark, one job a step."""
    down, up = (scored.where(F.col("label") == v).count() for v in (0, 1))
    x, target = F.col("score"), F.when(F.col("label") == 1, (up + 1) / (up + 2)).otherwise(1 / (down + 2))

    def sums(slope: float, offset: float) -> tuple[float, np.ndarray, np.ndarray]:
        z = F.col("score") * F.lit(slope) + F.lit(offset)
        p = 1 / (1 + F.exp(-z))
        miss, curve = p - target, p * (1 - p)
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - target * z
        r = scored.agg(*(F.sum(c) for c in (loss, miss * x, miss, curve * x * x, curve * x, curve))).first()
        return r[0], np.array(r[1:3]), np.array([[r[3], r[4]], [r[4], r[5]]])

    slope, offset = newton_platt(sums, up, down)
    return round(slope, 9), round(offset, 9)  # sums of a job differ in their last digits


def train_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> QualityModel:
    """A model from all labelled documents.

    Of five parts, dealt by a hash of the id, three are fitted, one calibrates the score and one sets the threshold: the highest
    of ``THRESHOLDS`` that rejects at most ``MOST_REJECTED`` of its good rows. Null labels, ids and texts and ids with labels of
    both classes are passed over. Without labelled rows the model gives every text the probability one half and keeps it.

    Rows' vectors are stored once. Each step of the fit is one job that sums gradients where the rows are.
    """

    def vectors(batches):
        splitter = kept(("splitter",), Splitter)
        for batch in batches:
            for row, to, data, offsets in pieces(batch.column(2)):
                found = _vectors(splitter(data, offsets))
                own = batch.slice(row, to - row)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *found.columns], ["part", "label", *found.schema.names])

    rows = materialise(_labelled(docs, labels, doc_id, text, label).mapInArrow(vectors, f"part int, label int, {VECTOR}"))
    sizes = {(r.part, r.label): r["count"] for r in rows.groupBy("part", "label").count().collect()}
    down, up = (sum(sizes.get((p, v), 0) for p in range(3)) for v in (0, 1))
    point = np.zeros((1 << WIDTH_BITS) + 1)
    if up and down:
        fit = rows.where("part < 3")
        importance = (0.5 / down, 0.5 / up)
        ridge = np.append(np.full(1 << WIDTH_BITS, RIDGE), 0.0)

        def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
            value, grad = _gradient(fit, at, importance)
            return value + float((ridge * at * at).sum()) / 2, grad + ridge * at

        point = minimise(loss, point)
    elif up or down:
        point[-1] = 4.0 if up else -4.0
    scored = materialise(_scored(rows.where("part >= 3"), point[:-1], float(point[-1])))
    slope, offset = _platt(scored.where("part = 3")) if sizes.get((3, 0)) and sizes.get((3, 1)) else (1.0, 0.0)
    p = 1 / (1 + F.exp(-(F.col("score") * F.lit(slope) + F.lit(offset))))
    low = scored.where("part = 4 and label = 1").agg(*(F.count_if(p < t) for t in THRESHOLDS)).first()
    fits = [t for t, n in zip(THRESHOLDS, low) if n <= MOST_REJECTED * sizes.get((4, 1), 0)]
    release(rows, scored)
    return QualityModel(point[:-1].astype(np.float32), float(point[-1]), slope, offset, fits[0] if fits else THRESHOLDS[-1])


def _counts(words: Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    data, offsets = words.data, words.offsets
    n_docs = len(offsets) - 1
    flags = np.zeros(256, bool)
    flags[list(b"#*$%&|<>")] = True
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    letter = ~space & ((np.arange(256) & 0xC0) != 0x80)  # a code point's first byte
    n_symbols = _sums(flags[data], offsets)
    word_chars = _sums(letter[data], offsets)

    three, first = words.windows(3, seed=29)
    owner = np.repeat(np.arange(n_docs), np.diff(first))
    again = _repeated(mix(three + numbers(1, 31)[0] * owner.astype(np.uint64)))[0]
    cover = np.zeros(len(words.start) + 1, np.int64)
    at = (np.arange(len(three)) - first[owner] + words.first[owner])[again]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + 3, -1)
    n_repeat = _sums(np.cumsum(cover[:-1]) > 0, words.first)

    # Lines: cut at line feeds and at the documents' ends.
    ends = np.unique(np.concatenate((np.flatnonzero(data == 10), offsets[1:])))
    doc = np.searchsorted(offsets, ends, side="left") - 1
    starts = np.maximum(np.concatenate(([0], ends[:-1] + (data[np.minimum(ends[:-1], max(len(data) - 1, 0))] == 10) if len(data) else ends[:-1])), offsets[np.maximum(doc, 0)])
    n_in = np.searchsorted(words.start, ends) - np.searchsorted(words.start, starts)
    use = (n_in > 0) & (ends > starts)
    starts, ends, doc = starts[use], ends[use], doc[use]
    line = mix(words.span_hash(starts, ends) + numbers(1, 37)[0] * doc.astype(np.uint64))
    later = _repeated(line)[1]
    n_dup = np.bincount(doc[later], minlength=n_docs)
    return [np.diff(words.first), word_chars, n_symbols, n_dup, n_repeat]


def _repeated(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, equals an earlier one) for each value."""
    order = np.argsort(hashed, kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    any_, later = np.zeros(len(hashed), bool), np.zeros(len(hashed), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def judge_quality(docs: DataFrame, model: QualityModel, keep_from: float | None = None, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, the counts, ``quality`` (calibrated probability), base_failed and kept, one row per input row.

    Null text counts as empty: no words, so it fails the base rules (fewer than 50 words). Rows are judged one by one, so
    repeated rows get equal results. ``keep_from`` takes the place of the model's threshold. Other columns of ``docs`` are
    ignored, or with ``carry`` come first, doc_id once; of these, a column named as one of the results gives way to it.
    """
    names = [c.split()[0] for c in COUNTS.split(", ")][1:]
    if carry:
        docs = docs.drop(*({*names, "quality", "base_failed", "kept"} - {doc_id, text}))
    keep_from = model.keep_from if keep_from is None else keep_from
    kept_columns = docs.columns if carry else ["doc_id"]
    rows = docs if carry else docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    at = rows.columns.index(text if carry else "text")
    kinds = [f"`{n}` {t}" for n, t in rows.dtypes if n in kept_columns] + COUNTS.split(", ")[1:] + ["quality double"]

    def judge(batches):
        splitter = kept(("splitter",), Splitter)
        for batch in batches:
            own = [i for i, n in enumerate(batch.schema.names) if n in kept_columns]
            for row, to, data, offsets in pieces(batch.column(at)):
                words = splitter(data, offsets)
                p = 1 / (1 + np.exp(-np.clip(_scores(words, model), -500, 500)))
                part = batch.slice(row, to - row)
                columns = [*(part.column(i) for i in own), *(pa.array(c, pa.int64()) for c in _counts(words)), pa.array(p, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[i] for i in own), *names, "quality"])

    counted = rows.mapInArrow(judge, ", ".join(kinds))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))
