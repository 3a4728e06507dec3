"""Removal of passages that a document with a smaller id holds too.

A window is ``k`` consecutive words. Each window belongs to the bucket of its minimiser, the ``m`` words inside it whose
hash is least. Consecutive windows of a document with the same minimiser travel as one packed string (a
super-k-mer) of ``k - 1 + windows`` words, so a word is sent about three times instead of ``k`` times. Equal
windows have equal minimisers, so they meet in one bucket, where a sort finds each one's smallest document.

A passage in a third of all documents would fill one bucket. So each map group of some megabytes first sorts
its own windows: of equal ones only those of its smallest document travel, the others are settled on the spot.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.store import tasks_of
from sensorframe.llm.words import Splitter, pieces

#: Words of a minimiser.
M = 3
#: Text bytes of a map group, and of the text whose windows a bucket task holds at once.
GROUP_BYTES = 6 << 20
#: Level of zstd for packed strings.
LEVEL = 6
SENT = "part int, packed binary, size long, settled binary"
RUNS = "doc_id long, key long, start int, length int"


class _Group:
    """Words of some documents, gathered piece by piece."""

    def __init__(self):
        self.bytes, self.n_words = 0, 0
        self.data, self.start, self.end, self.window, self.second, self.owner, self.at, self.least = ([] for _ in range(8))
        self.doc_id, self.key = [], []

    def add(self, words, k: int, doc_id: np.ndarray, key: np.ndarray) -> None:
        hashed, first = words.windows(k)
        second, _ = words.windows(k, seed=17)
        counts = np.diff(first)
        owner = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(hashed)) - first[owner] + words.first[owner]  # the windows' first words
        mers = _mers(words.hash)
        wide = np.lib.stride_tricks.sliding_window_view(mers, k - M + 1) if len(mers) > k - M else np.empty((0, k - M + 1), np.uint64)
        least = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 16):
            least[i : i + (1 << 16)] = at[i : i + (1 << 16)] + wide[at[i : i + (1 << 16)]].argmin(axis=1)
        self.window.append(hashed)
        self.second.append(second)
        self.owner.append(owner + len(self.doc_id))
        self.at.append(at + self.n_words)
        self.least.append((least + self.n_words, mers[least] if len(least) else np.empty(0, np.uint64)))
        self.start.append(words.start + self.bytes)
        self.end.append(words.end + self.bytes)
        self.data.append(words.data)
        self.doc_id.extend(doc_id.tolist())
        self.key.extend(key.tolist())
        self.bytes += len(words.data)
        self.n_words += len(words.start)


def _mers(hashed: np.ndarray) -> np.ndarray:
    """Hash of the M words from each word on, whatever document they are in; windows never reach over an end."""
    n = len(hashed) - M + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashed[:n].copy()
    for j in range(1, M):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashed[j : j + n]
    total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9)


def _later(window: np.ndarray, second: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """True for windows that also belong to a smaller doc_id among those given."""
    order = np.argsort(window, kind="stable")
    w, s = window[order], second[order]
    new = np.ones(len(w), bool)
    new[1:] = w[1:] != w[:-1]
    if ((s[1:] != s[:-1]) & ~new[1:]).any():  # one hash for two word sequences: sort by both
        order = np.lexsort((second, window))
        w, s = window[order], second[order]
        new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
    docs = doc_id[order]
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(docs, first) if len(docs) else docs
    out = np.empty(len(w), bool)
    out[order] = docs > np.repeat(least, np.diff(np.append(first, len(docs))))
    return out


def _runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the runs of true flags; no run goes over a true ``breaks``."""
    inside = np.flatnonzero(flags)
    if not len(inside):
        return inside, inside
    new = np.ones(len(inside), bool)
    new[1:] = (np.diff(inside) > 1) | breaks[inside[1:]]
    first = np.flatnonzero(new)
    return inside[first], np.diff(np.append(first, len(inside)))


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The byte ranges, one after the other."""
    total = int(length.sum())
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return data[shift + np.arange(total)]


def _send(group: _Group, k: int, n_parts: int) -> Iterator[pa.RecordBatch]:
    window, second, owner, at = (np.concatenate(x) for x in (group.window, group.second, group.owner, group.at))
    if not len(window):
        return
    place, mer = (np.concatenate([x[i] for x in group.least]) for i in (0, 1))
    data, start, end = (np.concatenate(x) for x in (group.data, group.start, group.end))
    doc_id, key = np.array(group.doc_id, np.int64), np.array(group.key, np.int64)
    later = _later(window, second, doc_id[owner])
    other = np.ones(len(window), bool)
    other[1:] = owner[1:] != owner[:-1]
    first, n = _runs(later, other)
    settled = np.stack([doc_id[owner[first]], key[owner[first]], at[first] - _base(group, owner[first]), n]).astype(np.int64)
    other[1:] |= place[1:] != place[:-1]
    first, n = _runs(~later, other)
    part = ((mer[first] >> np.uint64(20)) % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    first, n, part = first[order], n[order], part[order]
    bounds = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
    codec, parts, blobs, sizes = pa.Codec("zstd", LEVEL), [], [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        f = first[a:b]
        own, doc = np.unique(owner[f], return_inverse=True)
        from_, length = start[at[f]], end[at[f] + n[a:b] + k - 2] - start[at[f]]
        head = np.array([len(own), b - a], np.int64)
        rows = np.stack([doc, at[f] - _base(group, owner[f]), length]).astype("<i4").view(np.uint8)
        rows = np.ascontiguousarray(rows.reshape(3, -1, 4).transpose(0, 2, 1))  # bytes of equal weight side by side
        blob = b"".join((head.tobytes(), doc_id[own].tobytes(), key[own].tobytes(), rows.tobytes(), _gather(data, from_, length).tobytes()))
        parts.append(int(part[a]))
        sizes.append(len(blob))
        blobs.append(codec.compress(blob, asbytes=True))
    rest: list = [None] * len(parts)
    if settled.size:
        parts.append(int(abs(int(key[0])) % n_parts))
        blobs.append(None)
        sizes.append(0)
        rest.append(settled.tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(rest, pa.binary())], [c.split()[0] for c in SENT.split(", ")])


def _base(group: _Group, owner: np.ndarray) -> np.ndarray:
    return np.asarray(group.first_word)[owner]


def _sender(k: int, n_parts: int):
    def send(batches):
        splitter = Splitter()
        group, firsts = _Group(), []
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            keys = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
            for row, to, data, offsets in pieces(batch.column(2)):
                words = splitter(data, offsets)
                firsts.extend((words.first[:-1] + group.n_words).tolist())
                group.add(words, k, ids[row:to], keys[row:to])
                if group.bytes >= GROUP_BYTES:
                    group.first_word = firsts
                    yield from _send(group, k, n_parts)
                    group, firsts = _Group(), []
        if group.data:
            group.first_word = firsts
            yield from _send(group, k, n_parts)

    return send


def _counter(k: int):
    def count(table: pa.Table) -> pa.Table:
        splitter, codec = Splitter(), pa.Codec("zstd")
        window, second, doc_id, key, at, new, out = ([] for _ in range(7))
        for packed, size, settled in zip(table["packed"], table["size"].to_pylist(), table["settled"]):
            if settled.is_valid:
                out.append(np.frombuffer(settled.as_buffer(), np.int64).reshape(4, -1))
            if not packed.is_valid:
                continue
            blob = np.frombuffer(codec.decompress(packed.as_buffer(), size), np.uint8)
            n_docs, n = blob[:16].view(np.int64)
            ids, keys = blob[16 : 16 + 16 * n_docs].view(np.int64).reshape(2, -1)
            rows = blob[16 + 16 * n_docs : 16 + 16 * n_docs + 12 * n].reshape(3, 4, -1).transpose(0, 2, 1)
            doc, start, length = np.ascontiguousarray(rows).view("<i4")[:, :, 0].astype(np.int64)
            text = blob[16 + 16 * n_docs + 12 * n :]
            offsets = np.concatenate(([0], np.cumsum(length.astype(np.int64))))
            lo = 0
            while lo < n:
                hi = max(int(np.searchsorted(offsets, offsets[lo] + (1 << 20), side="right")) - 1, lo + 1)
                words = splitter(text[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                h, first = words.windows(k)
                counts = np.diff(first)
                own = np.repeat(np.arange(lo, hi), counts)
                window.append(h)
                second.append(words.windows(k, seed=17)[0])
                doc_id.append(ids[doc[own]])
                key.append(keys[doc[own]])
                at.append(start[own] + np.arange(len(h)) - first[own - lo])
                new.append(np.arange(len(h)) == first[own - lo])
                lo = hi
        if window:
            window, second, doc_id, key, at, new = (np.concatenate(x) for x in (window, second, doc_id, key, at, new))
            first, n = _runs(_later(window, second, doc_id), new)
            out.append(np.stack([doc_id[first], key[first], at[first], n]))
        runs = np.concatenate(out, axis=1) if out else np.empty((4, 0), np.int64)
        return pa.table({"doc_id": runs[0], "key": runs[1], "start": runs[2].astype(np.int32), "length": runs[3].astype(np.int32)})

    return count


def _remover(k: int):
    def remove(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, start, length in zip(batch.column(1).fill_null(""), batch.column(2), batch.column(3)):
                words = text.as_buffer().to_pybytes().split()  # at exactly the six bytes that part words
                n_words.append(len(words))
                if start.is_valid and len(start):
                    edge = np.zeros(len(words) + 1, np.int64)
                    from_ = np.asarray(start.values)
                    np.add.at(edge, from_, 1)
                    np.add.at(edge, from_ + np.asarray(length.values) + k - 1, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = list(compress(words, stay.tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return remove


def repeated_runs(docs: DataFrame, k: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (hash of the text), start and length of runs of windows that a smaller doc_id holds too."""
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).head().b
    n_parts = max(tasks_of(docs.sparkSession), -(-size // GROUP_BYTES))
    return rows.mapInArrow(_sender(k, n_parts), SENT).groupBy("part").applyInArrow(_counter(k), RUNS)


def drop_repeats(docs: DataFrame, k: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row.

    Null and empty texts have no words. A document with fewer than ``k`` words has no window and keeps all. Rows
    that repeat a doc_id are judged one by one and never against each other; a null doc_id is neither smaller nor
    larger than any. Other columns of ``docs`` are ignored.
    """
    runs = repeated_runs(docs, k, doc_id, text).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "length")).alias("runs"))
    runs = runs.select("doc_id", "key", F.col("runs.start").alias("start"), F.col("runs.length").alias("length"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    met = rows.join(runs, ["doc_id", "key"], "left").select("doc_id", "text", "start", "length")
    return met.mapInArrow(_remover(k), "doc_id long, n_words long, n_removed long, kept string")
