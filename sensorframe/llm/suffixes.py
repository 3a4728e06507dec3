"""Removal of every byte that lies in a long string which starts somewhere else too, by a distributed suffix array.

A suffix array with one row per byte would shuffle more than forty bytes for every byte of text, so two reductions,
both without loss, come before the sort:

1. *Screen.* Every window of ``length`` bytes is represented by its minimiser and half a window of context; a window whose
   representative occurs once in the table occurs once itself. What is left are the regions of windows that may repeat. Regions
   with equal bytes are one region from here on, with a count.
2. *Letters.* Regions are cut where the hash of the next bytes is the least of its surroundings, about every 32 bytes. A cut
   depends on the bytes near it alone, so equal windows hold equal letters. The suffix array is that of the letters.

Then the difference-cover algorithm: of each three letters the second and third start a sampled suffix. Triples of
letters are sorted over all sampled places and named by their rank, triples of names are named again, and once more, so
a name stands for 27 letters; two further sorts, of (letter, name) and (letter, letter, name), merge the first letters of
each three with the sampled ones. Neighbours in the final order are compared on the ``length`` bytes of all windows
that start in their letter: where they agree, these windows repeat.

Windows at the ends of a repeat are cut off inside a letter, and the order of letters cannot tell how far such bytes agree.
For them an exact check follows: they are grouped by the digest of their bytes, along with one representative of what is
known to repeat, and only where another suffix shares the bytes that all windows of the letter have in common.

No step gathers a group: ranks come from range sorts that cut between equal keys, counts from map-side sums, the joins on
hashes are left to the skew handling of adaptive execution. What the driver reads is one row per partition of a sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.store import materialise, release
from sensorframe.llm.words import mix, numbers

#: Bytes under the hash that places cuts and minimisers.
GRAM = 16
#: A cut is the least hash among this many positions around it.
SPACING = 64
#: Bytes of a text that are hashed at once; longer texts are taken in overlapping stretches.
STRETCH = 4 << 20
#: Times that triples are named: a name of three rounds stands for 27 letters.
ROUNDS = 3
SPANS = "array<struct<start:int,length:int>>"


class Bytes:
    """Hashes of any ranges of a byte string."""

    BASE = 0xB5297A4D3F84D5B5 | 1
    value = numbers(256, 23)
    power = inverse = np.empty(0, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Bytes.power) < n:
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                table = np.full(1 << n.bit_length(), np.uint64(base))
                table[0] = 1
                setattr(Bytes, name, np.cumprod(table))
        self.total = np.zeros(n, np.uint64)
        np.cumsum(self.value[data] * self.power[: n - 1], out=self.total[1:])

    def ranges(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mix((self.total[start + length] - self.total[start]) * self.inverse[start])

    def grams(self) -> np.ndarray:
        """Hash of the ``GRAM`` bytes at every position that has as many."""
        n = len(self.total) - GRAM
        return mix((self.total[GRAM:] - self.total[:n]) * self.inverse[:n])


def _least(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """Least (or greatest) of ``width`` values from every position on."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[:-step], values[step:])
        have += step
    return values


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions of letters: ``SPACING - 1`` before each gram that is the least of some ``SPACING`` consecutive ones.

    Whether a position is cut depends on the ``2 * SPACING + GRAM - 2`` bytes from it on, and two cuts are at most ``SPACING`` apart.
    """
    if len(data) < 2 * SPACING + GRAM:
        return np.empty(0, np.int64)
    hashed = Bytes(data).grams()
    least = _least(hashed, SPACING)
    inside = _least(least, SPACING, np.maximum)  # of the windows that hold position SPACING - 1 and on
    return np.flatnonzero(hashed[SPACING - 1 : SPACING - 1 + len(inside)] == inside)


def _representatives(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first window, hash) of runs of windows with the same representative: the left or right context of the least gram."""
    hashed = Bytes(data)
    grams = hashed.grams()
    place = np.arange(len(grams), dtype=np.uint64)
    packed = (grams & ~np.uint64((1 << 23) - 1)) | place  # the first of equal hashes wins
    at = (_least(packed, length - GRAM + 1) & np.uint64((1 << 23) - 1)).astype(np.int64)
    window = np.arange(len(at))
    half = (length - GRAM) // 2
    right = at - window <= half
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (right[1:] != right[:-1]))))
    at, right = at[new], right[new]
    keys = hashed.ranges(np.where(right, at, at - half), half + GRAM)
    return new, np.where(right, keys, ~keys).view(np.int64)


def _stretches(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, max(len(data) - length + 1, 0), STRETCH):
        yield at, data[at : at + STRETCH + length - 1]


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid and value.as_buffer().size else np.empty(0, np.uint8)


def _digest(raw: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(raw, digest_size=size).digest()


def _number(raw: bytes) -> int:
    return int.from_bytes(_digest(raw, 8), "little", signed=True)


def _screen(length: int):
    def screen(batches):
        for batch in batches:
            keys, found = [], []
            for key, data in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                for _, part in _stretches(data, length):
                    hashed = _representatives(part, length)[1]
                    found.append(hashed)
                    keys.append(np.full(len(hashed), key, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(keys))], ["mark", "key"])

    return screen


_HELD = "doc_id {}, n_bytes long, body binary, whole string, starts array<int>, lengths array<int>, digests array<binary>"


def _holder(length: int):
    def regions(data: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.zeros(len(data) + 1, np.int32)
        for at, part in _stretches(data, length):
            first, hashed = _representatives(part, length)
            to = np.append(first[1:], len(part) - length + 1)
            hit = np.isin(hashed, marks)
            np.add.at(edge, at + first[hit], 1)
            np.add.at(edge, at + to[hit] - 1 + length, -1)
        bounds = np.diff(np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).view(np.int8), [0])))
        start = np.flatnonzero(bounds == 1)
        return start, np.flatnonzero(bounds == -1) - start

    def hold(batches):
        for batch in batches:
            kind = batch.schema.field(0).type
            columns = [[] for _ in range(6)]
            for data, marks in zip(_texts(batch.column(1)), batch.column(2)):
                start = size = ()
                if marks.is_valid:
                    start, size = regions(data, np.asarray(marks.values))
                raw = data.tobytes()
                parts = [_digest(raw[s : s + n]) for s, n in zip(start, size)]
                whole = None if parts else hashlib.sha256(raw).hexdigest()
                for column, value in zip(columns, (len(data), raw if parts else None, whole, list(map(int, start)), list(map(int, size)), parts)):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [c.split()[0] for c in _HELD.split(", ")])

    return hold


def _letters(length: int):
    """Per region: starts and names of its letters, hashes of what all windows of a letter share, digests of all they hold.

    Names and hashes only bring suffixes together; what decides that windows agree is the digest.
    """
    shared = length - SPACING

    def letters(batches):
        for batch in batches:
            columns = [[] for _ in range(4)]
            for data in _texts(batch.column(1)):
                at, raw, n = cuts(data), data.tobytes(), len(data)
                ends = np.append(at[1:], n)
                hashed = Bytes(data)
                inside = at[at + shared <= n]
                columns[0].append(at.astype(np.int32))
                columns[1].append(hashed.ranges(at, ends - at).view(np.int64) if len(at) else at)
                columns[2].append(hashed.ranges(inside, shared).view(np.int64) if len(inside) else inside)
                columns[3].append([_number(raw[a : b + length - 1]) ^ (b - a) if b + length - 1 <= n else None for a, b in zip(at.tolist(), ends.tolist())])
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds)]], ["region", "at", "letter", "shared", "held"])

    return letters


_PLACED = "region long, k int, part int, less long, less0 long, head boolean, edges array<long>"


def _placer(n_keys: int):
    """Over rows sorted by their keys: how many rows of the partition have a smaller key, and how many of these are ``first``."""

    def place(batches):
        part = TaskContext.get().partitionId()
        rows = firsts = 0
        run = (0, 0)  # rows and firsts before the run of equal keys that is open
        last, begin, head = None, None, True
        schema = pa.schema([("region", pa.int64()), ("k", pa.int32()), ("part", pa.int32()), ("less", pa.int64()), ("less0", pa.int64()), ("head", pa.bool_()), ("edges", pa.list_(pa.int64()))])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(2 + c).to_numpy(zero_copy_only=False) for c in range(n_keys)])
            zero = batch.column(2 + n_keys).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.ones(n, bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            if last is None:
                begin = keys[:, 0].tolist()
                new[0] = False
            else:
                new[0] = keys[:, 0].tolist() != last
            before0 = firsts + np.cumsum(zero) - zero
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            less = np.where(start >= 0, rows + start, run[0])
            less0 = np.where(start >= 0, before0[start], run[1])
            heads = (start < 0) & head
            head = head and bool(start[-1] < 0)
            rows, firsts, run, last = rows + n, firsts + int(zero.sum()), (int(less[-1]), int(less0[-1])), keys[:, -1].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(n, part, np.int32)), pa.array(less), pa.array(less0), pa.array(heads), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((None, None, part, rows, firsts, head, begin + last + list(run)), schema.types)], schema=schema)

    return place


def _places(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Stored per region, in the order of k: how many rows have a smaller key (``name``_less), and how many of those are ``first`` (``name``_less0).

    The sort goes on by region and k, so equal keys may lie in several partitions; what a run of equal keys at a
    partition's head takes over from the partitions before follows from one stored row per partition.
    """
    ordered = rows.select("region", "k", *keys, "first").orderBy(*keys, "region", "k")
    placed = materialise(ordered.mapInArrow(_placer(len(keys)), _PLACED))
    offsets, before, before0, open_key, open_at = [], 0, 0, None, (0, 0)
    n = len(keys)
    for p in placed.where(F.col("k").isNull()).orderBy("part").collect():
        begin, last, run = p.edges[:n], p.edges[n : 2 * n], p.edges[2 * n :]
        at = open_at if begin == open_key else (before, before0)
        offsets.append((p.part, before, before0, *at))
        # The partition's last run began here, unless the whole partition is the run it began with.
        open_at = at if p.head else (before + run[0], before0 + run[1])
        open_key, before, before0 = last, before + p.less, before0 + p.less0
    starts = rows.sparkSession.createDataFrame(offsets, "part int, before long, before0 long, at long, at0 long")
    joined = placed.where(F.col("k").isNotNull()).join(F.broadcast(starts), "part")
    found = joined.select(
        "region",
        "k",
        F.when(F.col("head"), F.col("at")).otherwise(F.col("before") + F.col("less")).alias("less"),
        F.when(F.col("head"), F.col("at0")).otherwise(F.col("before0") + F.col("less0")).alias("less0"),
    )
    listed = materialise(_listed(found, name, "less", "less0"))
    release(placed)
    return listed


def _listed(placed: DataFrame, name: str, *values: str) -> DataFrame:
    """Per region the values in the order of k; a region is part of one document."""
    ordered = F.array_sort(F.collect_list(F.struct("k", *values)))
    return placed.groupBy("region").agg(ordered.alias("_all")).select("region", *[F.col(f"_all.{v}").alias(f"{name}_{v}") for v in values])


def _exploded(letters: DataFrame, residues: str) -> DataFrame:
    return letters.where(F.size("letter") > 0).withColumn("k", F.expr(f"explode(filter(sequence(0, size(letter) - 1), k -> k % 3 in ({residues})))"))


def _get(column: str, at: str):
    """A letter or name, or -1 behind the end."""
    return F.expr(f"coalesce(get({column}, cast({at} as int)), -1L)")


def suffix_places(letters: DataFrame) -> DataFrame:
    """region and ``place``, per letter the number of suffixes that come before the suffix that starts with it.

    ``letters`` are stored rows of region and letter (an array of names). Suffixes that agree in 27 letters may have one place.
    """
    sampled = "k - 1 - floor(k / 3)"  # index of letter k among the sampled ones
    names = None
    for level in range(ROUNDS):
        if names is None:
            keys = [_get("letter", f"k + {d}") for d in range(3)]
            rows = _exploded(letters, "1, 2")
        else:
            keys = [_get("name_less", f"{sampled} + {d * 2 * 3 ** (level - 1)}") for d in range(3)]
            rows = _exploded(letters.join(names, "region"), "1, 2")
        rows = rows.select("region", "k", *[key.alias(f"c{i}") for i, key in enumerate(keys)], F.lit(0).alias("first"))
        before, names = names, _places(rows, ["c0", "c1", "c2"], "name")
        release(*([before] if before is not None else []))
    known = materialise(letters.join(names, "region", "left"))
    release(names)
    first = F.expr("cast(k % 3 = 0 as int)").alias("first")
    one = _exploded(known, "0, 1").select("region", "k", _get("letter", "k").alias("c0"), _get("name_less", "k - floor((k + 1) / 3)").alias("c1"), first)
    two = _exploded(known, "0, 2").select("region", "k", _get("letter", "k").alias("c0"), _get("letter", "k + 1").alias("c1"), _get("name_less", "k + 1 - floor((k + 2) / 3)").alias("c2"), first)
    one, two = _places(one, ["c0", "c1"], "one"), _places(two, ["c0", "c1", "c2"], "two")
    met = known.join(one, "region", "left").join(two, "region", "left")
    # Of letters 0, 1, 2 of three, ``one`` lists 0 and 1, ``two`` 0 and 2, the names 1 and 2, each in order.
    place = """transform(letter, (c, k) -> case k % 3
        when 0 then get(one_less, cast(2 * k / 3 as int)) + get(two_less, cast(2 * k / 3 as int)) - get(two_less0, cast(2 * k / 3 as int))
        when 1 then get(name_less, cast(2 * (k - 1) / 3 as int)) + get(one_less0, cast(2 * (k - 1) / 3 as int) + 1)
        else get(name_less, cast(2 * (k - 2) / 3 as int) + 1) + get(two_less0, cast(2 * (k - 2) / 3 as int) + 1) end)"""
    return met.select("region", F.expr(place).alias("place"))


def _neighbours(batches):
    """Over suffixes in order: whether a suffix agrees with the one before or behind it in all its windows."""
    schema = pa.schema([("region", pa.int64()), ("k", pa.int32()), ("repeats", pa.bool_()), ("behind", pa.bool_())])
    waiting = None  # the last suffix, which still needs the one behind it

    carried = False
    for batch in batches:
        if not batch.num_rows:
            continue
        region, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        column = batch.column(2)
        held = np.stack([column.fill_null(0).to_numpy(zero_copy_only=False), np.where(column.is_null().to_numpy(zero_copy_only=False), -1, 1)])
        if waiting is not None:
            region, k = np.concatenate((waiting[0], region)), np.concatenate((waiting[1], k))
            held = np.concatenate((waiting[2], held), axis=1)
        behind = np.zeros(len(k), bool)
        behind[1:] = (held[0][1:] == held[0][:-1]) & (held[1][1:] > 0) & (held[1][:-1] > 0)
        behind[0] = carried
        repeats = behind.copy()
        repeats[:-1] |= behind[1:]
        n = len(k) - 1
        yield pa.RecordBatch.from_arrays([pa.array(c[:n]) for c in (region, k, repeats, behind)], schema=schema)
        waiting, carried = (region[n:], k[n:], held[:, n:]), bool(behind[n])
    if waiting is not None:
        yield pa.RecordBatch.from_arrays([pa.array(waiting[0]), pa.array(waiting[1]), pa.array([carried]), pa.array([carried])], schema=schema)


def _windows(length: int):
    """Rows of the windows that need the exact check, one digest each."""

    def windows(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for region, data, first, to, group, open_ in zip(*(batch.column(c).to_pylist() for c in range(6))):
                for a, b, g, o in zip(first, to, group, open_):
                    for at in range(a, min(b, len(data) - length + 1)):
                        for column, value in zip(out, (g, _number(data[at : at + length]), region, at, o)):
                            column.append(value)
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], ["shared", "window", "region", "at", "open"])
                    out = [[] for _ in range(5)]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], ["shared", "window", "region", "at", "open"])

    return windows


def repeated_spans(regions: DataFrame, length: int) -> DataFrame:
    """region and spans (start, end of repeated windows, joined) of stored regions (region, body, copies)."""
    letters = materialise(regions.select("region", "body").mapInArrow(_letters(length), "region long, at array<int>, letter array<long>, shared array<long>, held array<long>"))
    places = letters.join(suffix_places(letters.select("region", "letter")), "region")
    suffixes = places.select("region", F.posexplode(F.arrays_zip("place", "held")).alias("k", "s")).select("region", "k", "s.held", "s.place")
    compared = suffixes.orderBy("place", "region", "k").select("region", "k", "held").mapInArrow(_neighbours, "region long, k int, repeats boolean, behind boolean")
    compared = materialise(_listed(compared, "is", "repeats", "behind"))

    # Windows of letter k start at its bytes; what they share are the bytes from the next letter on. Before the first letter
    # there is a head with windows of its own.
    every = regions.select("region", "copies").join(letters.drop("letter", "held"), "region").join(compared, "region", "left")
    parts = every.where(F.size("at") > 0).select("region", "copies", "at", "shared", "is_repeats", "is_behind", F.expr("explode(sequence(-1, size(at) - 2))").alias("k"))
    parts = parts.select(
        "region",
        F.expr("if(k < 0, 0, get(at, k))").alias("first"),
        F.expr("get(at, k + 1)").alias("to"),
        F.expr("get(shared, k + 1)").alias("shared"),
        F.expr("k >= 0 and coalesce(get(is_repeats, k), false)").alias("agrees"),
        F.expr("copies > 1").alias("copied"),
        F.expr("k >= 0 and coalesce(get(is_behind, k), false)").alias("behind"),
    )
    parts = materialise(parts.where((F.col("shared").isNotNull()) & (F.col("to") > F.col("first"))))
    open_ = ~F.col("agrees") & ~F.col("copied")
    senders = parts.where(~F.col("behind"))
    active = senders.groupBy("shared").agg(F.count(F.lit(1)).alias("n"), F.max(open_).alias("open")).where("n > 1 and open").select("shared")
    asked = senders.join(active, "shared", "left_semi").groupBy("region").agg(F.sort_array(F.collect_list(F.struct("first", "to", "shared", open_.alias("open")))).alias("w"))
    asked = regions.select("region", "body").join(asked, "region").select("region", "body", "w.first", "w.to", "w.shared", "w.open")
    windows = materialise(asked.mapInArrow(_windows(length), "shared long, window long, region long, at int, open boolean"))
    again = windows.groupBy("shared", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    checked = windows.where("open").join(again, ["shared", "window"], "left_semi")
    settled = parts.where("agrees").select("region", F.col("first").alias("start"), (F.col("to") - 1 + length).alias("end"))
    twice = regions.where("copies > 1").select("region", F.lit(0).alias("start"), F.octet_length("body").alias("end"))
    found = settled.unionByName(checked.select("region", F.col("at").alias("start"), (F.col("at") + length).alias("end"))).unionByName(twice)
    return found.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _remover(batches):
    for batch in batches:
        spans, kept = [], []
        for data, whole, starts, found in zip(_texts(batch.column(2)), batch.column(3).to_pylist(), batch.column(4), batch.column(5)):
            if whole is not None:
                spans.append([])
                kept.append(whole)
                continue
            edge = np.zeros(len(data) + 1, np.int32)
            for place, part in zip(np.asarray(starts.values), found.values):
                if part.is_valid:
                    start, end = (np.asarray(part.values.field(c)) for c in ("start", "end"))
                    np.add.at(edge, place + start, 1)
                    np.add.at(edge, np.minimum(place + end, len(data)), -1)
            gone = np.cumsum(edge[:-1]) > 0
            bounds = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
            start, end = np.flatnonzero(bounds == 1), np.flatnonzero(bounds == -1)
            spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(start, end)])
            kept.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "spans", "kept_sha256"])


def drop_repeated_bytes(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start and length of what goes, in bytes, maximal) and kept_sha256 of every row.

    A byte goes if a string of ``length`` bytes holds it that also starts elsewhere in the table, be it in the same row;
    overlaps count, and strings are judged on the input. Null and empty texts and those shorter than ``length`` keep all. Every
    row is a document of its own: rows that repeat, with or without an id, repeat each other's strings. ``length`` must be at
    least ``4 * SPACING``, so that every window holds whole letters. Other columns do not matter.
    """
    if length < 4 * SPACING + GRAM:
        raise ValueError(f"length must be at least {4 * SPACING + GRAM}")
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.xxhash64(doc_id, text).alias("key"))
    marks = rows.select("key", "text").mapInArrow(_screen(length), "mark long, key long")
    marks = materialise(marks)
    again = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    marked = marks.join(again, "mark", "left_semi").groupBy("key").agg(F.collect_set("mark").alias("marks"))
    held = rows.join(marked, "key", "left").select("doc_id", "text", "marks").mapInArrow(_holder(length), _HELD.format(kind))
    held = materialise(held.withColumn("row", F.monotonically_increasing_id()))
    release(marks)
    parts = held.where("whole is null").select("row", "body", F.posexplode(F.arrays_zip("starts", "lengths", "digests")).alias("nth", "p"))
    bodies = parts.select(F.col("p.digests").alias("digest"), F.expr("substring(body, p.starts + 1, p.lengths)").alias("body"))
    regions = bodies.groupBy("digest").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("copies"))
    regions = materialise(regions.withColumn("region", F.monotonically_increasing_id()))
    spans = regions.select("region", "digest").join(repeated_spans(regions.drop("digest"), length), "region").select("digest", "spans")
    found = held.where("whole is null").select("row", F.posexplode("digests").alias("nth", "digest")).join(spans, "digest", "left")
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("nth", "spans"))).alias("f")).select("row", F.col("f.spans").alias("found"))
    met = held.join(found, "row", "left").select("doc_id", "n_bytes", "body", "whole", "starts", "found")
    return met.mapInArrow(_remover, f"doc_id {kind}, n_bytes long, spans {SPANS}, kept_sha256 string")
