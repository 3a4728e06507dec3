"""Personal data in text: e-mail and IP addresses, card and phone numbers.

Patterns with checks find the plain cases. A character tagger (``tagger``) adds what they drop, such as a phone number
that runs into a card number. It reads overlapping windows of the whole text; a span cut by a window's edge is left
to the neighbour that holds it whole, and the spans of all windows are reconciled over the text. Every span
holds a digit or an ``@``, so a window without either needs no reading. The tagger is trained once per driver and
travels with the job; it is a few kilobytes, whatever the input's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.tagger import KINDS, WINDOW, Tagger, char_classes, decode, trained_tagger

#: Windows overlap by half; a span of the tagger is at most this long.
STRIDE = WINDOW // 2
#: Windows decoded at once.
BATCH = 1024

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
SPANS = "doc_id long, text string, spans array<struct<kind:string,start:int,end:int,base:boolean>>"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind: str, s: str) -> bool:
    """Checks that go with a kind, on a candidate span."""
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)
    if kind == "card":
        d = _digits(s)
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(s)) <= 15
    local, _, domain = s.partition("@")
    return bool(local) and LOCAL.issuperset(local) and DOMAIN.fullmatch(domain) is not None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each kind that do not overlap within the kind; those failing the checks are dropped."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for kind, pattern in (("ip", ADDRESS), ("card", CARD), ("phone", PHONE)):
        out.extend((kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(kind, m[0]))
    return out


def _windows(text: str) -> list[int]:
    """Starts of the windows that hold a trigger; the last window ends with the text."""
    hits = np.array([m.start() for m in TRIGGER.finditer(text)])
    last = max(len(text) - WINDOW, 0)
    grid = np.minimum(np.unique(np.concatenate([hits // STRIDE, np.maximum(hits // STRIDE - 1, 0)])) * STRIDE, last)
    return sorted(set(grid.tolist()))


def _tagged(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the runs of B followed by I."""
    found = []
    for b in np.flatnonzero(tags % 2 == 1):
        end = b + 1
        while end < len(tags) and tags[end] == tags[b] + 1:
            end += 1
        found.append(((int(tags[b]) - 1) // 2, int(b), int(end)))
    return found


def _reconciled(text: str, votes: dict[tuple[int, int, int], int], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of the tagger's spans over the whole text: those most windows agree on, longest first, none overlapping another
    or a pattern's span, each passing its kind's check."""
    taken = sorted((a, b) for _, a, b in base)
    found = []
    for kind, start, end in sorted(votes, key=lambda s: (-votes[s], s[1] - s[2], s[1], s[0])):
        if all(end <= a or start >= b for a, b in taken) and holds(KINDS[kind], text[start:end]):
            found.append((KINDS[kind], start, end))
            taken.append((start, end))
    return found


def _added(texts: list[str], bases: list[list[tuple[str, int, int]]], model: Tagger) -> list[list[tuple[str, int, int]]]:
    where = [(d, s) for d, t in enumerate(texts) for s in _windows(t)]
    votes: list[dict[tuple[int, int, int], int]] = [{} for _ in texts]
    classes: dict[int, np.ndarray] = {}
    for i in range(0, len(where), BATCH):
        part = where[i : i + BATCH]
        x = np.zeros((len(part), WINDOW), np.int8)
        for r, (d, s) in enumerate(part):
            if d not in classes:
                classes = {d: char_classes(texts[d])}
            own = classes[d][s : s + WINDOW]
            x[r, : len(own)] = own
        tags = decode(model, x)
        for r in np.flatnonzero(tags.any(1)):
            d, s = part[r]
            n = min(WINDOW, len(texts[d]) - s)
            for kind, a, b in _tagged(tags[r, :n]):
                if (a > 0 or s == 0) and (b < n or s + n == len(texts[d])):
                    span = (kind, s + a, s + b)
                    votes[d][span] = votes[d].get(span, 0) + 1
    return [_reconciled(t, v, b) if v else [] for t, v, b in zip(texts, votes, bases)]


def find_spans(docs: DataFrame, model: Tagger | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and spans (kind, start, end in code points, found by a pattern) of every row, in order of kind, then start.

    Null text is empty and holds nothing. Rows are read one by one, so repeated rows get equal spans and doc_id may
    be null. Other columns of ``docs`` are ignored; ``scrub`` keeps them.
    """
    model = model or trained_tagger()

    def find(batches):
        for batch in batches:
            for part in _parts(batch):
                texts, spans = _search(part.column(1), model)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), _span_array(spans)], ["doc_id", "text", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(find, SPANS)


def scrub(docs: DataFrame, model: Tagger | None = None, text: str = "text", mask: str = "<{}>") -> DataFrame:
    """``docs`` with every span of the text column replaced by its kind; all other columns stay as they are. Null stays null."""
    model = model or trained_tagger()
    at = docs.columns.index(text)

    def replace(batches):
        for batch in batches:
            for part in _parts(batch):
                texts, spans = _search(part.column(at), model)
                clean = pa.array([_masked(t, s, mask) if v else None for t, s, v in zip(texts, spans, part.column(at).is_valid().to_pylist())], pa.string())
                columns = [clean if i == at else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(replace, docs.schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, 500):
        yield batch.slice(i, 500)


def _search(column: pa.Array, model: Tagger) -> tuple[list[str], list[list[tuple[str, int, int, bool]]]]:
    texts = column.fill_null("").to_pylist()
    out: list[list[tuple[str, int, int, bool]]] = [[] for _ in texts]
    some = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
    bases = [base_spans(texts[i]) for i in some]
    for i, base, more in zip(some, bases, _added([texts[i] for i in some], bases, model)):
        out[i] = sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return texts, out


def _masked(text: str, spans: list[tuple[str, int, int, bool]], mask: str) -> str:
    """Overlapping spans are replaced once, by the kind of the first."""
    parts, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            parts += [text[done:start], mask.format(kind)]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def _span_array(spans: list[list[tuple[str, int, int, bool]]]) -> pa.Array:
    flat = [s for row in spans for s in row]
    kind, start, end, base = zip(*flat) if flat else ((), (), (), ())
    items = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(base, pa.bool_())], ["kind", "start", "end", "base"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(s) for s in spans]))), pa.int32()), items)
