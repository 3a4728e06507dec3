"""License texts in documents, found by patience alignment with templates.

Words are runs of letters and digits, A-Z lower-cased. Windows of a document that hold enough of a template's telling
words are aligned with it: words that occur once in both are anchors, the longest increasing run of anchors is
kept, and the gaps between them are aligned in the same way. The share of template words that find a partner
is the coverage. Windows are found in Arrow batches over whole texts; only they are aligned word by word.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.words import Splitter, pieces

# Notices as they are published.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
}
#: Words that tell nothing about a license.
PLAIN = frozenset("a an and any as at be by can for from in is it its of on or that the this to with you".split())
#: A window needs this share of the telling words to be aligned; an alignment this coverage to be reported.
NEEDED, COVERAGE = 0.6, 0.75
FOUND = "doc_id long, license string, start_word long, end_word long, matched long, coverage double"


def _increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence."""
    tails: list[int] = []
    tail_at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = tail_at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            tail_at.append(i)
        else:
            tails[k], tail_at[k] = v, i
    out, i = [], tail_at[-1] if tail_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (in ``a``, in ``b``), increasing in both.

    Equal ends are matched first; then words unique to both sides anchor, the longest increasing subsequence of them
    stays, and every gap between anchors is aligned again. A gap without such words stays unmatched.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        seen: dict = {}
        for side, words, lo, hi in ((0, a, a0, a1), (1, b, b0, b1)):
            for i in range(lo, hi):
                entry = seen.setdefault(words[i], [-1, -1, 0, 0])
                entry[side] = i
                entry[2 + side] += 1
        both = sorted((e[0], e[1]) for e in seen.values() if e[2] == e[3] == 1)
        anchors = [both[i] for i in _increasing([y for _, y in both])]
        if not anchors:
            continue
        out += anchors
        x0, y0 = a0, b0
        for x, y in [*anchors, (a1, b1)]:
            todo.append((x0, x, y0, y))
            x0, y0 = x + 1, y + 1
    return sorted(out)


class _Template:
    def __init__(self, name: str, text: str, splitter: Splitter):
        raw = np.frombuffer(text.encode(), np.uint8)
        words = splitter(raw, np.array([0, len(raw)]))
        self.name, self.words = name, words.hash.tolist()
        telling = [h for i, h in enumerate(self.words) if words.text(i).lower() not in PLAIN]
        self.telling = np.unique(np.array(telling, np.uint64))
        self.need = max(1, int(np.ceil(NEEDED * len(telling))))
        self.reach = len(self.words) + max(3, len(self.words) // 2)


def _search(words, d: int, hit: np.ndarray, template: _Template) -> list[tuple[int, int, int, float]]:
    """(start, end, matched, coverage) of the template in document ``d``, left to right, none overlapping another.

    ``hit`` holds the positions of telling words in the document.
    """
    found, done, base, last = [], int(words.first[d]), int(words.first[d]), int(words.first[d + 1])
    ahead = np.searchsorted(hit, hit + template.reach) - np.arange(len(hit))
    for p, n in zip(hit.tolist(), ahead.tolist()):
        if n < template.need or p < done:
            continue
        # The template may begin with words that tell nothing.
        lead = max(p - len(template.words) // 2, done)
        part = words.hash[lead : min(p + template.reach, last)].tolist()
        pairs = patience(part, template.words)
        coverage = len(pairs) / len(template.words)
        if coverage >= COVERAGE:
            start, end = lead + pairs[0][0], lead + pairs[-1][0] + 1
            found.append((start - base, end - base, len(pairs), coverage))
            done = end
    return found


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, start_word, end_word (exclusive), matched and coverage of every template found in every row.

    Null and empty texts hold none. Rows are read one by one, so repeated rows repeat their findings and doc_id may be
    null. Templates are judged on their own, so a header also counts as the notice that it begins with. Other columns
    are ignored; no templates give no rows.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        splitter = Splitter(lower=True, letters=True)
        known = [t for t in (_Template(n, x, splitter) for n, x in sorted(templates.items())) if len(t.telling)]
        vocabulary = np.unique(np.concatenate([t.telling for t in known])) if known else np.empty(0, np.uint64)
        member = np.stack([np.isin(vocabulary, t.telling) for t in known]) if known else np.empty((0, 0), bool)
        for batch in batches:
            rows = []
            for row, to, data, offsets in pieces(batch.column(1)):
                words = splitter(data, offsets)
                if not len(vocabulary) or not len(words.hash):
                    continue
                at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == words.hash)
                kind = at[hit]
                for t, template in enumerate(known):
                    own = hit[member[t][kind]]
                    doc = np.searchsorted(words.first, own, side="right") - 1
                    n_hits = np.bincount(doc, minlength=to - row)
                    edge = np.concatenate(([0], np.cumsum(n_hits)))
                    for d in np.flatnonzero(n_hits >= template.need):
                        for start, end, matched, coverage in _search(words, int(d), own[edge[d] : edge[d + 1]], template):
                            rows.append((row + int(d), template.name, start, end, matched, coverage))
            if rows:
                index, *columns = zip(*rows)
                ids = batch.column(0).take(pa.array(index))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], [f.split()[0] for f in FOUND.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, FOUND)
