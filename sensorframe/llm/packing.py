"""Token sequences of one size, packed online by the sum-of-squares rule.

Each task packs what it reads. Whole windows of a long document leave at once. A remainder goes to the open window
whose choice keeps the sum of squares of the level array least, where the level array counts open windows by fill.
Levels that many windows share are used up, levels that would fill up are avoided, so perfect fits stay likely.

Open windows are bounded. Beyond the bound, and at a task's end, the smallest are cut up to fill the largest, so no
window is left partly filled but the last; its tokens are cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.kept import kept

#: Words of the cache's younger half; the older half is as large at most.
CACHED = 300_000
#: Text whose words are looked up, and whose new words are encoded, at once.
TEXT_BYTES = 1 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Token ids of whole texts as packed unsigned 32-bit values, by way of a bounded cache of words.

    The tokenizer never joins anything over white space, so a text's ids are those of its words in turn. The new words of
    some megabytes of text are encoded together where they are letters, cut at the tokens that end a word; others one by one.
    """

    #: Letters, then signs of ASCII but the apostrophe: two parts that are always encoded apart.
    PARTS = re.compile(rb"([A-Za-z\x80-\xff]+)([!-&(-/:-@[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Lower-case letters need no normalising and no pattern: white space parts them already.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def _plain(word: bytes) -> bytes | None:
        """The word as the tokenizer sees it, if that is one run of letters whose lower case is beyond doubt."""
        if word.isascii():
            return word.lower()
        s = word.decode("utf-8", "replace")
        if s.isalpha() and is_normalized("NFC", s) and "\u03a3" not in s and "\u0130" not in s:
            return s.lower().encode()
        return None

    def _learn(self, words: Iterable[bytes]) -> None:
        young, old = self.young, self.old
        plain: set[bytes] = set()
        parted = []
        for w in words:
            if (known := old.get(w)) is not None:
                young[w] = known
            elif w.isalpha() and w.islower():
                plain.add(w)
            elif (m := self.PARTS.fullmatch(w)) and (head := self._plain(m[1])):
                tail = m[2]
                parted.append((w, head, tail))
                if head not in young:
                    if (known := old.get(head)) is not None:
                        young[head] = known
                    else:
                        plain.add(head)
                if tail not in young:
                    young[tail] = self._encode(tail.decode())
            else:
                young[w] = self._encode(w.decode("utf-8", "replace"))
        if plain:
            rows = list(plain)
            found = self.letters.encode_batch_fast([b" ".join(rows).decode()], add_special_tokens=False)
            ids = np.array(found[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(rows) and cuts[-1] == len(ids):
                packed, from_ = ids.tobytes(), 0
                for w, to in zip(rows, (4 * cuts).tolist()):
                    young[w] = packed[from_:to]
                    from_ = to
            else:
                young.update((w, self._encode(w.decode())) for w in rows)
        for w, head, tail in parted:
            young[w] = young[head] + young[tail]

    def many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of some texts, whose new words are learnt in one go."""
        # A special token is one only as it stands, before any change of case.
        whole = {i: self._encode(t.decode("utf-8", "replace")) for i, t in enumerate(texts) if b"<|" in t}
        words = [() if i in whole else (t.lower() if t.isascii() else t).split() for i, t in enumerate(texts)]
        every = set(chain.from_iterable(words))
        missing = every.difference(self.young)
        if len(self.young) + len(missing) > CACHED and self.young:
            self.old, self.young, missing = self.young, {}, every
        self._learn(missing)
        known = self.young.__getitem__
        return [whole[i] if i in whole else b"".join(map(known, w)) for i, w in enumerate(words)]

    def __call__(self, text: bytes) -> bytes:
        return self.many([text])[0]


def word_ids(path: str) -> WordIds:
    """The process's own tokenizer and cache; it stays between the tasks of a worker, until another operator's begin."""
    return kept(("word ids", path), lambda: WordIds(path))


class Packer:
    """Open windows of one task. A piece is (doc_id, doc_tokens, start, ids)."""

    def __init__(self, size: int, max_open: int, first_id: int):
        self.size, self.max_open, self.next_id = size, max_open, first_id
        self.level = np.zeros(size + 1, np.int64)
        self.windows: list[list[list[tuple]]] = [[] for _ in range(size)]
        self.n_open = 0
        self.closed: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, total, start, ids in pieces:
            n = len(ids) >> 2
            self.closed.append((doc_id, start, n, ids, total, self.next_id, at))
            at += n
        self.next_id += 1

    def _open(self, pieces: list[tuple], fill: int) -> None:
        if fill == self.size:
            self._close(pieces)
        else:
            self.windows[fill].append(pieces)
            self.level[fill] += 1
            self.n_open += 1

    def _take(self, fill: int) -> list[tuple]:
        self.level[fill] -= 1
        self.n_open -= 1
        return self.windows[fill].pop()

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, width = len(ids) >> 2, 4 * self.size
        whole = len(ids) // width * width
        for at in range(0, whole, width):
            self._close([(doc_id, total, at >> 2, ids[at : at + width])])
        if rest := (len(ids) - whole) >> 2:
            piece = (doc_id, total, whole >> 2, ids[whole:])
            fill = self._best(rest)
            self._open([*(self._take(fill) if fill else []), piece], fill + rest)
            if self.n_open > self.max_open:
                self._merge()

    def _best(self, n: int) -> int:
        """The level whose use changes the sum of squares least; 0 is a new window. Ties go to the fuller one."""
        level = self.level
        change = np.where(level[: self.size - n + 1] > 0, 1 - 2 * level[: self.size - n + 1], np.iinfo(np.int64).max // 2)
        change[0] = 0
        after = 2 * level[n : self.size + 1] + 1
        after[-1] = 0  # a full window is no longer counted
        change += after
        return int(self.size - n - np.argmin(change[::-1]))

    def _merge(self) -> None:
        """Cut the emptiest windows to fill the fullest; at most one window stays open."""
        fills = [f for f in range(self.size) for _ in range(int(self.level[f]))]
        rows = [(f, self._take(f)) for f in fills]
        low, high = 0, len(rows) - 1
        while low <= high:
            fill, pieces = rows[high]
            high -= 1
            while fill < self.size and low <= high:
                donor_fill, donor = rows[low]
                while donor and fill < self.size:
                    doc_id, total, start, ids = donor.pop()
                    n = min(len(ids) >> 2, self.size - fill)
                    pieces.append((doc_id, total, start, ids[: 4 * n]))
                    fill += n
                    donor_fill -= n
                    if 4 * n < len(ids):
                        donor.append((doc_id, total, start + n, ids[4 * n :]))
                rows[low] = (donor_fill, donor)
                low += not donor
            self._open(pieces, fill)

    def finish(self) -> None:
        self._merge()
        for fill in range(self.size):
            for _ in range(int(self.level[fill])):
                pieces = self._take(fill)
                while fill:
                    want, taken = 1 << (fill.bit_length() - 1), []
                    fill -= want
                    while want:
                        doc_id, total, start, ids = pieces.pop()
                        n = min(want, len(ids) >> 2)
                        taken.append((doc_id, total, start, ids[: 4 * n]))
                        want -= n
                        if 4 * n < len(ids):
                            pieces.append((doc_id, total, start + n, ids[4 * n :]))
                    self._close(taken)

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.closed:
            columns, self.closed = list(zip(*self.closed)), []
            kinds = [pa.binary() if f.endswith("binary") else pa.int64() for f in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, max_open: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its token ids followed by ``end_id``; null and empty texts are ``end_id`` alone. Every id lies in exactly
    one piece; a sequence's pieces lie gapless from offset 0. Every row is a document of its own, also where rows repeat
    or doc_id is null. ``size`` is a power of two. ``sequence_id`` holds the task's number in its upper bits, and a task
    is packed as a whole, so a task that runs again gives its sequences anew and clashes with none.
    ``tokenizer`` is a path that every executor can open. Other columns of ``docs`` are ignored.
    """
    end = np.uint32(end_id).tobytes()

    def texts(batches):
        keys, held, size = [], [], 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                held.append(value.as_buffer().to_pybytes() if value.is_valid else b"")
                size += len(held[-1])
                if size >= TEXT_BYTES:
                    yield keys, held
                    keys, held, size = [], [], 0
        yield keys, held

    def run(batches):
        words = word_ids(tokenizer)
        packer = Packer(size, max_open, TaskContext.get().partitionId() << 40)
        for keys, held in texts(batches):
            for key, ids in zip(keys, words.many(held)):
                packer.add(key, ids + end)
                if len(packer.closed) >= 4096:
                    yield from packer.drain()
        packer.finish()
        yield from packer.drain()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)
