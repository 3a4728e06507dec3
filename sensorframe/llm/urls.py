"""URL verdicts: rules on host and path first, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.linear import fit_logistic
from sensorframe.llm.words import pieces

WIDTH_BITS, GRAMS, SCALE = 14, (3, 4, 5), 20.0

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_GOOD = (
    "blog news docs wiki library school museum garden recipes weather science history travel maps forum code research health archive bakery cinema theatre "
    "lessons something everything within thinking thistle northern southern another feather gathering father brother nation station motion notion tension "
    "therapy theory thanks there their that whether rather estate harbour render ender thread thesis athens than hinter inner outer earth"
).split()
_BAD = "cheap-pills spam-farm casino-bonus free-money adult-video xxx-cams payday-loans replica-watch viagra-shop poker-online crack-keygen click-bait bet-slots hot-singles miracle-diet fake-followers phish-login torrent-warez escort-girls lottery-win ad-server ads-network banner-ads click-tracker pixel-tracking adult-club adult-xx".split()


def labelled_urls() -> list[tuple[str, int]]:
    """(host and path, 1 for block): each name in a few usual shapes."""
    rows = []
    for names, label in ((_GOOD, 0), (_BAD, 1)):
        for i, name in enumerate(names):
            rows += [(f"{name}.example.org/en/{1000 + i}", label), (f"www.{name}.example.net/de/{200 + i}.html", label), (f"m.{name}.example.com/fr/{30 + i}/", label), (f"{name}.com/{name}/{i}", label)]
    return rows


@dataclass
class UrlModel:
    weight: np.ndarray
    bias: float


def _slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams, document of each); digits are all alike, and no n-gram leaves its text."""
    b = data.copy()
    b[(b >= 48) & (b <= 57)] = 48
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    slots, docs = [], []
    for n in GRAMS:
        if len(b) < n:
            continue
        m = len(b) - n + 1
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + b[j : j + m]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - WIDTH_BITS)
        inside = owner[:m] == owner[n - 1 :]
        slots.append(h[inside].astype(np.int64))
        docs.append(owner[:m][inside])
    return (np.concatenate(slots), np.concatenate(docs)) if slots else (np.empty(0, np.int64), np.empty(0, np.int64))


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def train_urls(rows: list[tuple[str, int]] | None = None) -> UrlModel:
    """A model from a small table of (host and path, 1 for block); equal tables give equal weights."""
    rows = labelled_urls() if rows is None else rows
    slots, docs = _slots(*_joined([t for t, _ in rows]))
    x = []
    for d in range(len(rows)):
        found, n = np.unique(slots[docs == d], return_counts=True)
        x.append((found, SCALE * n / max(n.sum(), 1)))
    weight, bias = fit_logistic(x, np.array([y for _, y in rows]), 1 << WIDTH_BITS, l2=1e-4)
    return UrlModel(weight.astype(np.float32), bias)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as (length, rule, verdict), else null. ``rules`` is a short list in the caller's code."""
    hits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array(*hits)) if hits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def judge_urls(pages: DataFrame, model: UrlModel | None = None, rules=RULES, page_id: str = "page_id", url: str = "url", block_from: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability of block by the model) of every row.

    Null urls and those without ``://`` have empty host and path, fit no rule and get the model's verdict on the empty text. Of
    rules of equal length the larger by name wins. Repeated rows get equal results; other columns are ignored.
    """
    model = model or train_urls()

    def score(batches):
        for batch in batches:
            out = []
            for _, _, data, offsets in pieces(batch.column(3)):
                slots, docs = _slots(data, offsets)
                n = len(offsets) - 1
                total = np.bincount(docs, model.weight[slots], minlength=n) / np.maximum(np.bincount(docs, minlength=n), 1)
                out.append(1 / (1 + np.exp(-np.clip(SCALE * total + model.bias, -500, 500))))
            values = pa.array(np.concatenate(out) if out else np.empty(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), values], ["page_id", "host", "path", "score"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    scored = rows.withColumn("both", F.concat("host", "path")).mapInArrow(score, "page_id long, host string, path string, score double")
    hit = scored.withColumn("hit", _rule(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.col("score") >= block_from, "block").otherwise("allow")
    return hit.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", by_model).alias("verdict"), "score")
