"""From raw documents to packed token sequences, in five stages that each read what the one before kept.

1. ``quality``: documents that the quality rules or the classifier reject go.
2. ``near_duplicates``: of each group of near duplicates the document with the smallest id stays; documents without id count too.
3. ``pii``: personal data is replaced by its kind in the text.
4. ``mixing``: sources are evened out by temperature. Nothing clean is lost: every document is drawn at least once,
   documents of small sources up to 1.5 times on average.
5. ``packing``: documents are packed into sequences of at most 2,048 tokens.

The quality classifier is fitted on labelled documents of the raw table, so that it does not depend on what it keeps.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sensorframe.llm.mixing import mix_sources  # noqa: E402
from sensorframe.llm.ngram_join import jaccard_components  # noqa: E402
from sensorframe.llm.packing import pack  # noqa: E402
from sensorframe.llm.pii import scrub  # noqa: E402
from sensorframe.llm.quality import judge_quality, train_quality  # noqa: E402
from sensorframe.llm.store import materialise  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Rows that repeat a doc_id are judged by their own texts."""
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_quality(raw, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge_quality(docs, model, carry=True).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id, then the smallest hash of the row.

    Rows are grouped by their own text, whatever their id. A row without id is a document as well: it goes if it is near
    to one with an id or, of rows without, to one with a smaller hash. Rows that repeat an id with other texts are different
    documents, and each that is near to no other stays; of rows equal in all columns one stays. Rows are told apart by id
    and a 64-bit hash.
    """
    # Nulls do not enter a hash, so that their places are hashed too.
    docs = docs.withColumn("row_key", F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS)))
    found = jaccard_components(docs, doc_id="row_key").select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    stay = docs.select("row_key", "doc_id").join(found, "row_key").groupBy("component_id").agg(F.min(order).alias("s")).select("s.row_key")
    return docs.join(stay, "row_key", "left_semi").dropDuplicates(["row_key", "doc_id"]).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the text."""
    return scrub(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as drawn; a document drawn twice has two rows."""
    return mix_sources(docs, budget=None, most_repeats=1.5).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("packing", packing)]
#: A classifier, a tagger and a tokenizer take part, so no SQL can say it; tests/llm compares the stages with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stored and read back by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
