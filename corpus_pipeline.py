"""The corpus pipeline: quality, near duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwise.llm import jaccard, mixing, packing, personal, quality
from strandwise.llm.common import documents, stored
from strandwise.sources.storage import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold stay."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs.select(*COLUMNS), model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest doc_id (null last); wordless rows stay all.

    Rows are told apart by _row, a hash of doc_id and text, so that a doc_id may be null or stand for several texts.
    """
    docs, ids = _rows(docs.select(*COLUMNS))
    groups = jaccard.near_duplicates(docs.select(F.col("_row").alias("doc_id"), "text"))
    groups = groups.groupBy(F.col("doc_id").alias("_row"), "component_id").agg((F.max("n_shingles") > 0).alias("worded"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "_row"))
    kept = groups.join(ids.select("_row", "id"), "_row").groupBy("component_id").agg(first.alias("first"), F.max("worded").alias("worded"))
    kept = kept.select("first._row", "worded")
    equal = W.partitionBy("_row").orderBy("lang", "source", "n_chars")  # rows of one doc_id and one text
    return docs.join(kept, "_row").withColumn("_no", F.row_number().over(equal)).where("_no = 1 or not worded").select(*COLUMNS)


def _rows(docs: DataFrame, slots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """docs with _row, and a table of _row and id.

    Different rows that share a 64-bit hash (about n^2 / 2^65 of n rows, so hundreds in 10^11) are hashed anew with another salt, they
    alone, until none share one.  slots: so few values for the hash, for tests.
    """
    hashed = lambda salt: F.xxhash64(F.lit(salt), F.col("doc_id").cast("long"), F.col("doc_id").isNull(), "text")
    place = lambda h: h if slots is None else F.pmod(h, F.lit(slots))
    row, salt = place(hashed(0)), 0
    while True:
        named = docs.withColumn("_row", row)
        ids = named.select("_row", F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash")).distinct()
        ids = stored(ids, "rows")
        shared = [r["_row"] for r in ids.groupBy("_row").count().where("count > 1").select("_row").collect()]
        if not shared:
            return named, ids
        salt += 1
        row = F.when(row.isin(shared), place(hashed(salt))).otherwise(row)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text."""
    changed = personal.redact(docs.select(*COLUMNS))
    return changed.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them; the one at a source's cut stands whole or not, whichever is nearer."""
    return mixing.taken_documents(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences along the curve, as pieces of documents."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("personal_data", redact), ("mixing", mix), ("packing", pack)]

#: The classifier, the personal-data graph and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
