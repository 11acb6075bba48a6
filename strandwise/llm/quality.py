"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are trigrams of character classes over the whole text and marks for words that repeat an earlier
one nearby.  Their damped counts, weighted by inverse document frequency, are projected on the leading singular
vectors of a bounded sample of labelled rows.  The sample's vectors are broadcast; every document takes exact
cosine products with all of them, block by block, and its NEIGHBOURS nearest vote, weighted by similarity.

The fit reads at most SAMPLE labelled rows (half of each label where there are enough), the first in a seeded
order; scoring reads every row.  Labels, lang, source and doc_id are never inputs of a score.

Null and empty texts have no terms; their vector is zero and they get the sample's mean vote for such texts,
which is the score 0: nothing is no good text.  Rows with a null label are not learned from; a label for an absent
document is not used; repeated rows are scored each.  Without any labels every score is 0.5.  An empty table gives
an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from strandwise.llm.common import documents, mix, small_batches, text_batches
from strandwise.llm.words import Words

#: Labelled rows that the fit may read.
SAMPLE = 4000
TERMS, FACTORS, NEIGHBOURS = 1024, 48, 15
THRESHOLD = 0.3
#: Terms for words that repeat one of the last few words.
_REPEATS = 4


def _classes() -> np.ndarray:
    """Class of each byte: letters by case, digits, blanks, line ends; every other ASCII sign is its own."""
    table = np.arange(256, dtype=np.uint64) + np.uint64(10)
    table[ord("a") : ord("z") + 1] = 1
    table[128:] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[[32, 9]] = 4
    table[10:14] = 5
    return table


def term_counts(texts: pa.Array) -> np.ndarray:
    """A row of TERMS counts for each text."""
    words = Words(texts)
    n_docs = len(words.counts)
    kinds = _classes()[words.data]
    out = np.zeros((n_docs, TERMS), np.float32)
    if len(kinds) > 2:
        grams = mix(kinds[:-2] * np.uint64(1 << 20) + kinds[1:-1] * np.uint64(1 << 10) + kinds[2:], 41)
        slot = (grams % np.uint64(TERMS - _REPEATS)).astype(np.int64)
    for i in range(n_docs):
        a, b = words.offsets[i], words.offsets[i + 1]
        if b - a > 2:
            out[i, : TERMS - _REPEATS] = np.bincount(slot[a : b - 2], minlength=TERMS - _REPEATS)
        h = words.hashes[words.first[i] : words.first[i + 1]]
        for k in range(1, _REPEATS + 1):
            if len(h) > k:
                out[i, TERMS - k] = 4 * np.count_nonzero(h[k:] == h[:-k])
    return out


def damped(counts: np.ndarray) -> np.ndarray:
    """Square roots of term shares: texts of any length are alike, and rare terms count."""
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


class Model:
    """The projection and the sample's unit vectors and labels: at most SAMPLE x FACTORS and TERMS x FACTORS numbers."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray) -> None:
        """Rows are weighted a block at a time, so the driver holds little more than the counts."""
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
        blocks = [slice(i, i + 256) for i in range(0, len(counts), 256)]
        self.mean = sum(self._weighted(counts[b]).sum(axis=0) for b in blocks) / len(counts)
        spread = np.zeros((counts.shape[1], counts.shape[1]))
        for b in blocks:
            centred = self._weighted(counts[b]) - self.mean
            spread += centred.T @ centred
        values, vectors = np.linalg.eigh(spread)
        self.basis = vectors[:, np.argsort(values)[::-1][:FACTORS]].astype(np.float32)
        self.vectors = np.concatenate([self._placed(counts[b]) for b in blocks])
        self.labels = labels.astype(np.float32)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        return unit(damped(counts) * self.idf)

    def _placed(self, counts: np.ndarray) -> np.ndarray:
        return unit((self._weighted(counts) - self.mean) @ self.basis).astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        own = self._placed(counts)
        near = own @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1), 1e-6) ** 4
        votes = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        return np.where(counts.sum(axis=1) > 0, np.clip(votes, 0, 1), 0.0)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from labelled rows that are not held out, in the same way whenever and however they are dealt.

    A doc_id with labels of both kinds is left out; of several texts under one doc_id the one with the smallest hash counts.
    """
    spark = docs.sparkSession
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = rows.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    order = F.md5(F.concat(F.lit("sample"), F.col("doc_id").cast("string")))
    picked = [rows.where(F.col("quality") == q).select("doc_id", "quality").orderBy(order, "doc_id").limit(sample // 2) for q in (0, 1)]
    chosen = {r["doc_id"]: r["quality"] for r in picked[0].unionByName(picked[1]).collect()}  # at most `sample` rows
    if not chosen:
        return None
    few = spark.createDataFrame(list(chosen.items()), "doc_id long, quality int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            counts = pa.array([c.astype(np.float32).tobytes() for c in term_counts(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), batch.column("hash"), counts], ["doc_id", "quality", "hash", "counts"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("hash")).join(F.broadcast(few), "doc_id")
    rows = own.mapInArrow(run, "doc_id long, quality int, hash string, counts binary").groupBy("doc_id")
    rows = rows.agg(F.first("quality").alias("quality"), F.min(F.struct("hash", "counts"))["counts"].alias("counts"))
    table = rows.toArrow().sort_by("doc_id")  # at most `sample` rows of TERMS numbers
    if not table.num_rows:
        return None
    counts = np.frombuffer(b"".join(c.as_buffer() for c in table["counts"]), np.float32).reshape(-1, TERMS)
    return Model(counts, table["quality"].to_numpy())


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with a column score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [c for c in docs.columns if c != "score"]
    rows = docs.select(*extra)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = batch.column(names.index("text"))
            scores = np.full(batch.num_rows, 0.5) if shared.value is None else shared.value.score(term_counts(texts)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*names, "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("score", DoubleType()))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
