"""Document fingerprints: canonical exact digests.

A text's canonical form is NFKC, case-folded, NFKC again, with every run of white space folded to one space
and none at the ends.  Its fingerprint is the 128-bit xxhash of that form in UTF-8.  Documents are grouped by
fingerprint and, inside a group, by the canonical bytes themselves, so a collision never joins two texts.

Null text counts as empty.  Rows with equal doc_id all stay, ordered by text; a null doc_id sorts below all
others.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import BITMAP_BITS, bitmap_of_slots, documents, in_bitmap, text_batches

_LOWEST = -(1 << 63)
#: Hexadecimal digits of a fingerprint that give its bit in the bitmap.
_DIGITS = 12


def canonical(text: str | None) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            prints = [digest(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def copy_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, copy_of: the smallest doc_id with the same canonical bytes, for texts that share a fingerprint.

    Only rows whose fingerprint occurs twice send their bytes; they are picked by a bitmap of fixed size, so a
    few others may come along, as groups of one.
    """
    spark = docs.sparkSession
    shared = fingerprints(docs).groupBy("fingerprint").count().where("count > 1")
    bits = spark.sparkContext.broadcast(bitmap_of_slots(shared.select((F.conv(F.substring("fingerprint", 1, _DIGITS), 16, 10).cast("long") % BITMAP_BITS).alias("slot"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            forms = [canonical(x) for x in batch.column("text").to_pylist()]
            prints = [xxhash.xxh3_128_hexdigest(c) for c in forms]
            slots = np.array([int(x[:_DIGITS], 16) for x in prints], np.int64) % BITMAP_BITS
            kept = np.flatnonzero(in_bitmap(bits.value, slots))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(kept)), pa.array([prints[i] for i in kept], pa.string()), pa.array([forms[i] for i in kept], pa.binary())],
                ["doc_id", "fingerprint", "canonical"],
            )

    some = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string, canonical binary")
    return some.groupBy("fingerprint", "canonical").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies")).where("copies > 1")


def with_next(docs: DataFrame, edit, schema: str) -> DataFrame:
    """Apply ``edit(doc_ids, texts, next_texts) -> RecordBatch`` along descending doc_id; the last row's next is the first.

    Rows are dealt to ranges of doc_id, each sorted within; the first row of a range is also sent to the range
    before, so no range needs another's rows and each text moves once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(_LOWEST)))
    n_ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("key", [(i + 1) / n_ranges for i in range(n_ranges - 1)], 20 * n_ranges)).first()[0]
    cuts = sorted(set(cuts or []))
    rows = rows.withColumn("range", _bisect(F.col("key"), cuts))
    tops = {r["range"]: r["top"] for r in rows.groupBy("range").agg(F.max("key").alias("top")).collect()}  # a row for each range
    if not tops:
        return spark.createDataFrame([], schema)
    order = sorted(tops)  # the next row after range r's smallest is the largest of the range below; below the lowest comes the highest
    to = {tops[r]: order[(i + 1) % len(order)] for i, r in enumerate(order)}
    lent = spark.createDataFrame([(int(k), int(v)) for k, v in to.items()], "key long, to int")
    extra = rows.join(F.broadcast(lent), "key").select("doc_id", "text", "key", F.col("to").alias("range"), F.lit(1).alias("lent"))
    placed = rows.select("doc_id", "text", "key", "range", F.lit(0).alias("lent")).unionByName(extra)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(n_parts, "range").sortWithinPartitions("range", "lent", F.desc("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, until its next is seen
        for batch in text_batches(batches):
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = table.slice(table.num_rows - 1, 1)
            n = table.num_rows - 1
            if not n:
                continue
            lent_, range_ = table.column("lent").to_numpy(), table.column("range").to_numpy()
            use = np.flatnonzero((lent_[:n] == 0) & (range_[:n] == range_[1:]))
            if len(use):
                texts = table.column("text")
                yield edit(table.column("doc_id").take(pa.array(use)), texts.take(pa.array(use)).to_pylist(), texts.take(pa.array(use + 1)).to_pylist())

    return placed.mapInArrow(run, schema)


def _bisect(key, cuts):
    """Number of cuts below ``key``, by halving steps over one array."""
    if not cuts:
        return F.lit(0)
    listed, n = F.lit(cuts), len(cuts)
    steps = F.lit([1 << k for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: low + F.when((low + step <= n) & (F.get(listed, low + step - 1) < key), step).otherwise(0))


def _edited(batch_ids: pa.Array, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    ids, n_chars, sha, own, other, near_e, near_n = batch_ids, [], [], [], [], [], []
    known = None, ""  # the next document's digest is its own when its turn comes
    for text, following in zip(texts, nexts):
        n = len(text)
        third = n // 3
        changed = text[: n - third] + following[:third]
        a, b, c = known[1] if text == known[0] else digest(text), digest(changed), digest(following)
        known = following, c
        n_chars.append(n)
        sha.append(hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest())
        own.append(a)
        other.append(b)
        near_e.append(float(a == b))
        near_n.append(float(a == c))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n_chars, pa.int64()), pa.array(sha), pa.array(own), pa.array(other), pa.array(near_e, pa.float64()), pa.array(near_n, pa.float64())],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The digest query: every text against its edited form and the next document, with its group of copies.

    near_* are 1.0 for equal fingerprints and 0.0 otherwise: an exact digest knows no partial likeness.
    copy_of is the smallest doc_id with the same canonical bytes, the row's own where there is no other.
    """
    made = with_next(docs, _edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    groups = copy_groups(docs).select("fingerprint", "copy_of")
    # Canonical forms with one fingerprint but different bytes would be a collision of 128 bits; they'd stay apart here.
    alone = groups.groupBy("fingerprint").agg(F.min("copy_of").alias("copy_of"), F.count("*").alias("forms"))
    return made.join(alone, "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.when(F.col("forms") == 1, F.col("copy_of")).otherwise(F.col("doc_id")).alias("copy_of"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
