"""Substring deduplication by recompression.

Each document is a sequence of words.  A round of recompression names every maximal run of one symbol, then every
pair of a left symbol and a right symbol; which symbols are left is a hash bit of the symbol and the round.  A name
is a hash of what it stands for, so all tasks agree on it without asking, and equal substrings get equal symbols
except near their ends.  With each symbol goes the span of words that decided it: inside a window of WINDOW words, a
symbol whose span the window holds is the same wherever the window stands.

A window's anchor is the longest such symbol of the last round (ties by hash, then the first), or of the round before
where the last has none, and so on for FALLBACKS rounds; at last two unequal words.  Windows in a row with one anchor form a block.  Equal
windows have equal anchors in the same place.  Windows of one word again and again are their own anchors.

1. A block's anchor is looked up over all documents.  An anchor in one document only means that none of its
   windows repeats.
2. Blocks with one anchor and equal words are equal window for window: all but the smallest doc_id's are repeats.
3. Where an anchor has blocks that differ, the smallest doc_id of each block gives its words.  They are laid beside
   those of one reference, the block in most documents, anchor on anchor: windows without a difference repeat
   the reference's.  Only the windows over a difference are sent one by one, as hashes of 128 bits; such a window
   repeats if a smaller doc_id sent it.

Null texts have no words.  Rows with one doc_id are the same document for the order of documents: neither removes
from the other.  What is removed from a row goes by its doc_id and its text's hash.  A null doc_id comes after all
others, in one place with the largest number of 64 bits.  An empty table gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import BITMAP_BITS, bitmap_of, documents, in_bitmap, mix, stored, text_batches, within
from strandwise.llm.words import Words, sequence_hashes, sequence_values

WINDOW = 50
#: Rounds of recompression; after five a symbol is about four words and its span about thirty, well inside a window.
ROUNDS = 5
#: Rounds, from the last, in which a window may find its anchor.
FALLBACKS = 3
_LAST = (1 << 63) - 1


def recompress(symbols: np.ndarray, first: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, ...]]:
    """For each round, the last first: its symbols, the span [lo, hi) of words that decided each, the sum of its words' weights.

    first: index of each document's first word, and the end.  A symbol decided by a document's edge has a span
    beyond the document, so that no window holds it.
    """
    n = len(symbols)
    far = np.int64(1 << 40)
    name, weight = symbols.copy(), weights.copy()
    lo, hi = np.arange(n, dtype=np.int64), np.arange(1, n + 1, dtype=np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def beside(doc, lo, hi):
        """For each symbol, the span of its left and of its right neighbour; an edge is far."""
        same = doc[1:] == doc[:-1]
        left, right = np.full(len(doc), -far), np.full(len(doc), far)
        left[1:][same] = lo[:-1][same]
        right[:-1][same] = hi[1:][same]
        return left, right

    states = []
    for r in range(rounds):
        if not len(name):
            break
        # runs
        left, right = beside(doc, lo, hi)
        begins = np.ones(len(name), bool)
        begins[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(begins)
        end = np.append(at[1:], len(name)) - 1
        length = end - at + 1
        name = np.where(length > 1, mix(name[at] + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2 * r + 21), name[at])
        lo, hi, doc, weight = np.minimum(left[at], lo[at]), np.maximum(right[end], hi[end]), doc[at], np.add.reduceat(weight, at)
        # pairs
        left, right = beside(doc, lo, hi)
        is_left = (mix(name, 101 + r) & np.uint64(1)) == 0
        joined = np.zeros(len(name), bool)
        joined[:-1] = is_left[:-1] & ~is_left[1:] & (doc[1:] == doc[:-1])
        second = np.zeros(len(name), bool)
        second[1:] = joined[:-1]
        pair = np.flatnonzero(joined)
        alone = ~joined & ~second
        # a symbol that finds no partner saw the neighbour on its open side
        lo, hi = np.where(alone & ~is_left, np.minimum(lo, left), lo), np.where(alone & is_left, np.maximum(hi, right), hi)
        name[pair] = mix(name[pair] * np.uint64(0xC2B2AE3D27D4EB4F) + name[pair + 1], 2 * r + 22)
        lo[pair], hi[pair] = np.minimum(lo[pair], lo[pair + 1]), np.maximum(hi[pair], hi[pair + 1])
        weight[pair] += weight[pair + 1]
        keep = ~second
        name, lo, hi, doc, weight = name[keep], lo[keep], hi[keep], doc[keep], weight[keep]
        states.append((name, lo, hi, weight))
    return states[::-1]


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a slice of documents: first word, the anchor's name, its first word and whether there is one."""
    counts = words.counts
    sizes = np.maximum(counts - WINDOW + 1, 0)
    starts = np.repeat(words.first[:-1], sizes) + _within(sizes)
    name_at, lo_at = np.zeros(len(words.hashes) + 1, np.uint64), np.zeros(len(words.hashes) + 1, np.int64)
    open_ = np.zeros(len(words.hashes) + 1, bool)
    open_[starts] = True
    symbols, letters = mix(words.hashes, 5), words.ends - words.starts
    edge = np.flatnonzero(symbols[1:] != symbols[:-1])  # where long runs of words meet, only that names a window's place
    edges = mix(symbols[edge] * np.uint64(0xC2B2AE3D27D4EB4F) + symbols[edge + 1], 20), edge, edge + 2, letters[edge] + letters[edge + 1]
    for level, (name, lo, hi, weight) in enumerate([*recompress(symbols, words.first, letters)[:FALLBACKS], edges]):
        if not open_.any():
            break
        # A symbol lies in the windows that begin from hi - WINDOW to lo.
        before = np.append(0, np.cumsum(open_))
        fits = np.flatnonzero((hi - lo <= WINDOW) & (lo >= 0))
        fits = fits[before[lo[fits] + 1] > before[np.maximum(hi[fits] - WINDOW, 0)]]
        name, lo, hi, weight = name[fits], lo[fits], hi[fits], weight[fits]
        # The least-ranked one wins each window: a symbol of many letters, as few common words rarely say where a
        # window comes from.
        rank = (np.uint64(255) - np.minimum(weight, 255).astype(np.uint64) << np.uint64(56)) | (mix(name, 77) >> np.uint64(8))
        order = np.argsort(rank, kind="stable")[::-1]
        from_ = np.maximum(hi - WINDOW, 0)[order]
        span = lo[order] - from_ + 1
        where, of = np.repeat(from_, span) + _within(span), np.repeat(order, span)
        where, of = where[open_[where]], of[open_[where]]
        name_at[where], lo_at[where] = mix(name, 201 + level)[of], lo[of]  # the last write stays: the least rank
        open_[where] = False
    return starts, name_at[starts], lo_at[starts], ~open_[starts]


def _within(sizes: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n of sizes, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def blocks(words: Words) -> tuple[np.ndarray, ...]:
    """Maximal rows of windows with one anchor: document, first window, number of windows, anchor, its place from the first word, hash of the words."""
    starts, name, lo, has = anchors(words)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty, empty
    doc = words.doc[starts]
    alone = np.flatnonzero(~has)  # equal windows in a row, as in a run of a word, have one anchor
    name[alone], lo[alone] = sequence_hashes(words, starts[alone], starts[alone] + WINDOW, 3), -1
    new = np.ones(len(starts), bool)
    new[1:] = (name[1:] != name[:-1]) | (lo[1:] != lo[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(starts)))
    end = starts[at] + np.where(has[at], many - 1, 0) + WINDOW
    text = sequence_hashes(words, starts[at], end, 2)
    return doc[at], starts[at], many, name[at].view(np.int64), np.where(has[at], lo[at] - starts[at], 0), text.view(np.int64)


def _blocks_table(docs: DataFrame) -> DataFrame:
    """doc_id, key, anchor, words (hash), at (first word in the document), many, lead (the anchor's place in the block): the blocks of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            words = Words(batch.column("text"))
            doc, at, many, anchor, lead, text = blocks(words)
            ids, keys = (batch.column(c).to_numpy()[doc] for c in ("doc_id", "key"))
            arrays = [ids, keys, anchor, text, (at - words.first[doc]).astype(np.int32), many.astype(np.int32), lead.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["doc_id", "key", "anchor", "words", "at", "many", "lead"])

    return docs.mapInArrow(run, "doc_id long, key long, anchor long, words long, at int, many int, lead int")


def _slot(*columns):
    return F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS))


def _block_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (doc_id, key, at, many and others) with hashes, the 64-bit hashes of the block's words."""
    others = [f for f in wanted.schema.fields if f.name not in ("doc_id", "key")]
    lists = stored(wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct(*[f.name for f in others])).alias("blocks")), "wanted")  # a document's own blocks bound the list
    touched = docs.sparkSession.sparkContext.broadcast(bitmap_of(lists, F.col("doc_id"), F.col("key")))
    some = within(docs, touched, "doc_id", "key").dropDuplicates(["doc_id", "key"]).join(lists, ["doc_id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            words = Words(batch.column("text"))
            lists_ = batch.column("blocks")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(lists_.offsets.to_numpy()))
            flat = lists_.flatten()
            own = {f.name: flat.field(f.name) for f in others}
            start = words.first[doc] + own["at"].to_numpy()
            size = own["many"].to_numpy() + (WINDOW - 1)
            hashes = words.hashes[np.repeat(start, size) + _within(size)].tobytes()
            ends = np.append(0, np.cumsum(size * 8)).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(hashes)])
            ids, keys = (batch.column(c).take(pa.array(doc)) for c in ("doc_id", "key"))
            yield pa.RecordBatch.from_arrays([ids, keys, *own.values(), binary], ["doc_id", "key", *own, "hashes"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return some.select("doc_id", "key", "text", "blocks").mapInArrow(run, f"doc_id long, key long, {kinds}, hashes binary")


def _beside(blocks_: DataFrame) -> DataFrame:
    """doc_id, key, at, many, w1, w2: windows equal to the reference's in a smaller doc_id (w1 null), and hashes of all that are not.

    blocks_: doc_id, key, anchor, at, many, lead, hashes, first (the anchor's smallest doc_id) and reference, of the anchor's
    reference block.  The reference sends its windows where a smaller doc_id may hold some.
    """
    ours = blocks_.where("not reference or first < doc_id")
    theirs = blocks_.where("reference").select("anchor", F.col("doc_id").alias("r_doc"), F.col("lead").alias("r_lead"), F.col("hashes").alias("r_hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, at, many, lead, r_doc, r_lead, is_ref = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "key", "at", "many", "lead", "r_doc", "r_lead", "reference"))
            hashes = [np.frombuffer(x, np.uint64) for x in batch.column("hashes").to_pylist()]
            r_hashes = [np.frombuffer(x, np.uint64) for x in batch.column("r_hashes").to_pylist()]
            equal = [np.zeros(0, bool)]
            for k, (x, y) in enumerate(zip(hashes, r_hashes)):
                off = lead[k] - r_lead[k]  # word i here is word i - off there
                a, b = max(0, off), min(len(x), len(y) + off)
                differ = np.ones(len(x), np.int32)
                if b > a and not is_ref[k]:
                    differ[a:b] = x[a:b] != y[a - off : b - off]
                sums = np.append(0, np.cumsum(differ))
                equal.append(sums[WINDOW:] == sums[:-WINDOW] if r_doc[k] < ids[k] else np.zeros(many[k], bool))
            equal = np.concatenate(equal)
            row = np.repeat(np.arange(len(many)), many)
            place = _within(many)
            base = np.repeat(np.cumsum(many + (WINDOW - 1)) - (many + (WINDOW - 1)), many) + place
            flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
            w1, w2 = (sequence_values(flat, base, base + WINDOW, s).view(np.int64) for s in (3, 4))
            # rows of windows that repeat, and of equal windows in a row, are one row each
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (equal[1:] != equal[:-1]) | (~equal[1:] & ((w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(row)))
            row, gone = row[first], pa.array(equal[first])
            arrays = [pa.array(ids[row]), pa.array(keys[row]), pa.array((at[row] + place[first]).astype(np.int32)), pa.array(count.astype(np.int32))]
            arrays += [pc.if_else(gone, pa.scalar(None, pa.int64()), pa.array(w[first])) for w in (w1, w2)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "at", "many", "w1", "w2"])

    columns = ["doc_id", "key", "at", "many", "lead", "hashes", "reference", "r_doc", "r_lead", "r_hashes"]
    return ours.join(theirs, "anchor").select(*columns).mapInArrow(run, "doc_id long, key long, at int, many int, w1 long, w2 long")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, key, at, many: rows of windows (first word in the document, number) that also start in a smaller doc_id.  docs: doc_id, key, text."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    found = stored(_blocks_table(docs), "blocks")
    ends = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("words").alias("first"), F.max("words").alias("last"))
    shared = stored(ends.where("low < high").select("anchor", (F.col("first") < F.col("last")).alias("unsure")), "shared")
    # Few anchors are shared; a bitmap of them spares the other blocks the moves that follow.
    some = stored(within(found, send(bitmap_of(shared, F.col("anchor"))), "anchor").join(shared, "anchor"), "shared-blocks")
    holder = F.struct("doc_id", "key", "at", "many", "lead")
    by_words = some.groupBy("anchor", "words").agg(F.min(holder).alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("copies"), F.first("unsure").alias("unsure"))
    by_words = stored(by_words, "sequences")
    # Equal blocks: all but the smallest doc_id's repeat.
    low = by_words.where("low.doc_id < high").select("anchor", "words", F.col("low.doc_id").alias("low"))
    same = some.join(low, ["anchor", "words"]).where("doc_id > low").select("doc_id", "key", "at", "many")
    # Anchors with several blocks: the smallest holder of each lays its words beside the reference's.
    unsure = by_words.where("unsure").select("low.*", "anchor", "words", "copies")
    chosen = unsure.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.min(F.struct(-F.col("copies"), F.col("doc_id"), F.col("words"))).alias("top"))
    marked = unsure.join(chosen, "anchor").select("doc_id", "key", "anchor", "at", "many", "lead", "first", (F.col("words") == F.col("top.words")).alias("reference"))
    marked = stored(marked, "marked")
    sent = stored(_beside(stored(_block_words(docs, marked), "unsure-blocks")), "windows")
    near = sent.where("w1 is null").select("doc_id", "key", "at", "many")
    windows = sent.where("w1 is not null")
    low = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    low = stored(low, "repeated")
    again = within(windows, send(bitmap_of(low, F.col("w1"), F.col("w2"))), "w1", "w2")
    single = again.join(low, ["w1", "w2"]).where("doc_id > low").select("doc_id", "key", "at", "many")
    return same.unionByName(near).unionByName(single)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words joined by one space) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64("text", F.col("doc_id").isNull()).alias("key"), "text", F.col("doc_id").isNull().alias("none"))
    covers = repeats(docs.drop("none")).groupBy("doc_id", "key").agg(F.collect_list(F.struct("at", "many")).alias("covers"))  # a document's own words bound the list
    covers = stored(covers, "covers")
    touched = spark.sparkContext.broadcast(bitmap_of(covers, F.col("doc_id"), F.col("key")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, none, text, cover in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "none", "text", "covers"))):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                kept, n = words, len(words)
                if cover:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [c["at"] for c in cover], 1)
                    np.add.at(edge, [c["at"] + c["many"] - 1 + WINDOW for c in cover], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                out.append((None if none else doc, n, n - len(kept), b" ".join(kept)))
            if out:
                ids, n, gone, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    def side(want: bool):
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(touched.value, batch.column("slot").to_numpy()) == want))

        return docs.withColumn("slot", _slot("doc_id", "key")).mapInArrow(pick, "doc_id long, key long, text string, none boolean, slot long").drop("slot")

    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    whole = side(False).withColumn("covers", F.lit(None).cast("array<struct<at:int,many:int>>")).mapInArrow(cut, schema)
    return whole.unionByName(side(True).join(covers, ["doc_id", "key"], "left").mapInArrow(cut, schema))


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = remove_repeats(documents(spark, sf_dir))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM win JOIN low USING (h) WHERE low < doc_id),
kept AS (
  SELECT r, count(gone.p) AS n, string_agg(CASE WHEN gone.p IS NULL THEN x END, ' ' ORDER BY p) AS t
  FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) LEFT JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
