"""Packing along a space-filling curve.

A document's token counts are hashed to a vector of few dimensions; its place on the Hilbert curve through them
is its sort key.  Documents are range-sorted by that key and laid end to end, and the line is cut every
``length`` tokens.  So neighbours on the curve share sequences and only the last sequence has padding.

A document is its ids and then an end id, as the file's tokenizer gives them, special strings in a text included.  Null and empty texts are the end id alone.  Equal rows are packed
each; a null doc_id stays null.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import documents, stored, text_batches, text_buffer

LENGTH, END_ID = 4096, 2
DIMS, BITS = 4, 8
#: Words whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 1_000_000
#: Latin letters and then signs: two pre-tokens, the letters in lower case.  No apostrophe, which could make a third.
#: Such words are merged many at a time.
_PLAIN = "^(?P<stem>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{1,40})(?P<tail>[.,;:!?$%&*#|()\"-]*)$"
#: Tokenizer files of this kind encode each word apart: no token crosses white space.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_END = "</w>"
_NONE = np.int32(2**31 - 1)


def wordwise(spec: dict) -> bool:
    """Whether a tokenizer file's texts can be encoded word by word, and words of letters by their merges alone."""
    model = spec["model"]
    plain = model["type"] == "BPE" and model["end_of_word_suffix"] == _END and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback", "unk_token"))
    apart = all("<" in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not set(t["content"]) & set(" \t\n\x0b\x0c\r") for t in spec["added_tokens"])
    return plain and apart and spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER and not spec["post_processor"]


class Merges:
    """A byte-pair model's merges over many words at once."""

    def __init__(self, model: dict) -> None:
        vocab = model["vocab"]
        self.size = np.int64(max(vocab.values()) + 1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] for a, _ in pairs], np.int64) * self.size + np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        signs = [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]  # the byte-level alphabet
        self.inner, self.last = (np.array([vocab[c + end] for c in signs], np.int32) for end in ("", _END))
        both = self.inner[:, None], np.concatenate([self.inner, self.last])[None, :]
        self.first = self.ranks(*np.broadcast_arrays(*both))  # of two bytes, the second maybe a word's last

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of the merge of each pair, _NONE where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def ids(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (bytes in a row, and how many each has), and how many each has.

        A step makes the first of the least merges in each word.
        """
        ends = np.cumsum(sizes) - 1
        tokens = self.inner[data]
        tokens[ends] = self.last[data[ends]]
        is_last = np.zeros(len(data), np.int32)
        is_last[ends] = 256
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rank = np.full(len(tokens), _NONE)
        rank[:-1] = self.first[data[:-1], is_last[1:] + data[1:]]
        rank[ends] = _NONE
        done = [(word[:0], tokens[:0])]
        while len(tokens):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            counts = np.diff(np.append(starts, len(tokens)))
            least = np.repeat(np.minimum.reduceat(rank, starts), counts)
            ready = least == _NONE
            done.append((word[ready], tokens[ready]))
            go = ~ready
            tokens, word, rank, least = tokens[go], word[go], rank[go], least[go]
            if not len(tokens):
                break
            at = np.flatnonzero(rank == least)
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
            tokens[at] = self.made[rank[at]]
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # one token before each goes
            tokens, word, rank = tokens[keep], word[keep], rank[keep]
            rank[at] = _NONE
            for left in (at, at[at > 0] - 1):
                left = left[left + 1 < len(tokens)]
                left = left[word[left] == word[left + 1]]
                rank[left] = self.ranks(tokens[left], tokens[left + 1])
        word, tokens = (np.concatenate(x) for x in zip(*done))
        return tokens[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))


class TextIds:
    """Ids of texts, in as few bytes as the file's vocabulary needs."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.merges = Merges(spec["model"]) if wordwise(spec) else None
        self.size = self.whole.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())  # what is remembered

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _each(self, words: pa.Array) -> pa.Array:
        """Ids of each word: of Latin letters and signs after them by the merges, of others by the tokenizer."""
        parts = pc.extract_regex(words, _PLAIN)
        plain = pc.is_valid(parts)
        out = [pa.array([self.encode(w) for w in words.filter(pc.invert(plain)).to_pylist()], pa.binary())]
        parts = parts.filter(plain)
        stems, tails = pc.utf8_lower(parts.field("stem")).dictionary_encode(), parts.field("tail").dictionary_encode()
        data, offsets = text_buffer(stems.dictionary)
        ids, sizes = self.merges.ids(data, np.diff(offsets))
        stem_ids = binary_rows(ids.astype(self.dtype), sizes).take(stems.indices)
        tail_ids = pa.array([self.encode(t) for t in tails.dictionary.to_pylist()], pa.binary()).take(tails.indices)
        out.append(pc.binary_join_element_wise(stem_ids, tail_ids, b""))
        order = np.argsort(np.append(np.flatnonzero(~plain.to_numpy(zero_copy_only=False)), np.flatnonzero(plain.to_numpy(zero_copy_only=False))))
        return pa.concat_arrays(out).take(pa.array(order))

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each begins, and the end; null is empty."""
        if self.merges is None:
            each = [np.frombuffer(self.encode(x or ""), self.dtype) for x in texts.to_pylist()]
            return np.concatenate([np.zeros(0, self.dtype), *each]), np.append(0, np.cumsum([len(x) for x in each])).astype(np.int64)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        place = pc.index_in(words, self.words).fill_null(-1).to_numpy()
        if len(self.words) + np.count_nonzero(place < 0) > REMEMBERED:
            self.words, self.ids, place = self.words[:0], self.ids[:0], np.full(len(words), -1)
        new = np.flatnonzero(place < 0)
        place = place.copy()
        place[new] = len(self.words) + np.arange(len(new))
        some = words.take(pa.array(new))
        self.words, self.ids = pa.concat_arrays([self.words, some]), pa.concat_arrays([self.ids, self._each(some)])
        ids = self.ids.take(pa.array(place))
        sizes = pc.binary_length(ids).to_numpy() // self.dtype.itemsize
        line = ids.take(coded.indices)
        flat = np.frombuffer(line.buffers()[2] or b"", self.dtype)
        ends = np.append(0, np.cumsum(sizes[coded.indices.to_numpy()]))
        offsets = split.offsets.to_numpy()
        at = ends[offsets - offsets[0]].astype(np.int64)
        return flat[: at[-1]], at


def binary_rows(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of the bytes of sizes elements each."""
    ends = np.append(0, np.cumsum(sizes)) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


@lru_cache(maxsize=2)
def _text_ids(path: str) -> TextIds:
    return TextIds(path)


def token_ids(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of each text."""
    flat, at = _text_ids(path).of(pa.array(texts, pa.string()))
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


@lru_cache(maxsize=2)
def _directions(size: int) -> np.ndarray:
    return np.random.RandomState(11).standard_normal((size, DIMS))


def document_vectors(flat: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashed projections of the documents' damped token counts, about normal in each dimension."""
    docs = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keys = np.sort(docs * size + flat)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    doc, kind = keys[first] // size, keys[first] % size
    counts = np.diff(np.append(first, len(keys)))
    out = np.zeros((len(at) - 1, DIMS))
    if len(first):
        begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        sums = np.add.reduceat(np.sqrt(counts)[:, None] * _directions(size)[kind], begins)
        out[doc[begins]] = sums / np.sqrt(np.add.reduceat(counts, begins))[:, None]
    return out


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of rows of unsigned coordinates, by Skilling's transpose form."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, curve, n, ids (little-endian, of the width of the vocabulary, without the end id) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _text_ids(path)
        for batch in text_batches(batches, most=1 << 22):
            flat, at = coder.of(batch.column("text"))
            vectors = document_vectors(flat, at, coder.size)
            grid = np.clip((np.tanh(0.6 * vectors) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
            columns = [batch.column("doc_id"), pa.array(hilbert_key(grid), pa.int64()), pa.array(np.diff(at) + 1), binary_rows(flat, np.diff(at))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "curve", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, curve long, n long, ids binary")


def line_starts(rows: DataFrame) -> DataFrame:
    """uid, at: where each row begins on the line of all rows ordered by (curve, doc_id, uid).

    Ranges of the order are summed apart; the sums, one for each range, then move the ranges.
    """
    spark = rows.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("uid", "curve", "doc_id", "n").repartitionByRange(n_parts, "curve", "doc_id", "uid").sortWithinPartitions("curve", "doc_id", "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(ends - n, pa.int64()), batch.column("n"), batch.column("part")], ["uid", "at", "n", "part"])
            at = int(ends[-1]) if len(ends) else at

    local = stored(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, "uid long, at long, n long, part int"), "line")
    totals = sorted((r["part"], r["n"]) for r in local.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row for each range
    bases, so_far = [], 0
    for part, n in totals:
        bases.append((part, so_far))
        so_far += n
    moved = spark.createDataFrame(bases, "part int, base long")
    return local.join(F.broadcast(moved), "part").select("uid", (F.col("at") + F.col("base")).alias("at"))


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = stored(tokenised(docs, path).withColumn("uid", F.monotonically_increasing_id()), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, dtype = np.array([end_id], "<u4"), _text_ids(path).dtype
        for batch in batches:
            out = []
            for doc, at, ids in zip(batch.column("doc_id").to_pylist(), batch.column("at").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.concatenate([np.frombuffer(ids, dtype).astype("<u4"), end])
                start = 0
                while start < len(ids):
                    offset = (at + start) % length
                    some = ids[start : start + length - offset]
                    out.append((doc, start, len(some), zlib.crc32(some.tobytes()), len(ids), (at + start) // length, offset))
                    start += len(some)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = rows.select("uid", "doc_id", "ids").join(line_starts(rows), "uid").select("doc_id", "at", "ids")
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_tokenizer())
