"""Alignment of two tokenizers' tokens by byte offsets.

Each tokenizer cuts a space and the text into tokens; where tokens of both end at one byte, the text falls into groups.  The
ends are intersected by galloping: each end of the shorter list steps through the longer in doubling strides and then halves the last
stride; that gives its rank.  Ranks that hit an end are the common ones and slice the groups; the difference of two ranks that follow
one another is the range of tokens that overlap the driving token.  All lists of a batch gallop in lockstep.

Both files' kinds are looked at: where neither lets a token hold a space after another sign, tokens of both end before such a
space.  Then each distinct stretch between two such places is encoded and aligned once in a batch, and texts are put together
from stretches; else whole texts are one stretch.

Counts of id pairs over all documents: tasks gather blocks of about BLOCK_BYTES of text, each with its distinct pairs and how many
of its documents hold each.  Only these move; a block's pairs come back with corpus-wide counts and meet the block's row.  The
highest count of each A id is a table of at most a row for each id of the vocabulary and is broadcast.

Texts that are null or empty, or that the tokens of either side do not spell, have no tokens: zeros and an empty digest.  A
text may be of any length: it is in one block, maybe alone.  Repeated rows are documents each, a null doc_id stays null.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import documents, stored, text_batches, text_buffer

#: Bytes of text whose documents share a block.
BLOCK_BYTES = 1 << 24
#: Stretches that a worker remembers; the memory is emptied when it is full.
REMEMBERED = 300_000
_PIECE_SPACE = "▁"
#: A pair is one number: the A id times this and the B id.
PAIR = 1 << 32


def gallop(values: np.ndarray, longer: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """For each value the first place in ``longer[low:high]`` (ascending) that is not below it, or high."""
    low, step = lows - 1, np.ones(len(values), np.int64)  # what is at low is below the value
    going = np.arange(len(values))
    while len(going):  # doubling strides
        probe = low[going] + step[going]
        inside = probe < highs[going]
        inside[inside] = longer[probe[inside]] < values[going[inside]]
        going = going[inside]
        low[going] = probe[inside]
        step[going] *= 2
    high = np.minimum(low + step, highs)
    going = np.flatnonzero(high - low > 1)
    while len(going):  # halving the last stride
        middle = (low[going] + high[going]) // 2
        below = longer[middle] < values[going]
        low[going] = np.where(below, middle, low[going])
        high[going] = np.where(below, high[going], middle)
        going = going[high[going] - low[going] > 1]
    return high


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``count`` numbers."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def align(ends_a: np.ndarray, first_a: np.ndarray, ends_b: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common ends (places in A and in B, ascending) and overlapping pairs of tokens (places in A and in B).

    ends: ascending over all texts, whose tokens begin at first (one more than there are texts).
    """
    n_a, n_b = np.diff(first_a), np.diff(first_b)
    common, links = [], []
    for a_drives in (True, False):
        texts = np.flatnonzero((n_a <= n_b) == a_drives)
        short, first_s, long, first_l = (ends_a, first_a, ends_b, first_b) if a_drives else (ends_b, first_b, ends_a, first_a)
        counts = first_s[texts + 1] - first_s[texts]
        driving = ranges(first_s[texts], counts)
        lows, highs = np.repeat(first_l[texts], counts), np.repeat(first_l[texts + 1], counts)
        rank = gallop(short[driving], long, lows, highs)
        hit = rank < highs
        hit[hit] = long[rank[hit]] == short[driving[hit]]
        after = rank + hit  # where the next token's range begins
        begins = np.empty_like(rank)
        begins[1:] = after[:-1]
        heads = (np.cumsum(counts) - counts)[counts > 0]
        begins[heads] = lows[heads]
        widths = rank - begins + 1
        pairs = np.repeat(driving, widths), ranges(begins, widths)
        common.append((driving[hit], rank[hit]) if a_drives else (rank[hit], driving[hit]))
        links.append(pairs if a_drives else pairs[::-1])
    (ca, cb), (la, lb) = (map(np.concatenate, zip(*x)) for x in (common, links))
    order = np.argsort(ca, kind="stable")
    return ca[order], cb[order], la, lb


class Side:
    """A tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, path: str, prefixed: bool) -> None:
        """prefixed: the tokenizer itself puts the space before a text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.prefixed = prefixed
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            spelt = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_PIECE_SPACE, " ").encode() for i, p in enumerate(pieces)]
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            probe = "a  e\u0301  x\ufb01 "
            self.apart = "".join(model.encode(probe, out_type=str)) == _PIECE_SPACE + probe.replace(" ", _PIECE_SPACE)  # signs stay as they are
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            spec = json.loads(model.to_str())
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
            hidden = [b for b in range(256) if b not in shown]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}  # the byte-level alphabet
            spelt = [bytes(byte[c] for c in model.id_to_token(i)) if all(c in byte for c in model.id_to_token(i) or "") else b"" for i in range(model.get_vocab_size())]
            self.encode = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
            split = spec["pre_tokenizer"] or {}
            self.apart = not spec["normalizer"] and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.apart = self.apart and not any(re.search(r"\S ", s.decode("utf-8", "replace")) for s in spelt)
        self.spelt, self.sizes = pa.array(spelt, pa.binary()), np.array([len(s) for s in spelt], np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with a space, in a row, and where each text's begin, and the end."""
        each = self.encode([t[1:] for t in texts] if self.prefixed else texts)
        first = np.append(0, np.cumsum([len(x) for x in each])).astype(np.int64)
        return np.fromiter((i for x in each for i in x), np.int64, first[-1]), first

    def spells(self, ids: np.ndarray, first: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text's ids give its bytes."""
        total = np.append(0, np.cumsum(self.sizes[ids]))[first]
        fits = np.diff(total) == np.diff(offsets)
        made = text_bytes(self.spelt.take(pa.array(ids)))
        some = np.flatnonzero(fits & (np.diff(offsets) > 0))
        sizes = np.diff(offsets)[some]
        same = made[ranges(total[some], sizes)] == data[ranges(offsets[some], sizes)]
        if len(some):
            fits[some] = np.logical_and.reduceat(same, np.cumsum(sizes) - sizes)
        return fits


def text_bytes(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


class Stretches:
    """What is known of stretches of text: whether they are spelt, counts, groups as text, and pairs of linked ids."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = Side(path_a, False), Side(path_b, path_b.endswith(".model"))
        self.apart = self.a.apart and self.b.apart
        self.clear()

    def clear(self) -> None:
        self.words, self.groups = pa.array([], pa.large_binary()), pa.array([], pa.large_binary())
        self.numbers = np.zeros((0, 4), np.int64)  # sound, tokens of A, of B, groups
        self.links, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where stretches begin: at texts, and at each space between a sign that is no white space and another sign."""
        begins = np.zeros(len(data) + 1, bool)
        if self.apart:
            before = [np.concatenate([np.zeros(k, np.uint8), data[: max(len(data) - k, 0)]])[: len(data)] for k in (1, 2, 3)]
            one, two, three = before
            blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & ((two == 0x9A) | (two == 0xA0)) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80)
            begins[:-1] = (data == 32) & (one > 32) & ~blank  # of signs beyond ASCII, all near white space count as such
            begins[offsets[1:] - 1] = False
        begins[offsets[:-1]] = True
        return np.flatnonzero(begins[:-1])

    def learn(self, words: pa.Array) -> None:
        data, offsets = text_bytes(words), np.append(0, np.cumsum(pc.binary_length(words).to_numpy())).astype(np.int64)
        texts = words.cast(pa.large_string()).to_pylist()
        (ids_a, first_a), (ids_b, first_b) = self.a.ids(texts), self.b.ids(texts)
        sound = self.a.spells(ids_a, first_a, data, offsets) & self.b.spells(ids_b, first_b, data, offsets)
        ids_a, first_a, ids_b, first_b = *kept(ids_a, first_a, sound), *kept(ids_b, first_b, sound)
        ca, cb, la, lb = align(np.cumsum(self.a.sizes[ids_a]), first_a, np.cumsum(self.b.sizes[ids_b]), first_b)
        text_a, text_b = ids_a.astype(str).tolist(), ids_b.astype(str).tolist()
        groups, at_a, at_b = [], 0, 0
        for i, j in zip((ca + 1).tolist(), (cb + 1).tolist()):
            groups.append(f"{','.join(text_a[at_a:i])}|{','.join(text_b[at_b:j])}")
            at_a, at_b = i, j
        first_g = np.searchsorted(ca, first_a)
        said = [";".join(groups[x:y]).encode() for x, y in zip(first_g[:-1], first_g[1:])]
        order = np.argsort(la, kind="stable")
        pairs = ids_a[la[order]] * PAIR + ids_b[lb[order]]
        first = np.searchsorted(la[order], first_a)
        self.words, self.groups = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.groups, pa.array(said, pa.large_binary())])
        self.numbers = np.concatenate([self.numbers, np.stack([sound, np.diff(first_a), np.diff(first_b), np.diff(first_g)], 1)])
        self.links, self.first = np.concatenate([self.links, pairs]), np.append(self.first, self.first[-1] + first[1:])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """For each text its tokens of A, of B, groups and links, and its groups as text; then distinct (text, pair) and how often.

        Texts without tokens have zeros and b"".
        """
        data, offsets = text_buffer(texts)
        full = np.diff(offsets) > 0
        data, offsets = np.insert(data, offsets[:-1], 32), offsets + np.arange(len(offsets))
        starts = self.cuts(data, offsets)
        ends = np.append(starts[1:], len(data)).astype(np.int64)
        line = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
        coded = line.dictionary_encode()
        words = coded.dictionary
        place = pc.index_in(words, self.words).fill_null(-1).to_numpy().astype(np.int64)
        if len(self.words) + np.count_nonzero(place < 0) > REMEMBERED:
            self.clear()
            place = np.full(len(words), -1, np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.words) + np.arange(len(new))
            self.learn(words.take(pa.array(new)))
        at = place[coded.indices.to_numpy()]
        text = np.searchsorted(offsets, ends, "left") - 1
        sums = np.stack([np.bincount(text, c, len(full)) for c in self.numbers[at].T], 1).astype(np.int64)
        sound = full & (sums[:, 0] == np.bincount(text, minlength=len(full)))
        first = np.searchsorted(text, np.arange(len(full) + 1))
        said = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), self.groups.take(pa.array(at))), pa.scalar(b";", pa.large_binary())).to_pylist()
        said = [g if ok else b"" for g, ok in zip(said, sound)]
        numbers = np.concatenate([sums[:, 1:], (sums[:, 1] + sums[:, 2] - sums[:, 3])[:, None]], 1) * sound[:, None]
        here = sound[text]
        keys, times = np.unique(text[here] * len(self.words) + at[here], return_counts=True)
        word = keys % max(len(self.words), 1)
        widths = self.first[word + 1] - self.first[word]
        pairs = self.links[ranges(self.first[word], widths)]
        return numbers, said, *counted(np.repeat(keys // max(len(self.words), 1), widths), pairs, np.repeat(times, widths))


def kept(ids: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some texts; the others have none."""
    counts = np.diff(first) * which
    return ids[ranges(first[:-1][which], np.diff(first)[which])], np.append(0, np.cumsum(counts))


def counted(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, pair) in that order, and the sums of times."""
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    if not len(text):
        return text, pair, times
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])))
    return text[first], pair[first], np.add.reduceat(times, first)


@lru_cache(maxsize=2)
def _stretches(path_a: str, path_b: str) -> Stretches:
    return Stretches(path_a, path_b)


def packed(values: np.ndarray) -> bytes:
    """Small numbers below 2^32, by planes of bytes."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_LISTS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "cells": pa.int64()}
_BLOCK = "block long, " + ", ".join(f"{c} array<{'string' if k == pa.string() else 'bigint'}>" for c, k in _LISTS.items()) + ", places binary, times binary, pairs array<bigint>, held array<bigint>"


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each block of documents.

    Lists of a value for each document (cells: how many distinct pairs it has), places (for each of a document's pairs the place
    among the block's, as steps from the one before) and times, and the block's distinct pairs, ascending, and how many of
    its documents hold each.
    """

    def row(number: int, ids: list, numbers: list, said: list, cells: list) -> pa.RecordBatch:
        texts, pairs, times = (np.concatenate(x) for x in zip(*cells))
        kinds, place, held = np.unique(pairs, return_inverse=True, return_counts=True)
        steps = np.diff(place, prepend=0)
        counts = np.bincount(texts, minlength=len(ids))
        heads = (np.cumsum(counts) - counts)[counts > 0]
        steps[heads] = place[heads]
        numbers = np.concatenate(numbers)
        lists = [ids, *numbers.T, said, counts]
        columns = [pa.array([number], pa.int64()), *(pa.array([list(v)], pa.list_(k)) for v, k in zip(lists, _LISTS.values()))]
        columns += [pa.array([packed(steps)], pa.binary()), pa.array([packed(times)], pa.binary()), *(pa.array([v], pa.list_(pa.int64())) for v in (kinds, held))]
        return pa.RecordBatch.from_arrays(columns, ["block", *_LISTS, "places", "times", "pairs", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, number = _stretches(path_a, path_b), TaskContext.get().partitionId() << 33
        ids, numbers, said, cells, size = [], [], [], [], 0
        for batch in text_batches(batches, most=1 << 21):
            counts, groups, *found = coder.of(batch.column("text"))
            found[0] = found[0] + len(ids)
            ids += batch.column("doc_id").to_pylist()
            numbers.append(counts)
            said += [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            cells.append(found)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield row(number, ids, numbers, said, cells)
                number += 1
                ids, numbers, said, cells, size = [], [], [], [], 0
        if ids:
            yield row(number, ids, numbers, said, cells)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    made = stored(blocks(docs, path_a, path_b), "blocks")
    pairs = made.select("block", F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = stored(pairs.groupBy("pair").agg(F.sum("held").alias("count")), "counts")
    a = F.expr(f"pair div {PAIR}")
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))  # a row for each A id at most
    counts = counts.join(F.broadcast(most), a == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    known = pairs.select(F.col("block").alias("of"), "pair").join(counts, "pair").select("of", "pair", "count", "best")
    held = made.select("block", *_LISTS, "places", "times")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left[c][0] for c in left.column_names}
        order = np.argsort(right["pair"].to_numpy())
        count, best = (right[c].to_numpy()[order] for c in ("count", "best"))
        cells = row["cells"].values.to_numpy()
        text = np.repeat(np.arange(len(cells)), cells)
        steps, times = unpacked(row["places"].as_py()), unpacked(row["times"].as_py())
        sums = np.cumsum(steps)
        heads = (np.cumsum(cells) - cells)[cells > 0]
        place = sums - np.repeat(sums[heads] - steps[heads], cells[cells > 0])
        total = lambda v: group_sums(text, v, len(cells))
        lists = {c: row[c].values for c in _LISTS} | {"n_best": pa.array(total(times * best[place])), "count_sum": pa.array(total(times * count[place]))}
        return pa.Table.from_arrays([lists[c] for c in names], names)

    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names)
    return held.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(meet, schema)


def group_sums(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of int64 values by ascending group number."""
    ends = np.append(0, np.cumsum(values))
    first = np.searchsorted(group, np.arange(n + 1))
    return (ends[first[1:]] - ends[first[:-1]]).astype(np.int64)


def alignment_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id and groups, ``a1,a2|b1;a3|b2,b3`` with the ids of A and B in order; empty where a text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, most=1 << 21):
            said = _stretches(path_a, path_b).of(batch.column("text"))[1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.decode() for s in said], pa.string())], ["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, groups string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
