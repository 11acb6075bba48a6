"""Alignment of two tokenizers against plain Python."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwise.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_map():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Plain:
    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.byte = byte_map()

    def spans(self, ids, spelt):
        at, out = 0, []
        for i, s in zip(ids, spelt):
            out.append((i, at, at + len(s)))
            at += len(s)
        return out

    def tokens(self, text):
        """Ids with byte ranges of A and B, or none."""
        if not text:
            return None
        data = (" " + text).encode()
        ids_a = self.a.encode(" " + text, add_special_tokens=False).ids
        spelt_a = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in ids_a]
        ids_b = self.b.encode(text)
        spelt_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(spelt_a) != data or b"".join(spelt_b) != data:
            return None
        return self.spans(ids_a, spelt_a), self.spans(ids_b, spelt_b)

    def groups(self, text):
        """Group text and linked id pairs."""
        found = self.tokens(text)
        if found is None:
            return None
        a, b = found
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        said, at = [], [0, 0]
        for e in common:
            sides = []
            for k, tokens in enumerate((a, b)):
                first = at[k]
                while at[k] < len(tokens) and tokens[at[k]][2] <= e:
                    at[k] += 1
                sides.append(",".join(str(i) for i, _, _ in tokens[first : at[k]]))
            said.append("|".join(sides))
        links, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        return len(a), len(b), len(common), links, ";".join(said)


@pytest.fixture(scope="module")
def plain():
    return Plain()


def brute(plain, rows):
    found = [plain.groups(t) for _, t in rows]
    count = collections.Counter(p for f in found if f for p in set(f[3]))
    most = collections.Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (d, _), f in zip(rows, found):
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((d, f[0], f[1], f[2], len(f[3]), sum(count[p] == most[p[0]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(f[4].encode()).hexdigest()))
    return out


WORDS = ["the", "tokenization", "über", "naïveté", "ﬁ", "12", "3.14", "don't", "\t", "\n\n", "", "  ", "x" * 50, "日本語", "🙂", "a,b;c", "<|endoftext|>", "<s>", "<0x41>", " ", "　x", "é", "--", "'s", "…"]


def texts():
    rng = random.Random(5)
    out = [None, "", " ", "  ", "a", "a ", " a", "▁x", "a ▁", "<s>", "<unk> </s>", "\x00", "a\x85 b", "a  b", "a  b", "a   b", "x᠎ y", "y" * 100_000, "é" * 3_000, " " * 3_000]
    out += [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    return out + [out[-1]] * 3 + [out[-2]]


def test_against_plain(spark, plain, monkeypatch):
    rows = [(i if i % 10 else None, t) for i, t in enumerate(texts())]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    made = made.withColumns({c: F.lit(1) for c in ("block", "pair", "pairs", "count", "best", "held", "cells", "n_a")}).repartition(3)
    got = [tuple(r) for r in alignment.align_documents(made, A, B).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute(plain, rows), key=key)
    assert alignment.align_documents(made.limit(0), A, B).count() == 0
    said = sorted((str(r["doc_id"]), r["groups"]) for r in alignment.alignment_groups(made, A, B).collect())
    assert said == sorted((str(d), (plain.groups(t) or [""])[-1]) for d, t in rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" a.é1'  　 ᠎​\t\n\x1f\x85▁🙂T<"), max_size=12), max_size=5))
def test_stretches_are_as_whole_texts(texts):
    """Cut at spaces, texts give what whole texts give."""
    plain, coder = Plain.shared, Plain.coder
    numbers, said, *_ = coder.of(pa.array([*texts, "end"], pa.string()))
    for t, n, g in zip(texts, numbers.tolist(), said):
        want = plain.groups(t)
        assert (n[:3], g.decode()) == ((list(want[:3]), want[4]) if want else ([0, 0, 0], "")), t


Plain.shared, Plain.coder = Plain(), alignment.Stretches(A, B)


def test_files_that_cannot_be_cut(plain):
    coder = alignment.Stretches(A, B)
    assert coder.apart
    coder.apart = False
    some = ["one two  three", "", "don't stop", "é é"]
    whole, cut = coder.of(pa.array(some)), Plain.coder.of(pa.array(some))
    assert whole[1] == cut[1] and all((x == y).all() for x, y in zip(whole[2:], cut[2:]))


def test_forgetting(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    coder = alignment.Stretches(A, B)
    for _ in range(3):
        some = pa.array(["a b c d", "e f g", "a e"])
        assert coder.of(some)[1] == Plain.coder.of(some)[1]


def test_gallop():
    for seed in range(200):
        rng = np.random.RandomState(seed)
        longer = np.sort(rng.choice(300, rng.randint(1, 60), replace=False))
        values = np.sort(rng.choice(320, rng.randint(1, 20), replace=False))
        low, high = sorted(rng.randint(0, len(longer) + 1, 2))
        got = alignment.gallop(values, longer, np.full(len(values), low), np.full(len(values), high))
        assert (got == low + np.searchsorted(longer[low:high], values)).all()


def test_counts_over_blocks(spark, plain, monkeypatch):
    """Many blocks in a task; pairs' counts are still of all documents."""
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1)
    rows = [(i, f"tokenization of {i % 3} naïveté words") for i in range(30)]
    table = alignment.blocks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), A, B)
    assert table.count() >= 1
    got = [tuple(r) for r in alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), A, B).collect()]
    assert sorted(got) == sorted(brute(plain, rows))
