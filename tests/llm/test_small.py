"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables, against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm import fingerprints, jaccard, mixing, packing, personal, preferences, quality, search, sharding, substrings
from strandwise.llm.components import components

WORDS = ["the", "Of", "tion", "anon", "é", "x" * 30, "12", "a,b", "end."]


def make_text(seed, n):
    rng = np.random.RandomState(seed)
    return " ".join(WORDS[i] + str(rng.randint(40)) for i in rng.randint(len(WORDS), size=n))


@pytest.fixture(scope="module")
def rows():
    long = make_text(1, 4000)
    base = make_text(2, 130)
    near = base.split()
    near[60] = "other"
    texts = [
        None, "", "   \t\n", "one", "One", "one two three four", base, base, base.upper(), " ".join(near), base + " tail", long, "start " + long[:9000], "w " * 300, "w " * 200 + base,
        make_text(3, 60), make_text(3, 60), " ".join(make_text(4, 200).split()[:120]), make_text(4, 200), "mail a.b@c.de or +1 (234) 555-1234", "ip 1.2.3.4 and 4111 1111 1111 1111", "Å ﬁ x y", "Å fi x y",
    ]
    out = [(i * 3 % 40, t, "en", None if i % 7 == 3 else f"s{i % 3}") for i, t in enumerate(texts)]
    return [*out, out[6], out[6]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(1) for c in ("score", "slot", "key", "n", "size", "hash", "range", "label")}
    return made.withColumns(clash).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words_of(text):
    return (text or "").encode().split()


def brute_removal(rows):
    """doc_id, n_words, n_removed, kept text of rows of doc_id and text."""
    first = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return sorted(out)


def removal(table):
    return sorted(tuple(r) for r in substrings.remove_repeats(table).select("doc_id", "n_words", "n_removed", "kept_text").collect())


def test_substrings(docs, rows, empty):
    got = removal(docs)
    assert got == brute_removal([r[:2] for r in rows]) and any(x[2] for x in got)
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_of_crowds_and_runs(spark):
    """Near copies with a few changed words, words and phrases said again and again, and a passage in many places."""
    rng = np.random.RandomState(8)
    base, passage = make_text(60, 220).split(), make_text(61, 70).split()
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.randint(220, size=rng.randint(0, 4)):
            w[p] = WORDS[rng.randint(len(WORDS))] + str(rng.randint(4))
        rows.append((int(rng.randint(1000)), w))
    rows += [(1000 + i, make_text(500 + i, rng.randint(5, 80)).split() + passage[rng.randint(9) : 70 - rng.randint(9)] + make_text(600 + i, rng.randint(5, 80)).split()) for i in range(40)]
    rows += [(2000 + i, ["a"] * rng.randint(20, 130) + ["b"] * rng.randint(3, 130) + ["c"] * rng.randint(60, 90)) for i in range(12)]
    rows += [(3000 + i, (["a", "b", "a", "c", "d"] * 60)[rng.randint(5) : 200 + rng.randint(90)]) for i in range(6)]
    rows = [(d, " ".join(w)) for d, w in rows]
    got = removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert got == brute_removal(rows) and sum(x[2] > 0 for x in got) > 90


def test_substrings_of_rows_that_share_an_id(spark):
    base, other = make_text(2, 130), make_text(51, 120)
    rows = [(1, base), (None, base + " tail"), (None, other), (None, "short"), (7, "x y z"), (7, base), (7, other), (8, other), (7, None), (2**63 - 1, "x y z")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in substrings.remove_repeats(table).select("doc_id", "n_words", "n_removed", "kept_text").collect()}
    assert got == {(1, 130, 0, base), (None, 131, 130, "tail"), (None, 120, 120, ""), (None, 1, 0, "short"), (7, 3, 0, "x y z"), (7, 130, 130, ""), (7, 120, 0, other), (8, 120, 120, ""), (7, 0, 0, ""), (2**63 - 1, 3, 0, "x y z")}


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    ids = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, *_ in rows]
    got = packing.pack_documents(docs, path, 256).toPandas().sort_values(["sequence_id", "offset"])
    assert got.length.sum() == sum(map(len, ids))
    ends = (got.offset + got.length).tolist()
    for a, b, same in zip(ends, got.offset.tolist()[1:], (got.sequence_id.diff().iloc[1:] == 0).tolist()):
        assert b == (a if same else 0)
    assert (got.groupby("sequence_id").length.sum().iloc[:-1] == 256).all()
    by = collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    known = {(d, s) for d, s in zip([r[0] for r in rows], map(bytes, (i.tobytes() for i in ids)))}
    for (d, start, length, crc), _ in by.items():
        assert any(k[0] == d and zlib.crc32(k[1][4 * start : 4 * (start + length)]) == crc for k in known)
    assert packing.pack_documents(empty, path).count() == 0


def test_token_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    texts = ["don't we're É’s naïve ½ ﬁ İstanbul ΣΑΣ — «a», x,y 3.14 <|endoftext|> a\x1cb café…, ÀÉ! Áb", "", "ß ÿ z  q", None, "hello <|startoftext|> w<|endoftext|>orld, <|STARTOFTEXT|>", " \t", "ªº µ aaaa aaa! bbbbbbbbb ababababab " + "é" * 39 + " " + "ab" * 30, make_text(9, 900)]
    texts += ["".join(np.random.RandomState(i).choice(list("etaoinsrhldcumfpgwybvkxjqzÀéüñßÿ'.,!"), size=12)) for i in range(400)]
    assert [x.tolist() for x in packing.token_ids(texts, path)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_ids_of_other_files(tmp_path):
    """Files of another kind are encoded text by text, with ids as wide as they need."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({f"w{i}": i for i in range(70000)} | {"?": 70000}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Metaspace()
    made.save(str(tmp_path / "t.json"))
    texts = ["w1 w69999", "", None, "w2"]
    assert [x.tolist() for x in packing.token_ids(texts, str(tmp_path / "t.json"))] == [made.encode(t or "", add_special_tokens=False).ids for t in texts]
    from strandwise.llm.packing import TextIds

    assert TextIds(str(tmp_path / "t.json")).dtype.itemsize == 4


def test_hilbert_neighbours_touch():
    side = 8
    points = np.array([(x, y) for x in range(side) for y in range(side)])
    order = points[np.argsort(packing.hilbert_key(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_mixing(docs, rows, empty):
    got = mixing.mix_sources(docs).toPandas()
    sizes = collections.Counter()
    for d, t, _, s in rows:
        sizes[s] += len(words_of(t))
    assert got["size"].sum() == sum(sizes.values())
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby("pattern").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert ((by.target - by.taken).abs() <= 0.5).all() and (by.target <= 3 * by["size"]).all()
    again = mixing.mix_sources(docs.repartition(5)).toPandas()
    assert sorted(map(tuple, got.fillna(-1).values.tolist())) == sorted(map(tuple, again.fillna(-1).values.tolist()))
    assert mixing.mix_sources(empty).count() == 0
    text = mixing.taken_documents(docs).toPandas()
    assert abs(sum(len(words_of(t)) for t in text.text) - got.taken.sum()) <= max(got["size"])


def test_flow_spreads_overlapping_patterns():
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 12, "b": 14})
    into = collections.Counter()
    out = collections.Counter()
    for (p, s), v in flow.items():
        into[s] += v
        out[p] += v
    assert into == {"a": 12, "b": 14}
    assert sum(max(0, out[p] - c) for p, c in {("a",): 10, ("a", "b"): 10, ("b",): 5}.items()) == 1  # 26 wanted of 25 once


def test_mixing_of_overlapping_sources(spark):
    """Quotas of sources that share documents are met by the flow's optimum, and a row takes no more than it may."""
    rng = np.random.RandomState(12)
    kinds = [["a"], ["b"], ["a", "b"], ["b", "c", "c"], ["c", None], ["e"], [], None]
    rows = [(int(i), "w " * int(rng.randint(1, 40)), kinds[i % 8]) for i in range(240)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source array<string>").withColumns({"size": F.lit(1), "pattern": F.lit(1), "members": F.lit(1)})
    got = mixing.mix_memberships(table).toPandas()
    pattern = lambda k: tuple(sorted({"n" if x is None else "s" + x for x in k or [None]}))
    capacity, sizes = collections.Counter(), collections.Counter()
    for _, t, k in rows:
        capacity[pattern(k)] += len(t.split())
        for s in pattern(k):
            sizes[s] += len(t.split())
    names = sorted(sizes, key=lambda s: (s == "n", s))
    total, wish = sum(capacity.values()), {}
    left, open_ = total, set(names)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    while True:
        full = {s for s in open_ if weight[s] * left > 3 * sizes[s] * sum(weight[x] for x in open_)}
        if not full:
            wish |= {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
            break
        wish |= {s: 3.0 * sizes[s] for s in full}
        left, open_ = left - sum(3 * sizes[s] for s in full), open_ - full
    flow = mixing.route(dict(capacity), {s: int(wish[s] + 0.5) for s in names})
    into = collections.Counter()
    for (_, s), v in flow.items():
        into[s] += v
    shown = got.fillna({"source": "~"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert {("n" if s == "~" else "s" + s): (int(r.taken), round(r.target, 6)) for s, r in shown.iterrows()} == {s: (into[s], round(wish[s], 6)) for s in names}
    by_row = got.groupby("doc_id").agg(taken=("taken", "sum"), size=("size", "first"))
    assert (by_row.taken <= 3 * by_row["size"]).all() and len(by_row) == 240
    assert sorted(map(str, mixing.mix_memberships(table.repartition(7)).collect())) == sorted(map(str, mixing.mix_memberships(table).collect()))


def test_mixing_of_equal_rows_and_many_sources(spark):
    """Equal rows without an id take their turns, so the source meets its target; there may be any number of sources."""
    table = spark.createDataFrame([(None, "a b c d e f g h i j", "x")] * 20 + [(1, "w " * 200, "y")], "doc_id long, text string, source string")
    text = mixing.taken_documents(table.withColumn("_row", F.lit(2)).withColumn("_size", F.lit(3))).toPandas()
    got = mixing.mix_sources(table).toPandas()
    assert got.taken.sum() == 400 and got[got.pattern == "sx"].taken.sum() == 133 and text[text.source == "x"].text.tolist() == ["a b c d e f g h i j"] * 13
    assert text.columns.tolist() == ["doc_id", "text", "source", "_row", "_size"] and (text._row == 2).all()
    many = spark.range(10_500).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.col("id").cast("string").alias("source"))
    got = mixing.mix_sources(many).agg(F.sum("taken"), F.count("*"), F.max(F.abs(F.col("taken") - F.col("target")))).first()
    assert got[1] == 10_500 and got[2] <= 0.5


def test_targets_reshare():
    got = mixing.targets({"a": 10, "b": 1000, "c": 10}, {"a": 1, "b": 2, "c": 3})
    assert got["c"] == 30 and got["a"] == 30 and got["b"] == 960


def test_preferences(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 3, "assistant", "b"), (2, 0, "user", "x"), (2, 1, "assistant", "c"), (3, 0, None, "only"), (4, 0, "assistant", "c")]
    made = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1))
    got = {r["conv_id"]: r for r in preferences.format_preferences(preferences.preference_pairs(made), "conv_id").collect()}
    assert got[1]["prompt_turns"] == 3 and got[1]["chosen"] == "<|assistant|>\nb\n<|end|>\n" and got[1]["rejected"] == "<|assistant|>\nc\n<|end|>\n"
    a, b = map(int, got[1]["chosen_mask"].split(":"))
    assert got[1]["chosen"][a:b] == "b\n<|end|>\n"
    assert got[2]["rejected"] == "" and got[2]["rejected_mask"] == "" and got[2]["prompt"] == "<|user|>\nx\n<|end|>\n"
    assert got[3]["chosen"] == "" and got[3]["prompt"] == "<|unknown|>\nonly\n<|end|>\n"
    assert preferences.format_preferences(preferences.preference_pairs(made.limit(0)), "conv_id").count() == 0


def test_preferences_of_long_conversations_and_ties(spark):
    """A turn table with repeated rows, turns of one number, null ids and a conversation of 5000 turns; masks against running sums."""
    rng = np.random.RandomState(7)
    long = [(9, i, ["user", "assistant"][i % 2], "x" * int(rng.randint(9))) for i in range(5000)]
    turns = [*long, (8, 0, "user", "q"), (8, 0, "user", "q"), (8, 0, "assistant", "b"), (8, 0, "assistant", "a"), (None, 0, "assistant", "n"), (None, 1, "user", None), (10, 0, "user", "no"), (10, 1, "assistant", "")]
    made = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("chosen", F.lit(1))
    got = {r["conv_id"]: r for r in preferences.format_preferences(preferences.preference_pairs(made), "conv_id").collect()}
    assert set(got) == {8, 9, 10, None} and got[8]["prompt_turns"] == 1 and got[8]["chosen"].startswith("<|assistant|>\nb")  # turns of one number by role, then text
    whole = preferences.format_preferences(spark.createDataFrame([(1, [(r, t) for _, _, r, t in long], [("user", "other")])], "id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"), "id").first()
    spans = [tuple(map(int, s.split(":"))) for s in whole["chosen_mask"].split(",")]
    assert [whole["chosen"][a:b] for a, b in spans] == [t + "\n<|end|>\n" for _, _, r, t in long if r == "assistant"] and whole["rejected_mask"] == ""


def test_sharding(docs, rows, empty):
    got = sharding.shard_documents(docs, 8).toPandas()
    assert len(got) == len(rows)
    assert sorted(got.text_crc32) == sorted(zlib.crc32((t or "").encode()) for _, t, *_ in rows)
    for s, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    moved = got[got["shard"] != got.grown_shard]
    assert set(moved.grown_shard) <= {8}
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("founded", [0, 1, 8])
def test_growth_moves_keys_to_the_new_shard_alone(spark, founded):
    numbers = range(max(founded, 1), 22)
    ids = spark.range(1500).select(F.col("id").cast("string").alias("k"))
    got = ids.select(*[sharding.tree_shard(F.col("k"), n, None, founded).alias(str(n)) for n in numbers]).toPandas()
    for n in numbers[:-1]:
        moved = got[got[str(n)] != got[str(n + 1)]][str(n + 1)]
        assert set(moved) == {n} and abs(len(moved) - 1500 / (n + 1)) < 5 * (1500 / (n + 1)) ** 0.5


def test_shard_weights(spark):
    ids = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    even = ids.select("k", sharding.tree_shard(F.col("k"), 8).alias("a"), sharding.tree_shard(F.col("k"), 8, {0: 3.0}).alias("b")).toPandas()
    assert even.a.value_counts(normalize=True).between(0.115, 0.135).all()
    assert abs((even.b == 0).mean() - 0.3) < 0.02
    changed = even[even.a != even.b]
    assert (changed.b.isin([0, 1, 2, 3])).all()  # into the region whose weight grew


def test_quality(spark, docs, empty):
    good = [(1000 + i, make_text(100 + i, 60), 1) for i in range(60)]
    bad = [(2000 + i, make_text(200 + i, 60).upper().replace(" ", "!! "), 0) for i in range(60)]
    table = spark.createDataFrame([(d, t) for d, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in good + bad] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(table, labels)
    got = quality.score_quality(table, model).withColumn("h", quality.held_out(F.col("doc_id"))).toPandas().merge(labels.toPandas(), on="doc_id")
    assert ((got.score >= 0.3) == (got.quality == 1)).all() and got.h.any()
    assert [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id] == got.h.tolist()
    odd = quality.score_quality(docs, model).toPandas()
    assert len(odd) == docs.count() and odd.score.between(0, 1).all()
    assert quality.score_quality(empty, model).count() == 0
    assert quality.fit(table, labels.limit(0)) is None and quality.score_quality(table, None).toPandas().score.eq(0.5).all()


def test_quality_on_the_given_labels(spark):
    """Scores against plain nearest neighbours over the model's vectors, and held-out labels of the smallest tables."""
    import pyarrow as pa

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    got = quality.score_quality(docs, model).withColumn("h", quality.held_out(F.col("doc_id"))).toPandas()
    for text, score in zip(got.text[:60], got.score[:60]):
        counts = quality.term_counts(pa.array([text]))
        if not counts.sum():
            assert score == 0
            continue
        x = np.sqrt(counts[0] / counts[0].sum()) * model.idf
        x = (x / np.linalg.norm(x) - model.mean) @ model.basis
        x = x / np.linalg.norm(x)
        near = sorted(((float(x @ v), float(label)) for v, label in zip(model.vectors, model.labels)), reverse=True)[: quality.NEIGHBOURS]
        weights = [max(c, 1e-6) ** 4 for c, _ in near]
        assert abs(sum(w * label for w, (_, label) in zip(weights, near)) / sum(weights) - score) < 1e-3
    both = got[got.h].merge(labels.toPandas(), on="doc_id")
    good, bad = both[both.quality == 1].score, both[both.quality == 0].score
    assert len(good) and len(bad) and np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.9


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        c = int(c) * (1 + i % 2)
        total += c - 9 * (c > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 8 <= len(digits) <= 15
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [
    "a@b.c_d@e.f x@y 1.2.3.4.5.6.7.8 1..2 300.1.1.1 001.02.3.4", "é@x.y a.b@c-d.e.f, ++1 (234) 555-1234- +12345678 +1234567 4111 1111 1111 1111 4111-1111-1111-1111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 1  2",
    "a" * 20000 + "@" + "b." * 9000 + "c", "1 " * 20000, "\U0001f600 x@y.zz \U0001f600 1.1.1.1", "a@b.c" * 300, "4111111111111111, 4111111111111111",
]


def test_personal(spark, docs, rows, empty):
    table = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = sorted((r["doc_id"], r["base_sha256"], r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]) for r in personal.find_personal(table).collect())
    want = sorted((d, hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest(), len(base_spans(t or ""))) for d, t in [(1000 + i, t) for i, t in enumerate(TRICKY)] + [r[:2] for r in rows])
    assert got == want
    assert personal.find_personal(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in personal.redact(table.where("doc_id >= 1000")).collect()}
    assert clean[1005] == "\U0001f600 [email] \U0001f600 [ip]" and clean[1007] == "[card], [card]"


def test_personal_bootstraps(spark):
    texts = [f"please write to user{i}@mail.example.com today" for i in range(12)] + [f"please write to AKIA{i}X7Q9Z2 today" for i in range(3)] + ["version of ABCD1234EFGH here", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal.find_personal(table).collect()}
    assert all(got[12 + i].startswith("id:16:") for i in range(3)) and got[15] == "" and got[16] == ""


def test_personal_ids_end_at_punctuation(spark):
    tails, heads = ["", ".", ",", ";", ":", "?", "...", "-", "/."], ["write to ", "write to:", "write to=", "write to,"]
    forms = ["AB1234567", "123-45-6789", "A/1.b@2-C%+_9"]
    cases = [(h, v, t) for h in heads for v in forms for t in tails]
    texts = [f"{h}user{i}@mail.example.com today" for h in heads for i in range(200)] + [f"{h}{v}{t} now" for h, v, t in cases]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal.find_personal(table).where("doc_id >= 800").collect()}
    assert got == {800 + i: f"id:{len(h)}:{len(h) + len(v)}" for i, (h, v, t) in enumerate(cases)}
    long = spark.createDataFrame([(0, "a" * 50000 + "1" + "." * 50000), (1, "1" + "-" * 100000), (2, ("ab1" + "." * 9) * 9000)], "doc_id long, text string")
    found = {r["doc_id"]: r["m"] for r in long.select("doc_id", personal.matches(F.col("text"), "id").alias("m")).collect()}
    assert found[0][0]["many"] == 50001 and found[1] is None and found[2][0]["many"] == 9000 * 12 - 9


def test_personal_patterns_spread_beyond_seeds(spark):
    ids = [f"QX{i}44Z{i}81" for i in range(9)]
    texts = [f"{h} user{i}{h[:2]}@mail.example.com today" for h in ("write to", "reach via") for i in range(200)]
    texts += [f"{h} {x} today" for h in ("write to", "reach via", "passport") for x in ids[:8]] + [f"passport {ids[8]} today", f"version {ids[8]}1 today"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in personal.find_personal(table).where("doc_id >= 400").collect()}
    assert all(got[400 + i].startswith("id:") for i in range(25)) and got[425] == ""


def test_search(spark):
    rng = np.random.RandomState(0)
    v = rng.standard_normal((700, 12)).astype(np.float32)
    v[50:120] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)] + [(900, None), (1000, [float("nan")] * 12), (1100, [1.0, None]), (0, [float(x) for x in v[0]]), (300, [1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(0), "block": F.lit(0), "cell": F.lit(0)})
    got = sorted(map(tuple, search.top_products(table).select("query_id", "rank", "vec_id", "score").collect()))
    live = [(i, np.floor(1024 * np.array(x, np.float32).astype(np.float64)).astype(np.int64)) for i, x in rows if x is not None and all(y is not None and np.isfinite(y) for y in x)]
    want = []
    for k, (q, a) in enumerate(live):
        if q % 100 == 0:
            s = sorted((-int(a @ b), i) for j, (i, b) in enumerate(live) if j != k and len(a) == len(b))[:10]
            want += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    assert got == sorted(want)
    assert search.top_products(table.limit(0)).count() == 0


def test_search_of_groups_and_large_components(spark, monkeypatch):
    for name, value in (("BLOCK", 40), ("CHUNK", 3), ("PER_PIVOT", 36)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.RandomState(1)
    v = rng.standard_normal((900, 6)) + 8 * rng.standard_normal((12, 6))[np.arange(900) % 12]  # 25 pivots
    table = spark.createDataFrame([(i * 10, [float(x) for x in v[i]]) for i in range(900)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, search.top_products(table).select("query_id", "rank", "vec_id", "score").collect()))
    whole = np.floor(1024 * v).astype(np.int64)
    want = []
    for q in range(0, 900, 10):
        s = sorted((-int(whole[q] @ whole[j]), j * 10) for j in range(900) if j != q)[:10]
        want += [(q * 10, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    assert got == sorted(want)
    big = lambda x: spark.createDataFrame([(0, [x]), (1, [x]), (100, [1.0])], "vec_id long, embedding array<double>")
    assert search.top_products(big(2.0**21)).where("query_id = 0 and rank = 1").first()["score"] == 2**62
    with pytest.raises(Exception, match="beyond 64 bits"):
        search.top_products(big(2.0**32)).collect()


def shingles(text):
    w = tuple(words_of(text.lower() if text else text))
    w = tuple((text or "").encode().lower().split())
    return frozenset(w[i : i + 5] for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {}
    for d, t, *_ in rows:
        sets.setdefault(d, []).append(shingles(t))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(d, s) for d, ss in sets.items() for s in ss]
    for i, (a, x) in enumerate(flat):
        for b, y in flat[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in sets}


def test_jaccard(docs, rows, empty):
    want = brute_components(rows)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect())
    assert got == sorted((d, len(shingles(t)), want[d]) for d, t, *_ in rows)
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_crowd(spark):
    """A crowd of edited copies, more than a short list holds, beside texts that share one passage."""
    rng = np.random.RandomState(5)
    base = make_text(50, 120).split()
    passage = make_text(51, 40)
    rows = []
    for i in range(60):
        w = list(base)
        for p in rng.randint(120, size=rng.randint(0, 9)):
            w[p] = f"e{rng.randint(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, make_text(300 + i, 60) + " " + passage + " " + make_text(400 + i, 60)) for i in range(40)]
    want = brute_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 41


def test_jaccard_crosses_its_blocks(spark, monkeypatch):
    """Hot keys, groups of many blocks and groups of many parts, against brute force with small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 12)
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 5)
    rng = np.random.RandomState(8)
    rows = []
    for crowd, edits in enumerate((4, 9, 30)):
        base = make_text(60 + crowd, 100).split()
        for _ in range(45):
            w = list(base)
            for p in rng.randint(100, size=rng.randint(0, edits)):
                w[p] = f"e{rng.randint(1000)}"
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    passage = make_text(70, 40)
    rows += [(2000 + i, make_text(500 + i, 9) + " " + passage + " " + make_text(700 + i, 9)) for i in range(30)]
    want = brute_components(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 30 < len(set(want.values())) < 140


def test_jaccard_crowd_beyond_a_block(spark):
    """More near copies than BLOCK: each adds a word of its own to one of two texts, so each text's crowd is one component."""
    rows = [(i, make_text(80 + i % 2, 60) + f" own{i}") for i in range(2 * jaccard.BLOCK + 600)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 2 for i, _ in rows}


def test_prefix_keys_meet():
    """Linked sets share a key under any choice of frequent tokens; long prefixes meet every other."""
    rng = np.random.RandomState(3)
    for _ in range(200):
        universe = rng.randint(0, 2**63, size=60).astype(np.uint64) * np.uint64(2)
        frequent = np.sort(universe[rng.rand(60) < rng.rand()])
        a = np.unique(universe[: rng.randint(1, 60)])
        keep = rng.rand(len(a)) < 0.93
        b = np.unique(np.concatenate([a[keep], rng.randint(0, 2**62, size=rng.randint(0, 3)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        ka, alone_a, long_a = jaccard.index_keys(a, frequent)
        kb, alone_b, long_b = jaccard.index_keys(b, frequent)
        shared = [(x, p or q) for x, p in zip(ka, alone_a) for y, q in zip(kb, alone_b) if x == y]
        assert any(not alone or long_a or long_b for _, alone in shared)


def test_parity_bounds_the_difference():
    rng = np.random.RandomState(4)
    for _ in range(100):
        a = np.unique(rng.randint(0, 2**63, size=rng.randint(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.rand(len(a)) < 0.9], rng.randint(0, 2**63, size=rng.randint(0, 30)).astype(np.uint64)]))
        x, y = sorted((jaccard.parity(a), jaccard.parity(b)), key=len)
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = np.random.RandomState(6)
    edges = [(int(a), int(b)) for a, b in rng.randint(0, 300, size=(220, 2))] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_fingerprints(docs, rows, empty):
    got = fingerprints.fingerprint_edits(docs).toPandas()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    texts = [r[1] or "" for r in ordered]
    want = []
    for i, (d, *_) in enumerate(ordered):
        t, nxt = texts[i], texts[(i + 1) % len(texts)]
        third = len(t) // 3
        e = t[: len(t) - third] + nxt[:third]
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.digest(t), fingerprints.digest(e)))
    assert sorted(map(tuple, got[["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]].values.tolist())) == sorted(want)
    assert fingerprints.digest("Å ﬁ x y") == fingerprints.digest("å  FI X y ")
    forms = collections.defaultdict(set)
    for d, t, *_ in rows:
        forms[fingerprints.canonical(t)].add(d)
    low = {d: min(s) for s in forms.values() for d in s}
    assert {r.doc_id: r.copy_of for r in got.itertuples()} == low
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_ranges_of_cuts(spark):
    for cuts in ([], [5], [1, 3, 3, 8], list(range(0, 3000, 7))):
        got = spark.range(-3, 60).select("id", fingerprints._bisect(F.col("id"), cuts).alias("r")).collect()
        assert all(r["r"] == sum(c < r["id"] for c in cuts) for r in got)


def test_fit_repeats_itself(spark):
    """One doc_id with several texts and one with both labels: models are equal however rows are dealt."""
    rows = [(i, make_text(i, 30)) for i in range(60)] + [(5, "other text"), (5, "a third"), (7, "x")]
    labels = [(i, i % 2) for i in range(60)] + [(9, 0), (9, 1), (5, 1)]
    models = []
    for n in (1, 4, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").orderBy(F.rand(n)).repartition(n)
        models.append(quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int").repartition(n)))
    assert all((m.vectors == models[0].vectors).all() and (m.labels == models[0].labels).all() for m in models)
    taught = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5} - {9}
    assert len(models[0].labels) == len(taught)


def test_growth_by_the_default_call_and_many_shards(spark, docs):
    for n in (1, 3, 7, 8):
        small, grown = (sharding.shard_documents(docs, k).select("doc_id", "text_crc32", "shard", "grown_shard").toPandas() for k in (n, n + 1))
        key = ["doc_id", "text_crc32"]
        assert sorted(map(str, small[[*key, "grown_shard"]].values.tolist())) == sorted(map(str, grown[[*key, "shard"]].values.tolist()))
    many = spark.range(20_000).select(sharding.tree_shard(F.col("id").cast("string"), 1500).alias("s")).groupBy("s").count().toPandas()
    assert len(many) > 1490 and many.s.max() == 1499 and many["count"].max() < 45
    with pytest.raises(ValueError):
        sharding.tree(3, 8)


def test_redaction_keeps_columns_of_any_name(spark):
    names = ["_spans", "_last", "_id", "_of", "_hash", "hash", "spans", "last", "row", "id", "of", "reach", "start", "kind", "a.b"]
    made = spark.createDataFrame([(1, "mail a.b@c.de now"), (None, "none"), (2, None)], "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    got = {r["doc_id"]: r for r in personal.redact(made).collect()}
    assert {d: r["text"] for d, r in got.items()} == {1: "mail [email] now", None: "none", 2: None}
    assert all(r[c] == c for r in got.values() for c in names) and personal.redact(made).columns == made.columns


def test_dual_trees_prune_clustered_vectors():
    rng = np.random.RandomState(4)
    centres = rng.randint(-2000, 2000, (40, 16))
    data = (centres[rng.randint(40, size=3000)] + rng.randint(-20, 20, (3000, 16))).astype(np.int64)
    queries = (centres[rng.randint(40, size=60)] + rng.randint(-20, 20, (60, 16))).astype(np.int64)
    best = search.dual_search(queries, -1 - np.arange(60), np.full(60, -np.inf), data, np.arange(3000), np.arange(3000))
    scores = queries @ data.T
    for q in range(60):
        order = np.lexsort((np.arange(3000), -scores[q]))[: search.TOP]
        assert best.rows[q][1].tolist() == order.tolist()
    assert best.products < 0.2 * scores.size and best.pruned > 0.2 * best.pairs
