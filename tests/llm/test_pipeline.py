"""The pipeline on a small corpus: each stage's decisions against plain code over what it was given."""

import re

import numpy as np

import corpus_pipeline
from strandwise.llm import mixing, packing, quality
from tests.llm.test_small import base_spans, brute_components, make_text


def corpus(spark, folder):
    rows, labels = [], []
    for i in range(160):
        text = make_text(i // 2 if i % 4 == 0 else i, 80)
        if i % 5 == 0:
            text += f" mail u{i}@mail.example.com"
        if i % 8 == 3:
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", f"s{i % 3}" if i % 11 else None, len(text)))
        if i % 3:
            labels.append((i, int(i % 8 != 3), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs.toPandas(), spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.toPandas()
        kept[name] = len(after)
        if name != "packing":
            assert list(after.columns) == corpus_pipeline.COLUMNS
        if name == "quality":
            bad = {i for i in range(160) if i % 8 == 3}
            assert set(after.doc_id) == set(before.doc_id) - bad
        elif name == "near_duplicates":
            roots = brute_components([(r.doc_id, r.text) for r in before.itertuples()])
            assert set(after.doc_id) == {d for d, c in roots.items() if d == c} and len(after) < len(before)
        elif name == "personal_data":
            assert set(after.doc_id) == set(before.doc_id)
            assert not any(base_spans(t) for t in after.text) and after.text.str.contains(re.escape("[email]")).any()
            clean = {r.doc_id: r.text for r in before.itertuples() if not base_spans(r.text)}
            assert all(clean.get(r.doc_id, r.text) == r.text and len(r.text) == r.n_chars for r in after.itertuples())
        elif name == "mixing":
            sizes = {s: 0 for s in before.source}
            for r in before.itertuples():
                sizes[r.source] += len(r.text.split())
            names = sorted(sizes, key=lambda s: (s is None, s or ""))
            wish = mixing.targets(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
            for s in names:
                part = after[after.source.isna()] if s is None else after[after.source == s]
                assert abs(sum(len(t.split()) for t in part.text) - wish[s]) <= 0.5 + max(len(t.split()) for t in part.text) / 2
            whole = dict(zip(before.doc_id, before.text))
            assert all(whole[r.doc_id] == r.text for r in after.itertuples())
            assert after.doc_id.value_counts().max() <= 3
        elif name == "packing":
            n = sum(len(x) + 1 for x in packing.token_ids(before.text.tolist(), packing.default_tokenizer()))
            assert after.length.sum() == n and (after.groupby("sequence_id").length.sum().iloc[:-1] == packing.LENGTH).all()
    assert kept["packing"] >= 1 and np.isfinite(quality.THRESHOLD)


def test_run_gives_the_last_stage(spark, tmp_path):
    corpus(spark, str(tmp_path))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"


def test_near_duplicates_of_rows_that_share_an_id(spark):
    a, b, c, d, e = (make_text(60 + i, 80) for i in range(5))
    rows = [(1, a), (2, a + " tail"), (2, b), (3, c), (3, c), (None, d), (None, d + " tail"), (None, d), (None, e), (None, e), (4, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.deduplicate(spark, docs, "").collect()]
    of_d = [x for x in got if x[1] in (d, d + " tail")]
    assert len(of_d) == 1 and of_d[0][0] is None
    order = lambda rows: sorted(rows, key=str)
    assert order(set(got) - set(of_d)) == order({(1, a), (2, b), (3, c), (None, e), (4, None), (None, "")}) and len(got) == 8


def test_rows_that_share_a_hash_are_told_apart(spark):
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, f"t{i % 60}") for i in range(300)], "doc_id long, text string")
    named, ids = corpus_pipeline._rows(docs, 4096)
    pairs = named.distinct().collect()
    assert len({r["_row"] for r in pairs}) == len(pairs) == docs.distinct().count() == ids.count()
    assert len({h[0] for h in docs.distinct().selectExpr("pmod(xxhash64(0, doc_id, doc_id is null, text), 4096)").collect()}) < len(pairs)
