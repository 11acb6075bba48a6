"""WARC archives and capture histories against plain Python."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandwise.llm import warc


def make(spark, rows):
    made = spark.createDataFrame(rows, "page_id long, url string, html string")
    return made.withColumns({c: F.lit(1) for c in ("payload", "sha1", "slot", "lead_id", "lead_url", "value", "run", "n")}).repartition(5)


LONG = "é" + "x<p>\r\n\r\nWARC/1.1\r\n" * 100
ROWS = [(i, f"http://www.Host{i % 4}.org:80/a?b={i % 3}#f", (LONG + str(i % 6) if i % 2 else f"short {i % 3}")) for i in range(60)]
ROWS += [(None, "https://a.b/", LONG + "1"), (None, None, None), (61, None, ""), (62, "http://x.y", None), (3, ROWS[3][1], ROWS[3][2]), (63, "no url\r\nX: y", "z" * 3_000_000)]
ROWS += [(None, "u", "w" * 1000), (None, "v", "w" * 1000), (70, "p", "q" * 999), (71, "p", "q" * 999)]


def brute(rows):
    lead = {}
    for page, _, html in rows:
        if page is not None:
            lead[html or ""] = max(lead.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = lead.get(html or "") if len(data) >= 1000 else None
        again = first is not None and first != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("hot", [200, 12])
def test_round_trip(spark, tmp_path, monkeypatch, hot):
    """hot 12: payloads that a twelfth of the pages share go to every task."""
    monkeypatch.setattr(warc, "HOT", hot)
    warc.write_warc(make(spark, ROWS), f"{tmp_path}/w")
    got = warc.read_warc(spark, f"{tmp_path}/w", payload=True).collect()
    number = lambda x: None if x is None or ":-:" in x else int(x.split(":")[2])
    assert sorted(((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"])) for r in got), key=key) == sorted(brute(ROWS), key=key)
    texts = {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in ROWS}
    assert all(r["intact"] and (r["record_type"] == "revisit" or r["payload"] == texts[r["payload_digest"]]) for r in got)
    for r in got[:20]:  # offset and length address a member of the file
        with open(r["file"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            assert r["record_id"].encode() in gzip.decompress(f.read(r["length"]))
    assert {r["target_uri"] for r in got} >= {"no%20url%0D%0AX:%20y", None}


def test_other_files_are_read(spark, tmp_path):
    records = [warc.record(i, "http://a.b/c", b"x" * i, hashlib.sha1(b"x" * i).hexdigest(), None) for i in range(5)]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r["payload_bytes"] for r in got) == sorted([*range(5)] * 2)
    plain = {r["offset"]: r["length"] for r in got if r["file"].endswith("plain.warc")}
    assert sorted(plain.items()) == [(sum(map(len, records[:i])), len(r)) for i, r in enumerate(records)]
    with pytest.raises(ValueError):
        list(warc.warc_records(b"".join(records)[3:]))
    with pytest.raises(ValueError):
        list(warc.warc_records(gzip.compress(records[0])[:-9]))


def test_histories(spark, tmp_path):
    warc.write_warc(make(spark, ROWS), f"{tmp_path}/w")
    got = warc.histories(warc.read_warc(spark, f"{tmp_path}/w")).collect()
    by_url = {}
    for r in got:
        by_url.setdefault(r["url_key"], []).append((r["capture"], r["date"], r["record_id"]))
    assert len(got) == len(ROWS) and len(by_url) == 4 * 3 + 7
    for found in by_url.values():
        found.sort()
        assert [x[0] for x in found] == list(range(len(found))) and [x[1:] for x in found] == sorted(x[1:] for x in found)
    assert "org,host1)/a?b=0" in by_url and "b,a)/" in by_url and None in by_url


def test_order_is_global(spark, tmp_path, monkeypatch):
    """Ranges follow one another and each is in order."""
    monkeypatch.setattr(warc, "MERGED_ROWS", 10)
    warc.write_warc(make(spark, ROWS), f"{tmp_path}/w")
    merged = warc.merged_runs(warc.sorted_runs(warc.read_warc(spark, f"{tmp_path}/w")))
    rows = merged.withColumn("part", F.spark_partition_id()).collect()
    keys = [((r["url_key"] is not None, r["url_key"]), r["date"], r["record_id"]) for r in sorted(rows, key=lambda r: r["part"])]
    assert keys == sorted(keys) and len({r["part"] for r in rows}) > 3


def test_loser_tree():
    for seed in range(60):
        rng = random.Random(seed)
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 12))]
        got = [runs[r][i] for r, i in warc.LoserTree(runs)]
        assert got == sorted(x for r in runs for x in r)


def test_empty(spark, tmp_path):
    warc.write_warc(make(spark, ROWS).limit(0), f"{tmp_path}/w")
    assert warc.histories(warc.read_warc(spark, f"{tmp_path}/w")).count() == 0
