"""WARC archives: writing with revisits, reading, and capture histories by external merge.

Writing.  Payloads are grouped by their SHA-256; of payloads that several pages share, the largest page_id is the response
and the others are revisits of it.  Groups with more than a share of all pages (so fewer than HOT of them) are sent to every task; other
shared payloads are joined.  A bitmap lets pages whose payload nobody shares be written where they are read.  Each task
writes one file with a gzip member for each record.  Spark's text sink puts a line end after each row; here the line end is an empty
member, so files are sound .warc.gz on any store that Spark writes to.

Reading.  A file is one row and is decoded record by record; whole-file gzip and plain files are read too.

Histories.  Each reading task sorts its captures by URL key and time into a run.  The runs are cut at common range borders,
and each range's pieces are merged by a tree of losers.  A capture's number within its URL key may count over ranges.

Null html is an empty payload.  A page with a null page_id revisits any numbered one; pages that share the largest page_id of a payload, or
have none, are responses each.  Null URLs have no target and a null key, which comes first; control characters and blanks of a URL are
percent-encoded.  Dates count page_id's seconds from EPOCH, modulo 2^30, as pages have no times.  Repeated rows are captures each.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import BITMAP_BITS, bitmap_of, in_bitmap, small_batches, stored
from strandwise.llm.ranks import ranked
from strandwise.sources import storage

#: Payloads from so many bytes on are revisited.
SHARED_BYTES = 1000
#: A payload that more than one of HOT pages has is sent to every task: fewer than HOT rows, whatever the table's size.
HOT = 200
#: Captures that one task merges, about.
MERGED_ROWS = 1 << 17
EPOCH = datetime.datetime(2024, 1, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "file string, offset long, length long, record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, intact boolean"


def member(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def _date(page_id: int | None) -> str:
    return (EPOCH + datetime.timedelta(seconds=(page_id or 0) % 2**30)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:x-capture:{'-' if page_id is None else page_id}:{sha1}>"


def _target(url: str) -> str:
    return re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, leader: tuple[int, str | None] | None) -> bytes:
    """A response record, or, with a leader (page_id and url), a revisit of it."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit" if leader else "response"), ("WARC-Record-ID", _record_id(page_id, sha1)), ("WARC-Date", _date(page_id))]
    if url is not None:
        head.append(("WARC-Target-URI", _target(url)))
    if leader:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(leader[0], sha1)), ("WARC-Refers-To-Date", _date(leader[0]))]
        if leader[1] is not None:
            head.append(("WARC-Refers-To-Target-URI", _target(leader[1])))
    else:
        block += payload
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _records(batch: pa.RecordBatch, hot: dict) -> pa.RecordBatch:
    """value: the member of each page.  A page's leader comes from its columns or, by its payload, from ``hot``."""
    columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "payload", "lead_id", "lead_url")]
    out = []
    for page_id, url, html, sha1, payload, lead_id, lead_url in zip(*columns):
        if payload in hot:
            lead_id, lead_url = hot[payload]
        leader = (lead_id, lead_url) if lead_id is not None and lead_id != page_id else None
        out.append(member(record(page_id, url, html, sha1, leader)))
    return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_warc(pages: DataFrame, path: str) -> None:
    """Archives of all pages (page_id, url, html) in a new folder."""
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    pages = pages.withColumns({"sha1": F.sha1("html"), "payload": F.when(F.octet_length("html") >= SHARED_BYTES, F.sha2("html", 256))})
    groups = pages.where("payload is not null").groupBy("payload").agg(F.max(F.struct("page_id", "url")).alias("lead"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1 and lead.page_id is not null").select("payload", F.col("lead.page_id").alias("lead_id"), F.col("lead.url").alias("lead_url"), "n"), "payloads")
    often = F.col("n") > pages.count() // HOT
    hot = spark.sparkContext.broadcast({r["payload"]: (r["lead_id"], r["lead_url"]) for r in groups.where(often).collect()})
    bits = spark.sparkContext.broadcast(bitmap_of(groups, F.col("payload")))

    def shared(batch: pa.RecordBatch) -> np.ndarray:
        """Pages whose payload others may have, but for hot ones."""
        maybe = in_bitmap(bits.value, batch.column("slot").to_numpy())
        return maybe & np.array([p is not None and p not in hot.value for p in batch.column("payload").to_pylist()], bool)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _records(batch.filter(pa.array(~shared(batch))), hot.value)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared(batch)))

    no_leader = {"lead_id": F.lit(None).cast("long"), "lead_url": F.lit(None).cast("string")}
    slotted = pages.withColumn("slot", F.pmod(F.xxhash64("payload"), F.lit(BITMAP_BITS)))
    joined = slotted.mapInArrow(others, slotted.schema).drop("slot").join(groups.where(~often).drop("n"), "payload", "left")
    made = [slotted.withColumns(no_leader).mapInArrow(alone, "value binary"), joined.mapInArrow(lambda batches: (_records(b, {}) for b in batches), "value binary")]
    lines = made[0].unionAll(made[1]).select(F.col("value").cast("string"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1")).text(path)


def _members(data: bytes, chunk: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member, or of the whole where it is not compressed."""
    if data[:2] != b"\x1f\x8b":
        yield 0, len(data), data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        made, out, to = zlib.decompressobj(31), [], at
        while not made.eof:
            if to >= len(data):
                raise ValueError("a gzip member is cut off")
            out.append(made.decompress(view[to : to + chunk]))
            to = min(to + chunk, len(data))
        to -= len(made.unused_data)
        yield at, to - at, b"".join(out)
        at = to


def warc_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset and length (of the member, or of the record where there are none), header fields by lower-case name, and block."""
    packed = data[:2] == b"\x1f\x8b"
    for offset, length, content in _members(data):
        at = 0
        while at < len(content):
            if not content.startswith(b"WARC/", at) or (end := content.find(b"\r\n\r\n", at)) < 0:
                raise ValueError(f"no WARC record at {offset if packed else at}")
            lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            to = end + 4 + int(head["content-length"])
            yield (offset, length, head, content[end + 4 : to]) if packed else (at, to + 4 - at, head, content[end + 4 : to])
            at = to + 4


def _hex_digest(text: str | None) -> str | None:
    """A sha1 digest of base 32 or base 16 as lower-case hex."""
    name, _, value = (text or "").partition(":")
    if name.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def _row(file: str, offset: int, length: int, head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
    said, kind = _hex_digest(head.get("warc-payload-digest")), head.get("warc-type")
    if kind == "revisit":
        size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        n, digest, intact = int(size[1]) if size else None, said, True
    else:
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
        intact = said in (None, digest)
    return file, offset, length, kind, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-refers-to"), digest, n, intact, payload


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each record of the files in a folder.

    payload_digest is of the payload as read, of revisits as their header says; intact tells whether the header agrees; with
    ``payload`` the bytes come too.  A task holds one file and one record at a time.
    """
    small_batches(spark)
    schema = _RECORD + ", payload binary" * payload
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}.get(x.split(" ")[1], pa.string()) for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for file, content in zip(b.column("path"), b.column("content")):
                rows, held = [], 0
                for found in warc_records(content.as_py()):
                    rows.append(_row(file.as_py(), *found))
                    held += len(found[3]) if payload else 1 << 9
                    if held >= 1 << 22:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def url_key(url: Column) -> Column:
    """Host parts from the last to the first, then path and query; lower case, without scheme, www, usual ports and fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), "^[a-z][a-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), ":(80|443)$", ""), "^www[0-9]*[.]", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


class LoserTree:
    """Merges sorted runs: a leaf for each run, in each node the loser of the two that met there, and the winner above all."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * self.k
        winners = [*([-1] * self.k), *range(self.k)]
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (b, a) if self.before(b, a) else (a, b)
        self.winner = winners[1] if self.k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        """Whether run a's next value comes before run b's; an ended run comes last, of equals the first run's."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or x == y and a < b

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Run and place in it of each value, in order of the values."""
        for _ in range(sum(map(len, self.runs))):
            best = self.winner
            yield best, self.at[best]
            self.at[best] += 1
            node = (best + self.k) // 2
            while node:
                if self.before(self.losers[node], best):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best


ORDER = ["url_key", "date", "record_id", "file", "offset"]


def sorted_runs(records: DataFrame) -> DataFrame:
    """Captures with url_key, run and place: what a task reads is one run, sorted there."""
    runs = records.withColumns({"url_key": url_key(F.col("target_uri")), "run": F.spark_partition_id()}).sortWithinPartitions(*ORDER)
    return stored(runs.withColumn("place", F.monotonically_increasing_id()), "runs")


def merged_runs(runs: DataFrame) -> DataFrame:
    """All captures in order of ORDER, by ranges.  A task holds the pieces of runs that fall in its range."""
    spark = runs.sparkSession
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), runs.count() // MERGED_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([], arrow)], arrow).combine_chunks()
        number = pieces["run"].to_numpy()
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, np.int64)
        keys = list(zip(*[[(x is not None, x) if c == "url_key" else x or "" for x in pieces[c].to_pylist()] if c != "offset" else pieces[c].to_pylist() for c in ORDER]))
        ends = [*starts[1:], len(keys)]
        order = [starts[r] + i for r, i in LoserTree([keys[a:b] for a, b in zip(starts, ends)])] if len(keys) else []
        for i in range(0, len(order), 1 << 13):
            yield from pieces.take(pa.array(order[i : i + (1 << 13)], pa.int64())).combine_chunks().to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(runs.schema)
    return runs.repartitionByRange(n_parts, *ORDER).sortWithinPartitions("run", "place").mapInArrow(run, runs.schema)


def histories(records: DataFrame) -> DataFrame:
    """Records in order of URL key and time, with ``capture``, the number from 0 within the key."""
    runs = sorted_runs(records)
    return ranked(runs, ["url_key"], ORDER[1:], "capture", merged_runs(runs)).drop("run", "place")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = storage.new_folder(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    number = lambda c: F.regexp_extract(c, "^<urn:x-capture:(-?[0-9]+):", 1)
    page = lambda c: F.when(number(c) != "", number(c)).cast("long")
    columns = ["payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "url_key", "capture"]
    return histories(read_warc(spark, folder)).select(page("record_id").alias("page_id"), *columns)


OP12_SQL = f"""
WITH p AS (SELECT page_id, lower(url) AS url, encode(coalesce(html, '')) AS payload FROM pages),
g AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS lead,
    regexp_replace(regexp_replace(url, '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM p),
k AS (
  SELECT *, regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*'), ':(80|443)$', ''), '^www[0-9]*[.]', '') AS host, regexp_replace(bare, '^[^/?]*', '') AS rest,
    payload_bytes >= {SHARED_BYTES} AND lead IS NOT NULL AND page_id IS DISTINCT FROM lead AS again FROM g),
u AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key FROM k)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN lead END AS refers_to, url_key,
  row_number() OVER (PARTITION BY url_key ORDER BY ((coalesce(page_id, 0) % 1073741824) + 1073741824) % 1073741824, CASE WHEN page_id IS NULL THEN '-' ELSE CAST(page_id AS VARCHAR) END, payload_digest) - 1 AS capture
FROM u
"""
