"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).  A flow network sends token
capacity from patterns to source quotas: a pattern offers its tokens once at no cost and again at a rising cost
for each repeat, up to a limit.  Patterns that share no source, not even by way of others, are networks of their
own; each is solved in a task, so neither patterns nor sources meet on the driver.  Then each pattern's documents
stand in a seeded order, and its sources take the line one after the other.

Null text has size 0; a null source, and an empty or null array of sources, is a source of its own, ordered last;
repeated rows count each, and equal rows take their turns.  Where nothing has a size, every target is 0.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from strandwise.llm.common import documents, stored
from strandwise.llm.components import components
from strandwise.llm.jaccard import bounds, runs

#: A document is taken so often at most, a source's target is so many times its size at most.
MOST_REPEATS = 3
#: Ranges of the seeded order that are summed before the one range that a quota cuts is ordered document by document.
RANGES = 1 << 12


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def targets(sizes: dict, weights: dict) -> dict:
    """Share the sum of sizes by weight; no target above MOST_REPEATS sizes, the excess reshared until none is."""
    left, open_, out = sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * left > MOST_REPEATS * sizes[s] * total}
        if not full:
            return out | {s: weights[s] * left / total for s in open_}
        for s in full:
            out[s] = float(MOST_REPEATS * sizes[s])
        left -= sum(MOST_REPEATS * sizes[s] for s in full)
        open_ -= full
    return out


def route(capacity: dict, quota: dict) -> dict:
    """Min-cost flow from patterns (tuples of sources) to sources: {(pattern, source): tokens}.

    The k-th repeat of a pattern's tokens costs k a token, so the flow spreads repeats evenly.  Successive
    shortest paths over residual arcs; costs are small integers and never negative before the first path.
    """
    arcs: list[list] = []  # to, capacity, cost; arc i ^ 1 is its reverse
    out: dict = {}

    def arc(a, b, cap, cost):
        out.setdefault(a, []).append(len(arcs))
        arcs.append([b, cap, cost])
        out.setdefault(b, []).append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    used = {}
    for p, tokens in capacity.items():
        for k in range(MOST_REPEATS):
            arc("from", ("p", p), tokens, k)
        for s in p:
            if s in quota:
                used[p, s] = arc(("p", p), ("s", s), MOST_REPEATS * tokens, 0)
    for s, q in quota.items():
        arc(("s", s), "to", q, 0)
    height: dict = {}
    while True:
        far, via, heap, n = {"from": 0}, {}, [(0, 0, "from")], 0
        while heap:
            d, _, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for i in out.get(a, ()):
                b, cap, cost = arcs[i]
                to = d + cost + height.get(a, 0) - height.get(b, 0)
                if cap > 0 and (b not in far or to < far[b]):
                    far[b], via[b], n = to, i, n + 1
                    heapq.heappush(heap, (to, n, b))
        if "to" not in far:
            return {k: arcs[i + 1][1] for k, i in used.items() if arcs[i + 1][1]}
        reach = far["to"]
        for a in out:
            height[a] = height.get(a, 0) + min(far.get(a, reach), reach)
        path, a = [], "to"
        while a != "from":
            path.append(via[a])
            a = arcs[via[a] ^ 1][0]
        push = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= push
            arcs[i ^ 1][1] += push


def _members(docs: DataFrame) -> Column:
    """The row's sources in order: each after an s, and n for none."""
    coded = lambda c: F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c))
    if not isinstance(docs.schema["source"].dataType, ArrayType):
        return F.array(coded(F.col("source")))
    some = F.array_sort(F.array_distinct(F.transform("source", coded)))
    return F.when(F.size("source") > 0, some).otherwise(F.array(F.lit("n")))


def source_targets(patterns: DataFrame) -> DataFrame:
    """source, size, target, quota (the target in whole words).  patterns: members, tokens.

    Sources in code point order, null last, weigh 1, 2, 3 and again.  Those whose target would be above MOST_REPEATS
    sizes are the first by size for weight; the rest share what is left.
    """
    sizes = patterns.select(F.explode("members").alias("source"), "tokens").groupBy("source").agg(F.sum("tokens").alias("size"))
    total = patterns.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    ranked = sizes.withColumn("w", (F.row_number().over(W.orderBy(F.col("source") == "n", "source")) - 1) % 3 + 1)  # a row for each source
    before = W.orderBy(F.col("size") / F.col("w"), "source").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    ranked = ranked.crossJoin(F.broadcast(total))  # one row
    ranked = ranked.withColumns({
        "left": F.col("total") - F.coalesce(F.sum(MOST_REPEATS * F.col("size")).over(before), F.lit(0)),
        "open": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    ranked = ranked.withColumn("full", F.col("w") * F.col("left") > MOST_REPEATS * F.col("size") * F.col("open"))
    ranked = ranked.withColumns({
        "left": F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), MOST_REPEATS * F.col("size"))).over(everything), F.lit(0)),
        "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(everything),
    })
    share = (F.col("w") * F.col("left")).cast("double") / F.col("open").cast("double")
    target = F.when(F.col("full"), (MOST_REPEATS * F.col("size")).cast("double")).otherwise(share)
    return ranked.select("source", "size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("quota"))


def routed(patterns: DataFrame, quotas: DataFrame) -> DataFrame:
    """pattern, source, tokens: the flow.  patterns: pattern, members, tokens; quotas: source, quota."""
    ties = patterns.where(F.size("members") > 1).select(F.xxhash64(F.col("members")[0]).alias("a"), F.explode("members").alias("source")).select("a", F.xxhash64("source").alias("b"))
    ties = stored(ties.where("a <> b").distinct(), "ties")
    pairs = patterns.select("pattern", "tokens", F.explode("members").alias("source")).join(quotas.select("source", "quota"), "source")
    node = F.xxhash64("source")
    if ties.limit(1).count():
        pairs = pairs.withColumn("node", node).join(components(ties), "node", "left").withColumn("network", F.coalesce("component", "node"))
    else:
        pairs = pairs.withColumn("network", node)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["network"]):
            at, rows, out = bounds(table, ["network"]), table.to_pylist(), []
            for a, b in zip(at[:-1], at[1:]):
                members, tokens = {}, {}
                for r in rows[a:b]:
                    members.setdefault(r["pattern"], []).append(r["source"])
                    tokens[r["pattern"]] = r["tokens"]
                names = {tuple(sorted(m)): p for p, m in members.items()}
                flow = route({m: tokens[p] for m, p in names.items()}, {r["source"]: r["quota"] for r in rows[a:b]})
                out += [(names[m], s, v) for (m, s), v in flow.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], ["pattern", "source", "tokens"])

    n_parts = int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.select("network", "pattern", "source", "tokens", "quota").repartition(n_parts, "network").sortWithinPartitions("network")
    return pairs.mapInArrow(solve, "pattern string, source string, tokens long")


def select(rows: DataFrame, patterns: DataFrame, flow: DataFrame, seed: int) -> DataFrame:
    """rows with takes: array of source, tokens.  rows: _pattern, _size, _key (what tells rows apart) and others.

    The seeded order of a pattern's rows is cut in RANGES by hash, whose sums tell how many tokens come before each;
    rows are then ordered inside their range, so no task orders a whole pattern.  The line of all rows is laid
    MOST_REPEATS times, and the pattern's sources take it one after the other; the row at a cut gives the words
    still missing.
    """
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_key")))
    rows = rows.withColumn("_order", order).withColumn("_range", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    sums = rows.groupBy("_pattern", "_range").agg(F.sum("_size").alias("_in"))
    before = F.sum("_in").over(W.partitionBy("_pattern").orderBy("_range")) - F.col("_in")  # RANGES rows a pattern at most
    ends = F.sum("tokens").over(W.partitionBy("pattern").orderBy("source"))
    parts = flow.withColumn("to", ends).groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("source", (F.col("to") - F.col("tokens")).alias("from"), "to"))).alias("_parts"))
    plan = patterns.join(parts, "pattern", "left").select(F.col("pattern").alias("_pattern"), F.col("tokens").alias("_all"), "_parts")  # a row for each pattern
    starts = sums.select("_pattern", "_range", before.alias("_before")).join(plan, "_pattern")
    line = W.partitionBy("_pattern", "_range").orderBy("_order", "_size").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("_sofar", F.sum("_size").over(line) - F.col("_size")).join(starts, ["_pattern", "_range"])
    repeats = " + ".join(f"greatest(0L, least(_before + _sofar + _size + {k} * _all, p.to) - greatest(_before + _sofar + {k} * _all, p.from))" for k in range(MOST_REPEATS))
    takes = F.expr(f"coalesce(transform(_parts, p -> named_struct('source', p.source, 'tokens', {repeats})), array())")
    return placed.withColumn("takes", takes).drop("_order", "_range", "_before", "_sofar", "_all", "_parts")


def _mixed(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """rows with takes, and the sources' targets."""
    patterns = stored(rows.groupBy(F.col("_pattern").alias("pattern")).agg(F.first("_members").alias("members"), F.sum("_size").alias("tokens")), "patterns")
    info = stored(source_targets(patterns), "targets")
    flow = stored(routed(patterns, info), "flow")
    return select(rows, patterns, flow, seed), info


def _pattern(members: Column) -> Column:
    return F.to_json(members)


def _key(docs: DataFrame) -> Column:
    """What the seeded order hashes: id and text, so that rows without an id, or of one id, are spread as well."""
    return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _rows(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(*columns, _members(docs).alias("_members"), _pattern(_members(docs)).alias("_pattern"), word_count(F.col("text")).alias("_size"), _key(docs).alias("_key"))


def _sum(takes: str) -> Column:
    return F.expr(f"aggregate({takes}, 0L, (a, t) -> a + t.tokens)")


def mix_memberships(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: a row for each source of each row of docs.

    source is a string or an array of them; taken are the row's words, repeats counted, that go to this source.
    """
    rows, info = _mixed(stored(_rows(docs, F.col("doc_id").cast("long").alias("doc_id")), "rows"), seed)
    each = rows.select("doc_id", F.col("_size").alias("size"), F.explode("_members").alias("source"), "takes")
    taken = F.expr("aggregate(filter(takes, t -> t.source = source), 0L, (a, t) -> a + t.tokens)")
    each = each.withColumn("taken", taken).join(info.select("source", F.col("size").alias("source_size"), "target"), "source")
    return each.select("doc_id", F.expr("if(source = 'n', null, substring(source, 2))").alias("source"), "size", "source_size", "target", "taken")


def mix_sources(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, pattern of every row of documents that have one source each."""
    rows, info = _mixed(stored(_rows(docs, F.col("doc_id").cast("long").alias("doc_id")), "rows"), seed)
    joined = rows.withColumn("source", F.col("_members")[0]).join(info.select("source", F.col("size").alias("source_size"), "target"), "source")
    return joined.select("doc_id", F.col("_size").alias("size"), "source_size", "target", _sum("takes").alias("taken"), F.col("source").alias("pattern"))


def taken_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed corpus: each row as often as it is taken, to the nearest whole number (a half counts as one).

    Only rows at a cut are taken in part, so a source misses its target by half such a row at most for each cut of its
    pattern.  Rows without words have nothing to repeat and stay once.  Columns of docs may have any names.
    """
    columns = docs.columns
    rows = _rows(docs, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    rows, _ = _mixed(rows, seed)
    times = F.when(F.col("_size") == 0, 1).otherwise(F.floor((2 * _sum("takes") + F.col("_size")) / (2 * F.col("_size")))).cast("int")
    rows = rows.select("_row", F.explode(F.array_repeat(F.lit(0), times)))
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).drop("pattern")


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS pattern,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS o
  FROM documents),
s AS (SELECT pattern, sum(size) AS size FROM d GROUP BY pattern),
w AS (SELECT pattern, size, (row_number() OVER (ORDER BY pattern = 'n', pattern) - 1) % 3 + 1 AS w FROM s),
r AS (
  SELECT *, sum(size) OVER () - coalesce(sum({MOST_REPEATS} * size) OVER before, 0) AS left_,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS total
  FROM w WINDOW before AS (ORDER BY size / w, pattern ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, w * left_ > {MOST_REPEATS} * size * total AS capped FROM r),
rest AS (
  SELECT (SELECT sum(size) FROM s) - coalesce(sum(CASE WHEN capped THEN {MOST_REPEATS} * size END), 0) AS left_,
    sum(CASE WHEN NOT capped THEN w END) AS total
  FROM c),
t AS (
  SELECT pattern, size AS source_size,
    CASE WHEN capped THEN CAST({MOST_REPEATS} * size AS DOUBLE) ELSE CAST(w * rest.left_ AS DOUBLE) / rest.total END AS target
  FROM c, rest)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target + 0.5) AS BIGINT) // CAST(source_size AS BIGINT) * size + greatest(0, least(size,
    CAST(floor(target + 0.5) AS BIGINT) % CAST(source_size AS BIGINT)
    - (sum(size) OVER (PARTITION BY pattern ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size))) END AS BIGINT) AS taken
FROM d JOIN t USING (pattern)
"""
