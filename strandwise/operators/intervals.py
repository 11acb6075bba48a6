"""Interval algebra on DataFrames with columns chrom, start, end (0-based, half-open).

A contig may hold most rows, so nothing here sorts or joins a whole contig in one task if it can be cut first:
merges and running sums are made inside bins of BIN bases and then across bins, and range joins meet in bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN = 1 << 14
#: Bins in which range joins meet: short against bins are the reads, few are the bins that a transcript touches.
JOIN_BIN = 1 << 11
#: Pairs that are looked at in the time in which a row is moved to one bin more.
MOVE = 50


def _islands(df: DataFrame, *keys: str) -> DataFrame:
    """Merge overlapping and touching intervals inside each group of keys."""
    line = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def merge(df: DataFrame, *keys: str) -> DataFrame:
    """Sorted disjoint union; touching intervals join, empty ones go.  keys: chrom unless given."""
    keys = keys or ("chrom",)
    kinds = {c: df.schema[c].dataType for c in ("start", "end")}
    rows = _exploded(df.where("start < end").select(*keys, "start", "end").distinct(), F.col("start"), F.col("end"), BIN)
    low, high = F.col("_bin") * BIN, (F.col("_bin") + 1) * BIN
    cut = rows.withColumns({"start": F.greatest("start", low), "end": F.least("end", high)})
    # Islands that reach no edge of their bin are whole; the others, two a bin at most, are joined across bins.
    alone = F.when((F.col("start") > low) & (F.col("end") < high), F.col("start"))
    islands = _islands(_islands(cut, *keys, "_bin").withColumn("_alone", alone).drop("_bin"), *keys, "_alone")
    return islands.select(*keys, *[F.col(c).cast(t).alias(c) for c, t in kinds.items()])


def _exploded(df: DataFrame, start: Column, end: Column, size: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(start / size), F.floor(F.greatest(end - 1, start) / size))))


#: Each level of bins of a join over mixed lengths has bins so many times as wide as the one below.
WIDER, LEVELS = 8, 6


def _leveled(rows: DataFrame, start: Column, end: Column, size: int, lifted: Column | None) -> DataFrame:
    """rows with _own (the first level whose bins are no shorter than the row, so that it touches two at most), _level, _bin and _way.

    Way 0 is a row's own level; way 1 are the levels of ``lifted`` (an array) above it.
    """
    length = end - start
    own = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        own = F.when(length <= size * WIDER**k, k).otherwise(own)
    rows = rows.withColumn("_own", own)
    mine = F.array(F.struct(F.col("_own").alias("level"), F.lit(0).alias("way")))
    if lifted is not None:
        above = F.filter(lifted, lambda k: k > F.col("_own"))
        mine = F.concat(mine, F.transform(above, lambda k: F.struct(k.alias("level"), F.lit(1).alias("way"))))
    rows = rows.withColumn("_at", F.explode(mine))
    width = F.lit(size) * F.element_at(F.array(*[F.lit(WIDER**k).cast("long") for k in range(LEVELS)]), F.col("_at.level") + 1)
    bins = F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(end - 1, start) / width)))
    return rows.withColumns({"_level": F.col("_at.level"), "_way": F.col("_at.way"), "_width": width}).withColumn("_bin", bins).drop("_at")


def _salted(a: DataFrame, b: DataFrame, keys: dict[str, str], hot: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with _salt: rows of the left side's bins above ``hot`` rows are dealt into parts, and the right side's stand in each part.

    A table with a row for each such bin, so one for ``hot`` rows at most, is broadcast.
    """
    crowded = a.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).withColumn("_parts", F.ceil(F.col("_n") / hot)).drop("_n")
    kinds = [c for c, t in a.dtypes if "map<" not in t]
    left = a.join(F.broadcast(crowded), list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(*kinds), F.coalesce("_parts", F.lit(1)))).select(*a.columns, "_salt")
    for key, other in keys.items():
        crowded = crowded.withColumnRenamed(key, other)
    right = b.join(F.broadcast(crowded), list(keys.values()), "left")
    right = right.withColumn("_rsalt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).select(*b.columns, "_rsalt")
    return left, right


def _renamed(b: DataFrame, *names: str) -> DataFrame:
    """The right side's own columns under other names: chrom as _chrom and _bin as _rbin."""
    for name in ("chrom", "_bin", *names):
        b = b.withColumnRenamed(name, "_chrom" if name == "chrom" else f"_r{name[1:]}")
    return b


def _met(a: DataFrame, b: DataFrame, keys: dict[str, str], meet: Column, hot: int | None) -> DataFrame:
    """Rows of both sides that are in one bin and meet.

    Neither side is broadcast: a plan takes a side to be as small as its file, and not as the places or bins that its rows were spread to.
    """
    if hot is not None:
        a, b = _salted(a, b, keys, hot)
        keys = keys | {"_salt": "_rsalt"}
    for key, other in keys.items():
        meet &= F.col(key) == F.col(other)
    return a.join(b.hint("merge"), meet)


def fit(left: DataFrame, right: DataFrame) -> tuple[int, float, float]:
    """The power of two, JOIN_BIN at most, as the width of bins in which left and right meet at least cost, the rows that then stand in bins
    and the overlapping pairs to expect.

    On a contig of g bases, n and m rows of l and k bases make n * m * (w + l) * (w + k) / (w * g) pairs to look at and n * l / w + m * k / w
    more rows; the sum is least at one w.  Counts are made while the query is made: one aggregate of each side, met by contig.
    """

    def counts(rows: DataFrame, start: str, end: str, p: str) -> DataFrame:
        bases = F.sum(F.greatest(F.col(end) - F.col(start), F.lit(0)).cast("double"))
        return rows.groupBy("chrom").agg(F.count("*").cast("double").alias(f"{p}n"), bases.alias(f"{p}bases"), F.min(start).alias(f"{p}low"), F.max(end).alias(f"{p}high"))

    both = counts(left, "start", "end", "").join(counts(right, "r_start", "r_end", "r"), "chrom")
    span = F.greatest(F.greatest("high", "rhigh") - F.least("low", "rlow"), F.lit(1))
    sums = both.agg(
        F.sum(F.col("n") * F.col("rn") / span),
        F.sum(F.col("bases") * F.col("rbases") / span + MOVE * (F.col("bases") + F.col("rbases"))),
        F.sum(F.col("n") + F.col("rn")),
        F.sum(F.col("bases") + F.col("rbases")),
        F.sum((F.col("n") * F.col("rbases") + F.col("rn") * F.col("bases")) / span),
    )
    wide, narrow, rows, bases, pairs = [x or 0.0 for x in sums.first()]
    size = min(JOIN_BIN, 1 << max(round(math.log2(max(narrow / wide, 1)) / 2), 4)) if wide else JOIN_BIN
    return size, rows + bases / size, pairs


def fitted_bin(left: DataFrame, right: DataFrame) -> int:
    """The width of bins that asks least of overlap_join(left, right)."""
    return fit(left, right)[0]


def overlap_join(left: DataFrame, right: DataFrame, size: int = JOIN_BIN, mixed: bool = False, hot: int | None = None) -> DataFrame:
    """Pairs with left.start < right.end and right.start < left.end on one contig.

    left: chrom, start, end and others; right: chrom, r_start, r_end and others.  Both sides are sent to the bins they
    touch and a pair is kept in the bin of its later start only, so it comes once.

    mixed: bins of several widths, for sides that both hold long ranges.  A row is in the two bins at most of its own level; a pair meets
    on the higher of its levels: right rows are lifted to all levels above theirs, left rows only to those that right rows have (the right
    side is worked out twice for that).  Where the right side is a model of genes, its rows in many short bins are cheaper than
    reads on several levels, so it is off unless asked for.
    hot: rows of the left side above which a bin is split (its rows are counted first, so the left side is worked out twice).
    """
    own = ["_bin", "_chrom", "_rbin", "_level", "_rlevel", "_way", "_rway", "_own", "_rown", "_width", "_rwidth", "_salt", "_rsalt"]
    meet = (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    keys = {"chrom": "_chrom", "_bin": "_rbin"}
    if mixed:
        levels = _leveled(right, F.col("r_start"), F.col("r_end"), size, None).agg(F.collect_set("_own").alias("_levels"))
        a = _leveled(left.crossJoin(F.broadcast(levels)), F.col("start"), F.col("end"), size, F.col("_levels")).drop("_levels")  # one row
        b = _leveled(right, F.col("r_start"), F.col("r_end"), size, F.array(*map(F.lit, range(LEVELS))))
        # left rows on their own level meet all that stands there, lifted ones only rows whose own level it is
        b = _renamed(b, "_level", "_way", "_own", "_width").withColumn("_rway", F.explode(F.when(F.col("_rway") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        keys |= {"_level": "_rlevel", "_way": "_rway"}
        meet &= F.col("_bin") == F.floor(F.greatest("start", "r_start") / F.col("_width"))
    else:
        a = _exploded(left, F.col("start"), F.col("end"), size)
        b = _renamed(_exploded(right, F.col("r_start"), F.col("r_end"), size))
        meet &= F.col("_bin") == F.floor(F.greatest("start", "r_start") / size)
    return _met(a, b, keys, meet, hot).drop(*own)


def point_join(points: DataFrame, at: str, regions: DataFrame, strict: bool = False, size: int = JOIN_BIN, hot: int | None = None) -> DataFrame:
    """Points and the regions that hold them: r_start <= at < r_end, or r_start < at < r_end when strict.  hot: as in overlap_join."""
    a = points.withColumn("_bin", F.floor(F.col(at) / size))
    b = _renamed(_exploded(regions, F.col("r_start"), F.col("r_end"), size))
    low = F.col("r_start") < F.col(at) if strict else F.col("r_start") <= F.col(at)
    return _met(a, b, {"chrom": "_chrom", "_bin": "_rbin"}, low & (F.col(at) < F.col("r_end")), hot).drop("_chrom", "_bin", "_rbin", "_salt", "_rsalt")


def range_sums(points: DataFrame, at: str, ranges: DataFrame, key: str, **sums: Column) -> DataFrame:
    """key and sums of the points at r_start <= at < r_end, over all of a key's ranges (chrom, r_start, r_end, key); zeros where none are.

    sums: aggregates (whole numbers) of the points' columns, which are null in rows that stand for no point.  A range's sum is the sum of
    what lies before its end less that before its start, so points and ranges are counted apart and their pairs never come up.
    """
    ends = F.explode(F.expr("array(named_struct('pos', cast(r_start as bigint), 'sign', -1), named_struct('pos', cast(r_end as bigint), 'sign', 1))"))
    asked = ranges.where("chrom is not null and r_start < r_end").select("chrom", key, ends.alias("e")).select("chrom", key, "e.*").withColumn("_bin", F.floor(F.col("pos") / BIN))
    given = points.where("chrom is not null").withColumn("pos", F.col(at).cast("long"))
    both = given.unionByName(asked.select("chrom", "pos", F.lit(True).alias("_asked")).distinct(), allowMissingColumns=True)
    both = both.withColumn("_bin", F.floor(F.col("pos") / BIN)).where("pos is not null").repartition("chrom", "_bin")
    events = both.groupBy("chrom", "_bin", "pos").agg(F.max("_asked").alias("_asked"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()])
    bins = events.groupBy("chrom", "_bin").agg(*[F.sum(n).alias(n) for n in sums])
    order = W.partitionBy("chrom").orderBy("_bin")  # a row for each bin
    bins = bins.select("chrom", "_bin", *[(F.sum(n).over(order) - F.col(n)).alias(f"_{n}") for n in sums])
    line = W.partitionBy("chrom", "_bin").orderBy("pos")
    before = events.select("chrom", "_bin", "pos", "_asked", *[(F.sum(n).over(line) - F.col(n)).alias(n) for n in sums]).where("_asked")
    before = before.join(bins, ["chrom", "_bin"]).select("chrom", "pos", *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])
    met = asked.drop("_bin").join(before.hint("merge"), ["chrom", "pos"])
    return met.groupBy(key).agg(*[F.sum(F.col("sign") * F.col(n)).alias(n) for n in sums])


def reach(ranges: DataFrame) -> DataFrame:
    """chrom, r_start, r_end, reach: for each place in r_start <= at < r_end, the end that is farthest of the ranges (chrom, r_start, r_end) that hold it.

    The rows are disjoint, so a place meets one of them at most: two places lie in one range if the reach of the first is beyond the second.
    """
    starts = ranges.where("chrom is not null and r_start < r_end").groupBy("chrom", F.col("r_start").cast("long").alias("r_start")).agg(F.max("r_end").cast("long").alias("far"))
    starts = starts.withColumn("_bin", F.floor(F.col("r_start") / BIN))
    order = W.partitionBy("chrom").orderBy("_bin")  # a row for each bin that has starts
    bins = starts.groupBy("chrom", "_bin").agg(F.max("far").alias("_far"), F.min("r_start").alias("_low"))
    bins = bins.select("chrom", "_bin", F.max("_far").over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.lead("_low").over(order).alias("_after"))
    line = W.partitionBy("chrom", "_bin").orderBy("r_start")
    runs = starts.withColumns({"_most": F.max("far").over(line), "_next": F.lead("r_start").over(line)}).join(bins, ["chrom", "_bin"])
    runs = runs.select("chrom", "r_start", F.coalesce("_next", "_after").alias("_until"), F.greatest("_most", "_before").alias("reach"))
    return runs.select("chrom", "r_start", F.least("_until", "reach").alias("r_end"), "reach").where("r_start < r_end")


def as_right(df: DataFrame, *keep: str) -> DataFrame:
    return df.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), *keep)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common ranges of the merged sides."""
    met = overlap_join(merge(a), as_right(merge(b)))
    return met.select("chrom", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end")).where("start < end")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """What the merged left side has and the merged right side has not."""
    left, right = merge(a), merge(b)
    met = overlap_join(left, as_right(right))
    line = W.partitionBy("chrom", "start", "end").orderBy("r_start")
    after = met.withColumn("_next", F.lead("r_start").over(line)).withColumn("_first", F.row_number().over(line) == 1)
    pieces = after.select("chrom", F.explode(F.array(
        F.struct(F.col("r_end").alias("s"), F.coalesce("_next", "end").alias("e")),
        F.struct(F.when(F.col("_first"), F.col("start")).alias("s"), F.col("r_start").alias("e")),
    )).alias("p")).select("chrom", F.col("p.s").alias("start"), F.col("p.e").alias("end")).where("start < end")
    whole = left.join(met.select("chrom", "start", "end").distinct(), ["chrom", "start", "end"], "left_anti")
    return whole.unionByName(pieces)


def overlap_length(queries: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """key, bases: how many bases of each query the merged regions hold."""
    met = overlap_join(queries, as_right(merge(regions)))
    sums = met.groupBy(key).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("bases"))
    return queries.select(key).join(sums, key, "left").select(key, F.coalesce("bases", F.lit(0)).cast("long").alias("bases"))


def coverage(df: DataFrame, weight: Column | None = None, *keys: str) -> DataFrame:
    """Runs (keys, start, end, depth) of equal non-zero depth.  keys: chrom unless given.

    An interval is two events; sums of events by position, then by bin, give every position's depth without
    listing bases.  Runs are cut at events, so neighbours may have equal depth only where events cancel out.
    """
    keys = keys or ("chrom",)
    unit = weight if weight is not None else F.lit(1)
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), unit.alias("d")), F.struct(F.col("end").alias("pos"), (-unit).alias("d"))))
    events = df.where("start < end").select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.pos").alias("start")).agg(F.sum("e.d").alias("d"))
    events = events.where("d <> 0").withColumn("_bin", F.floor(F.col("start") / BIN))
    bins = events.groupBy(*keys, "_bin").agg(F.sum("d").alias("_all"), F.min("start").alias("_low"))
    order = W.partitionBy(*keys).orderBy("_bin")  # a row for each bin that has events
    bins = bins.select(*keys, "_bin", (F.sum("_all").over(order) - F.col("_all")).alias("_base"), F.lead("_low").over(order).alias("_after"))
    line = W.partitionBy(*keys, "_bin").orderBy("start")
    placed = events.withColumn("_sum", F.sum("d").over(line)).withColumn("_lead", F.lead("start").over(line)).join(bins, [*keys, "_bin"])
    return placed.select(*keys, "start", F.coalesce("_lead", "_after").alias("end"), (F.col("_base") + F.col("_sum")).alias("depth")).where("depth <> 0 and end is not null")
