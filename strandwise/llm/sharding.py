"""Sharding by a hierarchical weighted hash tree.

Shards are leaves of a tree region > rack > shard.  A document descends it: at each level every child draws
``-ln(u) / weight``, u in (0, 1] being a hash of the document's key and the child's name, and the least draw wins.
A child's chance is its share of the weights, and a change of weights moves keys only into or out of the
subtrees whose weights changed.  The shards of the start make whole regions; each shard that is added opens a region
of its own and keeps it for good, so growth from any number of shards moves keys to the new one alone.

Null text has size 1; a null doc_id is a key of its own; repeated rows share a shard and have slots each.  An
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwise.llm.common import documents, stored

RACKS, SHARDS = 2, 2
#: Shards at the start in the query.
FOUNDED = 8
#: Hexadecimal digits of a hash that cut each shard in parts, numbered apart; no task numbers a whole shard.
PART_DIGITS = 3


def tree(n_shards: int, founded: int = 0) -> dict[str, dict[str, list[int]]]:
    """region > rack > shards, for equal shards: those of the start in regions of RACKS x SHARDS, the others each in its own.

    founded: the number at the start; it must stay the same when shards are added.
    """
    if founded > n_shards:
        raise ValueError(f"{founded} shards at the start are more than {n_shards}")
    out: dict[str, dict[str, list[int]]] = {}
    for i in range(n_shards):
        region = f"r{i // (RACKS * SHARDS)}" if i < founded else f"x{i}"
        out.setdefault(region, {}).setdefault(f"{region}k{i // SHARDS % RACKS if i < founded else 0}", []).append(i)
    return out


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """The hash draw of a child: 52 bits of md5 as a number in (0, 1], to an exponential with rate ``weight``."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), name)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1) / float(2**52)) / weight


def _least(key: Column, children: Column) -> Column:
    """The child whose draw is least, the first of equals."""
    drawn = lambda c, i: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), i.alias("i"), c.alias("child"))
    return F.array_min(F.transform(children, drawn))["child"]


def tree_shard(key: Column, n_shards: int, weights: dict[int, float] | None = None, founded: int = 0) -> Column:
    """The shard of ``key`` (a string column) among shards 0 to n_shards - 1; weights: of shards, 1 where not given.

    The tree is one constant, an array of regions of racks of shards, and only the chosen region's racks and the chosen rack's
    shards are drawn, so the expression doesn't grow with the number of shards.
    """
    weight = lambda i: float((weights or {}).get(i, 1.0))
    node = lambda name, held, **more: {"name": name, "weight": sum(map(weight, held)), **more}
    regions = [
        node(region, [i for s in racks.values() for i in s], kids=[node(rack, s, kids=[node(f"s{i}", [i], shard=i) for i in s]) for rack, s in racks.items()])
        for region, racks in tree(n_shards, founded).items()
    ]
    kind = "array<struct<name:string,weight:double,kids:array<struct<name:string,weight:double,kids:array<struct<name:string,weight:double,shard:int>>>>>>"
    constant = F.from_json(F.lit(json.dumps(regions)), kind)
    return _least(key, _least(key, _least(key, constant)["kids"])["kids"])["shard"]


def numbered(rows: DataFrame, group: str, key: Column, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps: parts of a group are numbered apart and then moved up."""
    rows = rows.withColumn("_part", F.conv(F.substring(F.md5(key), 1, PART_DIGITS), 16, 10).cast("int"))
    sizes = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    base = sizes.withColumn("_base", F.sum("_n").over(W.partitionBy(group).orderBy("_part")) - F.col("_n")).drop("_n")
    within = W.partitionBy(group, "_part").orderBy(*order)
    # base has 16^PART_DIGITS rows a shard at most, whatever the input's size
    placed = rows.withColumn("_at", F.row_number().over(within) - 1).join(F.broadcast(base), [group, "_part"])
    return placed.withColumn(name, (F.col("_base") + F.col("_at")).cast("long")).drop("_part", "_base", "_at")


def shard_documents(docs: DataFrame, n_shards: int = 8, founded: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law holds from any number of shards to the next as long as ``founded`` stays the same; with none, every shard has a region of its own.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        tree_shard(key, n_shards, None, founded).alias("shard"),
        tree_shard(key, n_shards + 1, None, founded).alias("grown_shard"),
    )
    order = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = stored(rows, "shards")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return numbered(rows, "shard", key, ["doc_id", "size", "text_crc32"], "slot").select(*order)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), 8, FOUNDED)


def _sql_least(draws: list[str], values: list[str]) -> str:
    if len(values) == 1:
        return values[0]
    low = f"least({', '.join(draws)})"
    return "CASE " + " ".join(f"WHEN {d} = {low} THEN {v}" for d, v in zip(draws[:-1], values[:-1])) + f" ELSE {values[-1]} END"


def _sql_shard(n_shards: int) -> str:
    def draw(name: str, weight: int) -> str:
        return f"(-ln((CAST('0x' || substr(md5(k || '|{name}'), 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE) / {float(weight)}::DOUBLE)"

    region_draws, region_values = [], []
    for region, racks in tree(n_shards, FOUNDED).items():
        rack_draws, rack_values = [], []
        for rack, shards in racks.items():
            rack_draws.append(draw(rack, len(shards)))
            rack_values.append(_sql_least([draw(f"s{i}", 1) for i in shards], [str(i) for i in shards]))
        region_draws.append(draw(region, sum(map(len, racks.values()))))
        region_values.append(_sql_least(rack_draws, rack_values))
    return f"CAST({_sql_least(region_draws, region_values)} AS INTEGER)"


OP5_SQL = f"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS UBIGINT)], list_transform(range(8), lambda j: CAST(0 AS UBIGINT))),
    lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END)) AS t),
d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, k, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda i: CAST(CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) AS UBIGINT))),
      lambda s, b: xor(s // 256, t[CAST(xor(s, b) % 256 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32,
    {_sql_shard(8)} AS shard, {_sql_shard(9)} AS grown_shard
  FROM d, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k), 1, {PART_DIGITS}), doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM c
"""
