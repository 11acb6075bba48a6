"""Merkle manifest of a dataset, with a proof for each row.

Leaves of a group (documents: of a language) are numbered in order.  A number's digits, to the base ``arity``, become
columns; the last digit is grouped away first, and the structs of the digits' nodes nest in the struct of the node above, until a
bounded block of ``arity ** digits`` leaves is one nested struct.  Blocks' roots are the next tier's leaves, and so on until
a group has one block; groups' roots make a tree of their own.  Proofs come from the nested structs by transform and explode, from the
upper tier down; what an upper tier says of a block meets the block's struct by grouping, so nothing is joined and no row
holds more than a block.

A node is the digest of its children, a lone child included; a group's only node is its root.  Nulls are ``-`` in a leaf.  A null
group is a group of its own and the first; within a group null keys come first and rows of one key by their digest, so
repeated rows have proofs each.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import documents, stored
from strandwise.llm.ranks import field, ranked

ARITY, DIGITS = 2, 8
STEPS = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def joined(texts: Column) -> Column:
    return F.array_join(texts, "")


def block_trees(nodes: DataFrame, keys: list[str], arity: int, digits: int) -> DataFrame:
    """keys, block, node: the nested struct of each block.  nodes: keys, rank, hash, item."""
    digit = lambda k: F.expr(f"cast(rank div {arity**k} % {arity} as int)").alias(f"d{k}")
    block = F.expr(f"rank div {arity**digits}").alias("block")
    rows = nodes.select(*keys, block, *map(digit, range(digits)), F.struct("hash", "item").alias("node"))
    for k in range(digits):
        above = [f"d{j}" for j in range(k + 1, digits)]
        kids = F.transform(F.array_sort(F.collect_list(F.struct(f"d{k}", "node"))), lambda x: x["node"])
        rows = rows.groupBy(*keys, "block", *above).agg(kids.alias("kids"))
        first = sum((F.col(d) for d in above), F.col("block")) == 0
        whole = first & (F.size("kids") == 1)  # the group has no other node on this level
        made = F.when(whole, F.col("kids")[0]["hash"]).otherwise(digest(joined(F.transform("kids", lambda x: x["hash"]))))
        rows = rows.select(*keys, "block", *above, F.struct(made.alias("hash"), "kids").alias("node"))
    return rows


def tiers(nodes: DataFrame, keys: list[str], arity: int, digits: int) -> list[DataFrame]:
    """block_trees of the nodes, of these blocks' roots and so on, until each group has one block."""
    out = []
    while True:
        trees = stored(block_trees(nodes, keys, arity, digits), "tier")
        out.append(trees)
        if not trees.agg(F.max("block")).first()[0]:
            return out
        nodes = trees.select(*keys, F.col("block").alias("rank"), "node.hash", F.struct("block").alias("item"))


def unfolded(node: Column, arity: int, digits: int) -> Column:
    """An array with each leaf of a nested struct: node (hash, item), steps (the siblings before and after, from below)."""

    def step(above: Column, kids: Column, kid: Column, i: Column) -> Column:
        side = lambda at, n: joined(F.transform(F.slice(kids, at, n), lambda x: x["hash"]))
        here = F.array(F.struct(side(F.lit(1), i).alias("before"), side(i + 2, F.lit(arity)).alias("after")))
        return F.when(kid["hash"] == above["hash"], F.array().cast(STEPS)).otherwise(here)  # an only node is the one above

    def below(n: Column) -> Column:
        kids = n["node"]["kids"]
        return F.transform(kids, lambda kid, i: F.struct(kid.alias("node"), F.concat(step(n["node"], kids, kid, i), n["steps"]).alias("steps")))

    nodes = F.array(F.struct(node.alias("node"), F.array().cast(STEPS).alias("steps")))
    for _ in range(digits):
        nodes = F.flatten(F.transform(nodes, below))
    return nodes


def descended(levels: list[DataFrame], upper: DataFrame, keys: list[str], arity: int, digits: int) -> DataFrame:
    """keys, hash, item, said, steps of each leaf below ``levels``.  upper: keys, said (a struct) and steps of each group's root."""
    upper = upper.select(*keys, F.lit(0).cast("long").alias("block"), F.struct("said", "steps").alias("upper"))
    for k, trees in reversed(list(enumerate(levels))):
        kinds = dict(trees.select("node").dtypes) | dict(upper.select("upper").dtypes)
        parts = [
            trees.select(*keys, "block", "node", F.lit(None).cast(kinds["upper"]).alias("upper")),
            upper.select(*keys, "block", F.lit(None).cast(kinds["node"]).alias("node"), "upper"),
        ]
        met = parts[0].unionByName(parts[1]).groupBy(*keys, "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("node", "upper")))
        rows = met.select(*keys, "upper", F.explode(unfolded(F.col("node"), arity, digits)).alias("leaf"))
        steps = F.concat("leaf.steps", "upper.steps").alias("steps")
        if k:
            upper = rows.select(*keys, F.col("leaf.node.item.block").alias("block"), F.struct("upper.said", steps).alias("upper"))
    return rows.select(*keys, "leaf.node.hash", "leaf.node.item", "upper.said", steps)


def prove(leaves: DataFrame, group: str, order: list[str], arity: int = ARITY, digits: int = DIGITS) -> DataFrame:
    """group, hash, item, subroot, root, steps of each leaf.

    leaves: a stored table of group, hash, item (a struct) and the columns of ``order``, which ends in a unique one.
    """
    own = tiers(ranked(leaves, [group], order), [group], arity, digits)
    subroots = own[-1].select(group, "node.hash", F.struct(group).alias("item"))
    top = tiers(ranked(subroots, [], [group]), [], arity, digits)
    said = F.struct(F.col("node.hash").alias("root"))
    root = top[-1].select(said.alias("said"), F.array().cast(STEPS).alias("steps"))
    groups = descended(top, root, [], arity, digits)
    upper = groups.select(F.col(f"item.{group}").alias(group), F.struct(F.col("hash").alias("subroot"), "said.root").alias("said"), "steps")
    rows = descended(own, upper, [group], arity, digits)
    return rows.select(group, "hash", "item", "said.subroot", "said.root", "steps")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof's steps give."""
    return F.aggregate(steps, leaf, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def proof_digest(steps: Column) -> Column:
    return digest(joined(F.transform(steps, lambda s: F.concat(s["before"], s["after"]))))


def document_leaves(docs: DataFrame) -> DataFrame:
    """A leaf for each document; its item holds doc_id and the leaf of the tampered document, null if that is not another."""
    integer = lambda c: F.col(c).cast("long")
    leaf = lambda n_chars: digest(F.concat(field(integer("doc_id")), field(F.col("source")), field(F.col("lang")), field(n_chars), field(F.col("text"))))
    more = integer("n_chars").cast("decimal(20,0)") + 1
    hit = (F.crc32(integer("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    item = F.struct(integer("doc_id").alias("doc_id"), F.when(hit, leaf(more)).alias("tampered"))
    return docs.select("lang", leaf(integer("n_chars")).alias("hash"), item.alias("item"))


def manifest(docs: DataFrame, arity: int = ARITY, digits: int = DIGITS) -> DataFrame:
    """doc_id, lang, leaf, tampered, subroot, root, steps of every document."""
    leaves = document_leaves(docs).withColumns({"doc_id": F.col("item.doc_id"), "uid": F.monotonically_increasing_id()})
    rows = prove(stored(leaves, "leaves"), "lang", ["doc_id", "hash", "uid"], arity, digits)
    return rows.select("item.doc_id", "lang", F.col("hash").alias("leaf"), "item.tampered", "subroot", "root", "steps")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(documents(spark, sf_dir))
    root = folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "{0}", "text")) + ")"

OP11_SQL = f"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS UBIGINT)], list_transform(range(8), lambda j: CAST(0 AS UBIGINT))),
    lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS UBIGINT)) ELSE c // 2 END)) AS t),
crc AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(length(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)) AS UBIGINT))),
    lambda s, b: xor(s // 256, t[CAST(xor(s, b) % 256 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS crc FROM documents, tab),
leaves AS (
  SELECT *, CASE WHEN crc % 7 = 0 THEN {_LEAF.format("CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR)")} ELSE leaf END AS tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM (SELECT doc_id, lang, source, n_chars, text, crc, {_LEAF.format("CAST(n_chars AS VARCHAR)")} AS leaf FROM crc)),
nodes AS (
  SELECT lang, 0 AS level, i, leaf AS hash, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(hash, '' ORDER BY i)), max((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2),
subroots AS (SELECT lang, hash, level AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, g AS i, hash, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(hash, '' ORDER BY i)), max((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, i // 2),
walk AS (
  SELECT row_number() OVER () AS row, doc_id, leaf, l.lang, g, height, hash AS subroot, (SELECT hash FROM tops WHERE n = 1) AS root, (SELECT max(level) FROM tops) AS top, CASE WHEN height = 0 THEN g ELSE l.i END AS i, 0 AS level, tampered AS folded, '' AS proof
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT row, doc_id, leaf, w.lang, g, height, subroot, root, top, CASE WHEN w.level + 1 = height THEN g ELSE w.i // 2 END, w.level + 1,
    sha256(CASE WHEN w.i % 2 = 1 THEN coalesce(s.hash, '') || folded ELSE folded || coalesce(s.hash, '') END), proof || coalesce(s.hash, '')
  FROM walk w
  LEFT JOIN (SELECT 0 AS part, lang, level, i, hash FROM nodes UNION ALL SELECT 1, NULL, level, i, hash FROM tops) s
    ON s.part = (w.level >= height)::INT AND (s.lang IS NOT DISTINCT FROM w.lang OR w.level >= height) AND s.level = w.level - CASE WHEN w.level >= height THEN height ELSE 0 END AND s.i = xor(w.i, 1)
  WHERE w.level < height + top)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM walk WHERE level = height + top
"""
