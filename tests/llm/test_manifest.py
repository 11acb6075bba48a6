"""The Merkle manifest against a plain tree in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from strandwise.llm import merkle, ranks


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return h("".join(fields))


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def steps(tree, i, arity):
    out = []
    for nodes in tree[:-1]:
        first = i // arity * arity
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + arity])))
        i //= arity
    return out


def brute(rows, arity=2):
    """doc_id, leaf, subroot, root, proof, folded root of rows of doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    for rs in groups.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([leaf(*r) for r in groups[g]], arity) for g in langs}
    top = levels([trees[g][-1][0] for g in langs], arity)
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = steps(trees[g], i, arity) + steps(top, k, arity)
            node = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = leaf(*r[:3], r[3] + 1, r[4])
            for a, b in path:
                node = h(a + node + b)
            out.append((r[0], leaf(*r), trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in path)), node, node == top[-1][0]))
    return out


def documents(spark, rows):
    made = spark.createDataFrame([r for r in rows], "doc_id long, source string, lang string, n_chars long, text string")
    return made.withColumns({c: F.lit(1) for c in ("hash", "item", "rank", "block", "node", "root", "subroot", "leaf", "tampered", "steps", "d0")}).repartition(3)


def result(spark, rows, arity, digits):
    found = merkle.manifest(documents(spark, rows), arity, digits)
    root = merkle.folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("p"), root.alias("f"))
    return [tuple(r) for r in found.withColumn("v", F.col("f") == F.col("root")).collect()]


ROWS = [(i * 7 % 50 if i % 9 else None, f"s{i % 3}" if i % 4 else None, ["en", "é", None, "de", "zz"][min(i % 13, 4)], i if i % 5 else None, "text " * (i % 6) if i % 8 else None) for i in range(90)]
ROWS += [ROWS[3]] * 3 + [(99, None, "one", 2**63 - 1, "a" * 400_000)]


@pytest.mark.parametrize("arity, digits", [(2, 2), (3, 1), (2, 8)])
def test_manifest(spark, arity, digits):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(result(spark, ROWS, arity, digits), key=key) == sorted(brute(ROWS, arity), key=key)


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5])
def test_small_trees(spark, n):
    rows = [(i, "s", "en", 5, "t") for i in range(n)]
    assert sorted(result(spark, rows, 2, 1)) == sorted(brute(rows))


def test_tampering_shows(spark):
    rows = [(i, "s", ["en", "de"][i % 2], 5, f"t{i}") for i in range(40)]
    hit = {i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert hit and {r[0] for r in result(spark, rows, 2, 3) if not r[-1]} == hit


def test_ranks_of_a_key_over_parts(spark):
    """One key holds most rows; it stands in several parts."""
    rows = spark.range(1000).select(F.when(F.col("id") < 900, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), "id")
    got = ranks.ranked(rows, ["k"], ["id"]).toPandas().sort_values(["k", "id"])
    assert (got["rank"] == got.groupby("k").cumcount()).all()
    assert ranks.ranked(rows, [], ["id"]).where("rank <> id").count() == 0
