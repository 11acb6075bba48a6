"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct five-word shingles, in one global order: tokens counted as rare, tokens
counted as frequent, tokens not counted; by hash inside each class.  Counted are the tokens in the lowest
COUNTED of the hash range, over all documents; no prefix reaches further unless it runs out of them.

Documents x, y with overlap of 0.8 share a token among the first ``p = |x| - ceil(0.8 |x|) + 1`` of each, and two
among the first ``p + 1``.  So rare and uncounted tokens are indexed alone, and frequent ones as combinations of
two out of the prefix extended by one.  Where a prefix holds more than MOST_COMBINED frequent tokens, those are
indexed alone too and searched for pairs with such a document.

Documents that share a key are candidates.  A parity bitmap of each token set bounds the symmetric difference
from below, which drops nearly all other candidates; the rest are verified on their whole texts.  Lists of a key
are searched in blocks and give a spanning forest of their links, not all pairs.  A key all of whose tokens stand in
more than BLOCK documents is hot: its rows are dealt by document and never meet in one task.

Equal word sequences are one class and searched once.  Null and wordless texts have no tokens and no links.
Rows with one doc_id are one node; a null doc_id links with nothing.  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import BITMAP_BITS, bitmap_of, bitmap_of_slots, documents, in_bitmap, mix, stored, text_batches
from strandwise.llm.components import components
from strandwise.llm.words import Words, sequence_hashes

WORDS = 5
#: Part of the hash range in which tokens are counted; a prefix takes a fifth of a document's tokens.
COUNTED = 0.28
#: A token in more documents than this is frequent; at most so many are told to all tasks (2 MB).
FREQUENT, MOST_FREQUENT = 16, 1 << 18
MOST_COMBINED = 16
#: Lists up to this length give their pairs, longer ones are searched in blocks of BLOCK documents by their bitmaps;
#: groups are verified in blocks of GROUP_BLOCK documents by their texts.
SHORT_LIST, BLOCK = 16, 4096
GROUP_BLOCK = 128

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def token_sets(texts: pa.Array) -> tuple[Words, list[np.ndarray]]:
    """The sorted distinct tokens of each text."""
    words = Words(texts, lower=True)
    h = words.hashes
    n = len(h) - WORDS + 1
    rolled = mix(sum(h[i : i + n] * _MULTIPLIERS[i] for i in range(WORDS))) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for i in range(len(words.counts)):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            out.append(sequence_hashes(words, np.array([a]), np.array([b]), 3))
        else:
            out.append(np.zeros(0, np.uint64))
    return words, out


def parity_bits(n: int) -> int:
    """Bits of a set's parity bitmap: a power of two from twice its size, so sizes within 0.8 differ by one doubling."""
    return max(64, min(1 << 16, 1 << int(2 * n - 1).bit_length()))


def parity(tokens: np.ndarray) -> np.ndarray:
    """Each token flips one bit.  Bitmaps of two sets differ in at most as many bits as the sets differ in tokens."""
    m = parity_bits(len(tokens))
    odd = np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def summaries(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (the word sequence's hash), n (size of the token set), bits (its parity bitmap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            words, sets = token_sets(batch.column("text"))
            first, last = words.first[:-1], words.first[1:]
            h1, h2 = (sequence_hashes(words, first, last, s).view(np.int64) for s in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(h1), pa.array(h2), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s).tobytes() for s in sets], pa.binary())],
                ["doc_id", "h1", "h2", "n", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, h1 long, h2 long, n long, bits binary")


def counted_tokens(docs: DataFrame) -> DataFrame:
    """token, count of all tokens of the counted range, and of others that a prefix reaches, in more than FREQUENT documents."""
    limit = np.uint64(int(COUNTED * 2.0**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            _, sets = token_sets(batch.column("text"))
            low = [s[: max(np.searchsorted(s, limit), prefix(len(s)) + 1)] for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low).view(np.int64))], ["token"])

    return docs.select("text").mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") > FREQUENT)


def frequent_tokens(counts: DataFrame) -> np.ndarray:
    """The most frequent tokens of the counted range, sorted; their number is bounded, and any set of them gives right results."""
    limit = int(COUNTED * 2.0**64)  # below 2^63, so the counted tokens are those that are not negative and below it
    top = counts.where(F.col("token").between(0, limit - 1)).orderBy(F.desc("count"), "token").limit(MOST_FREQUENT)
    return np.sort(top.select("token").toArrow()["token"].to_numpy().astype(np.int64).view(np.uint64))


def prefix(n: int) -> int:
    """Tokens in a prefix of a set of n."""
    return n - (4 * n + 4) // 5 + 1


def index_keys(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Keys of a document, which of them are single frequent tokens, and whether those may meet any document."""
    return keys_and_heat(tokens, frequent, np.zeros(len(tokens), bool))[:3]


def keys_and_heat(tokens: np.ndarray, frequent: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool, np.ndarray]:
    """What index_keys gives, and which keys are hot: those all of whose tokens are marked in ``many``."""
    n = len(tokens)
    p = prefix(n)
    at = np.searchsorted(frequent, tokens)
    is_frequent = np.zeros(n, bool)
    if len(frequent):
        at[at == len(frequent)] = 0
        is_frequent = frequent[at] == tokens
    if n <= 2:  # an overlap of 0.8 may be a single token
        return tokens, np.zeros(n, bool), True, many
    kind = np.where(tokens >= np.uint64(int(COUNTED * 2.0**64)), 2, is_frequent.astype(np.int8))
    order = np.lexsort((tokens, kind))[: p + 1]
    often = order[is_frequent[order]]
    if not len(often):
        return tokens[order[:p]], np.zeros(p, bool), True, many[order[:p]]
    single = order[~is_frequent[order]]
    long = len(often) > MOST_COMBINED
    alone = [np.zeros(len(single), bool), np.ones(len(often), bool)]
    keys, heavy = [tokens[single], tokens[often]], [many[single], many[often]]
    if not long:
        i, j = np.triu_indices(len(often), 1)
        i, j = often[i], often[j]
        keys.append(mix(tokens[i] * _MULTIPLIERS[0] + tokens[j] * _MULTIPLIERS[1], 5))
        alone.append(np.zeros(len(i), bool))
        heavy.append(many[i] & many[j])
    return np.concatenate(keys), np.concatenate(alone), long, np.concatenate(heavy)


def index(docs: DataFrame, frequent, hot) -> DataFrame:
    """key, h1, n, alone, long, hot: a row for each key of a document; equal word sequences give equal rows.

    hot: a bitmap of tokens in more than BLOCK documents, by their lowest bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            words, sets = token_sets(batch.column("text"))
            h1 = sequence_hashes(words, words.first[:-1], words.first[1:], 1).view(np.int64)
            many = lambda s: in_bitmap(hot.value, (s & np.uint64(BITMAP_BITS - 1)).astype(np.int64))
            made = [(h, len(s), *keys_and_heat(s, frequent.value, many(s))) for h, s in zip(h1, sets) if len(s)]
            if made:
                sizes = [len(m[2]) for m in made]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([m[2] for m in made]).view(np.int64)),
                        pa.array(np.repeat(np.array([m[0] for m in made], np.int64), sizes)),
                        pa.array(np.repeat(np.array([m[1] for m in made], np.int32), sizes)),
                        pa.array(np.concatenate([m[3] for m in made])),
                        pa.array(np.repeat(np.array([m[4] for m in made]), sizes)),
                        pa.array(np.concatenate([m[5] for m in made])),
                    ],
                    ["key", "h1", "n", "alone", "long", "hot"],
                )

    return docs.select("text").mapInArrow(run, "key long, h1 long, n int, alone boolean, long boolean, hot boolean")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole batches' worth of groups from sorted batches: no group is cut between two tables."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        cols = [table[k].to_numpy() for k in keys]
        same = np.ones(table.num_rows, bool)
        for c in cols:
            same &= c == c[-1]
        cut = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups begin in a sorted table, and its end."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for k in keys:
        c = table[k].to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


class _Plane:
    """Members whose bitmaps have one length, by size; what has been reached is struck out."""

    def __init__(self, members: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray]):
        self.members, self.sizes, self.open = members, sizes[members], np.ones(len(members), bool)
        self.at = {int(i): k for k, i in enumerate(members)}
        self.same = np.stack([bits[i] for i in members])
        half = self.same.shape[1] // 2
        self.folded = self.same[:, :half] ^ self.same[:, half:]

    def strike(self, at: np.ndarray) -> None:
        self.open[at] = False
        if 2 * self.open.sum() < len(self.open):
            keep = self.open
            self.members, self.sizes, self.same, self.folded, self.open = (x[keep] for x in (self.members, self.sizes, self.same, self.folded, self.open))
            self.at = {int(i): k for k, i in enumerate(self.members)}


def near_enough(bits: list[np.ndarray], sizes: np.ndarray, long: np.ndarray | None = None, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and bitmaps allow to be linked; left: only pairs across the two sides.

    Breadth first: each member is laid beside those not yet reached, so a crowd that its first member reaches costs one step.
    """
    order = np.argsort(sizes, kind="stable")
    ms = np.array([len(b) for b in bits])
    planes = {int(m): _Plane(order[ms[order] == m], sizes, bits) for m in np.unique(ms)}
    seen, out = np.zeros(len(sizes), bool), []
    for start in order:
        if seen[start]:
            continue
        seen[start] = True
        planes[int(ms[start])].strike(planes[int(ms[start])].at[int(start)])
        waiting = [int(start)]
        while waiting:
            i = waiting.pop()
            m, x = int(ms[i]), bits[i]
            for length in (m, 2 * m, m // 2):
                plane = planes.get(length)
                if plane is None or not len(plane.members):
                    continue
                lo, hi = np.searchsorted(plane.sizes, sizes[i] * 0.8 - 1e-9), np.searchsorted(plane.sizes, sizes[i] * 1.25 + 1e-9, "right")
                if hi <= lo:
                    continue
                table = plane.folded if length > m else plane.same
                y = x[:length] ^ x[length:] if length < m else x
                others = plane.members[lo:hi]
                ok = plane.open[lo:hi] & (9 * np.bitwise_count(table[lo:hi] ^ y).sum(axis=1) <= sizes[i] + sizes[others])
                if long is not None and not long[i]:
                    ok &= long[others]
                if left is not None:
                    ok &= left[others] != left[i]
                found = others[ok]
                if len(found):
                    plane.strike(lo + np.flatnonzero(ok))
                    seen[found] = True
                    waiting.extend(found.tolist())
                    out.extend((i, j) for j in found.tolist())
    return out


def candidates(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: pairs of classes whose components hold every link.  classes: h1, rep, n, bits."""
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = stored(counted_tokens(docs), "tokens")
    frequent = spark.sparkContext.broadcast(frequent_tokens(counts))
    slots = counts.where(F.col("count") > BLOCK).select(F.col("token").bitwiseAND(F.lit(BITMAP_BITS - 1)).alias("slot"))
    heavy = spark.sparkContext.broadcast(bitmap_of_slots(slots))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of hot keys, which come first, as they are; pairs of short lists (key null); rows of long ones and of frequent tokens."""
        batches, cold = iter(batches), []
        for batch in batches:
            b = batch.filter(batch.column("hot"))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("h1"), pa.nulls(b.num_rows, pa.int64()), pc.or_(b.column("long"), pc.invert(b.column("alone"))), b.column("hot")], names)
            if b.num_rows < batch.num_rows:
                cold = [batch.slice(b.num_rows)]
                break
        for table in runs(chain(cold, batches), ["key"]):
            at = bounds(table, ["key"])
            sizes = np.diff(at)
            h1, n, key = table["h1"].to_numpy(), table["n"].to_numpy(), table["key"].to_numpy()
            alone, long = table["alone"].to_numpy(), table["long"].to_numpy()
            pairs = [], []
            rows = np.zeros(len(h1), bool)
            for s in np.unique(sizes[sizes > 1]):
                starts = at[:-1][sizes == s]
                if s > SHORT_LIST:
                    for a in starts:
                        rows[a : a + s] = not alone[a] or long[a : a + s].any()
                    continue
                i, j = np.triu_indices(s, 1)
                i, j = (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()
                ok = (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (h1[i] != h1[j]) & (~alone[i] | long[i] | long[j])
                i, j = i[ok], j[ok]
                pairs[0].append(np.minimum(h1[i], h1[j]))
                pairs[1].append(np.maximum(h1[i], h1[j]))
            if pairs[0]:
                found = np.unique(np.stack([np.concatenate(pairs[0]), np.concatenate(pairs[1])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.nulls(found.shape[1], pa.int64()), pa.array(found[0]), pa.array(found[1]), *[pa.nulls(found.shape[1], pa.bool_())] * 2], names)
            if rows.any():
                count = int(rows.sum())
                yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(h1[rows]), pa.nulls(count, pa.int64()), pa.array((long | ~alone)[rows]), pa.array(np.zeros(count, bool))], names)

    names = ["key", "a", "b", "long", "hot"]
    keyed = index(docs, frequent, heavy).groupBy("key", "h1").agg(*[F.first(c).alias(c) for c in ("n", "alone", "long", "hot")])
    dealt = keyed.repartition(n_parts, "key", F.when(F.col("hot"), F.col("h1"))).sortWithinPartitions(F.desc("hot"), "key", "h1")
    found = stored(dealt.mapInArrow(lists, "key long, a long, b long, long boolean, hot boolean"), "lists")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = np.zeros(len(na), bool)
            for k, (x, y) in enumerate(zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(x) > len(y):
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                keep[k] = 9 * int(np.bitwise_count(x ^ y).sum()) <= na[k] + nb[k]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda h, rep, n, x: classes.select(F.col("h1").alias(h), F.col("rep").alias(rep), F.col("n").alias(n), F.col("bits").alias(x))
    pairs = found.where("key is null").select(F.col("a").alias("ha"), F.col("b").alias("hb")).distinct()
    pairs = pairs.join(side("ha", "a", "na", "xa"), "ha").join(side("hb", "b", "nb", "xb"), "hb").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(check, "a long, b long")

    rows = found.where("key is not null").select("key", F.col("a").alias("h1"), "long", "hot")
    whole = rows.where("not hot").select("key", "h1", "long", F.lit(0).alias("own"), F.lit(0).alias("other"))  # no more than BLOCK rows
    salted = rows.where("hot").withColumn("salt", F.pmod(F.xxhash64("h1", F.lit(7)), F.lit(n_parts)).cast("int"))
    blocks = salted.groupBy("key").agg(F.count("*").alias("rows"), F.max("long").alias("useful")).where("rows > 1 and useful")
    blocks = blocks.select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("salt"))
    cut = salted.join(blocks, ["key", "salt"]).withColumn("own", F.pmod(F.xxhash64("h1", F.lit(3)), F.col("blocks")).cast("int"))
    cut = cut.select("key", "h1", "long", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = whole.unionByName(cut).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    rows = rows.join(classes.select("h1", "rep", "n", "bits"), "h1").select("key", "i", "j", F.col("own") == F.col("i"), "rep", "n", "bits", "long").toDF("key", "i", "j", "left", "rep", "n", "bits", "long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["key", "i", "j"]):
            at, cross = bounds(table, ["key", "i", "j"]), table["i"].to_numpy() != table["j"].to_numpy()
            rep, n, long, left = table["rep"].to_numpy(), table["n"].to_numpy(), table["long"].to_numpy(), table["left"].to_numpy()
            bits = [np.frombuffer(x, np.uint64) for x in table["bits"].to_pylist()]
            edges = set()
            for a, b in zip(at[:-1], at[1:]):
                edges.update((min(rep[a + i], rep[a + j]), max(rep[a + i], rep[a + j])) for i, j in near_enough(bits[a:b], n[a:b], long[a:b], left[a:b] if cross[a] else None))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], ["a", "b"])

    searched = rows.repartition(n_parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(search, "a long, b long")
    return pairs.unionByName(searched)


def verified(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b: links whose components are those of all true links inside each group.  groups: node, component.

    A group's texts are cut into blocks, and each block is compared by itself.  Groups of several blocks go on with
    one text for each part found so far.  Where a group still has several parts, texts outside its largest part meet
    every block; those of the largest part are not set against one another again.
    """
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks"))
    groups = groups.join(sizes, "component")
    itself = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
    links = stored(compared(docs, groups.select("component", "node", F.col("node").alias("part"), itself.alias("own")).selectExpr("*", "own as i", "own as j")), "links")
    large = stored(groups.where("blocks > 1").select("component", "node"), "large")
    if not large.limit(1).count():
        return links

    parts = stored(_parts(large, links), "parts")
    firsts = parts.where("node = part").select("component", "node", "part")
    count = firsts.groupBy("component").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks"), F.count("*").alias("parts")).where("parts > 1")
    count = stored(count, "open")
    if not count.limit(1).count():
        return links
    firsts = firsts.join(count, "component").select("component", "node", "part", itself.alias("own")).selectExpr("*", "own as i", "own as j")
    links = stored(links.unionByName(compared(docs, firsts)), "links")

    parts = stored(_parts(large, links), "parts")
    by_part = parts.groupBy("component", "part").agg(F.count("*").alias("size"))
    main = by_part.groupBy("component").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("all")).where("most < all")
    main = stored(main, "main")
    if not main.limit(1).count():
        return links
    main = main.withColumn("few", F.ceil((F.col("all") - F.col("most")) / GROUP_BLOCK).cast("int")).withColumn("blocks", F.ceil(F.col("most") / GROUP_BLOCK).cast("int"))
    rest = parts.join(main, "component").withColumn("own", F.when(F.col("part") == F.col("main"), F.col("few") + itself).otherwise(F.pmod(F.xxhash64("node", F.lit(5)), F.col("few")).cast("int")))
    last = F.when(F.col("part") == F.col("main"), F.col("few") - 1).otherwise(F.col("few") + F.col("blocks") - 1)
    cells = rest.select("component", "node", "part", "own", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    cells = cells.select("component", "node", "part", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return links.unionByName(compared(docs, cells))


def _parts(members: DataFrame, links: DataFrame) -> DataFrame:
    """component, node, part: the smallest node that links reach from each member."""
    labels = components(links.join(members.select(F.col("node").alias("a")), "a", "left_semi")).select("node", F.col("component").alias("part"))
    return members.join(labels, "node", "left").select("component", "node", F.coalesce("part", "node").alias("part"))


def compared(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """a, b: a spanning forest of the true links in each cell.  cells: component, i, j, own, node, part.

    A cell with i = j holds one block; in others only texts of different blocks are compared.  Nodes of one part are linked already.
    """
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = spark.sparkContext.broadcast(bitmap_of(cells.select("node").distinct(), F.col("node")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(wanted.value, batch.column("slot").to_numpy())))

    ids = docs.select(F.col("doc_id").cast("long").alias("node"), "text").where("node is not null")
    some = ids.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(BITMAP_BITS))).mapInArrow(pick, "node long, text string, slot long").drop("slot")
    rows = some.join(cells, "node").select("component", "i", "j", "own", "part", "node", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs((s for b in batches for s in text_batches([b])), ["component", "i", "j"]):
            at = bounds(table, ["component", "i", "j"])
            node, own, part, cross = (table[c].to_numpy() for c in ("node", "own", "part", "i"))
            cross = cross != table["j"].to_numpy()
            sets = [s for b in table.to_batches() for t in text_batches([b]) for s in token_sets(t.column("text"))[1]]
            edges = []
            for a, b in zip(at[:-1], at[1:]):
                edges += [(node[a + i], node[a + j]) for i, j in true_links(sets[a:b], own[a:b] if cross[a] else None, part[a:b])]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges)], ["a", "b"])

    return rows.repartition(n_parts, "component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(check, "a long, b long")


def true_links(sets: list[np.ndarray], side: np.ndarray | None, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of pairs with 100 * intersection >= 80 * union.

    side: only pairs with different sides; part: sets of one part are linked from the start.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    bits = [parity(s) for s in sets]
    root = list(range(len(sets)))
    if part is not None:
        _, first, of = np.unique(part, return_index=True, return_inverse=True)
        root = [int(first[k]) for k in of]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k, i in enumerate(order):
        x, bx = sets[i], bits[i]
        if not len(x):
            continue
        for j in order[k + 1 :]:
            y, by = sets[j], bits[j]
            if 5 * len(x) < 4 * len(y):
                break
            if side is not None and side[i] == side[j] or find(i) == find(j):
                continue
            if len(by) != len(bx):
                by = by[: len(bx)] ^ by[len(bx) :]
            if 9 * int(np.bitwise_count(bx ^ by).sum()) > len(x) + len(y):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                root[find(i)] = find(j)
                out.append((i, j))
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    base = stored(summaries(docs), "summaries")
    live = base.where("n > 0 and doc_id is not null")
    classes = stored(live.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "classes")
    groups = stored(components(candidates(docs, classes)), "groups")
    labels = components(verified(docs, groups))
    reps = classes.select("h1", "h2", F.col("rep").alias("node")).join(labels, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    shown = base.select("doc_id", "n", "h1", "h2").join(reps, ["h1", "h2"], "left")
    return shown.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP9_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS c FROM sh GROUP BY doc_id),
classes AS (SELECT c, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY c),
ws AS MATERIALIZED (SELECT rep, n, s FROM classes JOIN sh ON sh.doc_id = rep),
links AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM ws a JOIN ws b ON a.s = b.s AND a.rep <> b.rep AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
low AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (c) LEFT JOIN low USING (rep)
"""
