"""Reads over many transcripts: results against brute force, and plans that make no row of each pair."""

import random
import statistics

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwise import contract
from strandwise.functions import cigar as C
from strandwise.operators import coverage as V
from strandwise.operators import expression as X
from strandwise.operators import intervals as I
from strandwise.operators import regions as G
from strandwise.operators import reports as P
from strandwise.operators import sequences as S
from strandwise.operators import windows as N

READ = "rid long, qname string, flag int, chrom string, pos0 long, mapq int, cigar string, mate_chrom string, mate_pos0 long, tlen int, seq string"


def some_reads(spark, rng, n, cigars=("20M", "8M30N12M", "4S16M", "6M2D14M", "5M6000N15M"), flags=(0, 16, 67, 83, 99, 131, 73)):
    """n reads on two contigs, with mates near or far."""
    rows = []
    for i in range(n):
        at = rng.randrange(0, 9000)
        rows.append((i, f"q{i // 2}", rng.choice(flags), rng.choice("ab"), at, 60, rng.choice(cigars), rng.choice("aab"), max(0, at + rng.randrange(-200, 400)), 0, "A" * 20))
    made = spark.createDataFrame(rows, READ).withColumns({"cigar": C.parse_cigar(F.col("cigar")), "qual": F.expr("array_repeat(40, 20)"), "tags": F.lit(None).cast("map<string,struct<t:string,i:bigint,s:string>>")})
    return made, rows


def some_models(spark, rng, n):
    """n transcripts of one to four exons, most of them within 900 bases of another, some alike and one long."""
    rows = []
    for i in range(n):
        start, blocks = rng.randrange(0, 900) * 10, []
        for _ in range(rng.randrange(1, 5)):
            blocks.append((start, start + rng.choice([15, 40, 90])))
            start = blocks[-1][1] + rng.choice([0, 10, 60, 7000 if i == 0 else 90])
        rows.append([f"t{i}", rng.choice("ab"), blocks[0][0], blocks[-1][1], rng.choice("+-"), blocks[0][0], blocks[-1][1], blocks, i])
    for i in range(0, n, 5):
        rows.append([f"copy{i}", *rows[i][1:8], n + i])
    return spark.createDataFrame(rows, "tx_id string, chrom string, tx_start long, tx_end long, strand string, cds_start long, cds_end long, blocks array<struct<start:long,end:long>>, line long"), rows


def places(at, cigar):
    """Blocks and the end of a read."""
    out, n = [], ""
    for c in cigar:
        if c.isdigit():
            n += c
            continue
        if c == "M":
            out.append((at, at + int(n)))
        at += int(n) if c in "MDNS" else 0
        n = ""
    return out


def pairs_joined(df):
    """Whether the plan lets rows of both sides meet in bins."""
    return "_rbin" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_gene_counts_of_many_genes(spark, seed):
    rng = random.Random(seed)
    reads, read_rows = some_reads(spark, rng, 300)
    exons = []
    for i in range(60):
        at = rng.randrange(0, 9000)
        for _ in range(rng.randrange(1, 4)):
            exons.append((rng.choice("ab"), f"g{i}", at, at + rng.choice([0, 20, 60, 700])))
            at += rng.choice([5, 40, 6010])
    got = P.gene_counts(reads, spark.createDataFrame(exons, "chrom string, gene_id string, start long, end long"))
    want = {}
    for r in read_rows:
        sets = [{g for c, g, s, e in exons if c == r[3] and s <= a and b <= e and s < e} for a, b in places(r[4], r[6])]
        sets = [x for x in sets if x]
        both = set.intersection(*sets) if sets else set()
        if len(both) == 1:
            want[min(both)] = want.get(min(both), 0) + 1
    assert want and {r["gene_id"]: r["reads"] for r in got.collect()} == want
    assert not pairs_joined(got)


def test_range_joins_are_not_broadcast(spark):
    points = spark.range(20).selectExpr("'a' AS chrom", "id AS p")
    regions = spark.range(20).selectExpr("'a' AS chrom", "id AS r_start", "id + 5000 AS r_end")
    for df in (I.point_join(points, "p", regions), I.overlap_join(points.selectExpr("chrom", "p AS start", "p + 9 AS end"), regions)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert I.point_join(points, "p", regions).count() == 210


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_in_one_transcript_by_reach(spark, monkeypatch, seed):
    monkeypatch.setattr(I, "BIN", 256)  # reach is carried over bins
    rng = random.Random(seed)
    reads, rows = some_reads(spark, rng, 400)
    models, model_rows = some_models(spark, rng, 40)
    listed = I.reach(models.selectExpr("chrom", "tx_start AS r_start", "tx_end AS r_end"))
    for r in listed.collect():
        assert r["reach"] == max(m[3] for m in model_rows if m[1] == r["chrom"] and m[2] <= r["r_start"])
    held = {(r["chrom"], p) for r in listed.collect() for p in range(r["r_start"], r["r_end"])}
    assert held == {(m[1], p) for m in model_rows for p in range(m[2], m[3])}
    known = [m for m in model_rows if m[8] > min(x[8] for x in model_rows if x[1] == m[1])]
    got = {r["rid"]: r["label"].startswith(("sameTranscript=Yes", "readPair")) for r in G.inner_distance(reads, models).where("label <> 'sameChrom=No'").collect()}
    done = {r["rid"]: r["pos0"] + r["n"] for r in reads.select("rid", "pos0", (C.aligned_length() + F.expr("aggregate(cigar, 0L, (a, c) -> a + if(c.op = 'N', c.len, 0))")).alias("n")).collect()}
    want = {r[0]: any(m[1] == r[3] and m[2] <= min(done[r[0]] - 1, r[8]) and max(done[r[0]] - 1, r[8]) < m[3] for m in known) for r in rows if r[0] in got}
    assert got == want and set(got.values()) == {True, False}


@pytest.mark.parametrize("seed", [1, 2])
def test_sums_over_ranges(spark, monkeypatch, seed):
    monkeypatch.setattr(I, "BIN", 64)
    rng = random.Random(seed)
    points = [(rng.choice("ab"), rng.randrange(300), rng.randrange(5)) for _ in range(200)]
    ranges = [(rng.choice("ab"), s, s + rng.randrange(-3, 150), rng.choice("xyz")) for s in (rng.randrange(300) for _ in range(40))]
    got = I.range_sums(spark.createDataFrame(points, "chrom string, p long, w int"), "p", spark.createDataFrame(ranges, "chrom string, r_start long, r_end long, k string"), "k", n=F.count("w"), w=F.sum("w"))
    hits = lambda k: [w for c, p, w in points for rc, s, e, rk in ranges if rk == k and rc == c and s <= p < e]
    assert {r["k"]: (r["n"], r["w"]) for r in got.collect()} == {k: (len(hits(k)), sum(hits(k))) for k in "xyz"}


@pytest.mark.parametrize("seed", [1, 2])
def test_fragments_of_many_transcripts(spark, seed):
    rng = random.Random(seed)
    reads, rows = some_reads(spark, rng, 400)
    models, model_rows = some_models(spark, rng, 40)
    made = X.transcript_fragments(reads, models, "1++,1--,2+-,2-+", single=0.5)
    spans = {r["rid"]: r["n"] for r in reads.select("rid", C.reference_span().alias("n")).collect()}
    want = {}
    for rid, _, flag, chrom, at, _, _, _, mate, _, _ in rows:
        w = 1.0 if not flag & 1 else 0.0 if flag & 128 or flag & 12 == 12 else 0.5 if flag & 12 else 1.0
        for m in model_rows:
            if w and m[1] == chrom and at < m[3] and m[2] < at + spans[rid]:
                if any((s < at + 20 and at < e) if not flag & 1 else s <= at < e or s <= mate < e for s, e in m[7]):
                    n = want.setdefault(m[0], [0.0, 0.0, 0.0])
                    n[2] += w
                    if flag & 1:
                        n[1 if flag & 16 else 0] += w
    assert want and {r["tx_id"]: [r["forward"], r["reverse"], r["either"]] for r in made.collect()} == want
    assert not pairs_joined(made)


@pytest.mark.parametrize("seed", [1, 2])
def test_fragment_sizes_of_many_transcripts(spark, seed):
    rng = random.Random(seed)
    reads, rows = some_reads(spark, rng, 600, flags=(67, 83, 99, 73, 131))
    models, model_rows = some_models(spark, rng, 40)
    want = {m[0]: [] for m in model_rows}
    for _, _, flag, chrom, at, _, _, _, mate, _, _ in rows:
        lo, hi = min(at, mate), max(at, mate)
        for m in model_rows:
            if not flag & 136 and m[1] == chrom and m[2] <= lo and hi <= m[3] and at < m[3]:
                want[m[0]].append(20 + sum(max(0, min(e + 1, hi) - max(s + 1, lo + 1) + 1) for s, e in m[7]))
    made = G.fragment_size(reads, models)
    got = {r["tx_id"]: tuple(r)[1:] for r in made.collect()}
    assert any(len(v) >= 3 for v in want.values()) and got.keys() == want.keys()
    for name, sizes in want.items():
        stats = (statistics.mean(sizes), statistics.median(sizes), statistics.pstdev(sizes)) if len(sizes) >= 3 else (0, 0, 0)
        assert got[name] == pytest.approx((len(sizes), *stats))
    assert not pairs_joined(made)


@pytest.mark.parametrize("seed", [1, 2])
def test_strands_over_many_transcripts(spark, seed):
    rng = random.Random(seed)
    reads, rows = some_reads(spark, rng, 400, cigars=("20M", "8M30N12M", "20S"))
    models, model_rows = some_models(spark, rng, 40)
    want = {}
    for _, _, flag, chrom, at, _, cigar, _, _, _, _ in rows:
        end = at + (0 if cigar == "20S" else 20)
        genes = sorted({m[4] for m in model_rows if m[1] == chrom and at < m[3] and m[2] < end})
        if genes:
            own = ("" if not flag & 1 else "1" if flag & 64 else "2") + ("-" if flag & 16 else "+")
            want[(bool(flag & 1), own + ":".join(genes))] = want.get((bool(flag & 1), own + ":".join(genes)), 0) + 1
    flat = reads.where("not (flag & 1 = 1 and flag & 192 = 0)")
    for sample in (None, 10**6):
        assert {(r["paired"], r["key"]): r["reads"] for r in P.strand_inference(flat, models, sample).collect()} == want


def test_saturation_and_starts_make_no_pairs(spark):
    rng = random.Random(3)
    reads, _ = some_reads(spark, rng, 50)
    models, _ = some_models(spark, rng, 10)
    assert not pairs_joined(X.rpkm_saturation(reads, models))


def test_mismatches_where_keys_outgrow_the_read_number(spark, tmp_path):
    table = spark.range(400).selectExpr("id + 1 AS l_orderkey", "300000 + id * 7 AS l_partkey", "5000 + id * 11 AS l_suppkey", "int(1 + id % 7) AS l_linenumber", "double(40) AS l_quantity")
    table.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    for t in ("part", "orders", "events"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    got = [tuple(r) for r in contract.mismatch_profile(spark, str(tmp_path)).orderBy("pos").collect()]
    want = sorted(con.execute(contract.ORACLES["mismatch_profile"]).fetchall())
    assert sum(r[1] for r in want) > 0 and got == want


def test_bins_fit_deep_ranges(spark):
    rng = random.Random(7)
    make = lambda n, most, far: [(rng.choice("ab"), s, s + rng.randrange(most), i) for i in range(n) for s in [rng.randrange(far)]]
    frame = lambda rows: spark.createDataFrame(rows, "chrom string, start long, end long, id long")
    a, b = make(2000, 20, 4000), make(2000, 60, 4000)
    left, right = frame(a), I.as_right(frame(b).withColumnRenamed("id", "b_id"), "b_id")
    size = I.fitted_bin(left, right)
    assert 16 <= size <= 256  # bins of JOIN_BIN would look at pairs that are far apart
    assert I.fitted_bin(left.where("false"), right) == I.JOIN_BIN == I.fitted_bin(frame(make(50, 20, 10**8)), right)
    want = sorted((i, j) for c, s, e, i in a for d, t, f, j in b if c == d and s < f and t < e)
    assert want and sorted((r["id"], r["b_id"]) for r in I.overlap_join(left, right, size).collect()) == want


def test_names_are_counted_where_they_meet(spark):
    tags = "map<string,struct<t:string,i:bigint,s:string>>"
    rows = [(i, f"q{i % 7}" if i % 5 else None, 16 * (i % 2) + 1024 * (i % 3 == 0), "ab"[i % 2], [("M", 5)], {"xf": ("i", i % 4, None), "RE": ("Z", None, "EIN"[i % 3]), **({"TX": ("Z", None, "x")} if i % 2 else {"AN": ("Z", None, "x")})}) for i in range(60)]
    reads = spark.createDataFrame(rows, f"rid long, qname string, flag int, chrom string, cigar array<struct<op:string,len:int>>, tags {tags}").repartition(5)
    stat = S.single_cell_stat(reads, "a")
    sure = [r for r in rows if r[0] % 4 % 2]
    got = stat.first().asDict()
    assert got["alignments"] == 60 and got["confident"] == len(sure) and got["mito"] == 0 and got["reverse"] == len(sure)
    assert got["names"] == len({r[1] for r in rows} - {None}) and got["confident_names"] == len({r[1] for r in sure} - {None})
    assert got["duplicates"] + got["not_duplicates"] == got["sense"] == len(sure) and got["exon"] == sum(r[0] % 3 == 0 for r in sure)
    plan = stat._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("qname") and "REPARTITION_BY_COL" in plan  # no hash table of names before they are dealt by name
    assert {n: n_ for n, n_ in got.items() if "names" not in n} == S.single_cell_stat(reads, "a", names=False).first().asDict()
    assert set(S.single_cell_stat(reads.where("false"), "a").first()) == {0}


def test_pile_up_lays_out_crossing_mates_only(spark, monkeypatch):
    kept, store = {}, V.stored
    monkeypatch.setattr(V, "stored", lambda df, name: kept.setdefault(name, []).append(store(df, name)) or kept[name][-1])
    rng = random.Random(11)
    reads, _ = some_reads(spark, rng, 500)
    models, rows = some_models(spark, rng, 40)
    curve = {r["slot"]: r["covered"] for r in V.genebody_coverage(reads, models).collect()}
    (parts,), (places,) = kept["pileup"], kept["places"]
    assert parts.where("mated and bases is not null").count() and not parts.where("not mated and (qname is not null or bases is not null or quals is not null)").count()
    long = [r for r in rows if sum(e - s for s, e in r[7]) >= 100]
    assert places.count() == len({(r[1], r[4], str(r[7])) for r in long}) < len(long)  # transcripts of one shape list their places once
    listed = V.percentile_positions(models)
    depth = {(r["tx_id"], r["pos"]): r["covered"] for r in V.position_depth(reads, listed).collect()}
    want = {}
    for r in listed.collect():
        for i, pos in enumerate(sorted(r["positions"], reverse=r["strand"] == "-")):
            want[i] = want.get(i, 0) + depth.get((r["tx_id"], pos), 0)
    assert sum(want.values()) and curve == want


def some_ranges(rng, n, most, far, name=str):
    """n ranges on two contigs, some empty, reversed, alike or without a place."""
    rows = []
    for i in range(n):
        s = rng.randrange(far)
        rows.append((rng.choice("ab") if i % 50 else None, s if i % 41 else None, s + rng.choice([0, -3, rng.randrange(most), most]), None if i % 60 == 7 else name(i)))
    return rows + rows[:5]


def overlapping(a, b):
    whole = lambda rows: [r for r in rows if None not in r[:3]]
    return sorted(((i, j) for c, s, e, i in whole(a) for d, t, f, j in whole(b) if c == d and s < f and t < e), key=str)


@pytest.mark.parametrize("far,most", [(300, 40), (60, 90), (10**6, 5000)])
def test_overlap_pairs(spark, far, most):
    rng = random.Random(far)
    a, b = some_ranges(rng, 300, most, far), some_ranges(rng, 200, most * 2, far, int)
    left, right = spark.createDataFrame(a, "chrom string, start int, end int, x string"), spark.createDataFrame(b, "chrom string, r_start long, r_end long, y long")
    got = N.overlap_pairs(left, right, "x", "y")
    assert got.dtypes == [("x", "string"), ("y", "bigint")]
    want = overlapping(a, b)
    assert want and sorted(map(tuple, got.collect()), key=str) == want
    assert N.overlap_pairs(left.where("false"), right, "x", "y").count() == N.overlap_pairs(left, right.where("false"), "x", "y").count() == 0
    sure = right.withColumn("y", F.lit(3))  # a key that is never null
    assert N.overlap_pairs(left, sure, "x", "y").count() == len(want)


def test_tiles_hold_bins_cut_anywhere(monkeypatch):
    rng = random.Random(3)
    a, b = ([r for r in some_ranges(rng, n, most, 200, int) if None not in r[:3]] for n, most in ((250, 30), (150, 70)))
    size = 32
    bins = lambda s, e: range(s // size, max(e - 1, s) // size + 1)
    rows = sorted([(c, k, is_left, s, e, i, s // size == k) for is_left, side in ((True, a), (False, b)) for c, s, e, i in side for k in bins(s, e)], key=lambda r: r[:5])
    table = pa.table({
        **{n: [r[at] for r in rows] for at, n in enumerate(("chrom", "_bin", "_left", "start", "end"))},
        "x": pa.array([r[5] if r[2] else None for r in rows], pa.int64()), "y": pa.array([None if r[2] else r[5] for r in rows], pa.int64()), "_here": [r[6] for r in rows],
    })
    for tile, strip, full, most in ((128, 1 << 10, 1 << 16, 10000), (4, 3, 5, 7), (1, 1, 1, 1), (5, 2, 50, 64)):
        for name, n in (("TILE", tile), ("STRIP", strip), ("FULL", full)):
            monkeypatch.setattr(N, name, n)
        made = [*N._pairs(iter(table.to_batches(max_chunksize=most)), "x", "y")]
        assert sorted(((r["x"], y) for batch in made for r in batch.to_pylist() for y in r["y"]), key=str) == overlapping(a, b)
        assert all(sum(map(len, batch["y"].to_pylist())) < full + tile * strip for batch in made)  # what is held does not follow the bin


def test_deep_pairs_are_written_in_few_bytes(spark, tmp_path):
    rng, at = random.Random(4), lambda times, start: start * pow(times, -1, 400000) % 400000
    make = lambda n, times: [at(times, rng.randrange(500)) + 400000 * k for k in range(n)]
    orders = [(k, rng.randrange(10**6)) for k in make(10000, 53)]
    part = [(k, rng.randrange(1, 51)) for k in make(6000, 197)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(part, "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    contract.interval_join(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    for t in ("orders", "part", "out"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}{'' if t == 'out' else '.parquet'}/*.parquet')")
    want = f"({contract.ORACLES['interval_join']})"
    n = con.execute("select count(*) from out").fetchone()[0]
    assert n > 10**6 and con.execute(f"select count(*) from {want}").fetchone() == (n,)
    assert con.execute(f"select count(*) from (select a_id, b_id from out except all select a_id, b_id from {want})").fetchone() == (0,)
    written = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    assert written < n / 2  # a byte a pair before pairs lay in tiles
