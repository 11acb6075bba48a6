"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the entities of four fixed forms (e-mail, IP address, payment card, phone).  The words before them are
lexical patterns.  Other identifier-like tokens (a digit in a run of eight signs or more) are candidate instances.
Patterns and instances form a graph; in each round a pattern's confidence is the mean of its instances', and a
candidate's is the damped noisy-or of its patterns'.  Candidates after patterns of high confidence and support
are found as spans of kind ``id``.

Null text counts as empty.  Rows with equal doc_id and text have equal results each.  An empty table gives an
empty result.  Other columns are ignored.  Spans are in code points, end exclusive.

The expressions are the contract's, written so that a Java regular expression neither recurses nor tries a run of
signs again from its middle: possessive groups, and a start only where a run starts or the last match ended.  Only
``id`` gives signs back, from the end of its run to the last letter or digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwise.llm.common import documents, stored

KINDS = ("email", "ip", "card", "phone", "id")
_WORD = "A-Za-z0-9._%+-"  # last in a class: its hyphen is a sign, not a range
FORMS = {
    "email": rf"(?:(?<![{_WORD}])|\G)[{_WORD}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": rf"(?<![@/{_WORD}])(?=[A-Za-z._%+@/-]*+[0-9])[@/{_WORD}]{{6,}}[A-Za-z0-9]",
}
#: A sign that every match of a form holds; texts without it are not searched.
_SIGN = {"email": "@", "ip": ".", "phone": "+"}
#: Rounds over the graph, the damping of a candidate's confidence, and what makes a pattern trusted.
ROUNDS, DAMPING, CONFIDENT, SUPPORT = 3, 0.5, 0.6, 3


def matches(text: Column, kind: str) -> Column:
    """Array of (gap, many, value, before): the length of the text since the last match, the match and the words before it."""
    form = F.lit(FORMS[kind])
    if kind == "email" or kind == "ip" or kind == "phone":
        searched = F.when(F.contains(text, F.lit(_SIGN[kind])), text)
    else:
        searched = F.when(F.rlike(text, F.lit("[0-9]")), text)
    found = F.regexp_extract_all(searched, form, F.lit(0))
    gaps = F.slice(F.split(searched, FORMS[kind], -1), F.lit(1), F.size(found))
    made = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("many"), m.alias("value"), F.right(g, F.lit(60)).alias("before")))
    return F.when(F.size(found) > 0, made)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.when(d.cast("int") > 4, 1).otherwise(0))),
        F.lit(0),
        lambda a, d: a + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    octets = F.forall(F.split(value, r"\."), lambda p: F.rlike(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    return (
        F.when(kind == "ip", octets)
        .when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(True)
    )


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, hash, kind, start, end, value, before of base spans and of candidates that touch none."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), *[matches(text, k).alias(k) for k in KINDS])
    rows = rows.where(" or ".join(f"{k} is not null" for k in KINDS))
    rows = stored(rows, "matches").dropDuplicates(["doc_id", "hash"])
    parts = [rows.where(F.col(k).isNotNull()).select("doc_id", "hash", F.lit(k).alias("kind"), F.posexplode(k).alias("i", "m")) for k in KINDS]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    line = W.partitionBy("doc_id", "hash", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    placed = all_.withColumn("end", F.sum(F.col("m.gap") + F.col("m.many")).over(line))
    placed = placed.select("doc_id", "hash", "kind", (F.col("end") - F.col("m.many")).alias("start"), "end", F.col("m.value").alias("value"), F.col("m.before").alias("before"))
    placed = placed.where(valid(F.col("kind"), F.col("value")))
    order = W.partitionBy("doc_id", "hash").orderBy("start", "end", "kind")
    base = F.col("kind") != "id"
    reach = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    coming = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, W.unboundedFollowing))
    free = (F.coalesce(reach, F.lit(-1)) <= F.col("start")) & F.coalesce(coming >= F.col("end"), F.lit(True))
    return placed.withColumn("free", free).where((F.col("kind") != "id") | F.col("free")).drop("free")


def pattern(before: Column) -> Column:
    """The last word before an entity, and the signs between."""
    return F.regexp_extract(F.lower(before), r"(\p{L}{1,40}[^\p{L}]{0,8})$", 1)


def confident_patterns(spans: DataFrame) -> DataFrame:
    """pattern, confidence, support of trusted patterns, after ROUNDS rounds over the pattern-instance graph.

    A pattern's support is the number of its instances that the round before left confident, seeds or not.
    """
    edges = spans.select(pattern(F.col("before")).alias("pattern"), F.xxhash64("value").alias("instance"), (F.col("kind") != "id").cast("double").alias("seed"))
    edges = stored(edges.where("pattern <> ''").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph")
    known = edges.groupBy("instance").agg(F.max("seed").alias("confidence"))
    scored = None
    for r in range(ROUNDS):
        scored = edges.join(known, "instance").groupBy("pattern").agg(F.avg("confidence").alias("confidence"), F.count_if(F.col("confidence") >= CONFIDENT).alias("support"))
        scored = stored(scored.where(F.col("support") >= SUPPORT), f"patterns{r}")
        if r + 1 < ROUNDS:
            votes = edges.join(scored.select("pattern", F.col("confidence").alias("p")), "pattern", "left")
            known = votes.groupBy("instance").agg(F.max("seed").alias("seed"), F.sum(F.log1p(-F.least(F.coalesce("p", F.lit(0.0)) * DAMPING, F.lit(0.99)))).alias("doubt"))
            known = known.select("instance", F.when(F.col("seed") > 0, F.lit(1.0)).otherwise(1 - F.exp("doubt")).alias("confidence"))
    return scored.where(F.col("confidence") >= CONFIDENT)


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, hash, kind, start, end: base spans and what trusted patterns discover."""
    spans = stored(found_spans(docs), "spans")
    trusted = confident_patterns(spans).select("pattern")
    more = spans.where("kind = 'id'").withColumn("pattern", pattern(F.col("before"))).join(trusted, "pattern", "left_semi")
    columns = ["doc_id", "hash", "kind", "start", "end"]
    return spans.where("kind <> 'id'").select(*columns).unionByName(more.select(*columns))


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_lists(docs: DataFrame) -> DataFrame:
    """doc_id, hash, spans (array of no, kind, start, end in order) for documents that have any."""
    no = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return personal_spans(docs).groupBy("doc_id", "hash").agg(F.sort_array(F.collect_list(F.struct(no.alias("no"), "start", "end", "kind"))).alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    lists = span_lists(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    on = rows["doc_id"].eqNullSafe(lists["doc_id"]) & (rows["hash"] == lists["hash"])
    spans = F.coalesce(lists["spans"], F.array().cast("array<struct<no:bigint,start:bigint,end:bigint,kind:string>>"))
    base = F.filter(spans, lambda s: s["kind"] != "id")
    counts = [F.size(F.filter(spans, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return rows.join(lists, on, "left").select(rows["doc_id"], *counts, F.sha2(_listing(base).cast("binary"), 256).alias("base_sha256"), _listing(spans).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; a span that begins inside another adds nothing of its own."""
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))  # names cannot clash
    before = W.partitionBy("doc_id", "hash").orderBy("start", "end", "kind").rowsBetween(W.unboundedPreceding, -1)
    spans = personal_spans(docs.select("doc_id", "text")).withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    lists = spans.groupBy(F.col("doc_id").alias("id"), F.col("hash").alias("of")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "kind", "reach"))).alias("spans"), F.max("end").alias("last")
    )
    joined = rows.join(lists, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of")), "left")
    cut = F.expr(
        "concat(array_join(transform(spans, s -> if(s.start >= s.reach, concat(substring(row.text, int(s.reach + 1), int(s.start - s.reach)), '[', s.kind, ']'), '')), ''),"
        " substring(row.text, int(last + 1)))"
    )
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(cut)
    return joined.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in columns])


def op7_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(documents(spark, sf_dir))
