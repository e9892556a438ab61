"""Mixing sources to target weights with a low-discrepancy schedule.

A mix is K = 2**k slots of equal token count. The van der Corput point of a slot
(its number with the bits reversed) falls into one source's share of the
cumulative targets, so every stretch of the schedule has every source near its
weight. The slots of a source are ranked, and its r-th slot takes the r-th
equal-token block of the source's documents in shuffled order, laid end to end
and read up to `MAX_REPEATS` times. K is at most 2**20 whatever the corpus; the
blocks grow instead. So that targets are met to the word, a block is cut where its
target ends, and what a source's blocks leave goes to one more slot of its own after
the K; with whole_slots, the mix meets a target to within a block only.

Nothing gathers a source in one task: places in a source's shuffled stream come
from prefix sums in two levels (hash buckets, then rows of one bucket), and
slots are ranked likewise by stretches of the schedule.

Defined results: null or empty texts have size 0 and are never taken; the null
source comes last; a mix without any word takes nothing; repeated rows are
separate documents with neighbouring places; a null doc_id shuffles as the empty
key. Only the columns named are read, others cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, stored

MAX_SLOTS_LOG2 = 20
MAX_REPEATS = 3
#: Documents to a hash bucket, and the most buckets a source is dealt into.
BUCKET_ROWS, MAX_BUCKETS = 400, 65536
#: Slots to a stretch of the schedule.
STRETCH = 4096


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words of the whole text), with the shuffling key."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"))


def source_targets(sizes: DataFrame, weights: Column | None = None) -> DataFrame:
    """One row per source: source_id (its place by code point, null last), w,
    source_size and target.

    Targets share all words by weight; a source stops at MAX_REPEATS times its size
    and the excess is shared again. That fixed point is target = least(cap, level * w)
    for one level: sources in order of cap / w are capped until the level that the
    others would get no longer exceeds their own cap. weights may give another
    expression over source_id."""
    src = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("source_id", F.row_number().over(by_name) - 1)
    src = src.withColumn("w", (weights if weights is not None else F.col("source_id") % 3 + 1).cast("long"))
    cap = F.col("source_size") * MAX_REPEATS
    src = src.withColumn("cap", cap).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    order = Window.orderBy("ratio", "source_id")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("total", F.sum("source_size").over(whole))
    src = src.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("w").over(rest))
    src = src.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_id", "level"))).over(whole)["level"])
    return src.select("source", "source_id", "w", "source_size", "total", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def slots_log2(total: int) -> int:
    return min(MAX_SLOTS_LOG2, int(math.log2(max(total, 1))))


def shares(targets: DataFrame, k: int) -> DataFrame:
    """Adds slot_lo and slot_hi: the points, in units of 2**-k, that are the source's."""
    whole = F.floor("target").cast("long")
    order = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = targets.withColumn("_hi", F.sum(whole).over(order)).withColumn("_all", F.greatest(F.sum(whole).over(every), F.lit(1)))
    at = lambda c: F.floor(c.cast("double") / F.col("_all") * float(1 << k)).cast("long")
    return df.withColumn("slot_lo", at(F.col("_hi") - whole)).withColumn("slot_hi", at(F.col("_hi"))).drop("_hi", "_all")


def schedule(spark: SparkSession, targets: DataFrame, k: int) -> DataFrame:
    """slot, source_id and rank (the slot's place among those of its source)."""
    step = F.explode(F.sequence(F.col("slot_lo"), F.col("slot_hi") - 1, F.lit(STRETCH).cast("long")))
    runs = targets.filter("slot_hi > slot_lo").select("source_id", "slot_hi", step.alias("at")).repartition(spark.sparkContext.defaultParallelism, "source_id", "at")
    point = F.explode(F.sequence("at", F.least(F.col("at") + STRETCH, F.col("slot_hi")) - 1))
    points = runs.select("source_id", point.alias("point"))
    slot = F.conv(F.reverse(F.lpad(F.bin("point"), k, "0")), 2, 10).cast("long") if k else F.col("point")
    slots = points.select("source_id", slot.alias("slot")).withColumn("stretch", F.floor(F.col("slot") / STRETCH))
    ahead = Window.partitionBy("source_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = slots.groupBy("source_id", "stretch").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inside = Window.partitionBy("source_id", "stretch").orderBy("slot")
    ranked = slots.withColumn("_rn", F.row_number().over(inside) - 1).join(base, ["source_id", "stretch"])
    return ranked.select("slot", "source_id", (F.col("base") + F.col("_rn")).alias("rank"))


def streams(sizes: DataFrame, targets: DataFrame, buckets: int) -> DataFrame:
    """Every document with `at`, the words before it in its source's shuffled order."""
    sizes = sizes.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * buckets / 65536).cast("int"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    base = base.join(targets, same(base, targets, "source")).drop(targets["source"]).drop("n")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    rows = sizes.withColumn("_in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("_rn", F.row_number().over(inside))
    out = rows.join(base, same(rows, base, "source", "bucket"))
    return out.select("doc_id", rows["source"], "size", rows["bucket"], "_rn", "source_id", "source_size", "target", "total", (F.col("base") + F.col("_in")).alias("at"), "slot_lo", "slot_hi")


def block_pieces(docs: DataFrame, k: int, exact: bool = False) -> DataFrame:
    """Each document's words in each equal-token block of its source's stream, by
    pass; documents without any keep one row without a block. exact: up to the whole
    words of the target, with a last block (rank: the source's slots) for what is over."""
    length = F.col("total").cast("double") / float(1 << k)
    edge = lambda r: F.floor(r.cast("double") * length).cast("long")
    n = F.col("slot_hi") - F.col("slot_lo")
    stop = F.floor("target").cast("long") if exact else edge(n)
    last_rank = n if exact else n - 1
    docs = docs.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1)))).withColumn("start", F.col("pass") * F.col("source_size") + F.col("at"))
    docs = docs.filter((F.col("pass") == 0) | (F.col("start") < stop))
    first, last = F.greatest(F.least(F.floor(F.col("start") / length) - 1, n), F.lit(0)), F.least(F.floor((F.col("start") + F.col("size")) / length) + 1, last_rank)
    some = F.when((F.col("size") > 0) & (last_rank >= 0) & (first <= last), F.sequence(first.cast("long"), last.cast("long")))
    docs = docs.withColumn("rank", F.explode_outer(some))
    end = F.when(F.col("rank") >= n, stop).otherwise(F.least(edge(F.col("rank") + 1), stop))
    words = F.least(F.col("start") + F.col("size"), end) - F.greatest("start", edge(F.col("rank")))
    return docs.withColumn("words", F.greatest(words, F.lit(0))).filter((F.col("words") > 0) | (F.col("pass") == 0))


def _streams(sizes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The documents in their sources' streams, the targets, and the log2 of the slots."""
    rows, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    k = slots_log2(int(total))
    targets = stored(shares(source_targets(sizes), k), "mix-targets")
    return streams(sizes, targets, max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))), targets, k


def _mixed(spark: SparkSession, docs: DataFrame, exact: bool) -> tuple[DataFrame, list[str]]:
    """Every document's words by pass and block, with the block's slot; and the columns
    that tell documents apart."""
    placed, targets, k = _streams(stored(sized(docs), "mix-sizes"))
    slots = schedule(spark, targets, k)
    if exact:
        slots = slots.unionByName(targets.select((F.lit(1 << k) + F.col("source_id")).cast("long").alias("slot"), "source_id", (F.col("slot_hi") - F.col("slot_lo")).alias("rank")))
    # As large as the schedule, which no statistics tell Spark: not to be broadcast.
    found = block_pieces(placed, k, exact).join(slots.hint("merge"), ["source_id", "rank"], "left")
    taken = F.when(F.col("slot").isNotNull(), F.col("words")).otherwise(0)
    found = found.withColumn("words", taken).withColumn("slot", F.when(F.col("words") > 0, F.col("slot")))
    return found, ["doc_id", "source", "size", "source_id", "bucket", "_rn", "source_size", "target"]


def _taken(found: DataFrame, by: list[str]) -> DataFrame:
    out = found.groupBy(*by).agg(F.sum("words").cast("long").alias("taken"), F.coalesce(F.min("slot"), F.lit(-1)).cast("long").alias("first_slot"), F.count("slot").alias("slots"))
    return out.drop("source_id", "bucket", "_rn")


def passes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, source, size, pass, taken, first_slot: mix, pass by pass over the stream;
    passes that take nothing are left out. Sorted by first_slot this is the mix."""
    found, by = _mixed(spark, docs, True)
    return _taken(found.filter("words > 0"), [*by, "pass"]).select("doc_id", "source", "size", "pass", "taken", "first_slot")


def mix(spark: SparkSession, docs: DataFrame, whole_slots: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes of the
    document), first_slot (its first place in the schedule, -1 if none) and slots (how
    many places it has a part of). Of each source exactly floor(target) words are taken;
    whole_slots: as many as its slots hold, which may miss the target by a slot."""
    return _taken(*_mixed(spark, docs, not whole_slots))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(spark, docs, whole_slots=True).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


#: States the same mix in closed form: a source's slots take as many words from the
#: start of its shuffled stream, in as many passes as they need.
OP8_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS source_id FROM src),
r AS (
  SELECT *, source_id % 3 + 1 AS w, {MAX_REPEATS} * source_size AS cap FROM w),
l AS (
  SELECT *, cap::DOUBLE / w AS ratio, sum(source_size) OVER ()::BIGINT AS total,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT::DOUBLE
         / (sum(w) OVER (ORDER BY cap::DOUBLE / w, source_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM r),
t AS (
  SELECT source, source_id, source_size, total, least(cap::DOUBLE, w * (SELECT arg_min(level, (ratio, source_id)) FROM l WHERE level <= ratio)) AS target FROM l),
k AS (
  SELECT least({MAX_SLOTS_LOG2}, floor(log2(greatest(max(total), 1)))::INT) AS k, greatest(1, sum(floor(target)::BIGINT))::BIGINT AS whole FROM t),
n AS (
  SELECT t.*, sum(floor(target)::BIGINT) OVER (ORDER BY source_id)::BIGINT AS hi, floor(target)::BIGINT AS own, k, whole FROM t, k),
slots AS (
  SELECT *, floor(hi::DOUBLE / whole * (1 << k))::BIGINT - floor((hi - own)::DOUBLE / whole * (1 << k))::BIGINT AS slots FROM n),
most AS (
  SELECT *, least(floor(slots::DOUBLE * (total::DOUBLE / (1 << k)))::BIGINT, {MAX_REPEATS} * source_size) AS words FROM slots),
placed AS (
  SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS ahead FROM sizes),
points AS (
  SELECT i AS point, CASE WHEN k = 0 THEN 0 ELSE reverse(lpad(bin(i), k, '0'))::BIT::BIGINT END AS slot FROM k, unnest(range(0, 1 << k)) AS u(i)),
edges AS (
  SELECT source_id, slot, row_number() OVER (PARTITION BY source_id ORDER BY slot) - 1 AS rank, total, n.k FROM points
  JOIN n ON point >= floor((hi - own)::DOUBLE / whole * (1 << n.k)) AND point < floor(hi::DOUBLE / whole * (1 << n.k))),
starts AS (
  SELECT source_id, slot, floor(rank::DOUBLE * (total::DOUBLE / (1 << k)))::BIGINT AS lo FROM edges),
result AS (
  SELECT doc_id, size, source_size, target, source_id, ahead,
         (CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(size, words % source_size - ahead)) END)::BIGINT AS taken
  FROM placed JOIN most ON placed.source IS NOT DISTINCT FROM most.source)
SELECT doc_id, size, source_size, target, taken, (CASE WHEN taken > 0 THEN slot ELSE -1 END)::BIGINT AS first_slot
FROM result ASOF LEFT JOIN starts ON result.source_id = starts.source_id AND result.ahead >= starts.lo
"""
