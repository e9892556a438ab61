"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct word shingles. PERMS minima are taken of it;
BANDS hashes of ROWS minima each put documents into buckets, and of the minima only
the low BITS bits are kept, packed into longs. A pair from a bucket is estimated by
counting equal low bits, corrected for chance agreement (2**-BITS), and pairs whose
estimate is far below the threshold are dropped: DOUBT is over four standard errors.
What stays is confirmed on the full sets, as 64-bit hashes of all shingles, by
100 * intersection >= 80 * union.

A pair of similarity 0.8 shares no bucket with probability (1 - 0.8**4)**32 < 5e-8.

Groups: documents of equal sets are one class and stand in by its smallest doc_id, so
copies never make pairs. Links inside a component that is already known add nothing,
so a bucket is not expanded into all pairs: it proposes one pair for each member with
its smallest document, which settles buckets of two. Components are contracted, and for
larger buckets whose members still differ in component an exact join by prefixes finds
every link between documents of different components: no candidate is left out.

Defined results: null texts, and texts without words, have an empty set, n_shingles 0,
and stay by themselves; one word is one shingle. Rows without a doc_id have no
component (null) and are kept. Rows that repeat a doc_id are one document as far as
components go: each of their texts is compared, and sets whose smallest doc_id is the
same are in one component. row_verdicts decides for each text alone. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SpanHash, bounded_batches, mix64, pieces, stored, text_view, word_spans
from tidemark.llm.components import contract, merge

PERMS, BANDS, BITS = 128, 32, 4
ROWS = PERMS // BANDS
#: Candidates whose estimated similarity is under threshold - DOUBT are dropped.
DOUBT = 0.18
CHUNK = 1 << 19
_rng = np.random.default_rng(20240501)
_MUL = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, A-Z lower-cased."""
    raw, offsets = text_view(column)
    for i, j in pieces(offsets, CHUNK):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        starts, ends, _ = word_spans(part, at)
        h = SpanHash(part)(starts, ends) if len(starts) else np.zeros(0, np.uint64)
        edge = np.searchsorted(starts, at)
        for k in range(j - i):
            w = h[edge[k] : edge[k + 1]]
            n = min(width, len(w))
            s = np.full(max(0, len(w) - n + 1) if n else 0, n, np.uint64)
            for d in range(n):
                s = mix64(s + w[d : len(w) - n + 1 + d])
            yield np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """The minimum of each permutation over a set of shingle hashes."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 512):
        out = np.minimum(out, (h[i : i + 512, None] * _MUL + _ADD).min(0))
    return out


def _describe(width: int):
    shifts = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, bands, packed = [], [], [], []
            for s in shingle_sets(b.column("text"), width):
                n.append(len(s))
                if not len(s):
                    keys.append((None, None)), bands.append([]), packed.append([])
                    continue
                keys.append((int(s.sum().view(np.int64)), int(np.bitwise_xor.reduce(mix64(s)).view(np.int64))))
                sig = signature(s)
                rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
                h = np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
                bands.append(h.view(np.int64))
                low = (sig & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
                packed.append((low << shifts).sum(1, dtype=np.uint64).view(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (bands, packed)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)), *lists], ["doc_id", "n_shingles", "k1", "k2", "bands", "sig"])

    return run


def _sets(width: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            some = np.flatnonzero(_in_filter(bits, ids))
            for i in range(0, len(some), 512):
                part = b.take(pa.array(some[i : i + 512]))
                sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), width)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return run


#: Bits of the filter that picks the documents whose sets are wanted: 4 MB whatever
#: the corpus. More documents only let more through that nobody asked for.
FILTER_BITS = 25


def _slots(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(ids.astype(np.int64).view(np.uint64))
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), ((h << np.uint64(FILTER_BITS)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _in_filter(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    a, b = _slots(ids)
    return (bits[a >> 3] >> (a & 7) & 1).astype(bool) & (bits[b >> 3] >> (b & 7) & 1).astype(bool)


def _filter_of(spark: SparkSession, ids: DataFrame):
    """A Bloom filter of fixed size over a column of ids, made from its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
        for b in batches:
            for slots in _slots(b.column(0).to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(table, slots >> 5, np.uint32(1) << (slots & 31).astype(np.uint32))
        words = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(table[words].astype(np.int64))], ["word", "mask"])

    table = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for part in ids.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
        table[part.column(0).to_numpy()] = part.column(1).to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(table.view(np.uint8))


def estimate(a: Column | str, b: Column | str) -> Column:
    """Similarity from packed low bits: the share of equal values, less what chance gives."""
    ones = F.lit(sum(1 << (BITS * i) for i in range(64 // BITS)))
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    unequal = F.lit(0)
    for i in range(PERMS * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        unequal = unequal + F.bit_count(folded.bitwiseAND(ones))
    chance = 2.0**-BITS
    return ((1 - unequal / PERMS) - chance) / (1 - chance)


def _shingles(spark: SparkSession, docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id and shingles (hashes of its full set) of the documents in ids (doc_id)."""
    wanted = _filter_of(spark, ids)
    sets = docs.filter(F.col("doc_id").isNotNull()).mapInArrow(_sets(width, wanted), "doc_id long, shingles array<long>")
    sets = stored(sets.join(ids, "doc_id", "left_semi"), "shingle-sets")
    wanted.destroy()
    return sets


def _confirmed(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) that are links. Sizes and the b-bit estimate decide first. sets:
    the documents' shingles, if they are at hand."""
    left, right = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}")) for c in "ab")
    near = pairs.join(left, "a").join(right, "b")
    near = near.filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate("sa", "sb") >= percent / 100 - DOUBT)).select("a", "b", "na", "nb")
    near = stored(near, "candidates", slim=True)
    if sets is None:
        ids = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
        sets = _shingles(spark, docs, ids, width)
    sa, sb = (sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    found = near.join(sb, "b").join(sa, "a").withColumn("both", both)
    return stored(found.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"), "links", slim=True)


def text_tie(text: Column) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeats_ids(docs: DataFrame) -> bool:
    return not docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").isEmpty()


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    if not repeats_ids(docs):
        found = _components(spark, docs, width, percent).drop("k1", "k2")
    else:
        found = _by_doc_id(spark, docs, width, percent)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def row_verdicts(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, tie (text_tie) and kept of every text that has a doc_id, each judged by
    itself: of a component the text of the smallest doc_id, then tie, is kept."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter(F.col("doc_id").isNotNull())
    texts = _texts(spark, docs, width, percent)
    first = texts.groupBy("component").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    return texts.join(first, "component").select("doc_id", "tie", (F.struct("doc_id", "tie") == F.col("first")).alias("kept"))


def _texts(spark: SparkSession, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, tie, n_shingles, k1, k2, component of every different text of every doc_id;
    texts are numbered, and a component is the smallest number of its texts."""
    one = docs.withColumn("tie", text_tie(F.col("text"))).dropDuplicates(["doc_id", "tie"])
    one = stored(one.withColumn("id", F.monotonically_increasing_id()), "minhash-texts")
    found = _components(spark, one.select(F.col("id").alias("doc_id"), "text"), width, percent)
    found = found.select(F.col("doc_id").alias("id"), "n_shingles", "k1", "k2", F.col("component_id").alias("component"))
    return stored(one.select("id", "doc_id", "tie").join(found, "id").drop("id"), "minhash-verdicts")


def _by_doc_id(spark: SparkSession, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """near_duplicates, without kept, where several rows have one doc_id."""
    named = docs.filter(F.col("doc_id").isNotNull())
    texts = _texts(spark, named, width, percent)
    # A set stands for its smallest doc_id; components that share one become one.
    sets = texts.filter("n_shingles > 0").groupBy("k1", "k2", "component").agg(F.min("doc_id").alias("stands"))
    low = sets.groupBy("stands").agg(F.min("component").alias("a"), F.max("component").alias("_b")).filter("a < _b").drop("_b")
    joined = contract(sets.join(low, "stands").select("a", F.col("component").alias("b")))
    if joined is not None:
        texts = texts.join(joined.withColumnRenamed("vertex", "component"), "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root")
    ids = texts.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    texts = texts.join(ids, "component").select("doc_id", "tie", "n_shingles", "component_id")
    out = named.withColumn("tie", text_tie(F.col("text"))).select("doc_id", "tie").join(texts, ["doc_id", "tie"]).drop("tie")
    nulls = docs.filter(F.col("doc_id").isNull())
    return out.unionByName(_components(spark, nulls, width, percent).drop("k1", "k2"))


def _components(spark: SparkSession, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2, component_id for every row of docs, whose ids differ or
    are null."""
    bounded_batches(spark)
    rows = stored(docs.mapInArrow(_describe(width), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sig array<long>"), "minhash-rows")
    known = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).select("node", "copies")
    nodes = known.join(classes, known["doc_id"] == classes["node"]).select("node", "copies", F.col("n_shingles").alias("n"), "k1", "k2", "bands", "sig")
    nodes = stored(nodes, "minhash-nodes")
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("many")).filter("many > 1")
    # A table of its own, so that Spark can split a join with a bucket that many share.
    shared = stored(shared, "shared-buckets", slim=True)
    members = stored(entries.join(shared, "bucket"), "bucket-members")
    pairs = members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    roots = contract(_confirmed(spark, docs, nodes, pairs, width, percent), ready=True)
    open_ = _open(members.filter("many > 2").select("bucket", "node"), roots)
    pairs, sets = _across(spark, docs, open_, width, percent)
    links = _confirmed(spark, docs, nodes, pairs, width, percent, sets)
    roots = merge(roots, contract(_edges_of_roots(links, roots)))
    return _result(rows, nodes.select("k1", "k2", "node", "copies"), roots)


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """node and root of the documents in buckets whose members differ in component."""
    if roots is None:
        labelled = members.withColumn("root", F.col("node"))
    else:
        own = roots.select(F.col("vertex").alias("node"), "root")
        labelled = members.join(own, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    labelled = stored(labelled, "labelled-members", slim=True)
    span = labelled.groupBy("bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo < _hi").select("bucket")
    span = stored(span, "open-buckets", slim=True)
    return stored(labelled.join(span, "bucket").groupBy("node").agg(F.min("root").alias("root")), "open-documents", slim=True)


def _edges_of_roots(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return links
    for c in "ab":
        own = roots.select(F.col("vertex").alias(c), F.col("root").alias("_r"))
        links = links.join(own, c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    return links.select("a", "b")


def _across(spark: SparkSession, docs: DataFrame, open_: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of open documents (node, root) in different components that may be links:
    none that is one is left out. Also the documents' shingles.

    The shingles of each document are put in one order, the rarest among these documents
    first. Of two linked documents the first shingle they share, in that order, comes early
    in both: from its place on, each must have room for the whole intersection. So only the
    first fifth of each is joined, on equal shingles, under that bound. Members of a group
    of copies whose own edits are too many meet only those with whom they share edits, not
    the whole group."""
    own = open_.withColumnRenamed("node", "doc_id")
    sets = _shingles(spark, docs, own.select("doc_id"), width)
    tokens = sets.select("doc_id", F.explode("shingles").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("df"))
    ordered = tokens.join(often, "t").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("all"))
    n = F.size("all")
    ordered = ordered.join(own, "doc_id").select("doc_id", "root", n.alias("n"), F.slice("all", F.lit(1), (n - F.ceil(n * F.lit(percent) / 100) + 1).cast("int")).alias("head"))
    rows = stored(ordered.select("doc_id", "root", "n", F.posexplode("head").alias("p", "s")).select("doc_id", "root", "n", "p", "s.t", "s.df").filter("df > 1").drop("df"), "open-prefixes")
    x, y = (rows.select("t", *(F.col(c).alias(f"{k}_{c}") for c in ("doc_id", "root", "n", "p"))) for k in "xy")
    room = F.least(F.col("x_n") - F.col("x_p"), F.col("y_n") - F.col("y_p"))
    fits = (100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")) & ((100 + percent) * room >= percent * (F.col("x_n") + F.col("y_n")))
    on = (x["t"] == y["t"]) & (F.col("x_doc_id") < F.col("y_doc_id")) & (F.col("x_root") != F.col("y_root")) & fits
    return x.join(y, on).select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).distinct(), sets


def _result(rows: DataFrame, classes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Only classes of several rows, or linked to others, have to reach the rows."""
    if roots is not None:
        classes = classes.join(roots.select(F.col("vertex").alias("node"), "root"), "node", "left")
    else:
        classes = classes.withColumn("root", F.lit(None).cast("long"))
    moved = classes.filter(F.col("root").isNotNull() | (F.col("copies") > 1)).select("k1", "k2", F.coalesce("root", "node").alias("root"))
    out = rows.select("doc_id", "n_shingles", "k1", "k2").join(moved, ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", "k1", "k2", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, percent=80)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
c AS (
  SELECT min(doc_id) AS node, k AS s, len(k) AS n FROM (SELECT doc_id, list_sort(s) AS k FROM s) WHERE len(k) > 0 GROUP BY k),
u AS (
  SELECT node, n, unnest(s) AS g FROM c),
p AS (
  SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (
  SELECT node, node AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a WHERE r.root < e.b),
roots AS (
  SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(roots.root, s.doc_id) AS component_id, coalesce(roots.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN roots ON roots.node = c.node
"""
