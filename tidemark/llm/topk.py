"""Exact top-k search by inner product, with a three-phase uniform threshold.

The dimensions of a vector are cut into BLOCKS lists, each of which can score a
candidate in part; a candidate's score is the sum over the lists. Per block of
queries:

1. every partition sends, for each query and list, its k best candidates there,
   with their whole scores. The k-th best whole score seen bounds the k-th best
   of all from below;
2. that bound over BLOCKS is the uniform cutoff. A candidate that stays under it
   in every list has a whole score under the bound, so no such candidate can be
   among the k best; every list sends all entries at or above its cutoff;
3. the whole scores of those entries are resolved exactly, those under the bound
   are dropped, and the k best stay.

Queries come in blocks of QUERY_BLOCK rows, so what is broadcast has a fixed size
(QUERY_BLOCK * dimensions * 8 bytes) whatever the table; what the first phase
sends is cut to k rows a query and list in each partition. With fewer than k
candidates seen there is no bound and every candidate is sent.

Defined results: scores are integers (components become floor(1024 * x)), exact for
components of any size: where products could leave the integers that a float holds,
scores are computed in whole numbers without a bound. A score beyond 64 bits is returned
as the nearest long, and such scores tie. Ties go to the smaller vec_id. Vectors that are
null, empty, or hold null or non-finite components (1024 * x included) take no part, nor
do rows without a vec_id. Vectors of another length
than the query's are not its candidates. A row is "the query's own" by vec_id, so
repeated rows of one vec_id are not each other's candidates; a repeated query is
answered once (its smallest vector), and repeated candidate rows each count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, stored

BLOCKS = 4
QUERY_BLOCK = 1024
SCALE = 1024
#: Candidate rows scored at once: bounds a task's score matrix.
ROWS = 256
#: Below it floats hold all whole numbers, and sums in any order are exact.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v (whole numbers, as doubles) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)

    def whole(x):  # floats from 2**53 on are whole already, and may not fit a long
        y = x.cast("double") * scale
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    return rows.select("vec_id", F.transform("embedding", whole).alias("v"))


def _lists(ids: np.ndarray, m: np.ndarray, block: tuple[np.ndarray, np.ndarray], cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of rows: its start, the scores by list (list, row, query) and whether
    a candidate is not the query's own. Scores are floats, or Python's integers for rows
    whose products floats would round."""
    qid, q = block
    most = np.abs(q).max() * q.shape[1]
    large = np.abs(m).max(1) * most >= EXACT
    for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
        for i in range(0, len(rows), ROWS):
            at = rows[i : i + ROWS]
            x, y = m[at], q
            if large[at[0]]:
                x, y = (np.array([[int(c) for c in r] for r in z.tolist()], object) for z in (x, y))
            part = np.stack([x[:, a:b] @ y[:, a:b].T for a, b in zip(cuts, cuts[1:], strict=False)])
            yield at, part, ids[at, None] != qid[None, :]


def _longs(whole: np.ndarray) -> np.ndarray:
    """Whole scores as longs; beyond 64 bits the nearest."""
    if whole.dtype == object:
        return np.array([min(max(int(x), LEAST), MOST) for x in whole.ravel()], np.int64).reshape(whole.shape)
    return whole.astype(np.int64)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """vec_ids and a float matrix of whole numbers per length of vector."""
    for b in batches:
        v = b.column("v")
        flat, lengths = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
        ids, start = b.column("vec_id").to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            yield ids[rows], flat[start[rows, None] + np.arange(d)].astype(np.float64)


def _cuts(d: int) -> np.ndarray:
    return np.linspace(0, d, BLOCKS + 1).astype(int)


def _first(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list] = {}  # (length, list): scores in part, ids and whole scores, k a query
        for ids, m in _matrices(batches):
            d = m.shape[1]
            if d not in queries.value:
                continue
            for at, part, other in _lists(ids, m, queries.value[d], _cuts(d)):
                whole = _longs(part.sum(0))
                for j in range(BLOCKS):
                    own = np.where(other, part[j], -np.inf)
                    rows = [own, np.broadcast_to(ids[at, None], own.shape), whole]
                    if (d, j) in best:
                        rows = [np.concatenate([a, b]) for a, b in zip(best[d, j], rows, strict=True)]
                    if len(rows[0]) > k:
                        top = np.argpartition(-rows[0], k - 1, axis=0)[:k]
                        rows = [np.take_along_axis(x, top, 0) for x in rows]
                    best[d, j] = rows
        for (d, j), (part, ids, whole) in best.items():
            r, c = np.nonzero(part != -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(queries.value[d][0][c]), pa.array(ids[r, c]), pa.array(whole[r, c])], ["query_id", "vec_id", "score"])

    return run


def _second(queries, bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, m in _matrices(batches):
            d = m.shape[1]
            if d not in queries.value:
                continue
            qid = queries.value[d][0]
            # A bound at the least long says nothing, as lower scores tie with it.
            known = [bounds.value.get(int(x), LEAST) for x in qid]
            bound = np.array([x if x > LEAST else -np.inf for x in known], object)
            for at, part, other in _lists(ids, m, queries.value[d], _cuts(d)):
                low = bound if part.dtype == object else np.array([float(x) if abs(x) < EXACT else x * np.inf for x in bound])
                sent = (part * BLOCKS >= low).any(0).astype(bool) & other
                r, c = np.nonzero(sent)
                whole = _longs(part[:, r, c].sum(0))
                keep = (whole >= low[c]).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(qid[c[keep]]), pa.array(ids[at[r[keep]]]), pa.array(whole[keep])], ["query_id", "vec_id", "score"])

    return run


SCHEMA = "query_id long, vec_id long, score long"


def top_k(spark: SparkSession, vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows of `vectors` that satisfy
    the column expression is_query, against all rows of `vectors`."""
    bounded_batches(spark)
    vectors = stored(usable(vectors), "topk-vectors")
    wanted = vectors.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    low = 0
    parts: list[DataFrame] = []
    last: int | None = None
    while True:  # blocks of queries in order of vec_id
        more = wanted if last is None else wanted.filter(F.col("vec_id") > last)
        rows = more.orderBy("vec_id").limit(QUERY_BLOCK).collect()
        if not rows:
            break
        last, low = rows[-1]["vec_id"], low + 1
        by: dict[int, tuple[list, list]] = {}
        for r in rows:
            ids, m = by.setdefault(len(r["v"]), ([], []))
            ids.append(r["vec_id"])
            m.append(r["v"])
        block = spark.sparkContext.broadcast({d: (np.array(ids, np.int64), np.array(m, np.float64)) for d, (ids, m) in by.items()})
        seen = vectors.mapInArrow(_first(block, k), SCHEMA).distinct()
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        bounds = {r["query_id"]: r["score"] for r in seen.withColumn("n", nth).filter(F.col("n") == k).collect()}
        found = vectors.mapInArrow(_second(block, spark.sparkContext.broadcast(bounds)), SCHEMA)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        parts.append(stored(found.withColumn("rank", place).filter(F.col("rank") <= k), "topk-block"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(spark, vectors, F.col("vec_id") % 100 == 0, 10)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) q
  JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
