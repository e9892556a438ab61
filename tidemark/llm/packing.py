"""Packing documents into fixed windows by non-negative least squares.

A document is its token ids and an end id. Whole windows are cut from its front;
only the rest, shorter than a window, has to be combined with others. The rests are
known by a histogram of at most WINDOW lengths, so planning never sees rows:

1. lengths are rounded up to multiples of QUANTUM, and combinations of at most four
   that fill a window exactly are enumerated;
2. non-negative least squares finds repeat counts whose lengths match the histogram;
   the active-set solution has no more combinations than bins. Counts are rounded, and
   a combination is used as often as there are lengths for it;
3. what is left is packed greedily, the longest first with the best fits, again as
   counted patterns.

The plan (bounded by the number of lengths, not documents) is broadcast. A piece finds
its place from its rank among the pieces of its length, counted in two levels so that
a length that a third of all documents share is never gathered.

Defined results: null and empty texts are one end id; repeated rows are documents of
their own; the order of pieces that agree in every column is immaterial. An empty
table has no pieces. Columns other than doc_id and text are not read. A document that
tokenizes longer than memory allows is bounded by its row, as in any reader.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, stored
from tidemark.llm.tokens import default_path, encoder

WINDOW = 4096
QUANTUM = 8
END_ID = 2
#: Pieces to a hash bucket: a length that a third of all pieces have is dealt out as finely.
BUCKET_PIECES = 1000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, window: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(path), np.array([end], "<u4").tobytes()
        for b in batches:
            ids, at = enc.encode(b.column("text"))
            data, rows = memoryview(ids.astype("<u4", copy=False)).cast("B"), []
            for doc, first, last in zip(b.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                n = last - first + 1
                for s in range(0, n, window):
                    stop = min(n, s + window)
                    crc = zlib.crc32(data[4 * (first + s) : 4 * min(first + stop, last)])
                    rows.append((doc, s, stop - s, zlib.crc32(tail, crc) if stop == n else crc, n))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END_ID) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(path, window, end), PIECES)


def combinations(bins: int) -> np.ndarray:
    """Rows of four bin numbers (0: none) that sum to `bins`: all of one to three
    parts, and those of four whose two smallest agree."""
    out = [np.array([[bins, 0, 0, 0]])]
    a = np.arange(1, bins // 2 + 1)
    out.append(np.stack([bins - a, a, 0 * a, 0 * a], 1))
    b, c = np.meshgrid(np.arange(1, bins), np.arange(1, bins), indexing="ij")
    for twice in (False, True):
        first = bins - b - c * (1 + twice)
        ok = (first >= b) & (b >= c)
        out.append(np.stack([first[ok], b[ok], c[ok], c[ok] if twice else 0 * c[ok]], 1))
    return np.concatenate(out)


def nnls(cols: np.ndarray, h: np.ndarray, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Minimise |A x - h| over x >= 0 by the active-set method, where column j of A
    counts the bins cols[j] (bin 0 counts nothing). Returns the columns used and x. What
    `rounds` steps leave unmatched is left to the greedy step."""
    n = len(h)
    weight = (cols > 0).sum(1) ** 0.5
    used: list[int] = []
    A, x, r = np.zeros((n, 0)), np.zeros(0), h.astype(float)
    least = 0.5
    barred = np.zeros(len(cols), bool)
    for _ in range(rounds):
        r[0] = 0
        gain = r[cols].sum(1) / weight
        gain[used] = -1
        gain[barred] = -1
        j = int(gain.argmax())
        if gain[j] <= least:
            break
        col = np.zeros((n, 1))
        np.add.at(col[:, 0], cols[j][cols[j] > 0], 1)
        A, used, x = np.hstack([A, col]), [*used, j], np.append(x, 0.0)
        while True:
            gram = A.T @ A
            gram.flat[:: len(gram) + 1] += 1e-9
            s = np.linalg.solve(gram, A.T @ h)
            if (s > 1e-9).all():
                x = s
                break
            down = s <= 1e-9
            steps = np.where(down, x / np.maximum(x - s, 1e-12), np.inf)
            x = x + min(1.0, steps.min()) * (s - x)
            keep = x > 1e-9
            if not keep[-1] and used[-1] == j:
                barred[j] = True  # it cannot enter; numerical cycling otherwise
            A, used, x = A[:, keep], [u for u, k in zip(used, keep, strict=True) if k], x[keep]
            if not used:
                break
        r = h - A @ x
    return np.array(used, int), x


def plan(hist: dict[int, int], window: int = WINDOW, quantum: int = QUANTUM) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how often, [(length, how many), ...]) that use every counted length
    exactly, each of at most `window` tokens. Cost depends on the lengths alone."""
    left = {k: v for k, v in hist.items() if v}
    patterns: list[tuple[int, list[tuple[int, int]]]] = []
    if window in left:
        patterns.append((left.pop(window), [(window, 1)]))
    bins = window // quantum
    stock: dict[int, list[int]] = {}  # per bin its lengths, the longest last
    h = np.zeros(bins + 1)
    for length, n in sorted(left.items()):
        b = -(-length // quantum)
        stock.setdefault(b, []).append(length)
        h[b] += n
    cols = combinations(bins)
    cols = cols[((h[cols] > 0) | (cols == 0)).all(1)]
    used, x = nnls(cols, h) if len(cols) else (np.zeros(0, int), np.zeros(0))
    for j in used[np.argsort(-x)].tolist() if len(used) else []:
        parts = [int(b) for b in cols[j] if b]
        often = int(x[np.flatnonzero(used == j)[0]] + 0.5)
        while often > 0:
            # The longest length in stock of each bin; as often as all of them last.
            take: dict[int, int] = {}
            for b in parts:
                some = [length for length in reversed(stock[b]) if left.get(length, 0) > take.get(length, 0)]
                if not some:
                    take = {}
                    break
                take[some[0]] = take.get(some[0], 0) + 1
            if not take:
                break
            c = min(often, *(left[k] // m for k, m in take.items()))
            patterns.append((c, sorted(take.items(), reverse=True)))
            often -= c
            for k, m in take.items():
                left[k] -= c * m
            for b in parts:
                stock[b] = [k for k in stock[b] if left[k] > 0]
    lengths = sorted(k for k, v in left.items() if v)
    while lengths:
        room, take = window, {}
        while room and (i := bisect.bisect_right(lengths, room)):
            k = lengths[i - 1]
            while i and left[k] <= take.get(k, 0):
                i -= 1
                k = lengths[i - 1] if i else 0
            if not i:
                break
            m = min(left[k] - take.get(k, 0), room // k)
            take[k] = take.get(k, 0) + m
            room -= m * k
        c = min(left[k] // m for k, m in take.items())
        patterns.append((c, sorted(take.items(), reverse=True)))
        for k, m in take.items():
            left[k] -= c * m
            if not left[k]:
                lengths.pop(bisect.bisect_left(lengths, k))
    return patterns


def layout(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan by (length, first rank): sequence = base + (rank - first) // many, and
    offset = at + length * ((rank - first) % many)."""
    rows, rank, base = [], {}, 0
    for often, parts in patterns:
        at = 0
        for length, many in parts:
            first = rank.get(length, 0)
            rows.append((length, first, many, base, at))
            rank[length] = first + often * many
            at += length * many
        base += often
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "many", "base", "at"), table.T.copy(), strict=True))


def _place(plan_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan_of.value
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(p["length"] * (1 << 44) + p["first"], length * (1 << 44) + rank, "right") - 1
            own = rank - p["first"][i]
            seq, off = p["base"][i] + own // p["many"][i], p["at"][i] + length * (own % p["many"][i])
            cols = [b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = stored(pieces(docs, path or default_path(), window, end), "pack-pieces")
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, min(65536, sum(hist.values()) // BUCKET_PIECES))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = cut.withColumn("_rn", F.row_number().over(inside) - 1).join(base, ["length", "bucket"])
    ranked = ranked.withColumn("rank", (F.col("base") + F.col("_rn")).cast("long"))
    plan_of = spark.sparkContext.broadcast(layout(plan(hist, window)))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(_place(plan_of), PIECES + ", sequence_id long, offset long")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
