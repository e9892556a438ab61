"""A quality classifier over supervised subword embeddings.

Words and character n-grams (of UTF-8 bytes, spaces included) are hashed into
BUCKETS; each bucket has a learned vector, a document is the average of its vectors,
and a softmax over two classes follows. Vectors and softmax are trained together by
stochastic gradient descent in numpy. Since averaging and the softmax's inner product
are linear, the trained model folds into one number a bucket, so scoring a whole text
is one table lookup for each of its features.

The sample is about SAMPLE labelled documents of each class (all of a class that has
fewer), drawn by a hash of doc_id at a rate that counts over all labels give; the
class shares over all labels then correct the bias. Documents with contradicting
labels teach nothing; of rows that share a doc_id one text does. Every whole text is
scored.

Defined results: null and empty texts have no features and score the class share; no
label at all gives 0.5 to every document, one class only scores that class. Repeated
rows are scored each; columns beyond those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SpanHash, bounded_batches, crc32_mod, pieces, text_view, word_spans

LOG_BUCKETS = 17
BUCKETS = 1 << LOG_BUCKETS
NGRAMS = (3, 5)
DIM = 16
SAMPLE = 1500
EPOCHS = 6
RATE = 4.0
THRESHOLD = 0.3
#: Bytes of text in work at once.
CHUNK = 1 << 19


def _buckets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of feature: bucket of each, and where each text's begin and end."""
    if len(raw) == 0:
        return
    starts, ends, row = word_spans(raw, offsets)
    if len(starts):
        h = SpanHash(raw)(starts, ends)
        edges = np.searchsorted(starts, offsets)
        yield (h >> np.uint64(64 - LOG_BUCKETS)).astype(np.int64), edges[:-1], edges[1:]
    x = raw.astype(np.uint32)
    for n in NGRAMS:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, np.uint32)
        for i in range(n):
            h *= np.uint32(0x01000193)
            h ^= x[i : len(x) - n + 1 + i]
        h *= np.uint32(0x9E3779B1)
        first = np.minimum(offsets[:-1], len(h))
        yield (h >> np.uint32(32 - LOG_BUCKETS)).astype(np.int64), first, np.maximum(first, np.minimum(offsets[1:] - n + 1, len(h)))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the share of its features in each."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    found = [b[s[0] : e[0]] for b, s, e in _buckets(raw, np.array([0, len(raw)]))]
    every = np.concatenate(found) if found else np.zeros(0, np.int64)
    idx, n = np.unique(every, return_counts=True)
    return idx, (n / max(1, len(every))).astype(np.float32)


@dataclass
class Model:
    """The folded model: a document's logit is the mean of `table` over its features + bias."""

    table: np.ndarray
    bias: float


def train(texts: list[str], labels: np.ndarray, share: float, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """share: of class 1 among all labels, for the bias."""
    rng = np.random.default_rng(seed)
    bags = [bag(t) for t in texts]
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            idx, w = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = w @ vectors[idx]
            z = hidden @ soft + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = soft @ p
            soft -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate / RATE * p
            # A bucket's gradient is divided by its own share's scale, as if each distinct
            # feature came once: else rare features, the telling ones, would hardly move.
            vectors[idx] -= rate * np.outer(np.sqrt(w / max(1, len(idx))), back)
    table = (vectors @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
    seen = float(labels.mean())
    return Model(table, float(bias[1] - bias[0]) + _logit(share) - _logit(seen))


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return float(np.log(p / (1 - p)))


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, target: str, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text. labels: doc_id and the target (0 or 1), those to learn from."""
    sure = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.min(target).alias("y"), F.max(target).alias("_y")).filter("y = _y").drop("_y")
    counts = {r["y"]: r["n"] for r in sure.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    share = counts.get(1, 0) / total
    if len(counts) == 1:
        return Model(np.zeros(BUCKETS, np.float32), _logit(share))
    rate = F.when(F.col("y") == 1, F.lit(int(min(1.0, sample / counts[1]) * 2**20) + 1)).otherwise(F.lit(int(min(1.0, sample / counts[0]) * 2**20) + 1))
    drawn = sure.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(2**20)) < rate)
    rows = spark.createDataFrame([(r["doc_id"], r["y"]) for r in drawn.collect()], "doc_id long, y int")  # about 2 * sample rows
    drawn = docs.filter(F.col("text").isNotNull()).join(F.broadcast(rows), "doc_id")
    got = drawn.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in got], np.array([r["y"] for r in got], np.int64), share) if got else Model(np.zeros(BUCKETS, np.float32), _logit(share))


def scores(model: Model, column: pa.Array) -> np.ndarray:
    """Of whole texts, 0 to 1."""
    raw, offsets = text_view(column)
    out = np.empty(len(offsets) - 1)
    for i, j in pieces(offsets, CHUNK):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        total, n = np.zeros(j - i), np.zeros(j - i)
        for buckets, first, last in _buckets(part, at):
            sums = np.concatenate([[0.0], np.cumsum(model.table[buckets], dtype=np.float64)])
            total += sums[last] - sums[first]
            n += last - first
        out[i:j] = total / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(out + model.bias, -30, 30)))


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score for each row of docs (doc_id, text)."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(shared.value, b.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = learn(spark, docs, labels.filter(crc32_mod(F.col("doc_id"), 5) != 0), "quality")
    held = F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score(spark, docs, model).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
