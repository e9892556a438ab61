"""What the operators of this subpackage share: the shared folder, the word
rule, and zero-copy views of Arrow string columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import importable, shared_root

#: The characters that separate words: space and U+0009 to U+000D.
SEPARATORS = " \t\n\x0b\x0c\r"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage,
    so a lost executor costs a re-read instead of the whole history.

    slim: the rows are a few numbers each, and are written by as many tasks as the
    cluster has cores, whatever number of partitions made them: fewer files."""
    spark = df.sparkSession
    if slim:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that stored() made, once nothing reads it any more."""
    jvm, roots = spark.sparkContext._jvm, set()
    for file in df.inputFiles():
        roots.add(file.rsplit("/", 1)[0])
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, whatever the texts' length: each is held by the JVM,
    outside its heap, and by the Python worker at once. Also lets workers import us."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def words(text: Column) -> Column:
    """The array of words of a text; null and empty texts have none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SEPARATORS, " " * len(SEPARATORS))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has, without making them."""
    flat = F.translate(F.coalesce(text, F.lit("")), SEPARATORS, " " * len(SEPARATORS))
    return F.size(F.filter(F.split(flat, " "), lambda w: w != "")).cast("long")


def crc32_mod(key: Column, m: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(m))


def text_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `limit` bytes; a longer row is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


ODD = 0x9E3779B97F4A7C15


def powers(n: int, base: int = ODD) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


_powers: dict[int, np.ndarray] = {}


def _known_powers(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) <= n:
        _powers[base] = powers(max(n, 1 << 20), base)
    return _powers[base]


class SpanHash:
    """64-bit hashes of any spans of a byte string, from one prefix sum.

    The sum of byte * P**i over a span, times P**-start, depends on its content
    alone since P is odd and so has an inverse modulo 2**64."""

    def __init__(self, raw: np.ndarray, base: int = ODD):
        n = len(raw)
        self.back = _known_powers(pow(base, -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _known_powers(base, n)[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the row that each is in."""
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = ~space
    edge = word[1:] != word[:-1]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    inside = cut & word[:-1] & word[1:]  # a text ends and the next begins in the middle of letters
    starts = np.flatnonzero((edge & word[1:]) | inside)
    ends = np.flatnonzero((edge & word[:-1]) | inside)
    row = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, row
