"""Token counts from flat token files that have no index, by a separator scan.

A token file is nothing but ids of `width` bytes, documents following each other
with an end-of-document id behind each. Files are read in blocks of fixed size, all
independently: a block finds its separators with one vector comparison and keeps
the lengths between them, how many there are, and how many ids follow the last.
A prefix scan over the blocks of a file then gives each block the number of
documents before it and the ids that an open document brings in from earlier
blocks, however many of those have no separator at all.

Defined results: ids after a file's last separator are a document with
terminated = false; a separator right behind another ends a document of 0 tokens;
empty files have no documents; a file whose size is not a multiple of the id width
raises. Null and empty texts have 0 tokens; repeated rows are documents of their
own; other columns are not read. An id that `width` bytes can't hold raises.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, shared_path, stored
from tidemark.llm.tokens import default_path, encoder

#: <|endoftext|> of the tokenizer; its string in a text is encoded as ordinary text.
END_ID, WIDTH = 49407, 2
BLOCK_BYTES = 8 << 20
FILE_BYTES = 64 << 20
#: Rows of the file list that a writer holds at most.
LISTED = 10_000


def _writer(root: str, path: str, end: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(root)
        enc, kind = encoder(path, True), f"<u{width}"
        sep = np.array([end], kind).tobytes()
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        part, size, out, final, n, rows = 0, 0, None, "", 0, []

        def listed() -> pd.DataFrame:
            nonlocal rows
            done, rows = rows, []
            return pd.DataFrame(done, columns=["file", "ordinal", "doc_id", "file_bytes"]).astype({"doc_id": "Int64"})

        def close() -> Iterator[pd.DataFrame]:
            nonlocal out, part, size, n
            if out is not None:
                out.close()
                fs.move(final + ".tmp", final)
                rows.append((posixpath.basename(final), -1, None, size))
                yield listed()
            out, part, size, n = None, part + 1, 0, 0

        for b in batches:
            ids, at = enc.encode(pa.array(b["text"], pa.string(), from_pandas=True))
            if len(ids) and int(ids.max()) >> 8 * width:
                raise ValueError(f"id {int(ids.max())} does not fit {width} bytes")
            ids = ids.astype(kind)
            for doc, first, last in zip(b["doc_id"], at, at[1:], strict=False):
                if out is None:
                    final = posixpath.join(base, f"{name}-{part:04d}.tok")
                    out = fs.open_output_stream(final + ".tmp")
                out.write(ids[first:last].tobytes() + sep)
                size += int(last - first + 1) * width
                rows.append((posixpath.basename(final), n, None if pd.isna(doc) else int(doc), 0))
                n += 1
                if len(rows) >= LISTED:
                    yield listed()
                if size >= FILE_BYTES:
                    yield from close()
        yield from close()

    return run


def write_token_files(spark: SparkSession, docs: DataFrame, root: str, path: str, end: int = END_ID, width: int = WIDTH) -> DataFrame:
    """Encode whole texts into token files under root (shared by all executors);
    returns file, ordinal, doc_id, and per file one row of ordinal -1 with file_bytes."""
    bounded_batches(spark)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_writer(root, path, end, width), "file string, ordinal long, doc_id long, file_bytes long")
    return stored(rows, "token-files")


def _scan(root: str, end: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(root)
        for b in batches:
            for file, block, start, stop in zip(b["file"], b["block"], b["start"], b["stop"], strict=True):
                with fs.open_input_file(posixpath.join(base, file)) as f:
                    ids = np.frombuffer(f.read_at(stop - start, start), f"<u{width}")
                at = np.flatnonzero(ids == end)
                lengths = np.diff(at, prepend=-1) - 1
                tail = len(ids) - (int(at[-1]) + 1 if len(at) else 0)
                yield pd.DataFrame({"file": [file], "block": [block], "lengths": [lengths.astype(np.int64)], "n": [len(at)], "tail": [tail]})

    return run


def count_tokens(spark: SparkSession, files: DataFrame, root: str, end: int = END_ID, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal (from 0), n_tokens (without the separator), terminated. files: file, file_bytes."""
    bounded_batches(spark)
    step = block_bytes // width * width
    files = files.filter("file_bytes > 0").withColumn("file_bytes", F.when(F.col("file_bytes") % width == 0, F.col("file_bytes")).otherwise(F.raise_error(F.lit("a token file is cut inside an id"))))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("file_bytes") - 1, F.lit(step).cast("long")))
    blocks = files.select("file", start.alias("start"), "file_bytes").withColumn("block", F.floor(F.col("start") / step)).withColumn("stop", F.least(F.col("start") + step, F.col("file_bytes")))
    blocks = blocks.repartition(max(spark.sparkContext.defaultParallelism, 64), "file", "block")
    found = stored(blocks.select("file", "block", "start", "stop").mapInPandas(_scan(root, end, width), "file string, block long, lengths array<long>, n long, tail long"), "token-blocks")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    slim = found.select("file", "block", "n", "tail").withColumn("docs_before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("_t", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    # Ids open at a block: the tails of the blocks since the last one with a separator.
    slim = slim.withColumn("carry", F.col("_t") - F.coalesce(F.last(F.when(F.col("n") > 0, F.col("_t")), ignorenulls=True).over(before), F.lit(0)))
    slim = slim.withColumn("last", F.lead("block").over(order).isNull())
    wide = found.drop("n", "tail").join(slim, ["file", "block"])
    inside = wide.select("file", "docs_before", "carry", F.posexplode("lengths").alias("i", "len"))
    ended = inside.select("file", (F.col("docs_before") + F.col("i")).alias("ordinal"), (F.col("len") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("terminated"))
    rest = F.col("tail") + F.when(F.col("n") == 0, F.col("carry")).otherwise(0)
    open_ = slim.filter("last").select("file", (F.col("docs_before") + F.col("n")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("terminated")).filter("n_tokens > 0")
    return ended.unionByName(open_)


def op6_token_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = shared_path(spark, "tokens")
    rows = write_token_files(spark, docs, root, default_path())
    counts = count_tokens(spark, rows.filter("ordinal = -1").select("file", "file_bytes"), root)
    return rows.filter("ordinal >= 0").select("file", "ordinal", "doc_id").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
