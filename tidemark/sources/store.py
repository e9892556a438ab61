"""An immutable candle store by symbol, timeframe and year, with manifests.

Years are written once: a year that exists makes the write fail unless overwriting is
asked for. Files are whole tables of Spark's writer, so a write either shows up or not."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import CANDLE, Timeframe

SCHEMA_VERSION = 2


class ImmutableWriteError(RuntimeError):
    """A year or manifest that exists already."""


class CandleStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def years(self, symbol: str, tf: Timeframe) -> list[int]:
        p = self._path(f"symbol={symbol}", f"timeframe={tf.name}")
        if not self._fs(p).exists(p):
            return []
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in self._fs(p).listStatus(p) if s.getPath().getName().startswith("year="))

    def write(self, bars: DataFrame, overwrite: bool = False) -> list[tuple[str, str, int]]:
        """Add bars of any series; returns the (symbol, timeframe, year) written."""
        rows = bars.select(*[f.name for f in CANDLE.fields]).withColumn("year", F.year("timestamp"))
        # Years are written aside, where no reader looks, and then moved into their places.
        aside = f"_new-{uuid.uuid4().hex}"
        by = ("symbol", "timeframe", "year")
        # One task a year and series, in time order: a year is one sorted file.
        rows.repartition(*by).sortWithinPartitions(*by, "timestamp").write.partitionBy(*by).parquet(f"{self.root}/{aside}")
        top = self._path(aside)
        fs = self._fs(top)
        try:
            new = [y.getPath() for s in self._folders(fs, top) for t in self._folders(fs, s.getPath()) for y in self._folders(fs, t.getPath())]
            names = [[p.getParent().getParent().getName(), p.getParent().getName(), p.getName()] for p in new]
            keys = [(s.partition("=")[2], t.partition("=")[2], int(y.partition("=")[2])) for s, t, y in names]
            taken = sorted(k for k, n in zip(keys, names, strict=True) if fs.exists(self._path(*n)))
            if taken and not overwrite:
                raise ImmutableWriteError(f"already stored: {taken}")
            for p, n in zip(new, names, strict=True):
                self._swap(fs, p, self._path(*n), self._path(f"_old-{uuid.uuid4().hex}"))
        finally:
            fs.delete(top, True)
        return sorted(keys)

    @staticmethod
    def _folders(fs, path):
        return [s for s in fs.listStatus(path) if s.isDirectory() and "=" in s.getPath().getName()]

    @staticmethod
    def _swap(fs, new, place, old):
        """Put a folder into its place; what was there is deleted last."""
        fs.mkdirs(place.getParent())
        if fs.exists(place) and not fs.rename(place, old):
            raise OSError(f"cannot move {place}")
        if not fs.rename(new, place):
            fs.rename(old, place)
            raise OSError(f"cannot move {new}")
        fs.delete(old, True)

    def read(self, symbol: str, tf: Timeframe, start=None, end=None) -> DataFrame:
        """Bars that open in [start, end); years outside are never listed in the scan."""
        p = self._path()
        if not self._fs(p).exists(p) or not self.years(symbol, tf):
            return self.spark.createDataFrame([], CANDLE)
        df = self.spark.read.parquet(self.root).filter((F.col("symbol") == symbol) & (F.col("timeframe") == tf.name))
        if start is not None:
            df = df.filter((F.col("year") >= start.year) & (F.col("timestamp") >= F.lit(start)))
        if end is not None:
            df = df.filter((F.col("year") <= end.year) & (F.col("timestamp") < F.lit(end)))
        return df.select(*[f.name for f in CANDLE.fields])

    def digests(self, symbol: str, tf: Timeframe) -> DataFrame:
        """year and sha256 over its files' own digests, in order of their names."""
        base = self._path(f"symbol={symbol}", f"timeframe={tf.name}").toString()
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(base)
        one = files.select(F.regexp_extract("path", r"year=(\d+)", 1).cast("int").alias("year"), "path", F.sha2("content", 256).alias("sha"), "length")
        return one.groupBy("year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha"))), lambda x: x["sha"]), "\n").alias("all"), F.sum("length").alias("n_bytes")).select("year", F.sha2("all", 256).alias("sha256"), "n_bytes")


def rollup_digest(entries: DataFrame) -> DataFrame:
    """One digest over sorted `path:sha:bytes` lines, with counts of files and empty ones."""
    line = F.concat_ws(":", "path", "sha", F.col("n_bytes").cast("string"))
    return entries.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"), F.count(F.lit(1)).alias("files"), F.count_if(F.col("n_bytes") == 0).alias("empty"))


class ManifestStore:
    """One JSON file per dataset version, never changed."""

    def __init__(self, root: str):
        self.root = Path(root.removeprefix("file://"))

    def write(self, version: str, payload: dict) -> Path:
        path = self.root / f"{version}.json"
        if path.exists():
            raise ImmutableWriteError(f"manifest {version} exists")
        self.root.mkdir(parents=True, exist_ok=True)
        body = {"schema_version": SCHEMA_VERSION, "dataset_version": version, "created": datetime.now(UTC).isoformat(), **payload}
        text = json.dumps(body, indent=2, sort_keys=True, default=str)
        part = path.with_suffix(f".{uuid.uuid4().hex}")
        part.write_text(text)
        part.rename(path)
        return path

    def read(self, version: str) -> dict:
        return json.loads((self.root / f"{version}.json").read_text())

    def versions(self) -> list[str]:
        return sorted(p.stem for p in self.root.glob("*.json")) if self.root.exists() else []

    def verify(self, version: str, store: CandleStore) -> list[str]:
        """MISSING:… and CHANGED:… for years that are not as the manifest has them."""
        out = []
        for series in self.read(version)["series"]:
            tf = Timeframe(series["timeframe"])
            now = {r["year"]: r["sha256"] for r in store.digests(series["symbol"], tf).collect()} if store.years(series["symbol"], tf) else {}
            for year, sha in sorted(series["partitions"].items()):
                name = f"{series['symbol']}/{tf.name}/{year}"
                if int(year) not in now:
                    out.append(f"MISSING:{name}")
                elif now[int(year)] != sha:
                    out.append(f"CHANGED:{name}")
        return out


def combined_hash(partitions: dict[str, str]) -> str:
    """A single year's digest as it is, else one over year:digest lines."""
    if len(partitions) == 1:
        return next(iter(partitions.values()))
    return hashlib.sha256("\n".join(f"{y}:{s}" for y, s in sorted(partitions.items())).encode()).hexdigest()
