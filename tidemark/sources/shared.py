"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: str | None = None


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where a local session has none, as in tests, a temporary folder
    of this machine takes its place and is set as the checkpoint directory; a cluster
    has to name one."""
    global _LOCAL
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _LOCAL is None:
        _LOCAL = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(_LOCAL)
    return _LOCAL


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it again: the plan above starts from the files, and a lost
    executor costs a read."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies, if the executors have it there;
    on clusters that don't, it comes with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
