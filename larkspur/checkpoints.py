"""Cutting lineage by tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

Made = TypeVar("Made")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of one's own only where it is unset and Spark runs in one process, as in tests.

    On a cluster a machine's own folder would hold only what its executors write, so there it is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back: it survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/larkspur/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MADE: dict[tuple, tuple] = {}


def reused(source: DataFrame, what: tuple, make: Callable[[], Made]) -> Made:
    """What make() gives, made once in an application as long as the files of `source` stay the same."""
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, *what)
    state = []
    for name in sorted(source.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        state.append((name, status.getLen(), status.getModificationTime()))
    if key not in _MADE or _MADE[key][0] != state:
        _MADE[key] = (state, make())
    return _MADE[key][1]
