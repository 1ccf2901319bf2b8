"""Making the package importable in Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, unless their PYTHONPATH has it already."""
    context = spark.sparkContext
    if context.applicationId in _DONE or ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, files in os.walk(os.path.join(ROOT, "larkspur")):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, ROOT))
    # the driver serves the file itself; nothing of a job is kept there
    target = os.path.join(tempfile.mkdtemp(prefix="larkspur-code-"), "larkspur.zip")
    with open(target, "wb") as f:
        f.write(data.getvalue())
    context.addPyFile(target)
    _DONE.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than there are, as one row group does.

    With as many splits as cores or more, which any large table has, nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
