"""Session set-up that a query may need."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors where their Python path has no copy of it (once an application)."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    there = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if os.path.realpath(here) in there or os.path.realpath(os.getcwd()) == os.path.realpath(here) or context.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="codemosaic-"), "codemosaic.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(os.path.join(here, "codemosaic")):
            for name in names:
                if name.endswith(".py"):
                    z.write(full := os.path.join(top, name), os.path.relpath(full, here))
    before = list(sys.path)
    context.addPyFile(path)
    sys.path[:] = before  # the driver goes on with its own files
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a folder of our own if this one machine is all there is; on a
    cluster, where executors would each write to their own disk, an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared folder: the plan starts anew, and a lost executor is recovered from files."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
