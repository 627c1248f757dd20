"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a temporary folder of this machine, which only a local master can use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all machines share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return context._jsc.sc().getCheckpointDir().get()
