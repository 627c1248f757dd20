"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.storage import shared_dir


_written: list[str] = []


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete what ``materialize`` has written for this driver; results that are not stored elsewhere can't be read after it."""
    n = len(_written)
    while _written:
        place = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(text) -> bytes:
    """UTF-8 bytes of a text; null gives none."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
