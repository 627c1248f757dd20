"""Document sources and Parquet sinks."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Writer defaults.
ROWS_PER_GROUP, ROWS_PER_PAGE = 100_000, 20_000


def read_documents(spark: SparkSession, path: str | list[str], lines: bool = True) -> DataFrame:
    """(path, doc): one document a line, or one a file."""
    found = spark.read.text(path, wholetext=not lines)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def read_binary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, doc): one document a file, from bytes; bytes that are no UTF-8 are replaced."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("doc"))


def _check(compression: str) -> None:
    if compression not in ("snappy", "uncompressed"):
        raise ValueError(f"no such compression: {compression}")


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", rows_per_group: int = ROWS_PER_GROUP, rows_per_page: int = ROWS_PER_PAGE, mode: str = "errorifexists") -> int:
    """Write through Spark's file output; gives the bytes that lie at ``path`` then.

    Both row limits are 1 at least; ``compression`` is snappy or uncompressed.
    """
    _check(compression)
    (
        df.write.mode(mode).option("compression", compression)
        .option("parquet.block.row.count.limit", max(1, rows_per_group)).option("parquet.page.row.count.limit", max(1, rows_per_page)).parquet(path)
    )
    return stored_bytes(df.sparkSession, path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a path of any file system Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def write_to_sink(df: DataFrame, sink: Callable[[int, bytes], object], compression: str = "snappy", rows_per_group: int = ROWS_PER_GROUP, rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """(part, n_rows, n_bytes): each partition is one Parquet file in memory, which ``sink(part, data)`` takes on its executor.

    Columns with JSON text are annotated as JSON. Partitions without rows give no file. A lost task
    is run again, so a sink should put a part in its place and not append it.
    """
    return _files(df, sink, "part long, n_rows long, n_bytes long", compression, rows_per_group, rows_per_page)


def to_parquet_bytes(df: DataFrame, compression: str = "snappy", rows_per_group: int = ROWS_PER_GROUP, rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """(part, n_rows, n_bytes, data): each partition as a Parquet file in a binary column; ``coalesce(1)`` before gives one file."""
    return _files(df, None, "part long, n_rows long, n_bytes long, data binary", compression, rows_per_group, rows_per_page)


def _files(df: DataFrame, sink: Callable | None, schema: str, compression: str, rows_per_group: int, rows_per_page: int) -> DataFrame:
    _check(compression)
    names = df.columns
    arrow = to_arrow_schema(df.schema)
    texts = [i for i, f in enumerate(df.schema.fields) if (f.metadata or {}).get("json")]
    codec = "none" if compression == "uncompressed" else compression

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, n, held, waiting = io.BytesIO(), 0, [], 0
        target = arrow
        for i in texts:
            target = target.set(i, pa.field(names[i], pa.json_(pa.string())))
        writer = pq.ParquetWriter(out, target, compression=codec, max_rows_per_page=max(1, rows_per_page), store_schema=False)

        def flush(last: bool) -> None:
            nonlocal held, waiting
            while waiting >= max(1, rows_per_group) or (last and waiting):
                table = pa.Table.from_batches(held).combine_chunks()
                group = table.slice(0, max(1, rows_per_group))
                for i in texts:
                    group = group.set_column(i, target.field(i), pa.ExtensionArray.from_storage(pa.json_(pa.string()), group.column(i).combine_chunks()))
                writer.write_table(group.cast(target), row_group_size=max(1, rows_per_group))
                rest = table.slice(group.num_rows)
                held, waiting = rest.to_batches(), rest.num_rows

        for b in batches:
            n += b.num_rows
            held.append(b)
            waiting += b.num_rows
            flush(False)
        flush(True)
        writer.close()
        if n:
            data, part = out.getvalue(), TaskContext.get().partitionId()
            cols = [pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([len(data)], pa.int64())]
            if sink is None:
                cols.append(pa.array([data], pa.binary()))
            else:
                sink(part, data)
            yield pa.RecordBatch.from_arrays(cols, ["part", "n_rows", "n_bytes", "data"][: len(cols)])

    return df.mapInArrow(run, schema)


def write_documents(df: DataFrame, doc: str, path: str, mode: str = "errorifexists") -> None:
    """One canonical document a line."""
    df.select(F.col(doc).alias("value")).write.mode(mode).text(path)
