"""Questions and answers between blocks of documents and ranges of hashes.

Some operators must know, for very many strings, where else each occurs. One Spark row for each
string would cost more than the work itself. So documents are packed into compressed blocks,
each block packs its hashes by range into one row for each range, a task for each range answers
by block, and blocks and answers meet again. Shuffled are packed arrays, in number of bytes what
their information needs; every exchange is an ordinary Spark shuffle and can be recomputed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillon.llm.common import materialize, shuffle_partitions

#: Bytes of text in a block, unless one text is longer; bytes of text for each range of hashes.
BLOCK_BYTES, RANGE_BYTES = 1 << 20, 8 << 20
#: Ranges for each task, 128 MB of text, where that makes more tasks than the session's shuffle partitions.
RANGES_IN_TASK = 16
#: What a null id counts as: larger than any other.
NO_ID = np.iinfo(np.int64).max


def trim() -> None:
    """Give freed memory back to the machine: executors share it among many workers."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def zip_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of one length each, byte planes apart, compressed."""
    import zstandard

    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        parts.append(planes)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unzip_arrays(blob: bytes, n: int, *kinds) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, n * sum(np.dtype(k).itemsize for k in kinds))), 0, []
    for k in map(np.dtype, kinds):
        planes = np.frombuffer(raw, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(k) if n else np.zeros(0, k))
        at += n * k.itemsize
    return out


def _tasks(spark: SparkSession, ranges: int) -> int:
    """Tasks that grow with the bytes of text, so that a task's share doesn't."""
    return max(shuffle_partitions(spark), -(-ranges // RANGES_IN_TASK))


def pack(docs: DataFrame, ranges: int, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, blob): all rows of ``docs`` with all columns, in compressed blocks of about ``block_bytes`` of text.

    The blocks are dealt out once; whatever asks or meets them in the same query reads that one
    shuffle. A lost executor has its blocks cut again, so they must come out the same: what is not
    read from files as it stands (a join, say, whose rows come in any order) is written first.
    """
    if not _as_stored(docs):
        docs = materialize(docs, "to-pack")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = (np.cumsum(sizes) - sizes) // block_bytes
            for at in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(part)) + 1) if b.num_rows else []:
                yield pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([_write(b.slice(at[0], len(at)))], pa.binary())], ["block", "blob"])
                seq += 1

    return docs.mapInArrow(run, "block long, blob binary").repartition(_tasks(docs.sparkSession, ranges), "block")


def _as_stored(df: DataFrame) -> bool:
    """Whether rows come in a fixed order: from files, or tables of the driver, through row by row steps only."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() not in ("Project", "Filter", "MapInArrow", "MapInPandas", "LogicalRelation", "LocalRelation", "LogicalRDD"):
            return False
        below = plan.children()
        todo += [below.apply(i) for i in range(below.size())]
    return True


def _write(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_block(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def ranges_for(docs: DataFrame, text_col: str = "text") -> int:
    """Number of hash ranges, in proportion to the bytes of text."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(12, -(-total // RANGE_BYTES))


_ASKED = "part long, block long, n long, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["part", "block", "n", "data"])


def ask(blocks: DataFrame, question: Callable[[pa.Table], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """Rows (part, block, n, data) that ``question`` makes of each block's (part, n, data)."""

    def run(table: pa.Table) -> pa.Table:
        rows = [(p, block, n, d) for block, blob in zip(table["block"].to_pylist(), table["blob"].to_pylist()) for p, n, d in question(read_block(blob))]
        trim()
        return pa.Table.from_batches([_rows(rows)])

    return blocks.groupBy("block").applyInArrow(run, _ASKED)


def answer(asked: DataFrame, reply: Callable[[list[tuple[int, int, bytes]]], Iterator[tuple[int, int, bytes]]], ranges: int, mark: int = 0) -> DataFrame:
    """Rows (part, block, n, data) that ``reply`` makes of a part's (block, n, data), dealt by block; ``mark`` becomes the part."""

    def run(table: pa.Table) -> pa.Table:
        got = sorted(zip(table["block"].to_pylist(), table["n"].to_pylist(), table["data"].to_pylist()))
        rows = [(mark, *x) for x in reply(got)]
        trim()
        return pa.Table.from_batches([_rows(rows)])

    tasks = _tasks(asked.sparkSession, ranges)
    if tasks > shuffle_partitions(asked.sparkSession):
        asked = asked.repartition(tasks, "part")
    return asked.groupBy("part").applyInArrow(run, _ASKED).repartition(tasks, "block")


def meet(blocks: DataFrame, answers: DataFrame, work: Callable[[int, pa.Table, list[tuple[int, int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """What ``work`` makes of each block's number, rows and answers (part, n, data)."""

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [work(block, read_block(blob), sorted(zip(right["part"].to_pylist(), right["n"].to_pylist(), right["data"].to_pylist()))) for block, blob in zip(left["block"].to_pylist(), left["blob"].to_pylist())]
        trim()
        return pa.concat_tables(out) if out else empty

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
