"""Helpers shared by the operators: shared storage, size-checked broadcasts, Arrow text access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest side, in bytes of its written form, that is broadcast.
BROADCAST_BYTES = 8 << 20

#: Values of UTF-8 bytes that Python and the contracts call white space.
SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Where it is unset (tests on one machine) a local folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="pagewright-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a cut in the lineage that
    survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagewright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table that written() returned."""
    spark = df.sparkSession
    total = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table is within the bound for a broadcast."""
    return stored_bytes(df) <= limit


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


#: Rows of an Arrow batch, where the session keeps Spark's own number of 10,000: texts of some KB make
#: tens of MB of those, in the JVM and again in Python.
BATCH_ROWS = 2000


def give_back() -> None:
    """What this worker has freed goes back to the machine: workers wait for further tasks, and keep it else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow, by batches of BATCH_ROWS rows at most. A number that the session has set stays."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(held, schema)


def chunks(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text of an Arrow string column; null gives b''."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2]) if column.buffers()[2] else memoryview(b"")
    found = [bytes(data[a:b]) for a, b in zip(offsets, offsets[1:])]
    if column.null_count:
        for i in np.flatnonzero(np.asarray(column.is_null())).tolist():
            found[i] = b""
    return found


def cut_batches(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about limit bytes, one row at least."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) // limit).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.array([], int)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
        yield batch.slice(a, b - a)
