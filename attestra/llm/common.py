"""What the corpus operators share: reading tables, shared folders, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one step of an Arrow worker handles at once; bounds its memory.
STEP_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, one of our own, if all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    has = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found:
        if has.isEmpty():
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if has.isEmpty():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"/tmp/attestra-{uuid.uuid4().hex}")
        has = spark.sparkContext._jsc.sc().getCheckpointDir()
    return has.get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written within scratch(), which go at its end unless kept."""

    def __init__(self) -> None:
        self.paths: dict[str, SparkSession] = {}
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """df, the tables of which stay: for scratch() around this one to delete, if there is one."""
        files = df.inputFiles()
        self.kept |= {p for p in self.paths if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files)}
        return df


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Deletes, at its end, the tables that written() made in it and that are not kept: no later plan reads them."""
    own, around = Scratch(), _scratch.get()
    token = _scratch.set(own)
    try:
        yield own
    finally:
        _scratch.reset(token)
        for path, spark in own.paths.items():
            if path not in own.kept:
                delete(spark, path)
            elif around is not None:
                around.paths[path] = spark


#: Bytes of an Arrow batch in jobs that end in written().
BATCH_BYTES = 8_000_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run in it pass Arrow batches of at most BATCH_BYTES to Python: rows may be as long as the longest text."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, and may be read many times."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if (own := _scratch.get()) is not None:
        own.paths[path] = spark
    with small_batches(spark):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 1).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by written() that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            delete(spark, file.rsplit("/", 1)[0])


#: Bytes up to which a table is sent to all executors.
SEND_BYTES = 8_000_000


def few(df: DataFrame, size: Column | int) -> DataFrame:
    """df, a written table, to be sent to all executors if its rows, of `size` bytes each, are at most SEND_BYTES; else to be shuffled."""
    total = df.agg(F.sum(size if isinstance(size, Column) else F.lit(size))).first()[0] or 0
    return F.broadcast(df) if total <= SEND_BYTES else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay under `most` bytes; a longer text has a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def range_slots(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, written in ascending order of `order` over range partitions; column `_part` numbers them.

    The number of a row's partition is stored with it, so that a later recomputation cannot
    change it. No partition is larger than a share of the rows unless rows tie in all of `order`.
    """
    n = partitions(df.sparkSession)
    return written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), name)
