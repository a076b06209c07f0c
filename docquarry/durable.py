"""Durable intermediates in the folder that driver and executors share, bounded broadcasts, and dense positions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A table of at most this many rows (of a few dozen bytes each) may be broadcast.
BROADCAST_ROWS = 200_000

#: Bytes of a batch of rows on its way to or from Python inside small_batches(), and of texts in slices().
BATCH_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where that is unset, a session of one machine gets a temporary folder; any other is an error, as its executors couldn't
    read what the driver or other executors wrote there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='docquarry-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docquarry/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docquarry_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes what written() made, once nothing lazy reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._docquarry_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Batches of rows that are sent to Python end at so many bytes, by default, besides a longer row; for what is run inside, not only planned.

    Spark's own bound of 10000 rows or 64 MB is held several times over outside of the heap, by each task and its Python worker.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batch: pa.RecordBatch, text: int, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many bytes of its column of texts, besides a longer text: for Python objects that take several times the room of texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
        yield batch.slice(at, end - at)
        at = end


class Scratch:
    """Written tables of one operator that go together, once a later table holds what they were for."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        self.made.append(written(df, what))
        return self.made[-1]

    def drop(self) -> None:
        for df in self.made:
            drop_written(df)
        self.made.clear()


def small_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """df marked for broadcast if it has at most that many rows (counted, so df should be a written table), else as it is.

    size: so many rows a row stands for by its bytes, where it holds texts or arrays of any length.
    """
    if size is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, or where df has a column of that name already, longer ones."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def own(df: DataFrame, *but: str) -> list[Column]:
    """df's columns, whatever signs their names hold, less those named."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in but]


def with_position(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds the dense position, from 0, of each row in that order, without bringing all rows to one task.

    Rows are range-partitioned and sorted; their place in a partition and the sizes of the partitions before it add up to the position.
    """
    ids = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ids = written(ids, "positions")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ids.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    out = ids.join(F.broadcast(before), part == F.col("_part"))
    return out.withColumn(name, (F.col("_before") + place).cast("long")).drop("_id", "_part", "_before")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes in fewer partitions than there are cores, as from one small file; else as it is, unmoved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
