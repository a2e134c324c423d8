"""Settings and sizes that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a folder of this machine is set only where none is, and only for a local master."""
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if held is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        held = tempfile.mkdtemp(prefix="checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(held)
    return held


def written(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """The rows from a table in the shared folder: lineage ends and a lost executor costs no recomputation.  made: gets its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folders: list[str]) -> None:
    """Delete tables of written() that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for f in folders:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of one call in the shared folder, which go when the call ends.  files: of a table that is far smaller than its shuffle is wide."""

    def __init__(self, spark: SparkSession, files: int):
        self.spark, self.files = spark, files
        self.made: list[str] = []

    def written(self, df: DataFrame, name: str, few: bool = True, keep: bool = False) -> DataFrame:
        """few: a small table.  keep: it outlives the call."""
        return written(df.coalesce(self.files) if few else df, name, None if keep else self.made)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        removed(self.spark, self.made)


#: Groups of one level of a merge that one of the next takes.
FAN = 64


def tree(pieces: DataFrame, merge: Callable[[pa.Table], tuple], groups: int) -> DataFrame:
    """One row for each `part`, from pieces of it merged level by level.

    pieces: `part` and the columns of which merge(table) makes one row again.  groups: of each part
    at the first level, in proportion to the input, so that no task reads more than its share.
    """
    names, schema = pieces.columns[1:], pieces.schema
    groups = max(1, int(groups))

    def one(key: tuple, table: pa.Table) -> pa.Table:
        made = merge(table)
        return pa.table({"part": pa.array([key[0].as_py()], table.schema.field("part").type), **{n: pa.array([x], table.schema.field(n).type) for n, x in zip(names, made, strict=True)}, "slot": pa.array([key[1].as_py()], pa.int32())})

    out = pieces.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(groups)))
    while True:
        out = out.groupBy("part", "slot").applyInArrow(one, T.StructType([*schema.fields, T.StructField("slot", T.IntegerType())]))
        if groups == 1:
            return out.drop("slot")
        groups = -(-groups // FAN)
        out = out.withColumn("slot", F.pmod("slot", F.lit(groups)))


def short_batches(df: DataFrame) -> DataFrame:
    """The frame, with Arrow batches of BATCH_ROWS rows in its session unless another number was set: a row is a whole text here, and Spark's 10,000 of them fill memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of the input by the optimiser's statistics; those of the column where these say nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 45:
        return size
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: What stays in a Python worker between tasks, by the operator that made it; another operator's tasks drop it.
_resident: dict[str, dict] = {}


def resident(owner: str, key, make: Callable):
    """make(), kept in this worker while tasks of the same operator run."""
    for other in [k for k in _resident if k != owner]:
        del _resident[other]
    held = _resident.setdefault(owner, {})
    if key not in held:
        held[key] = make()
    return held[key]


def tidy(owner: str):
    """For functions of mapInArrow: other operators' tables go before, and freed memory goes back to the system after."""

    def wrap(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        @functools.wraps(f)
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            resident(owner, None, dict)
            try:
                yield from f(batches)
            finally:
                pa.default_memory_pool().release_unused()
                ctypes.CDLL(None).malloc_trim(0)

        return run

    return wrap
