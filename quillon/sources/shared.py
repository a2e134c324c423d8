"""Tables in the folder that the cluster shares, to end lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a folder of this machine is set only where none is, and only for a local master."""
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if held is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        held = tempfile.mkdtemp(prefix="checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(held)
    return held


def written(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """The rows from a table in the shared folder.  made: gets its path."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, folders: list[str]) -> None:
    """Delete tables of written() that nothing will read again; the list is emptied."""
    for f in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    folders.clear()
