"""Where intermediate tables go: a folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names; local runs fall back to /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/ctxforge/{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """The table, written and read back: what several later steps read is computed once, and a lost executor costs no lineage."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discarded(df: DataFrame) -> None:
    """Deletes a table that ``written`` gave, when every table made of it is written itself."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
