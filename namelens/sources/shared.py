"""Where written tables go so that the driver and all executors see them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``; where that is unset, in a local folder in a local session, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def small_parts(spark: SparkSession) -> None:
    """Lets a shuffle of few bytes keep as many partitions as there are cores: names are small, comparing them is not.

    Set in the session. Shuffles of more bytes are parted as they were. Written tables are far larger in memory than as files,
    which the planner is told, or it would gather tables that grow with the input in the driver to broadcast them.
    """
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "32")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table there: what reads it more than once neither computes nor plans it again."""
    small_parts(df.sparkSession)
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
