"""Tables in the folder that driver and executors share, where iterative jobs cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task, by expectation, where partitions follow the rows.
ROWS = 1 << 18
#: Rows of a key and a transform, some 300 bytes each, up to which Spark may broadcast them.
FEW = 1 << 14
#: Whether a query's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder is set only where that is unset and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-fieldscan-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def many(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that is never broadcast, nor is the other one.

    Spark guesses the size of rows from their file, and so finds exploded pixels, clouds and stored keys far smaller than they
    are; a broadcast of them goes through the driver's memory.
    """
    return df.hint("merge")


def few_or_many(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a side of joins that is left to Spark while its ``rows`` are FEW, and else never broadcast."""
    return df if rows <= FEW else many(df)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back, so that the next round's plan starts at a file.

    What was shuffled for it isn't read again, so it leaves the disk at once and the rounds don't add up there.
    """
    path, conf = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    usual = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, usual)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: the usual number, or more where a task would have over ROWS, as what it sorts or groups would grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
