"""Helpers shared by the text operators: the shared scratch folder, lineage cuts, row numbers, hot keys and null-safe text."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy if it has at least one in so many of all rows; hence this bounds the number of heavy keys.
HEAVY_SHARE = 2048
HEAVY_LEAST = 1000
#: Rows of a stored table of narrow rows up to which Spark may broadcast it.
FEW = 1 << 17
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or the session's checkpoint folder.

    Where neither is set, a temporary one is made for a local master; on a cluster that would be a folder of the driver
    alone, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-fieldscan-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later jobs start there, also after a lost executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def many(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that is never broadcast, nor is the other one.

    Spark guesses the size of rows from their file and their columns' types, and so finds exploded, packed and long rows far
    smaller than they are; a broadcast of them goes through the driver's memory.
    """
    return df.hint("merge")


def few_or_many(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a side of joins that is left to Spark while its ``rows`` are FEW, and else never broadcast."""
    return df if rows <= FEW else many(df)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with marks behind it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str = "rid") -> tuple[DataFrame, str]:
    """``df`` written once with a number for each row, and the number's column, which clashes with no other.

    Numbers that are made anew by each scan differ when the splits do, and these follow the cores that are registered;
    written ones stay.
    """
    name = free_name(df, name)
    return cut(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def heavy_keys(counts: DataFrame, keys: list[str], count_col: str = "rows_of_key") -> DataFrame:
    """The keys with at least one in HEAVY_SHARE of all rows, hence HEAVY_SHARE rows at most, which may be broadcast.

    ``counts`` has one row for each key with its number of rows.
    """
    total = counts.agg(F.sum(count_col)).first()[0] or 0
    return counts.where(F.col(count_col) >= max(HEAVY_LEAST, total / HEAVY_SHARE)).select(*keys, count_col)


def join_heads(rows: DataFrame, heads: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    """``rows`` joined to ``heads``, one narrow row for each key that says how many rows the key has.

    Rows of heavy keys take their head from a broadcast of bounded size, so no task gets all rows of one key; the others
    are joined by key, by a shuffle, as heads may be as many as rows.
    """
    heavy = heavy_keys(heads, keys, count_col)
    if heavy.isEmpty():
        return rows.join(many(heads), keys)
    hot = F.broadcast(heads.join(F.broadcast(heavy.select(*keys)), keys, "left_semi"))
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(many(heads), keys))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A to Z only. ``lower`` has a fast path for ASCII, where the two agree."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, UPPER.lower()))
