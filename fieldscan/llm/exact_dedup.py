"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Sorting the blocks gives every distinct block an integer name;
then adjacent names are paired and the pairs are named in the same way, until each document has one name. Names stand
for equal content because they come from comparing it, so an identity (level, name) is free of collisions.

The content of a block is shuffled once. Blocks that are a large share of all rows are first counted by hash; there are
at most ``HEAVY_SHARE`` of them, they are named by a small distinct and their rows take the name from a broadcast, so
no task gets all copies of one block. Pairs are pre-aggregated to distinct pairs before they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HEAVY_LEAST, HEAVY_SHARE, ascii_lower, cut, join_heads, numbered, shuffle_partitions, text_or_empty

BLOCK_BYTES = 4096
#: Stands for the missing right half of an odd tail; no name has this value.
NO_NAME = -(1 << 62)


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, rid: str | None) -> DataFrame:
    rows = docs.select(
        (F.monotonically_increasing_id() if rid is None else F.col(rid)).alias("rid"),
        F.col(id_col).alias("doc_id"),
        ascii_lower(text_or_empty(F.col(text_col))).cast("binary").alias("body"),
    )
    last = f"cast(greatest(ceil(octet_length(body) / {block_bytes}D), 1) as int) - 1"
    cuts = rows.select(
        "rid",
        "doc_id",
        F.sha2("body", 256).alias("sha"),
        F.expr(f"transform(sequence(0, {last}), i -> substring(body, i * {block_bytes} + 1, {block_bytes}))").alias("parts"),
    )
    return cuts.select("rid", "doc_id", "sha", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "block"))


def _ranked(distinct: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """Integer names for the distinct rows of ``keys``: the rank in a hash class, spread so that classes don't meet."""
    cls = F.pmod(F.hash(*keys), F.lit(groups))
    rank = F.dense_rank().over(W.partitionBy("cls").orderBy(*keys)).cast("long")
    return distinct.withColumn("cls", cls).withColumn("name", rank * groups + F.col("cls")).drop("cls")


def name_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, rid: str | None = None
) -> DataFrame:
    """One row per input row: ``rid`` (long, unique), ``doc_id``, ``sha`` (of the normalised text), ``level``, ``name``.

    ``rid`` names a column of stored row numbers; without one, numbers are given, once, in the job that names the blocks.

    Two rows have equal (level, name) if and only if their texts are equal after lower-casing A to Z. Null text counts
    as empty, which is one empty block. Repeated rows and null ids are rows like others.
    """
    spark = docs.sparkSession
    blocks = _blocks(docs, id_col, text_col, block_bytes, rid)
    counts = cut(blocks.groupBy(F.xxhash64("block").alias("h")).agg(F.count("*").alias("c")), "block-counts")
    total = counts.agg(F.sum("c")).first()[0] or 0
    heavy = counts.where(F.col("c") >= max(HEAVY_LEAST, total / HEAVY_SHARE)).select("h")
    groups = 8 * max(shuffle_partitions(spark), total * block_bytes >> 26)

    if heavy.isEmpty():
        rows = blocks.withColumn("heavy_name", F.lit(None).cast("long"))
    else:
        content = blocks.select(F.xxhash64("block").alias("h"), "block").join(F.broadcast(heavy), "h").select("block").distinct()
        named = cut(content.withColumn("heavy_name", -F.row_number().over(W.orderBy("block")).cast("long")), "heavy-names")
        rows = blocks.join(F.broadcast(named), "block", "left")
        rows = rows.withColumn("block", F.when(F.col("heavy_name").isNull(), F.col("block")))
    cls = F.when(F.col("heavy_name").isNull(), F.pmod(F.xxhash64("block"), F.lit(groups))).otherwise(F.pmod(F.col("rid"), F.lit(groups)))
    rank = F.dense_rank().over(W.partitionBy("cls").orderBy("block")).cast("long")
    rows = rows.withColumn("cls", cls).withColumn("name", F.coalesce("heavy_name", rank * groups + F.col("cls")))
    first = F.col("pos") == 0
    level = cut(
        rows.select("rid", "pos", "n", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"), "name"),
        "block-names",
    )

    def done(df: DataFrame, depth: int) -> DataFrame:
        return df.where("n = 1").select("rid", "doc_id", "sha", F.lit(depth).alias("level"), "name")

    depth, most = 0, level.agg(F.max("n")).first()[0] or 1
    out = done(level, 0)
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = (
            level.where("n > 1")
            .groupBy("rid", F.expr("cast(pos div 2 as int)").alias("pos"))
            .agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NO_NAME)).alias("b"),
                F.max("doc_id").alias("doc_id"),
                F.max("sha").alias("sha"),
                F.expr("cast(max(n) + 1 as int) div 2").cast("int").alias("n"),
            )
        )
        pairs = cut(pairs, "pairs")
        distinct = pairs.groupBy("a", "b").agg(F.count("*").alias("rows_of_key"))
        names = cut(_ranked(distinct, ["a", "b"], 8 * shuffle_partitions(spark)), "names")
        level = cut(join_heads(pairs, names, ["a", "b"], "rows_of_key").select("rid", "pos", "n", "doc_id", "sha", "name"), "pair-names")
        out = out.unionByName(done(level, depth))
    return out


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, rid: str | None = None
) -> DataFrame:
    """One row per document: ``rid, doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays; null ids come last, and of rows with the same id one stays. An
    empty table gives no rows. Other columns of ``docs`` are not read. ``rid`` as in ``name_documents``.
    """
    named = name_documents(docs, id_col, text_col, block_bytes, rid)
    best = cut(named.groupBy("level", "name").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count("*").alias("group_size")), "groups")
    return join_heads(named, best, ["level", "name"], "group_size").select(
        "rid",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns; an empty table stays empty."""
    rows, rid = numbered(docs)
    gone = exact_duplicates(rows, id_col, text_col, rid=rid).where("not kept").select(F.col("rid").alias(rid))
    return rows.join(gone, rid, "left_anti").drop(rid)
