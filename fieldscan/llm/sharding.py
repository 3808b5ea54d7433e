"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` virtual nodes on a ring of ``RING`` cells. A row's key falls in a cell and belongs to the
next virtual node clockwise. A shard takes rows of its own cells up to its capacity; rows that find it full continue
clockwise to the next virtual node whose shard has room. With ``slack`` 0 the capacities add up to the number of rows,
so counts differ by one at most; more slack moves fewer rows when the number of shards changes.

Rows of a cell are interchangeable on the ring, so where they go follows from the count of each cell: the driver walks
the ring once over at most ``RING`` counts, whatever the size of the table. Ranks inside a cell are made in parts salted
by content, and equal rows in turns, so one key or one row with a third of all rows is not ranked in one task.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, text_or_empty

RING = 1 << 14
SALTS = 16


def ring_owners(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order; a cell may hold several."""
    nodes = ((int(hashlib.md5(f"shard {s} node {v}".encode()).hexdigest()[:4], 16) * RING >> 16, s) for s in range(shards) for v in range(vnodes))
    return sorted(nodes)


def capacities(total: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack:
        return [int(-(-total * (1 + slack) // shards))] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk_ring(counts: dict[int, int], shards: int, vnodes: int, slack: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) of all rows, given the number of rows in each cell."""
    nodes, free = ring_owners(shards, vnodes), capacities(sum(counts.values()), shards, slack)
    used, out = [0] * shards, []

    def put(cell: int, rank: int, n: int, shard: int) -> int:
        n = min(n, free[shard] - used[shard])
        if n:
            out.append((cell, rank, rank + n, shard, used[shard]))
            used[shard] += n
        return n

    over, at = [], 0
    for cell in sorted(counts):
        while at < len(nodes) and nodes[at][0] < cell:
            at += 1
        n = put(cell, 0, counts[cell], nodes[at % len(nodes)][1])
        if n < counts[cell]:
            over.append([cell, n, counts[cell] - n, at])
    waiting, over = deque(), deque(over)
    for step in range(2 * len(nodes) + 1):
        while over and over[0][3] <= step:
            waiting.append(over.popleft())
        shard = nodes[step % len(nodes)][1]
        while waiting and free[shard] > used[shard]:
            row = waiting[0]
            n = put(row[0], row[1], row[2], shard)
            row[1], row[2] = row[1] + n, row[2] - n
            if not row[2]:
                waiting.popleft()
    return out


def assign_shards(
    docs: DataFrame, shards: int = 40, vnodes: int = 64, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, shard, slot`` (gapless from 0 in each shard).

    The key is the id (null: the word null). Null text counts as empty: size 16, crc 0. Rows with one key may be on
    several shards, where a shard is full. Which of the rows of one cell move on follows their id, checksum and size, so
    files and splits of the table don't matter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = text_or_empty(F.col(text_col)).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    cell = (F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int") * RING / 65536).cast("int")
    content = ["doc_id", "text_crc32", "size"]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        cell.alias("cell"),
        # equal rows take turns, so that they aren't numbered in one task; which of them is which makes no difference
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("turn"),
    ).withColumn("salt", F.pmod(F.xxhash64(*content), F.lit(SALTS)).cast("int"))
    among = F.row_number().over(W.partitionBy(*content, "turn").orderBy("cell")).cast("long") - 1
    rows = cut(rows.withColumn("among", among), "ring-keys")
    # a part is what has one content and turn; parts stand in the order of their salt, content and turn in their cell
    sizes = rows.groupBy("cell", "salt", *content, "turn").agg(F.count("*").alias("n"))
    in_salt = W.partitionBy("cell", "salt").orderBy(*content, "turn").rowsBetween(W.unboundedPreceding, -1)
    sizes = cut(sizes.withColumn("start", F.coalesce(F.sum("n").over(in_salt), F.lit(0)).cast("long")), "ring-parts")
    before = W.partitionBy("cell").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("cell", "salt").agg(F.sum("n").alias("n"))
    parts = cut(parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")), "ring-counts")
    counts = {r["cell"]: r["n"] for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # RING rows at most
    runs = spark.createDataFrame(walk_ring(counts, shards, vnodes, slack), "cell int, lo long, hi long, shard int, first long")
    bases = sizes.join(parts.select("cell", "salt", "base"), ["cell", "salt"]).select(*[F.col(c).alias(f"p_{c}") for c in (*content, "turn")], (F.col("base") + F.col("start")).alias("first_rank"))
    same = F.lit(True)
    for c in (*content, "turn"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    ranked = rows.join(bases, same).withColumn("rank", F.col("first_rank") + F.col("among"))
    # runs: a row for each cell and for each virtual node that took overflow, so its size has a fixed bound
    inside = (ranked["cell"] == runs["cell"]) & (ranked["rank"] >= runs["lo"]) & (ranked["rank"] < runs["hi"])
    return ranked.join(F.broadcast(runs), inside).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("lo")).alias("slot")
    )
