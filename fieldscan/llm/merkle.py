"""Merkle manifests: hash trees over rows, and proofs by pointer jumping.

Rows are leaves of a tree for each value of a column, in the order of their ids, and the trees' tops are leaves of one top
tree. Places in a tree come from a range partition and the sizes of its parts, so no tree is sorted in one task. Levels are
made LEVELS at a time, by grouping 2**LEVELS consecutive nodes.

Every node points at its parent and holds the segment of siblings towards it: a byte that says on which side the sibling
stands, and its digest. Joining nodes with themselves by pointer doubles the distance to the ancestor and puts the segments
together. After k rounds only nodes whose level is a multiple of 2**k can be pointed at from below, so the tables shrink
fast (2**k levels hold 2**-(2**k) of the nodes); leaves take their steps of 1, 2, 4, ... levels from these tables, until
all have reached the root. A table of ancestors is broadcast only if it is small; of those that aren't, at most 2**(2**k)
leaves share a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, shuffle_partitions

LEVELS = 5
#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 16 << 20
#: Bytes of a step: the side (0 only child, 1 sibling behind, 2 sibling in front) and a digest.
STEP = 33


def leaf_digest(*fields: Column) -> Column:
    """SHA-256, as hex, of all fields: ``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``n``, the rows of their tree, ``tree_at``, its rank among all trees (null first), and ``pos`` in it."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_partitions(spark), F.asc_nulls_first(tree), *order).sortWithinPartitions(F.asc_nulls_first(tree), *order)
    dealt = cut(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "dealt")
    # a row for each tree and each partition's edge
    starts = cut(dealt.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("in_part")), "starts")
    sizes = starts.groupBy(tree).agg(F.sum("in_part").alias("n"), F.min("part").alias("part"), F.min("first").alias("first"))
    # trees by rank: trees that begin in a partition, behind those that begin in partitions before it
    begun = sizes.groupBy("part").agg(F.count("*").alias("trees"))
    before = begun.select("part", (F.sum("trees").over(W.orderBy("part")) - F.col("trees")).alias("trees"))  # a row per partition
    rank = F.row_number().over(W.partitionBy("part").orderBy("first")) - 1
    sizes = sizes.withColumn("rank", rank).join(F.broadcast(before), "part").select(F.col(tree).alias("same"), "n", (F.col("trees") + F.col("rank")).alias("tree_at"))
    ahead = F.sum("in_part").over(W.partitionBy(tree).orderBy("part")) - F.col("in_part")
    starts = starts.withColumn("ahead", ahead).join(sizes, F.col(tree).eqNullSafe(F.col("same")))
    starts = cut(starts.select("same", F.col("part").alias("of_part"), "first", "ahead", "n", "tree_at"), "starts")
    out = dealt.join(_small(starts, 100), (F.col("part") == F.col("of_part")) & F.col(tree).eqNullSafe(F.col("same")))
    return out.withColumn("pos", F.col("ahead") + F.col("at") - F.col("first")).drop("part", "of_part", "same", "at", "first", "ahead")


def _levels(nodes: DataFrame, base: int) -> DataFrame:
    """Nodes (t, n, pos, digest, payload) of level ``base`` and LEVELS - 1 above it, with siblings; and those of the next level, ``open``."""
    rows = nodes.groupBy("t", "n", F.shiftright("pos", LEVELS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "payload"))).alias("kids"))
    # level by level; digests are hex text here, as they are hashed so
    rows = rows.withColumn("a0", F.transform("kids", lambda k: F.lower(F.hex(k["digest"]))))
    made = []
    for i in range(LEVELS + 1):
        level = base + i
        count = F.expr(f"(n + {(1 << level) - 1}) div {1 << level}")
        a = f"a{i}"
        if i < LEVELS:
            pairs = F.expr(f"transform(sequence(0, (size({a}) - 1) div 2), i -> sha2(concat({a}[2 * i], coalesce(get({a}, 2 * i + 1), '')), 256))")
            rows = rows.withColumn(f"a{i + 1}", F.when((F.size(a) > 0) & (count > 1), pairs).otherwise(F.array().cast("array<string>")))
        side = f"CASE WHEN {1 if i == LEVELS else 0} = 1 OR (n + {(1 << level) - 1}) div {1 << level} = 1 THEN NULL WHEN i % 2 = 1 THEN 2 WHEN i + 1 < size({a}) THEN 1 ELSE 0 END"
        sibling = f"unhex(get({a}, CASE WHEN i % 2 = 1 THEN i - 1 ELSE i + 1 END))"
        payload = "kids[i].payload" if base + i == 0 else "null"
        made.append(F.expr(
            f"transform({a}, (x, i) -> named_struct('level', {level}, 'pos', block * {1 << (LEVELS - i)} + i, 'digest', unhex(x), 'side', {side},"
            f" 'sibling', {sibling}, 'open', {'true' if i == LEVELS else 'false'}, 'payload', {payload}))"
        ))
    return rows.select("t", "n", F.explode(F.flatten(F.array(*made))).alias("x")).select("t", "n", "x.*")


def grow(leaves: DataFrame) -> DataFrame:
    """All nodes of all trees: (t, n, level, pos, digest, side, sibling, payload), from leaves (t, n, pos, digest, payload).

    ``side`` is null at a tree's top. A tree of n leaves has as many levels as halving n, rounded up, takes to reach one.
    """
    base, out = 0, None
    while True:
        made = cut(_levels(leaves, base), "nodes")
        whole = made.where(f"not open or (n + {(1 << (base + LEVELS)) - 1}) div {1 << (base + LEVELS)} = 1").drop("open")
        out = whole if out is None else out.unionByName(whole)
        leaves = made.where(f"open and (n + {(1 << (base + LEVELS)) - 1}) div {1 << (base + LEVELS)} > 1").select("t", "n", "pos", "digest", "payload")
        base += LEVELS
        if leaves.isEmpty():
            return out


def jumped(rows: DataFrame, ancestors: DataFrame, row_bytes: int) -> DataFrame:
    """``rows`` with their pointer replaced by that of the node it points at, and the segments put together.

    Rows that have reached the root point at no node (ut is -1, with a place of their own, so they don't meet in a join).
    """
    to = ancestors.select(F.col("t").alias("ut"), F.col("level").alias("ul"), F.col("pos").alias("up"), F.struct("ut", "ul", "up", "steps").alias("next"))
    out = rows.join(_small(to, row_bytes), ["ut", "ul", "up"], "left")
    found = {c: F.coalesce(F.col(f"next.{c}"), F.col(c)) for c in ("ut", "ul", "up")}
    found["up"] = F.when(F.col("next.ut") == -1, F.xxhash64("t", "level", "pos")).otherwise(found["up"])
    found["steps"] = F.concat("steps", F.coalesce("next.steps", F.lit(b"")))
    return out.withColumns(found).select(*rows.columns)


def proofs(leaves: DataFrame, id_col: str, tree_col: str, digest_col: str) -> tuple[DataFrame, str | None]:
    """(rows, root): ``leaves`` with all their columns and ``steps``, the siblings from the leaf to the root, and ``subroot_at``,
    the number of steps that lead to the top of its own tree; and the root as hex text, None without leaves.

    Leaves ascend by id in each tree, null ids first; equal ids ascend by digest, and rows equal in both have equal
    digests, so it doesn't matter which comes first. ``digest_col`` is hex text. A null tree is a tree of its own.
    """
    rows = leaves.select(F.col(tree_col).alias("tree"), F.col(id_col).alias("id"), F.unhex(digest_col).alias("digest"), F.struct(*leaves.columns).alias("payload"))
    rows = cut(rows, "leaves")
    if rows.isEmpty():
        none = leaves.select(*leaves.columns, F.lit(None).cast("binary").alias("steps"), F.lit(0).alias("subroot_at"))
        return none, None
    at = placed(rows, "tree", ["id", "digest"])
    nodes = grow(at.select((F.col("tree_at") + 1).alias("t"), "n", "pos", "digest", "payload"))
    tops = cut(nodes.where("side is null").select(F.col("t") - 1, "digest", "level").toDF("pos", "digest", "levels"), "tops")
    trees, deepest = tops.agg(F.count("*"), F.max("levels")).first()
    upper = grow(tops.select(F.lit(0).cast("long").alias("t"), F.lit(trees).alias("n"), "pos", "digest", F.lit(None).cast(rows.schema["payload"].dataType).alias("payload")))
    root = upper.where("side is null").select(F.lower(F.hex("digest"))).first()[0]

    top, is_root = F.col("side").isNull(), F.col("side").isNull() & (F.col("t") == 0)
    steps = F.when(top, F.lit(b"")).otherwise(F.concat(F.unhex(F.lpad(F.hex(F.col("side")), 2, "0")), F.coalesce("sibling", F.lit(bytes(STEP - 1)))))
    pointed = nodes.unionByName(upper).select(
        "t", "n", "level", "pos", "payload", steps.alias("steps"),
        F.when(is_root, F.lit(-1)).when(top, F.lit(0)).otherwise(F.col("t")).cast("long").alias("ut"),
        F.when(is_root | ~top, F.col("level") + 1).otherwise(F.lit(0)).cast("int").alias("ul"),
        F.when(is_root, F.col("pos")).when(top, F.col("t") - 1).otherwise(F.shiftright("pos", 1)).cast("long").alias("up"),
    )
    inner = pointed.where("t = 0 or level > 0").drop("n", "payload")
    out = pointed.where("t > 0 and level = 0")
    longest, reach, table = deepest + 1 + max(0, (trees - 1).bit_length()), 1, inner
    while True:
        out = jumped(out, table, STEP * reach + 64)
        if 2 * reach > longest:
            break
        table = cut(jumped(table.where(f"t = 0 or level % {2 * reach} = 0"), table, STEP * reach + 64), "ancestors")
        reach *= 2
    levels = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))  # halvings of n, rounded up
    return out.select("payload.*", "steps", levels.alias("subroot_at")), root


def fold(digest: Column, steps: Column, first: Column | int, last: Column) -> Column:
    """The digest (hex text) after the steps ``first`` (from 0) to before ``last``."""
    first = first if isinstance(first, Column) else F.lit(first)

    def one(h: Column, i: Column) -> Column:
        side, other = F.substring(steps, i * STEP + 1, F.lit(1)), F.lower(F.hex(F.substring(steps, i * STEP + 2, F.lit(STEP - 1))))
        return F.sha2(F.when(side == F.lit(b"\0"), h).when(side == F.lit(b"\1"), F.concat(h, other)).otherwise(F.concat(other, h)), 256)

    at = F.when(first < last, F.sequence(first.cast("int"), last.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, digest, one)


def n_steps(steps: Column) -> Column:
    return (F.octet_length(steps) / STEP).cast("int")


def siblings(steps: Column) -> Column:
    """The siblings' digests as hex text, put together from the leaf to the root."""
    n = n_steps(steps)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    one = lambda i: F.when(F.substring(steps, i * STEP + 1, F.lit(1)) == F.lit(b"\0"), F.lit("")).otherwise(F.lower(F.hex(F.substring(steps, i * STEP + 2, F.lit(STEP - 1)))))
    return F.array_join(F.transform(at, one), "")
