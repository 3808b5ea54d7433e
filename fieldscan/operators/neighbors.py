"""Neighbourhoods of points as cell-bucketed range joins, and what is computed from them.

Points are keyed by (sequence_id, frame_index, point_id). A cell twice as wide as the radius makes a distance join an
equi-join with the 8 cells that a ball can touch, so no pair of points further than two cells apart is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldscan.functions.scratch import ROWS, many, parts_for, stored

FRAME = ["sequence_id", "frame_index"]
POINT = [*FRAME, "point_id"]
#: What a radius is widened by for cells, and tasks at most that take the nearest of one key's points.
ROOM, PARTS = 1 + 1e-9, 8


def _cell(size: Column | float) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long").alias(f"c{c}") for c in "xyz"]


def _around() -> Column:
    steps = (0, 1)
    return F.array(*[F.struct(*[F.lit(d).alias(n) for n, d in zip("ijk", (i, j, k))]) for i in steps for j in steps for k in steps])


def voxel_downsample(points: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """Mean position and colour of the points of each voxel; the grid starts half a voxel below the cloud's minimum."""
    keys = FRAME if keys is None else keys
    low = stored(points.groupBy(*keys).agg(*[(F.min(c) - size / 2).alias(f"low_{c}") for c in "xyz"], F.count("*").alias("n_points")), "low")
    parts = parts_for(points.sparkSession, low.agg(F.sum("n_points")).first()[0] or 0)
    at = [F.floor((F.col(c) - F.col(f"low_{c}")) / size).cast("long").alias(f"i{c}") for c in "xyz"]
    means = [c for c in ("x", "y", "z", "r", "g", "b") if c in points.columns]
    placed = points.select(*keys, *means).repartition(parts, *keys).join(many(low.drop("n_points")), keys)
    out = placed.select(*keys, *at, *means).groupBy(*keys, "ix", "iy", "iz")
    return out.agg(*[F.avg(c).alias(c) for c in means], F.count("*").alias("n"))


def square(radius: Column | float) -> Column | float:
    """The square of a number as it is written, rounded once: that of 0.2 is 0.04, where 0.2 * 0.2 is a bit more."""
    return radius * radius if isinstance(radius, Column) else float(Decimal(repr(float(radius))) ** 2)


def neighbor_pairs(points: DataFrame, others: DataFrame, radius: Column | float, on: list[str] | None = None, most: Column | float | None = None, cells: bool = False) -> DataFrame:
    """(point, other) within ``radius``, with squared distance d2. Rows of ``others`` come with prefix o_.

    ``on`` has the columns that both sides share (a frame, or a pair of frames). A radius that is a column stands in both
    sides, with one value for each key. ``most`` is the greatest squared distance, by default the ``square`` of the radius.
    With ``cells`` the cell in which the two met is kept as qx, qy, qz.
    """
    on = FRAME if on is None else on
    # a little more than the radius, for what rounding adds to a distance
    reach = radius * ROOM
    left = points.withColumn("near", F.explode(_around())).withColumns({f"q{c}": F.floor((F.col(c) - reach) / (2 * reach)).cast("long") + F.col(f"near.{n}") for c, n in zip("xyz", "ijk")}).drop("near")
    right = others.select(*on, *[F.floor(F.col(c) / (2 * reach)).cast("long").alias(f"q{c}") for c in "xyz"], *[F.col(c).alias(f"o_{c}") for c in others.columns if c not in on])
    d2 = sum(((F.col(c) - F.col(f"o_{c}")) * (F.col(c) - F.col(f"o_{c}")) for c in "xyz"), F.lit(0.0))
    out = left.join(many(right), [*on, "qx", "qy", "qz"]).withColumn("d2", d2).where(F.col("d2") <= (square(radius) if most is None else most))
    return out if cells else out.drop("qx", "qy", "qz")


def radius_neighbors(points: DataFrame, radius: float) -> DataFrame:
    """All ordered pairs of a frame within ``radius``, a point with itself included."""
    return neighbor_pairs(points, points, radius, most=radius * radius)


def usual_spacing(points: DataFrame, k: int) -> float:
    """A radius that holds about k points in a typical frame: one number over all frames.

    Points that lie on a line, a plane or in a volume are as far apart as their length, area or volume has it; for what has
    fewer dimensions than that, the guess is too small, so the largest of the three is taken.
    """
    a, b, c = (F.sort_array(F.array(*[F.greatest(F.max(c) - F.min(c), F.lit(1e-6)) for c in "xyz"]), False)[i] for i in range(3))
    share = k / F.count("*")
    guess = F.greatest(a * share, F.sqrt(a * b * share), F.pow(a * b * c * share, 1 / 3))
    one = points.groupBy(*FRAME).agg(guess.alias("s")).agg(F.percentile_approx("s", F.lit(0.5))).first()[0]
    return float(one or 1.0)


def knn(points: DataFrame, k: int, start: float | None = None) -> DataFrame:
    """The k nearest points of the same frame, the point itself included; ties go to the lower id.

    Points whose k-th distance exceeds the cell are looked up again with cells twice as wide, until the cell covers
    the frame. Each round is one job for all frames; the rounds are bounded by the extent over ``start``, which is by
    default the spacing that the points' density suggests. A point without a place has no row.
    """
    points = points.where(sum((F.abs(c) for c in "xyz"), F.lit(0.0)) < float("inf"))
    box = points.groupBy(*FRAME).agg(F.sqrt(sum((F.pow(F.max(c) - F.min(c), 2) for c in "xyz"), F.lit(0.0))).alias("extent"))
    # stored, so no round makes the points anew; a point carries what the next round needs, so none is joined
    kept = [*POINT, "x", "y", "z", "extent"]
    placed = stored(points.join(many(box), FRAME).select(*kept), "placed")
    open_points, others, size, found = placed, placed.drop("extent"), float(start or usual_spacing(placed, k)), []
    point = W.partitionBy(*POINT)
    rank = F.row_number().over(point.orderBy("d2", "o_point_id"))
    while True:
        near = neighbor_pairs(open_points, others, size, most=size * size).select(*kept, "o_point_id", "d2").withColumn("rank", rank).where(F.col("rank") <= k)
        near = stored(near.withColumn("done", (F.count("*").over(point) >= k) | (F.col("extent") <= size)), "knn")
        found.append(near.where("done").select(*POINT, "o_point_id", "d2", "rank"))
        open_points = near.where("not done and rank = 1").select(*kept)
        if open_points.isEmpty():
            break
        size *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("rank", F.col("rank").cast("long"))


#: Halvings of a cell, at most: a cell of the deepest level is 1/256 of the radius wide.
DEEPEST = 8


def dense_levels(points: DataFrame, radius: float, most: int) -> list[DataFrame]:
    """Point ids by level: item L has the points whose cells of 2**-L of the radius and wider all hold more than ``most``.

    An octree without its nodes: only points of dense cells go on to the next level, and cells are counts by key.
    """
    out, rest = [], points.select(*POINT, "x", "y", "z")
    for level in range(DEEPEST):
        cell = _cell(radius / 2**level)
        keyed = rest.select("*", *cell)
        dense = keyed.groupBy(*FRAME, "cx", "cy", "cz").agg(F.count("*").alias("n")).where(F.col("n") > most).drop("n")
        if dense.isEmpty():
            break
        rest = stored(keyed.join(many(dense), [*FRAME, "cx", "cy", "cz"], "left_semi").drop("cx", "cy", "cz"), "dense")
        out.append(rest.select(*POINT))
    return out


def knn_hybrid(points: DataFrame, radius: float, max_nn: int) -> DataFrame:
    """Up to ``max_nn`` nearest points within ``radius``, the point itself included; ties go to the lower id.

    Cells adapt to the density: where a cell as wide as the radius holds many points, it is halved until it doesn't, and a
    point is looked up with the cells of its own level first. If those reach ``max_nn`` points within their width, these
    are the nearest; else the point goes on with cells twice as wide, at most as wide as the radius. So a dense cell's
    square is never made, and the pairs made grow with the points. What a point has besides its place comes to its nearest
    ones where they are ranked, not to each cell that it is looked up in.
    """
    rank = F.row_number().over(W.partitionBy(*POINT).orderBy("d2", "o_point_id"))
    placed, more = points.select(*POINT, "x", "y", "z"), [c for c in points.columns if c not in (*POINT, "x", "y", "z")]

    def best(some: DataFrame, size: float) -> DataFrame:
        near = neighbor_pairs(some, points, size).withColumn("rank", rank.cast("long")).where(F.col("rank") <= max_nn)
        return near.join(many(points.select(*POINT, *more)), POINT) if more else near

    levels, found, wide = dense_levels(points, radius, 2 * max_nn), [], None
    for level in range(len(levels), 0, -1):
        mine = levels[level - 1] if level == len(levels) else levels[level - 1].join(many(levels[level]), POINT, "left_anti")
        mine = mine if wide is None else mine.unionByName(wide)
        near = stored(best(placed.join(many(mine), POINT, "left_semi"), radius / 2**level), "near")
        full = near.where(F.col("rank") == max_nn).select(*POINT)
        found.append(near.join(many(full), POINT, "left_semi"))
        wide = stored(mine.join(many(full), POINT, "left_anti"), "wide")
    rest = placed if wide is None else placed.join(many(points.select(*POINT).join(many(levels[0]), POINT, "left_anti").unionByName(wide)), POINT, "left_semi")
    out = best(rest, radius)
    for more in found:
        out = out.unionByName(more)
    return out


def outlier_statistical(points: DataFrame, nb_neighbors: int, std_ratio: float, start: float | None = None) -> DataFrame:
    """Points whose mean distance to their neighbours is below the frame's mean + std_ratio * sample deviation."""
    mean = knn(points, nb_neighbors, start).groupBy(*POINT).agg(F.avg(F.sqrt("d2")).alias("mean_d"))
    positive = F.when(F.col("mean_d") > 0, F.col("mean_d"))
    limit = mean.groupBy(*FRAME).agg((F.avg(positive) + std_ratio * F.coalesce(F.stddev_samp(positive), F.lit(0.0))).alias("limit"))
    good = mean.join(limit, FRAME).where((F.col("mean_d") > 0) & (F.col("mean_d") < F.col("limit"))).select(*POINT)
    return points.join(many(good), POINT, "left_semi")


def outlier_radius(points: DataFrame, nb_points: int, radius: float) -> DataFrame:
    """Points with more than ``nb_points`` points within the radius, themselves counted."""
    good = radius_neighbors(points, radius).groupBy(*POINT).agg(F.count("*").alias("n")).where(F.col("n") > nb_points).select(*POINT)
    return points.join(many(good), POINT, "left_semi")


def renumbered(points: DataFrame, most: int = ROWS) -> DataFrame:
    """Point ids by position in the frame, for clouds that were made anew.

    Frames of more than ``most`` points, as a whole sequence's surface, are cut into ranges of position that are numbered
    apart, each from where the one before it ends.
    """
    points = stored(points, "cloud")
    sizes = points.groupBy(*FRAME).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    parts = parts_for(points.sparkSession, sizes["all"] or 0)
    if (sizes["most"] or 0) <= most:
        order = W.partitionBy(*FRAME).orderBy("x", "y", "z")
        return points.repartition(parts, *FRAME).withColumn("point_id", F.row_number().over(order).cast("long"))
    ranged = stored(points.repartitionByRange(max(parts, -(-sizes["all"] // most)), *FRAME, "x", "y", "z").withColumn("part", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(W.partitionBy(*FRAME).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    starts = ranged.groupBy(*FRAME, "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(before, F.lit(0))).drop("n")
    place = F.row_number().over(W.partitionBy(*FRAME, "part").orderBy("x", "y", "z"))
    out = ranged.repartition(parts, *FRAME, "part").withColumn("place", place).join(many(starts), [*FRAME, "part"])
    return out.withColumn("point_id", (F.col("place") + F.col("start")).cast("long")).select(*points.columns, "point_id")


def clean_output(points: DataFrame, nb_neighbors: int = 30, std_ratio: float = 1.5, voxel: float = 0.005) -> DataFrame:
    """Downsample, then drop statistical outliers. The older variant is (20, 2.0)."""
    return outlier_statistical(renumbered(voxel_downsample(points, voxel).drop("ix", "iy", "iz", "n")), nb_neighbors, std_ratio)


def clean_registration(points: DataFrame, nb_neighbors: int = 10, std_ratio: float = 0.4, nb_points: int = 20, radius: float = 0.05) -> DataFrame:
    """Statistical outliers, then sparse points; no downsampling, which would hide motion below a voxel."""
    return outlier_radius(outlier_statistical(points, nb_neighbors, std_ratio), nb_points, radius)


def covariances(neighbors: DataFrame) -> DataFrame:
    """Covariance of the neighbours of each point, as six sums about their mean, and their number."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    aggs = [F.covar_pop(f"o_{a}", f"o_{b}").alias(f"c{a}{b}") for a, b in pairs]
    return neighbors.groupBy(*POINT, "x", "y", "z").agg(F.count("*").alias("n"), *aggs)


def estimate_normals(points: DataFrame, radius: float, max_nn: int = 30) -> DataFrame:
    """``nx, ny, nz``: the direction of least variance among the neighbours; (0, 0, 1) with fewer than three.

    Only the 3x3 eigenvectors are Python, in batches.
    """
    if "nx" in points.columns:
        return points

    @F.pandas_udf("struct<nx:double,ny:double,nz:double>")
    def least(n: pd.Series, xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], 1).reshape(-1, 3, 3)
        v = np.linalg.eigh(np.nan_to_num(m))[1][:, :, 0]
        v[n.to_numpy() < 3] = (0.0, 0.0, 1.0)
        return pd.DataFrame(v, columns=["nx", "ny", "nz"])

    cov = covariances(knn_hybrid(points.select(*POINT, "x", "y", "z"), radius, max_nn))
    made = cov.select(*POINT, least("n", "cxx", "cxy", "cxz", "cyy", "cyz", "czz").alias("normal")).select(*POINT, "normal.*")
    return points.join(many(made), POINT)


def orient_normals(points: DataFrame) -> DataFrame:
    """Normals turned towards the frame's camera at the origin (not along a spanning tree of tangent planes)."""
    away = F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") > 0
    return points.withColumns({c: F.when(away, -F.col(c)).otherwise(F.col(c)) for c in ("nx", "ny", "nz")})


def nn_correspondence(source: DataFrame, target: DataFrame, radius: Column | float, on: list[str]) -> DataFrame:
    """Each source point with its nearest target point within ``radius``; ties go to the lower id. Target columns: o_*."""
    pairs = neighbor_pairs(source, target, radius, on, cells=True)
    first = [c for c in source.columns if c not in (*on, "point_id")]
    theirs = [f"o_{c}" for c in target.columns if c not in (*on, "point_id", "radius")]
    keep = [F.first(c).alias(c) for c in first]
    # the nearest of each cell where the join left it, then of each point; a key's points are in PARTS places, so sums by key are few rows
    near = pairs.groupBy(*on, "qx", "qy", "qz", "point_id").agg(*keep, F.min(F.struct("d2", "o_point_id", *theirs)).alias("best"))
    near = near.withColumn("part", F.pmod(F.xxhash64("point_id"), F.lit(PARTS))).repartition(*on, "part")
    best = near.groupBy(*on, "part", "point_id").agg(*keep, F.min("best").alias("best"))
    return best.select(*on, "point_id", *first, "best.*")


def registration_score(source: DataFrame, matched: DataFrame, on: list[str]) -> DataFrame:
    """fitness: matched share of the source; rmse over the matched; 0 for both without matches."""
    every = source.groupBy(*on).agg(F.count("*").alias("n_source"))
    got = matched.groupBy(*on).agg(F.count("*").alias("n_matched"), F.sqrt(F.avg("d2")).alias("rmse"))
    out = every.join(got, on, "left")
    return out.select(
        *on, (F.coalesce("n_matched", F.lit(0)) / F.col("n_source")).alias("fitness"), F.coalesce("rmse", F.lit(0.0)).alias("rmse"), F.coalesce("n_matched", F.lit(0)).alias("n_matched")
    )


def solve_least_squares(rows: DataFrame, keys: list[str], n: int, out: list[str]) -> DataFrame:
    """Solve the n x n normal equations kept as arrays ``ata`` and ``atb``, in batches; singular systems give zeros."""
    from pyspark.sql import types as T

    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(c, T.DoubleType()) for c in out])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            a = np.stack(batch["ata"].to_numpy()).reshape(-1, n, n)
            b = np.stack(batch["atb"].to_numpy())
            x = np.einsum("kij,kj->ki", np.linalg.pinv(a, rcond=1e-10, hermitian=True), b)
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(x, columns=out)], axis=1)

    return rows.select(*keys, "ata", "atb").mapInPandas(run, schema)


def color_gradient(points: DataFrame, radius: float, max_nn: int = 30) -> DataFrame:
    """``dx, dy, dz``: gradient of the grey level on the tangent plane (points need normals), by least squares."""
    grey = points.withColumn("grey", (F.col("r") + F.col("g") + F.col("b")) / 3)
    near = knn_hybrid(grey.select(*POINT, *"xyz", "grey", "nx", "ny", "nz"), radius, max_nn).where(F.col("point_id") != F.col("o_point_id"))
    # neighbours are projected on the plane through the point
    off = sum(((F.col(f"o_{c}") - F.col(c)) * F.col(f"n{c}") for c in "xyz"), F.lit(0.0))
    near = near.withColumn("off", off)
    near = near.withColumns({f"e{c}": F.col(f"o_{c}") - F.col("off") * F.col(f"n{c}") - F.col(c) for c in "xyz"}).withColumn("eg", F.col("o_grey") - F.col("grey"))
    sums = [F.sum(F.col(f"e{a}") * F.col(f"e{b}")) for a in "xyz" for b in "xyz"]
    # the normal direction is held at zero by one more equation, weighted by the number of neighbours
    n = F.count("*").cast("double")
    held = [n * n * F.first(f"n{a}") * F.first(f"n{b}") for a in "xyz" for b in "xyz"]
    system = near.groupBy(*POINT).agg(F.array(*[s + h for s, h in zip(sums, held)]).alias("ata"), F.array(*[F.sum(F.col(f"e{a}") * F.col("eg")) for a in "xyz"]).alias("atb"))
    solved = solve_least_squares(system, POINT, 3, ["dx", "dy", "dz"])
    return points.join(many(solved), POINT, "left").fillna(0.0, ["dx", "dy", "dz"])
