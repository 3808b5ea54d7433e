"""Frame pairs, poses along the gantry or along registrations, and clouds moved by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldscan.functions.geometry import IDENTITY, identity, inverse, moved, product, translation
from fieldscan.functions.scratch import many


def consecutive_pairs(frames: DataFrame) -> DataFrame:
    """Pairs of a frame and the next of its sequence; sequences of fewer than two frames have none."""
    ordered = W.partitionBy("sequence_id").orderBy("frame_index")
    out = frames.select("sequence_id", F.col("frame_index").alias("source_frame"), F.lead("frame_index").over(ordered).alias("target_frame"))
    return out.where("target_frame is not null")


def too_short(frames: DataFrame) -> DataFrame:
    """``sequence_id, problem`` of the sequences that can't make a pair."""
    few = frames.groupBy("sequence_id").agg(F.count("*").alias("n")).where("n < 2")
    return few.select("sequence_id", F.lit("need >= 2 frames").alias("problem"))


def init_transform(step_m: float, axis: int = 0) -> Column:
    """Where registration starts: identity, or a move by the expected step along the gantry's axis."""
    return translation(axis, F.lit(step_m)) if step_m else identity()


def step_per_pair(step_m: Column, sampling: Column | int) -> Column:
    return step_m * sampling


def kinematic_pose(frames: DataFrame, step_m: float, axis: int = 0) -> DataFrame:
    """``pose`` (camera to world) and ``extrinsic`` by position in the sequence: frame i stands i steps along the axis."""
    place = F.row_number().over(W.partitionBy("sequence_id").orderBy("frame_index")) - 1
    out = frames.withColumn("pose", translation(axis, place * F.lit(step_m)))
    return out.withColumn("extrinsic", inverse(F.col("pose")))


def position_pose(frames: DataFrame, positions: DataFrame, axis: int = 0) -> DataFrame:
    """Poses from recorded positions, counted from the sequence's first."""
    joined = frames.join(positions.select("sequence_id", "frame_index", "position_m"), ["sequence_id", "frame_index"])
    first = F.first("position_m").over(W.partitionBy("sequence_id").orderBy("frame_index").rowsBetween(W.unboundedPreceding, 0))
    return joined.withColumn("pose", translation(axis, F.col("position_m") - first))


BLOCK = 64


def pose_chain(steps: DataFrame) -> DataFrame:
    """``pose`` of accepted frames: the product of all transforms T from the first accepted frame (identity) up to each.

    A prefix product in blocks: products inside blocks of BLOCK frames, then over the blocks' totals, then both
    together, so a sequence of n frames costs n * BLOCK products and no long array per row.
    """
    ordered = W.partitionBy("sequence_id").orderBy("frame_index")
    rows = steps.withColumn("at", F.row_number().over(ordered) - 1)
    rows = rows.withColumn("T", F.when(F.col("at") == 0, identity()).otherwise(F.col("T"))).withColumn("block", F.expr(f"at div {BLOCK}"))
    one = F.array(*[F.lit(x) for x in IDENTITY])
    multiply = lambda column: F.aggregate(column, one, lambda a, b: product(a, b))
    inside = W.partitionBy("sequence_id", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("local", multiply(F.collect_list("T").over(inside)))
    totals = rows.groupBy("sequence_id", "block").agg(F.max_by("local", "at").alias("total"))
    before = W.partitionBy("sequence_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("start", multiply(F.collect_list("total").over(before)))
    out = rows.join(many(totals.select("sequence_id", "block", "start")), ["sequence_id", "block"])
    return out.withColumn("pose", product(F.col("start"), F.col("local"))).drop("at", "block", "local", "start")


def transform_points(points: DataFrame, poses: DataFrame, pose: str = "pose", on: list[str] | None = None) -> DataFrame:
    """Points in the frame of ``poses``; frames without a pose are left out."""
    on = ["sequence_id", "frame_index"] if on is None else on
    joined = points.join(many(poses.select(*on, F.col(pose).alias("__t"))), on)
    x, y, z = moved(F.col("__t"), F.col("x"), F.col("y"), F.col("z"))
    return joined.withColumns({"x": x, "y": y, "z": z}).drop("__t")


def merge_clouds(points: DataFrame, poses: DataFrame) -> DataFrame:
    """All points of accepted frames in one cloud per sequence: no deduplication and no downsampling."""
    return transform_points(points, poses)


#: Parameters by kind of capture.
PRESETS = {
    "icl": {"depth_scale": 5000.0, "depth_trunc": 4.0, "voxel_size": 0.02, "max_iter": 30, "erode": True, "inpaint": True, "known_poses": False, "step_m": 0.0},
    "own": {"depth_scale": 1000.0, "depth_trunc": 3.5, "voxel_size": 0.005, "max_iter": 80, "erode": False, "inpaint": False, "known_poses": True, "step_m": 0.00127},
}
QUALITY_TRUNC = 4.0


def preset_params(paths: DataFrame, path: str = "path") -> DataFrame:
    """Processing parameters of each path: those of the public sequences if it contains ``icl``, else our own."""
    icl = F.lower(F.col(path)).contains("icl")
    columns = {k: F.when(icl, F.lit(PRESETS["icl"][k])).otherwise(F.lit(PRESETS["own"][k])) for k in PRESETS["icl"]}
    return paths.withColumns(columns).withColumn("quality_trunc", F.lit(QUALITY_TRUNC))
