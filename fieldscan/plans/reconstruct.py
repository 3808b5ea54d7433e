"""Whole reconstructions of many sequences at once, as compositions of operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldscan.functions.geometry import Camera, identity, rotation_deg, translation_m
from fieldscan.functions.scratch import many, stored
from fieldscan.operators.agent import CONFIG, AgentConfig, attempt_scan, judge, simple_accept
from fieldscan.operators.neighbors import clean_registration, color_gradient, estimate_normals, outlier_statistical, renumbered, voxel_downsample
from fieldscan.operators.pixels import (
    clip_depth_mad, crop_bbox, crop_camera, erode_valid, fill_holes, mask_depth_range, project_points, undistort_bilinear, undistort_depth,
)
from fieldscan.operators.poses import consecutive_pairs, init_transform, kinematic_pose, merge_clouds, pose_chain
from fieldscan.operators.quality import (
    QualityParams, QualityThresholds, depth_validity, pair_metrics, point_count, quality_aggregate, quality_verdict, quick_check, verdict_or_missing,
)
from fieldscan.operators.registration import PAIR, feature_match, fpfh, icp_colored, pair_clouds, recover_feature_init, run_icp
from fieldscan.operators.volume import tsdf_extract, tsdf_integrate


def frame_clouds(
    pixels: DataFrame, camera: Camera, scale: float, trunc: float, near: int, erode: bool = False, inpaint: bool = False, bbox: tuple[int, int, int, int] | None = None
) -> DataFrame:
    """Undistorted, cropped, masked, eroded, filled and projected pixels, numbered by their place in the image."""
    out, camera = prepared(pixels, camera, scale, trunc, near, bbox)
    out = erode_valid(out) if erode else out
    out = fill_holes(out) if inpaint else out
    points = project_points(out, camera, scale, trunc)
    return points.withColumn("point_id", F.col("v").cast("long") * (1 << 20) + F.col("u")).drop("u", "v")


def prepared(pixels: DataFrame, camera: Camera, scale: float, trunc: float, near: int, bbox: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, Camera]:
    """(pixels, camera) without distortion, within the box, and with depth in range."""
    out = undistort_depth(undistort_bilinear(pixels, camera), camera) if any(camera.dist) else pixels
    if bbox is not None:
        out, camera = crop_bbox(out, bbox), crop_camera(camera, bbox)
    return mask_depth_range(out, trunc, scale, near), camera


def previous_pairs(frames: DataFrame) -> DataFrame:
    """Each frame (source) with the one before it (target)."""
    before = F.lag("frame_index").over(W.partitionBy("sequence_id").orderBy("frame_index"))
    return frames.select("sequence_id", F.col("frame_index").alias("source_frame"), before.alias("target_frame")).where("target_frame is not null")


def surfaces(clouds: DataFrame, voxel: float) -> DataFrame:
    """Clouds with grey levels, normals and gradients, ready for coloured registration."""
    grey = clouds.withColumn("grey", (F.col("r") + F.col("g") + F.col("b")) / 3)
    return stored(color_gradient(stored(estimate_normals(grey, 2 * voxel), "normals"), 2 * voxel), "surfaces")


def registration_attempts(
    asked: DataFrame, clouds: DataFrame, ready: DataFrame, voxel: float, max_iter: int, step_m: float = 0.0, axis: int = 0, config: AgentConfig = CONFIG
) -> DataFrame:
    """``T, fitness, rmse`` of every asked (pair, attempt): 0 is the first try, k the k-th strategy of ``config``.

    All pairs of all attempts go through one loop of ICP, on clouds whose frame number also says the attempt. ``ready`` are
    the clouds as ``surfaces`` gives them. A strategy that leaves an empty cloud gives fitness and rmse 0.
    """
    span, coarse, parts, changed, init = config.max_retries + 1, max(2 * voxel, 1e-4), [], [], None
    ends = asked.select("sequence_id", "attempt", F.explode(F.array("source_frame", "target_frame")).alias("frame_index")).distinct()
    named = lambda df, k, *cols: df.withColumns({c: F.col(c) * span + k for c in cols})
    plain = ["grey", "nx", "ny", "nz", "dx", "dy", "dz"]
    for k in sorted(r["attempt"] for r in asked.select("attempt").distinct().collect()):  # max_retries + 1 numbers at most
        strategy = config.recovery(k - 1) if k else None
        mine = ends.where(F.col("attempt") == k).select("sequence_id", "frame_index")
        base = (ready if strategy in (None, "reseed_init", "feature_init") else clouds).join(mine, ["sequence_id", "frame_index"], "left_semi")
        if strategy == "point_to_plane":
            base = estimate_normals(base.withColumn("grey", F.lit(0.0)), 4 * voxel).withColumns({c: F.lit(0.0) for c in plain[-3:]})
        elif strategy == "feature_init":
            sparse = stored(estimate_normals(renumbered(voxel_downsample(base.drop(*plain), coarse)), 2 * coarse), "sparse")
            pairs = asked.where(F.col("attempt") == k).select(*PAIR)
            matches = stored(feature_match(pairs, stored(fpfh(sparse, coarse), "features")), "matches")
            init = named(recover_feature_init(matches, sparse, coarse).select(*PAIR, F.col("T").alias("start")), k, *PAIR[1:])
        elif strategy not in (None, "reseed_init"):
            if strategy == "tighter_crop":
                base = clip_depth_mad(base)
            elif strategy == "voxel_downsample":
                base = renumbered(voxel_downsample(base, coarse))
            else:
                base = outlier_statistical(base, 30, 1.5)
            changed.append(named(base, k, "frame_index").select("sequence_id", "frame_index", "point_id", "x", "y", "z", "r", "g", "b"))
            continue
        parts.append(named(base, k, "frame_index").select("sequence_id", "frame_index", "point_id", "x", "y", "z", *plain))
    if changed:
        parts.append(surfaces(reduce(DataFrame.unionByName, changed), voxel).select("sequence_id", "frame_index", "point_id", "x", "y", "z", *plain))
    points = reduce(DataFrame.unionByName, parts)
    start = asked.select(PAIR[0], *[(F.col(c) * span + F.col("attempt")).alias(c) for c in PAIR[1:]])
    loose = F.pmod(F.col("source_frame"), F.lit(span)).isin([k for k in range(1, span) if config.recovery(k - 1) == "point_to_plane"])
    start = start.withColumns({"T": init_transform(step_m, axis), "radius": F.when(loose, 4.0 * voxel).otherwise(2.0 * voxel), "colored": ~loose})
    if init is not None:
        by_features = F.pmod(F.col("source_frame"), F.lit(span)).isin([k for k in range(1, span) if config.recovery(k - 1) == "feature_init"])
        start = start.join(init, PAIR, "left").withColumn("T", F.when(by_features, F.coalesce("start", identity())).otherwise(F.col("T"))).drop("start")
    start, points = stored(start, "asked"), stored(points, "attempt-clouds")
    source, target = pair_clouds(start, points)
    found = run_icp(start, source, target, max_iter)
    failed = stored(start.join(found.where("colored and fitness = 0").select(*PAIR), PAIR, "left_semi").withColumn("colored", F.lit(False)), "failed")
    if not failed.isEmpty():
        alike = [x.join(failed.select(*PAIR), PAIR, "left_semi") for x in (source, target)]
        found = found.join(failed.select(*PAIR), PAIR, "left_anti").unionByName(run_icp(failed, *alike, max_iter))
    own = [F.floor(F.col(c) / span).cast("long").alias(c) for c in PAIR[1:]]
    return found.select(PAIR[0], *own, F.pmod(F.col("source_frame"), F.lit(span)).cast("int").alias("attempt"), "T", "fitness", "rmse")


def register_sequences(
    clouds: DataFrame,
    voxel: float,
    max_iter: int,
    expected_step_m: float = 0.0,
    config: AgentConfig = CONFIG,
    axis: int = 0,
    most_rounds: int | None = None,
    frames: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """(sequence_id, frame_index, target, T, fitness, rmse, accepted, fallback, attempts, last_strategy, status, reason) of all frames.

    ``frames`` lists all frames with a ``problem`` or null; those without a point have the problem ``empty cloud``. Frames
    with a problem are FAILED. A frame's target is the last accepted frame, so pairs depend on verdicts, and so do
    retries, as limits adapt. All frames are first registered against the one before. After each scan all tries that it
    asks for (also against the targets a frame near a failing one may turn out to have) are made in one job a round of ICP,
    until no verdict wants another: the number of rounds follows the longest run of failing frames, not their number. With
    ``most_rounds`` the frames that are open then have the status UNDECIDED and aren't accepted. ``strict`` as in
    ``attempt_scan``.
    """
    seen = clouds.select("sequence_id", "frame_index").distinct().withColumn("has_points", F.lit(True))
    listed = seen.select("sequence_id", "frame_index", F.lit(None).cast("string").alias("problem")) if frames is None else frames.select("sequence_id", "frame_index", "problem")
    listed = listed.join(seen, ["sequence_id", "frame_index"], "left")
    listed = stored(listed.withColumn("problem", F.when(F.col("has_points").isNull(), F.coalesce("problem", F.lit("empty cloud"))).otherwise(F.col("problem"))).drop("has_points"), "frames")
    asked = stored(previous_pairs(listed.where("problem is null")).withColumn("attempt", F.lit(0)), "asked")
    ready, known, turn = surfaces(clouds, voxel), None, 0
    while True:
        if not asked.isEmpty():
            made = registration_attempts(asked, clouds, ready, voxel, max_iter, expected_step_m, axis, config)
            known = stored(made if known is None else known.unionByName(made), "registered")
        turn += 1
        if known is None:
            rows = listed.withColumn("tries", F.lit(None).cast("array<struct<target:long,attempt:int,fitness:double,rmse:double,translation_m:double,rotation_deg:double>>"))
        else:
            row = F.struct(F.col("target_frame").alias("target"), "attempt", "fitness", "rmse", translation_m(F.col("T")).alias("translation_m"), rotation_deg(F.col("T")).alias("rotation_deg"))
            tries = known.groupBy("sequence_id", F.col("source_frame").alias("frame_index")).agg(F.collect_list(row).alias("tries"))
            rows = listed.join(tries, ["sequence_id", "frame_index"], "left")
        judged = stored(attempt_scan(rows, expected_step_m, config, strict), "judged")
        asked = judged.select("sequence_id", F.col("frame_index").alias("source_frame"), F.explode("asks").alias("ask"))
        asked = stored(asked.select("sequence_id", "source_frame", F.col("ask.target").alias("target_frame"), F.col("ask.attempt").alias("attempt")), "asked")
        if turn == most_rounds or judged.where("wanted is not null").isEmpty():
            break
    # frames behind an open one of their sequence rest on its verdict
    before = W.partitionBy("sequence_id").orderBy("frame_index")
    judged = judged.withColumn("open", F.max(F.col("wanted").isNotNull()).over(before) & F.col("failed").isNull())
    if known is None:
        out = judged.withColumns({"T": identity(), "fitness": F.lit(None).cast("double"), "rmse": F.lit(None).cast("double")})
    else:
        taken = known.withColumnsRenamed({"source_frame": "frame_index", "target_frame": "target"})
        out = judged.join(taken, ["sequence_id", "frame_index", "target", "attempt"], "left")
    lost, start = F.col("failed").isNotNull(), F.col("target").isNull()
    status = F.when(lost, "FAILED").when(F.col("open"), "UNDECIDED").when(~F.col("accepted"), "REJECTED").when(F.col("attempt") > 0, "RECOVERED").otherwise("OK")
    via = F.lit(None).cast("string")
    for k in range(config.max_retries):
        via = F.when(F.col("attempt") == k + 1, config.recovery(k)).otherwise(via)
    out = out.withColumns({"fitness": F.when(lost, 0.0).when(start, 1.0).otherwise(F.col("fitness")), "rmse": F.when(lost | start, 0.0).otherwise(F.col("rmse")), "status": status})
    out = judge(out, expected_step_m, F.col("attempt"), F.col("min_fitness"), F.col("max_rmse"), config)
    return out.select(
        "sequence_id", "frame_index", "target", "T", "fitness", "rmse", (F.col("accepted") & ~F.col("open")).alias("accepted"), "fallback",
        F.col("attempt").alias("attempts"), via.alias("last_strategy"), "status", F.when(lost, F.col("failed")).when(F.col("status") == "REJECTED", F.col("reason")).otherwise("").alias("reason"),
    )


def reconstruct_icp(
    pixels: DataFrame, camera: Camera, scale: float, trunc: float, near: int = 0, voxel: float = 0.005, max_iter: int = 80, expected_step_m: float = 0.0, clean: bool = True,
    config: AgentConfig = CONFIG, axis: int = 0, most_rounds: int | None = None, erode: bool = False, inpaint: bool = False, bbox: tuple[int, int, int, int] | None = None,
    problems: DataFrame | None = None, strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(merged points, frame outcomes): project, clean, register with recovery, judge, chain the accepted poses and merge.

    ``problems`` (sequence_id, frame_index, problem) lists frames that could not be read; they become FAILED outcomes, as do
    frames without a point.
    """
    frames = pixels.select("sequence_id", "frame_index").distinct().withColumn("problem", F.lit(None).cast("string"))
    if problems is not None:
        frames = frames.join(problems, ["sequence_id", "frame_index"], "left_anti").unionByName(problems.select(*frames.columns))
    clouds = frame_clouds(pixels, camera, scale, trunc, near, erode, inpaint, bbox)
    clouds = stored(clean_registration(clouds) if clean else clouds, "clouds")
    outcomes = stored(register_sequences(clouds, voxel, max_iter, expected_step_m, config, axis, most_rounds, frames, strict), "outcomes")
    poses = pose_chain(outcomes.where("accepted").select("sequence_id", "frame_index", "T"))
    return merge_clouds(clouds, poses), outcomes


def reconstruct_simple(pixels: DataFrame, camera: Camera, scale: float, voxel: float = 0.005, max_iter: int = 50) -> tuple[DataFrame, DataFrame]:
    """The older way: register every frame against the one before, keep any match, merge. The first row is 0, 0, success."""
    clouds = stored(frame_clouds(pixels, camera, scale, 3.0, 0), "clouds")
    frames = clouds.select("sequence_id", "frame_index").distinct()
    found = icp_colored(previous_pairs(frames), clouds, voxel, max_iter, None, False)
    rows = frames.join(many(found.withColumnRenamed("source_frame", "frame_index")), ["sequence_id", "frame_index"], "left")
    rows = rows.withColumns({"fitness": F.coalesce("fitness", F.lit(0.0)), "rmse": F.coalesce("rmse", F.lit(0.0)), "real": F.col("frame_index")})
    place = F.row_number().over(W.partitionBy("sequence_id").orderBy("real")) - 1
    judged = stored(simple_accept(rows.withColumn("frame_index", place)).withColumn("frame_index", F.col("real")).drop("real"), "judged")
    poses = pose_chain(judged.where("accepted").select("sequence_id", "frame_index", "T"))
    return merge_clouds(clouds, poses), judged


def reconstruct_tsdf(
    pixels: DataFrame, camera: Camera, scale: float, trunc: float, near: int, voxel: float, step_m: float, axis: int = 0, clean: bool = True,
    bbox: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """Surface points of every sequence from poses along the gantry: integrate all frames, extract, clean.

    Distortion and the box count; erosion and filling don't belong to this way.
    """
    masked, camera = prepared(pixels, camera, scale, trunc, near, bbox)
    masked = stored(masked, "masked")
    poses = stored(kinematic_pose(masked.select("sequence_id", "frame_index").distinct(), step_m, axis), "poses")
    voxels = tsdf_integrate(masked, poses, camera, voxel, scale, trunc)
    surface = tsdf_extract(stored(voxels, "voxels"), voxel).withColumn("frame_index", F.lit(0).cast("long"))
    return clean_registration(renumbered(surface)) if clean else surface


def quality_report(
    pixels: DataFrame, camera: Camera, params: QualityParams = QualityParams(), thresholds: QualityThresholds = QualityThresholds(), sample: bool = False,
    pairs: DataFrame | None = None, sequences: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, metrics of pairs) from pixels: every frame with the next, or with ``sample`` n_samples pairs of each sequence.

    Validity counts raw depths of the whole image; points are those left of the box, eroded and filled. All pairs of all
    sequences are registered in one job a round. A sequence without a pair has the verdict FAIL. ``pairs`` and ``sequences`` are
    given where the pixels are those of some frames only.
    """
    frames = stored(pixels.select("sequence_id", "frame_index").distinct(), "frames")
    if pairs is None:
        pairs = consecutive_pairs(frames)
        pairs = stored(quick_check(pairs, params.n_samples, 0, "source_frame") if sample else pairs, "pairs")
    image, view = (pixels, camera) if params.bbox is None else (crop_bbox(pixels, params.bbox), crop_camera(camera, params.bbox))
    clouds = frame_clouds(image, view, params.depth_scale, params.depth_trunc, params.depth_min_mm, params.erode, params.inpaint)
    clouds = stored(clouds, "clouds")
    found = icp_colored(pairs, clouds, params.voxel_size, params.max_iter).withColumn("rotation_deg", rotation_deg(F.col("T")))
    metrics = pair_metrics(pairs, depth_validity(pixels, params.depth_trunc * params.depth_scale), point_count(clouds), found)
    metrics = stored(metrics, "metrics")
    return verdict_or_missing(frames if sequences is None else sequences, quality_verdict(quality_aggregate(metrics), thresholds, None)), metrics


def batch_sequences(points: DataFrame) -> DataFrame:
    """One row for each sequence of a batch, made in the one job that runs them all: its points and its box."""
    return points.groupBy("sequence_id").agg(
        F.count("*").alias("n_points"), *[f(c).alias(f"{name}_{c}") for c in "xyz" for f, name in ((F.min, "min"), (F.max, "max"))]
    )
