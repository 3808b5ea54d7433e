"""Quality of captures: depth validity, pair metrics, verdicts, and the gantry's calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pixels import to_gray

FRAME = ["sequence_id", "frame_index"]
METRICS = ("depth_validity", "median_depth_m", "n_points", "icp_fitness", "icp_rmse", "rotation_deg")


@dataclass(frozen=True)
class QualityThresholds:
    """Failing and warning limits of the means."""

    fitness: tuple[float, float] = (0.3, 0.5)
    rmse: tuple[float, float] = (0.015, 0.005)
    validity: tuple[float, float] = (0.10, 0.30)
    rotation: tuple[float, float] = (5.0, 1.0)


@dataclass(frozen=True)
class QualityParams:
    """How the frames of a quality report are projected and registered."""

    bbox: tuple[int, int, int, int] | None = None
    depth_min_mm: int = 0
    erode: bool = False
    inpaint: bool = False
    depth_scale: float = 1000.0
    depth_trunc: float = 4.0
    voxel_size: float = 0.005
    max_iter: int = 50
    n_samples: int = 15


def depth_validity(pixels: DataFrame, trunc_mm: float) -> DataFrame:
    """Share of raw depths in (0, trunc_mm] of each frame, and their median (0 without any)."""
    good = (F.col("depth_raw") > 0) & (F.col("depth_raw") <= trunc_mm)
    return pixels.groupBy(*FRAME).agg(
        F.avg(good.cast("double")).alias("depth_validity"),
        F.coalesce(F.percentile(F.when(good, F.col("depth_raw")), F.lit(0.5)), F.lit(0.0)).alias("median_depth"),
    )


def depth_profile(pixels: DataFrame) -> DataFrame:
    """Count and percentage of positive depths, least, median and greatest, of each sequence's middle frame."""
    frames = pixels.select(*FRAME).distinct()
    place = F.row_number().over(W.partitionBy("sequence_id").orderBy("frame_index")) - 1
    n = F.count("*").over(W.partitionBy("sequence_id"))
    middle = frames.withColumn("at", place).withColumn("n", n).where("at = n div 2").select(*FRAME)
    d = F.when(F.col("depth_raw") > 0, F.col("depth_raw"))
    return pixels.join(middle, FRAME).groupBy(*FRAME).agg(
        F.count(d).alias("n_valid"), (100.0 * F.count(d) / F.count("*")).alias("percent"), F.min(d).alias("least"), F.percentile(d, F.lit(0.5)).alias("median"), F.max(d).alias("greatest")
    )


def pair_metrics(pairs: DataFrame, validity: DataFrame, counts: DataFrame, registered: DataFrame, depth_scale: float | None = None) -> DataFrame:
    """Metrics of each pair (source_frame, target_frame): validity, median and points of the source, and the registration.

    The median becomes metres by 1000 whatever the scale, unless ``depth_scale`` is given. A pair with an empty cloud on
    either side is an error row, with zeros for its registration.
    """
    as_source = lambda df: df.withColumnRenamed("frame_index", "source_frame")
    out = pairs.join(as_source(validity), ["sequence_id", "source_frame"]).join(as_source(counts), ["sequence_id", "source_frame"], "left")
    full = counts.where("n_points > 0").select("sequence_id", F.col("frame_index").alias("target_frame"), F.lit(True).alias("full"))
    out = out.join(full, ["sequence_id", "target_frame"], "left")
    out = out.join(registered.select("sequence_id", "source_frame", "target_frame", "fitness", "rmse", "rotation_deg"), ["sequence_id", "source_frame", "target_frame"], "left")
    bad = (F.coalesce("n_points", F.lit(0)) == 0) | F.col("full").isNull()
    zero = lambda c: F.when(bad, F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))
    return out.select(
        "sequence_id", (F.row_number().over(W.partitionBy("sequence_id").orderBy("source_frame")) - 1).cast("long").alias("pair_index"),
        "depth_validity", (F.col("median_depth") / F.lit(float(depth_scale or 1000.0))).alias("median_depth_m"),
        F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"), zero(F.col("fitness")).alias("icp_fitness"), zero(F.col("rmse")).alias("icp_rmse"),
        zero(F.col("rotation_deg")).alias("rotation_deg"), F.when(bad, "empty cloud").otherwise("").alias("error"),
    )


def quality_aggregate(metrics: DataFrame) -> DataFrame:
    """Mean, median and quartiles of each metric over a sequence's rows without error; zeros where every row has one.

    A mean is the sum in the order of the pairs, by running totals, over their number: it is the same in every run to the last bit.
    """
    good = lambda m: F.when(F.col("error") == "", F.col(m).cast("double"))
    order = W.partitionBy("sequence_id").orderBy("pair_index", *METRICS)
    total = {f"{m}_total": F.sum(good(m)).over(order.rowsBetween(W.unboundedPreceding, 0)) for m in METRICS}
    rows = metrics.withColumns({"place": F.row_number().over(order)} | total)
    values = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), good(m).alias("value"), F.col(f"{m}_total").alias("total")) for m in METRICS]))
    rows = rows.select("sequence_id", "place", values)
    at = lambda q: F.coalesce(F.percentile("value", F.lit(q)), F.lit(0.0))
    mean = F.when(F.count("value") > 0, F.max_by("total", "place") / F.count("value"))
    return rows.groupBy("sequence_id", "metric").agg(F.coalesce(mean, F.lit(0.0)).alias("mean"), at(0.5).alias("median"), at(0.25).alias("p25"), at(0.75).alias("p75"))


def quality_verdict(aggregates: DataFrame, t: QualityThresholds = QualityThresholds(), places: int | None = 12) -> DataFrame:
    """``verdict`` (the worst of four bands on means) and ``failing`` of each sequence; no aggregate is FAIL ``no metrics``.

    Means count to ``places`` places: one that lies on a limit would else be judged by the order in which it was summed. None
    takes them as they are, which ``quality_aggregate`` sums in a fixed order.
    """
    mean = {m: F.max(F.when(F.col("metric") == m, F.col("mean"))) for m in METRICS}
    rows = aggregates.groupBy("sequence_id").agg(*[(v if places is None else F.round(v, places)).alias(k) for k, v in mean.items()])

    def level(value: Column, limits: tuple[float, float], above: bool) -> Column:
        fail, warn = (value > limits[0], value > limits[1]) if above else (value < limits[0], value < limits[1])
        return F.when(fail, 2).when(warn, 1).otherwise(0)

    levels = [
        ("icp_fitness", level(F.col("icp_fitness"), t.fitness, False)), ("icp_rmse", level(F.col("icp_rmse"), t.rmse, True)),
        ("depth_validity", level(F.col("depth_validity"), t.validity, False)), ("rotation_deg", level(F.col("rotation_deg"), t.rotation, True)),
    ]
    worst = F.greatest(*[x for _, x in levels])
    failing = F.array_compact(F.array(*[F.when(x > 0, F.lit(name)) for name, x in levels]))
    verdict = F.when(worst == 2, "FAIL").when(worst == 1, "WARN").otherwise("PASS")
    return rows.select("sequence_id", verdict.alias("verdict"), failing.alias("failing"))


def verdict_or_missing(sequences: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A verdict for every sequence, FAIL with ``no metrics`` where none could be made."""
    out = sequences.select("sequence_id").distinct().join(verdicts, "sequence_id", "left")
    return out.select("sequence_id", F.coalesce("verdict", F.lit("FAIL")).alias("verdict"), F.coalesce("failing", F.array(F.lit("no metrics"))).alias("failing"))


def quick_check(pairs: DataFrame, n_samples: int = 15, seed: int = 0, index: str = "pair_index") -> DataFrame:
    """Up to ``n_samples`` pairs of each sequence, uniformly by a seeded hash, so that a run can be repeated."""
    order = F.md5(F.concat_ws(" ", F.lit(str(seed)), F.col("sequence_id").cast("string"), F.col(index).cast("string")))
    return pairs.withColumn("__k", F.row_number().over(W.partitionBy("sequence_id").orderBy(order, index))).where(F.col("__k") <= n_samples).drop("__k")


def full_report(metrics: DataFrame, t: QualityThresholds = QualityThresholds()) -> DataFrame:
    """The verdict of every sequence over all its pairs, with the number of pairs and of errors."""
    sizes = metrics.groupBy("sequence_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("error") != "").alias("n_errors"))
    return quality_verdict(quality_aggregate(metrics), t, None).join(sizes, "sequence_id")


def fitness_band(fitness: Column) -> Column:
    return F.when(fitness >= 0.5, "green").when(fitness >= 0.1, "orange").otherwise("red")


def point_count(points: DataFrame) -> DataFrame:
    return points.groupBy(*FRAME).agg(F.count("*").alias("n_points"))


def frame_counters(registrations: DataFrame, count_recovered: bool = False) -> DataFrame:
    """Successes and failures of each sequence. RECOVERED counts as a failure unless ``count_recovered``."""
    good = F.col("status").isin("OK", "RECOVERED") if count_recovered else F.col("status") == "OK"
    return registrations.groupBy("sequence_id").agg(F.count_if(good).alias("n_ok"), F.count_if(~good).alias("n_failed"))


def outcome_summary(registrations: DataFrame) -> DataFrame:
    """How many frames of each sequence ended with each status and reason."""
    return registrations.groupBy("sequence_id", "status", "reason").agg(F.count("*").alias("n_frames"))


def gantry_phase_shift(pixels: DataFrame, first: int = 0, second: int = 50) -> DataFrame:
    """(sx, sy, response) between two frames of each sequence by phase correlation of their grey levels.

    Frames count by position; sequences without the second frame are left out. One pair of images per group.
    """
    place = pixels.select(*FRAME).distinct().withColumn("at", F.row_number().over(W.partitionBy("sequence_id").orderBy("frame_index")) - 1)
    two = place.where(F.col("at").isin(first, second))
    grey = pixels.join(two, FRAME).select("sequence_id", "at", "u", "v", to_gray(F.col("r"), F.col("g"), F.col("b")).alias("grey"))

    def shift(group: pd.DataFrame) -> pd.DataFrame:
        if group["at"].nunique() < 2:
            return pd.DataFrame(columns=["sequence_id", "sx", "sy", "response"])
        h, w = group["v"].max() + 1, group["u"].max() + 1
        images = []
        for at in (first, second):
            x = group[group["at"] == at]
            image = np.zeros((h, w))
            image[x["v"], x["u"]] = x["grey"]
            images.append(np.fft.fft2(image))
        cross = images[1] * np.conj(images[0])
        surface = np.real(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12)))
        py, px = np.unravel_index(np.argmax(surface), surface.shape)
        near = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)]
        weights = np.array([max(surface[(py + dy) % h, (px + dx) % w], 0.0) for dy, dx in near])
        offset = (weights[:, None] * np.array(near)).sum(0) / max(weights.sum(), 1e-12)
        sy, sx = [p + o - n if p + o > n / 2 else p + o for p, o, n in zip((py, px), offset, (h, w))]
        return pd.DataFrame({"sequence_id": [group["sequence_id"].iloc[0]], "sx": [float(sx)], "sy": [float(sy)], "response": [float(weights.sum())]})

    schema = f"sequence_id {pixels.schema['sequence_id'].dataType.simpleString()}, sx double, sy double, response double"
    return grey.groupBy("sequence_id").applyInPandas(shift, schema)


def gantry_axis_step(shifts: DataFrame, median_depth_mm: DataFrame, fx: float, fy: float, frames_between: int = 50) -> DataFrame:
    """Axis, pixels and metres per frame, and direction, from a shift over ``frames_between`` frames.

    ``median_depth_mm`` has (sequence_id, median_depth), null where no depth is between 100 and 5000: then no estimate.
    """
    out = shifts.join(median_depth_mm, "sequence_id", "left")
    along_x = F.abs("sx") >= F.abs("sy")
    px = F.when(along_x, F.col("sx")).otherwise(F.col("sy")) / frames_between
    focal = F.when(along_x, F.lit(float(fx))).otherwise(F.lit(float(fy)))
    return out.select(
        "sequence_id", F.when(along_x, "X").otherwise("Y").alias("axis"), px.alias("px_per_frame"),
        (F.abs(px) * F.col("median_depth") / 1000.0 / focal).alias("step_m"), F.when(px >= 0, 1).otherwise(-1).alias("direction"),
    )


def median_working_depth(pixels: DataFrame, low: int = 100, high: int = 5000) -> DataFrame:
    d = F.col("depth_raw")
    return pixels.groupBy("sequence_id").agg(F.percentile(F.when((d > low) & (d < high), d), F.lit(0.5)).alias("median_depth"))


def gantry_step_check(steps: DataFrame, expected_m: float = 0.038 / 30) -> DataFrame:
    """Ratio of the step to the expected one; suspect above 1.5 or below 0.5."""
    out = steps.withColumn("ratio", F.col("step_m") / F.lit(expected_m))
    return out.withColumn("suspect", (F.col("ratio") > 1.5) | (F.col("ratio") < 0.5))
