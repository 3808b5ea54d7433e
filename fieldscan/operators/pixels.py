"""Pixels to points: cropping, masks, hole filling, undistortion, projection and colour filters.

``pixels`` has (sequence_id, frame_index, u, v, r, g, b, depth_raw), points have x, y, z and colours in [0, 1]. Windows
and joins are keyed by the frame, so frames spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscan.functions import tiles
from fieldscan.functions.geometry import Camera
from fieldscan.functions.scratch import many

FRAME = ["sequence_id", "frame_index"]


def pixels_explode(images: DataFrame, width: int, values: str = "values") -> DataFrame:
    """One row per pixel of dense images kept as arrays, row by row."""
    keep = [c for c in images.columns if c != values]
    out = images.select(*keep, F.posexplode(values).alias("pos", "value"))
    return out.select(*keep, (F.col("pos") % width).cast("int").alias("u"), F.expr(f"cast(pos div {width} as int)").alias("v"), "value")


def crop_bbox(pixels: DataFrame, bbox: tuple[int, int, int, int]) -> DataFrame:
    """Pixels with x1 <= u < x2 and y1 <= v < y2, counted from the corner. ``crop_camera`` gives the camera that fits."""
    x1, y1, x2, y2 = bbox
    inside = (F.col("u") >= x1) & (F.col("u") < x2) & (F.col("v") >= y1) & (F.col("v") < y2)
    return pixels.where(inside).withColumn("u", (F.col("u") - x1).cast("int")).withColumn("v", (F.col("v") - y1).cast("int"))


def crop_camera(camera: Camera, bbox: tuple[int, int, int, int], shift_pp: bool = True) -> Camera:
    """The camera after a crop. Without ``shift_pp`` (the older variant) the principal point stays."""
    return camera.shifted(bbox[0], bbox[1]) if shift_pp else camera


def normalize_color(value: Column) -> Column:
    """Colours in [0, 1] to 0..255, truncated."""
    return (value * 255).cast("int")


def mask_depth_range(pixels: DataFrame, trunc: float = 3.5, scale: float = 1000.0, min_mm: int = 0) -> DataFrame:
    """Depth beyond ``int(trunc * scale)``, or nearer than ``min_mm``, becomes 0."""
    far = F.col("depth_raw") > int(trunc * scale)
    near = (F.lit(min_mm) > 0) & (F.col("depth_raw") > 0) & (F.col("depth_raw") < min_mm)
    return pixels.withColumn("depth_raw", F.when(far | near, F.lit(0)).otherwise(F.col("depth_raw")))


def _per_image(pixels: DataFrame, out: T.StructField, value) -> DataFrame:
    """``out`` as ``value`` gives it for the depths and places of whole images, in one shuffle by frame.

    Depths and places are those of an image. Rows without a place or depth don't count; they keep the depth they have, and
    have 0 or false otherwise.
    """
    fields = [out if f.name == out.name else f for f in pixels.schema.fields]
    schema = T.StructType(fields if out.name in pixels.columns else [*fields, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in tiles.whole_frames(batches):
            (depth, known), (u, placed_u), (v, placed_v) = (tiles.numbers(table, c) for c in ("depth_raw", "u", "v"))
            frame = np.repeat(np.arange(len(starts)), np.diff([*starts, table.num_rows]))
            rows = np.flatnonzero(known & placed_u & placed_v)
            found = depth.copy() if out.name == "depth_raw" else np.zeros(len(depth), bool)
            found[rows] = value(depth[rows], u[rows], v[rows], frame[rows])
            if out.name == "depth_raw":
                column = pa.array(found, table.schema.field("depth_raw").type, mask=~known)
            else:
                column = pa.array(found).cast(pa.bool_() if out.dataType == T.BooleanType() else pa.int32())
            at = table.schema.get_field_index(out.name)
            table = table.append_column(out.name, column) if at < 0 else table.set_column(at, out.name, column)
            yield from table.to_batches(max_chunksize=1 << 16)

    return tiles.by_frame(pixels).mapInArrow(run, schema)


def erode_valid(pixels: DataFrame, radius: int = 2) -> DataFrame:
    """Depth becomes 0 where any pixel of the square around has none."""
    return _per_image(pixels, pixels.schema["depth_raw"], lambda *image: tiles.eroded(*image, radius))


def dilate_valid(pixels: DataFrame, radius: int = 5) -> DataFrame:
    """``near_valid``: 1 where any pixel of the square around has depth."""
    return _per_image(pixels, T.StructField("near_valid", T.IntegerType()), lambda *image: tiles.near_valid(*image, radius))


def hole_mask(pixels: DataFrame, radius: int = 5) -> DataFrame:
    """``hole``: no depth here, but depth near."""
    return _per_image(pixels, T.StructField("hole", T.BooleanType()), lambda depth, *at: (depth == 0) & tiles.near_valid(depth, *at, radius))


def fill_holes(pixels: DataFrame, radius: int = 5) -> DataFrame:
    """Holes get the mean of valid depths within ``radius``, weighted by one over the distance, truncated.

    The holes are those of the usual inpainting step; the values are not those of its solver. A hole with no valid
    pixel in the circle (it may be in the square only) stays empty.
    """
    return _per_image(pixels, pixels.schema["depth_raw"], lambda *image: tiles.filled(*image, radius))


def _source_place(camera: Camera) -> tuple[Column, Column]:
    """Where an undistorted pixel comes from, with the same camera matrix."""
    k1, k2, p1, p2, k3 = camera.dist
    x, y = (F.col("u") - camera.cx) / camera.fx, (F.col("v") - camera.cy) / camera.fy
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
    xd = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
    yd = y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    return camera.fx * xd + camera.cx, camera.fy * yd + camera.cy


def undistort_depth(pixels: DataFrame, camera: Camera) -> DataFrame:
    """Nearest neighbour, as averages corrupt depth at edges; outside the image 0. Without distortion nothing changes."""
    if not any(camera.dist):
        return pixels
    us, vs = _source_place(camera)
    at = pixels.withColumn("su", F.floor(us + 0.5).cast("int")).withColumn("sv", F.floor(vs + 0.5).cast("int")).drop("depth_raw")
    source = pixels.select(*FRAME, F.col("u").alias("su"), F.col("v").alias("sv"), "depth_raw")
    out = at.join(many(source), [*FRAME, "su", "sv"], "left")
    return out.withColumn("depth_raw", F.coalesce("depth_raw", F.lit(0))).select(*pixels.columns)


def undistort_bilinear(pixels: DataFrame, camera: Camera, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Weighted mean of the four pixels around the source place, rounded; outside the image 0.

    For colours; with ``channels=("depth_raw",)`` it is the older depth variant, which blurs edges.
    """
    if not any(camera.dist):
        return pixels
    us, vs = _source_place(camera)
    at = pixels.select(*FRAME, "u", "v", us.alias("us"), vs.alias("vs"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    at = at.withColumn("c", F.explode(corners))
    du, dv = F.col("us") - F.floor("us"), F.col("vs") - F.floor("vs")
    weight = F.when(F.col("c.i") == 1, du).otherwise(1 - du) * F.when(F.col("c.j") == 1, dv).otherwise(1 - dv)
    at = at.select(*FRAME, "u", "v", (F.floor("us") + F.col("c.i")).cast("int").alias("su"), (F.floor("vs") + F.col("c.j")).cast("int").alias("sv"), weight.alias("w"))
    source = pixels.select(*FRAME, F.col("u").alias("su"), F.col("v").alias("sv"), *channels)
    sums = at.join(many(source), [*FRAME, "su", "sv"]).groupBy(*FRAME, "u", "v")
    sums = sums.agg(*[F.floor(F.round(F.sum(F.col("w") * F.col(c)), 6) + 0.5).cast("int").alias(f"{c}_new") for c in channels])
    out = pixels.join(many(sums), [*FRAME, "u", "v"], "left")
    for c in channels:
        out = out.withColumn(c, F.coalesce(f"{c}_new", F.lit(0)))
    return out.select(*pixels.columns)


def project_points(pixels: DataFrame, camera: Camera, scale: float = 1000.0, trunc: float = 3.5, abs_fy: bool = True) -> DataFrame:
    """Points of the pixels with depth below ``trunc`` metres, with colours in [0, 1]. The older variant keeps fy's sign."""
    fy = abs(camera.fy) if abs_fy else camera.fy
    z = F.col("depth_raw") / F.lit(float(scale))
    out = pixels.where((F.col("depth_raw") > 0) & (z < trunc)).withColumn("z", z)
    return out.select(
        *FRAME, "u", "v",
        ((F.col("u") - camera.cx) * F.col("z") / camera.fx).alias("x"), ((F.col("v") - camera.cy) * F.col("z") / fy).alias("y"), "z",
        *[(F.col(c) / 255.0).alias(c) for c in ("r", "g", "b")],
    )


def project_points_v1(pixels: DataFrame, camera: Camera, scale: float = 1000.0) -> DataFrame:
    """The older variant: cut at 3 metres, no masks, fy as it is."""
    return project_points(pixels, camera, scale, 3.0, abs_fy=False)


def to_gray(r: Column, g: Column, b: Column) -> Column:
    """Fixed weights 0.299, 0.587 and 0.114, rounded."""
    return F.floor(F.round(0.299 * r + 0.587 * g + 0.114 * b, 6) + 0.5).cast("int")


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit hue (0 to 179), saturation and value of colours in 0..255."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (high - low).cast("double")
    hue = F.when(span == 0, F.lit(0.0)).when(high == r, 60.0 * (g - b) / span).when(high == g, 120.0 + 60.0 * (b - r) / span)
    hue = hue.otherwise(240.0 + 60.0 * (r - g) / span)
    hue = F.when(hue < 0, hue + 360.0).otherwise(hue)
    h = (F.floor(F.round(hue / 2, 6) + 0.5) % 180).cast("int")
    s = F.when(high == 0, F.lit(0)).otherwise(F.floor(F.round(255.0 * span / high, 6) + 0.5).cast("int"))
    return h, s, high.cast("int")


#: Lowest and highest hue, saturation and value, inclusive.
GREEN = ((35, 40, 40), (70, 255, 255))
BROWN = ((0, 50, 40), (20, 255, 180))
WHITE = ((0, 0, 200), (180, 55, 255))


def with_hsv(points: DataFrame) -> DataFrame:
    """Adds h, s, val of the colours, scaled to 0..255 and truncated first."""
    scaled = F.array(F.struct(*[normalize_color(F.col(c)).alias(c) for c in ("r", "g", "b")]))
    # in a lambda the scaled colours are variables, so the expression stays small
    hsv = F.transform(scaled, lambda c: F.struct(*[x.alias(n) for n, x in zip(("h", "s", "val"), rgb_to_hsv(c["r"], c["g"], c["b"]))]))[0]
    return points.withColumn("__hsv", hsv).select(*points.columns, "__hsv.h", "__hsv.s", "__hsv.val")


def in_hsv_ranges(ranges: list[tuple[tuple[int, int, int], tuple[int, int, int]]]) -> Column:
    any_of = F.lit(False)
    for low, high in ranges:
        any_of = any_of | (F.col("h").between(low[0], high[0]) & F.col("s").between(low[1], high[1]) & F.col("val").between(low[2], high[2]))
    return any_of


def filter_hsv_ranges(points: DataFrame, ranges: list, keep: bool = True) -> DataFrame:
    """Points whose colour is in any of the ranges, or with ``keep=False`` in none."""
    inside = in_hsv_ranges(ranges)
    return with_hsv(points).where(inside if keep else ~inside).drop("h", "s", "val")


def filter_green(points: DataFrame) -> DataFrame:
    return filter_hsv_ranges(points, [GREEN])


def crop_aabb(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Points inside a box, bounds included."""
    inside = F.lit(True)
    for c, a, b in zip("xyz", low, high):
        inside = inside & F.col(c).between(a, b)
    return points.where(inside)


def points_by_index(points: DataFrame, ids: DataFrame, id_col: str = "point_id") -> DataFrame:
    """The points whose id is listed."""
    return points.join(ids.select(id_col).distinct(), id_col, "left_semi")


def clip_depth_mad(points: DataFrame, mad_mult: float = 2.0, percentile_hi: float = 90.0) -> DataFrame:
    """Points up to median + mad_mult * MAD of z in their frame; without spread up to the percentile; never an empty frame."""
    middle = points.groupBy(*FRAME).agg(F.percentile("z", F.lit(0.5)).alias("med"), F.percentile("z", F.lit(percentile_hi / 100)).alias("hi"))
    spread = points.join(many(middle), FRAME).groupBy(*FRAME, "med", "hi").agg(F.percentile(F.abs(F.col("z") - F.col("med")), F.lit(0.5)).alias("mad"))
    cap = F.when(F.col("mad") > 0, F.col("med") + mad_mult * F.col("mad")).otherwise(F.col("hi"))
    # the cap is never below the median, so at least half of a frame stays
    return points.join(many(spread.select(*FRAME, cap.alias("cap"))), FRAME).where("z <= cap + 1e-9").drop("cap")
