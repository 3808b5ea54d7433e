"""Catalogues of image files: listing, natural order, pairing, sampling, sequences, cameras and layouts.

``frame_files`` has (sequence_id, kind (rgb or depth), path). Listing never reads a file's content.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import entries


def list_files(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """``path, length, mtime`` of all files below a root whose name matches, empty ones (which Spark's file sources leave out) too.

    The root's own entries are listed first; tasks then list a folder each with all below it. Hidden files and folders
    (``.`` or ``_`` in front) don't count.
    """
    top = [(x.path, x.type == fs.FileType.Directory) for x in entries(root)]
    folders = spark.createDataFrame([(path,) for path, deep in top if deep] or [("",)], "folder string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["folder"]:
                found = entries(folder, True) if folder else entries(root)
                found = [x for x in found if x.type == fs.FileType.File and fnmatchcase(x.base_name, pattern)]
                yield pd.DataFrame({"path": pd.Series([x.path for x in found], dtype=object), "length": [x.size for x in found], "mtime": pd.to_datetime([x.mtime for x in found], utc=True)})

    if any(not deep for _, deep in top):
        folders = folders.union(spark.createDataFrame([("",)], "folder string")).distinct()
    return folders.repartition(max(1, min(len(top), 10_000)), "folder").mapInPandas(run, "path string, length long, mtime timestamp")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def natural_key(name: Column) -> Column:
    """Sorts names by text and number: digit runs are padded, so rgb_2 comes before rgb_10."""
    pieces = F.regexp_extract_all(name, F.lit(r"(\D+|\d+)"), F.lit(1))
    return F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p))


def natural_sort(files: DataFrame, path: str = "path", keys: list[str] | None = None) -> DataFrame:
    """``rank`` (from 0) of each file in the natural order of its group's names."""
    order = W.partitionBy(*(keys or ["sequence_id", "kind"])).orderBy(natural_key(file_name(F.col(path))), path)
    return files.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def frame_catalog(files: DataFrame) -> DataFrame:
    """Files that count as frames: those named ``kind_*.png``, or all PNGs of a folder that has none; folder by folder."""
    name = file_name(F.col("path"))
    out = files.where(F.lower(name).endswith(".png")).withColumn("prefixed", name.startswith(F.concat("kind", F.lit("_"))))
    any_prefixed = F.max("prefixed").over(W.partitionBy("sequence_id", "kind"))
    return out.withColumn("any_prefixed", any_prefixed).where(F.col("prefixed") | ~F.col("any_prefixed")).drop("prefixed", "any_prefixed")


def pair_positional(catalog: DataFrame) -> DataFrame:
    """The k-th colour file with the k-th depth file of each sequence whose counts agree: (sequence_id, frame_index, paths)."""
    ranked = natural_sort(catalog)
    good = pairing_problems(catalog).select("sequence_id")
    side = lambda kind: ranked.where(F.col("kind") == kind).select("sequence_id", F.col("rank").alias("frame_index"), F.col("path").alias(f"{kind}_path"))
    return side("rgb").join(side("depth"), ["sequence_id", "frame_index"]).join(good, "sequence_id", "left_anti")


def pairing_problems(catalog: DataFrame) -> DataFrame:
    """Sequences that can't be paired by position, with both counts: a side is empty, or the counts differ."""
    counts = catalog.groupBy("sequence_id").agg(F.count_if(F.col("kind") == "rgb").alias("n_rgb"), F.count_if(F.col("kind") == "depth").alias("n_depth"))
    problem = F.when(F.col("n_rgb") == 0, "no rgb images").when(F.col("n_depth") == 0, "no depth images").when(F.col("n_rgb") != F.col("n_depth"), "unequal counts")
    return counts.withColumn("problem", problem).where("problem is not null")


def frame_id(name: Column) -> Column:
    """The first digit run as text (007 isn't 7), or the stem without one."""
    digits = F.regexp_extract(name, r"(\d+)", 1)
    return F.when(digits != "", digits).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def pair_by_id(files: DataFrame) -> DataFrame:
    """The older rule: colour and depth files with the same id, the last file by name for an id that repeats."""
    named = files.withColumn("frame_id", frame_id(file_name(F.col("path"))))
    side = lambda kind: named.where(F.col("kind") == kind).groupBy("sequence_id", "frame_id").agg(F.max("path").alias(f"{kind}_path"))
    both = side("rgb").join(side("depth"), ["sequence_id", "frame_id"])
    order = W.partitionBy("sequence_id").orderBy(natural_key(F.col("frame_id")), "frame_id")
    return both.withColumn("frame_index", (F.row_number().over(order) - 1).cast("long"))


def subsample_step(frames: DataFrame, step: int) -> DataFrame:
    """Every step-th frame from the first on, counted anew."""
    step = max(1, step)
    return frames.where(F.col("frame_index") % step == 0).withColumn("frame_index", F.expr(f"frame_index div {step}"))


def subsample_floor(frames: DataFrame, step: int) -> DataFrame:
    """``int(n / step)`` frames at multiples of the step: a trailing part of a step is dropped."""
    n = F.count("*").over(W.partitionBy("sequence_id"))
    out = frames.withColumn("n", n).where((F.col("frame_index") % step == 0) & (F.expr(f"frame_index div {step}") < F.expr(f"n div {step}")))
    return out.withColumn("frame_index", F.expr(f"frame_index div {step}")).drop("n")


def discover_sequences(files: DataFrame) -> DataFrame:
    """Folders directly holding both ``rgb_*`` and ``depth_*`` files, with both counts."""
    name = file_name(F.col("path"))
    out = files.groupBy(folder(F.col("path")).alias("folder")).agg(F.count_if(name.startswith("rgb_")).alias("n_rgb"), F.count_if(name.startswith("depth_")).alias("n_depth"))
    return out.where("n_rgb > 0 and n_depth > 0")


def select_camera(files: DataFrame, camera: int, strict: bool = False) -> DataFrame:
    """Files below ``camera_N/`` of each sequence. Sequences without that folder keep their own files, or none if strict."""
    found = F.regexp_extract("path", r"/camera_(\d+)/", 1)
    out = files.withColumn("camera_id", F.when(found != "", found.cast("int")))
    has = F.max((F.col("camera_id") == camera).cast("int")).over(W.partitionBy("sequence_id"))
    out = out.withColumn("has", F.coalesce(has, F.lit(0)))
    rest = F.lit(False) if strict else (F.col("has") == 0) & F.col("camera_id").isNull()
    return out.where((F.col("camera_id") == camera) | rest).drop("has")


def position_from_name(path: Column) -> Column:
    """Metres of travel from a file named by micrometres."""
    return F.regexp_extract(file_name(path), r"rgb_(\d+)", 1).cast("long") / 1e6


def layout_manifest(catalog: DataFrame, step: int = 1, start_index: int = 0) -> DataFrame:
    """The renames that bring a flat folder to ``rgb/<i>.png`` and ``depth/<i>.png``; sequences with problems have none."""
    frames = subsample_step(pair_positional(catalog), step)
    number = (F.col("frame_index") + start_index).cast("string")
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_path").alias("source")) for k in ("rgb", "depth")])
    out = frames.select("sequence_id", number.alias("number"), F.explode(both).alias("f"))
    return out.select("sequence_id", "f.source", F.concat("f.kind", F.lit("/"), "number", F.lit(".png")).alias("target"))
