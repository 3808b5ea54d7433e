"""Queries that run each operator over the stand-in relations, and their SQL for DuckDB.

Values that depend on the order of sums are rounded on both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldscan.functions import geometry, tiles
from fieldscan.functions.scratch import shared_dir, stored
from fieldscan.operators import agent, neighbors, pixels, poses, quality, registration, volume
from fieldscan.sources import catalog, images, sidecars, sinks
from fieldscan.streaming import capture

from . import folders, reconstruct
from .standins import AWAY, BLANK, CAMERA, GROUND_CAMERA, GROUND_SCALE, GROUND_STEP, LOWERED, NEAR, SCALE, TRUNC, UNREADABLE, duck, ground, relation

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
BBOX = (1, 2, 7, 6)
BENT = geometry.Camera(6.0, 6.0, 3.5, 3.5, (0.1, -0.02, 0.001, 0.002, 0.0))
FRAME = "sequence_id, frame_index"


def query(name: str, needs: tuple[str, ...] | str | None = None, sql: str | None = None):
    """Register a query and, with ``needs`` and ``sql``, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = duck(needs, sql)
        return f

    return add


#: Decimals that end in 5 just behind the last place kept would round either way by an error in the last bit; moved by
#: so many of its thousandths, they don't.
OFF_TIES = 3.3


def rounded(df: DataFrame, *columns: str, n: int = 6) -> DataFrame:
    """Rounded, off ties, and zero without a sign."""
    return df.withColumns({c: F.round(F.col(c).cast("double") + F.lit(OFF_TIES * 10.0 ** (-n - 3)), n) + F.lit(0.0) for c in columns})


def r(expression: str, n: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE) + CAST({OFF_TIES * 10.0 ** (-n - 3)!r} AS DOUBLE), {n}) + CAST(0 AS DOUBLE))"


# --- sources

FILE = "regexp_extract(path, '[^/]*$')"
NUMBER = f"CAST(regexp_extract({FILE}, '[0-9]+') AS BIGINT)"
CATALOG = f"""catalog AS (SELECT sequence_id, kind, path FROM (SELECT *, max(starts_with({FILE}, kind || '_')) OVER (PARTITION BY sequence_id, kind) AS p FROM frame_files)
  WHERE NOT p OR starts_with({FILE}, kind || '_'))"""
EVEN = f"even AS (SELECT * FROM catalog WHERE {NUMBER} % 50 <> 0)"
RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, kind ORDER BY {NUMBER}, path) - 1 AS rank FROM even)"
PAIRED = """paired AS (SELECT a.sequence_id, a.rank AS frame_index, a.path AS rgb_path, b.path AS depth_path FROM ranked a
  JOIN ranked b ON a.sequence_id = b.sequence_id AND a.rank = b.rank AND a.kind = 'rgb' AND b.kind = 'depth')"""
FILES = f"+ {CATALOG}, {EVEN}, {RANKED}, {PAIRED} "


def _files(spark: SparkSession, d: str) -> DataFrame:
    return catalog.frame_catalog(relation(spark, d, "frame_files"))


def _even(spark: SparkSession, d: str) -> DataFrame:
    """Files without the orders whose depth file is missing, so that both sides agree."""
    return _files(spark, d).where(F.regexp_extract(catalog.file_name(F.col("path")), r"(\d+)", 1).cast("long") % 50 != 0)


@query("src_frame_catalog", "frame_files", f"+ {CATALOG} SELECT * FROM catalog")
def _(spark, d):
    return _files(spark, d).select("sequence_id", "kind", "path")


@query("natural_sort", "frame_files", f"+ {CATALOG} SELECT *, row_number() OVER (PARTITION BY sequence_id, kind ORDER BY {NUMBER}, path) - 1 AS rank FROM catalog")
def _(spark, d):
    return catalog.natural_sort(_files(spark, d)).select("sequence_id", "kind", "path", "rank")


@query("pair_positional", "frame_files", FILES + "SELECT * FROM paired")
def _(spark, d):
    return catalog.pair_positional(_even(spark, d))


@query("pairing_problems", "frame_files", f"""+ {CATALOG} SELECT *, CASE WHEN n_rgb = 0 THEN 'no rgb images' WHEN n_depth = 0 THEN 'no depth images' ELSE 'unequal counts' END AS problem
  FROM (SELECT sequence_id, count(*) FILTER (kind = 'rgb') AS n_rgb, count(*) FILTER (kind = 'depth') AS n_depth FROM catalog GROUP BY 1) WHERE n_rgb <> n_depth""")
def _(spark, d):
    return catalog.pairing_problems(_files(spark, d))


@query("pair_by_id", "frame_files", f"""SELECT sequence_id, frame_id, rgb_path, depth_path, row_number() OVER (PARTITION BY sequence_id ORDER BY CAST(frame_id AS BIGINT), frame_id) - 1 AS frame_index
  FROM (SELECT sequence_id, regexp_extract({FILE}, '[0-9]+') AS frame_id, max(path) FILTER (kind = 'rgb') AS rgb_path, max(path) FILTER (kind = 'depth') AS depth_path
  FROM frame_files GROUP BY ALL) WHERE rgb_path IS NOT NULL AND depth_path IS NOT NULL""")
def _(spark, d):
    return catalog.pair_by_id(relation(spark, d, "frame_files"))


@query("subsample_step", "frame_files", FILES + "SELECT sequence_id, frame_index // 7 AS frame_index, rgb_path, depth_path FROM paired WHERE frame_index % 7 = 0")
def _(spark, d):
    return catalog.subsample_step(catalog.pair_positional(_even(spark, d)), 7)


@query("subsample_floor", "frame_files", FILES + """SELECT sequence_id, frame_index // 7 AS frame_index, rgb_path, depth_path
  FROM (SELECT *, count(*) OVER (PARTITION BY sequence_id) AS n FROM paired) WHERE frame_index % 7 = 0 AND frame_index // 7 < n // 7""")
def _(spark, d):
    return catalog.subsample_floor(catalog.pair_positional(_even(spark, d)), 7)


JSON = "CASE WHEN json_valid(json_text) THEN json_text::JSON END"
PARSED = f"""parsed AS (SELECT sequence_id, CAST(j->'K'->0->>0 AS DOUBLE) AS fx, CAST(j->'K'->1->>1 AS DOUBLE) AS fy, CAST(j->'K'->0->>2 AS DOUBLE) AS cx, CAST(j->'K'->1->>2 AS DOUBLE) AS cy,
  CASE WHEN j IS NOT NULL THEN coalesce(CAST(j->'dist'->>0 AS DOUBLE), CAST(0 AS DOUBLE)) END AS k1, CASE WHEN j IS NOT NULL THEN coalesce(CAST(j->>'width' AS INT), 640) END AS width,
  CASE WHEN j IS NOT NULL THEN coalesce(CAST(j->>'height' AS INT), 480) END AS height FROM (SELECT sequence_id, {JSON} AS j FROM intrinsics_text))"""


def _flat(df: DataFrame) -> DataFrame:
    k = F.col("K")
    return df.select("sequence_id", k[0][0].alias("fx"), k[1][1].alias("fy"), k[0][2].alias("cx"), k[1][2].alias("cy"), F.col("dist")[0].alias("k1"), *[c for c in ("width", "height") if c in df.columns])


@query("src_intrinsics", "intrinsics_text", f"+ {PARSED} SELECT * FROM parsed")
def _(spark, d):
    return _flat(sidecars.parse_intrinsics(relation(spark, d, "intrinsics_text")))


@query("src_intrinsics_strict", "intrinsics_text", f"+ {PARSED} SELECT sequence_id, fx, fy, cx, cy, k1 FROM parsed WHERE fx IS NOT NULL")
def _(spark, d):
    return _flat(sidecars.parse_intrinsics_strict(relation(spark, d, "intrinsics_text").where("sequence_id % 10 != 9")))


@query("default_intrinsics", "intrinsics_text", f"""+ {PARSED} SELECT sequence_id, fx IS NULL AS is_default, {r("coalesce(fx, w / (2 * tan(radians(30))))")} AS fx,
  {r("coalesce(fy, w / (2 * tan(radians(30))))")} AS fy, {r("coalesce(cx, w / 2)")} AS cx, {r("coalesce(cy, h / 2)")} AS cy
  FROM (SELECT *, CAST(coalesce(width, 640) AS DOUBLE) AS w, CAST(coalesce(height, 480) AS DOUBLE) AS h FROM parsed)""")
def _(spark, d):
    out = sidecars.camera_columns(sidecars.parse_intrinsics(relation(spark, d, "intrinsics_text")))
    return rounded(out.select("sequence_id", "is_default", "fx", "fy", "cx", "cy"), "fx", "fy", "cx", "cy")


@query("resolve_intrinsics", "intrinsics_text", f"""+ {PARSED}, c AS (SELECT p.*, root_rank, name, name_rank FROM parsed p CROSS JOIN
  (VALUES (1, 'kdc_intrinsics.txt', 1), (0, 'kd_intrinsics.txt', 2), (0, 'kdc_intrinsics.json', 3), (0, 'other.json', 9)) v(root_rank, name, name_rank)
  WHERE name_rank < 9 AND (name_rank <> 2 OR sequence_id % 2 = 0)), f AS (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY root_rank, name_rank) AS k FROM c)
  SELECT sequence_id, name, root_rank, fx FROM f WHERE k = 1 AND fx IS NOT NULL""")
def _(spark, d):
    made = F.expr("inline(array(struct(1, 'kdc_intrinsics.txt'), struct(0, 'kd_intrinsics.txt'), struct(0, 'kdc_intrinsics.json'), struct(0, 'other.json'))) as (root_rank, name)")
    rows = relation(spark, d, "intrinsics_text").select("sequence_id", "json_text", made)
    out = sidecars.resolve_intrinsics(rows.where("name != 'kd_intrinsics.txt' or sequence_id % 2 = 0"))
    return out.select("sequence_id", "name", "root_rank", F.col("K")[0][0].alias("fx"))


@query("discover_sequences", "frame_files", f"""SELECT folder, count(*) FILTER (starts_with({FILE}, 'rgb_')) AS n_rgb, count(*) FILTER (starts_with({FILE}, 'depth_')) AS n_depth
  FROM (SELECT '/cap/' || sequence_id AS folder, path FROM frame_files) GROUP BY 1 HAVING count(*) FILTER (starts_with({FILE}, 'rgb_')) > 0 AND count(*) FILTER (starts_with({FILE}, 'depth_')) > 0""")
def _(spark, d):
    return catalog.discover_sequences(relation(spark, d, "frame_files").withColumn("path", F.regexp_replace("path", "/(rgb|depth)/", "/")))


@query("select_camera", "frame_files", f"""SELECT sequence_id, kind, path FROM (SELECT *, max(n % 3 = 1) OVER (PARTITION BY sequence_id) AS has FROM
  (SELECT sequence_id, kind, {NUMBER} AS n, CASE WHEN sequence_id = 'seq_4' THEN path ELSE replace(path, sequence_id, sequence_id || '/camera_' || ({NUMBER} % 3)) END AS path,
  sequence_id = 'seq_4' AS flat FROM frame_files)) WHERE flat OR n % 3 = 1""")
def _(spark, d):
    number = F.regexp_extract(catalog.file_name(F.col("path")), r"(\d+)", 1).cast("long") % 3
    flat = F.col("sequence_id") == "seq_4"
    path = F.when(flat, F.col("path")).otherwise(F.replace("path", "sequence_id", F.concat("sequence_id", F.lit("/camera_"), number.cast("string"))))
    return catalog.select_camera(relation(spark, d, "frame_files").withColumn("path", path), 1).select("sequence_id", "kind", "path")


def _as_png(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Frames as PNG files in a table, made from their pixels. Small images come many at a time, so no group is made of each."""
    import numpy as np
    import pyarrow as pa

    names = ("u", "v", "r", "g", "b", "depth_raw")

    def encode(batches):
        for table, starts in tiles.whole_frames(batches):
            values, out = {c: table.column(c).to_numpy() for c in names}, []
            for first, end in zip(starts, [*starts[1:], table.num_rows]):
                u, v, *rgb, depth_raw = (values[c][first:end] for c in names)
                color, depth = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), np.uint16)
                for k, c in enumerate(rgb):
                    color[v, u, k] = c
                depth[v, u] = depth_raw
                out.append((images.encode_png(color), images.encode_png(depth)))
            keys = [table.column(c).combine_chunks().take(pa.array(starts)) for c in ("sequence_id", "frame_index")]
            columns = [keys[0].cast(pa.string()), keys[1].cast(pa.int64()), *[pa.array(x, pa.binary()) for x in zip(*out)]]
            yield pa.RecordBatch.from_arrays(columns, ["sequence_id", "frame_index", "rgb", "depth"])

    return tiles.by_frame(pixels.select("sequence_id", "frame_index", *names)).mapInArrow(encode, "sequence_id string, frame_index long, rgb binary, depth binary")


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    return _as_png(relation(spark, d, "pixels"), 8, 8)


@query("decode_depth_png", "pixels", "SELECT CAST(sequence_id AS VARCHAR) AS sequence_id, frame_index, u, v, depth_raw FROM pixels WHERE depth_raw > 0")
def _(spark, d):
    return images.decode_frames(_encoded(spark, d)).select("sequence_id", "frame_index", "u", "v", "depth_raw")


@query("decode_color_png", "pixels", "SELECT CAST(sequence_id AS VARCHAR) AS sequence_id, frame_index, u, v, r, g, b FROM pixels")
def _(spark, d):
    return images.decode_frames(_encoded(spark, d), keep_empty=True).select("sequence_id", "frame_index", "u", "v", "r", "g", "b")


ASOF = """placed AS (SELECT sequence_id, ts, event_id, row_number() OVER (PARTITION BY sequence_id ORDER BY ts, event_id) - 1 AS frame_index, position_m FROM
  (SELECT *, coalesce(last_value(CASE WHEN kind = 'position' THEN position_m END IGNORE NULLS) OVER (PARTITION BY sequence_id ORDER BY ts, event_id), CAST(0 AS DOUBLE)) AS position_m
  FROM (SELECT sequence_id, ts, event_id, kind, position_m FROM capture)) WHERE kind = 'frame')"""
ASOF = ASOF.replace("SELECT *, coalesce", "SELECT sequence_id, ts, event_id, kind, coalesce")


def _frames_at(spark: SparkSession, d: str) -> DataFrame:
    return capture.position_asof(relation(spark, d, "capture"))


@query("src_session", "capture", f"+ {ASOF} SELECT sequence_id, count(*) AS n_frames, 'ros' AS backend FROM placed GROUP BY 1")
def _(spark, d):
    roll = capture.session_rollup(_frames_at(spark, d))
    text = roll.select("sequence_id", F.to_json(F.struct(F.lit("ros").alias("backend"), "n_frames", "frame_positions")).alias("t"))
    return text.select("sequence_id", F.from_json("t", sidecars.SESSION).alias("s")).select("sequence_id", F.col("s.n_frames").cast("long").alias("n_frames"), "s.backend")


@query("session_positions", "capture", f"+ {ASOF} SELECT sequence_id, frame_index, position_m FROM placed")
def _(spark, d):
    return sidecars.session_positions(capture.session_rollup(_frames_at(spark, d)))


@query("position_from_name", "frame_files", f"SELECT path, {NUMBER} / CAST(1000000 AS DOUBLE) AS position_m FROM frame_files WHERE starts_with({FILE}, 'rgb_')")
def _(spark, d):
    out = relation(spark, d, "frame_files").where(catalog.file_name(F.col("path")).startswith("rgb_"))
    return out.select("path", catalog.position_from_name(F.col("path")).alias("position_m"))


@query("src_ply", "cloud", f"SELECT count(*) AS n, {r('sum(x)', 4)} AS x, {r('sum(y)', 4)} AS y, {r('sum(z)', 4)} AS z, {r('sum(r)', 3)} AS r FROM cloud")
def _(spark, d):
    """Clouds written as PLY files, one per partition, and read back in ranges of bytes."""
    from fieldscan.sources.ply import PlyDataSource

    spark.dataSource.register(PlyDataSource)
    path = f"{shared_dir(spark)}/ply-{uuid.uuid4().hex}"
    points = relation(spark, d, "cloud").repartition("sequence_id", "frame_index").select("x", "y", "z", "r", "g", "b")
    points.write.format("ply").mode("append").option("path", path).save()
    back = spark.read.format("ply").option("path", path).option("split_bytes", 4096).load()
    return rounded(rounded(back.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("x", "y", "z", "r")]), "x", "y", "z", n=4), "r", n=3)


@query("sink_ply", "cloud", f"SELECT CAST(sequence_id AS VARCHAR) AS sequence_id, count(*) AS n, {r('sum(x)', 4)} AS x, 1 AS files FROM cloud GROUP BY 1")
def _(spark, d):
    """One file for each sequence, named after it."""
    from fieldscan.sources.ply import PlyDataSource

    spark.dataSource.register(PlyDataSource)
    path = f"{shared_dir(spark)}/ply-{uuid.uuid4().hex}"
    points = relation(spark, d, "cloud").select("x", "y", "z", "r", "g", "b", "sequence_id").repartition("sequence_id").sortWithinPartitions("sequence_id")
    points.write.format("ply").mode("append").option("path", path).option("by", "sequence_id").save()
    back = spark.read.format("ply").option("path", path).load().withColumn("sequence_id", F.regexp_extract("path", r"([^/]*)-[0-9a-f]{32}\.ply$", 1))
    return rounded(back.groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.countDistinct("path").alias("files")), "x", n=4)


@query("src_camera_params", "intrinsics_text", """SELECT sequence_id, sequence_id + CAST(4 AS DOUBLE) AS e01, sequence_id + CAST(3 AS DOUBLE) AS e30, sequence_id * CAST(6 AS DOUBLE) AS k02,
  sequence_id * CAST(2 AS DOUBLE) AS k20, 1280 AS width, 720 AS height FROM intrinsics_text""")
def _(spark, d):
    """A saved camera for each supplier, parsed; matrices are saved column by column."""
    made = F.to_json(F.struct(
        F.lit("camera").alias("class_name"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.col("sequence_id") + i).alias("extrinsic"),
        F.struct(F.lit(720).alias("height"), F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.col("sequence_id") * i).alias("intrinsic_matrix"), F.lit(1280).alias("width")).alias("intrinsic"),
    ))
    out = sidecars.parse_view_cameras(relation(spark, d, "intrinsics_text").select("sequence_id", made.alias("json_text")))
    e, k = F.col("extrinsic"), F.col("K")
    return out.select("sequence_id", e[1].alias("e01"), e[12].alias("e30"), k[2].alias("k02"), k[6].alias("k20"), "width", "height")


# --- sinks

JUDGED = """judged AS (SELECT *, CASE WHEN fitness < 0.3 OR rmse > 0.015 THEN 'REJECTED' ELSE 'OK' END AS status, CASE WHEN fitness < 0.3 THEN 'low fitness' END AS reason FROM registrations)"""


def _registrations(spark: SparkSession, d: str) -> DataFrame:
    out = relation(spark, d, "registrations")
    return out.withColumn("translation_m", F.col("tx")).withColumn("rotation_deg", F.col("rot_deg"))


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    status = F.when((F.col("fitness") < 0.3) | (F.col("rmse") > 0.015), "REJECTED").otherwise("OK")
    return _registrations(spark, d).withColumn("status", status).withColumn("reason", F.when(F.col("fitness") < 0.3, "low fitness"))


@query("sink_metrics_csv", "registrations", f"+ {JUDGED} SELECT frame_index AS frame, status, round(fitness, 6) AS fitness, round(rmse, 6) AS rmse, coalesce(reason, '') AS note FROM judged")
def _(spark, d):
    return sinks.metrics_csv(_statuses(spark, d))


@query("sink_metrics_csv_v1", "registrations", f"+ {JUDGED} SELECT frame_index AS frame_idx, fitness, rmse AS inlier_rmse, status = 'OK' AS success FROM judged")
def _(spark, d):
    return sinks.metrics_csv_v1(_statuses(spark, d))


@query("sink_quality_csv", "pair_metrics", "SELECT pair_index, depth_validity, median_depth_m, n_points, icp_fitness, icp_rmse, rotation_deg, error FROM pair_metrics")
def _(spark, d):
    return sinks.quality_csv(relation(spark, d, "pair_metrics"))


LONG = "long AS (" + " UNION ALL ".join(f"SELECT sequence_id, error, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM pair_metrics" for m in quality.METRICS) + ")"
AGGREGATED = """agg AS (SELECT sequence_id, metric, coalesce(avg(value) FILTER (error = ''), 0) AS mean, coalesce(quantile_cont(value, 0.5) FILTER (error = ''), 0) AS median,
  coalesce(quantile_cont(value, 0.25) FILTER (error = ''), 0) AS p25, coalesce(quantile_cont(value, 0.75) FILTER (error = ''), 0) AS p75 FROM long GROUP BY 1, 2)"""
LEVELS = """levels AS (SELECT sequence_id, CASE WHEN f < 0.3 THEN 2 WHEN f < 0.5 THEN 1 ELSE 0 END AS lf, CASE WHEN e > 0.015 THEN 2 WHEN e > 0.005 THEN 1 ELSE 0 END AS le,
  CASE WHEN v < 0.1 THEN 2 WHEN v < 0.3 THEN 1 ELSE 0 END AS lv, CASE WHEN t > 5 THEN 2 WHEN t > 1 THEN 1 ELSE 0 END AS lt FROM
  (SELECT sequence_id, max(mean) FILTER (metric = 'icp_fitness') AS f, max(mean) FILTER (metric = 'icp_rmse') AS e, max(mean) FILTER (metric = 'depth_validity') AS v,
  max(mean) FILTER (metric = 'rotation_deg') AS t FROM agg GROUP BY 1))"""
VERDICTS = """verdicts AS (SELECT sequence_id, CASE greatest(lf, le, lv, lt) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS verdict,
  concat_ws(', ', CASE WHEN lf > 0 THEN 'icp_fitness' END, CASE WHEN le > 0 THEN 'icp_rmse' END, CASE WHEN lv > 0 THEN 'depth_validity' END, CASE WHEN lt > 0 THEN 'rotation_deg' END) AS failing FROM levels)"""
QUALITY = f"+ {LONG}, {AGGREGATED}, {LEVELS}, {VERDICTS} "


def _aggregates(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_aggregate(relation(spark, d, "pair_metrics"))


@query("sink_quality_summary", "pair_metrics", QUALITY + """SELECT sequence_id, verdict, failing, n_pairs FROM verdicts JOIN (SELECT sequence_id, count(*) AS n_pairs FROM pair_metrics GROUP BY 1) USING (sequence_id)""")
def _(spark, d):
    metrics = relation(spark, d, "pair_metrics")
    agg = quality.quality_aggregate(metrics)
    out = sinks.quality_summary(quality.quality_verdict(agg, places=None), agg, metrics.groupBy("sequence_id").agg(F.count("*").alias("n_pairs")))
    line = lambda k: F.regexp_extract("text", rf"(?m)^{k}: (.*)$", 1)
    return out.select("sequence_id", line("verdict").alias("verdict"), F.regexp_replace(line("failing"), "^none$", "").alias("failing"), line("pairs").cast("long").alias("n_pairs"))


@query("report_struct", "pair_metrics", QUALITY + """SELECT sequence_id, verdict, n_pairs FROM verdicts JOIN (SELECT sequence_id, count(*) AS n_pairs FROM pair_metrics GROUP BY 1) USING (sequence_id)""")
def _(spark, d):
    out = sinks.report_struct(quality.quality_verdict(_aggregates(spark, d), places=None), relation(spark, d, "pair_metrics"))
    return out.select("sequence_id", F.get_json_object("report", "$.verdict").alias("verdict"), F.json_array_length(F.get_json_object("report", "$.pairs")).cast("long").alias("n_pairs"))


@query("sink_pose_txt", "registrations", "SELECT sequence_id, (frame_index * 3) || '_1_pose.txt' AS name, 4 AS n_lines FROM registrations WHERE fitness >= 0.5")
def _(spark, d):
    rows = relation(spark, d, "registrations").where("fitness >= 0.5").withColumn("pose", geometry.rotation_z(F.col("rot_deg"), F.col("tx")))
    out = sinks.pose_txt(rows, 3, 1)
    return out.select("sequence_id", "name", F.size(F.split("text", "\n")).alias("n_lines"))


@query("layout_manifest", "frame_files", FILES + """SELECT sequence_id, unnest([rgb_path, depth_path]) AS source, unnest(['rgb/', 'depth/']) || (frame_index // 3 + 10) || '.png' AS target FROM paired WHERE frame_index % 3 = 0""")
def _(spark, d):
    return catalog.layout_manifest(_even(spark, d), 3, 10)


@query("capture_intrinsics_doc", "intrinsics_text", f"+ {PARSED} SELECT * FROM parsed WHERE fx IS NOT NULL")
def _(spark, d):
    known = sidecars.camera_columns(sidecars.parse_intrinsics(relation(spark, d, "intrinsics_text"))).where("not is_default")
    return _flat(sidecars.parse_intrinsics(sidecars.capture_intrinsics_doc(known)))


# --- pixels

MASKED = f"masked AS (SELECT * REPLACE (CASE WHEN depth_raw > {int(TRUNC * SCALE)} OR depth_raw BETWEEN 1 AND {NEAR - 1} THEN 0 ELSE depth_raw END AS depth_raw) FROM pixels)"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, "pixels")


def _masked(spark: SparkSession, d: str) -> DataFrame:
    return pixels.mask_depth_range(_pixels(spark, d), TRUNC, SCALE, NEAR)


def projected(source: str, cx: str = "3.5", cy: str = "3.5", trunc: float = TRUNC) -> str:
    z = f"(depth_raw / CAST({SCALE:g} AS DOUBLE))"
    return f"""SELECT {FRAME}, u, v, {r(f"(u - CAST({cx} AS DOUBLE)) * {z} / 6")} AS x, {r(f"(v - CAST({cy} AS DOUBLE)) * {z} / 6")} AS y, {r(z)} AS z,
  {r("r / CAST(255 AS DOUBLE)")} AS r, {r("g / CAST(255 AS DOUBLE)")} AS g, {r("b / CAST(255 AS DOUBLE)")} AS b FROM {source} WHERE depth_raw > 0 AND {z} < {trunc}"""


COLUMNS = ("x", "y", "z", "r", "g", "b")


@query("pixels_explode", "pixels", f"SELECT {FRAME}, u, v, depth_raw FROM pixels")
def _(spark, d):
    raw = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("sequence_id"), F.col("vec_id").alias("frame_index"), F.col("embedding").alias("values"))
    out = pixels.pixels_explode(raw, 8)
    return out.select("sequence_id", "frame_index", "u", "v", F.floor(F.abs(F.col("value").cast("double")) * 10000).cast("int").alias("depth_raw"))


@query("mask_depth_range", "pixels", f"+ {MASKED} SELECT {FRAME}, u, v, depth_raw FROM masked")
def _(spark, d):
    return _masked(spark, d).select("sequence_id", "frame_index", "u", "v", "depth_raw")


_CROPPED = f"cropped AS (SELECT * REPLACE (u - {BBOX[0]} AS u, v - {BBOX[1]} AS v) FROM masked WHERE u >= {BBOX[0]} AND u < {BBOX[2]} AND v >= {BBOX[1]} AND v < {BBOX[3]})"


@query("crop_bbox", "pixels", f"+ {MASKED}, {_CROPPED} " + projected("cropped", "2.5", "1.5"))
def _(spark, d):
    return rounded(pixels.project_points(pixels.crop_bbox(_masked(spark, d), BBOX), pixels.crop_camera(CAMERA, BBOX), SCALE, TRUNC), *COLUMNS)


@query("crop_bbox_v1", "pixels", f"+ {MASKED}, {_CROPPED} " + projected("cropped"))
def _(spark, d):
    return rounded(pixels.project_points(pixels.crop_bbox(_masked(spark, d), BBOX), pixels.crop_camera(CAMERA, BBOX, False), SCALE, TRUNC), *COLUMNS)


@query("normalize_color", "cloud", f"SELECT {FRAME}, point_id, CAST(trunc(r * 255) AS INT) AS r8 FROM cloud")
def _(spark, d):
    return relation(spark, d, "cloud").select("sequence_id", "frame_index", "point_id", pixels.normalize_color(F.col("r")).alias("r8"))


def square(source: str, radius: int, pick: str, value: str) -> str:
    return f"""(SELECT p.sequence_id, p.frame_index, p.u, p.v, {pick}({value}) AS m FROM {source} p JOIN {source} q
  ON p.sequence_id = q.sequence_id AND p.frame_index = q.frame_index AND abs(p.u - q.u) <= {radius} AND abs(p.v - q.v) <= {radius} GROUP BY ALL)"""


@query("erode_valid", "pixels", f"""+ {MASKED} SELECT {FRAME}, u, v, CASE WHEN m > 0 THEN depth_raw ELSE 0 END AS depth_raw FROM masked
  JOIN {square("masked", 2, "min", "CAST(q.depth_raw > 0 AS INT)")} USING (sequence_id, frame_index, u, v)""")
def _(spark, d):
    return pixels.erode_valid(_masked(spark, d)).select("sequence_id", "frame_index", "u", "v", "depth_raw")


@query("dilate_valid", "pixels", f"+ {MASKED} SELECT {FRAME}, u, v, m AS near_valid FROM {square('masked', 5, 'max', 'CAST(q.depth_raw > 0 AS INT)')}")
def _(spark, d):
    return pixels.dilate_valid(_masked(spark, d)).select("sequence_id", "frame_index", "u", "v", "near_valid")


@query("hole_mask", "pixels", f"""+ {MASKED} SELECT {FRAME}, u, v, depth_raw = 0 AND m > 0 AS hole FROM masked
  JOIN {square("masked", 5, "max", "CAST(q.depth_raw > 0 AS INT)")} USING (sequence_id, frame_index, u, v)""")
def _(spark, d):
    return pixels.hole_mask(_masked(spark, d)).select("sequence_id", "frame_index", "u", "v", "hole")


@query("fill_holes", "pixels", f"""+ {MASKED}, f AS (SELECT p.sequence_id, p.frame_index, p.u, p.v, CAST(floor(round(sum(w * dr) / sum(w), 6)) AS INT) AS fill FROM
  (SELECT p.sequence_id, p.frame_index, p.u, p.v, q.depth_raw AS dr, 1 / sqrt(CAST((p.u - q.u) ** 2 + (p.v - q.v) ** 2 AS DOUBLE)) AS w FROM masked p JOIN masked q
  ON p.sequence_id = q.sequence_id AND p.frame_index = q.frame_index AND p.depth_raw = 0 AND q.depth_raw > 0 AND (p.u - q.u) ** 2 + (p.v - q.v) ** 2 <= 25) p GROUP BY ALL)
  SELECT {FRAME}, u, v, coalesce(fill, depth_raw) AS depth_raw FROM masked LEFT JOIN f USING (sequence_id, frame_index, u, v)""")
def _(spark, d):
    return pixels.fill_holes(_masked(spark, d)).select("sequence_id", "frame_index", "u", "v", "depth_raw")


BENT_SQL = """bent AS (SELECT *, 6 * xd + 3.5 AS us, 6 * yd + 3.5 AS vs FROM (SELECT *, x * rad + 2 * p1 * x * y + p2 * (r2 + 2 * x * x) AS xd, y * rad + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y AS yd FROM
  (SELECT *, 1 + k1 * r2 + k2 * r2 * r2 AS rad FROM (SELECT *, x * x + y * y AS r2 FROM (SELECT *, (u - 3.5::DOUBLE) / 6 AS x, (v - 3.5::DOUBLE) / 6 AS y, 0.1::DOUBLE AS k1, -0.02::DOUBLE AS k2,
  0.001::DOUBLE AS p1, 0.002::DOUBLE AS p2 FROM masked)))))"""


@query("undistort_depth", "pixels", f"""+ {MASKED}, {BENT_SQL} SELECT b.sequence_id, b.frame_index, b.u, b.v, coalesce(s.depth_raw, 0) AS depth_raw FROM bent b LEFT JOIN masked s
  ON s.sequence_id = b.sequence_id AND s.frame_index = b.frame_index AND s.u = floor(b.us + 0.5) AND s.v = floor(b.vs + 0.5)""")
def _(spark, d):
    return pixels.undistort_depth(_masked(spark, d), BENT).select("sequence_id", "frame_index", "u", "v", "depth_raw")


def bilinear(value: str, name: str) -> str:
    return f"""+ {MASKED}, {BENT_SQL}, c AS (SELECT b.sequence_id, b.frame_index, b.u, b.v, CAST(floor(us) + i AS INT) AS su, CAST(floor(vs) + j AS INT) AS sv,
  CASE i WHEN 1 THEN us - floor(us) ELSE 1 - (us - floor(us)) END * CASE j WHEN 1 THEN vs - floor(vs) ELSE 1 - (vs - floor(vs)) END AS w FROM bent b, (VALUES (0), (1)) a(i), (VALUES (0), (1)) e(j))
  SELECT c.sequence_id, c.frame_index, c.u, c.v, CAST(coalesce(floor(round(sum(w * s.{value}), 6) + 0.5), 0) AS INT) AS {name} FROM c LEFT JOIN masked s
  ON s.sequence_id = c.sequence_id AND s.frame_index = c.frame_index AND s.u = su AND s.v = sv GROUP BY 1, 2, 3, 4"""


@query("undistort_color", "pixels", bilinear("r", "r"))
def _(spark, d):
    return pixels.undistort_bilinear(_masked(spark, d), BENT).select("sequence_id", "frame_index", "u", "v", "r")


@query("undistort_depth_v1", "pixels", bilinear("depth_raw", "depth_raw"))
def _(spark, d):
    return pixels.undistort_bilinear(_masked(spark, d), BENT, ("depth_raw",)).select("sequence_id", "frame_index", "u", "v", "depth_raw")


@query("project_points", "pixels", f"+ {MASKED} " + projected("masked"))
def _(spark, d):
    return rounded(pixels.project_points(_masked(spark, d), CAMERA, SCALE, TRUNC), *COLUMNS)


@query("project_points_v1", "pixels", projected("pixels", trunc=3.0))
def _(spark, d):
    return rounded(pixels.project_points_v1(_pixels(spark, d), CAMERA, SCALE), *COLUMNS)


@query("to_gray", "pixels", f"SELECT {FRAME}, u, v, CAST(floor(round(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 6) + 0.5) AS INT) AS gray FROM pixels")
def _(spark, d):
    return _pixels(spark, d).select("sequence_id", "frame_index", "u", "v", pixels.to_gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"))


HSV = """hsv AS (SELECT *, CAST(floor(round((CASE WHEN hue < 0 THEN hue + 360 ELSE hue END) / 2, 6) + 0.5) AS INT) % 180 AS h,
  CASE WHEN hi = 0 THEN 0 ELSE CAST(floor(round(255::DOUBLE * span / hi, 6) + 0.5) AS INT) END AS s, hi AS val FROM
  (SELECT *, CASE WHEN span = 0 THEN 0::DOUBLE WHEN hi = r8 THEN 60::DOUBLE * (g8 - b8) / span WHEN hi = g8 THEN 120 + 60::DOUBLE * (b8 - r8) / span ELSE 240 + 60::DOUBLE * (r8 - g8) / span END AS hue FROM
  (SELECT *, greatest(r8, g8, b8) AS hi, CAST(greatest(r8, g8, b8) - least(r8, g8, b8) AS DOUBLE) AS span FROM
  (SELECT *, CAST(trunc(r * 255) AS INT) AS r8, CAST(trunc(g * 255) AS INT) AS g8, CAST(trunc(b * 255) AS INT) AS b8 FROM cloud))))"""


@query("rgb_to_hsv", "cloud", f"+ {HSV} SELECT {FRAME}, point_id, h, s, val FROM hsv")
def _(spark, d):
    return pixels.with_hsv(relation(spark, d, "cloud")).select("sequence_id", "frame_index", "point_id", "h", "s", "val")


@query("filter_green", "cloud", f"+ {HSV} SELECT {FRAME}, point_id FROM hsv WHERE h BETWEEN 35 AND 70 AND s >= 40 AND val >= 40")
def _(spark, d):
    return pixels.filter_green(relation(spark, d, "cloud")).select("sequence_id", "frame_index", "point_id")


@query("filter_hsv_ranges", "cloud", f"""+ {HSV} SELECT {FRAME}, point_id FROM hsv WHERE NOT ((h BETWEEN 0 AND 20 AND s BETWEEN 50 AND 255 AND val BETWEEN 40 AND 180) OR (s BETWEEN 0 AND 55 AND val BETWEEN 200 AND 255))""")
def _(spark, d):
    return pixels.filter_hsv_ranges(relation(spark, d, "cloud"), [pixels.BROWN, pixels.WHITE], keep=False).select("sequence_id", "frame_index", "point_id")


@query("crop_aabb", "points", f"SELECT {FRAME}, point_id FROM points WHERE x BETWEEN 0.1 AND 0.4 AND y BETWEEN 0.2 AND 0.6 AND z BETWEEN 0 AND 0.5")
def _(spark, d):
    return pixels.crop_aabb(relation(spark, d, "points"), (0.1, 0.2, 0.0), (0.4, 0.6, 0.5)).select("sequence_id", "frame_index", "point_id")


@query("points_by_index", "cloud", f"SELECT {FRAME}, point_id, x, y, z FROM cloud WHERE point_id IN (SELECT DISTINCT o_custkey % 64 FROM orders WHERE o_custkey % 5 = 0)")
def _(spark, d):
    ids = spark.read.parquet(f"{d}/orders.parquet").where("o_custkey % 5 = 0").select((F.col("o_custkey") % 64).alias("point_id"))
    return pixels.points_by_index(relation(spark, d, "cloud"), ids).select("sequence_id", "frame_index", "point_id", "x", "y", "z")


@query("clip_depth_mad", "cloud", f"""+ m AS (SELECT {FRAME}, quantile_cont(z, 0.5) AS med, quantile_cont(z, 0.9) AS hi FROM cloud GROUP BY ALL),
  a AS (SELECT {FRAME}, med, hi, quantile_cont(abs(z - med), 0.5) AS mad FROM cloud JOIN m USING (sequence_id, frame_index) GROUP BY ALL)
  SELECT {FRAME}, point_id FROM cloud JOIN a USING (sequence_id, frame_index) WHERE z <= CASE WHEN mad > 0 THEN med + 2 * mad ELSE hi END + 1e-9""")
def _(spark, d):
    return pixels.clip_depth_mad(relation(spark, d, "cloud")).select("sequence_id", "frame_index", "point_id")


# --- neighbourhoods

RADIUS, VOXEL = 0.05, 0.037
ALL_PAIRS = """near AS (SELECT a.sequence_id, a.frame_index, a.point_id, b.point_id AS o_point_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2
  FROM cloud a JOIN cloud b USING (sequence_id, frame_index))"""


def _cloud(spark: SparkSession, d: str) -> DataFrame:
    return relation(spark, d, "cloud")


@query("voxel_downsample", "points", f"""+ lo AS (SELECT {FRAME}, min(x) - {VOXEL} / 2 AS lx, min(y) - {VOXEL} / 2 AS ly, min(z) - {VOXEL} / 2 AS lz FROM points GROUP BY ALL)
  SELECT {FRAME}, CAST(floor((x - lx) / {VOXEL}::DOUBLE) AS BIGINT) AS ix, CAST(floor((y - ly) / {VOXEL}::DOUBLE) AS BIGINT) AS iy, CAST(floor((z - lz) / {VOXEL}::DOUBLE) AS BIGINT) AS iz,
  {r("avg(x)")} AS x, {r("avg(y)")} AS y, {r("avg(z)")} AS z, count(*) AS n FROM points JOIN lo USING (sequence_id, frame_index) GROUP BY 1, 2, 3, 4, 5""".replace(f"{VOXEL} / 2", f"{VOXEL / 2}::DOUBLE"))
def _(spark, d):
    return rounded(neighbors.voxel_downsample(relation(spark, d, "points"), VOXEL), "x", "y", "z")


@query("radius_neighbors", "cloud", f"+ {ALL_PAIRS} SELECT {FRAME}, point_id, o_point_id, {r('d2')} AS d2 FROM near WHERE d2 <= {RADIUS * RADIUS}::DOUBLE")
def _(spark, d):
    return rounded(neighbors.radius_neighbors(_cloud(spark, d), RADIUS), "d2").select("sequence_id", "frame_index", "point_id", "o_point_id", "d2")


RANK = f"rank AS (SELECT *, row_number() OVER (PARTITION BY {FRAME}, point_id ORDER BY d2, o_point_id) AS rank FROM near)"


@query("knn", "cloud", f"+ {ALL_PAIRS}, {RANK} SELECT {FRAME}, point_id, o_point_id, rank, {r('d2')} AS d2 FROM rank WHERE rank <= 5")
def _(spark, d):
    return rounded(neighbors.knn(_cloud(spark, d), 5), "d2")


@query("knn_hybrid", "cloud", f"+ {ALL_PAIRS}, {RANK} SELECT {FRAME}, point_id, o_point_id, rank FROM rank WHERE rank <= 4 AND d2 <= 0.04::DOUBLE")
def _(spark, d):
    return neighbors.knn_hybrid(_cloud(spark, d).drop("r", "g", "b"), 0.2, 4).select("sequence_id", "frame_index", "point_id", "o_point_id", "rank")


def statistical(source: str, k: int, ratio: float, out: str) -> str:
    return f"""near_{out} AS (SELECT a.sequence_id, a.frame_index, a.point_id, b.point_id AS o, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2 FROM {source} a JOIN {source} b USING (sequence_id, frame_index)),
  mean_{out} AS (SELECT {FRAME}, point_id, avg(sqrt(d2)) AS m FROM (SELECT *, row_number() OVER (PARTITION BY {FRAME}, point_id ORDER BY d2, o) AS k FROM near_{out}) WHERE k <= {k} GROUP BY ALL),
  limit_{out} AS (SELECT {FRAME}, avg(m) + {ratio} * coalesce(stddev_samp(m), 0) AS l FROM mean_{out} WHERE m > 0 GROUP BY ALL),
  {out} AS (SELECT p.* FROM {source} p JOIN mean_{out} m USING (sequence_id, frame_index, point_id) JOIN limit_{out} USING (sequence_id, frame_index) WHERE m > 0 AND m < l)"""


@query("outlier_statistical", "cloud", f"+ {statistical('cloud', 10, 0.4, 'good')} SELECT {FRAME}, point_id FROM good")
def _(spark, d):
    return neighbors.outlier_statistical(_cloud(spark, d), 10, 0.4).select("sequence_id", "frame_index", "point_id")


def sparse(source: str, n: int, radius: float) -> str:
    return f"""(SELECT a.sequence_id, a.frame_index, a.point_id FROM {source} a JOIN {source} b USING (sequence_id, frame_index)
  WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= {radius * radius}::DOUBLE GROUP BY ALL HAVING count(*) > {n})"""


@query("outlier_radius", "cloud", f"SELECT * FROM {sparse('cloud', 3, 0.15)}")
def _(spark, d):
    return neighbors.outlier_radius(_cloud(spark, d), 3, 0.15).select("sequence_id", "frame_index", "point_id")


@query("clean_registration", "cloud", f"+ {statistical('cloud', 10, 0.4, 'good')} SELECT * FROM {sparse('good', 4, 0.3)}")
def _(spark, d):
    return neighbors.clean_registration(_cloud(spark, d), 10, 0.4, 4, 0.3).select("sequence_id", "frame_index", "point_id")


@query("clean_output", "cloud", f"""+ lo AS (SELECT {FRAME}, min(x) - 0.05::DOUBLE AS lx, min(y) - 0.05::DOUBLE AS ly, min(z) - 0.05::DOUBLE AS lz FROM cloud GROUP BY ALL),
  vox AS (SELECT {FRAME}, row_number() OVER (PARTITION BY {FRAME} ORDER BY x, y, z) AS point_id, x, y, z FROM (SELECT {FRAME}, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM cloud JOIN lo USING (sequence_id, frame_index)
  GROUP BY {FRAME}, floor((x - lx) / 0.1::DOUBLE), floor((y - ly) / 0.1::DOUBLE), floor((z - lz) / 0.1::DOUBLE))), {statistical('vox', 8, 1.5, 'good')}
  SELECT {FRAME}, count(*) AS n, {r("sum(x)", 4)} AS x FROM good GROUP BY 1, 2""")
def _(spark, d):
    out = neighbors.clean_output(_cloud(spark, d), 8, 1.5, 0.1).groupBy("sequence_id", "frame_index").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    return rounded(out, "x", n=4)


@query("estimate_normals", "cloud", f"SELECT {FRAME}, point_id, true AS unit FROM cloud")
def _(spark, d):
    out = neighbors.estimate_normals(_cloud(spark, d), 0.3)
    length = F.abs(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")) - 1)
    return out.select("sequence_id", "frame_index", "point_id", (length < 1e-6).alias("unit"))


@query("orient_normals", "cloud", f"SELECT {FRAME}, point_id, true AS towards FROM cloud")
def _(spark, d):
    out = neighbors.orient_normals(neighbors.estimate_normals(_cloud(spark, d), 0.3))
    side = F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z")
    return out.select("sequence_id", "frame_index", "point_id", (side <= 0).alias("towards"))


PAIRS = """frames AS (SELECT DISTINCT sequence_id, frame_index FROM cloud), pairs AS (SELECT sequence_id, frame_index AS source_frame, t AS target_frame FROM
  (SELECT *, lead(frame_index) OVER (PARTITION BY sequence_id ORDER BY frame_index) AS t FROM frames) WHERE t IS NOT NULL)"""
MATCHED = f"""{PAIRS}, m AS (SELECT source_frame, target_frame, sequence_id, a.point_id, b.point_id AS o_point_id, a.x, a.y, a.z, b.x AS ox, b.y AS oy, b.z AS oz,
  (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2 FROM pairs JOIN cloud a USING (sequence_id) JOIN cloud b USING (sequence_id) WHERE a.frame_index = source_frame AND b.frame_index = target_frame),
  matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id, source_frame, point_id ORDER BY d2, o_point_id) AS k FROM m WHERE d2 <= 0.04::DOUBLE) WHERE k = 1)"""


def _pair_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cloud = _cloud(spark, d)
    pairs = stored(poses.consecutive_pairs(cloud.select("sequence_id", "frame_index").distinct()), "pairs")
    return (pairs, *registration.pair_clouds(pairs, cloud))


def _correspondence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    _, source, target = _pair_sides(spark, d)
    return source, neighbors.nn_correspondence(source, target, 0.2, registration.PAIR)


@query("nn_correspondence", "cloud", f"+ {MATCHED} SELECT sequence_id, source_frame, target_frame, point_id, o_point_id, {r('d2')} AS d2 FROM matched")
def _(spark, d):
    return rounded(_correspondence(spark, d)[1], "d2").select(*registration.PAIR, "point_id", "o_point_id", "d2")


@query("registration_score", "cloud", f"""+ {MATCHED} SELECT sequence_id, source_frame, target_frame, {r("coalesce(n, 0) / CAST(n_source AS DOUBLE)")} AS fitness, {r("coalesce(e, 0)")} AS rmse FROM
  (SELECT sequence_id, source_frame, target_frame, count(*) AS n_source FROM pairs JOIN cloud USING (sequence_id) WHERE frame_index = source_frame GROUP BY ALL) LEFT JOIN
  (SELECT sequence_id, source_frame, target_frame, count(*) AS n, sqrt(avg(d2)) AS e FROM matched GROUP BY ALL) USING (sequence_id, source_frame, target_frame)""")
def _(spark, d):
    source, matched = _correspondence(spark, d)
    return rounded(neighbors.registration_score(source, matched, registration.PAIR).drop("n_matched"), "fitness", "rmse")


@query("color_gradient", "cloud", f"SELECT {FRAME}, point_id, true AS finite FROM cloud")
def _(spark, d):
    out = neighbors.color_gradient(stored(neighbors.estimate_normals(_cloud(spark, d), 0.3), "normals"), 0.3)
    along = F.col("dx") * F.col("nx") + F.col("dy") * F.col("ny") + F.col("dz") * F.col("nz")
    size = 1 + F.abs("dx") + F.abs("dy") + F.abs("dz")
    return out.select("sequence_id", "frame_index", "point_id", (F.abs(along) <= 0.01 * size).alias("finite"))


# --- registration


@query("icp_normal_eq", "cloud", f"""+ {MATCHED}, j AS (SELECT *, y AS j0, -x AS j1, CAST(0 AS DOUBLE) AS j2, z - oz AS res FROM matched)
  SELECT sequence_id, source_frame, target_frame, count(*) AS n_matched, {r("sum(j0 * j0)")} AS a00, {r("sum(j0 * j1)")} AS a01, {r("sum(j1)")} AS a15, {r("count(*)")} AS a55, {r("sum(-j0 * res)")} AS b0, {r("sum(-res)")} AS b5
  FROM j GROUP BY 1, 2, 3""")
def _(spark, d):
    matched = _correspondence(spark, d)[1].withColumns({"o_nx": F.lit(0.0), "o_ny": F.lit(0.0), "o_nz": F.lit(1.0)})
    out = registration.icp_normal_eq(matched).select(*registration.PAIR, "n_matched", "a00", "a01", "a15", "a55", "b0", "b5")
    return rounded(out, "a00", "a01", "a15", "a55", "b0", "b5")


def _shifted_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every frame's cloud with a copy of it that is moved by a centimetre: the copy is the target, named -1 - frame."""
    cloud = _cloud(spark, d)
    copy = cloud.withColumn("frame_index", -1 - F.col("frame_index")).withColumn("x", F.col("x") + 0.01)
    pairs = cloud.select("sequence_id", "frame_index").distinct()
    return pairs.select("sequence_id", F.col("frame_index").alias("source_frame"), (-1 - F.col("frame_index")).alias("target_frame")), cloud.unionByName(copy)


def _scores(out: DataFrame) -> DataFrame:
    return rounded(out.select(*registration.PAIR, "fitness", "rmse", geometry.translation_m(F.col("T")).alias("moved")), "fitness", "rmse", "moved", n=4)


@query("icp_point_to_plane")
def _(spark, d):
    pairs, both = _shifted_pairs(spark, d)
    return _scores(registration.icp_point_to_plane(pairs, both, 0.1))


@query("icp_colored")
def _(spark, d):
    pairs, both = _shifted_pairs(spark, d)
    return _scores(registration.icp_colored(pairs, both, 0.1))


@query("icp_colored_v1")
def _(spark, d):
    pairs, both = _shifted_pairs(spark, d)
    return _scores(registration.icp_colored_v1(pairs, both, 0.1))


@query("init_transform", "registrations", "SELECT sequence_id, frame_index, 0.0127::DOUBLE AS moved, CAST(0 AS DOUBLE) AS turned FROM registrations")
def _(spark, d):
    t = poses.init_transform(0.0127, 1)
    return rounded(relation(spark, d, "registrations").select("sequence_id", "frame_index", geometry.translation_m(t).alias("moved"), geometry.rotation_deg(t).alias("turned")), "moved", "turned")


@query("recover_tighter_crop", "cloud", f"""+ m AS (SELECT {FRAME}, quantile_cont(z, 0.5) AS med, quantile_cont(z, 0.9) AS hi FROM cloud GROUP BY ALL),
  a AS (SELECT {FRAME}, med, hi, quantile_cont(abs(z - med), 0.5) AS mad FROM cloud JOIN m USING (sequence_id, frame_index) GROUP BY ALL)
  SELECT {FRAME}, count(*) AS n FROM cloud JOIN a USING (sequence_id, frame_index) WHERE z <= CASE WHEN mad > 0 THEN med + 2 * mad ELSE hi END + 1e-9 GROUP BY 1, 2""")
def _(spark, d):
    return pixels.clip_depth_mad(_cloud(spark, d)).groupBy("sequence_id", "frame_index").agg(F.count("*").alias("n"))


@query("recover_voxel", "cloud", f"""+ lo AS (SELECT {FRAME}, min(x) - 0.037::DOUBLE AS lx, min(y) - 0.037::DOUBLE AS ly, min(z) - 0.037::DOUBLE AS lz FROM cloud GROUP BY ALL)
  SELECT {FRAME}, count(DISTINCT (floor((x - lx) / 0.074::DOUBLE), floor((y - ly) / 0.074::DOUBLE), floor((z - lz) / 0.074::DOUBLE))) AS n FROM cloud JOIN lo USING (sequence_id, frame_index) GROUP BY 1, 2""")
def _(spark, d):
    return neighbors.voxel_downsample(_cloud(spark, d), max(2 * VOXEL, 1e-4)).groupBy("sequence_id", "frame_index").agg(F.count("*").alias("n"))


@query("recover_denoise", "cloud", f"+ {statistical('cloud', 30, 1.5, 'good')} SELECT {FRAME}, count(*) AS n FROM good GROUP BY 1, 2")
def _(spark, d):
    return neighbors.outlier_statistical(_cloud(spark, d), 30, 1.5).groupBy("sequence_id", "frame_index").agg(F.count("*").alias("n"))


@query("recover_reseed", "registrations", "SELECT sequence_id, frame_index, 0.00127::DOUBLE AS moved FROM registrations WHERE fitness < 0.3")
def _(spark, d):
    again = relation(spark, d, "registrations").where("fitness < 0.3")
    return rounded(again.select("sequence_id", "frame_index", geometry.translation_m(poses.init_transform(0.00127)).alias("moved")), "moved")


@query("recover_p2p")
def _(spark, d):
    pairs, both = _shifted_pairs(spark, d)
    return _scores(registration.icp_point_to_plane(pairs, both, 0.2))


@query("recovery_order", "registrations", """SELECT sequence_id, frame_index, CASE frame_index % 7 WHEN 0 THEN 'tighter_crop' WHEN 1 THEN 'voxel_downsample' WHEN 2 THEN 'denoise'
  WHEN 3 THEN 'reseed_init' WHEN 4 THEN 'point_to_plane' END AS strategy FROM registrations""")
def _(spark, d):
    rows = relation(spark, d, "registrations").withColumn("attempt", F.col("frame_index") % 7)
    return agent.recovery_order(rows).select("sequence_id", "frame_index", "strategy")


@query("recovery_loop", "registrations", f"""+ g AS (SELECT *, list_filter([0, 1, 2, 3, 4, 5], lambda k: NOT (fitness + 0.1::DOUBLE * k < 0.3 OR rmse - 0.002::DOUBLE * k > 0.015 OR tx > 0.05 OR rot_deg > 10))[1] AS k FROM registrations)
  SELECT sequence_id, frame_index, CASE WHEN k = 0 THEN 'OK' WHEN k IS NULL THEN 'REJECTED' ELSE 'RECOVERED' END AS status, coalesce(k, 5) AS attempts,
  CASE WHEN k > 0 THEN ['tighter_crop', 'voxel_downsample', 'denoise', 'reseed_init', 'point_to_plane'][k] END AS recovered_via FROM g""")
def _(spark, d):
    rows = relation(spark, d, "registrations").withColumn("T", geometry.rotation_z(F.col("rot_deg"), F.col("tx")))
    tries = {s: rows.withColumns({"fitness": F.col("fitness") + 0.1 * (k + 1), "rmse": F.col("rmse") - 0.002 * (k + 1)}) for k, s in enumerate(agent.STRATEGIES[:5])}
    return agent.recovery_loop(rows, tries).select("sequence_id", "frame_index", "status", "attempts", "recovered_via")


@query("agent_config", "registrations", """SELECT sequence_id, frame_index, CASE WHEN NOT (a OR b OR c OR e) THEN 'accept' WHEN frame_index % 6 < 2 THEN 'retry' ELSE 'reject' END AS action,
  concat_ws('; ', CASE WHEN a THEN 'fitness' END, CASE WHEN b THEN 'rmse' END, CASE WHEN c THEN 'translation' END, CASE WHEN e THEN 'rotation' END) AS failing,
  CASE frame_index % 6 WHEN 0 THEN 'tighter_crop' WHEN 1 THEN 'denoise' END AS strategy
  FROM (SELECT *, fitness < 0.4 AS a, rmse > 0.01 AS b, tx > 0.04 AS c, rot_deg > 6 AS e FROM registrations)""")
def _(spark, d):
    """Verdicts and strategies under settings that all differ from the usual ones."""
    config = agent.AgentConfig(
        fitness_floor=0.4, rmse_ceiling=0.01, translation_factor=2.0, translation_cap_m=0.03, rotation_cap_deg=6.0, max_retries=2, enabled=("denoise", "feature_init", "tighter_crop")
    )
    rows = _registrations(spark, d).withColumn("attempt", F.col("frame_index") % 6)
    out = agent.recovery_order(agent.judge(rows, 0.02, F.col("attempt"), config=config, transform=None), config=config)
    return out.select("sequence_id", "frame_index", "action", F.regexp_replace("reason", "(?<=[a-z]) [^;]*", "").alias("failing"), "strategy")


def _features(spark: SparkSession, d: str) -> DataFrame:
    return registration.fpfh(stored(neighbors.estimate_normals(_cloud(spark, d), 0.3), "normals"), 0.08, 100)


_BIN = lambda x: f"CAST(greatest(0, least(10, floor(round(11 * ({x}), 9)))) AS INT)"
FEATURES = f"""+ n AS (SELECT *, sqrt(x * x + y * y + z * z) AS l, x / l AS nx, y / l AS ny, z / l AS nz FROM cloud),
  near AS (SELECT {FRAME}, a.point_id AS i, b.point_id AS j, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2, (b.x - a.x) / sqrt(d2) AS ex, (b.y - a.y) / sqrt(d2) AS ey, (b.z - a.z) / sqrt(d2) AS ez,
    a.nx * ex + a.ny * ey + a.nz * ez AS me, b.nx * ex + b.ny * ey + b.nz * ez AS other, abs(me) < abs(other) AS swap, CASE WHEN swap THEN -1 ELSE 1 END AS s,
    CASE WHEN swap THEN b.nx ELSE a.nx END AS ux, CASE WHEN swap THEN b.ny ELSE a.ny END AS uy, CASE WHEN swap THEN b.nz ELSE a.nz END AS uz,
    CASE WHEN swap THEN a.nx ELSE b.nx END AS mx, CASE WHEN swap THEN a.ny ELSE b.ny END AS my, CASE WHEN swap THEN a.nz ELSE b.nz END AS mz,
    s * (ey * uz - ez * uy) AS wx, s * (ez * ux - ex * uz) AS wy, s * (ex * uy - ey * ux) AS wz, sqrt(wx * wx + wy * wy + wz * wz) AS wl, wx / wl AS vx, wy / wl AS vy, wz / wl AS vz
    FROM n a JOIN n b USING (sequence_id, frame_index) WHERE d2 > 0 AND d2 <= 0.16::DOUBLE),
  bins AS (SELECT {FRAME}, i, j, unnest([{_BIN("(atan2((uy * vz - uz * vy) * mx + (uz * vx - ux * vz) * my + (ux * vy - uy * vx) * mz, ux * mx + uy * my + uz * mz) + pi()) / (2 * pi())")},
    11 + {_BIN("(vx * mx + vy * my + vz * mz + 1) / 2")}, 22 + {_BIN("(CASE WHEN swap THEN -other ELSE me END + 1) / 2")}]) AS bin FROM near WHERE wl > 0),
  own AS (SELECT {FRAME}, i, bin, 300 * count(*) / sum(count(*)) OVER (PARTITION BY {FRAME}, i) AS part FROM bins GROUP BY {FRAME}, i, bin),
  mixed AS (SELECT {FRAME}, a.i, b.bin, sum(b.part / a.d2) AS mix FROM near a JOIN own b USING (sequence_id, frame_index) WHERE b.i = a.j GROUP BY {FRAME}, a.i, b.bin),
  every AS (SELECT * FROM own UNION ALL SELECT {FRAME}, i, bin, 100 * mix / sum(mix) OVER (PARTITION BY {FRAME}, i, bin // 11) FROM mixed)
  SELECT {FRAME}, CAST(bin AS INT) AS bin, {{total}} AS total FROM every GROUP BY ALL"""


@query("fpfh", "cloud", FEATURES.format(total=r("sum(part)", 3)))
def _(spark, d):
    """Sums of the bins of each frame, with normals along the rays, which SQL can say too."""
    away = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    found = registration.fpfh(_cloud(spark, d).withColumns({f"n{c}": F.col(c) / away for c in "xyz"}), 0.08, 100)
    bins = found.select("sequence_id", "frame_index", F.posexplode("hist").alias("bin", "part")).where("part > 0")
    return rounded(bins.groupBy("sequence_id", "frame_index", "bin").agg(F.sum("part").alias("total")), "total", n=3)


@query("feature_match")
def _(spark, d):
    pairs = _pair_sides(spark, d)[0]
    return registration.feature_match(pairs, stored(_features(spark, d), "features"))


@query("recover_feature_init")
def _(spark, d):
    pairs = _pair_sides(spark, d)[0]
    matches = stored(registration.feature_match(pairs, stored(_features(spark, d), "features")), "matches")
    out = registration.recover_feature_init(matches, _cloud(spark, d), 0.1)
    return out.select(*registration.PAIR, "inliers")


# --- agent, poses


@query("rotation_magnitude", "registrations", f"SELECT sequence_id, frame_index, {r('rot_deg', 4)} AS rotation_deg FROM registrations")
def _(spark, d):
    out = relation(spark, d, "registrations").select("sequence_id", "frame_index", geometry.rotation_deg(geometry.rotation_z(F.col("rot_deg"))).alias("rotation_deg"))
    return rounded(out, "rotation_deg", n=4)


@query("translation_magnitude", "registrations", f"SELECT sequence_id, frame_index, {r('tx')} AS translation_m FROM registrations")
def _(spark, d):
    return rounded(relation(spark, d, "registrations").select("sequence_id", "frame_index", geometry.translation_m(geometry.rotation_z(F.col("rot_deg"), F.col("tx"))).alias("translation_m")), "translation_m")


@query("median_mad", "registrations", f"""+ m AS (SELECT sequence_id, quantile_cont(fitness, 0.5) AS median FROM registrations GROUP BY 1)
  SELECT sequence_id, {r("median")} AS median, {r("quantile_cont(abs(fitness - median), 0.5)")} AS mad FROM registrations JOIN m USING (sequence_id) GROUP BY sequence_id, median""")
def _(spark, d):
    return rounded(agent.median_mad(relation(spark, d, "registrations"), ["sequence_id"], "fitness"), "median", "mad")


def limit(column: str, sign: str) -> str:
    return f"(list_median(w_{column}) {sign} 3 * list_median(list_transform(w_{column}, lambda q: abs(q - list_median(w_{column})))))"


@query("adaptive_thresholds", "registrations", f"""+ w AS (SELECT *, list(fitness) OVER w AS w_fitness, list(rmse) OVER w AS w_rmse, frame_index AS before FROM registrations
  WINDOW w AS (PARTITION BY sequence_id ORDER BY frame_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
  SELECT sequence_id, frame_index, {r(f"CASE WHEN before >= 8 THEN greatest(0.3, {limit('fitness', '-')}) ELSE 0.3 END")} AS min_fitness,
  {r(f"CASE WHEN before >= 8 THEN least(0.015, {limit('rmse', '+')}) ELSE 0.015 END")} AS max_rmse FROM w""")
def _(spark, d):
    out = agent.adaptive_thresholds(relation(spark, d, "registrations")).select("sequence_id", "frame_index", "min_fitness", "max_rmse")
    return rounded(out, "min_fitness", "max_rmse")


@query("judge", "registrations", """SELECT sequence_id, frame_index, CASE WHEN NOT (a OR b OR c OR e) THEN 'accept' WHEN frame_index % 6 < 5 THEN 'retry' ELSE 'reject' END AS action,
  concat_ws('; ', CASE WHEN a THEN 'fitness' END, CASE WHEN b THEN 'rmse' END, CASE WHEN c THEN 'translation' END, CASE WHEN e THEN 'rotation' END) AS failing
  FROM (SELECT *, fitness < 0.3 AS a, rmse > 0.015 AS b, tx > 0.05 AS c, rot_deg > 10 AS e FROM registrations)""")
def _(spark, d):
    out = agent.judge(_registrations(spark, d), 0.001, F.col("frame_index") % 6, transform=None)
    return out.select("sequence_id", "frame_index", "action", F.regexp_replace("reason", "(?<=[a-z]) [^;]*", "").alias("failing"))


def _scan(where: str = "true") -> str:
    """The ordered scan as a recursive table ``scan``: a step goes on by one frame in all sequences, with the windows as lists."""
    limit = lambda best, floor, sign, of: f"CASE WHEN n >= 8 AND len({of}) >= 3 THEN {best}({floor}::DOUBLE, list_median({of}) {sign} 3 * list_median(list_transform({of}, lambda x: abs(x - list_median({of}))))) ELSE {floor}::DOUBLE END"
    keep = lambda window, value: f"CASE WHEN good THEN list_append({window}, {value})[greatest(1, len({window}) - 18):] ELSE {window} END"
    return f"""+recursive m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY frame_index) AS place FROM registrations WHERE {where}),
  scan AS (SELECT sequence_id, place, frame_index, true AS good, 0.3::DOUBLE AS low, 0.015::DOUBLE AS high, [1.0::DOUBLE] AS fits, [0.0::DOUBLE] AS errs, 1 AS n, 0 AS rejects FROM m WHERE place = 1
  UNION ALL SELECT sequence_id, place, frame_index, good, low, high, {keep('fits', 'fitness')}, {keep('errs', 'rmse')}, n + good::INT, CASE WHEN good THEN 0 ELSE rejects + 1 END FROM
  (SELECT *, fitness >= low AND rmse <= high AND tx <= 0.05 AND rot_deg <= 10 AS good FROM
  (SELECT m.*, fits, errs, n, rejects, {limit('greatest', 0.3, '-', 'fits')} AS low, {limit('least', 0.015, '+', 'errs')} AS high
  FROM scan s JOIN m ON m.sequence_id = s.sequence_id AND m.place = s.place + 1)))"""


SCANNED = f"SELECT sequence_id, frame_index, good AS accepted, {r('low')} AS min_fitness, {r('high')} AS max_rmse, rejects >= 3 AS fallback"


@query("agent_scan", "registrations", f"{_scan()} {SCANNED} FROM scan")
def _(spark, d):
    return rounded(agent.agent_scan(_registrations(spark, d), 0.001), "min_fitness", "max_rmse")


ACCEPTED = "acc AS (SELECT *, NOT (fitness < 0.3 OR rmse > 0.015) AS accepted FROM registrations)"


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    return _registrations(spark, d).withColumn("accepted", ~((F.col("fitness") < 0.3) | (F.col("rmse") > 0.015)))


@query("consecutive_rejects", "registrations", f"""+ {ACCEPTED}, i AS (SELECT *, sum(CAST(accepted AS INT)) OVER (PARTITION BY sequence_id ORDER BY frame_index) AS island FROM acc)
  SELECT sequence_id, frame_index, n AS rejects, n >= 3 AS fallback FROM (SELECT sequence_id, frame_index, CASE WHEN accepted THEN 0 ELSE
  count(*) FILTER (NOT accepted) OVER (PARTITION BY sequence_id, island ORDER BY frame_index) END AS n FROM i)""")
def _(spark, d):
    return agent.consecutive_rejects(_accepted(spark, d)).select("sequence_id", "frame_index", "rejects", "fallback")


@query("simple_accept", "registrations", "SELECT sequence_id, frame_index, fitness > 0 OR frame_index < 3 AS accepted FROM registrations")
def _(spark, d):
    return agent.simple_accept(relation(spark, d, "registrations")).select("sequence_id", "frame_index", "accepted")


@query("target_chain", "registrations", f"""+ {ACCEPTED} SELECT sequence_id, frame_index, last_value(CASE WHEN accepted THEN frame_index END IGNORE NULLS) OVER
  (PARTITION BY sequence_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target FROM acc""")
def _(spark, d):
    return agent.target_chain(_accepted(spark, d)).select("sequence_id", "frame_index", "target")


@query("consecutive_pairs", "cloud", f"+ {PAIRS} SELECT * FROM pairs")
def _(spark, d):
    return _pair_sides(spark, d)[0]


@query("pose_chain", "registrations", f"""+ {ACCEPTED}, a AS (SELECT *, sum(CASE WHEN k = 1 THEN 0 ELSE rot_deg END) OVER (PARTITION BY sequence_id ORDER BY frame_index) AS angle FROM
  (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY frame_index) AS k FROM acc WHERE accepted)),
  b AS (SELECT *, coalesce(lag(angle) OVER (PARTITION BY sequence_id ORDER BY frame_index), 0) AS before FROM a)
  SELECT sequence_id, frame_index, {r("sum(CASE WHEN k = 1 THEN 0 ELSE tx * cos(radians(before)) END) OVER (PARTITION BY sequence_id ORDER BY frame_index)", 5)} AS px,
  {r("sum(CASE WHEN k = 1 THEN 0 ELSE tx * sin(radians(before)) END) OVER (PARTITION BY sequence_id ORDER BY frame_index)", 5)} AS py, {r("cos(radians(angle))", 5)} AS c FROM b""")
def _(spark, d):
    rows = _accepted(spark, d).where("accepted").withColumn("T", geometry.rotation_z(F.col("rot_deg"), F.col("tx")))
    out = poses.pose_chain(rows.select("sequence_id", "frame_index", "T"))
    p = F.col("pose")
    return rounded(out.select("sequence_id", "frame_index", p[3].alias("px"), p[7].alias("py"), p[0].alias("c")), "px", "py", "c", n=5)


@query("kinematic_pose", "registrations", f"SELECT sequence_id, frame_index, {r('frame_index * 0.00127::DOUBLE')} AS place, {r('-frame_index * 0.00127::DOUBLE')} AS back FROM registrations")
def _(spark, d):
    out = poses.kinematic_pose(relation(spark, d, "registrations").select("sequence_id", "frame_index"), 0.00127)
    return rounded(out.select("sequence_id", "frame_index", F.col("pose")[3].alias("place"), F.col("extrinsic")[3].alias("back")), "place", "back")


@query("position_pose", "capture", f"+ {ASOF} SELECT sequence_id, frame_index, {r('position_m - first_value(position_m) OVER (PARTITION BY sequence_id ORDER BY frame_index)')} AS place FROM placed")
def _(spark, d):
    frames = _frames_at(spark, d)
    out = poses.position_pose(frames.select("sequence_id", "frame_index"), frames)
    return rounded(out.select("sequence_id", "frame_index", F.col("pose")[3].alias("place")), "place")


@query("step_per_pair", "registrations", f"SELECT sequence_id, frame_index, {r('0.00127::DOUBLE * (1 + sequence_id % 5)')} AS step_m FROM registrations")
def _(spark, d):
    step = poses.step_per_pair(F.lit(0.00127), 1 + F.col("sequence_id") % 5)
    return rounded(relation(spark, d, "registrations").select("sequence_id", "frame_index", step.alias("step_m")), "step_m")


@query("preset_params", "frame_files", """SELECT path, CAST(CASE WHEN i THEN 5000 ELSE 1000 END AS DOUBLE) AS depth_scale, CAST(CASE WHEN i THEN 4.0 ELSE 3.5 END AS DOUBLE) AS depth_trunc, CASE WHEN i THEN 30 ELSE 80 END AS max_iter,
  NOT i AS known_poses FROM (SELECT path, contains(lower(path), 'icl') AS i FROM (SELECT CASE WHEN sequence_id = 'seq_3' THEN replace(path, 'cap', 'ICL') ELSE path END AS path FROM frame_files))""")
def _(spark, d):
    path = F.when(F.col("sequence_id") == "seq_3", F.replace("path", F.lit("cap"), F.lit("ICL"))).otherwise(F.col("path"))
    return poses.preset_params(relation(spark, d, "frame_files").select(path.alias("path"))).select("path", "depth_scale", "depth_trunc", "max_iter", "known_poses")


# --- merging and volumes

POSED = """posed AS (SELECT sequence_id, frame_index, radians((frame_index * 7) % 90) AS a, (frame_index % 10) / CAST(100 AS DOUBLE) AS tx FROM (SELECT DISTINCT sequence_id, frame_index FROM cloud))"""
TURNED = f"""turned AS (SELECT {FRAME}, point_id, cos(a) * x - sin(a) * y + tx AS x, sin(a) * x + cos(a) * y AS y, z FROM cloud JOIN posed USING (sequence_id, frame_index))"""


def _posed(spark: SparkSession, d: str) -> DataFrame:
    frames = _cloud(spark, d).select("sequence_id", "frame_index").distinct()
    pose = geometry.rotation_z(((F.col("frame_index") * 7) % 90).cast("double"), (F.col("frame_index") % 10) / F.lit(100.0))
    return frames.withColumn("pose", pose)


@query("transform_points", "cloud", f"+ {POSED}, {TURNED} SELECT {FRAME}, point_id, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z FROM turned")
def _(spark, d):
    return rounded(poses.transform_points(_cloud(spark, d), _posed(spark, d)).select("sequence_id", "frame_index", "point_id", "x", "y", "z"), "x", "y", "z")


@query("merge_clouds", "cloud", f"+ {POSED}, {TURNED} SELECT sequence_id, count(*) AS n, {r('sum(x)', 4)} AS x, {r('sum(y)', 4)} AS y FROM turned WHERE frame_index % 3 <> 0 GROUP BY 1")
def _(spark, d):
    merged = poses.merge_clouds(_cloud(spark, d), _posed(spark, d).where("frame_index % 3 != 0"))
    return rounded(merged.groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")), "x", "y", n=4)


TSDF = 0.213
CELL = f"CAST(floor({{c}} / {TSDF}::DOUBLE) AS BIGINT)"
VOLUME = f"""{MASKED}, frame_at AS (SELECT {FRAME}, (row_number() OVER (PARTITION BY sequence_id ORDER BY frame_index) - 1) * 0.01::DOUBLE AS pl FROM (SELECT DISTINCT {FRAME} FROM masked)),
  pts AS (SELECT {FRAME}, (u - 3.5::DOUBLE) * (depth_raw / 1000::DOUBLE) / 6 + pl AS x, (v - 3.5::DOUBLE) * (depth_raw / 1000::DOUBLE) / 6 AS y, depth_raw / 1000::DOUBLE AS z FROM masked JOIN frame_at USING (sequence_id, frame_index)
  WHERE depth_raw > 0 AND depth_raw / 1000::DOUBLE < {TRUNC}),
  own AS (SELECT DISTINCT {FRAME}, {CELL.format(c="x")} AS ix, {CELL.format(c="y")} AS iy, {CELL.format(c="z")} AS iz FROM pts),
  near AS (SELECT DISTINCT {FRAME}, ix, iy, iz + k AS iz FROM (SELECT DISTINCT {FRAME}, ix, iy + j AS iy, iz FROM (SELECT DISTINCT {FRAME}, ix + i AS ix, iy, iz FROM own,
  (SELECT unnest(range(-4, 5)) AS i)), (SELECT unnest(range(-4, 5)) AS j)), (SELECT unnest(range(-4, 5)) AS k)),
  seen AS (SELECT {FRAME}, ix, iy, iz, z, CAST(floor(6 * x / z + 3.5 + 0.5) AS INT) AS u, CAST(floor(6 * y / z + 3.5 + 0.5) AS INT) AS v FROM
  (SELECT {FRAME}, ix, iy, iz, (ix + 0.5) * {TSDF}::DOUBLE - pl AS x, (iy + 0.5) * {TSDF}::DOUBLE AS y, (iz + 0.5) * {TSDF}::DOUBLE AS z FROM near JOIN frame_at USING (sequence_id, frame_index)) WHERE z > 0),
  voxels AS (SELECT sequence_id, ix, iy, iz, avg(least(1, sdf / {4 * TSDF}::DOUBLE)) AS tsdf, count(*) AS weight, avg(r / 255::DOUBLE) AS r FROM
  (SELECT s.*, m.r, m.depth_raw / 1000::DOUBLE - z AS sdf FROM seen s JOIN masked m USING (sequence_id, frame_index, u, v) WHERE m.depth_raw > 0) WHERE sdf >= {-4 * TSDF}::DOUBLE GROUP BY ALL)"""


def _voxels(spark: SparkSession, d: str) -> DataFrame:
    masked = stored(_masked(spark, d), "masked")
    at = poses.kinematic_pose(masked.select("sequence_id", "frame_index").distinct(), 0.01)
    return volume.tsdf_integrate(masked, at, CAMERA, TSDF, SCALE, TRUNC)


@query("tsdf_integrate", "pixels", f"+ {VOLUME} SELECT sequence_id, ix, iy, iz, {r('tsdf', 5)} AS tsdf, weight, {r('r', 5)} AS r FROM voxels")
def _(spark, d):
    return rounded(_voxels(spark, d).drop("g", "b"), "tsdf", "r", n=5)


def crossing(axis: str) -> str:
    shift = " AND ".join(f"b.i{c} = a.i{c}{' + 1' if c == axis else ''}" for c in "xyz")
    place = ", ".join(f"(a.i{c} + 0.5 + {'a.tsdf / (a.tsdf - b.tsdf)' if c == axis else '0'}) * {TSDF}::DOUBLE AS {c}" for c in "xyz")
    return f"SELECT a.sequence_id, {place} FROM voxels a JOIN voxels b ON a.sequence_id = b.sequence_id AND {shift} WHERE a.tsdf * b.tsdf < 0"


@query("tsdf_extract", "pixels", f"""+ {VOLUME}, s AS ({' UNION ALL '.join(crossing(c) for c in 'xyz')}) SELECT sequence_id, {r('x', 4)} AS x, {r('y', 4)} AS y, {r('z', 4)} AS z FROM s""")
def _(spark, d):
    return rounded(volume.tsdf_extract(stored(_voxels(spark, d), "voxels"), TSDF).select("sequence_id", "x", "y", "z"), "x", "y", "z", n=4)


@query("reconstruct_tsdf")
def _(spark, d):
    out = reconstruct.reconstruct_tsdf(_pixels(spark, d), CAMERA, SCALE, TRUNC, NEAR, TSDF, 0.01)
    return rounded(reconstruct.batch_sequences(out), *[f"{m}_{c}" for m in ("min", "max") for c in "xyz"], n=4)


#: On the ground scene with the floors alone and the one strategy that can help there; adaptive limits have queries of their own.
SCENE_AGENT = agent.AgentConfig(fitness_floor=0.5, cold_start=1 << 30, enabled=("point_to_plane",))


@query("reconstruct_icp", (), f"""WITH f AS (SELECT s_suppkey % 2 AS sequence_id, s_suppkey AS frame_index, s_suppkey // 2 AS place FROM supplier),
  g AS (SELECT *, CASE WHEN place % 20 IN ({UNREADABLE}, {BLANK}) THEN 'FAILED' WHEN place % 20 = {AWAY} THEN 'REJECTED' WHEN place % 20 IN ({LOWERED}, {LOWERED + 1}) THEN 'RECOVERED' ELSE 'OK' END AS status FROM f)
  SELECT sequence_id, frame_index, status, CASE WHEN status <> 'FAILED' THEN last_value(CASE WHEN status IN ('OK', 'RECOVERED') THEN frame_index END IGNORE NULLS)
    OVER (PARTITION BY sequence_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS target,
  CASE WHEN status IN ('RECOVERED', 'REJECTED') THEN 1 ELSE 0 END AS attempts, CASE WHEN status IN ('RECOVERED', 'REJECTED') THEN 'point_to_plane' END AS last_strategy,
  CASE WHEN place % 20 = {UNREADABLE} THEN 'imread failed' WHEN place % 20 = {BLANK} THEN 'empty cloud' WHEN status = 'REJECTED' THEN 'fitness 0.000 < 0.500' ELSE '' END AS reason FROM g""")
def _(spark, d):
    seen, problems = ground(spark, d)
    _, outcomes = reconstruct.reconstruct_icp(seen, GROUND_CAMERA, GROUND_SCALE, TRUNC, 0, GROUND_STEP, expected_step_m=GROUND_STEP, config=SCENE_AGENT, problems=problems)
    return outcomes.select("sequence_id", "frame_index", "status", "target", "attempts", "last_strategy", "reason")


@query("reconstruct_simple")
def _(spark, d):
    merged, judged = reconstruct.reconstruct_simple(_pixels(spark, d), CAMERA, SCALE, 0.15, 2)
    n = merged.groupBy("sequence_id").agg(F.count("*").alias("n_points"))
    return judged.groupBy("sequence_id").agg(F.count_if("accepted").alias("n_accepted")).join(n, "sequence_id")


@query("batch_sequences", (), f"""WITH f AS (SELECT s_suppkey % 2 AS bed, s_suppkey // 2 AS place FROM supplier),
  g AS (SELECT bed, CASE WHEN place % 20 IN ({UNREADABLE}, {BLANK}) THEN 'FAILED' WHEN place % 20 = {AWAY} THEN 'REJECTED' WHEN place % 20 IN ({LOWERED}, {LOWERED + 1}) THEN 'RECOVERED' ELSE 'OK' END AS status FROM f)
  SELECT concat('bed_', CAST(bed AS VARCHAR)) AS sequence_id, count(*) AS n_frames, count(*) FILTER (status = 'OK') AS n_ok, count(*) FILTER (status = 'RECOVERED') AS n_recovered,
  count(*) FILTER (status = 'REJECTED') AS n_rejected, count(*) FILTER (status = 'FAILED') AS n_failed, CASE WHEN count(*) FILTER (status IN ('REJECTED', 'FAILED')) > 0 THEN 'PARTIAL' ELSE 'OK' END AS status, '' AS reason FROM g GROUP BY 1
  UNION ALL SELECT 'bed_2', 0, 0, 0, 0, 0, 'FAILED', 'no depth images'""")
def _(spark, d):
    """A tree of folders with the ground scene's images, unreadable and blank ones among them, and a bed without depth images; all in one run."""
    seen, lost = ground(spark, d)
    good = _as_png(seen, 18, 16).withColumn("sequence_id", F.concat(F.lit("bed_"), "sequence_id"))
    bad = lost.select(F.concat(F.lit("bed_"), "sequence_id").alias("sequence_id"), F.col("frame_index").cast("long").alias("frame_index"), *[F.lit(b"lost").alias(k) for k in ("rgb", "depth")])
    encoded = stored(good.unionByName(bad), "encoded")
    broken = encoded.withColumns({"sequence_id": F.lit("bed_2"), "depth": F.lit(None).cast("binary")})
    root = f"{shared_dir(spark)}/beds-{uuid.uuid4().hex}"
    images.save_frames(encoded.unionByName(broken), root)
    _, _, outcomes = folders.reconstruct_folders(spark, root, GROUND_CAMERA, GROUND_SCALE, TRUNC, voxel=GROUND_STEP, expected_step_m=GROUND_STEP, config=SCENE_AGENT)
    return outcomes.select("sequence_id", "n_frames", "n_ok", "n_recovered", "n_rejected", "n_failed", "status", "reason")


@query("outcome_summary", "registrations", f"+ {JUDGED} SELECT sequence_id, status, reason, count(*) AS n_frames FROM judged GROUP BY ALL")
def _(spark, d):
    return quality.outcome_summary(_statuses(spark, d))


# --- quality


@query("depth_validity", "pixels", f"""SELECT {FRAME}, {r("avg(CAST(depth_raw BETWEEN 1 AND 3500 AS INT))")} AS depth_validity, {r("coalesce(quantile_cont(depth_raw, 0.5) FILTER (depth_raw BETWEEN 1 AND 3500), 0)")} AS median_depth
  FROM pixels GROUP BY 1, 2""")
def _(spark, d):
    return rounded(quality.depth_validity(_pixels(spark, d), 3500), "depth_validity", "median_depth")


@query("depth_profile", "pixels", f"""+ f AS (SELECT {FRAME} FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY frame_index) - 1 AS pl, count(*) OVER (PARTITION BY sequence_id) AS n
  FROM (SELECT DISTINCT {FRAME} FROM pixels)) WHERE pl = n // 2), p AS (SELECT *, nullif(depth_raw, 0) AS dd FROM pixels JOIN f USING (sequence_id, frame_index))
  SELECT {FRAME}, count(dd) AS n_valid, {r("100 * count(dd) / CAST(count(*) AS DOUBLE)")} AS percent, min(dd) AS least, {r("quantile_cont(dd, 0.5)")} AS median, max(dd) AS greatest FROM p GROUP BY 1, 2""")
def _(spark, d):
    return rounded(quality.depth_profile(_pixels(spark, d)), "percent", "median")


@query("pair_metrics", "cloud", f"""+ {PAIRS}, v AS (SELECT {FRAME}, avg(CAST(depth_raw BETWEEN 1 AND 4000 AS INT)) AS dv, coalesce(quantile_cont(depth_raw, 0.5) FILTER (depth_raw BETWEEN 1 AND 4000), 0) AS md FROM pixels GROUP BY ALL),
  n AS (SELECT {FRAME}, count(*) AS n_points FROM cloud GROUP BY ALL)
  SELECT sequence_id, row_number() OVER (PARTITION BY sequence_id ORDER BY source_frame) - 1 AS pair_index, {r("dv")} AS depth_validity, {r("md / 1000")} AS median_depth_m, n_points, 0.5::DOUBLE AS icp_fitness, '' AS error
  FROM pairs JOIN v USING (sequence_id) JOIN n USING (sequence_id, frame_index) WHERE frame_index = source_frame""")
def _(spark, d):
    pairs = _pair_sides(spark, d)[0]
    scores = pairs.withColumns({"fitness": F.lit(0.5), "rmse": F.lit(0.01), "rotation_deg": F.lit(1.0)})
    out = quality.pair_metrics(pairs, quality.depth_validity(_pixels(spark, d), 4000), quality.point_count(_cloud(spark, d)), scores)
    return rounded(out.drop("icp_rmse", "rotation_deg"), "depth_validity", "median_depth_m")


@query("quality_aggregate", "pair_metrics", f"+ {LONG}, {AGGREGATED} SELECT sequence_id, metric, {r('mean', 5)} AS mean, {r('median', 5)} AS median, {r('p25', 5)} AS p25, {r('p75', 5)} AS p75 FROM agg")
def _(spark, d):
    return rounded(_aggregates(spark, d), "mean", "median", "p25", "p75", n=5)


@query("quality_verdict", "pair_metrics", QUALITY + "SELECT * FROM verdicts")
def _(spark, d):
    return quality.quality_verdict(_aggregates(spark, d), places=None).withColumn("failing", F.array_join("failing", ", "))


@query("quick_check", "pair_metrics", """SELECT sequence_id, pair_index FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY md5('0 ' || sequence_id || ' ' || pair_index), pair_index) AS k FROM pair_metrics) WHERE k <= 15""")
def _(spark, d):
    return quality.quick_check(relation(spark, d, "pair_metrics")).select("sequence_id", "pair_index")


@query("full_report", "pair_metrics", QUALITY + """SELECT sequence_id, verdict, failing, n_pairs, n_errors FROM verdicts JOIN
  (SELECT sequence_id, count(*) AS n_pairs, count(*) FILTER (error <> '') AS n_errors FROM pair_metrics GROUP BY 1) USING (sequence_id)""")
def _(spark, d):
    return quality.full_report(relation(spark, d, "pair_metrics")).withColumn("failing", F.array_join("failing", ", "))


OTHER_LEVELS = LEVELS
for _usual, _other in (("f < 0.3", "f < 0.2"), ("f < 0.5", "f < 0.6"), ("e > 0.015", "e > 0.02"), ("e > 0.005", "e > 0.008"), ("v < 0.1", "v < 0.2"), ("v < 0.3", "v < 0.6"), ("t > 5", "t > 8"), ("t > 1 ", "t > 3 ")):
    OTHER_LEVELS = OTHER_LEVELS.replace(_usual, _other)


@query("quality_params", "pair_metrics", f"+ {LONG}, {AGGREGATED}, {OTHER_LEVELS}, {VERDICTS} SELECT * FROM verdicts")
def _(spark, d):
    """Verdicts under limits that all differ from the usual ones."""
    limits = quality.QualityThresholds(fitness=(0.2, 0.6), rmse=(0.02, 0.008), validity=(0.2, 0.6), rotation=(8.0, 3.0))
    return quality.quality_verdict(_aggregates(spark, d), limits, None).withColumn("failing", F.array_join("failing", ", "))


@query("gantry_phase_shift")
def _(spark, d):
    return rounded(quality.gantry_phase_shift(_pixels(spark, d), 0, 20), "sx", "sy", "response", n=4)


SHIFTS = "shifts AS (SELECT sequence_id, sum(tx) * 100 AS sx, sum(rot_deg) / 40 - 1 AS sy FROM registrations GROUP BY 1), depth AS (SELECT sequence_id, quantile_cont(1000 * fitness + 200, 0.5) AS md FROM registrations GROUP BY 1)"
STEPS = f"""{SHIFTS}, steps AS (SELECT sequence_id, CASE WHEN x THEN 'X' ELSE 'Y' END AS axis, px, abs(px) * md / 1000 / CASE WHEN x THEN 600 ELSE 610 END AS step_m, CASE WHEN px >= 0 THEN 1 ELSE -1 END AS direction FROM
  (SELECT sequence_id, md, abs(sx) >= abs(sy) AS x, CASE WHEN abs(sx) >= abs(sy) THEN sx ELSE sy END / 50 AS px FROM shifts JOIN depth USING (sequence_id)))"""


def _steps(spark: SparkSession, d: str) -> DataFrame:
    rows = relation(spark, d, "registrations")
    shifts = rows.groupBy("sequence_id").agg((F.sum("tx") * 100).alias("sx"), (F.sum("rot_deg") / 40 - 1).alias("sy"))
    depth = rows.groupBy("sequence_id").agg(F.percentile(1000 * F.col("fitness") + 200, F.lit(0.5)).alias("median_depth"))
    return quality.gantry_axis_step(shifts, depth, 600.0, 610.0)


@query("gantry_axis_step", "registrations", f"+ {STEPS} SELECT sequence_id, axis, {r('px', 5)} AS px_per_frame, {r('step_m', 5)} AS step_m, direction FROM steps")
def _(spark, d):
    return rounded(_steps(spark, d), "px_per_frame", "step_m", n=5)


@query("gantry_step_check", "registrations", f"+ {STEPS} SELECT sequence_id, {r('step_m / (0.038::DOUBLE / 30)', 4)} AS ratio, step_m / (0.038::DOUBLE / 30) > 1.5 OR step_m / (0.038::DOUBLE / 30) < 0.5 AS suspect FROM steps")
def _(spark, d):
    return rounded(quality.gantry_step_check(_steps(spark, d)).select("sequence_id", "ratio", "suspect"), "ratio", n=4)


@query("point_count", "points", f"SELECT {FRAME}, count(*) AS n_points FROM points GROUP BY 1, 2")
def _(spark, d):
    return quality.point_count(relation(spark, d, "points"))


@query("frame_counters", "registrations", f"+ {JUDGED} SELECT sequence_id, count(*) FILTER (status = 'OK') AS n_ok, count(*) FILTER (status <> 'OK') AS n_failed FROM judged GROUP BY 1")
def _(spark, d):
    return quality.frame_counters(_statuses(spark, d))


@query("fitness_band", "registrations", "SELECT sequence_id, frame_index, CASE WHEN fitness >= 0.5 THEN 'green' WHEN fitness >= 0.1 THEN 'orange' ELSE 'red' END AS band FROM registrations")
def _(spark, d):
    return relation(spark, d, "registrations").select("sequence_id", "frame_index", quality.fitness_band(F.col("fitness")).alias("band"))


# --- streams


def streamed(df: DataFrame, operator, mode: str = "append") -> DataFrame:
    """What a streaming operator gives when the rows of ``df`` arrive as files, all that are there at the start.

    In another mode than append each batch replaces the table of results, so a batch that is run again leaves the same.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = operator(spark.readStream.schema(df.schema).parquet(path))
    if mode == "append":
        running = out.writeStream.format("parquet").option("path", f"{path}-out")
    else:
        running = out.writeStream.foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{path}-out"))
    running.option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}-out")


@query("position_asof", "capture", f"+ {ASOF} SELECT sequence_id, event_id, frame_index, position_m FROM placed")
def _(spark, d):
    return _frames_at(spark, d).drop("ts")


@query("stream_position_asof", "capture", f"+ {ASOF} SELECT sequence_id, event_id, frame_index, position_m FROM placed")
def _(spark, d):
    events = relation(spark, d, "capture").withColumn("ts", F.col("ts").cast("timestamp"))
    return streamed(events.repartition("sequence_id"), capture.stream_position_asof).drop("ts")


@query("stream_frames", "pixels", f"SELECT DISTINCT CAST(sequence_id AS VARCHAR) AS sequence_id, frame_index FROM pixels")
def _(spark, d):
    """PNG files of both folders land in two steps: the depth image of every odd frame comes a step after its colour image."""
    path = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    frames, even = stored(_encoded(spark, d), "encoded"), F.col("frame_index") % 2 == 0
    first = frames.withColumn("depth", F.when(even, F.col("depth")))
    for step, kinds in ((first, ("rgb", "depth")), (frames.where(~even), ("depth",))):
        images.save_frames(step, f"{path}/in", kinds)
        joined = capture.stream_frames(spark, f"{path}/in").select("sequence_id", "frame_index")
        running = joined.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        running.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("sequence_id string, frame_index long").parquet(f"{path}/out")


STOPPED = f"{ASOF}, st AS (SELECT *, min(CASE WHEN frame_index % 2 = 0 AND position_m <> 0 AND position_m >= 0.78 THEN frame_index END) OVER (PARTITION BY sequence_id) AS stop FROM placed)"


@query("capture_stop", "capture", f"+ {STOPPED} SELECT sequence_id, frame_index, position_m FROM st WHERE stop IS NULL OR frame_index <= stop")
def _(spark, d):
    return capture.capture_stop(_frames_at(spark, d)).select("sequence_id", "frame_index", "position_m")


@query("capture_duration", "capture", f"+ {ASOF} SELECT sequence_id, frame_index, 6000000 AS expected FROM (SELECT *, min(ts) OVER (PARTITION BY sequence_id) AS t0 FROM placed) WHERE epoch(ts) - epoch(t0) < 200000")
def _(spark, d):
    return capture.capture_duration(_frames_at(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), 200_000, 30).select("sequence_id", "frame_index", "expected")


GAPS = f"{ASOF}, g AS (SELECT * FROM placed WHERE event_id % 5 <> 0 AND event_id % 7 <> 0)"


def _with_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _frames_at(spark, d).withColumns({"has_color": F.col("event_id") % 5 != 0, "has_depth": F.col("event_id") % 7 != 0})


@query("drop_incomplete", "capture", f"+ {GAPS} SELECT event_id, row_number() OVER (PARTITION BY sequence_id ORDER BY frame_index) - 1 AS frame_index FROM g")
def _(spark, d):
    return capture.drop_incomplete(_with_gaps(spark, d), False).select("event_id", "frame_index")


@query("drop_incomplete_gaps", "capture", f"+ {GAPS} SELECT event_id, frame_index FROM g")
def _(spark, d):
    return capture.drop_incomplete(_with_gaps(spark, d), True).select("event_id", "frame_index")


@query("session_rollup", "capture", f"+ {ASOF} SELECT sequence_id, count(*) AS n_frames, count(*) AS n_positions, {r('sum(position_m)', 4)} AS travelled FROM placed GROUP BY 1")
def _(spark, d):
    out = capture.session_rollup(_frames_at(spark, d))
    total = F.aggregate(F.map_values("frame_positions"), F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select("sequence_id", "n_frames", F.size("frame_positions").cast("long").alias("n_positions"), total.alias("travelled")), "travelled", n=4)


@query("capture_progress", "capture", f"+ {ASOF} SELECT sequence_id, frame_index, CAST(least(100, floor(100 * frame_index / CAST(nullif(sequence_id % 9 * 10, 0) AS DOUBLE))) AS INT) AS percent FROM placed".replace("least(100, floor(", "CASE WHEN sequence_id % 9 = 0 THEN NULL ELSE least(100, floor(").replace("AS DOUBLE))) AS INT)", "AS DOUBLE))) END AS INT)"))
def _(spark, d):
    rows = _frames_at(spark, d).withColumn("total", F.col("sequence_id") % 9 * 10)
    out = capture.capture_progress(rows, "frame_index", "total")
    return out.withColumn("percent", F.when(F.col("total") > 0, F.col("percent"))).select("sequence_id", "frame_index", "percent")


def arriving(steps: list[DataFrame], operator) -> DataFrame:
    """What a streaming operator gives when the rows of each step arrive as files and the stream is started again for it."""
    spark = steps[0].sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    for rows in steps:
        rows.write.mode("append").parquet(f"{path}/in")
        out = operator(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        running = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        running.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


#: Frames that arrive when their turn is long over.
HELD = "frame_index % 8 = 5 AND frame_index < 20"


@query("stream_agent", "registrations", f"{_scan(f'NOT ({HELD})')} {SCANNED}, false AS late FROM scan UNION ALL SELECT sequence_id, frame_index, NULL, NULL, NULL, NULL, true FROM registrations WHERE {HELD}")
def _(spark, d):
    """A frame a minute, in three steps: up to eight places out of order, some far too late, and a row that ends the capture."""
    metrics = _registrations(spark, d).select("sequence_id", "frame_index", "fitness", "rmse", "translation_m", "rotation_deg", F.timestamp_seconds(F.col("frame_index") * 60 + 1_000_000).alias("ts"))
    rows = stored(metrics.withColumn("at", F.expr(f"CASE WHEN {HELD} THEN 99999 ELSE frame_index + (frame_index * 7 + sequence_id * 3) % 9 END")), "arrivals")
    end = spark.range(1).selectExpr("-1L AS sequence_id", *[f"cast(null as {t}) AS {c}" for c, t in metrics.dtypes[1:-1]], "timestamp_seconds(1000000000) AS ts")
    steps = [rows.where(c).select(*metrics.columns) for c in ("at < 25", "at >= 25 AND at < 50", "at >= 50")]
    out = arriving([*steps[:2], steps[2].unionByName(end)], lambda s: capture.stream_agent(s, 0.001, ts="ts"))
    return rounded(out, "min_fitness", "max_rmse")


@query("stream_metrics", "registrations", f"+ {JUDGED} SELECT sequence_id, status, count(*) AS n_frames FROM judged GROUP BY 1, 2")
def _(spark, d):
    return streamed(_statuses(spark, d), capture.stream_metrics, "complete")


@query("stream_tsdf", "pixels", f"+ {VOLUME} SELECT sequence_id, ix, iy, iz, {r('tsdf', 5)} AS tsdf, weight FROM voxels")
def _(spark, d):
    """Frames arrive as files in four steps; a batch each, of which the second and the fourth merge what came before."""
    masked = stored(_masked(spark, d), "masked")
    at = stored(poses.kinematic_pose(masked.select("sequence_id", "frame_index").distinct(), 0.01), "poses")
    path = f"{shared_dir(spark)}/volume-{uuid.uuid4().hex}"
    add = capture.on_volume(f"{path}/out", at, CAMERA, TSDF, SCALE, TRUNC, merge_every=2)
    for step in range(4):
        masked.where(F.col("frame_index") % 4 == step).write.mode("append").parquet(f"{path}/in")
        arriving = spark.readStream.schema(masked.schema).parquet(f"{path}/in")
        arriving.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    total = capture.volume_so_far(spark, f"{path}/out", masked.schema["sequence_id"].dataType.simpleString())
    return rounded(total.select("sequence_id", "ix", "iy", "iz", "tsdf", "weight"), "tsdf", n=5)


@query("sink_live_snapshot", "cloud", "SELECT sequence_id, frame_index % 2 AS batch, count(*) AS n FROM cloud GROUP BY 1, 2")
def _(spark, d):
    """Two batches are added; the first is run again, as after a failure, and counts once."""
    path = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    points = relation(spark, d, "cloud")
    for k in (0, 1, 0):
        sinks.live_snapshot(points.where(F.col("frame_index") % 2 == k), path, k)
    return spark.read.parquet(path).groupBy(F.col("sequence_id").cast("long").alias("sequence_id"), F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"))


@query("cb_on_frame", "cloud", "SELECT sequence_id, count(DISTINCT frame_index) AS n_frames, count(*) AS n FROM cloud GROUP BY 1")
def _(spark, d):
    """Points arrive as a stream, and each batch is handed to the callback."""
    path = f"{shared_dir(spark)}/arriving-{uuid.uuid4().hex}"
    points = relation(spark, d, "cloud")
    points.write.parquet(path)
    arriving = spark.readStream.schema(points.schema).parquet(path).writeStream.foreachBatch(capture.on_frames(f"{path}-live"))
    arriving.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}-live")
    return out.groupBy(F.col("sequence_id").cast("long").alias("sequence_id")).agg(F.countDistinct("frame_index").alias("n_frames"), F.count("*").alias("n"))


@query("cb_on_complete", "registrations", f"+ {JUDGED} SELECT sequence_id, frame_index, CASE WHEN status = 'OK' THEN 'succeeded' ELSE 'failed' END AS outcome FROM judged")
def _(spark, d):
    named = [df.select("sequence_id", "frame_index", F.lit(name).alias("outcome")) for df, name in zip(capture.completed(_statuses(spark, d)), ("succeeded", "failed"))]
    return named[0].unionByName(named[1])


@query("cb_on_progress", "pair_metrics", """SELECT sequence_id, pair_index, done, total, CAST(floor(100 * done / CAST(total AS DOUBLE)) AS INT) AS percent FROM
  (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY pair_index) AS done, count(*) OVER (PARTITION BY sequence_id) AS total FROM pair_metrics)""")
def _(spark, d):
    return capture.pair_progress(relation(spark, d, "pair_metrics")).select("sequence_id", "pair_index", "done", "total", "percent")


@query("cb_observed", "registrations", "SELECT count(*) AS n_frames FROM registrations")
def _(spark, d):
    """Progress by an observation, as the callbacks of a run."""
    from pyspark.sql import Observation

    seen = Observation()
    rows = relation(spark, d, "registrations")
    capture.observed(rows, seen).write.format("noop").mode("overwrite").save()
    return spark.range(1).select(F.lit(seen.get["n_frames"]).alias("n_frames"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Depth in range, cropped, projected, and one point per voxel with its colour, with the frame's depth validity."""
    cropped = pixels.crop_bbox(_masked(spark, d), (0, 0, 8, 8))
    points = pixels.project_points(cropped, CAMERA, SCALE, TRUNC)
    valid = quality.depth_validity(_pixels(spark, d), TRUNC * SCALE)
    return neighbors.voxel_downsample(points, 0.11).join(valid, ["sequence_id", "frame_index"])
