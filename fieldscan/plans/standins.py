"""The relations of a capture, derived from the driver's tables, which hold no images.

Each has one definition for both engines; ``{k}`` and what differs by engine is filled in. A bare number with a point
would be a decimal in Spark, so divisors are cast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldscan.functions.geometry import Camera

TABLES = ("embeddings", "lineitem", "events", "orders", "supplier")
#: Camera of the 8x8 images, and the limits that go with them.
CAMERA = Camera(6.0, 6.0, 3.5, 3.5)
SCALE, TRUNC, NEAR = 1000.0, 3.5, 300

_EMBEDDED = {
    "spark": "SELECT vec_id, label, pos, CAST(e0 AS DOUBLE) AS e FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, e0",
    "duck": "SELECT vec_id, label, unnest(generate_series(0, 63)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings",
}
_K = {"spark": "CAST(get_json_object(props, '$.k') AS INT)", "duck": "CAST(json_extract_string(props, '$.k') AS INT)"}

RELATIONS = {
    "pixels": """SELECT label AS sequence_id, vec_id AS frame_index, CAST(pos % 8 AS INT) AS u, CAST(floor(pos / CAST(8 AS DOUBLE)) AS INT) AS v,
  CAST(floor(abs(e) * 10000) AS INT) AS depth_raw, CAST((vec_id * 7 + pos * 11) % 256 AS INT) AS r,
  CAST((vec_id * 13 + pos * 5) % 256 AS INT) AS g, CAST((vec_id * 3 + pos * 17) % 256 AS INT) AS b FROM ({embedded}) x""",
    "cloud": """SELECT sequence_id, frame_index, CAST(v * 8 + u AS BIGINT) AS point_id, (u - CAST(3.5 AS DOUBLE)) * (depth_raw / CAST(1000 AS DOUBLE)) / CAST(6 AS DOUBLE) AS x,
  (v - CAST(3.5 AS DOUBLE)) * (depth_raw / CAST(1000 AS DOUBLE)) / CAST(6 AS DOUBLE) AS y, depth_raw / CAST(1000 AS DOUBLE) AS z,
  r / CAST(255 AS DOUBLE) AS r, g / CAST(255 AS DOUBLE) AS g, b / CAST(255 AS DOUBLE) AS b FROM pixels WHERE depth_raw BETWEEN 300 AND 3499""",
    "points": """SELECT l_suppkey % 10 AS sequence_id, l_suppkey AS frame_index, CAST(row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) AS BIGINT) AS point_id,
  l_quantity / CAST(100 AS DOUBLE) AS x, l_extendedprice / CAST(100000 AS DOUBLE) AS y, l_tax * CAST(10 AS DOUBLE) + l_discount AS z FROM lineitem""",
    "registrations": """SELECT user_id AS sequence_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_index,
  least(CAST(1 AS DOUBLE), value / CAST(100 AS DOUBLE)) AS fitness, CAST({k} % 100 AS DOUBLE) / CAST(5000 AS DOUBLE) AS rmse,
  CAST({k} % 60 AS DOUBLE) / CAST(1000 AS DOUBLE) AS tx, CAST((event_id * 37) % 120 AS DOUBLE) / CAST(10 AS DOUBLE) AS rot_deg FROM events""",
    "pair_metrics": """SELECT user_id AS sequence_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pair_index,
  CAST({k} % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS depth_validity, value / CAST(50 AS DOUBLE) AS median_depth_m, CAST(event_id % 5000 AS BIGINT) AS n_points,
  least(CAST(1 AS DOUBLE), value / CAST(100 AS DOUBLE) + CAST(user_id % 3 AS DOUBLE) / CAST(4 AS DOUBLE)) AS icp_fitness,
  CAST({k} % 100 AS DOUBLE) / CAST(5000 * (1 + user_id % 3) AS DOUBLE) AS icp_rmse,
  CAST((event_id * 37) % 120 AS DOUBLE) / CAST(10 * (1 + 4 * (user_id % 3)) AS DOUBLE) AS rotation_deg,
  CASE WHEN event_type = 'error' THEN 'empty cloud' ELSE '' END AS error FROM events""",
    "frame_files": """SELECT concat('seq_', CAST(o_custkey % 20 AS VARCHAR(9))) AS sequence_id, kind, concat('/cap/seq_', CAST(o_custkey % 20 AS VARCHAR(9)), '/', kind, '/',
  CASE WHEN o_custkey % 2 = 0 THEN concat(kind, '_') ELSE '' END, CAST(o_orderkey AS VARCHAR(19)), '.png') AS path
  FROM orders CROSS JOIN (SELECT 'rgb' AS kind UNION ALL SELECT 'depth' AS kind) k WHERE NOT (kind = 'depth' AND o_orderkey % 50 = 0)""",
    "intrinsics_text": """SELECT s_suppkey AS sequence_id, CASE WHEN s_suppkey % 10 = 9 THEN '{{"K": [[1' ELSE
  concat('{{"K": [[', CAST(500 + s_suppkey AS VARCHAR(19)), ',0,320],[0,', CAST(510 + s_suppkey AS VARCHAR(19)), ',240],[0,0,1]]',
  CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ', "width": 1280, "height": 720' END,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE ', "dist": [0.1, 0, 0, 0, 0]' END, '}}') END AS json_text FROM supplier""",
    "capture": """SELECT user_id AS sequence_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN 'position' ELSE 'frame' END AS kind,
  CASE WHEN event_type = 'purchase' THEN value / CAST(100 AS DOUBLE) END AS position_m FROM events""",
}
_NEEDS = {"cloud": ("pixels",)}


def _sql(name: str, engine: str) -> str:
    return RELATIONS[name].format(embedded=_EMBEDDED[engine], k=_K[engine])


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation as a DataFrame over the tables of a folder; names of views are private to the call."""
    text = _sql(name, "spark")
    frames = {}
    for need in (*_NEEDS.get(name, ()), *TABLES):
        for word in (f"FROM {need} ", f"FROM {need}\n", f"FROM {need}"):
            if word in text:
                frames[need] = relation(spark, sf_dir, need) if need in RELATIONS else spark.read.parquet(f"{sf_dir}/{need}.parquet")
                break
    text = text.replace("{", "{{").replace("}", "}}")
    for need in frames:
        text = text.replace(f"FROM {need}", f"FROM {{{need}}}")
    return spark.sql(text, **frames)


def duck(names: tuple[str, ...] | str, body: str) -> str:
    """SQL for DuckDB: the relations as common tables, then ``body``, which may go on with more of them: ``+`` or ``+recursive``."""
    names = (names,) if isinstance(names, str) else names
    order = []
    for n in names:
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    if not order:
        return body
    tables = ",\n".join(f"{n} AS ({_sql(n, 'duck')})" for n in order)
    body = body.lstrip()
    head, more = "WITH RECURSIVE" if body.startswith("+recursive") else "WITH", "," if body.startswith("+") else ""
    return f"{head} {tables}{more}\n{body.removeprefix('+recursive').removeprefix('+')}"


#: The camera over the ground scene: one pixel is a step of the gantry at a depth of a metre.
GROUND_CAMERA = Camera(80.0, 80.0, 9.0, 8.0)
GROUND_SCALE, GROUND_STEP = 5000.0, 1 / 80
#: Places, of every twenty, of frames with the camera lowered, moved far away, unreadable, and without depth.
LOWERED, AWAY, UNREADABLE, BLANK = 5, 9, 13, 17


def ground(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, problems) of two captures along level ground, a frame of 18 x 16 pixels for each supplier, with planted faults.

    Neighbouring frames fit exactly, so registration settles within a few rounds; scenes with relief are in the tests.
    """
    shift = f"CASE place % 20 WHEN {LOWERED} THEN 0.045D WHEN {AWAY} THEN 0.3D ELSE 0D END"
    depth = f"CASE WHEN place % 20 = {BLANK} THEN 0 ELSE cast({GROUND_SCALE}D * (1D + {shift}) as int) END"
    grey = "cast(128 + 100 * cos(0.4D * v) as int)"
    frames = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_suppkey % 2 AS sequence_id", "s_suppkey AS frame_index", "s_suppkey div 2 AS place")
    lost = f"place % 20 = {UNREADABLE}"
    seen = frames.where(f"not ({lost})").selectExpr("*", "explode(sequence(0, 287)) AS at").selectExpr("sequence_id", "frame_index", "place", "at % 18 AS u", "at div 18 AS v")
    pixels = seen.selectExpr("sequence_id", "frame_index", "cast(u as int) AS u", "cast(v as int) AS v", f"{depth} AS depth_raw", *[f"{grey} AS {c}" for c in "rgb"])
    return pixels, frames.where(lost).selectExpr("sequence_id", "frame_index", "'imread failed' AS problem")
