"""Analytic scenes and brute force: planes, spheres, known shifts, images and files."""

import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscan.functions import scratch
from fieldscan.functions.geometry import Camera, rotation_deg, translation_m
from fieldscan.operators import neighbors, pixels, quality, registration, volume
from fieldscan.plans import reconstruct
from fieldscan.sources import catalog, images, sidecars, sinks
from fieldscan.sources.ply import PlyDataSource

PIXELS = "sequence_id long, frame_index long, u int, v int, r int, g int, b int, depth_raw int"
CLOUD = "sequence_id long, frame_index long, point_id long, x double, y double, z double, r double, g double, b double"


def plane(spark, n=64, depth=1000, frames=1):
    rows = spark.range(frames * n * n)
    k = F.col("id") % (n * n)
    return rows.select(F.lit(1).cast("long").alias("sequence_id"), F.expr(f"id div {n * n}").alias("frame_index"), (k % n).cast("int").alias("u"), F.expr(f"cast((id % {n * n}) div {n} as int)").alias("v"),
                       *[((k * m) % 256).cast("int").alias(c) for c, m in zip("rgb", (3, 5, 7))], F.lit(depth).alias("depth_raw"))


def test_plane(spark):
    points = pixels.project_points(plane(spark), Camera(525.0, 525.0, 32.0, 32.0)).collect()
    assert len(points) == 4096
    for p in points[::97]:
        assert p["z"] == 1.0 and p["x"] == pytest.approx((p["u"] - 32) / 525) and p["y"] == pytest.approx((p["v"] - 32) / 525)
    assert pixels.project_points(plane(spark, depth=0), Camera(525.0, 525.0, 32.0, 32.0)).count() == 0


def test_masks_at_the_edges(spark):
    rows = [(1, 0, u, v, 0, 0, 0, 0 if (u, v) == (3, 3) else 100) for u in range(7) for v in range(7)]
    df = spark.createDataFrame(rows, PIXELS)
    eroded = {(r["u"], r["v"]): r["depth_raw"] for r in pixels.erode_valid(df).collect()}
    assert {k for k, d in eroded.items() if d == 0} == {(u, v) for u in range(1, 6) for v in range(1, 6)}
    filled = {(r["u"], r["v"]): r["depth_raw"] for r in pixels.fill_holes(df).collect()}
    assert filled[(3, 3)] == 100 and len(filled) == 49


def cloud(spark, points, frame=0, colors=None):
    colors = np.full((len(points), 3), 0.5) if colors is None else colors
    return spark.createDataFrame([(1, frame, i, *map(float, p), *map(float, c)) for i, (p, c) in enumerate(zip(points, colors))], CLOUD)


def sphere(n=400, seed=1):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def test_neighbors_against_brute_force(spark):
    p = np.random.default_rng(2).uniform(0, 1, (150, 3)) ** 3
    df = cloud(spark, p)
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    got = {(r["point_id"], r["o_point_id"]) for r in neighbors.radius_neighbors(df, 0.2).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d2 <= 0.04))}
    for start in (None, 0.01):
        near = {}
        for r in neighbors.knn(df, 6, start).collect():
            near.setdefault(r["point_id"], []).append((r["rank"], r["o_point_id"]))
        for i in range(150):
            assert [j for _, j in sorted(near[i])] == sorted(range(150), key=lambda j: (d2[i, j], j))[:6]
    assert neighbors.knn(df.limit(3), 6).count() == 9


def test_normals_of_a_sphere(spark):
    p = sphere()
    out = neighbors.orient_normals(neighbors.estimate_normals(cloud(spark, p), 0.4)).collect()
    dots = [abs(r["nx"] * r["x"] + r["ny"] * r["y"] + r["nz"] * r["z"]) for r in out]
    assert np.mean(dots) > 0.98


def smooth(p):
    return 0.5 + 0.4 * np.sin(3 * p + np.array([0.0, 1.0, 2.0]))


@pytest.mark.parametrize("colored", [False, True])
def test_icp_finds_a_known_shift(spark, colored):
    grid = np.stack(np.meshgrid(np.linspace(-1, 1, 18), np.linspace(-1, 1, 18)), -1).reshape(-1, 2)
    p = np.column_stack([grid, 0.3 * np.sin(2 * grid[:, 0]) * np.cos(2 * grid[:, 1])])
    a, shift = math.radians(1.0), np.array([0.02, -0.01, 0.015])
    q = p @ np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]]).T + shift
    points = cloud(spark, p, 0, smooth(p)).unionByName(cloud(spark, q, 1, smooth(p)))
    pairs = spark.createDataFrame([(1, 0, 1), (1, 1, 9)], "sequence_id long, source_frame long, target_frame long")
    run = registration.icp_colored if colored else registration.icp_point_to_plane
    got = {r["target_frame"]: r for r in run(pairs, points, 0.15, 20).withColumns({"deg": rotation_deg(F.col("T")), "m": translation_m(F.col("T"))}).collect()}
    assert got[1]["fitness"] == 1.0 and got[1]["rmse"] < 2e-3
    assert got[1]["deg"] == pytest.approx(1.0, abs=0.05) and got[1]["m"] == pytest.approx(np.linalg.norm(shift), abs=2e-3)
    assert got[9]["fitness"] == 0 and got[9]["deg"] == 0 and got[9]["m"] == 0


def test_surface_of_a_plane(spark):
    frame = plane(spark, 24, 1030)
    out = reconstruct.reconstruct_tsdf(frame, Camera(30.0, 30.0, 12.0, 12.0), 1000.0, 3.5, 0, 0.05, 0.0, clean=False)
    z = [r["z"] for r in out.collect()]
    assert len(z) > 100 and np.max(np.abs(np.array(z) - 1.03)) < 0.01
    assert volume.TRUNC_VOXELS == 4


def test_sequences_are_registered_and_merged(spark):
    merged, outcomes = reconstruct.reconstruct_icp(plane(spark, 12, 1000, 3), Camera(10.0, 10.0, 6.0, 6.0), 1000.0, 3.5, 0, 0.2, 3, clean=False)
    assert [r["status"] for r in outcomes.orderBy("frame_index").collect()] == ["OK", "OK", "OK"]
    assert merged.count() == 3 * 144


def test_png_round_trip_and_bad_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    color, depth = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8), rng.integers(0, 5000, (5, 7)).astype(np.uint16)
    for kind, image in (("rgb", color), ("depth", depth)):
        os.makedirs(tmp_path / kind)
        (tmp_path / kind / f"{kind}_3.png").write_bytes(images.encode_png(image))
        (tmp_path / kind / f"{kind}_12.png").write_bytes(images.encode_png(image)[: 40 if kind == "depth" else None])
    assert (images.decode_png(images.encode_png(depth))[..., 0] == depth).all() and images.decode_png(b"") is None and images.decode_png(None) is None
    files = catalog.list_files(spark, str(tmp_path)).select(F.lit("s").alias("sequence_id"), F.regexp_extract("path", "/(rgb|depth)/", 1).alias("kind"), "path")
    frames = images.with_contents(catalog.pair_positional(catalog.frame_catalog(files)))
    got = images.decode_frames(frames, keep_empty=True).collect()
    assert len(got) == 35 and {r["frame_index"] for r in got} == {0}
    assert all((r["r"], r["g"], r["b"], r["depth_raw"]) == (*map(int, color[r["v"], r["u"]]), int(depth[r["v"], r["u"]])) for r in got)
    assert [tuple(r) for r in images.unreadable_frames(frames).collect()] == [("s", 1, "imread failed")]
    boxed = images.decode_frames(frames, bbox=(2, 1, 5, 4), trunc_raw=4000).collect()
    assert len(boxed) == ((depth[1:4, 2:5] > 0) & (depth[1:4, 2:5] <= 4000)).sum()


@pytest.mark.parametrize("kinds", [3, 5])
def test_png_filters(kinds):
    import struct
    import zlib

    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    lines, before = b"", np.zeros(15, int)
    for y in range(6):
        now, kind = image[y].reshape(-1).astype(int), y % kinds
        left, corner = np.concatenate([[0] * 3, now[:-3]]), np.concatenate([[0] * 3, before[:-3]])
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [0 * now, left, before, (left + before) // 2, paeth][kind]
        lines += bytes([kind]) + ((now - guess) % 256).astype(np.uint8).tobytes()
        before = now
    chunk = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (images.decode_png(data) == image).all()


def test_ply(spark, tmp_path):
    spark.dataSource.register(PlyDataSource)
    df = cloud(spark, sphere(40)).select("x", "y", "z", "r", "g", "b").coalesce(1)
    df.write.format("ply").mode("append").option("path", str(tmp_path / "out")).save()
    back = spark.read.format("ply").option("path", str(tmp_path / "out")).load()
    key = lambda rows: sorted((round(r["x"], 9), round(r["y"], 9), round(r["z"], 9)) for r in rows)
    assert key(back.collect()) == key(df.collect()) and back.first()["r"] == pytest.approx(0.5, abs=0.003)
    named = df.withColumn("name", F.when(F.col("x") > 0, "plant a/1").otherwise("b")).sortWithinPartitions("name")
    named.write.format("ply").mode("append").option("path", str(tmp_path / "by")).option("by", "name").save()
    counts = {os.path.basename(r["path"]).rsplit("-", 1)[0]: r["count"] for r in spark.read.format("ply").option("path", str(tmp_path / "by")).load().groupBy("path").count().collect()}
    assert counts == {"plant_a_1": df.where("x > 0").count(), "b": df.where("x <= 0").count()}
    df.limit(0).write.format("ply").mode("append").option("path", str(tmp_path / "none")).save()
    assert not os.path.exists(tmp_path / "none")
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n")
    assert spark.read.format("ply").option("path", str(tmp_path / "a.ply")).load().select("x", "y", "z", "r").collect() == [(1.0, 2.0, 3.0, 0.0)]


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_one_ply_file_is_read_by_many_tasks(spark, tmp_path, scheme):
    spark.dataSource.register(PlyDataSource)
    n, where = 5000, f"{scheme}{tmp_path}/big"
    df = spark.range(n).selectExpr("cast(id as double) AS x", "-id / 2D AS y", "1D AS z", "id % 256 / 255D AS r", "cast(null as double) AS g").coalesce(1)
    df.write.format("ply").mode("append").option("path", where).save()
    back = spark.read.format("ply").option("split_bytes", 10_000).load(where)
    assert back.rdd.getNumPartitions() == -(-os.path.getsize(next(str(x) for x in (tmp_path / "big").iterdir())) // 10_000) > 10
    rows = back.orderBy("point_id").collect()
    assert [(r["point_id"], r["x"], r["y"], r["z"], round(255 * r["r"]), r["g"], r["b"]) for r in rows] == [(i, float(i), -i / 2, 1.0, i % 256, 0.0, 0.0) for i in range(n)]
    assert spark.read.format("ply").load(f"{where}/*.ply").count() == n and spark.read.format("ply").load(f"{where}/*.txt").count() == 0
    # the other byte order, with elements behind the points and a property that is left out
    record = np.dtype([("z", ">f4"), ("x", ">f4"), ("y", ">f4"), ("label", ">u2"), ("green", "u1")])
    points = np.zeros(700, record)
    points["x"], points["green"] = np.arange(700), 51
    names = "property float z\nproperty float x\nproperty float y\nproperty ushort label\nproperty uchar green\n"
    (tmp_path / "b.ply").write_bytes(f"ply\nformat binary_big_endian 1.0\nelement vertex 700\n{names}element face 1\nproperty list uchar int v\nend_header\n".encode() + points.tobytes() + b"\x01\0\0\0\x05")
    small = spark.read.format("ply").option("split_bytes", 999).load(f"{scheme}{tmp_path}/b.ply").orderBy("point_id").collect()
    assert [r["x"] for r in small] == list(range(700)) and {r["g"] for r in small} == {0.2}


def test_large_frames_are_numbered_in_ranges(spark):
    """A frame isn't sorted in one task: ids by position are the same, cut into ranges or not."""
    rows = [(1, k % 2, float(k * 37 % 101), float(k * 11 % 7), float(k % 3)) for k in range(400)]
    df = spark.createDataFrame(rows, "sequence_id long, frame_index long, x double, y double, z double")
    got = {(r["frame_index"], r["point_id"]): (r["x"], r["y"], r["z"]) for r in neighbors.renumbered(df, 30).collect()}
    want = {(f, i + 1): p for f in (0, 1) for i, p in enumerate(sorted(r[2:] for r in rows if r[1] == f))}
    assert got == want == {(r["frame_index"], r["point_id"]): (r["x"], r["y"], r["z"]) for r in neighbors.renumbered(df).collect()}
    assert neighbors.renumbered(df.limit(0)).count() == 0


def test_voxels_are_grouped_in_as_many_tasks_as_rows_need(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS", 50)
    df = spark.range(1000).selectExpr("1L AS sequence_id", "id % 100 AS frame_index", "id % 7 / 2D AS x", "id % 5 / 2D AS y", "0D AS z")
    out = neighbors.voxel_downsample(df, 0.5)
    assert "20), REPARTITION_BY_NUM" in out._jdf.queryExecution().toString() and out.agg(F.sum("n")).first()[0] == 1000
    assert neighbors.voxel_downsample(df.limit(0), 0.5).count() == 0


def test_gradients_start_at_stored_normals(spark, monkeypatch):
    """Else the rounds of neighbours that gradients take would find the normals anew."""

    class Seen(Exception):
        pass

    def gradient(points, *args):
        raise Seen(points._jdf.queryExecution().toString())

    monkeypatch.setattr(registration, "color_gradient", gradient)
    cloud = spark.createDataFrame([(1, f, k, k / 10, f / 10, 1.0, 0.5, 0.5, 0.5) for f in (0, 1) for k in range(5)], CLOUD)
    pairs = spark.createDataFrame([(1, 0, 1)], "sequence_id long, source_frame long, target_frame long")
    with pytest.raises(Seen) as seen:
        registration.icp_colored(pairs, cloud, 0.1)
    assert "Join" not in str(seen.value) and "ArrowEvalPython" not in str(seen.value)


def test_short_ply_ranges_are_read_together(spark, tmp_path):
    """A task costs more than a range of some kB, so their number doesn't grow with the files."""
    spark.dataSource.register(PlyDataSource)
    df = spark.range(0, 20_000, 1, 3).selectExpr("cast(id as double) AS x", "0D AS y", "1D AS z")
    df.write.format("ply").mode("append").option("path", str(tmp_path / "many")).save()
    back = spark.read.format("ply").option("split_bytes", 1000).load(str(tmp_path / "many"))
    assert back.rdd.getNumPartitions() < 100
    assert sorted(r["x"] for r in back.select("x").collect()) == list(map(float, range(20_000)))


def test_small_frames_are_given_out_together():
    class Frames:
        columns, schema = ["sequence_id", "frame_index", "rgb", "depth"], T.StructType.fromDDL("sequence_id string, frame_index long, rgb binary, depth binary")

        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            return run

    color, depth, blank = (images.encode_png(x) for x in (np.full((2, 3, 3), 7, np.uint8), np.full((2, 3), 500, np.uint16), np.zeros((2, 3), np.uint16)))
    rows = [("a", i, color, b"lost" if i % 10 == 3 else blank if i % 10 == 7 else depth) for i in range(300)]
    out = list(images.decode_frames(Frames(), problems=True)(iter([pd.DataFrame(rows, columns=Frames.columns)])))
    assert len(out) == 2 and [len(x) for x in out] == [240 * 6, 60]
    assert out[0].iloc[-1].to_dict() == {"sequence_id": "a", "frame_index": 299, "u": 2, "v": 1, "r": 7, "g": 7, "b": 7, "depth_raw": 500, "problem": None}
    assert list(out[1]["problem"].unique()) == ["imread failed", "empty cloud"] and out[1]["u"].isna().all()


def test_failed_tasks_leave_no_ply_files(spark, tmp_path):
    spark.dataSource.register(PlyDataSource)
    good = spark.range(100).selectExpr("cast(id as double) AS x", "0D AS y", "0D AS z").repartition(2)
    good.write.format("ply").mode("append").option("path", str(tmp_path)).save()
    before = sorted(os.listdir(tmp_path))
    bad = spark.range(50_000).selectExpr("if(id = 49999, cast(raise_error('lost') as double), cast(id as double)) AS x", "0D AS y", "0D AS z").coalesce(1)
    with pytest.raises(Exception, match="lost"):
        bad.write.format("ply").mode("append").option("path", str(tmp_path)).save()
    assert sorted(os.listdir(tmp_path)) == before and len(before) == 2
    good.where("x < 10").coalesce(1).write.format("ply").mode("overwrite").option("path", str(tmp_path)).save()
    assert len(os.listdir(tmp_path)) == 1 and spark.read.format("ply").load(str(tmp_path)).count() == 10


def test_sidecars(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "session.json").write_text(json.dumps({"backend": "ros", "started_at": "2026-04-06T15:27:52", "n_frames": 2, "frame_positions": {"0": 0.1, "1": 0.2}}, indent=1))
    sessions = sidecars.read_sessions(spark, str(tmp_path / "*" / "session.json"))
    assert sorted(map(tuple, sidecars.session_positions(sessions).collect())) == [("s1", 0, 0.1), ("s1", 1, 0.2)]
    assert str(sessions.first()["started_at"]) == "2026-04-06 15:27:52"
    m = [float(i) for i in range(16)]
    (tmp_path / "view.json").write_text(json.dumps({"class_name": "c", "extrinsic": m, "intrinsic": {"height": 4, "width": 5, "intrinsic_matrix": m[:9]}, "version_major": 1, "version_minor": 0}, indent=1))
    view = sidecars.read_view_cameras(spark, str(tmp_path / "view.json")).first()
    assert view["extrinsic"] == [float(4 * j + i) for i in range(4) for j in range(4)] and view["K"] == [0, 3, 6, 1, 4, 7, 2, 5, 8]
    default = spark.range(1).select(*[v.alias(k) for k, v in sidecars.default_camera(F.lit(640.0), F.lit(480.0)).items()]).first()
    assert (default["cx"], default["cy"]) == (320.0, 240.0) and default["fx"] == pytest.approx(640 / (2 * math.tan(math.radians(30))))
    strict = sidecars.parse_intrinsics_strict(spark.createDataFrame([(1, "{bad")], "sequence_id long, json_text string"))
    with pytest.raises(Exception, match="intrinsics missing or malformed"):
        strict.collect()


def test_nothing_is_written_for_no_rows(spark, tmp_path):
    assert not sinks.write_csv(spark.range(0), str(tmp_path / "a")) and not os.path.exists(tmp_path / "a")
    assert sinks.write_csv(spark.range(1), str(tmp_path / "b"))


def test_matches_are_mutual_nearest_descriptors(spark, monkeypatch):
    monkeypatch.setattr(registration, "BLOCK", 16)
    rng = np.random.default_rng(5)
    hists = {0: rng.uniform(0, 100, (50, 33)), 1: rng.uniform(0, 100, (70, 33)), 2: np.empty((0, 33))}
    hists[1][:20] = hists[0][:20] + rng.normal(0, 1, (20, 33))
    hists[1][30] = hists[1][31] = hists[0][30]
    rows = [(1, f, i, h.tolist()) for f, x in hists.items() for i, h in enumerate(x)]
    features = spark.createDataFrame(rows, "sequence_id long, frame_index long, point_id long, hist array<double>")
    pairs = spark.createDataFrame([(1, 1, 0), (1, 0, 2), (2, 0, 1)], "sequence_id long, source_frame long, target_frame long")
    got = {(r["source_id"], r["target_id"]) for r in registration.feature_match(pairs, features).collect()}
    d = np.round(((hists[1][:, None] - hists[0][None]) ** 2).sum(2), 6)
    assert got == {(i, int(j)) for i, j in enumerate(d.argmin(1)) if d[:, j].argmin() == i} and len(got) >= 21


def test_blocks_of_far_descriptors_never_meet(spark, monkeypatch):
    """Clustered descriptors, one cluster of equal ones: same matches as loops, and most blocks don't meet."""
    monkeypatch.setattr(registration, "BLOCK", 24)
    rng = np.random.default_rng(8)
    middles = rng.uniform(0, 100, (9, 33))
    hists = {f: np.concatenate([middles[k] + rng.normal(0, 0.5, (30, 33)) for k in range(8)] + [np.repeat(middles[8:], 60, 0)]) for f in (0, 1)}
    rows = [(1, f, i, h.tolist()) for f, x in hists.items() for i, h in enumerate(x)]
    features = spark.createDataFrame(rows, "sequence_id long, frame_index long, point_id long, hist array<double>")
    pairs = spark.createDataFrame([(1, 1, 0)], "sequence_id long, source_frame long, target_frame long")
    keyed, blocks = registration.feature_blocks(features)
    assert keyed.count() == len(rows) and keyed.groupBy("frame_index", "pivot", "part").count().agg({"count": "max"}).first()[0] <= 3 * registration.BLOCK
    per = {f: blocks.where(f"frame_index = {f}").count() for f in (0, 1)}
    met = registration.pivot_pairs(pairs, blocks).count()
    assert min(per.values()) > 30 and met < 0.35 * per[0] * per[1]
    got = {(r["source_id"], r["target_id"]) for r in registration.feature_match(pairs, features).collect()}
    d = np.round(((hists[1][:, None] - hists[0][None]) ** 2).sum(2), 6)
    assert got == {(i, int(j)) for i, j in enumerate(d.argmin(1)) if d[:, j].argmin() == i}


def test_pose_from_matches_that_are_mostly_wrong(spark):
    rng = np.random.default_rng(6)
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    s = rng.uniform(0, 1, (200, 3))
    t = s @ turn.T + [0.3, -0.2, 0.5]
    right = rng.permutation(200)[:60]
    to = rng.permutation(200)
    to[right] = right
    points = cloud(spark, s, 0).unionByName(cloud(spark, t, 1))
    matches = [(1, 0, 1, i, int(to[i])) for i in range(200)]
    matches += [(1, 0, 2, 1, 1), (1, 0, 2, 2, 2)]
    df = spark.createDataFrame(matches, "sequence_id long, source_frame long, target_frame long, source_id long, target_id long")
    got = registration.recover_feature_init(df, points.unionByName(cloud(spark, t[:3], 2)), 0.01).collect()
    assert len(got) == 1 and got[0]["inliers"] >= 60
    found = np.array(got[0]["T"]).reshape(4, 4)
    assert np.abs(found[:3, :3] - turn).max() < 1e-6 and np.abs(found[:3, 3] - [0.3, -0.2, 0.5]).max() < 1e-6


def test_quality_from_pixels(spark):
    from fieldscan.operators.quality import QualityParams

    bent = F.when(F.col("frame_index") == 2, 0).otherwise((1000 + 0.02 * F.pow(F.col("u") - 12, 2) + 0.03 * F.pow(F.col("v") - 9, 2)).cast("int"))
    rows = plane(spark, 24, frames=4).withColumn("depth_raw", bent).where("frame_index < 4")
    rows = rows.unionByName(rows.where("frame_index = 0").withColumn("sequence_id", F.lit(2).cast("long")))
    params = QualityParams(bbox=(2, 2, 22, 22), voxel_size=0.01, max_iter=3)
    verdicts, metrics = reconstruct.quality_report(rows, Camera(525.0, 525.0, 12.0, 12.0), params)
    got = {r["pair_index"]: r for r in metrics.collect()}
    assert [got[k]["error"] for k in range(3)] == ["", "empty cloud", "empty cloud"]
    assert got[0]["n_points"] == 400 and got[0]["depth_validity"] == 1 and got[0]["icp_fitness"] > 0.99 and got[0]["rotation_deg"] < 0.01
    assert got[1]["depth_validity"] == 1 and got[1]["icp_fitness"] == 0 and got[2]["depth_validity"] == 0
    assert {r["sequence_id"]: (r["verdict"], r["failing"]) for r in verdicts.collect()} == {1: ("PASS", []), 2: ("FAIL", ["no metrics"])}
    assert reconstruct.quality_report(rows, Camera(525.0, 525.0, 12.0, 12.0), QualityParams(voxel_size=0.01, max_iter=1, n_samples=1), sample=True)[1].count() == 1


def plain_fpfh(x, n, radius, max_nn):
    """Fast point feature histograms by loops over all points and neighbours."""
    own, near = [], []
    for i in range(len(x)):
        d2 = ((x - x[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(len(x)), d2)) if d2[j] <= radius * radius][:max_nn]
        near.append([(j, d2[j]) for j in order if d2[j] > 0])
        hist, total = np.zeros(33), 0
        for j, q in near[-1]:
            e = (x[j] - x[i]) / np.sqrt(q)
            u, m = n[i], n[j]
            if np.arccos(abs(u @ e)) > np.arccos(abs(m @ e)):
                u, m, e = m, u, -e
            v = np.cross(e, u)
            if not np.linalg.norm(v):
                continue
            v /= np.linalg.norm(v)
            angles = ((np.arctan2(np.cross(u, v) @ m, u @ m) + np.pi) / (2 * np.pi), (v @ m + 1) / 2, (u @ e + 1) / 2)
            for a, value in enumerate(angles):
                hist[11 * a + min(10, max(0, int(np.floor(round(11 * value, 9)))))] += 1
            total += 1
        own.append(100 * hist / max(total, 1))
    out = []
    for i in range(len(x)):
        mix = sum((own[j] / q for j, q in near[i]), np.zeros(33)).reshape(3, 11)
        out.append(own[i] + (100 * mix / np.maximum(mix.sum(1, keepdims=True), 1e-300)).reshape(-1))
    return np.array(out)


@pytest.mark.parametrize("max_nn", [100, 12])
def test_point_feature_histograms_against_loops(spark, max_nn):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (120, 3))
    n = rng.normal(size=(120, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    rows = [(1, 0, i, *map(float, p), *map(float, q)) for i, (p, q) in enumerate(zip(x, n))]
    points = spark.createDataFrame(rows, "sequence_id long, frame_index long, point_id long, x double, y double, z double, nx double, ny double, nz double")
    got = {r["point_id"]: r["hist"] for r in registration.fpfh(points, 0.08, max_nn).collect()}
    want = plain_fpfh(x, n, 0.4, max_nn)
    assert len(got) == 120
    assert np.allclose(np.array([got[i] for i in range(120)]), want, atol=1e-6)
    assert np.allclose(want.sum(1), 600)


def test_dense_cells_are_split(spark, monkeypatch):
    """A cell of 3,000 points among sparse ones: the same neighbours as by brute force, from pairs that grow with the points."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.uniform(0.3, 0.5, (3000, 3)), rng.uniform(0, 4, (300, 3)), rng.uniform(0.31, 0.312, (400, 3)), np.full((90, 3), 0.4)])
    rows = [(1, 0, i, *map(float, p)) for i, p in enumerate(x)]
    points = spark.createDataFrame(rows, "sequence_id long, frame_index long, point_id long, x double, y double, z double")
    made, pairs = [], neighbors.neighbor_pairs

    def counted(some, others, size, on=None):
        out = pairs(some, others, size, on)
        made.append(out.count())
        return out

    monkeypatch.setattr(neighbors, "neighbor_pairs", counted)
    got = {}
    for r in neighbors.knn_hybrid(points, 0.5, 10).select("point_id", "o_point_id", "rank").collect():
        got.setdefault(r["point_id"], {})[r["rank"]] = r["o_point_id"]
    for i in range(len(x)):
        d2 = ((x - x[i]) ** 2).sum(1)
        want = [j for j in np.lexsort((np.arange(len(x)), d2)) if d2[j] <= 0.25][:10]
        assert [got[i][k] for k in range(1, len(want) + 1)] == want and len(got[i]) == len(want), i
    assert len(made) > 3 and sum(made) < 200 * len(x) < 3000 * 3000, made


@pytest.mark.parametrize("dy, dx", [(2, 3), (-4, 1), (0, -5)])
def test_phase_shift_of_a_moved_image(spark, dy, dx):
    image = np.random.default_rng(3).integers(0, 256, (16, 24))
    frames = {10: image, 20: np.zeros_like(image), 30: np.roll(image, (dy, dx), (0, 1))}
    rows = [(s, f, u, v, *[int(x[v, u])] * 3) for s in (1, 2) for f, x in frames.items() if s == 1 or f < 30 for v in range(16) for u in range(24)]
    pixels_ = spark.createDataFrame(rows, "sequence_id long, frame_index long, u int, v int, r int, g int, b int")
    (got,) = quality.gantry_phase_shift(pixels_, 0, 2).collect()
    assert got["sequence_id"] == 1 and abs(got["sx"] - dx) < 0.1 and abs(got["sy"] - dy) < 0.1 and got["response"] > 0.9


def test_clouds_are_not_broadcast(spark):
    """Exploded clouds look as small as what they come from; a broadcast of them would pass through the driver."""
    cloud = spark.range(2).selectExpr("1L AS sequence_id", "id AS frame_index", "explode(sequence(1L, 50L)) AS point_id").selectExpr("*", *[f"point_id / 100D AS {c}" for c in "xyzrgb"])
    turned = cloud.selectExpr("sequence_id", "frame_index", "cast(point_id as int) AS u", "1 AS v", "1 AS r", "1 AS g", "1 AS b", "1 AS depth_raw")
    plans = [
        neighbors.radius_neighbors(cloud, 0.1), neighbors.outlier_radius(cloud, 3, 0.1), neighbors.nn_correspondence(cloud, cloud, 0.1, ["sequence_id", "frame_index"]),
        neighbors.knn_hybrid(cloud, 0.1, 4), pixels.undistort_depth(turned, Camera(6.0, 6.0, 3.5, 3.5, (0.1, 0.0, 0.0, 0.0, 0.0))),
    ]
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_radius_is_squared_once(spark):
    """0.2 * 0.2 is more than 0.04 by the last bit; a squared distance of that size is beyond a radius of 0.2, as SQL has it."""
    assert neighbors.square(0.2) == 0.04 < 0.2 * 0.2
    cloud = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 1, 2, 0.2, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 1, 3, 0.0, 0.1999, 0.0, 0.0, 0.0, 0.0)], CLOUD)
    first, rest = cloud.where("point_id = 1"), cloud.where("point_id = 2")
    assert neighbors.nn_correspondence(first, rest, 0.2, ["sequence_id", "frame_index"]).count() == 0
    near = neighbors.knn_hybrid(cloud, 0.2, 3).where("point_id = 1").select("o_point_id").collect()
    assert sorted(r[0] for r in near) == [1, 3]


def test_mean_on_a_limit(spark):
    """A mean that sums of another order put a bit beside the limit is on the limit."""
    off = {"icp_fitness": (0.5, -1), "icp_rmse": (0.005, 1), "depth_validity": (0.3, -1), "rotation_deg": (1.0, 1)}
    rows = [(s, m, limit + s * side * 4e-16 * max(1.0, limit)) for s in (0, 1) for m, (limit, side) in off.items()]
    verdicts = quality.quality_verdict(spark.createDataFrame(rows, "sequence_id long, metric string, mean double")).orderBy("sequence_id").collect()
    assert [(r.verdict, r.failing) for r in verdicts] == [("PASS", [])] * 2


def test_cells_a_ball_can_touch(spark):
    """Each point meets eight cells, and no neighbour is lost at their borders or at the radius itself."""
    x = [(i, 0.25 * (i % 5) - 0.5, 0.25 * (i // 5 % 5) - 0.5, 0.25 * (i // 25) - 0.5) for i in range(125)]
    cloud = spark.createDataFrame([(1, 1, *p) for p in x], "sequence_id long, frame_index long, point_id long, x double, y double, z double")
    got = {(r.point_id, r.o_point_id) for r in neighbors.neighbor_pairs(cloud, cloud, 0.25).collect()}
    assert got == {(a[0], b[0]) for a in x for b in x if sum((p - q) ** 2 for p, q in zip(a[1:], b[1:])) <= 0.0625}
    assert neighbors._around()._jc.toString().count("AS k") == 8
    plan = neighbors.nn_correspondence(cloud, cloud, 0.25, ["sequence_id", "frame_index"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1


def test_level_clouds_are_looked_up_in_few_rounds(spark, monkeypatch):
    """The spacing of a level or straight cloud isn't that of a volume, a point carries its place to the next round, and one without a place has no row."""
    grid = np.stack(np.meshgrid(np.arange(18) / 80, np.arange(16) / 80), -1).reshape(-1, 2)
    level = cloud(spark, np.column_stack([grid, np.ones(288)]))
    line = cloud(spark, np.column_stack([np.arange(100) / 80, np.zeros(100), np.zeros(100)]))
    assert 1 / 80 < neighbors.usual_spacing(level, 10) < 4 / 80
    assert 5 / 80 < neighbors.usual_spacing(line, 10) < 20 / 80
    names, store = [], scratch.stored
    monkeypatch.setattr(neighbors, "stored", lambda df, name="step": (names.append(name), store(df, name))[1])
    lost = level.limit(2).withColumns({"point_id": F.col("point_id") + 1000, "x": F.when(F.col("point_id") == 0, float("nan"))})
    got = neighbors.knn(level.unionByName(lost), 10).collect()
    assert len(got) == 2880 and {r["point_id"] for r in got} == set(range(288))
    assert names.count("knn") <= 2 and set(names) == {"placed", "knn"}


def test_gradients_query_makes_normals_once(spark, monkeypatch):
    from fieldscan.plans import queries

    names, store = [], scratch.stored
    monkeypatch.setattr(queries, "stored", lambda df, name="step": (names.append(name), store(df, name))[1])
    assert queries.QUERIES["color_gradient"](spark, "/root/testdata/sf0.001").count() > 0
    assert "normals" in names


def test_few_matches_are_searched_once_each_three(spark):
    """Without a pose that fits well all hypotheses are drawn; of few matches no three is tried twice, so the search ends."""
    rng = np.random.default_rng(4)
    s, t = rng.uniform(0, 1, (9, 3)), rng.uniform(0, 1, (9, 3))
    t[:3] = s[:3] + [0.1, 0.2, 0.3]
    points = cloud(spark, s, 0).unionByName(cloud(spark, t, 1))
    df = spark.createDataFrame([(1, 0, 1, i, i) for i in range(9)], "sequence_id long, source_frame long, target_frame long, source_id long, target_id long")
    got = registration.recover_feature_init(df, points, 0.001, 1 << 40, 1.0).collect()
    assert [r["inliers"] for r in got] == [3]
    assert np.abs(np.array(got[0]["T"]).reshape(4, 4)[:3, 3] - [0.1, 0.2, 0.3]).max() < 1e-6


def test_pairs_are_not_broadcast_beyond_a_bound(spark, monkeypatch):
    """Pairs, their transforms and sums grow with the frames; beyond a fixed number no join of registration takes them through the driver."""
    from fieldscan.operators import poses

    monkeypatch.setattr(scratch, "FEW", 1)
    xy = np.stack(np.meshgrid(np.arange(8) / 10, np.arange(8) / 10), -1).reshape(-1, 2)
    points = np.column_stack([xy, 0.3 * np.sin(6 * xy[:, 0]) * np.cos(5 * xy[:, 1]) + 1])
    frames = cloud(spark, points, 0).unionByName(cloud(spark, points + [0.02, 0, 0.01], 1)).unionByName(cloud(spark, points + [0.04, 0, 0.02], 2))
    pairs = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "sequence_id long, source_frame long, target_frame long")
    plans, store = [], scratch.stored

    def noted(df, name="step"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return store(df, name)

    monkeypatch.setattr(registration, "stored", noted)
    out = registration.icp_colored(pairs, frames, 0.1, 4, None, False)
    rows = sorted(out.select("source_frame", "fitness", "rmse").collect())
    assert [r["source_frame"] for r in rows] == [1, 2] and all(r["fitness"] > 0.9 and r["rmse"] < 0.02 for r in rows)
    assert {"targets", "sources", "icp"} <= {name for name, _ in plans}
    chain = poses.pose_chain(out.select("sequence_id", F.col("source_frame").alias("frame_index"), "T"))
    plans.append(("chain", chain._jdf.queryExecution().executedPlan().toString()))
    assert not [name for name, plan in plans if "BroadcastHashJoin" in plan]


def test_stored_tables_leave_no_shuffle_files(spark):
    """Rounds don't add up on disk: what was shuffled for a stored table goes with the query that wrote it, and the session's setting stays."""
    import glob

    before = spark.conf.get(scratch.CLEANUP)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: sum(len(glob.glob(f"{d}/*/shuffle_*.data")) for d in local)
    start = held()
    out = scratch.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"), "sums")
    assert held() <= start and out.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get(scratch.CLEANUP) == before


def test_only_places_go_to_every_cell(spark, monkeypatch):
    """A point is looked up in eight cells, which get its place alone; its normal and grey come to the nearest, with the same neighbours."""
    points = cloud(spark, np.random.default_rng(5).uniform(0, 1, (40, 3)))
    ready = neighbors.estimate_normals(points.withColumn("grey", F.col("r")), 0.5)
    sent, pairs = [], neighbors.neighbor_pairs
    monkeypatch.setattr(neighbors, "neighbor_pairs", lambda some, *more: (sent.append(some.columns), pairs(some, *more))[1])
    near = neighbors.knn_hybrid(ready, 0.5, 5)
    assert sent and all(c == [*neighbors.POINT, "x", "y", "z"] for c in sent)
    own = {r["point_id"]: (r["nx"], r["ny"], r["nz"], r["grey"]) for r in ready.collect()}
    rows = near.collect()
    assert len(rows) == len({(r["point_id"], r["o_point_id"]) for r in rows}) > 100
    assert all(np.allclose(own[r["point_id"]], [r["nx"], r["ny"], r["nz"], r["grey"]]) and np.allclose(own[r["o_point_id"]], [r["o_nx"], r["o_ny"], r["o_nz"], r["o_grey"]]) for r in rows)


def test_means_are_summed_in_the_order_of_pairs(spark):
    """A mean that lies on a limit is judged by the sum in the order of pairs, as SQL's over rows that lie so, however the rows are dealt."""
    orders = {0: [0.0091, 0.0098, 0.0009, 0.0073, 0.0082, 0.0018, 0.0027, 0.0002], 1: [0.0073, 0.0018, 0.0002, 0.0027, 0.0009, 0.0091, 0.0098, 0.0082]}
    assert sorted(orders[0]) == sorted(orders[1])
    rows = [(s, k, 1.0, 1.0, 9, 1.0, x, 0.0, "") for s, xs in orders.items() for k, x in enumerate(xs)]
    rows += [(s, 9, 1.0, 1.0, 9, 1.0, 1.0, 0.0, "empty cloud") for s in orders]
    metrics = spark.createDataFrame(rows, "sequence_id long, pair_index long, depth_validity double, median_depth_m double, n_points long, icp_fitness double, icp_rmse double, rotation_deg double, error string")
    for n in (1, 5):
        dealt = metrics.orderBy(F.desc("pair_index")).repartition(n)
        means = {r.sequence_id: r["mean"] for r in quality.quality_aggregate(dealt).where("metric = 'icp_rmse'").collect()}
        assert means == {0: 0.005000000000000001, 1: 0.004999999999999999}
        assert {r.sequence_id: r.failing for r in quality.full_report(dealt).collect()} == {0: ["icp_rmse"], 1: []}
