"""Volumes against loops over voxels, frames and pixels; volumes that grow as frames arrive."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscan.functions.geometry import Camera
from fieldscan.operators import volume
from fieldscan.streaming import capture

PIXELS = "sequence_id long, frame_index long, u int, v int, r int, g int, b int, depth_raw int"
POSES = "sequence_id long, frame_index long, pose array<double>, extrinsic array<double>"
CAMERA, VOXEL = Camera(9.0, -8.0, 3.0, 2.5), 0.1


def scene(seed=4):
    rng = np.random.default_rng(seed)
    rows = [(s, f, u, v, *map(int, rng.integers(0, 256, 3)), int(rng.integers(0, 5) * 250)) for s in (1, 2) for f in range(4) for u in range(7) for v in range(6)]
    rows += rows[9:12] + [(1, 1, 3, 3, 1, 2, 3, 777), (1, 9, 0, 0, 1, 2, 3, 900), (2, 3, None, 2, 1, 2, 3, 900), (2, 3, 1, 2, 1, 2, 3, None)]
    poses = []
    for s in (1, 2):
        for f in range(4):
            a, t = math.radians(7.0 * f), np.array([0.03 * f, -0.02, 0.01 * s])
            pose = np.eye(4)
            pose[:3, :3], pose[:3, 3] = [[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]], t
            poses.append((s, f, *(list(map(float, m.ravel())) for m in (pose, np.linalg.inv(pose)))))
    return rows, poses + [(2, 7, poses[0][2], poses[0][3])]


def by_loops(rows, poses, trunc_m=3.5, reach=4):
    frames, out = defaultdict(list), defaultdict(list)
    for r in rows:
        if r[2] is not None and r[7]:
            frames[r[:2]].append(r)
    for s, f, pose, extrinsic in poses:
        pose, extrinsic = np.reshape(pose, (4, 4)), np.reshape(extrinsic, (4, 4))
        near, at = set(), defaultdict(list)
        for r in frames[(s, f)]:
            z = r[7] / 1000
            at[r[2:4]].append(r)
            if z < trunc_m:
                p = pose @ [(r[2] - CAMERA.cx) * z / CAMERA.fx, (r[3] - CAMERA.cy) * z / abs(CAMERA.fy), z, 1]
                i = [math.floor(c / VOXEL) for c in p[:3]]
                near |= {(i[0] + a, i[1] + b, i[2] + c) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) for c in range(-reach, reach + 1)}
        for i in near:
            x, y, z, _ = extrinsic @ [*((k + 0.5) * VOXEL for k in i), 1]
            if z > 0:
                for r in at.get((math.floor(CAMERA.fx * x / z + CAMERA.cx + 0.5), math.floor(abs(CAMERA.fy) * y / z + CAMERA.cy + 0.5)), []):
                    if r[7] / 1000 - z >= -4 * VOXEL:
                        out[(s, *i)].append((min(1.0, (r[7] / 1000 - z) / (4 * VOXEL)), *(c / 255 for c in r[4:7])))
    return {k: (len(v), *np.mean(v, 0)) for k, v in out.items()}


def as_dict(df):
    return {(r["sequence_id"], r["ix"], r["iy"], r["iz"]): (r["weight"], r["tsdf"], r["r"], r["g"], r["b"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys() and len(want) > 300
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


@pytest.mark.parametrize("sums", [100, 1 << 20])
def test_integration_against_loops(spark, monkeypatch, sums):
    """Also where a frame is repeated in part, has no pose, or no place or depth, and where sums leave a task often."""
    monkeypatch.setattr(volume, "SUMS", sums)
    rows, poses = scene()
    same(as_dict(volume.tsdf_integrate(spark.createDataFrame(rows, PIXELS), spark.createDataFrame(poses, POSES), CAMERA, VOXEL)), by_loops(rows, poses))


def test_no_pixels_or_no_poses(spark):
    pixels, poses = (spark.createDataFrame(rows, schema) for rows, schema in zip(scene(), (PIXELS, POSES)))
    for p, q in ((pixels.limit(0), poses), (pixels, poses.limit(0)), (pixels.limit(0), poses.limit(0))):
        assert volume.tsdf_integrate(p, q, CAMERA, VOXEL).count() == 0


@pytest.mark.parametrize("reach,spread", [(1, 40), (4, 300), (2, 5000)])
def test_widening_across_blocks(reach, spread):
    own = np.unique(np.random.default_rng(reach).integers(-spread, spread, (60, 3)), axis=0)
    steps = np.stack(np.meshgrid(*[np.arange(-reach, reach + 1)] * 3), -1).reshape(-1, 3)
    got = volume.widened(own, reach)
    assert len(np.unique(got, axis=0)) == len(got)
    assert set(map(tuple, got)) == set(map(tuple, (own[:, None] + steps).reshape(-1, 3)))


def test_a_volume_grows_and_survives_replay(spark, tmp_path):
    """Batches that are run again, the merging ones too, count once; at every step the volume is that of the frames so far."""
    rows, poses = scene()
    frames, at = spark.createDataFrame(rows, PIXELS), spark.createDataFrame(poses, POSES)
    path = f"{tmp_path}/volume"
    assert capture.volume_so_far(spark, path).count() == 0
    add = capture.on_volume(path, at, CAMERA, VOXEL, merge_every=2)
    for step in range(4):
        for _ in range(2):
            add(frames.where(F.col("frame_index") == step), step)
        same(as_dict(capture.volume_so_far(spark, path)), by_loops([r for r in rows if r[1] <= step], poses))
    add(frames.limit(0), 4)
    same(as_dict(capture.volume_so_far(spark, path)), by_loops(rows, poses))
