"""Operators over whole images against loops over pixels, on images of many sizes with gaps, nulls and repeated rows."""

import math

import numpy as np
import pytest

from fieldscan.operators import pixels
from fieldscan.sources import images

ROW = "sequence_id long, frame_index long, u int, v int, depth_raw int, note string"


def rows_of(seed=3):
    rng, rows = np.random.default_rng(seed), []
    for f in range(12):
        wide, high = rng.integers(1, 17, 2)
        for u in range(wide):
            for v in range(high):
                if rng.random() < 0.9:
                    depth = 0 if rng.random() < 0.15 else int(rng.integers(300, 3000))
                    rows.append((None if f % 4 == 3 else f % 2, f // 2, u + f, v + 3 * f, depth, f"{f} {u} {v}"))
    return rows


def around(rows, row, reach):
    return [o for o in rows if o[:2] == row[:2] and abs(o[2] - row[2]) <= reach and abs(o[3] - row[3]) <= reach]


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_squares_against_loops(spark, batch):
    rows = rows_of()
    rows += rows[:5]
    df = spark.createDataFrame(rows, ROW)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        eroded = sorted((tuple(r) for r in pixels.erode_valid(df, 2).collect()), key=str)
        holes = sorted((tuple(r) for r in pixels.hole_mask(df, 3).collect()), key=str)
        near = sorted((tuple(r) for r in pixels.dilate_valid(df, 3).collect()), key=str)
        filled = sorted((tuple(r) for r in pixels.fill_holes(df, 3).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert eroded == sorted(((*r[:4], r[4] if all(o[4] > 0 for o in around(rows, r, 2)) else 0, r[5]) for r in rows), key=str)
    some = [any(o[4] > 0 for o in around(rows, r, 3)) for r in rows]
    assert near == sorted(((*r, int(s)) for r, s in zip(rows, some)), key=str)
    assert holes == sorted(((*r, r[4] == 0 and s) for r, s in zip(rows, some)), key=str)
    want = []
    for r in rows:
        found = [(1 / math.dist(o[2:4], r[2:4]), o[4]) for o in around(rows, r, 3) if o[4] > 0 and 0 < math.dist(o[2:4], r[2:4]) <= 3]
        fill = math.floor(round(sum(w * d for w, d in found) / sum(w for w, _ in found), 6)) if r[4] == 0 and found else r[4]
        want.append((*r[:4], fill, r[5]))
    assert filled == sorted(want, key=str)


def test_rows_without_place_or_depth_do_not_count(spark):
    rows = [(1, 0, 0, 0, 500, "a"), (1, 0, 1, 0, None, "b"), (1, 0, None, 0, 0, "c"), (1, 0, 2, 0, 700, "d")]
    df = spark.createDataFrame(rows, ROW)
    for out in (pixels.erode_valid(df), pixels.fill_holes(df)):
        assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(rows, key=str)
    assert {r["note"]: r["near_valid"] for r in pixels.dilate_valid(df).collect()} == {"a": 1, "b": 0, "c": 0, "d": 1}
    assert pixels.hole_mask(df.limit(0)).count() == 0


def test_images_change_while_they_are_decoded(spark):
    """Erosion and filling while decoding need no shuffle and give the rows of the operators."""
    rng = np.random.default_rng(5)
    frames = []
    for f in range(3):
        depth = rng.integers(300, 5000, (14, 11)).astype(np.uint16)
        depth[rng.random(depth.shape) < 0.05] = 0
        frames.append(("s", f, images.encode_png(rng.integers(0, 255, (14, 11, 3)).astype(np.uint8)), images.encode_png(depth)))
    df = spark.createDataFrame(frames, "sequence_id string, frame_index long, rgb binary, depth binary")
    plain = pixels.mask_depth_range(images.decode_frames(df, keep_empty=True), 4.5)
    cut = pixels.crop_bbox(plain, (1, 2, 10, 12))
    got = images.decode_frames(df, (1, 2, 10, 12), 4500, keep_empty=True, erode=1, fill=2)
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pixels.fill_holes(pixels.erode_valid(cut, 1), 2).collect()))
