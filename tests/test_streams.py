"""Streams whose rows and files arrive in steps, out of order, late and again."""

import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fieldscan.functions.scratch import shared_dir
from fieldscan.operators import agent
from fieldscan.sources import images
from fieldscan.streaming import capture

METRICS = "sequence_id long, frame_index long, fitness double, rmse double, translation_m double, rotation_deg double, t long"


def arriving(spark, steps, operator, schema):
    """Rows of a streaming operator, one run over each step of arriving rows, as after stops and starts."""
    path = f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}"
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(schema).parquet(f"{path}/in").withColumn("ts", F.timestamp_seconds("t"))
        out = operator(source)
        running = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        running.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out").collect()


def frame_rows(n, seed=9):
    rng = random.Random(seed)
    return [(s, i, rng.uniform(0.2, 1.0), rng.uniform(0.0, 0.02), rng.uniform(0, 0.06), rng.uniform(0, 12), 1_000_000 + 60 * i) for s in range(3) for i in range(n)]


CLOCK = (99, None, None, None, None, None, 2_000_000)


def test_shuffled_arrival_is_judged_in_order(spark):
    rows, rng = frame_rows(60), random.Random(3)
    at = {(r[0], r[1]): r[1] + rng.uniform(0, 9) for r in rows}
    steps = [[r for r in rows if lo <= at[r[:2]] < hi] for lo, hi in ((0, 20), (20, 45), (45, 99))]
    for step in steps:
        rng.shuffle(step)
    # the batches overlap: some frames come a batch after frames behind them
    assert max(r[1] for r in steps[0]) > min(r[1] for r in steps[1])
    got = arriving(spark, [*steps, [CLOCK]], lambda s: capture.stream_agent(s, 0.001, ts="ts"), METRICS)
    want = agent.agent_scan(spark.createDataFrame(rows, METRICS), 0.001).collect()
    assert sorted(tuple(r)[:-1] for r in got) == sorted(map(tuple, want)) and not any(r["late"] for r in got)


def test_late_and_repeated_frames_are_rejects(spark):
    rows = frame_rows(50)
    held = {(0, 7), (2, 11)}
    again = [r for r in rows if r[:2] in {(1, 3), (0, 25)}]
    steps = [[r for r in rows if r[1] < 25 and r[:2] not in held], [r for r in rows if r[1] >= 25], [r for r in rows if r[:2] in held] + again, [CLOCK]]
    got = arriving(spark, steps, lambda s: capture.stream_agent(s, 0.001, ts="ts"), METRICS)
    late = sorted((r["sequence_id"], r["frame_index"]) for r in got if r["late"])
    assert late == [(0, 7), (0, 25), (1, 3), (2, 11)] and all(r["accepted"] is None and r["min_fitness"] is None for r in got if r["late"])
    want = agent.agent_scan(spark.createDataFrame([r for r in rows if r[:2] not in held], METRICS), 0.001).collect()
    assert sorted(tuple(r)[:-1] for r in got if not r["late"]) == sorted(map(tuple, want))


def test_nothing_is_judged_before_its_time(spark):
    """Frames within the lateness of the newest one wait; without a clock row the last ones stay in the buffer."""
    rows = [r for r in frame_rows(30) if r[0] == 0]
    got = arriving(spark, [rows], lambda s: capture.stream_agent(s, 0.001, ts="ts"), METRICS)
    assert sorted(r["frame_index"] for r in got) == list(range(20))
    assert arriving(spark, [[], [CLOCK]], lambda s: capture.stream_agent(s, ts="ts"), METRICS) == []


def save(root, frame, kind, mtime):
    path = f"{root}/plant/{kind}/{kind}_{frame}.png"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(images.encode_png(np.full((2, 3), frame, np.uint16) if kind == "depth" else np.full((2, 3, 3), frame, np.uint8)))
    os.utime(path, (mtime, mtime))


def test_files_of_both_folders_land_in_steps(spark, tmp_path):
    root, t0, rows_kept = str(tmp_path / "in"), 1_700_000_000, []
    steps = [
        # frames 2 and 3 are without their depth images
        [(f, "rgb", t0 + f) for f in range(4)] + [(f, "depth", t0 + f) for f in range(2)],
        # 2 comes a step apart; an hour later the capture goes on, which moves the watermark
        [(2, "depth", t0 + 60), (4, "rgb", t0 + 3600), (4, "depth", t0 + 3600)],
        # 3 comes beyond the watermark; the images of 5 are further apart than the lateness
        [(3, "depth", t0 + 100), (5, "rgb", t0 + 3600), (5, "depth", t0 + 4400)],
    ]
    for step in steps:
        for frame, kind, mtime in step:
            save(root, frame, kind, mtime)
        stream = capture.stream_frames(spark, root).select("sequence_id", "frame_index", "rgb", "depth")
        running = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        running = running.trigger(availableNow=True).start()
        running.awaitTermination()
        rows_kept.append(running.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["sequence_id"], r["frame_index"]) for r in got) == [("plant", f) for f in (0, 1, 2, 4)]
    assert all(images.decode_png(bytes(r["depth"]))[0, 0, 0] == r["frame_index"] == images.decode_png(bytes(r["rgb"]))[0, 0, 0] for r in got)
    # what is behind the watermark leaves the state
    assert rows_kept[0] == 6 and rows_kept[1] < 6 and rows_kept[2] < 6


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_frames_are_saved_whole(spark, tmp_path, scheme):
    rows = [("a", 0, b"x", b"y"), ("a", 1, b"z", None), ("b", 0, None, None)]
    paths = images.save_frames(spark.createDataFrame(rows, "sequence_id string, frame_index long, rgb binary, depth binary"), f"{scheme}{tmp_path}")
    assert sorted(r["path"].removeprefix(f"{scheme}{tmp_path}/") for r in paths.collect()) == ["a/depth/depth_0.png", "a/rgb/rgb_0.png", "a/rgb/rgb_1.png"]
    found = {os.path.relpath(os.path.join(d, f), tmp_path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(tmp_path) for f in names}
    assert {k: v for k, v in found.items()} == {"a/depth/depth_0.png": b"y", "a/rgb/rgb_0.png": b"x", "a/rgb/rgb_1.png": b"z"}


class Kept:
    """A state's value that counts how often it is read and written."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        pass

    def deleteTimer(self, at):
        pass

    def getCurrentWatermarkInMs(self):
        return 0


def test_waiting_frames_are_kept_in_one_value(spark):
    kept, agent_of = Kept(), capture._OrderedAgent(agent.CONFIG, 0.05)
    agent_of.init(kept)
    rows = [Row(sequence_id=1, frame_index=i, due=10 + i, fitness=0.9, rmse=0.001, translation_m=0.0, rotation_deg=0.0) for i in range(500)]
    assert list(agent_of.handleInputRows((1,), iter(rows), kept)) == [] and kept.calls == 2
    assert [r["frame_index"] for r in agent_of.handleInputRows((1,), iter(rows[:3]), kept) if r["late"]] == [0, 1, 2] and kept.calls == 4


def test_positions_are_taken_from_rows(spark):
    """Each key's rows are few, so no data frame is made of them."""
    kept, asof = Kept(), capture._AsOf()
    asof.init(kept)
    rows = [Row(sequence_id=1, ts=t, event_id=t, kind=k, position_m=p) for t, k, p in ((3, "frame", None), (2, "position", 0.5), (1, "frame", None), (4, "position", None), (5, "frame", None))]
    got = [(r["event_id"], r["frame_index"], r["position_m"]) for r in asof.handleInputRows((1,), iter(rows), kept)]
    assert got == [(1, 0, 0.0), (3, 1, 0.5), (5, 2, 0.5)] and kept.calls == 2
