"""Verdicts, thresholds and sequences with exact expected values."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from fieldscan.functions import geometry
from fieldscan.operators import agent, poses, quality
from fieldscan.plans.queries import streamed
from fieldscan.streaming import capture

_DRAW = random.Random(20)
HISTORY = [(_DRAW.uniform(0.7, 0.95), _DRAW.uniform(0.002, 0.008)) for _ in range(11)]


def one(spark, rotation=0.0, tx=0.0, fitness=0.9, rmse=0.001):
    return spark.createDataFrame([(1, 1, fitness, rmse, rotation, tx)], "sequence_id long, frame_index long, fitness double, rmse double, rot double, tx double").withColumn(
        "T", geometry.rotation_z(F.col("rot"), F.col("tx"))
    )


def test_cold_start_and_tightening():
    config = agent.AgentConfig(fitness_mads=1.5, rmse_mads=0.5, cold_start=4)
    state = agent.AgentState(config)
    assert state.thresholds() == (0.3, 0.015)
    fits, errors = [f for f, _ in HISTORY], [e for _, e in HISTORY]
    state = agent.AgentState(config, fits, errors, len(HISTORY))
    low = median(fits) - 1.5 * median(abs(x - median(fits)) for x in fits)
    high = median(errors) + 0.5 * median(abs(x - median(errors)) for x in errors)
    assert state.thresholds() == pytest.approx((low, high)) and low > 0.3 and high < 0.015


@pytest.mark.parametrize(
    "change,attempt,action,word",
    [({}, 0, "accept", ""), ({"rotation": 30.0}, 0, "retry", "rotation"), ({"tx": 0.2}, 1, "retry", "translation"), ({"fitness": 0.1}, 5, "reject", "fitness"), ({"rmse": 0.5}, 4, "retry", "rmse")],
)
def test_judge(spark, change, attempt, action, word):
    row = agent.judge(one(spark, **change), 0.001, attempt).first()
    assert row["action"] == action and row["reason"].split(" ")[0] == word


def test_translation_cap_follows_the_step(spark):
    assert agent.judge(one(spark, tx=0.05), 0.001).first()["action"] == "accept"
    assert agent.judge(one(spark, tx=0.051), 0.001).first()["action"] == "retry"
    assert agent.judge(one(spark, tx=0.2), 0.1).first()["action"] == "accept"


def test_magnitudes(spark):
    row = one(spark, 90.0, 0.005).select(geometry.rotation_deg(F.col("T")), geometry.translation_m(F.col("T")), geometry.rotation_deg(F.lit(None).cast("array<double>"))).first()
    assert row[0] == pytest.approx(90) and row[1] == pytest.approx(0.005) and row[2] == 0.0


def test_strategies_in_order():
    config = agent.AgentConfig()
    assert [config.recovery(k) for k in range(7)] == [*agent.STRATEGIES[:5], None, None]
    some = agent.AgentConfig(enabled=("feature_init", "denoise"))
    assert [some.recovery(k) for k in range(3)] == ["denoise", "feature_init", None]
    with pytest.raises(ValueError):
        agent.AgentConfig(enabled=("magic",)).recovery(0)


def metric_rows(n=60, seed=4):
    rng = random.Random(seed)
    return [(s, i, rng.uniform(0.2, 1.0), rng.uniform(0.0, 0.02), rng.uniform(0, 0.06), rng.uniform(0, 12)) for s in range(3) for i in range(n)]


SCHEMA = "sequence_id long, frame_index long, fitness double, rmse double, translation_m double, rotation_deg double"


def test_scan_against_plain_loop(spark):
    rows = metric_rows()
    got = {(r["sequence_id"], r["frame_index"]): r for r in agent.agent_scan(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.001).collect()}
    for s in range(3):
        fits, errors, accepted, rejects = [], [], 0, 0
        for _, i, f, e, t, r in [x for x in rows if x[0] == s]:
            low, high = 0.3, 0.015
            if accepted >= 8:
                wf, we = fits[-20:], errors[-20:]
                low = max(low, median(wf) - 3 * median(abs(x - median(wf)) for x in wf))
                high = min(high, median(we) + 3 * median(abs(x - median(we)) for x in we))
            if i == 0:
                f, e = 1.0, 0.0
            good = i == 0 or (f >= low and e <= high and t <= 0.05 and r <= 10)
            if good:
                fits, errors, accepted, rejects = [*fits, f], [*errors, e], accepted + 1, 0
            else:
                rejects += 1
            row = got[(s, i)]
            assert row["accepted"] == good and row["min_fitness"] == pytest.approx(low) and row["max_rmse"] == pytest.approx(high) and row["fallback"] == (rejects >= 3)


def test_stream_equals_batch(spark):
    rows = spark.createDataFrame(metric_rows(), SCHEMA).repartition(1)
    batch = sorted(map(tuple, agent.agent_scan(rows, 0.001).collect()))
    assert sorted(map(tuple, streamed(rows, lambda s: capture.stream_agent(s, 0.001)).collect())) == batch
    rng = random.Random(6)
    events = [(s, k, k, rng.choice(["frame", "position"]), rng.choice([None, rng.random()])) for s in range(3) for k in range(80)]
    df = spark.createDataFrame(events, "sequence_id long, t long, event_id long, kind string, position_m double")
    df = df.select("sequence_id", F.timestamp_seconds("t").alias("ts"), "event_id", "kind", "position_m").repartition(1)
    want = sorted(map(tuple, capture.position_asof(df).collect()))
    assert sorted(map(tuple, streamed(df, capture.stream_position_asof).collect())) == want
    latest, plain = {}, []
    for s, _, k, kind, p in events:
        if kind == "position":
            latest[s] = latest.get(s, 0.0) if p is None else p
        else:
            plain.append((s, k, latest.get(s, 0.0)))
    assert sorted((r[0], r[2], r[4]) for r in want) == sorted(plain)


def test_late_frames_are_split_off(spark):
    frames = spark.createDataFrame([(1, 0), (1, 4000), (1, 5000)], "sequence_id long, t long").withColumn("ts", F.timestamp_seconds("t"))
    good, late = capture.split_late(frames, frames.agg(F.max("ts").alias("newest")), "20 minutes")
    assert good.count() == 2 and late.count() == 1


def test_pose_chain_over_blocks(spark):
    n = 150
    rows = spark.createDataFrame([(1, i, 1.0, 0.01) for i in range(n)], "sequence_id long, frame_index long, a double, tx double").withColumn("T", geometry.rotation_z(F.col("a"), F.col("tx")))
    got = {r["frame_index"]: r["pose"] for r in poses.pose_chain(rows.select("sequence_id", "frame_index", "T")).collect()}
    x = y = angle = 0.0
    for i in range(n):
        if i:
            x, y, angle = x + 0.01 * math.cos(math.radians(angle)), y + 0.01 * math.sin(math.radians(angle)), angle + 1
        assert got[i][3] == pytest.approx(x, abs=1e-9) and got[i][7] == pytest.approx(y, abs=1e-9) and got[i][0] == pytest.approx(math.cos(math.radians(angle)), abs=1e-9)
    back = rows.select(geometry.product(F.col("T"), geometry.inverse(F.col("T"))).alias("p")).first()["p"]
    assert back == pytest.approx(list(geometry.IDENTITY), abs=1e-12)


def test_verdict_edges_and_missing(spark):
    t = quality.QualityThresholds()
    rows = [(1, i, t.validity[1], 1.0, 100, t.fitness[1], t.rmse[1], t.rotation[1], "") for i in range(3)]
    rows += [(2, 0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, "empty cloud"), (3, 0, 0.2, 1.0, 5, 0.9, 0.001, 0.1, ""), (3, 1, 0.0, 0.0, 0, 0.0, 9.0, 90.0, "bad")]
    metrics = spark.createDataFrame(rows, "sequence_id long, pair_index long, depth_validity double, median_depth_m double, n_points long, icp_fitness double, icp_rmse double, rotation_deg double, error string")
    verdicts = quality.quality_verdict(quality.quality_aggregate(metrics))
    every = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "sequence_id long")
    got = {r["sequence_id"]: (r["verdict"], r["failing"]) for r in quality.verdict_or_missing(every, verdicts).collect()}
    assert got == {1: ("PASS", []), 2: ("FAIL", ["icp_fitness", "depth_validity"]), 3: ("WARN", ["depth_validity"]), 4: ("FAIL", ["no metrics"])}
