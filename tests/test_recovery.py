"""Registration of sequences with retries: against a plain loop over the frames, and every strategy on a small scene."""

import random

import pandas as pd
import pytest

from fieldscan.operators.agent import STRATEGIES, AgentConfig, AgentState, translation_cap
from fieldscan.operators.registration import PAIR
from fieldscan.plans import reconstruct

FRAMES = {1: range(0, 30), 2: range(5, 12), 3: [7]}


def results():
    """Fitness, rmse and movement that a made-up registration gives; a function that workers get by value."""

    def result(sequence, source, target, strategy):
        rng = random.Random(f"{sequence} {source} {target} {strategy}")
        return rng.uniform(0.15, 0.9), rng.uniform(0.001, 0.019), rng.uniform(0, 0.06)

    return result


result = results()


def made_up(asked, clouds, ready, voxel, max_iter, step_m, axis, config):
    def run(batches):
        for batch in batches:
            rows = []
            for s, a, b, k in zip(*(batch[c] for c in (*PAIR, "attempt"))):
                fitness, rmse, x = result(s, a, b, config.recovery(k - 1) if k else None)
                rows.append((s, a, b, k, [1.0, 0, 0, x, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1], fitness, rmse))
            yield pd.DataFrame(rows, columns=[*PAIR, "attempt", "T", "fitness", "rmse"])

    ROUNDS.append(asked.count())
    return asked.select(*PAIR, "attempt").mapInPandas(run, "sequence_id long, source_frame long, target_frame long, attempt int, T array<double>, fitness double, rmse double")


ROUNDS = []


def plain(config):
    out, cap = {}, translation_cap(0.0, config)
    for s, frames in FRAMES.items():
        state, target = AgentState(config), None
        for f in frames:
            if target is None:
                state.record(True, 1.0, 0.0)
                out[s, f], target = ("OK", 0, None, 1.0), f
                continue
            k = 0
            while True:
                fitness, rmse, x = result(s, f, target, config.recovery(k - 1) if k else None)
                good = state.fits(fitness, rmse, x, 0.0, cap)
                if good or config.recovery(k) is None:
                    break
                k += 1
            state.record(good, fitness, rmse)
            out[s, f] = ("REJECTED" if not good else "RECOVERED" if k else "OK", k, target, fitness)
            target = f if good else target
    return out


@pytest.mark.parametrize("enabled", [("tighter_crop", "point_to_plane"), ()])
def test_sequences_against_a_plain_loop(spark, monkeypatch, enabled):
    monkeypatch.setattr(reconstruct, "registration_attempts", made_up)
    monkeypatch.setattr(reconstruct, "surfaces", lambda clouds, voxel: clouds)
    config = AgentConfig(enabled=enabled)
    rows = [(s, f, 0, 0.0, 0.0, 1.0) for s, frames in FRAMES.items() for f in frames]
    clouds = spark.createDataFrame(rows, "sequence_id long, frame_index long, point_id long, x double, y double, z double")
    out = reconstruct.register_sequences(clouds, 0.1, 5, config=config).collect()
    got = {(r["sequence_id"], r["frame_index"]): (r["status"], r["attempts"], r["target"], r["fitness"]) for r in out}
    want = plain(config)
    assert got == want and {x[0] for x in want.values()} >= {"OK", "REJECTED"}
    assert all(r["accepted"] == (r["status"] in ("OK", "RECOVERED")) for r in out)
    cut_short = reconstruct.register_sequences(clouds, 0.1, 5, config=config, most_rounds=1).collect()
    assert "UNDECIDED" in {r["status"] for r in cut_short} and not [r for r in cut_short if r["accepted"] and r["status"] == "UNDECIDED"]


def test_rounds_follow_the_longest_run_of_failures(spark, monkeypatch):
    """A sequence of 120 frames of which every eighth, and three more in a row, fail against anything."""
    bad = {f for f in range(1, 120) if f % 8 == 5} | {60, 62}

    def results():
        return lambda s, a, b, strategy: (0.1, 0.001, 0.0) if a in bad or b in bad else (0.9, 0.001, 0.0)

    monkeypatch.setitem(globals(), "result", results())
    monkeypatch.setattr(reconstruct, "registration_attempts", made_up)
    monkeypatch.setattr(reconstruct, "surfaces", lambda clouds, voxel: clouds)
    rows = [(1, f, 0, 0.0, 0.0, 1.0) for f in range(120) if f % 50 != 49]
    clouds = spark.createDataFrame(rows, "sequence_id long, frame_index long, point_id long, x double, y double, z double")
    frames = spark.createDataFrame([(1, f, "imread failed" if f == 49 else None) for f in range(120)], "sequence_id long, frame_index long, problem string")
    ROUNDS.clear()
    out = {r["frame_index"]: r for r in reconstruct.register_sequences(clouds, 0.1, 5, frames=frames).collect()}
    good = [f for f in range(120) if f not in bad and f % 50 != 49]
    assert [f for f in sorted(out) if out[f]["status"] == "OK"] == good
    assert [out[f]["target"] for f in good] == [None, *good[:-1]]
    assert out[49]["reason"] == "imread failed" and out[99]["reason"] == "empty cloud" and out[49]["status"] == out[99]["status"] == "FAILED"
    assert all(out[f]["status"] == "REJECTED" and out[f]["attempts"] == 5 and out[f]["reason"].startswith("fitness 0.100 < 0.") for f in bad)
    assert len(ROUNDS) <= 7 and sum(ROUNDS) < 120 + 20 * len(bad), ROUNDS


def test_a_strict_sequence_needs_its_first_frame(spark, monkeypatch):
    monkeypatch.setattr(reconstruct, "registration_attempts", made_up)
    monkeypatch.setattr(reconstruct, "surfaces", lambda clouds, voxel: clouds)
    clouds = spark.createDataFrame([(1, f, 0, 0.0, 0.0, 1.0) for f in (1, 2)], "sequence_id long, frame_index long, point_id long, x double, y double, z double")
    frames = spark.createDataFrame([(1, 0, "imread failed"), (1, 1, None), (1, 2, None)], "sequence_id long, frame_index long, problem string")
    strict = reconstruct.register_sequences(clouds, 0.1, 5, frames=frames, strict=True).orderBy("frame_index").collect()
    assert [(r["status"], r["reason"], r["accepted"]) for r in strict] == [("FAILED", "imread failed", False)] + [("FAILED", "no first frame", False)] * 2
    usual = reconstruct.register_sequences(clouds, 0.1, 5, frames=frames).orderBy("frame_index").collect()
    assert [r["status"] for r in usual][:2] == ["FAILED", "OK"]


def test_every_strategy_on_a_scene(spark):
    rng = random.Random(2)
    base = [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(160)]
    rows = []
    for f in range(2):
        for i, (x, y) in enumerate(base):
            z = 1 + 0.1 * ((x - 0.5) ** 2 + x * y)
            rows.append((1, f, i, x - 0.01 * f, y, z, x, y, 0.5))
    clouds = spark.createDataFrame(rows, "sequence_id long, frame_index long, point_id long, x double, y double, z double, r double, g double, b double")
    config = AgentConfig(enabled=STRATEGIES, max_retries=6)
    asked = spark.createDataFrame([(1, 1, 0, k) for k in range(7)], "sequence_id long, source_frame long, target_frame long, attempt int")
    got = reconstruct.registration_attempts(asked, clouds, reconstruct.surfaces(clouds, 0.1), 0.1, 30, 0.01, 0, config).collect()
    assert sorted(r["attempt"] for r in got) == list(range(7))
    for r in got:
        assert r["fitness"] > 0.8 and abs(r["T"][3] - 0.01) < 0.005, r
    with pytest.raises(ValueError):
        AgentConfig(enabled=("none of these",)).recovery(0)
