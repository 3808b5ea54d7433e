"""Captures while they run: frames and positions as streams, the live agent, and running counts.

Each stateful operator has a batch twin that gives the same rows on complete input. State is keyed by sequence and
bounded; late frames are those beyond the watermark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fieldscan.functions.geometry import Camera
from fieldscan.operators.agent import CONFIG, SCAN_SCHEMA, AgentConfig, AgentState, translation_cap
from fieldscan.operators.volume import tsdf_integrate
from fieldscan.sources.sinks import live_snapshot

LATENESS = "10 minutes"


def stream_frames(spark: SparkSession, root: str, lateness: str = LATENESS) -> DataFrame:
    """Frames of a capture folder as both files arrive: ``<sequence>/rgb/<n>.png`` joined with ``<sequence>/depth/<n>.png``."""

    def side(kind: str) -> DataFrame:
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        files = files.option("pathGlobFilter", "*.png").load(f"{root}/*/{kind}")
        name = rf"([^/]+)/{kind}/(?:{kind}_)?(\d+)\.png$"
        return files.select(
            F.regexp_extract("path", name, 1).alias("sequence_id"), F.regexp_extract("path", name, 2).cast("long").alias("frame_index"),
            F.col("content").alias(kind), F.col("modificationTime").alias(f"{kind}_time"),
        ).withWatermark(f"{kind}_time", lateness)

    rgb, depth = side("rgb"), side("depth").withColumnsRenamed({"sequence_id": "s", "frame_index": "f"})
    near = F.expr(f"depth_time BETWEEN rgb_time - INTERVAL {lateness} AND rgb_time + INTERVAL {lateness}")
    joined = rgb.join(depth, (F.col("sequence_id") == F.col("s")) & (F.col("frame_index") == F.col("f")) & near)
    return joined.select("sequence_id", "frame_index", "rgb", "depth", "rgb_time")


def split_late(frames: DataFrame, newest: DataFrame, lateness: str = LATENESS) -> tuple[DataFrame, DataFrame]:
    """For ``foreachBatch``: frames in time, and rejects more than ``lateness`` behind the newest time (a one-row table ``newest``)."""
    limit = newest.select((F.col("newest") - F.expr(f"INTERVAL {lateness}")).alias("limit"))
    marked = frames.join(F.broadcast(limit))
    late = F.col("ts") < F.col("limit")
    return marked.where(~late | F.col("limit").isNull()).drop("limit"), marked.where(late).drop("limit")


def position_asof(events: DataFrame) -> DataFrame:
    """Frames with the latest position before them in (ts, event_id) order; 0 before the first. Empty messages don't count.

    ``events`` has (sequence_id, ts, event_id, kind (frame or position), position_m).
    """
    before = W.partitionBy("sequence_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("kind") == "position", F.col("position_m")), ignorenulls=True).over(before)
    out = events.withColumn("position_m", F.coalesce(latest, F.lit(0.0))).where("kind = 'frame'")
    index = F.row_number().over(W.partitionBy("sequence_id").orderBy("ts", "event_id")) - 1
    return out.select("sequence_id", "ts", "event_id", index.cast("long").alias("frame_index"), "position_m")


def _values(rows: Iterator[Row], columns: tuple[str, ...]) -> list[tuple]:
    """The named columns of a key's rows. Rows are plain tuples here: a data frame for each key would cost more than its rows."""
    out, at = [], None
    for r in rows:
        at = [r.__fields__.index(c) for c in columns] if at is None else at
        out.append(tuple(r[k] for k in at))
    return out


def _nulls_last(*values) -> tuple:
    return tuple((x is None, x) for x in values)


def _number(x: float | None) -> float:
    return math.nan if x is None else float(x)


class _AsOf(StatefulProcessor):
    COLUMNS = ("ts", "event_id", "kind", "position_m")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "position double, frames long")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        position, n = self.state.get() or (0.0, 0)
        out = []
        for ts, event_id, kind, position_m in sorted(_values(rows, self.COLUMNS), key=lambda r: _nulls_last(*r[:2])):
            if kind == "position":
                position = position if position_m is None or math.isnan(position_m) else float(position_m)
            else:
                out.append(Row(sequence_id=key[0], ts=ts, event_id=event_id, frame_index=n, position_m=position))
                n += 1
        self.state.update((position, n))
        yield from out

    def close(self) -> None:
        pass


def stream_position_asof(events: DataFrame) -> DataFrame:
    """The streaming twin of ``position_asof``: rows of a later batch come after those of an earlier one."""
    key = events.schema["sequence_id"].dataType.simpleString()
    schema = f"sequence_id {key}, ts timestamp, event_id long, frame_index long, position_m double"
    return events.groupBy("sequence_id").transformWithState(_AsOf(), schema, "Append", "none")


def capture_stop(frames: DataFrame, end_position_m: float = 0.78) -> DataFrame:
    """Frames up to the one that ends the capture: the first even frame whose position isn't 0 and has reached the end."""
    hit = (F.col("frame_index") % 2 == 0) & (F.col("position_m") != 0) & (F.col("position_m") >= end_position_m)
    stop = F.min(F.when(hit, F.col("frame_index"))).over(W.partitionBy("sequence_id"))
    return frames.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("frame_index") <= F.col("stop"))).drop("stop")


def capture_duration(frames: DataFrame, duration_s: float, fps: int = 30, ts: str = "ts") -> DataFrame:
    """Frames of the first ``duration_s`` seconds (all if it isn't above 0), with the number expected."""
    elapsed = F.col(ts).cast("double") - F.min(F.col(ts).cast("double")).over(W.partitionBy("sequence_id"))
    out = frames.withColumn("elapsed_s", elapsed)
    out = out.where(F.col("elapsed_s") < duration_s) if duration_s > 0 else out
    return out.withColumn("expected", F.lit(int(duration_s * fps) if duration_s > 0 else None).cast("int"))


def drop_incomplete(frames: DataFrame, keep_gaps: bool) -> DataFrame:
    """Frames with both images (has_color, has_depth): counted anew, or with the gaps that dropped frames leave."""
    out = frames.where("has_color and has_depth")
    if keep_gaps:
        return out
    order = W.partitionBy("sequence_id").orderBy("frame_index")
    return out.withColumn("place", F.row_number().over(order) - 1).drop("frame_index").withColumn("frame_index", F.col("place").cast("long")).drop("place")


def session_rollup(frames: DataFrame) -> DataFrame:
    """Number of frames and the map of positions of each session."""
    entry = F.struct(F.col("frame_index").cast("string"), "position_m")
    return frames.groupBy("sequence_id").agg(F.count("*").alias("n_frames"), F.map_from_entries(F.collect_list(entry)).alias("frame_positions"))


def capture_progress(rows: DataFrame, done: str, total: str) -> DataFrame:
    """``percent``: truncated and at most 100; null if the total is 0."""
    percent = F.least(F.lit(100), F.floor(100 * F.col(done) / F.nullif(F.col(total), F.lit(0))))
    return rows.withColumn("percent", percent.cast("int"))


class _Agent(StatefulProcessor):
    COLUMNS = ("frame_index", "fitness", "rmse", "translation_m", "rotation_deg")

    def __init__(self, config: AgentConfig, cap: float):
        self.config, self.cap = config, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("agent", "fitness array<double>, rmse array<double>, accepted long, rejects long, seen long")

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        kept = self.state.get() or ([], [], 0, 0, 0)
        state, seen, out = AgentState(self.config, *kept[:4]), kept[4], []
        for frame, *values in sorted(_values(rows, self.COLUMNS), key=lambda r: _nulls_last(r[0])):
            out.append(_verdict(key, frame, state.step(seen == 0, *map(_number, values), self.cap)))
            seen += 1
        self.state.update((state.fitness, state.rmse, state.accepted, state.rejects, seen))
        yield from out

    def close(self) -> None:
        pass


class _OrderedAgent(StatefulProcessor):
    """Frames wait until the watermark has passed them and are then judged in their order; a timer is set for the next one.

    What a sequence is remembered by, the frames that wait included, is one value: it is read and written once in a batch.
    """

    COLUMNS = ("frame_index", "due", "fitness", "rmse", "translation_m", "rotation_deg")

    def __init__(self, config: AgentConfig, cap: float):
        self.config, self.cap = config, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        waiting = ", ".join(f"w_{c} array<{'long' if k < 2 else 'double'}>" for k, c in enumerate(self.COLUMNS))
        self.state = handle.getValueState("agent", f"fitness array<double>, rmse array<double>, accepted long, rejects long, last long, timer long, {waiting}")

    def _kept(self) -> tuple[list, dict[int, tuple]]:
        """(windows, counters, last frame and timer; what waits by its frame)."""
        kept = self.state.get() or ([], [], 0, 0, None, None, *[[]] * len(self.COLUMNS))
        return list(kept[:6]), {frame: tuple(rest) for frame, *rest in zip(*kept[6:])}

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        now, (kept, waiting) = timers.getCurrentWatermarkInMs(), self._kept()
        last = kept[4]
        for frame, due, *values in _values(rows, self.COLUMNS):
            if frame is None:
                continue
            due = now + 1 if due is None else due
            if due <= now or (last is not None and frame <= last) or frame in waiting:
                yield _verdict(key, frame, (None, None, None, None), True)
            else:
                waiting[frame] = (due, *map(_number, values))
        yield from self._judge(key, now, kept, waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._judge(key, timerValues.getCurrentWatermarkInMs(), *self._kept())

    def _judge(self, key, now: int, kept: list, waiting: dict[int, tuple]) -> list[Row]:
        """Verdicts of all frames up to the last one that the watermark has passed. What stays sets the next timer."""
        upto = max((frame for frame, (due, *_) in waiting.items() if due <= now), default=None)
        *kept, last, timer = kept
        state, out = AgentState(self.config, *kept), []
        for frame in sorted(f for f in waiting if upto is not None and f <= upto):
            out.append(_verdict(key, frame, state.step(last is None, *waiting.pop(frame)[1:], self.cap), False))
            last = frame
        ahead = min((due for due, *_ in waiting.values()), default=None)
        if ahead != timer:
            if timer is not None and timer > now:
                self.handle.deleteTimer(timer)
            if ahead is not None:
                self.handle.registerTimer(ahead)
        columns = map(list, zip(*((frame, *rest) for frame, rest in waiting.items()))) if waiting else [[]] * len(self.COLUMNS)
        self.state.update((state.fitness, state.rmse, state.accepted, state.rejects, last, ahead, *columns))
        return out

    def close(self) -> None:
        pass


def _verdict(key, frame: int, values: tuple, late: bool | None = None) -> Row:
    out = dict(zip(_SCANNED, (key[0], frame, *values)))
    return Row(**out) if late is None else Row(**out, late=late)


_SCANNED = [x.split()[0] for x in SCAN_SCHEMA.split(", ")]
ORDERED_SCHEMA = SCAN_SCHEMA + ", late boolean"


def stream_agent(
    metrics: DataFrame, expected_step_m: float = 0.0, config: AgentConfig = CONFIG, ts: str | None = None, lateness_s: int = 600, grace_s: int = 86_400
) -> DataFrame:
    """Accept or reject as metric rows arrive; the streaming twin of ``agent_scan``.

    Without ``ts``, rows of a later batch come after those of an earlier one. With ``ts``, the column of a frame's time, frames
    may arrive in any order: one waits in a buffer until the stream's newest time is ``lateness_s`` ahead of it, and what has
    waited is judged in the order of ``frame_index``, whichever batches it came in. The buffer holds a sequence's frames of that time. The
    result then has ``late``: a frame that comes after its turn, or once more, isn't judged and is a row with nulls. Frames more
    than ``grace_s`` later still are dropped by Spark, which counts them in its progress. A row without a
    ``frame_index`` only moves the clock, so that the last frames of a capture needn't wait for another capture's; a frame
    without a time is judged as soon as the clock moves. Times are after 1970 by more than the grace.
    """
    cap = translation_cap(expected_step_m, config)
    if ts is None:
        return metrics.groupBy("sequence_id").transformWithState(_Agent(config, cap), SCAN_SCHEMA, "Append", "none")
    # Spark drops what is behind its watermark, so that trails by the grace as well and timers are set ahead by it
    rows = metrics.select("sequence_id", F.col(ts).alias("ts"), "frame_index", (F.unix_millis(ts) - 1000 * grace_s).alias("due"), *_OrderedAgent.COLUMNS[2:])
    rows = rows.withWatermark("ts", f"{lateness_s + grace_s} seconds")
    return rows.groupBy("sequence_id").transformWithState(_OrderedAgent(config, cap), ORDERED_SCHEMA, "Append", "eventTime")


def stream_metrics(registrations: DataFrame) -> DataFrame:
    """Running counts by sequence and status, for the update mode."""
    return registrations.groupBy("sequence_id", "status").agg(F.count("*").alias("n_frames"))


def merge_voxels(voxels: DataFrame) -> DataFrame:
    """Means by weight of volumes in one table. The running mean doesn't depend on how frames are batched."""
    mean = lambda c: (F.sum(F.col(c) * F.col("weight")) / F.sum("weight")).alias(c)
    return voxels.groupBy("sequence_id", "ix", "iy", "iz").agg(*[mean(c) for c in ("tsdf", "r", "g", "b")], F.sum("weight").alias("weight"))


def _volume_parts(spark: SparkSession, path: str, schema: StructType, below: int | None = None) -> DataFrame:
    """Parts of a growing volume: the newest merged part and those of later batches, all of batches before ``below``."""
    try:
        parts = spark.read.schema(StructType([*schema.fields, StructField("kind", StringType()), StructField("batch", LongType())])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    parts = parts if below is None else parts.where(F.col("batch") < below)
    base = parts.where("kind = 'merged'").agg(F.max("batch")).first()[0]
    return (parts if base is None else parts.where((F.col("batch") > base) | ((F.col("batch") == base) & (F.col("kind") == "merged")))).drop("kind", "batch")


def on_volume(path: str, poses: DataFrame, camera: Camera, voxel: float, scale: float = 1000.0, trunc_m: float = 3.5, merge_every: int = 8):
    """A ``foreachBatch`` function that adds each batch's pixels to the volume in the folder ``path``.

    A batch writes a part of its own, named by its number, so one that is run again replaces itself and counts once. Every
    ``merge_every`` batches the part is the merged volume so far; what came before isn't read any more. Pixels of a frame
    may come in several batches: its surface is then widened for each share of them. ``volume_so_far`` reads the folder.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        new = tsdf_integrate(batch, poses, camera, voxel, scale, trunc_m)
        merges = (batch_id + 1) % merge_every == 0
        if merges:
            new = merge_voxels(_volume_parts(batch.sparkSession, path, new.schema, batch_id).unionByName(new))
        new.write.mode("overwrite").parquet(f"{path}/kind={'merged' if merges else 'part'}/batch={batch_id}")

    return add


def volume_so_far(spark: SparkSession, path: str, sequence_type: str = "long") -> DataFrame:
    """The volume that ``on_volume`` has written up to now: ``sequence_id, ix, iy, iz, tsdf, r, g, b, weight``; no rows before the first batch."""
    columns = f"sequence_id {sequence_type}, ix long, iy long, iz long, tsdf double, weight long, r double, g double, b double"
    return merge_voxels(_volume_parts(spark, path, StructType.fromDDL(columns)))


def observed(frames: DataFrame, name: str | Observation = "frames") -> DataFrame:
    """Counts of frames and mean scores that a listener or ``Observation`` sees as a run goes on (progress callbacks)."""
    return frames.observe(name, F.count("*").alias("n_frames"), F.avg("fitness").alias("mean_fitness"), F.max("frame_index").alias("last_frame"))


def on_frames(path: str):
    """A ``foreachBatch`` function that adds each batch's accepted points to a live snapshot."""
    return lambda batch, batch_id: live_snapshot(batch, path, batch_id)


def completed(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a run reports at its end: the frames that succeeded, and those that failed (a null status among them)."""
    good = F.coalesce(F.col("status").isin("OK", "RECOVERED"), F.lit(False))
    return outcomes.where(good), outcomes.where(~good)


def pair_progress(pairs: DataFrame, order: str = "pair_index") -> DataFrame:
    """``done, total, percent`` after each pair of a sequence, pairs without a result included."""
    mine = W.partitionBy("sequence_id")
    rows = pairs.withColumns({"done": F.row_number().over(mine.orderBy(order)).cast("long"), "total": F.count("*").over(mine)})
    return capture_progress(rows, "done", "total")
