"""Judging registrations: adaptive thresholds, accept / retry / reject, and the ordered scan of a sequence."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldscan.functions.geometry import rotation_deg, translation_m

#: The order of the strategies.
STRATEGIES = ("tighter_crop", "voxel_downsample", "denoise", "reseed_init", "point_to_plane", "feature_init")


@dataclass(frozen=True)
class AgentConfig:
    """The tunables of the agent."""

    fitness_floor: float = 0.3
    rmse_ceiling: float = 0.015
    fitness_mads: float = 3.0
    rmse_mads: float = 3.0
    window: int = 20
    cold_start: int = 8
    least_history: int = 3
    translation_factor: float = 3.0
    translation_cap_m: float = 0.05
    rotation_cap_deg: float = 10.0
    max_retries: int = 5
    fallback_after: int = 3
    enabled: tuple[str, ...] = STRATEGIES[:5]

    def recovery(self, attempt: int) -> str | None:
        """The strategy for an attempt; none at max_retries or past the enabled ones."""
        ordered = [s for s in STRATEGIES if s in self.enabled]
        unknown = set(self.enabled) - set(STRATEGIES)
        if unknown:
            raise ValueError(f"unknown strategies: {sorted(unknown)}")
        return ordered[attempt] if 0 <= attempt < min(self.max_retries, len(ordered)) else None


CONFIG = AgentConfig()


def recovery_order(attempts: DataFrame, attempt: str = "attempt", config: AgentConfig = CONFIG) -> DataFrame:
    """``strategy`` of each attempt, null where none is left."""
    out = F.lit(None).cast("string")
    for k in range(config.max_retries):
        if config.recovery(k):
            out = F.when(F.col(attempt) == k, config.recovery(k)).otherwise(out)
    return attempts.withColumn("strategy", out)


def median_mad(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and median absolute deviation of each group; nulls don't count, none give 0 and 0."""
    middle = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    spread = F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5))
    out = rows.join(middle, keys).groupBy(*keys, "median").agg(spread.alias("mad"))
    return out.select(*keys, F.coalesce("median", F.lit(0.0)).alias("median"), F.coalesce("mad", F.lit(0.0)).alias("mad"))


def _limit(values: str, sign: float, k: float) -> Column:
    """Median plus or minus k times the MAD of an array column; the median is bound once, as a field of an array of one."""

    def middle(a: str) -> str:
        return f"((element_at({a}, cast((size({a}) + 1) div 2 as int)) + element_at({a}, cast(size({a}) div 2 + 1 as int))) / 2)"

    ordered = f"transform(array(sort_array({values})), s -> named_struct('s', s, 'm', {middle('s')}))"
    spread = f"transform({ordered}, x -> named_struct('m', x.m, 'd', array_sort(transform(x.s, q -> abs(q - x.m)))))"
    return F.expr(f"element_at(transform({spread}, x -> x.m + {sign * k}D * {middle('x.d')}), 1)")


def adaptive_thresholds(accepted: DataFrame, config: AgentConfig = CONFIG) -> DataFrame:
    """``min_fitness, max_rmse`` before each frame of a sequence whose frames all were accepted.

    The floors alone hold while fewer than cold_start frames were accepted. Limits only tighten the floors.
    """
    last = W.partitionBy("sequence_id").orderBy("frame_index").rowsBetween(-config.window, -1)
    before = W.partitionBy("sequence_id").orderBy("frame_index").rowsBetween(W.unboundedPreceding, -1)
    out = accepted.withColumn("fit_win", F.collect_list("fitness").over(last)).withColumn("rmse_win", F.collect_list("rmse").over(last))
    warm = (F.count("*").over(before) >= config.cold_start) & (F.size("fit_win") >= config.least_history)
    low = F.greatest(F.lit(config.fitness_floor), _limit("fit_win", -1.0, config.fitness_mads))
    high = F.least(F.lit(config.rmse_ceiling), _limit("rmse_win", 1.0, config.rmse_mads))
    out = out.withColumn("warm", warm)
    out = out.withColumn("min_fitness", F.when(F.col("warm"), low).otherwise(config.fitness_floor))
    return out.withColumn("max_rmse", F.when(F.col("warm"), high).otherwise(config.rmse_ceiling)).drop("warm", "fit_win", "rmse_win")


def judge(
    rows: DataFrame, expected_step_m: float = 0.0, attempt: Column | int = 0, min_fitness: Column | float | None = None,
    max_rmse: Column | float | None = None, config: AgentConfig = CONFIG, transform: str | None = "T",
) -> DataFrame:
    """``action`` (accept, retry or reject) and ``reason`` of registrations with fitness, rmse and a transform.

    Without ``transform`` the columns translation_m and rotation_deg are there already.
    """
    as_col = lambda x, default: x if isinstance(x, Column) else F.lit(float(default if x is None else x))
    low, high = as_col(min_fitness, config.fitness_floor), as_col(max_rmse, config.rmse_ceiling)
    cap = translation_cap(expected_step_m, config)
    if transform:
        rows = rows.withColumn("translation_m", translation_m(F.col(transform))).withColumn("rotation_deg", rotation_deg(F.col(transform)))
    checks = [
        (F.col("fitness") < low, F.format_string("fitness %.3f < %.3f", "fitness", low)),
        (F.col("rmse") > high, F.format_string("rmse %.4f > %.4f", "rmse", high)),
        (F.col("translation_m") > cap, F.format_string("translation %.4f > %.4f", "translation_m", F.lit(cap))),
        (F.col("rotation_deg") > config.rotation_cap_deg, F.format_string("rotation %.2f > %.2f", "rotation_deg", F.lit(config.rotation_cap_deg))),
    ]
    bad = checks[0][0] | checks[1][0] | checks[2][0] | checks[3][0]
    attempt = attempt if isinstance(attempt, Column) else F.lit(attempt)
    left = F.lit(False)
    for k in range(config.max_retries):
        if config.recovery(k):
            left = left | (attempt == k)
    out = rows.withColumn("reason", F.concat_ws("; ", *[F.when(c, text) for c, text in checks]))
    return out.withColumn("action", F.when(~bad, "accept").when(left, "retry").otherwise("reject"))


class AgentState:
    """What the agent remembers of a sequence: two bounded windows and two counters."""

    def __init__(self, config: AgentConfig, fitness: list[float] = (), rmse: list[float] = (), accepted: int = 0, rejects: int = 0):
        self.config, self.fitness, self.rmse, self.accepted, self.rejects = config, list(fitness), list(rmse), accepted, rejects

    def thresholds(self) -> tuple[float, float]:
        c = self.config
        if self.accepted < c.cold_start or len(self.fitness) < c.least_history:
            return c.fitness_floor, c.rmse_ceiling
        med_f, med_r = median(self.fitness), median(self.rmse)
        mad_f, mad_r = median(abs(x - med_f) for x in self.fitness), median(abs(x - med_r) for x in self.rmse)
        return max(c.fitness_floor, med_f - c.fitness_mads * mad_f), min(c.rmse_ceiling, med_r + c.rmse_mads * mad_r)

    def fits(self, fitness: float, rmse: float, translation: float, rotation: float, cap: float) -> bool:
        low, high = self.thresholds()
        return fitness >= low and rmse <= high and translation <= cap and rotation <= self.config.rotation_cap_deg

    def record(self, good: bool, fitness: float, rmse: float) -> bool:
        """Remember a verdict; the fallback flag after it."""
        if good:
            self.fitness = [*self.fitness, fitness][-self.config.window :]
            self.rmse = [*self.rmse, rmse][-self.config.window :]
            self.accepted, self.rejects = self.accepted + 1, 0
        else:
            self.rejects += 1
        return self.rejects >= self.config.fallback_after

    def step(self, first: bool, fitness: float, rmse: float, translation: float, rotation: float, cap: float) -> tuple[bool, float, float, bool]:
        """(accepted, min_fitness, max_rmse, fallback flag) of the next frame; the first frame is accepted as (1, 0)."""
        low, high = self.thresholds()
        good = first or self.fits(fitness, rmse, translation, rotation, cap)
        return good, low, high, self.record(good, 1.0 if first else fitness, 0.0 if first else rmse)


def translation_cap(expected_step_m: float, config: AgentConfig = CONFIG) -> float:
    return max(config.translation_factor * expected_step_m, config.translation_cap_m) if expected_step_m > 0 else config.translation_cap_m


SCAN_SCHEMA = "sequence_id long, frame_index long, accepted boolean, min_fitness double, max_rmse double, fallback boolean"


def agent_scan(rows: DataFrame, expected_step_m: float = 0.0, config: AgentConfig = CONFIG) -> DataFrame:
    """Accept or reject the frames of every sequence in order: each verdict depends on the frames accepted before.

    Only metric rows (fitness, rmse, translation_m, rotation_deg) are grouped, so a group is a few bytes per frame of one
    sequence; sequences run in parallel.
    """
    cap = translation_cap(expected_step_m, config)

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        state, out = AgentState(config), []
        for i, r in enumerate(group.sort_values("frame_index").itertuples()):
            good, low, high, fallback = state.step(i == 0, r.fitness, r.rmse, r.translation_m, r.rotation_deg, cap)
            out.append((r.sequence_id, r.frame_index, good, low, high, fallback))
        return pd.DataFrame(out, columns=[x.split()[0] for x in SCAN_SCHEMA.split(", ")])

    needed = rows.select("sequence_id", "frame_index", "fitness", "rmse", "translation_m", "rotation_deg")
    return needed.groupBy("sequence_id").applyInPandas(scan, SCAN_SCHEMA)


#: Earlier frames that a frame near a failing one is registered against ahead of time.
LOOK_BACK = 3


def attempt_scan(
    rows: DataFrame, expected_step_m: float = 0.0, config: AgentConfig = CONFIG, strict: bool = False, look_back: int = LOOK_BACK, ahead: int | None = None
) -> DataFrame:
    """As ``agent_scan``, of frames with several tries against several targets: the first try that fits is taken.

    ``tries`` of a row are the ones made so far: an array of (target, attempt, fitness, rmse, translation_m, rotation_deg);
    ``problem`` says why a frame has no cloud, or is null. A frame's target is the frame accepted last. Adds ``target``,
    ``attempt``, the last one looked at, ``wanted``, the next one if it isn't made, and ``asks``, the tries
    (target, attempt) to make now. No verdict is final that comes behind a wanted try, but the scan goes on with a guess, so
    that one round asks for what is missing all along the sequence: a frame that failed so far counts as rejected, one that
    wasn't tried against its target as accepted, and frames near them are asked for against the ``look_back`` last frames
    that may turn out to be their target. A failing frame asks for ``ahead`` attempts at once, by default for all.

    Frames with a problem are FAILED and leave the agent as it is. The first frame without one is accepted as it stands;
    with ``strict``, a sequence whose first frame has a problem has no target, so all of its frames fail.
    """
    cap = translation_cap(expected_step_m, config)
    more = config.max_retries + 1 if ahead is None else ahead
    schema = SCAN_SCHEMA.replace("sequence_id long", f"sequence_id {rows.schema['sequence_id'].dataType.simpleString()}") + ", target long, attempt int, wanted int, asks array<struct<target:long,attempt:int>>, failed string"

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        state, out, targets, lost = AgentState(config), [], [], False
        for i, r in enumerate(group.sort_values("frame_index").itertuples()):
            low, high = state.thresholds()
            problem = r.problem if isinstance(r.problem, str) else None
            lost = lost or (strict and i == 0 and problem is not None)
            if lost and problem is None:
                problem = "no first frame"
                state.record(False, 0.0, 0.0)
            if problem is not None:
                out.append((r.sequence_id, r.frame_index, False, low, high, state.rejects >= config.fallback_after, None, 0, None, [], problem))
                continue
            if not targets:
                fallback = state.record(True, 1.0, 0.0)
                out.append((r.sequence_id, r.frame_index, True, low, high, fallback, None, 0, None, [], None))
                targets = [r.frame_index]
                continue
            tries = {(t["target"], t["attempt"]): t for t in (r.tries if r.tries is not None else ())}
            target, k, wanted, good, found = targets[-1], 0, None, False, None
            while True:
                t = tries.get((target, k))
                if t is None:
                    wanted = k
                    break
                found = t["fitness"], t["rmse"]
                good = state.fits(*found, t["translation_m"], t["rotation_deg"], cap)
                if good or config.recovery(k) is None:
                    break
                k += 1
            asks = [(x, 0) for x in targets[-look_back:] if (x, 0) not in tries]
            while wanted and k < wanted + more:
                if (target, k) not in tries:
                    asks.append((target, k))
                if config.recovery(k) is None:
                    break
                k += 1
            k = k if wanted is None else wanted
            fallback = state.rejects >= config.fallback_after if wanted == 0 else state.record(good, *found)
            out.append((r.sequence_id, r.frame_index, good, low, high, fallback, target, k, wanted, asks if wanted is not None or len(targets) > 1 else [], None))
            if good:
                targets = [r.frame_index]
            elif wanted == 0:
                targets = [*targets, r.frame_index]
        made = pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])
        made["asks"] = [[{"target": t, "attempt": k} for t, k in asks] for asks in made["asks"]]
        return made.astype({"wanted": "Int32", "target": "Int64"})

    return rows.select("sequence_id", "frame_index", "tries", "problem").groupBy("sequence_id").applyInPandas(scan, schema)


def consecutive_rejects(judged: DataFrame, accepted: str = "accepted", flag_at: int = 3) -> DataFrame:
    """``rejects``: length of the run of rejects that a frame ends (0 if accepted), and ``fallback`` from ``flag_at`` on."""
    ordered = W.partitionBy("sequence_id").orderBy("frame_index")
    island = F.sum(F.col(accepted).cast("int")).over(ordered.rowsBetween(W.unboundedPreceding, 0))
    out = judged.withColumn("island", island)
    run = F.sum((~F.col(accepted)).cast("int")).over(W.partitionBy("sequence_id", "island").orderBy("frame_index").rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("rejects", F.when(F.col(accepted), 0).otherwise(run).cast("long"))
    return out.withColumn("fallback", F.col("rejects") >= flag_at).drop("island")


def simple_accept(rows: DataFrame) -> DataFrame:
    """The older rule: any match, or one of the first three frames."""
    return rows.withColumn("accepted", (F.col("fitness") > 0) | (F.col("frame_index") < 3))


def target_chain(judged: DataFrame, accepted: str = "accepted") -> DataFrame:
    """``target``: the accepted frame before each frame; null for the first."""
    before = W.partitionBy("sequence_id").orderBy("frame_index").rowsBetween(W.unboundedPreceding, -1)
    return judged.withColumn("target", F.last(F.when(F.col(accepted), F.col("frame_index")), ignorenulls=True).over(before))


def recovery_loop(rows: DataFrame, attempts: dict[str, DataFrame], expected_step_m: float = 0.0, config: AgentConfig = CONFIG) -> DataFrame:
    """Retry failing pairs with the next strategy until one is accepted or none is left.

    ``rows`` has pair keys, fitness, rmse and T of the first try; ``attempts`` the same columns for each strategy, made for
    the failing pairs (one job each). A strategy without a row for a pair counts as failed: fitness 0, rmse infinite,
    the transform stays. Adds status (OK, RECOVERED, REJECTED), recovered_via, attempts and last_strategy.
    """
    keys = ["sequence_id", "frame_index"]
    now = judge(rows, expected_step_m, 0, config=config).select(*keys, "fitness", "rmse", "T", "action", "reason")
    now = now.withColumns({"recovered_via": F.lit(None).cast("string"), "attempts": F.lit(0), "last_strategy": F.lit(None).cast("string")})
    for k in range(config.max_retries):
        strategy = config.recovery(k)
        if strategy is None:
            break
        tried = attempts[strategy].select(*keys, F.col("fitness").alias("f"), F.col("rmse").alias("e"), F.col("T").alias("new_t")) if strategy in attempts else None
        again = now.where("action = 'retry'")
        if tried is None:
            again = again.withColumns({"f": F.lit(0.0), "e": F.lit(float("inf")), "new_t": F.col("T")})
        else:
            again = again.join(tried, keys, "left")
        again = again.withColumns({"fitness": F.coalesce("f", F.lit(0.0)), "rmse": F.coalesce("e", F.lit(float("inf"))), "T": F.coalesce("new_t", "T"),
                                   "attempts": F.lit(k + 1), "last_strategy": F.lit(strategy)}).drop("f", "e", "new_t", "action", "reason")
        again = judge(again, expected_step_m, k + 1, config=config).drop("translation_m", "rotation_deg")
        again = again.withColumn("recovered_via", F.when(F.col("action") == "accept", F.lit(strategy)))
        now = now.where("action != 'retry'").unionByName(again)
    status = F.when(F.col("action") != "accept", "REJECTED").when(F.col("recovered_via").isNotNull(), "RECOVERED").otherwise("OK")
    return now.withColumn("status", status)
