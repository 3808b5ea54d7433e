"""Registration of frame pairs: every round of ICP is one job over all active pairs.

A pair table has (sequence_id, source_frame, target_frame). Its clouds are rows keyed by the pair; a round moves the
source by the pair's transform, finds nearest targets by a cell join, sums the normal equations by pair and solves all
6x6 systems in batches. Transforms are written between rounds; pairs that have converged leave the loop.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscan.functions.geometry import identity, moved
from fieldscan.functions.scratch import few_or_many, many, stored

from .neighbors import POINT, color_gradient, estimate_normals, knn_hybrid, nn_correspondence

PAIR = ["sequence_id", "source_frame", "target_frame"]
#: Descriptors in a block at most (by expectation), pivots for so many of them, and tasks that draw hypotheses for a pair.
BLOCK, PIVOTS, PARTS = 2048, 4, 8
#: Matches of a pair, at most, that are searched in one group, each three of them once.
FEW = 64


def pair_clouds(pairs: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source and target clouds of all pairs, keyed by the pair."""
    side = lambda c: many(pairs.select(*PAIR)).join(points.withColumnRenamed("frame_index", c), ["sequence_id", c])
    return side("source_frame"), side("target_frame")


def icp_normal_eq(matched: DataFrame, colored: bool | Column = False, weight: float = 0.968) -> DataFrame:
    """The sums of one Gauss-Newton step of each pair: 21 products, 6 right sides, from point-to-plane residuals.

    ``matched`` has source x, y, z, target o_x, o_y, o_z and normal o_nx, o_ny, o_nz. With ``colored`` the photometric
    residual on the target's tangent plane (o_grey, o_dx, o_dy, o_dz against the source's grey) is added, the geometric
    one weighted by ``weight`` and the other by the rest; a column says for each row whether it is.
    """
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    n = [F.col(f"o_n{c}") for c in "xyz"]
    e = [F.col(c) - F.col(f"o_{c}") for c in "xyz"]
    dot = lambda a, b: sum((p * q for p, q in zip(a[1:], b[1:])), a[0] * b[0])

    def row(name: str, g: list[Column], residual: Column) -> dict[str, Column]:
        j = [y * g[2] - z * g[1], z * g[0] - x * g[2], x * g[1] - y * g[0], *g]
        return {f"{name}{a}": c for a, c in enumerate(j)} | {f"{name}_off": residual}

    # each factor is a column of its own, so the sums are of short products
    rows = matched.withColumns(row("j", n, dot(e, n)))
    mixed = isinstance(colored, Column)
    if mixed or colored:
        d = [F.col(f"o_d{c}") for c in "xyz"]
        rows = rows.withColumn("along", dot(d, n)).withColumns({f"p{c}": v - F.col("j_off") * m for c, v, m in zip("xyz", e, n)})
        rows = rows.withColumns({f"g{c}": v - F.col("along") * m for c, v, m in zip("xyz", d, n)})
        rows = rows.withColumns(row("k", [F.col(f"g{c}") for c in "xyz"], F.col("o_grey") + dot(d, [F.col(f"p{c}") for c in "xyz"]) - F.col("grey")))
        geometric, photometric = (F.when(colored, weight).otherwise(1.0), F.when(colored, 1 - weight).otherwise(0.0)) if mixed else (F.lit(weight), F.lit(1 - weight))
        rows = rows.withColumns({"wj": geometric, "wk": photometric})
    names = ("j", "k") if mixed or colored else ("j",)
    term = lambda a, b: sum((F.col(f"w{m}") * F.col(f"{m}{a}") * F.col(f"{m}{b}") for m in names), F.lit(0.0)) if len(names) > 1 else F.col(f"j{a}") * F.col(f"j{b}")
    aggs = [F.sum(term(a, b)).alias(f"a{a}{b}") for a in range(6) for b in range(a, 6)] + [F.sum(-term(a, "_off")).alias(f"b{a}") for a in range(6)]
    return rows.groupBy(*PAIR).agg(F.count("*").alias("n_matched"), F.sqrt(F.avg("d2")).alias("rmse"), *aggs)


#: What a round keeps of each pair; ``going`` pairs take another.
STATE = {"T": T.ArrayType(T.DoubleType()), "fitness": T.DoubleType(), "rmse": T.DoubleType(), "iterations": T.IntegerType(), "going": T.BooleanType(),
         "radius": T.DoubleType(), "colored": T.BooleanType(), "n_source": T.LongType()}


def _steps(systems: DataFrame, max_iter: int) -> DataFrame:
    """The pairs' state after a round, from the state before it and the sums: solves all systems of a batch at once.

    A pair ends without matches, at ``max_iter``, or when fitness and rmse change by less than 1e-6; its transform then is
    the one that the scores belong to. A singular system leaves the transform as it is.
    """
    names = [f"a{a}{b}" for a in range(6) for b in range(a, 6)]
    schema = T.StructType([systems.schema[k] for k in PAIR] + [T.StructField(k, t) for k, t in STATE.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            matched = batch["n_matched"].fillna(0).to_numpy(float)
            fitness, rmse = matched / np.maximum(batch["n_source"].to_numpy(float), 1), batch["error"].fillna(0).to_numpy(float)
            still = (np.abs(fitness - batch["fitness"]) >= 1e-6) | (np.abs(rmse - batch["rmse"]) >= 1e-6)
            going = (still & (fitness > 0) & (batch["iterations"] < max_iter)).to_numpy()
            m = np.zeros((len(batch), 6, 6))
            i, j = np.triu_indices(6)
            m[:, i, j] = m[:, j, i] = batch[names].fillna(0).to_numpy(float)
            step = np.einsum("kij,kj->ki", np.linalg.pinv(m, rcond=1e-9, hermitian=True), batch[[f"b{a}" for a in range(6)]].fillna(0).to_numpy(float))
            a, b, c = step[:, 0], step[:, 1], step[:, 2]
            ca, sa, cb, sb, cc, sc = np.cos(a), np.sin(a), np.cos(b), np.sin(b), np.cos(c), np.sin(c)
            delta = np.zeros((len(batch), 4, 4))
            delta[:, 0, :3] = np.stack([cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa], 1)
            delta[:, 1, :3] = np.stack([sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa], 1)
            delta[:, 2, :3] = np.stack([-sb, cb * sa, cb * ca], 1)
            delta[:, :3, 3] = step[:, 3:]
            delta[:, 3, 3] = 1
            before = np.stack(batch["T"].to_numpy()).reshape(-1, 4, 4)
            after = np.where(going[:, None, None], delta @ before, before)
            yield batch[[*PAIR, "radius", "colored", "n_source"]].assign(
                T=list(after.reshape(-1, 16)), fitness=fitness, rmse=rmse, iterations=(batch["iterations"] + going).astype("int32"), going=going
            )[schema.names]

    return systems.mapInPandas(run, schema)


def run_icp(start: DataFrame, source: DataFrame, target: DataFrame, max_iter: int) -> DataFrame:
    """``T, fitness, rmse, iterations, colored`` of every pair of ``start``, which has T, radius and colored for each.

    A round is one job over all pairs that go on: move, match, sum, solve. Sources and targets are keyed by the pair; with
    ``colored`` anywhere they have grey and its gradient. A pair with an empty cloud has fitness and rmse 0.
    """
    sizes = source.groupBy(*PAIR).agg(F.count("*").alias("n_source"))
    fresh = {"fitness": F.lit(-1.0), "rmse": F.lit(-1.0), "iterations": F.lit(0), "going": F.lit(True), "n_source": F.coalesce("n_source", F.lit(0).cast("long"))}
    state = stored(start.select(*PAIR, F.coalesce("T", identity()).alias("T"), "radius", "colored").join(many(sizes), PAIR, "left").withColumns(fresh).select(*PAIR, *STATE), "icp")
    pairs = state.count()
    around = stored(target.join(few_or_many(state.select(*PAIR, "radius"), pairs), PAIR), "targets")
    mine = ["grey"] if "grey" in source.columns else []
    source = stored(source.select(*PAIR, "point_id", "x", "y", "z", *mine), "sources")
    colored = F.col("colored") if mine else False
    while not (active := state.where("going")).isEmpty():
        x, y, z = moved(F.col("T"), F.col("x"), F.col("y"), F.col("z"))
        moved_on = source.join(few_or_many(active.select(*PAIR, "T", "radius", "colored"), pairs), PAIR).withColumns({"x": x, "y": y, "z": z}).drop("T")
        sums = icp_normal_eq(nn_correspondence(moved_on, around, F.col("radius"), PAIR), colored).withColumnRenamed("rmse", "error")
        state = stored(_steps(active.join(few_or_many(sums, pairs), PAIR, "left"), max_iter).unionByName(state.where("not going")), "icp")
    return state.select(*PAIR, "T", "fitness", "rmse", "iterations", "colored")


def _icp(pairs: DataFrame, source: DataFrame, target: DataFrame, voxel: float, max_iter: int, init: DataFrame | None, colored: bool) -> DataFrame:
    start = pairs.select(*PAIR)
    start = start.join(many(init.select(*PAIR, "T")), PAIR, "left") if init is not None else start.withColumn("T", identity())
    return run_icp(start.withColumns({"radius": F.lit(2.0 * voxel), "colored": F.lit(colored)}), source, target, max_iter).drop("colored")


def icp_point_to_plane(pairs: DataFrame, points: DataFrame, voxel: float = 0.005, max_iter: int = 50, init: DataFrame | None = None) -> DataFrame:
    """``T, fitness, rmse, iterations`` of every pair; an empty cloud on either side gives identity, 0 and 0.

    A pair stops at ``max_iter`` or when fitness and rmse change by less than 1e-6.
    """
    source, target = pair_clouds(pairs, stored(estimate_normals(points, 2 * voxel), "normals"))
    return _icp(pairs, source, target, voxel, max_iter, init, False)


def icp_colored(
    pairs: DataFrame, points: DataFrame, voxel: float = 0.005, max_iter: int = 50, init: DataFrame | None = None, fallback_on_zero: bool = True
) -> DataFrame:
    """Coloured ICP; pairs that end with fitness 0 are run again point to plane, unless it is the older variant."""
    grey = points.withColumn("grey", (F.col("r") + F.col("g") + F.col("b")) / 3)
    # stored in between, as the gradients' rounds of neighbours would find the normals anew each time
    ready = stored(color_gradient(stored(estimate_normals(grey, 2 * voxel), "normals"), 2 * voxel), "gradients")
    source, target = pair_clouds(pairs, ready)
    out = _icp(pairs, source, target, voxel, max_iter, init, True).withColumn("fell_back", F.lit(False))
    if not fallback_on_zero:
        return out
    failed = out.where("fitness = 0").select(*PAIR)
    again = _icp(failed, source, target, voxel, max_iter, init, False).withColumn("fell_back", F.lit(True))
    return out.where("fitness != 0").unionByName(again)


def icp_colored_v1(pairs: DataFrame, points: DataFrame, voxel: float = 0.005, max_iter: int = 50) -> DataFrame:
    """The older variant: no start transform and no fallback at fitness 0."""
    return icp_colored(pairs, points, voxel, max_iter, None, False)


def pair_features(near: DataFrame) -> DataFrame:
    """``theta, alpha, phi`` of each point and neighbour (o_*) with normals: the three angles of a Darboux frame.

    The frame stands at whichever of the two has the smaller angle between its normal and the line that joins them; at the
    other one the line is turned round. Pairs whose normal lies along the line have no frame and are left out.
    """
    line = [(F.col(f"o_{c}") - F.col(c)) / F.sqrt("d2") for c in "xyz"]
    rows = near.withColumns(dict(zip(("ex", "ey", "ez"), line)))
    e = [F.col(f"e{c}") for c in "xyz"]
    mine, theirs = [F.col(f"n{c}") for c in "xyz"], [F.col(f"o_n{c}") for c in "xyz"]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    rows = rows.withColumns({"at_me": dot(mine, e), "at_other": dot(theirs, e)})
    swap = F.abs("at_me") < F.abs("at_other")  # the smaller angle has the larger cosine
    pick = lambda a, b: [F.when(F.col("swap"), q).otherwise(p) for p, q in zip(a, b)]
    rows = rows.withColumn("swap", swap).withColumns(dict(zip(("ux", "uy", "uz"), pick(mine, theirs))) | dict(zip(("mx", "my", "mz"), pick(theirs, mine))))
    rows = rows.withColumns({f"e{c}": F.when(F.col("swap"), -F.col(f"e{c}")).otherwise(F.col(f"e{c}")) for c in "xyz"} | {"phi": F.when(F.col("swap"), -F.col("at_other")).otherwise(F.col("at_me"))})
    u, m, e = [F.col(f"u{c}") for c in "xyz"], [F.col(f"m{c}") for c in "xyz"], [F.col(f"e{c}") for c in "xyz"]
    rows = rows.withColumns(dict(zip(("vx", "vy", "vz"), cross(e, u))))
    v = [F.col(f"v{c}") for c in "xyz"]
    length = F.sqrt(dot(v, v))
    rows = rows.withColumns({"theta": F.atan2(dot(cross(u, v), m), length * dot(u, m)), "alpha": dot(v, m) / F.nullif(length, F.lit(0.0))})
    # stored, as a condition on what is computed would be put in front of it, written out in full
    return stored(rows.select(*POINT, "o_point_id", "theta", "alpha", "phi"), "angles").where("alpha is not null")


def point_bins(near: DataFrame) -> DataFrame:
    """(point, bin, part): the simplified histogram of each point, eleven bins for each angle that add up to 100."""
    place = lambda x: F.greatest(F.lit(0), F.least(F.lit(10), F.floor(F.round(11 * x, 9)))).cast("int")
    bins = F.array(place((F.col("theta") + np.pi) / (2 * np.pi)), 11 + place((F.col("alpha") + 1) / 2), 22 + place((F.col("phi") + 1) / 2))
    rows = pair_features(near).withColumn("bins", bins)
    total = rows.groupBy(*POINT).agg(F.count("*").alias("total"))
    counts = rows.select(*POINT, F.explode("bins").alias("bin")).groupBy(*POINT, "bin").agg(F.count("*").alias("c"))
    return counts.join(many(total), POINT).select(*POINT, "bin", (100 * F.col("c") / F.col("total")).alias("part"))


def fpfh(points: DataFrame, voxel: float, max_nn: int = 100) -> DataFrame:
    """``hist``: 33 bins of fast point feature histograms, of up to ``max_nn`` neighbours within 5 voxels; points need normals.

    A point's own histogram, plus those of its neighbours weighted by one over the squared distance, the sum of these
    scaled to 100 for each angle. A point without a neighbour has no row.
    """
    near = stored(knn_hybrid(points, 5 * voxel, max_nn).where(F.col("d2") > 0), "near")
    own = stored(point_bins(near), "spfh")
    theirs = own.select("sequence_id", "frame_index", F.col("point_id").alias("o_point_id"), "bin", "part")
    weighted = near.select(*POINT, "o_point_id", (1 / F.col("d2")).alias("w")).join(many(theirs), ["sequence_id", "frame_index", "o_point_id"])
    mixed = weighted.groupBy(*POINT, "bin").agg(F.sum(F.col("w") * F.col("part")).alias("mix")).withColumn("angle", F.expr("bin div 11"))
    sums = mixed.groupBy(*POINT, "angle").agg(F.sum("mix").alias("all"))
    mixed = mixed.join(many(sums), [*POINT, "angle"]).select(*POINT, "bin", (100 * F.col("mix") / F.col("all")).alias("part"))
    both = own.unionByName(mixed).groupBy(*POINT, "bin").agg(F.sum("part").alias("part"))
    spread = both.groupBy(*POINT).agg(F.map_from_entries(F.collect_list(F.struct("bin", "part"))).alias("m"))
    hist = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return spread.withColumn("m", F.col("m").cast("map<int,double>")).select(*POINT, hist.alias("hist"))


CLOUD = ["sequence_id", "frame_index"]


def feature_blocks(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features with ``block``, blocks with ``pivot, center, reach, parts``): descriptors near one pivot are in one block.

    A cloud has PIVOTS pivots for some BLOCK descriptors, each the first of a hash part, and a descriptor goes to the nearest.
    A group of descriptors that has no pivot makes a wide block that meets many, so there are more pivots than needed for size.
    A pivot with more than BLOCK descriptors, as where many are alike, has several blocks of the same centre and reach.
    """
    sizes = features.groupBy(*CLOUD).agg(F.ceil(PIVOTS * F.count("*") / BLOCK).cast("int").alias("n"))
    keyed = features.select(*CLOUD, "point_id", "hist").join(sizes, CLOUD).withColumn("part", F.pmod(F.xxhash64("point_id"), F.col("n")).cast("int"))
    keyed = stored(keyed, "features")
    pivots = stored(keyed.groupBy(*CLOUD, "part").agg(F.first("n").alias("n"), F.min_by("hist", "point_id").alias("center")).withColumnRenamed("part", "pivot"), "pivots")
    schema = T.StructType([*[keyed.schema[c] for c in (*CLOUD, "point_id", "hist")], T.StructField("pivot", T.IntegerType()), T.StructField("away", T.DoubleType())])

    def assign(points: pd.DataFrame, centers: pd.DataFrame) -> pd.DataFrame:
        if points.empty or centers.empty:
            return pd.DataFrame(columns=schema.names, dtype=object)
        x, p = np.stack(points["hist"]), np.stack(centers["center"])
        nearest = ((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T).argmin(1)
        away = np.sqrt(((x - p[nearest]) ** 2).sum(1))
        return points[[*CLOUD, "point_id", "hist"]].assign(pivot=centers["pivot"].to_numpy()[nearest], away=away)

    spread = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    near = stored(keyed.groupBy(*CLOUD, "part").cogroup(spread.groupBy(*CLOUD, "part")).applyInPandas(assign, schema), "near-pivots")
    shares = near.groupBy(*CLOUD, "pivot").agg(F.max("away").alias("reach"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    blocks = stored(pivots.drop("n").join(shares, [*CLOUD, "pivot"]), "blocks")
    part = F.pmod(F.xxhash64("point_id", F.lit(1)), F.col("parts"))
    return near.join(blocks.select(*CLOUD, "pivot", "parts"), [*CLOUD, "pivot"]).select(*CLOUD, "point_id", "hist", "pivot", part.cast("int").alias("part")), blocks


def pivot_pairs(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(pair, source, target, source_parts, target_parts): the pivots of a pair's clouds that may hold nearest descriptors of each other.

    Descriptors of two pivots are at least as far apart as the centres less both reaches, and each is at most as far from
    a centre of the other cloud as its own centre is, plus its reach. Two pivots meet unless the former is more than the
    least of the latter, for both sides.
    """

    def side(name: str) -> DataFrame:
        return blocks.select("sequence_id", F.col("frame_index").alias(f"{name}_frame"), *[F.col(c).alias(a) for c, a in (("pivot", name), ("center", f"{name}_center"), ("reach", f"{name}_reach"), ("parts", f"{name}_parts"))])

    met = pairs.select(*PAIR).distinct().join(side("source"), PAIR[:2]).join(side("target"), [PAIR[0], PAIR[2]])
    square = F.zip_with("source_center", "target_center", lambda a, b: (a - b) * (a - b))
    gap = F.sqrt(F.aggregate(square, F.lit(0.0), lambda a, x: a + x))
    met = met.withColumn("gap", gap).drop("source_center", "target_center")
    met = met.withColumn("least", F.col("gap") - F.col("source_reach") - F.col("target_reach"))
    for name in ("source", "target"):
        met = met.withColumn(f"{name}_most", F.min(F.col("gap") + F.col(f"{name}_reach")).over(W.partitionBy(*PAIR, name)))
    # with some room for rounding
    most = F.greatest("source_most", "target_most") * (1 + 1e-9) + 1e-3
    return met.where(F.col("least") <= most).select(*PAIR, "source", "target", "source_parts", "target_parts")


def feature_match(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Mutual nearest neighbours between the descriptors of a pair's clouds: (pair, source_id, target_id).

    Each cloud is dealt into blocks of some BLOCK descriptors around pivots, and each source block meets, in a task of its
    own, those target blocks that by the triangle inequality may hold a nearest descriptor of one of its own, or have
    one in it. That gives the nearest of every descriptor in the block; the nearest of all blocks is exact. Distances count
    to six places, and of equally near points the one with the least id is taken.
    """
    keyed, blocks = feature_blocks(features)
    met = stored(pivot_pairs(pairs, blocks), "met")
    met = met.withColumn("source_part", F.explode(F.sequence(F.lit(0), F.col("source_parts") - 1))).withColumn("target_part", F.explode(F.sequence(F.lit(0), F.col("target_parts") - 1)))

    def side(name: str) -> DataFrame:
        mine = keyed.select("sequence_id", F.col("frame_index").alias(f"{name}_frame"), F.col("pivot").alias(name), F.col("part").alias(f"{name}_part"), F.col("point_id").alias(f"{name}_id"), "hist")
        return met.drop("source_parts", "target_parts").join(mine, ["sequence_id", f"{name}_frame", name, f"{name}_part"])

    id_type = features.schema["point_id"].dataType
    schema = T.StructType([pairs.schema[k] for k in PAIR] + [T.StructField("source_id", id_type), T.StructField("target_id", id_type), T.StructField("d", T.DoubleType()), T.StructField("forth", T.BooleanType())])

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({k: [] for k in schema.names})
        a, b = a.sort_values("source_id"), b.sort_values("target_id")
        x, y = np.stack(a["hist"]), np.stack(b["hist"])
        d = np.round(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0), 6)
        ids, others = a["source_id"].to_numpy(), b["target_id"].to_numpy()
        to, back = d.argmin(1), d.argmin(0)
        out = pd.DataFrame({
            "source_id": np.concatenate([ids, ids[back]]), "target_id": np.concatenate([others[to], others]),
            "d": np.concatenate([d.min(1), d.min(0)]), "forth": np.arange(len(ids) + len(others)) < len(ids),
        })
        return out.assign(**{k: a[k].iloc[0] for k in PAIR})[schema.names]

    key = [*PAIR, "source", "target", "source_part", "target_part"]
    other = side("target").select(*[F.col(c).alias(f"o_{c}") for c in key], "target_id", F.col("hist").alias("hist"))
    found = side("source").groupBy(*key).cogroup(other.groupBy(*[f"o_{c}" for c in key])).applyInPandas(nearest, schema)
    found = stored(found, "nearest")
    forth = found.where("forth").groupBy(*PAIR, "source_id").agg(F.min(F.struct("d", "target_id")).alias("m")).select(*PAIR, "source_id", "m.target_id")
    back = found.where("not forth").groupBy(*PAIR, "target_id").agg(F.min(F.struct("d", "source_id")).alias("m")).select(*PAIR, "m.source_id", "target_id")
    return forth.join(many(back), [*PAIR, "source_id", "target_id"])


def _poses_of_three(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and shifts that move each triple of points (n, 3, 3) of ``s`` onto that of ``t`` best."""
    ms, mt = s.mean(1), t.mean(1)
    u, _, v = np.linalg.svd(np.einsum("nki,nkj->nij", s - ms[:, None], t - mt[:, None]))
    v, u = v.transpose(0, 2, 1).copy(), u.transpose(0, 2, 1)
    v[:, :, 2] *= np.where(np.linalg.det(v @ u) < 0, -1.0, 1.0)[:, None]
    r = v @ u
    return r, mt - np.einsum("nij,nj->ni", r, ms)


def recover_feature_init(
    matches: DataFrame, points: DataFrame, voxel: float, hypotheses: int = 100_000, confidence: float = 0.999, seed: int = 7
) -> DataFrame:
    """``T, inliers`` of each pair by sampled three-point hypotheses over its feature matches.

    Of hypotheses whose edge lengths agree (0.9), the one with the most matches within 1.5 voxels is kept. Drawing ends at
    ``hypotheses``, or once the share of inliers makes it likely by ``confidence`` that three of them were drawn. A pair's
    hypotheses are drawn in PARTS tasks, each with its matches, of which there are at most as many as points in a cloud; a
    pair of up to FEW matches is one task that draws for all parts, and ends each once every three matches were tried.
    A pair of fewer than three matches, or without a pose, has no row.
    """
    at = lambda c, i, p: points.select("sequence_id", F.col("frame_index").alias(c), F.col("point_id").alias(i), F.array("x", "y", "z").alias(p))
    placed = matches.join(many(at("source_frame", "source_id", "ps")), ["sequence_id", "source_frame", "source_id"])
    placed = placed.join(many(at("target_frame", "target_id", "pt")), ["sequence_id", "target_frame", "target_id"])
    schema = T.StructType([matches.schema[k] for k in PAIR] + [T.StructField("part", T.IntegerType()), T.StructField("T", T.ArrayType(T.DoubleType())), T.StructField("inliers", T.LongType())])

    def drawn_part(s: np.ndarray, t: np.ndarray, part: int, key: int) -> tuple[int, np.ndarray | None]:
        draw, n = np.random.default_rng([seed, part, key]), len(s)
        most, best, drawn, limit = 0, None, 0, -(-hypotheses // PARTS)
        triples = n * (n - 1) * (n - 2) // 6
        seen = np.zeros(triples and n**3, bool) if n <= FEW else None
        tried = 0
        while n >= 3 and drawn < limit:
            k = draw.integers(0, n, (min(1000, limit - drawn), 3))
            drawn += len(k)
            k = k[(k[:, 0] != k[:, 1]) & (k[:, 0] != k[:, 2]) & (k[:, 1] != k[:, 2])]
            if seen is not None:
                # of few matches the same three are drawn again and again; their pose is the same
                own = np.sort(k, 1) @ np.array([n * n, n, 1])
                first = np.sort(np.unique(own, return_index=True)[1])
                first = first[~seen[own[first]]]
                seen[own[first]] = True
                k, tried = k[first], tried + len(first)
            es, et = (np.linalg.norm(p[k] - np.roll(p[k], 1, 1), axis=2) for p in (s, t))
            k = k[(np.minimum(es, et) >= 0.9 * np.maximum(es, et)).all(1)]
            step = max(1, (1 << 20) // n)
            for some in (k[i : i + step] for i in range(0, len(k), step)):
                r, shift = _poses_of_three(s[some], t[some])
                near = ((np.einsum("hij,nj->hni", r, s) + shift[:, None] - t) ** 2).sum(2) <= (1.5 * voxel) ** 2
                count = near.sum(1)
                if count.max() > most:
                    most, i = int(count.max()), int(count.argmax())
                    best = np.vstack([np.column_stack([r[i], shift[i]]), [0, 0, 0, 1]]).reshape(-1)
            miss = 1 - (most / n) ** 3
            if miss <= 0 or miss ** (drawn * PARTS) <= 1 - confidence or (seen is not None and tried == triples):
                break
        return most, best

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source_id", "target_id"])
        first = rows.iloc[0]
        s, t = np.stack(rows["ps"]), np.stack(rows["pt"])
        key = zlib.crc32(str([first[k] for k in PAIR]).encode())
        parts = [int(first["part"])] if first["part"] >= 0 else range(PARTS)
        # of equally good parts the first counts, as it does between groups
        most, part, best = max(((m, -p, b) for p in parts for m, b in [drawn_part(s, t, p, key)]), key=lambda x: x[:2])
        out = rows.iloc[: 1 if most else 0][[*PAIR, "part"]]
        return out.assign(part=-part, T=pd.Series([best][: len(out)], out.index, object), inliers=most)

    sizes = matches.groupBy(*PAIR).agg(F.count("*").alias("n"))
    # a pair of few matches is one group that draws for all parts
    tasks = F.when(F.col("n") > FEW, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(-1)))
    parts = placed.join(many(sizes), PAIR).withColumn("part", F.explode(tasks)).drop("n")
    found = parts.groupBy(*PAIR, "part").applyInPandas(search, schema)
    best = found.groupBy(*PAIR).agg(F.max_by(F.struct("T", "inliers"), F.struct("inliers", -F.col("part"))).alias("b"))
    return best.select(*PAIR, "b.T", "b.inliers")
