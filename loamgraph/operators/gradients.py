"""Gradients of the losses by the heights of a mesh: adjoints that go back over half-edges to vertices, one aggregation a loss.

Meshes of several runs go side by side: `by` names the columns that tell them apart.  Faces are the same for all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage


def _norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def halfedges(faces: DataFrame, vertices: DataFrame, by: list[str]) -> DataFrame:
    """by, fid, and for each half-edge its origin o, destination d and opposite corner p with coordinates and border flags; normal, area, and the cotangent at p.

    faces: fid, u, v, w; vertices: by, vid, x, y, z, border.
    """
    corner = lambda c, n: vertices.select(*by, F.col("vid").alias(c), *[F.col(k).alias(f"{n}{k}") for k in "xyz"], F.col("border").alias(f"{n}b"))
    turned = faces.select("fid", F.explode(F.array(*[F.struct(F.col(a).alias("o"), F.col(b).alias("d"), F.col(c).alias("p")) for a, b, c in ("uvw", "vwu", "wuv")])).alias("h")).select("fid", "h.*")
    out = turned.join(corner("o", "o"), "o").join(corner("d", "d"), [*by, "d"]).join(corner("p", "p"), [*by, "p"])
    a, b = ([F.col(f"{n}{k}") - F.col(f"p{k}") for k in "xyz"] for n in "od")
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    out = out.withColumns({f"n{k}": c for k, c in zip("xyz", n)})
    out = out.withColumn("area", _norm(*[F.col(f"n{k}") for k in "xyz"]) / 2)
    return out.withColumn("cot", (a[0] * b[0] + a[1] * b[1] + a[2] * b[2]) / (2 * F.col("area")))


def curvatures(half: DataFrame, by: list[str]) -> DataFrame:
    """by, vid, border, area, kappa, mean, first, second, and the direction (tx, ty, tz) in which the mean curvature normal grows it."""
    side = lambda end, other: F.struct(F.col(end).alias("vid"), F.col(f"{end}b").alias("border"), F.lit(0.0).alias("angle"), F.lit(0.0).alias("own"), *[F.lit(0.0).alias(f"n{k}") for k in "xyz"], *[(F.col("cot") / 2 * (F.col(f"{end}{k}") - F.col(f"{other}{k}"))).alias(f"m{k}") for k in "xyz"])
    corner = F.struct(F.col("p").alias("vid"), F.col("pb").alias("border"), F.acos(F.col("cot") / F.sqrt(1 + F.col("cot") * F.col("cot"))).alias("angle"), F.col("area").alias("own"), *[F.col(f"n{k}").alias(f"n{k}") for k in "xyz"], *[F.lit(0.0).alias(f"m{k}") for k in "xyz"])
    rows = half.select(*by, F.explode(F.array(corner, side("o", "d"), side("d", "o"))).alias("r")).select(*by, "r.*")
    v = rows.groupBy(*by, "vid", "border").agg(F.sum("angle").alias("angles"), (F.sum("own") / 3).alias("area"), *[F.sum(f"{c}{k}").alias(f"{c}{k}") for c in "nm" for k in "xyz"])
    m = [F.col(f"m{k}") for k in "xyz"]
    facing = F.signum(sum((F.col(f"m{k}") * F.col(f"n{k}") for k in "yz"), F.col("mx") * F.col("nx")))
    inner = ~F.col("border")
    v = v.withColumn("kappa", F.when(inner, (F.lit(2 * math.pi) - F.col("angles")) / F.col("area")).otherwise(0.0)).withColumn("mean", F.when(inner, _norm(*m) / (2 * F.col("area")) * facing).otherwise(0.0))
    v = v.withColumns({f"t{k}": F.when(inner & (_norm(*m) > 0), facing * F.col(f"m{k}") / _norm(*m) / (2 * F.col("area"))).otherwise(0.0) for k in "xyz"})
    off = F.sqrt(F.greatest(F.lit(0.0), F.col("mean") * F.col("mean") - F.col("kappa")))
    return v.select(*by, "vid", "border", "area", "kappa", "mean", (F.col("mean") + off).alias("first"), (F.col("mean") - off).alias("second"), "tx", "ty", "tz")


def pulled_back(half: DataFrame, state: DataFrame, by: list[str], on_vertices: DataFrame, on_edges: DataFrame | None = None, on_area: DataFrame | None = None) -> DataFrame:
    """by, vid, slope: the derivative by each height of what depends on curvatures, edge weights and the whole area.

    on_vertices: by, vid, on_kappa, on_mean (derivatives by Gaussian and mean curvature); on_edges: by, a, b, on_weight (by half the
    sum of an edge's cotangents); on_area: by, on_area.  What isn't there counts 0.
    """
    v = state.join(on_vertices, [*by, "vid"], "left")
    k, m = F.coalesce("on_kappa", F.lit(0.0)), F.coalesce("on_mean", F.lit(0.0))
    inner = ~F.col("border")
    # Of a corner: by each angle there, by a third of each face there, and by the mean curvature normal.
    v = v.select(*by, "vid", F.when(inner, -k / F.col("area")).otherwise(0.0).alias("angle"), F.when(inner, -(k * F.col("kappa") + m * F.col("mean")) / (3 * F.col("area"))).otherwise(0.0).alias("third"), *[(m * F.col(f"t{c}")).alias(f"q{c}") for c in "xyz"])
    rows = half
    for n in "odp":
        rows = rows.join(v.select(*by, F.col("vid").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("angle", "third", "qx", "qy", "qz")]), [*by, n])
    rows = rows.withColumns({"low": F.least("o", "d"), "high": F.greatest("o", "d")})
    if on_edges is not None:
        rows = rows.join(on_edges.select(*by, F.col("a").alias("low"), F.col("b").alias("high"), "on_weight"), [*by, "low", "high"], "left")
    if on_area is not None:
        rows = rows.join(on_area, by) if by else rows.crossJoin(F.broadcast(on_area))
    weight = F.coalesce("on_weight", F.lit(0.0)) if on_edges is not None else F.lit(0.0)
    apart = {c: F.col(f"o{c}") - F.col(f"d{c}") for c in "xyz"}
    pull = {c: F.col(f"o_q{c}") - F.col(f"d_q{c}") for c in "xyz"}
    by_cot = -F.col("p_angle") / (1 + F.col("cot") * F.col("cot")) + weight / 2 + (pull["x"] * apart["x"] + pull["y"] * apart["y"] + pull["z"] * apart["z"]) / 2
    # Each face has three half-edges, so each has a third of what goes by the face's area.
    by_area = (F.col("o_third") + F.col("d_third") + F.col("p_third") + (F.col("on_area") if on_area is not None else F.lit(0.0))) / 3
    lift = F.col("cot") / 2 * pull["z"]
    far = {"o": ("d", "p"), "d": ("p", "o"), "p": ("o", "d")}
    area_slope = {n: (F.col("ny") * (F.col(f"{a}x") - F.col(f"{b}x")) - F.col("nx") * (F.col(f"{a}y") - F.col(f"{b}y"))) / (4 * F.col("area")) for n, (a, b) in far.items()}
    top = {"o": F.col("dz") - F.col("pz"), "d": F.col("oz") - F.col("pz"), "p": 2 * F.col("pz") - F.col("oz") - F.col("dz")}
    own = {"o": lift, "d": -lift, "p": F.lit(0.0)}
    slope = {n: by_cot * (top[n] - 2 * F.col("cot") * area_slope[n]) / (2 * F.col("area")) + by_area * area_slope[n] + own[n] for n in "odp"}
    return rows.select(*by, F.explode(F.array(*[F.struct(F.col(n).alias("vid"), slope[n].alias("slope")) for n in "odp"])).alias("g")).select(*by, "g.*").groupBy(*by, "vid").agg(F.sum("slope").alias("slope"))


def curvature_loss(state: DataFrame, fat: DataFrame, targets: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, loss) and (by, vid, on_kappa): over segments, weighted by length, the mean squared difference of their vertices' curvature to the target.

    fat: vid, sid; targets: sid, target, length; segments without a target or vertices add nothing but their length.
    """
    whole = targets.agg(F.sum("length").alias("whole"))
    size = fat.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    share = fat.join(size, "sid").join(targets.where("target is not null"), "sid").crossJoin(F.broadcast(whole)).select("vid", "target", (F.col("length") / F.col("whole") / F.col("n")).alias("share"))
    met = state.select(*by, "vid", "kappa").join(share, "vid")
    miss = F.col("kappa") - F.col("target")
    return met.groupBy(*by).agg(F.sum(F.col("share") * miss * miss).alias("loss")), met.groupBy(*by, "vid").agg(F.sum(2 * F.col("share") * miss).alias("on_kappa"))


def smooth_loss(half: DataFrame, state: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(by, loss), (by, vid, on_kappa, on_mean), (by, a, b, on_weight) and (by, on_area): the forms of both principal curvatures over edges inside, times the area."""
    area = half.groupBy(*by).agg((F.sum("area") / 3).alias("whole"))
    e = half.where(~(F.col("ob") | F.col("db"))).groupBy(*by, F.least("o", "d").alias("a"), F.greatest("o", "d").alias("b")).agg((F.sum("cot") / 2).alias("weight"))
    for n in "ab":
        e = e.join(state.select(*by, F.col("vid").alias(n), F.col("first").alias(f"f{n}"), F.col("second").alias(f"s{n}")), [*by, n])
    e = e.join(area, by) if by else e.crossJoin(F.broadcast(area))
    f, s = F.col("fa") - F.col("fb"), F.col("sa") - F.col("sb")
    loss = e.groupBy(*by, "whole").agg(F.sum(F.col("weight") * (f * f + s * s)).alias("form"))
    step = 2 * F.col("whole") * F.col("weight")
    ends = e.select(*by, F.explode(F.array(*[F.struct(F.col(n).alias("vid"), (sign * step * f).alias("g1"), (sign * step * s).alias("g2")) for n, sign in (("a", 1), ("b", -1))])).alias("g")).select(*by, "g.*")
    per = ends.groupBy(*by, "vid").agg(F.sum("g1").alias("g1"), F.sum("g2").alias("g2")).join(state.select(*by, "vid", "kappa", "mean"), [*by, "vid"])
    left = F.col("mean") * F.col("mean") - F.col("kappa")
    off = F.sqrt(F.greatest(left, F.lit(0.0)))
    tilt = F.when(left > 0, (F.col("g1") - F.col("g2")) / off).otherwise(0.0)
    on = per.select(*by, "vid", (-tilt / 2).alias("on_kappa"), (F.col("g1") + F.col("g2") + tilt * F.col("mean")).alias("on_mean"))
    return loss.select(*by, (F.col("form") * F.col("whole")).alias("loss")), on, e.select(*by, "a", "b", (F.col("whole") * (f * f + s * s)).alias("on_weight")), loss.select(*by, F.col("form").alias("on_area"))


def geodesic_loss(rows: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """The rows with `slope`, the derivative of the share of y that a line on x leaves unexplained by each x; 0 where x or y don't vary."""
    sums = rows.groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_c"), F.count(F.lit(1)).alias("_n"))
    joined = rows.join(sums, by) if by else rows.crossJoin(F.broadcast(sums))
    dx, dy, c = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my"), F.col("_c")
    slope = 2 * c / (F.col("_n") * F.col("_vx") * F.col("_vy")) * (c * dx / F.col("_vx") - dy)
    return joined.withColumn("slope", F.when((F.col("_vx") > 0) & (F.col("_vy") > 0), slope).otherwise(0.0)).select(*rows.columns, "slope")


def losses(faces: DataFrame, vertices: DataFrame, fat: DataFrame, targets: DataFrame, smooth: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, curvature, smoothness, loss) and (by, vid, slope) of curvature loss plus `smooth` (by, smooth) times smoothness loss."""
    half = stage(halfedges(faces, vertices, by))
    state = stage(curvatures(half, by))
    bent, on_kappa = curvature_loss(state, fat, targets, by)
    rough, on, on_edges, on_area = smooth_loss(half, state, by)
    scaled = lambda df, c: (df.join(smooth, by) if by else df.crossJoin(F.broadcast(smooth))).withColumns({k: F.col(k) * F.col("smooth") for k in c}).drop("smooth")
    both = on_kappa.withColumn("on_mean", F.lit(0.0)).unionByName(scaled(on, ["on_kappa", "on_mean"])).groupBy(*by, "vid").agg(F.sum("on_kappa").alias("on_kappa"), F.sum("on_mean").alias("on_mean"))
    slope = pulled_back(half, state, by, both, scaled(on_edges, ["on_weight"]), scaled(on_area, ["on_area"]))
    value = bent.withColumnRenamed("loss", "curvature").join(rough.withColumnRenamed("loss", "smoothness"), by) if by else bent.withColumnRenamed("loss", "curvature").crossJoin(rough.withColumnRenamed("loss", "smoothness"))
    value = value.join(smooth, by) if by else value.crossJoin(F.broadcast(smooth))
    return value.select(*by, "curvature", "smoothness", (F.col("curvature") + F.col("smooth") * F.col("smoothness")).alias("loss")), slope


def fit(faces: DataFrame, vertices: DataFrame, fat: DataFrame, targets: DataFrame, smooth: DataFrame, rounds: int, step: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(run, loss_before, loss_after, curvature, smoothness) and the vertices (run, vid, x, y, z, border) after so many rounds of descent, all runs at once.

    smooth: run, smooth.  Each run has its own step: the loss is taken at a step along the slope of all inner heights; if it falls, the step stands and the next is longer,
    else it is taken back and the next is shorter.  So no run's loss grows, and a round is one pass over all meshes.
    """
    by = ["run"]
    now = stage(vertices.select("run", "vid", "x", "y", "z", "border"))
    value, slope = losses(faces, now, fat, targets, smooth, by)
    first = stage(value.withColumn("step", F.lit(step)))
    state, slope = first, stage(slope)
    for _ in range(rounds):
        size = slope.join(now.where("not border").select("run", "vid"), ["run", "vid"]).groupBy("run").agg(F.sqrt(F.sum(F.col("slope") * F.col("slope"))).alias("size"))
        move = now.join(slope, ["run", "vid"], "left").join(size, "run").join(state.select("run", "step"), "run")
        down = F.when(F.col("border") | (F.col("size") == 0), 0.0).otherwise(F.coalesce("slope", F.lit(0.0)) * F.col("step") / F.col("size"))
        tried = stage(move.select("run", "vid", "x", "y", (F.col("z") - down).alias("z"), "border"))
        new_value, new_slope = losses(faces, tried, fat, targets, smooth, by)
        new_value = stage(new_value.select("run", *[F.col(c).alias(f"new_{c}") for c in ("curvature", "smoothness", "loss")]))
        better = F.col("new_loss") < F.col("loss")
        judged = state.join(new_value, "run")
        taken = stage(judged.select("run", better.alias("taken")))
        pick = lambda old, new: stage(old.join(taken.where("not taken"), "run").drop("taken").unionByName(new.join(taken.where("taken"), "run").drop("taken")))
        state = stage(judged.select("run", *[F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("curvature", "smoothness", "loss")], (F.col("step") * F.when(better, 1.5).otherwise(0.25)).alias("step")))
        now, slope = pick(now, tried), pick(slope, new_slope)
    return first.select("run", F.col("loss").alias("loss_before")).join(state.select("run", F.col("loss").alias("loss_after"), "curvature", "smoothness"), "run"), now
