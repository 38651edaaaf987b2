"""Kernels run group by group: one group is one snapshot, series or parameter setting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as N


def tomography(hop_rows: DataFrame, link_shares: DataFrame, prior: DataFrame, by: str, weight: float = 0.01) -> DataFrame:
    """by, route_id, share: traffic of each route from the links' shares.

    hop_rows: by, route_id, u, v; link_shares: by, u, v, share; prior: by, route_id, share.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        routes = sorted(right["route_id"])
        links = sorted(set(zip(left["u"], left["v"])))
        if not routes or not links:
            return pd.DataFrame({by: [], "route_id": [], "share": []})
        r, k = {x: i for i, x in enumerate(routes)}, {x: i for i, x in enumerate(links)}
        a, y = np.zeros((len(links), len(routes))), np.zeros(len(links))
        for route, u, v, share in zip(left["route_id"], left["u"], left["v"], left["share"]):
            y[k[u, v]] = share
            if route in r:
                a[k[u, v], r[route]] = 1
        x = N.traffic_from_links(a, y, right.set_index("route_id")["share"].reindex(routes).to_numpy(), weight)
        return pd.DataFrame({by: key[0], "route_id": routes, "share": x})

    rows = hop_rows.join(link_shares, [by, "u", "v"]).select(by, F.col("route_id").alias("route_id"), "u", "v", "share")
    kind = dict(prior.dtypes)
    fresh = prior.select(*[F.col(c).alias(c) for c in (by, "route_id", "share")])
    return rows.groupBy(F.col(by)).cogroup(fresh.groupBy(F.col(by))).applyInPandas(run, f"{by} {kind[by]}, route_id {kind['route_id']}, share double")


def completed(cells: DataFrame, by: str) -> DataFrame:
    """by, s, t, volume: each snapshot's matrix without holes; cells: by, s, t, volume (null: missing)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.groupby(["s", "t"])["volume"].sum(min_count=1).unstack().sort_index().sort_index(axis=1)
        out = pd.DataFrame(N.complete_matrix(wide.to_numpy(dtype=float)), index=wide.index, columns=wide.columns).stack().rename("volume").reset_index()
        out.insert(0, by, pdf[by].iloc[0])
        return out

    kind = dict(cells.dtypes)
    return cells.groupBy(by).applyInPandas(run, f"{by} {kind[by]}, s {kind['s']}, t {kind['t']}, volume double")


def segment_means(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """key, at, value, level: each run between gaps as segments of one level; missing values stay missing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        z = pdf[value].to_numpy(dtype=float)
        ok = np.isfinite(z)
        level = np.full(len(z), np.nan)
        cuts = np.flatnonzero(np.concatenate([[True], ok[1:] != ok[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(z)]):
            if ok[a]:
                level[a:b] = N.segment_means(z[a:b])
        return pdf.assign(level=level)[[key, at, value, "level"]]

    kind = dict(rows.dtypes)
    return rows.select(key, at, value).groupBy(key).applyInPandas(run, f"{key} {kind[key]}, {at} {kind[at]}, {value} double, level double").withColumn("level", F.nanvl("level", F.lit(None).cast("double"))).withColumn(value, F.nanvl(value, F.lit(None).cast("double")))


def hulls(points: DataFrame, by: str) -> DataFrame:
    """by, pos, id: corners of each group's convex hull, counter-clockwise."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        ids = N.convex_hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({by: pdf[by].iloc[0], "pos": range(len(ids)), "id": pdf["id"].iloc[ids].to_numpy()})

    kind = dict(points.dtypes)
    return points.select(by, "id", "x", "y").groupBy(by).applyInPandas(run, f"{by} {kind[by]}, pos int, id {kind['id']}")


def heat(meshes: DataFrame, by: str, side: int, source: int) -> DataFrame:
    """by, vid, distance: geodesic distances from one vertex of each surface.  meshes: by, vid, x, y, z."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vid")
        d = N.heat_distances(pdf[["x", "y", "z"]].to_numpy(), N.grid_faces(side), source)
        return pd.DataFrame({by: pdf[by].to_numpy(), "vid": pdf["vid"].to_numpy(), "distance": d})

    kind = dict(meshes.dtypes)
    return meshes.select(by, "vid", "x", "y", "z").groupBy(by).applyInPandas(run, f"{by} {kind[by]}, vid long, distance double")


def inferred_routes(edges: DataFrame, rtts: DataFrame, by: str, rounds: int = 6) -> DataFrame:
    """by, s, t, route, fitted, r2.  edges: by, a, b, gcl_us; rtts: by, s, t, rtt_us."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(left["a"]) | set(left["b"]))
        place = {x: k for k, x in enumerate(names)}
        left = left.sort_values(["a", "b"])
        pairs = [(place[a], place[b]) for a, b in zip(left["a"], left["b"])]
        wanted = {(place[s], place[t]): float(r) for s, t, r in zip(right["s"], right["t"], right["rtt_us"]) if s in place and t in place}
        routes, latency, r2 = N.infer_routes(len(names), pairs, left["gcl_us"].to_numpy(dtype=float), wanted, rounds)
        cost = {p: x for p, x in zip(pairs, latency)} | {(b, a): x for (a, b), x in zip(pairs, latency)}
        rows = [(key[0], names[s], names[t], [int(names[x]) for x in route], sum(cost[p] for p in zip(route, route[1:])), r2) for (s, t), route in sorted(routes.items())]
        return pd.DataFrame(rows, columns=[by, "s", "t", "route", "fitted", "r2"])

    kind = dict(edges.dtypes)
    return edges.groupBy(by).cogroup(rtts.groupBy(by)).applyInPandas(run, f"{by} {kind[by]}, s {kind['a']}, t {kind['a']}, route array<long>, fitted double, r2 double")


def commute(edges: DataFrame, by: str) -> DataFrame:
    """by, s, t, steps: commute times of all connected pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["a"]) | set(pdf["b"]))
        place = {x: k for k, x in enumerate(names)}
        d = N.commute_distances(len(names), [(place[a], place[b]) for a, b in zip(pdf["a"], pdf["b"])])
        rows = [(pdf[by].iloc[0], names[i], names[j], d[i, j]) for i in range(len(names)) for j in range(len(names)) if np.isfinite(d[i, j])]
        return pd.DataFrame(rows, columns=[by, "s", "t", "steps"])

    kind = dict(edges.dtypes)
    return edges.select(by, "a", "b").groupBy(by).applyInPandas(run, f"{by} {kind[by]}, s {kind['a']}, t {kind['a']}, steps double")
