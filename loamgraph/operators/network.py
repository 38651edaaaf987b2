"""From measured links to a graph with curvature, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage
from . import clusters as C
from . import edges as E
from . import paths as P
from . import transport as W
from . import triangles as T


def measured_graph(
    nodes: DataFrame,
    links: DataFrame,
    *,
    delays: DataFrame | None = None,
    remove_violations: bool = False,
    epsilon_us: int | None = None,
    cluster_radians: float | None = None,
    routes: DataFrame | None = None,
    curvature: bool = True,
    alpha: float = 0.0,
    weighted: bool = False,
    transport: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """(edges, mapping): a, b, rtt_us, throughput, gcl_us and curvature; mapping (id, rep) where nodes were clustered.

    nodes: id, lat, lon; links: source, target, rtt_us, throughput, gcl_us.  In this order: links without loops and with known ends, one
    edge a pair; with `delays` (like links) these give the edges and the links only throughput; the longest sides of triangles that
    break the triangle inequality go; edges more than `epsilon_us` above their bound go; nodes closer than `cluster_radians`
    become one.  Curvature is that of the traffic if `routes` (route_id, route, volume) are given, moved to the clusters
    before, and the mean of both directions; pairs that no route passes have null; with `transport` it is that of the least cost between the routes' places.  Else it is Ollivier and Ricci's.
    """
    known = lambda rows: E.known_ends(E.drop_self_loops(rows), nodes)
    edges = E.dedupe_edges(known(links))
    if delays is not None:
        own = E.dedupe_edges(known(delays.withColumn("throughput", F.lit(0).cast("long")))).drop("throughput")
        edges = own.join(edges.select("a", "b", "throughput"), ["a", "b"], "left").select("a", "b", "rtt_us", "throughput", "gcl_us")
    edges = stage(edges)
    if remove_violations:
        edges = T.remove_violations(edges)
    if epsilon_us is not None:
        edges = E.threshold(edges, epsilon_us)
    mapping = None
    if cluster_radians is not None:
        mapping = stage(C.representatives(nodes, C.single_linkage(nodes, cluster_radians)).select("id", "rep"))
        edges = C.contract_all(edges, mapping)
        if routes is not None:
            routes = C.relabel_routes(routes, mapping).join(routes.select("route_id", "volume"), "route_id")
        nodes = nodes.join(mapping.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    if not curvature:
        return edges, mapping
    edges = stage(edges)
    if routes is None:
        found = W.ricci(edges, alpha=alpha, weighted=weighted)
    else:
        adjacent = stage(P.adjacency(edges, "rtt_us"))
        distances = P.closure(adjacent, stage(nodes.select("id")))
        shortest = stage(P.routes(P.predecessors(distances, adjacent), nodes.select("id")))
        # A hop whose edge has gone takes the shortest way; routes that can't be mended go.
        whole = stage(P.fix_routes(routes.select("route_id", "route"), shortest).join(routes.select("route_id", "volume"), "route_id"))
        both = E.merge_curvatures((W.transport_curvature if transport else P.traffic_curvature)(adjacent.select("u", "v"), adjacent, distances, whole).withColumnsRenamed({"u": "source", "v": "target"}))
        found = both.select("a", "b", "curvature")
    return edges.join(found, ["a", "b"], "left"), mapping
