"""Loaders of trace tables on small files; the composed graph against its steps; smoothing against a plain fold."""

import gzip
import json
import math
import random

from pyspark.sql import functions as F

from loamgraph.operators import clusters as C
from loamgraph.operators import network as G
from loamgraph.operators import series as S
from loamgraph.operators import traces as R
from loamgraph.sources import metadata as D
from loamgraph.sources import network as N

from .test_sources import put


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_exchange_members(spark, tmp_path):
    path = put(tmp_path / "m.txt", "# head\n1.1.1.1\t10\tix-a\n1.1.1.2\tNone\tix-a\n9.9.9.9\t Telx Atlanta\tix\n1.1.1.1\t11\tix-b\n")
    assert rows(D.read_exchange_members(spark, path)) == [("1.1.1.1", 11, "ix-b"), ("1.1.1.2", -1, "ix-a")]
    assert rows(D.read_exchange_members(spark, path, "ix-a")) == [("1.1.1.1", 10, "ix-a"), ("1.1.1.2", -1, "ix-a")]


def test_relations(spark, tmp_path):
    assert rows(D.read_peers(spark, put(tmp_path / "p.txt", "# x\n1|2|0\n1|3|-1\n2|1|0\n"))) == [(1, 2), (2, 1)]
    cones, providers = D.read_customer_cones(spark, put(tmp_path / "c.json", json.dumps({"1": [2, 3], "2": [3], "4": []})))
    assert rows(cones) == [(1, 2), (1, 3), (2, 3)]
    assert rows(providers) == [(1, None), (2, 1), (3, 1), (3, 2), (4, None)]


def test_anchors_prefixes_organisations(spark, tmp_path):
    anchors = [{"id": 1, "address_v4": "1.2.3.4", "geometry": {"coordinates": [5.0, 6.0]}}, {"id": 2, "address_v4": "1.2.3.4", "geometry": {"coordinates": [7.0, 8.0]}}]
    assert rows(D.read_anchors(spark, put(tmp_path / "a.json", json.dumps(anchors, indent=1)))) == [(2, "1.2.3.4", 8.0, 7.0)]
    assert rows(D.read_prefix_owners(spark, put(tmp_path / "o.txt", "; head\n10.0.0.0/8\t7\n10.1.0.0/16\t8\n"))) == [("10.0.0.0/8", 7), ("10.1.0.0/16", 8)]
    with gzip.open(tmp_path / "t.gz", "wt") as f:
        f.write("one line that is left out\t\t\n10.0.0.0\t8\t7_9\n10.0.0.0\t8\t7\n")
    assert rows(D.read_prefix_table(spark, str(tmp_path / "t.gz"))) == [("10.0.0.0/8", "7")]
    lines = '{"asn": "5", "organization": {"orgName": "Five"}}\n{"asn": "6", "organization": {}}\n{"asn": "7", "organization": null}\n'
    assert rows(D.read_organisations(spark, put(tmp_path / "g.jsonl", lines))) == [(5, "Five"), (6, "6"), (7, "7")]


def test_place_votes(spark, tmp_path):
    head = "ip,city_code,city,state,country,iso2,iso3,lat,lon,score\n"
    line = '"{}/32","C","{}","S","Land","{}","LND","{}","2.0","{}"\n'.format
    put(tmp_path / "v" / "a.csv", head + line("1.1.1.1", "Paris", "FR", 1, 5) + line("2.2.2.2", "Rome", "IT", 1, "") + line("3.3.3.3", "Oslo", "NO", 1, 1))
    put(tmp_path / "v" / "b.csv", head + line("1.1.1.1", "Paris", "FR", 9, "") + line("2.2.2.2", "Milan", "IT", 1, 1) + '"4.4.4.4/32","C","WASHINGTON","D.C.","x","US","USA","1","2","3","4"\n')
    put(tmp_path / "v" / "c.csv", head + line("2.2.2.2", "Rome", "CH", 1, 1) + line("3.3.3.3", "", "SE", 1, 1))
    countries, places = D.read_place_votes(spark, str(tmp_path / "v"))
    assert rows(countries) == [("1.1.1.1/32", "FR"), ("2.2.2.2/32", "CH"), ("3.3.3.3/32", "SE")]
    # Two of three files agree on the first; the second's differ, and one of three is no majority.
    assert rows(places) == [("1.1.1.1", "Paris", 9.0, 2.0, 0.0)]


def test_link_exports(spark, tmp_path):
    put(tmp_path / "e" / "x.atla.net _ on ATLA-CHIC-data-1.csv", '﻿"time","Output [1h averages]"\n3600000,1.5\n3600999,2\n7200000,\n')
    put(tmp_path / "e" / "y.chic.net _ on ATLA-CHIC-data-2.csv", '﻿"time","Output [1h averages]"\n3600000,4\n')
    put(tmp_path / "e" / "z.chic.net _ on CHIC-CHIC-data-2.csv", '﻿"time","Output [1h averages]"\n3600000,4\n')
    assert rows(D.read_link_exports(spark, str(tmp_path / "e"))) == [("ATLA", "CHIC", 3600, 3.5), ("ATLA", "CHIC", 7200, 0.0), ("CHIC", "ATLA", 3600, 4.0)]


def test_owners(spark):
    addresses = spark.createDataFrame([(x,) for x in ("10.1.2.3", "10.9.9.9", "11.0.0.1", "192.168.255.1", "text", None)], "address string")
    prefixes = spark.createDataFrame([("10.0.0.0/8", 1), ("10.1.0.0/16", 2), ("10.1.2.0/24", 3), ("192.168.254.0/23", 4), ("0.0.0.0/0", 5)], "prefix string, asn long")
    assert rows(R.prefix_owner(addresses, prefixes)) == [("10.1.2.3", 3), ("10.9.9.9", 1), ("11.0.0.1", 5), ("192.168.255.1", 4)]
    assert R.prefix_owner(addresses, prefixes.limit(0)).count() == 0


def test_first_of_places(spark):
    rng = random.Random(4)
    seen, expected, given = set(), [], []
    for i in range(300):
        code, city = f"c{rng.randint(0, 90)}", rng.choice(["City", "CITY"]) + str(rng.randint(0, 90))
        given.append((i, code, city))
        if code not in seen and city.lower() not in seen:
            expected.append((i, code, city))
        seen |= {code, city.lower()}
    assert sorted(map(tuple, R.first_of_places(spark.createDataFrame(given, "i long, code string, city string"), "i", "code", "city").collect())) == expected


def test_measured_graph(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.5), (3, 0.0, 20.0), (4, 10.0, 20.0)], "id long, lat double, lon double")
    links = [(1, 2, 10, 1, 1), (2, 1, 9, 2, 1), (1, 3, 100, 4, 50), (2, 3, 20, 8, 50), (3, 4, 30, 16, 5), (4, 4, 1, 1, 0), (9, 1, 1, 1, 0)]
    links = spark.createDataFrame(links, "source long, target long, rtt_us long, throughput long, gcl_us long")
    plain = lambda edges: sorted(tuple(r)[:4] for r in edges.select("a", "b", "rtt_us", "throughput").collect())
    assert plain(G.measured_graph(nodes, links, curvature=False)[0]) == [(1, 2, 9, 3), (1, 3, 100, 4), (2, 3, 20, 8), (3, 4, 30, 16)]
    assert plain(G.measured_graph(nodes, links, remove_violations=True, curvature=False)[0]) == [(1, 2, 9, 3), (2, 3, 20, 8), (3, 4, 30, 16)]
    assert plain(G.measured_graph(nodes, links, epsilon_us=20, curvature=False)[0]) == [(1, 2, 9, 3), (2, 3, 20, 8)]
    edges, mapping = G.measured_graph(nodes, links, cluster_radians=0.02, curvature=False)
    rep = {r.id: r.rep for r in mapping.collect()}
    assert rep[1] == rep[2] and plain(edges) == [(rep[1], 3, 20, 12), (3, 4, 30, 16)]
    delays = links.where("source = 1 and target = 3")
    assert plain(G.measured_graph(nodes, links, delays=delays, curvature=False)[0]) == [(1, 3, 100, 4)]
    routes = spark.createDataFrame([(1, [1, 3, 4], 2.0), (2, [2, 4], 1.0)], "route_id long, route array<long>, volume double")
    curved, _ = G.measured_graph(nodes, links, remove_violations=True, routes=routes)
    assert curved.count() == 3 and curved.where("curvature is not null").count() > 0
    assert C.contract_all(edges, mapping.limit(0)).count() == 0


def test_smoothing_against_a_fold(spark):
    rng = random.Random(6)
    given = []
    for key, n in (("a", 3000), ("b", 1), ("c", 2), ("d", 700)):
        at = 0
        for _ in range(n):
            at += rng.randint(1, 5000 if rng.random() < 0.01 else 50)
            given.append((key, at, rng.uniform(-5, 5)))
    given += [("e", 7, 1.0), ("e", 7, 2.0)]
    found = {(r.key, r.at, r.value): r.ewma for r in S.ewma(spark.createDataFrame(given, "key string, at long, value double"), "key", "at", "value").collect()}
    for key in "abcd":
        own = [g for g in given if g[0] == key]
        scale = 2 * (len(own) - 1) / max(1, own[-1][1] - own[0][1])
        smooth = own[0][2]
        for before, now in zip([None, *own], own):
            if before:
                alpha = 1 - math.exp(-0.5 * scale * (now[1] - before[1]))
                smooth = alpha * now[2] + (1 - alpha) * smooth
            assert abs(found[now] - smooth) < 1e-9
    assert found["e", 7, 1.0] == found["e", 7, 2.0] == 1.0


def test_record_files(spark, tmp_path):
    fits = spark.createDataFrame([(1, (0.5,), [1.0, 2.0], [3.0, 4.0])], "run long, parameters struct<smooth: double>, initial array<double>, final array<double>")
    N.write_fits(fits, str(tmp_path / "f"))
    assert N.read_fits(spark, str(tmp_path / "f"), "smooth double").collect() == fits.collect()
    N.write_distances(spark.range(2).select(F.col("id").alias("source"), F.col("id").alias("destination"), F.lit(0.5).alias("geodesic_distance")), str(tmp_path / "d"))
    assert spark.read.csv(str(tmp_path / "d"), header=True).count() == 2
