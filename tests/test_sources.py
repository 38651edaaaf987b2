"""Readers on small files: missing columns, empty values, timeouts, duplicates."""

import json

import pytest

from loamgraph.operators import config
from loamgraph.operators import edges as E
from loamgraph.sources import network as N


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_links(spark, tmp_path):
    with_rtt, has = N.read_links(spark, put(tmp_path / "a.csv", "source_id,target_id,rtt\n1,2,3.5\n1,1,0.0\n2,3,\n"))
    assert has and sorted(-1 if r.rtt is None else r.rtt for r in with_rtt.collect()) == [-1, 0.0, 3.5]
    assert E.present(with_rtt, "rtt", has).count() == 2
    without, has = N.read_links(spark, put(tmp_path / "b.csv", "source_id,target_id\n1,2\n"))
    assert not has and E.present(without, "rtt", has).count() == 1


def test_probes_and_names(spark, tmp_path):
    probes = N.read_probes(spark, put(tmp_path / "p.csv", 'id,city,country,latitude,longitude\n10,"Paris, 5e",FR,48.8,2.3\n'))
    assert [tuple(r) for r in probes.collect()] == [("10", "Paris, 5e", "FR", 48.8, 2.3)]
    names = N.read_link_names(spark, put(tmp_path / "l.txt", "I2-ATLA-CHIC-400GE-1\nI2-CHIC-DENV-100GE-2\n"))
    assert sorted(r.id for r in names.collect()) == ["ATLA", "CHIC", "DENV"]


def test_snapshots_and_pings(spark, tmp_path):
    for stamp, x in (("20240101000000", 1), ("20240101010000", 2), ("20240102000000", 3)):
        put(tmp_path / "s" / f"{stamp}.csv", f"source_id,target_id,throughput\na,b,{x}\n")
    all_of = N.read_snapshots(spark, str(tmp_path / "s"))
    some = N.read_snapshots(spark, str(tmp_path / "s"), "20240101010000", "20240101235959")
    assert all_of.count() == 3 and [r.throughput for r in some.collect()] == ["2"]
    assert str(some.first().snapshot_ts) == "2024-01-01 01:00:00"
    put(tmp_path / "r" / "7_8.csv", "time,rtt\n0,timeout\n3600,4.25\n")
    pings = N.read_pings(spark, str(tmp_path / "r")).orderBy("ts").collect()
    assert [(r.source_id, r.target_id, r.rtt) for r in pings] == [("7", "8", None), ("7", "8", 4.25)]


def test_network_document(spark, tmp_path):
    doc = {
        "nodes": [{"id": "a", "latitude": 1.0, "longitude": 2.0}],
        "links": [{"source_id": "a", "target_id": "b", "rtt": 1.0}, {"source_id": "a", "target_id": "b", "rtt": 2.0}, {"source_id": "b", "target_id": "c"}],
        "traffic": [{"route": ["a", "b", "c"], "volume": 5.0}, {"route": ["a", "b"], "volume": 2.0}, {"route": ["a"], "volume": 9.0}],
    }
    found = N.read_network_json(spark, put(tmp_path / "n.json", json.dumps(doc, indent=1)))
    assert sorted((r.source_id, r.target_id, r.rtt, r.throughput) for r in found["links"].collect()) == [("a", "b", 2.0, 7.0), ("b", "c", None, 5.0)]
    assert found["delays"].count() == 0 and found["routes"].count() == 3


def test_graphml_with_two_keys_of_a_name(spark, tmp_path):
    text = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" for="node" attr.name="rtt" attr.type="float"/><key id="d1" for="edge" attr.name="rtt" attr.type="double"/>
<graph edgedefault="undirected"><node id="x"><data key="d0">1.5</data></node><node id="y"/><edge source="x" target="y"><data key="d1">2.5</data></edge></graph></graphml>"""
    nodes, edges = N.read_graphml(spark, put(tmp_path / "g.graphml", text))
    assert {r.id: r.attributes for r in nodes.collect()} == {"x": {"rtt": "1.5"}, "y": {}}
    assert [(r.source, r.target, r.attributes) for r in edges.collect()] == [("x", "y", {"rtt": "2.5"})]


def test_flow_log(spark, tmp_path):
    log = N.read_flow_log(spark, put(tmp_path / "f.log", "0 1 2 3 4 a->b 6 7 8 9 1200 x\nshort line\n"))
    assert [tuple(r) for r in log.collect()] == [("a", "b", 1200)]


def test_configurations(spark):
    grid = config.expand(spark, {"a": [1, 2, 3], "b": [4, 5, 6], "c": [7, 8]}, [["a", "b"]], {"d": "x", "a": 0})
    assert sorted((r.a, r.b, r.c, r.d) for r in grid.collect()) == sorted((a, b, c, "x") for a, b in ((1, 4), (2, 5), (3, 6)) for c in (7, 8))
    assert {tuple(r.batch) for r in config.batches(grid, "c").collect()} == {(7, 8)}
    with pytest.raises(ValueError):
        config.batches(grid, "zeta")
    with pytest.raises(ValueError):
        config.expand(spark, {"a": [1, 2], "b": [1]}, [["a", "b"]])


def test_thresholds_and_ends(spark):
    rows = spark.createDataFrame([("10", "9", 5, 1), ("9", "9", 0, 0), ("9", "77", None, 1)], "source string, target string, rtt_us long, gcl_us long")
    kept = E.threshold(E.drop_self_loops(rows), 4)
    assert kept.count() == 2
    assert [(r.a, r.b) for r in E.canonical(kept).orderBy("a", "b").collect()] == [("10", "9"), ("77", "9")]
    known = E.known_ends(rows, spark.createDataFrame([("9",), ("10",)], "id string"))
    assert known.count() == 2
