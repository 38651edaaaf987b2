"""Queries that write the tables' rows in a file format and read them by its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edges as E
from ..sources import metadata, network
from . import network as net
from .models import _folder
from .network import NET
from .registry import Tables, query


@query(NET + "SELECT CAST(source AS VARCHAR) AS source_id, CAST(target AS VARCHAR) AS target_id, x.city AS city, CAST(rtt_us AS DOUBLE)/8 AS rtt, CAST(throughput AS DOUBLE) AS throughput FROM dedges JOIN nodes x ON x.id = source WHERE (source + target) % 4 <> 0")
def csv_network(t: Tables) -> DataFrame:
    """Probes and links as two CSV files; links without a round trip go, and so do those of unknown probes."""
    probes, links = _folder(t, "probes"), _folder(t, "links")
    net.nodes(t).select(F.col("id").cast("string").alias("id"), "city", "country", F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).write.csv(probes, header=True)
    rtt = F.when((F.col("source") + F.col("target")) % 4 != 0, F.col("rtt_us").cast("double") / 8)
    rows = net.directed(t).select(F.col("source").cast("string").alias("source_id"), F.col("target").cast("string").alias("target_id"), rtt.alias("rtt"), "throughput")
    stray = rows.limit(1).withColumn("target_id", F.lit("nowhere"))
    rows.unionByName(stray).write.csv(links, header=True, emptyValue="")
    known = network.read_probes(t.spark, probes)
    read, has_rtt = network.read_links(t.spark, links)
    kept = E.present(read, "rtt", has_rtt)
    ends = known.select(F.col("id").alias("source_id"), "city")
    return kept.join(ends, "source_id").join(known.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id", "city", "rtt", "throughput")


@query(NET + "SELECT strftime(make_timestamp(y, 1, 1, 0, 0, 0), '%Y%m%d%H%M%S') AS snapshot, CAST(count(*) AS BIGINT) AS links, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT year(ts) AS y, source, target, sum(throughput) AS w FROM raw WHERE source <> target GROUP BY 1, 2, 3) WHERE y BETWEEN 1994 AND 1996 GROUP BY 1")
def snapshot_files(t: Tables) -> DataFrame:
    """One link file <timestamp>.csv for each year, of which only a range of names is read."""
    path = _folder(t, "snapshots")
    stamp = F.make_timestamp(F.year("ts"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    links = net.raw_links(t).where("source <> target").groupBy(stamp.alias("snapshot_ts"), F.col("source").alias("source_id"), F.col("target").alias("target_id")).agg(F.sum("throughput").alias("throughput"))
    network.write_snapshots(links, path)
    back = network.read_snapshots(t.spark, path, "19940101000000", "19961231000000")
    return back.groupBy(F.date_format("snapshot_ts", "yyyyMMddHHmmss").alias("snapshot")).agg(F.count(F.lit(1)).alias("links"), F.sum(F.col("throughput").cast("long")).alias("weight"))


@query("SELECT event_type AS source_id, CAST(user_id % 5 AS VARCHAR) AS target_id, count(*) AS n, CAST(count(CASE WHEN value >= 5 THEN 1 END) AS BIGINT) AS answered, round(sum(CASE WHEN value >= 5 THEN round(value, 3) END), 3) AS total, CAST(min(epoch(date_trunc('second', ts))) AS BIGINT) AS first FROM events GROUP BY 1, 2")
def ping_files(t: Tables) -> DataFrame:
    """One series <source>_<target>.csv for each pair, with 'timeout' where there is no answer."""
    path = _folder(t, "pings")
    rtt = F.when(F.col("value") >= 5, F.round("value", 3).cast("string")).otherwise("timeout")
    rows = t.events.select(F.concat_ws("_", "event_type", (F.col("user_id") % 5).cast("string")).alias("pair"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), rtt.alias("rtt"))
    network.write_named(rows, "pair", ["time"], path)
    back = network.read_pings(t.spark, path)
    return back.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"), F.count("rtt").alias("answered"), F.round(F.sum("rtt"), 3).alias("total"), F.min(F.unix_seconds("ts")).alias("first"))


@query(NET + "SELECT concat('n', source) AS source, concat('n', target) AS target, CAST(sum(throughput) AS BIGINT) AS bytes, count(*) AS flows FROM raw GROUP BY 1, 2")
def flow_log(t: Tables) -> DataFrame:
    """Space-separated flow records, with shorter lines between them."""
    path = _folder(t, "flows")
    blank = F.lit("-")
    pair = F.concat(F.lit("n"), F.col("source").cast("string"), F.lit("->n"), F.col("target").cast("string"))
    line = F.concat_ws(" ", F.col("ts").cast("string"), *[blank] * 4, pair, *[blank] * 4, F.col("throughput").cast("string"), blank)
    raw = net.raw_links(t).withColumn("ts", F.date_format("ts", "yyyy-MM-dd"))
    raw.select(F.explode(F.array(line, F.lit("end of record"))).alias("value")).write.text(path)
    back = network.read_flow_log(t.spark, path)
    return back.groupBy("source", "target").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("flows"))


@query(NET + "SELECT DISTINCT concat('N', id) AS id FROM (SELECT source AS id FROM dsum UNION ALL SELECT target FROM dsum)")
def link_names(t: Tables) -> DataFrame:
    """Node names out of link names '<net>-<a>-<b>-<capacity>-<number>'."""
    path = _folder(t, "links")
    name = F.concat_ws("-", F.lit("I2"), F.concat(F.lit("N"), F.col("source").cast("string")), F.concat(F.lit("N"), F.col("target").cast("string")), F.lit("400GE"), F.col("throughput").cast("string"))
    net.directed(t).select(name.alias("value")).write.text(path)
    return network.read_link_names(t.spark, path)


@query(NET + "SELECT concat('N', source) AS source, concat('N', target) AS target, CAST(epoch(date_trunc('month', ts)) AS BIGINT) AS time, CAST(sum(CASE WHEN throughput % 5 = 0 THEN 0 ELSE throughput END) AS DOUBLE) AS throughput FROM raw WHERE source <> target GROUP BY 1, 2, 3")
def link_exports(t: Tables) -> DataFrame:
    """One exported CSV a link, with a byte order mark and empty values; source and target stand in its name."""
    path = _folder(t, "exports")
    n = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    # The end that isn't the source stands first or second in the name's last part.
    ends = F.when(F.col("source") % 2 == 0, F.concat_ws("-", n("source"), n("target"))).otherwise(F.concat_ws("-", n("target"), n("source")))
    stem = F.concat(F.lit("rtr."), F.lower(n("source")), F.lit(".net _ ae1"), ends, F.lit("-data-x"))
    month = F.unix_seconds(F.date_trunc("month", F.col("ts").cast("timestamp"))) * 1000
    value = F.when(F.col("throughput") % 5 != 0, F.col("throughput").cast("string")).otherwise("")
    rows = net.raw_links(t).where("source <> target").select(stem.alias("name"), F.lit(1).alias("place"), F.concat_ws(",", month.cast("string"), value).alias("value"))
    head = rows.select("name").distinct().select("name", F.lit(0).alias("place"), F.lit("﻿time,Output [1h averages]").alias("value"))
    network.write_named(rows.unionByName(head), "name", ["place"], path, text=True)
    return metadata.read_link_exports(t.spark, path)
