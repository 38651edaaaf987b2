"""Readers and writers of probe, link, ping, snapshot, JSON and GraphML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBES = "id string, city string, country string, latitude double, longitude double"
NETWORK = (
    "nodes array<struct<id: string, latitude: double, longitude: double>>,"
    "links array<struct<source_id: string, target_id: string, rtt: double>>,"
    "delays array<struct<source_id: string, target_id: string, rtt: double>>,"
    "traffic array<struct<route: array<string>, volume: double>>"
)


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=PROBES, enforceSchema=False).select("id", "city", "country", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def read_links(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """Links and whether the files have round trips at all: without the column they are the bound, an empty value drops the link."""
    raw = spark.read.csv(path, header=True)
    has_rtt = "rtt" in raw.columns
    column = lambda c: (F.expr(f"try_cast(nullif({c}, '') as double)") if c in raw.columns else F.lit(None).cast("double")).alias(c)
    return raw.select("source_id", "target_id", column("rtt"), column("throughput")), has_rtt


def read_snapshots(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """All link files <timestamp>.csv of a folder with their time; only files from `first` to `last` (as in their names)."""
    raw = spark.read.option("header", True).csv(folder, pathGlobFilter="*.csv").withColumn("stamp", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{14})", 1))
    if first:
        raw = raw.where(F.col("stamp") >= first)
    if last:
        raw = raw.where(F.col("stamp") <= last)
    return raw.withColumn("snapshot_ts", F.to_timestamp("stamp", "yyyyMMddHHmmss")).drop("stamp")


def read_pings(spark: SparkSession, folder: str) -> DataFrame:
    """Ping series <source>_<target>.csv; 'timeout' is no value."""
    raw = spark.read.csv(folder, header=True, schema="time long, rtt string", pathGlobFilter="*_*.csv")
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    return raw.select(F.split(stem, "_")[0].alias("source_id"), F.split(stem, "_")[1].alias("target_id"), F.timestamp_seconds("time").alias("ts"), F.expr("try_cast(rtt as double)").alias("rtt"))


def read_network_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, links, delays, routes.  Of links given twice the last counts; their throughput is the volume of the routes across."""
    doc = spark.read.json(path, schema=NETWORK, multiLine=True)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.id", F.col("n.latitude").alias("lat"), F.col("n.longitude").alias("lon"))
    posed = doc.select(F.posexplode("links").alias("pos", "l")).select("pos", "l.*")
    links = posed.groupBy("source_id", "target_id").agg(F.max_by("rtt", "pos").alias("rtt"))
    delays = doc.select(F.explode("delays").alias("d")).select("d.*")
    routes = doc.select(F.posexplode("traffic").alias("route_id", "t")).select("route_id", "t.route", "t.volume")
    ends = F.arrays_zip(F.slice("route", 1, F.greatest(F.size("route") - 1, F.lit(0))).alias("source_id"), F.slice("route", 2, F.greatest(F.size("route") - 1, F.lit(0))).alias("target_id"))
    crossed = routes.select("volume", F.explode(ends).alias("h")).groupBy("h.source_id", "h.target_id").agg(F.sum("volume").alias("throughput"))
    return {"nodes": nodes, "links": links.join(crossed, ["source_id", "target_id"], "left"), "delays": delays, "routes": routes}


def write_network_json(nodes: DataFrame, links: DataFrame, delays: DataFrame, routes: DataFrame, path: str) -> None:
    """One JSON document; it holds a whole network by its nature."""
    listed = lambda df, name, *cols: df.agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    doc = listed(nodes, "nodes", "id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    doc = doc.crossJoin(listed(links, "links", "source_id", "target_id", "rtt")).crossJoin(listed(delays, "delays", "source_id", "target_id", "rtt")).crossJoin(listed(routes, "traffic", "route", "volume"))
    doc.write.json(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, attributes) and edges (source, target, attributes); attributes are maps from their names.

    Keys are declared by id; two keys of one name stay apart by their kind, the last declared of one kind counts.
    """
    data = "data array<struct<_key: string, _VALUE: string>>"
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string, _for string").load(path)
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)

    def named(rows: DataFrame, ids: list[str], kind: str) -> DataFrame:
        own = keys.where(F.col("_for").isin(kind, "all")).select(F.col("_id").alias("k"), F.col("`_attr.name`").alias("name"))
        flat = rows.select(*ids, F.explode_outer("data").alias("d")).join(own, F.col("d._key") == F.col("k"), "left")
        pairs = flat.groupBy(*ids, "name").agg(F.max("d._VALUE").alias("value"))
        return pairs.groupBy(*ids).agg(F.map_from_entries(F.filter(F.collect_list(F.struct("name", "value")), lambda e: e["name"].isNotNull())).alias("attributes"))

    return named(nodes, ["_id"], "node").withColumnRenamed("_id", "id"), named(edges, ["_source", "_target"], "edge").withColumnsRenamed({"_source": "source", "_target": "target"})


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML as text lines: nodes (id, others) and edges (source, target, others), one line each, in one file."""
    kind = {"double": "double", "float": "float", "int": "int", "bigint": "long", "boolean": "boolean"}
    heads = ['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    lines = []
    for df, tag, ids in ((nodes, "node", ["id"]), (edges, "edge", ["source", "target"])):
        rest = [c for c in df.columns if c not in ids]
        heads += [f'<key id="{tag}_{c}" for="{tag}" attr.name="{c}" attr.type="{kind.get(dict(df.dtypes)[c], "string")}"/>' for c in rest]
        safe = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
        parts = [F.lit(f"<{tag} ")] + [F.concat(F.lit(f'{c}="'), safe(c), F.lit('" ')) for c in ids] + [F.lit(">")]
        parts += [F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit(f'<data key="{tag}_{c}">'), safe(c), F.lit("</data>"))) for c in rest] + [F.lit(f"</{tag}>")]
        lines.append(df.select(F.lit(1 if tag == "node" else 2).alias("o"), F.concat(*parts).alias("value")))
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, "\n".join([*heads, '<graph edgedefault="undirected">']))], "o int, value string")
    tail = spark.createDataFrame([(3, "</graph></graphml>")], "o int, value string")
    # A document is one file in order.
    head.unionByName(lines[0]).unionByName(lines[1]).unionByName(tail).repartition(1).sortWithinPartitions("o", "value").select("value").write.text(path)


def write_named(rows: DataFrame, name: str, order: list[str], path: str, suffix: str = ".csv", text: bool = False) -> None:
    """One file for each value of the column `name`, called by it: CSV with a head line, or lines of the single other column if `text`.

    A file's rows are one task's, as they are one file; then files move to their names, which touches no rows.
    """
    spark = rows.sparkSession
    parts = f"{path.rstrip('/')}-parts"
    laid = rows.withColumn("_file", F.col(name)).repartition("_file").sortWithinPartitions("_file", *order)
    laid = laid.select("_file", *[c for c in rows.columns if c != name and (not text or c not in order)])
    writer = laid.write.partitionBy("_file")
    writer.text(parts) if text else writer.csv(parts, header=True)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(parts)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(path))
    for group in fs.listStatus(folder):
        if group.isDirectory():
            stem = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(group.getPath().getName())[len("_file=") :]
            for part in fs.listStatus(group.getPath()):
                if part.getPath().getName().startswith("part-"):
                    fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(path, stem + suffix))
    fs.delete(folder, True)


def write_snapshots(links: DataFrame, path: str) -> None:
    """One CSV file <yyyyMMddHHmmss>.csv for each snapshot time.  links: snapshot_ts, source_id, target_id and others."""
    stamped = links.withColumn("stamp", F.date_format("snapshot_ts", "yyyyMMddHHmmss")).drop("snapshot_ts")
    write_named(stamped, "stamp", ["source_id", "target_id"], path)


def read_flow_log(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated flow records: field 5 is 'source->target', field 10 the bytes."""
    f = F.split("value", " ")
    return spark.read.text(path).where(F.size(f) > 10).select(F.split(f[5], "->")[0].alias("source"), F.split(f[5], "->")[1].alias("target"), F.try_to_number(f[10], F.lit("999999999999999")).cast("long").alias("bytes"))


def read_link_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct node names of lines '<net>-<a>-<b>-<capacity>-<number>'."""
    p = F.split("value", "-")
    return spark.read.text(path).where(F.size(p) > 2).select(F.explode(F.array(p[1], p[2])).alias("id")).distinct()


def write_distances(rows: DataFrame, path: str) -> None:
    """source, destination, geodesic_distance as CSV files with a head line."""
    rows.select("source", "destination", "geodesic_distance").write.csv(path, header=True)


def write_fits(rows: DataFrame, path: str) -> None:
    """One JSON record for each fitted surface: parameters, heights before (initial) and after (final), and whatever else it has."""
    rows.write.json(path, ignoreNullFields=False)


def read_fits(spark: SparkSession, path: str, parameters: str) -> DataFrame:
    """run, parameters, initial, final of written fits; `parameters` is the schema of their settings."""
    return spark.read.json(path, schema=f"run long, parameters struct<{parameters.replace(' ', ': ', 1)}>, initial array<double>, final array<double>")
