"""Loaders of the tables that go with route traces: exchanges, relations, cones, anchors, prefixes, places, organisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _place() -> Column:
    """A row's place in its files, by name: of rows with one key the last counts."""
    return F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _lines(spark: SparkSession, path: str, comment: str) -> DataFrame:
    return spark.read.text(path).withColumn("place", _place()).where(~F.startswith("value", F.lit(comment)) & (F.col("value") != ""))


def read_exchange_members(spark: SparkSession, path: str, exchange: str | None = None) -> DataFrame:
    """address, asn (-1: none known), exchange from lines 'address<tab>asn<tab>exchange'.

    Fixed values: two names stand in the number's column of broken lines, which are left out.
    """
    t = F.split("value", "\t")
    rows = _lines(spark, path, "#").select(t[0].alias("address"), t[1].alias("asn"), t[2].alias("exchange"), "place").where(~F.col("asn").isin(" Telx Atlanta", " Telx New York"))
    if exchange is not None:
        rows = rows.where(F.col("exchange") == exchange)
    rows = rows.withColumn("asn", F.when(F.col("asn") == "None", F.lit(-1).cast("long")).otherwise(F.trim("asn").cast("long")))
    return rows.groupBy("address").agg(F.max_by(F.struct("asn", "exchange"), "place").alias("last")).select("address", "last.*")


def read_peers(spark: SparkSession, path: str) -> DataFrame:
    """asn, peer, both ways, from lines 'a|b|relation'; relation 0 is peering."""
    t = F.split("value", r"\|")
    rows = _lines(spark, path, "#").select(t[0].cast("long").alias("a"), t[1].cast("long").alias("b"), t[2].cast("int").alias("relation")).where("relation = 0")
    return rows.select(F.explode(F.array(F.struct(F.col("a").alias("asn"), F.col("b").alias("peer")), F.struct(F.col("b").alias("asn"), F.col("a").alias("peer")))).alias("e")).select("e.*").distinct()


def read_customer_cones(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(asn, customer) and (asn, provider) from a JSON object of lists by number; `asn` without a provider has a row with null."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<long>>")).alias("asn", "customers"))
    cones = doc.select(F.col("asn").cast("long").alias("asn"), F.explode_outer("customers").alias("customer")).distinct()
    links = cones.where("customer is not null")
    every = cones.select("asn").union(links.select("customer")).distinct()
    return links, every.join(links.select(F.col("customer").alias("asn"), F.col("asn").alias("provider")), "asn", "left")


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """id, address, latitude, longitude of a JSON list of anchors: the last of each address, null included."""
    schema = "id long, address_v4 string, geometry struct<coordinates: array<double>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).withColumn("place", F.monotonically_increasing_id())
    last = rows.groupBy("address_v4").agg(F.max_by(F.struct("id", "geometry"), "place").alias("last"))
    return last.select("last.id", F.col("address_v4").alias("address"), F.get("last.geometry.coordinates", F.lit(1)).alias("latitude"), F.get("last.geometry.coordinates", F.lit(0)).alias("longitude"))


def read_prefix_owners(spark: SparkSession, path: str) -> DataFrame:
    """prefix, asn from lines 'prefix<tab>asn'; lines with ';' are comments."""
    t = F.split("value", "\t")
    rows = _lines(spark, path, ";").select(t[0].alias("prefix"), t[1].cast("long").alias("asn"), "place")
    return rows.groupBy("prefix").agg(F.max_by("asn", "place").alias("asn"))


def read_prefix_table(spark: SparkSession, path: str) -> DataFrame:
    """prefix, asn (as written) from a table, zipped or not, of address, length and owner below one head line."""
    rows = spark.read.csv(path, sep="\t", header=True, enforceSchema=True, schema="address string, size string, asn string").withColumn("place", _place())
    return rows.withColumn("prefix", F.concat_ws("/", "address", "size")).groupBy("prefix").agg(F.max_by("asn", "place").alias("asn"))


def read_place_votes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(address, country) and (address, city, lat, lon, score) of CSV files that each locate addresses.

    An address has a place if more than half of the files name one and all of them the same; its coordinates, like its country, are the
    last file's.  Lines with more than ten fields are left out; an empty score is 0.
    """
    names = ["ip", "city_code", "city", "state", "country", "iso2", "iso3", "lat", "lon", "score", "spare"]
    files = spark.read.format("binaryFile").load(folder, pathGlobFilter="*.csv").select("path").agg(F.count(F.lit(1)).alias("files"))
    rows = spark.read.csv(folder, header=True, enforceSchema=True, schema=", ".join(f"{c} string" for c in names), pathGlobFilter="*.csv", ignoreLeadingWhiteSpace=True).withColumn("place", _place()).where("spare is null")
    countries = rows.groupBy(F.col("ip").alias("address")).agg(F.max_by("iso2", "place").alias("country"))
    named = rows.where("city is not null and city <> ''").withColumn("address", F.split("ip", "/")[0])
    number = lambda c: F.expr(f"try_cast(nullif({c}, '') as double)")
    last = F.max_by(F.struct(number("lat").alias("lat"), number("lon").alias("lon"), F.coalesce(number("score"), F.lit(0.0)).alias("score")), "place")
    voted = named.groupBy("address").agg(F.count(F.lit(1)).alias("votes"), F.min("city").alias("city"), F.max("city").alias("other"), last.alias("last"))
    # One row with the number of files.
    places = voted.join(F.broadcast(files), F.col("votes") > F.col("files") / 2).where("city = other").select("address", "city", "last.*")
    return countries, places


def read_organisations(spark: SparkSession, path: str) -> DataFrame:
    """asn, organisation from JSON lines; the number itself where no name is given."""
    rows = spark.read.json(path, schema="asn string, organization struct<orgName: string>").withColumn("place", _place())
    return rows.groupBy(F.col("asn").cast("long").alias("asn")).agg(F.max_by(F.coalesce("organization.orgName", "asn"), "place").alias("organisation"))


def read_link_exports(spark: SparkSession, folder: str) -> DataFrame:
    """source, target, time (whole seconds), throughput of one exported CSV a link, summed; an empty value is 0.

    Names are '<any>.<source>.<...> _ <3 characters><a>-<b>-data<...>': the target is the end that isn't the source; links to
    themselves are left out.  A byte order mark before the head is no part of it.
    """
    raw = spark.read.csv(folder, header=True, pathGlobFilter="*.csv")
    column = {c.lstrip("\ufeff").strip(): F.col(f"`{c}`") for c in raw.columns}
    name = F.regexp_replace(F.col("_metadata.file_name"), "%20", " ")
    ends = F.split(F.regexp_extract(F.element_at(F.split(name, " _ "), -1), "^.{3}(.*?)-data", 1), "-")
    value = F.coalesce(column["Output [1h averages]"].try_cast("double"), F.lit(0.0))
    rows = raw.select(F.upper(F.split(name, r"\.")[1]).alias("source"), ends.alias("ends"), column["time"].try_cast("long").alias("time"), value.alias("throughput")).where("time is not null")
    rows = rows.withColumn("target", F.when(F.col("source") == F.col("ends")[0], F.col("ends")[1]).otherwise(F.col("ends")[0])).where("source <> target")
    return rows.groupBy("source", "target", F.expr("time div 1000").alias("time")).agg(F.sum("throughput").alias("throughput"))
