"""Owners and places of the addresses on a traced route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def address_number(address: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one."""
    parts = F.split(address, r"\.")
    octets = [F.get(parts, F.lit(i)).try_cast("long") for i in range(4)]
    whole = (F.size(parts) == 4) & F.coalesce(F.greatest(*octets) <= 255, F.lit(False)) & F.coalesce(F.least(*octets) >= 0, F.lit(False))
    return F.when(whole, octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3])


def prefix_owner(addresses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """address, owner: that of the longest prefix 'a.b.c.d/n' around each address.  prefixes: prefix, asn.

    An address makes one row for each length in use, 33 at most, which meets its prefix by equality.
    """
    size = F.split("prefix", "/")[1].cast("int")
    cut = lambda number, n: F.expr(f"shiftright({number}, 32 - {n})")
    nets = prefixes.select(address_number(F.split("prefix", "/")[0]).alias("number"), size.alias("size"), F.col("asn").alias("owner")).select("size", cut("number", "size").alias("net"), "owner")
    sizes = nets.agg(F.collect_set("size").alias("sizes"))
    own = addresses.select("address").where("address is not null").distinct().withColumn("number", address_number(F.col("address"))).where("number is not null")
    tries = own.crossJoin(F.broadcast(sizes)).select("address", "number", F.explode("sizes").alias("size")).select("address", "size", cut("number", "size").alias("net"))
    return tries.join(nets, ["size", "net"]).groupBy("address").agg(F.max_by("owner", "size").alias("owner"))


def located_hops(hops: DataFrame, members: DataFrame, prefixes: DataFrame, places: DataFrame, organisations: DataFrame) -> DataFrame:
    """hops with asn, organisation and place: an exchange's table first, else the longest prefix and the voted city.

    hops: address and others; members: address, asn, exchange; places: address, city; organisations: asn, organisation.
    Without a name the number stands for its organisation; addresses that are null or in no table have nulls.
    """
    first = members.select("address", F.col("asn").alias("member_asn"), "exchange")
    found = hops.join(first, "address", "left").join(prefix_owner(hops, prefixes), "address", "left").join(places.select("address", "city"), "address", "left")
    inside = F.col("exchange").isNotNull()
    placed = found.withColumns({"asn": F.when(inside, F.col("member_asn")).otherwise(F.col("owner")), "place": F.when(inside, F.col("exchange")).otherwise(F.col("city"))})
    named = placed.join(organisations.select("asn", "organisation"), "asn", "left")
    return named.select(*hops.columns, "asn", F.coalesce("organisation", F.col("asn").cast("string")).alias("organisation"), "place")


def first_of_places(rows: DataFrame, at: str, code: str, name: str, by: str | None = None) -> DataFrame:
    """Rows whose code and lower-cased name no earlier row has (earlier by `at`); skipped rows count as seen too.

    As skipped rows are seen as well, a row stays if it is its code's first and its name's first: two minima, no fold.
    A missing code or name is a value like any other, the same for all that lack it.
    """
    keys = [by] if by else []
    marked = rows.withColumns({"_code": F.struct(*keys, F.col(code).isNull().alias("none"), F.coalesce(F.col(code).cast("string"), F.lit("")).alias("code")), "_name": F.struct(*keys, F.col(name).isNull().alias("none"), F.coalesce(F.lower(name), F.lit("")).alias("name"))})
    codes = marked.groupBy(F.col("_code").alias("_c")).agg(F.min(at).alias("_first_code"))
    names = marked.groupBy(F.col("_name").alias("_n")).agg(F.min(at).alias("_first_name"))
    both = marked.join(codes, F.col("_code").eqNullSafe(F.col("_c"))).join(names, F.col("_name").eqNullSafe(F.col("_n")))
    return both.where((F.col(at) == F.col("_first_code")) & (F.col(at) == F.col("_first_name"))).select(*rows.columns)
