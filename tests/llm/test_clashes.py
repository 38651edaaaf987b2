"""Columns named like the operators' own, ids that are the smallest long or missing, and one id for different texts."""

import random

import pyspark.sql.functions as F

from loamgraph.llm.exact_dedup import drop_copies, exact_groups
from loamgraph.llm.fingerprints import document_fingerprints
from loamgraph.llm.jaccard import keep_one, similarity_components
from loamgraph.llm.packing import pack
from loamgraph.llm.quality import resample
from loamgraph.llm.repeats import drop_repeats, repeat_digests
from loamgraph.llm.token_files import token_round_trip

from .test_jaccard import family

LOWEST = -(2**63)
OWN = "row key k1 k2 rest _a _k _rest gram at z".split()


def clashing(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    return docs.withColumns({c: F.lit(f"{c}!") for c in OWN})


def test_columns_keep_their_values(spark):
    passage = "x" * 250
    docs = clashing(spark, [(1, "a" + passage, 251), (2, passage + "b", 251), (None, None, None)])
    for out in (drop_repeats(docs), keep_one(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) == 3 and all(r[c] == f"{c}!" for r in rows for c in OWN)
    assert sorted(str((r.text, r.n_chars)) for r in drop_repeats(docs).collect()) == sorted(map(str, [("a", 1), ("b", 1), (None, None)]))


def test_one_of_each_group_stays_whatever_its_id(spark):
    a, b = family(random.Random(1), 2, 0), "another text that has nothing in common with them"
    near = a[0] + " tail"
    docs = clashing(spark, [(None, a[0], 1), (None, near, 1), (3, near + " end", 1), (3, b, 1)])
    assert sorted(r.text == b for r in keep_one(docs).collect()) == [False, True]
    assert {str(r.component_id) for r in similarity_components(docs, 5, 80).collect()} == {"None", "3"}


def test_the_smallest_long_is_an_id(spark):
    docs = clashing(spark, [(LOWEST, "some words here", 1), (None, "some words here", 1)])
    for out in (pack(docs), token_round_trip(docs), similarity_components(docs)):
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted([str(LOWEST), "None"])


def test_the_smallest_long_and_no_id_stay_apart(spark):
    docs = clashing(spark, [(LOWEST, "some words here", 1), (LOWEST, "some  words here", 1), (None, "other words", 1), (LOWEST, "other words", 1), (5, "other words", 1)])
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    want = sorted(["None", *[str(LOWEST)] * 3, "5"])
    for out in (exact_groups(docs), document_fingerprints(docs), resample(docs, labels)):
        assert sorted(str(r.doc_id) for r in out.collect()) == want
    groups = {(r.doc_id, r.group_size): (r.keep_id, r.kept) for r in exact_groups(docs).collect()}
    assert groups == {(LOWEST, 2): (LOWEST, True), (None, 3): (None, True), (LOWEST, 3): (None, False), (5, 3): (None, False)}


def test_drop_copies_with_clashing_columns(spark):
    docs = clashing(spark, [(2, "a b", 1), (1, "a  b", 1), (None, "c", 1)]).withColumns({"_id": F.lit(1), "_sha": F.lit("s"), "low": F.lit(9), "none": F.lit(True)})
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r["_sha"], r.low) for r in kept.collect()) == [("1", "s", 9), ("None", "s", 9)]


def test_many_equal_rows_cost_no_square(spark):
    text = " ".join(f"word{i}" for i in range(250))
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).union(spark.createDataFrame([(1, "x" + text), (2, "short")], "doc_id long, text string"))
    rows = repeat_digests(docs).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    assert sorted((str(r.doc_id), r.n_removed, r.n_spans, r["count"]) for r in rows) == [("1", len(text), 1, 1), ("2", 0, 0, 1), ("None", len(text), 1, 20_000)]


def test_empty_tables(spark):
    docs = clashing(spark, [])
    assert drop_repeats(docs).count() == keep_one(docs).count() == pack(docs).count() == token_round_trip(docs).count() == 0
