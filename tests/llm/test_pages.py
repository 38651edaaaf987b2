"""Language of web pages beside documents: the same table, markup and addresses as evidence."""

from pyspark.sql import functions as F

from loamgraph.llm import language as L
from loamgraph.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/pages.parquet")


def test_every_row_is_judged(spark):
    docs, pages = tables(spark)
    found = queries()["op3_language"](spark, FOLDER).toPandas()
    declared = pages.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("declared")).toPandas().set_index("page_id").declared
    of_pages = found[found.page_id.notna()].set_index("page_id")
    assert sorted(of_pages.index) == sorted(declared.index) and of_pages.doc_id.isna().all()
    assert sorted(found[found.page_id.isna()].doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert (of_pages.language == declared.reindex(of_pages.index)).mean() > 0.9


def test_evidence_acts_on_the_tables(spark):
    """Without the markup, or without addresses, some pages' posteriors are others; documents have neither, but share the corpus's prior."""
    docs, pages = tables(spark)
    model = L.fit(docs)
    names = ("host", "id", "text", "markup", "address", "kind")

    def posteriors(rows):
        return {r.doc_id: r.posterior for r in L.identify(rows, model, *names).where("kind = 'page'").collect()}

    whole = L.documents_and_pages(docs, pages)
    base = posteriors(whole)
    for gone in ("markup", "address"):
        other = posteriors(whole.withColumn(gone, F.lit("")))
        assert sum(base[k] != other[k] for k in base) >= 2


def test_short_pages_go_by_their_markup(spark):
    docs, _ = tables(spark)
    model = L.fit(docs)
    langs = model.languages
    rows = [(k, f"https://h{k}.example.{langs[k % len(langs)]}/", f'<html lang="{langs[k % len(langs)]}"><body>en</body></html>') for k in range(40)]
    found = {r.page_id: r.language for r in L.language_table(docs, spark.createDataFrame(rows, PAGES)).where("page_id is not null").collect()}
    assert found == {k: langs[k % len(langs)] for k in range(40)}


def test_edges(spark):
    docs, _ = tables(spark)
    long = "<p>" + "the and of them " * 200_000 + "<" * 100_000 + "</p>"
    rows = [(1, None, None), (None, "http://a.example.com/x", "<p></p>"), (2, "", ""), (3, "no address", "<script>the</script>"), (4, "http://b.net:80/", long), (4, "http://b.net:80/", long)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("kind", F.lit("clash")).withColumn("doc_id", F.lit("clash"))
    few = docs.limit(20)
    found = L.language_table(few, pages).toPandas()
    assert len(found) == 26 and found.doc_id.notna().sum() == 20
    found = found[found.doc_id.isna()]
    assert (found.page_id == 4).sum() == 2
    assert not found[found.page_id != 4].accepted.any() and found[found.page_id != 4].language.isna().all()
    assert L.language_table(few, pages.limit(0)).count() == 20
    assert L.language_table(few.limit(0), pages).where("accepted").count() == 0


def test_page_text(spark):
    rows = spark.createDataFrame([("<html><script>a</script><STYLE x=1>b</STYLE><p>c &lt; d</p>e < f",), (None,), ("<" * 200_000,)], "html string")
    assert [" ".join(r.t.split()) if r.t and len(r.t) < 1000 else r.t and len(r.t) for r in rows.select(L.page_text(F.col("html")).alias("t")).collect()] == ["c &lt; d e < f", None, 200_000]
