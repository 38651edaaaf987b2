import corpus_pipeline
from loamgraph.llm.jaccard import similarity_components
from loamgraph.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "repeats", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == columns
        seen[name] = docs = after
    assert seen["exact_dedup"].count() < seen["language"].count()
    near = similarity_components(seen["near_dedup"], 5, 80)
    assert near.where("doc_id <> component_id").count() == 0
    texts = [(r.text or "").encode() for r in seen["repeats"].collect()]
    starts = {}
    for t in texts:
        for i in range(len(t) - 199):
            starts[t[i : i + 200]] = starts.get(t[i : i + 200], 0) + 1
    # Only what removal brings together may repeat.
    assert sum(n > 1 for n in starts.values()) <= 0.001 * len(starts)
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in seen["repeats"].select("doc_id").collect()}


def test_queries_cover_all_documents(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name, query in queries().items():
        out = query(spark, FOLDER)
        assert out.select("doc_id").distinct().count() == n, name
