import corpus_pipeline
from framewright.llm import queries


def test_stages_keep_columns_and_clean_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialize(stage(spark, docs, data), f"test-{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if name == "language_id":
            assert out.count() >= 0.99 * first
        docs = out
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(docs.columns) and docs.count() > 0


def test_the_whole_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


def test_an_empty_corpus(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0


def test_queries_run(spark, data):
    assert len(queries.QUERIES) == 10


def test_odd_rows_pass_all_stages(spark, data):
    base = spark.read.parquet(f"{data}/documents.parquet")
    ddl = base.schema.add("_row", "string").add("_k", "string").add("label", "string")
    prose = base.filter("lang is not null and length(text) > 400").orderBy("doc_id").head()
    odd = [(None, None, None, None, None), (None, prose["text"], None, None, None), (-1, prose["text"] + " " + prose["text"], prose["lang"], None, 1), (-2, "", None, "s", 0), (-3, prose["text"] * 60, prose["lang"], "s", 1), (-3, prose["text"] * 60, prose["lang"], "s", 1), (-4, "12 34", "xx", "s", 1)]
    docs = base.selectExpr("*", "'a' as _row", "'b' as _k", "'c' as label").unionByName(spark.createDataFrame([(*r, "a", "b", "c") for r in odd], ddl))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialize(stage(spark, docs, data), f"odd-{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            if name == "language_id":
                ids = {r["doc_id"] for r in out.select("doc_id").collect()}
                assert not ids & {-2, -4} and {-1, -3} <= ids
            if name == "exact_dedup":
                assert out.filter("doc_id = -3").count() == 1
        docs = out
    assert docs.count() > 0
