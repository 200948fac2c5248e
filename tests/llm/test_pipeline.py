import corpus_pipeline
from tidemark.llm.tables import written

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns and 0 < docs.count() <= rows
        rows = docs.count()
        assert docs.select("doc_id").distinct().count() == rows
        assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == rows


def test_stages_over_no_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF_DIR), name)
        assert docs.count() == 0
