"""The pipeline on small test data, on odd rows and on an empty table."""
import corpus_pipeline
from pyspark.sql import functions as F
from tests.conftest import SF_CHECK
from tests.llm.conftest import CASES


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_CHECK)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("1 = 0"), SF_CHECK).count() == 0
    kept = {r.doc_id for r in corpus_pipeline.run(spark, SF_CHECK).collect()}
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()
    share = lambda ids: len(set(ids) & kept) / len(set(ids))
    assert share([r.doc_id for r in labels if not r.quality]) <= 0.05  # whole words need more than 1,000 documents for the insults' last quarter
    assert share([r.doc_id for r in labels if r.toxic]) <= 0.3 and share([r.doc_id for r in labels if r.quality and not r.toxic]) > 0.55


def test_stages_on_odd_rows(spark):
    """Null ids and texts, repeated rows and an extra column pass through every stage."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "kept") for i, t in CASES],
                                 "doc_id long, text string, lang string, source string, n_chars long, node string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_CHECK)
        assert out.columns == docs.columns and out.where(F.col("node") != "kept").count() == 0, name
        docs_left = out.count()
        assert 0 < docs_left <= len(CASES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_CHECK).count() >= len(CASES)
