import corpus_pipeline
from helpers import SF


def test_without_any_label_documents_with_a_letter_stay(spark):
    rows = [(1, "plain words", None), (2, "Straße 日本語", None), (3, "123 !", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, SF).collect()) == [1, 2]
