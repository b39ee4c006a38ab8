"""Empty document tables, and tables without labels, give empty or plain results."""

from veriframe.llm import language, ordinal_quality, quality_rules, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def test_empty_documents(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.apply(docs, quality_rules.learn(docs, labels)).count() == 0
    ratings = spark.createDataFrame([], "doc_id long, grade int")
    assert ordinal_quality.score(docs, ordinal_quality.train(docs, ratings)).count() == 0
    assert language.identify(docs, language.train(docs)).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 0


def test_documents_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words of text", None, None, None, None), (2, None, None, "s", 1, 0.5), (None, "", None, None, 0, None)], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.apply(docs, quality_rules.learn(docs, labels)).count() == 3
    assert {r.lang_pred for r in language.identify(docs, language.train(docs)).collect()} == {"und"}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()} == {0.0}
