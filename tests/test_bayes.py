"""Bayes tables against the pipeline's classifier and on edges."""

import random

import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from opinara.operators import bayes, modelling
from opinara.workspace import new_folder


def _texts(spark, n=400):
    rng = random.Random(6)
    words = [[f"c{c}w{i}" for i in range(30)] + [f"any{i}" for i in range(40)] for c in range(3)]
    rows = []
    for i in range(n):
        c = rng.choice([0, 1, 2, 2, 2])
        rows.append((i, " ".join(rng.choices(words[c], k=rng.randint(0, 25))), c))
    return spark.createDataFrame(rows, "doc_id long, reviews string, sentiment int")


def test_equals_the_pipelines_classifier(spark):
    df = _texts(spark)
    train, _, _ = modelling.balanced_splits(df, "doc_id")
    fitted = modelling.fit(NaiveBayes(labelCol="sentiment", featuresCol="features"), train)
    expected = {r.doc_id: int(r.prediction) for r in fitted.transform(df).collect()}
    model = bayes.train_bayes(bayes.balanced_training(df, "doc_id"), "doc_id")
    words = bayes.filtered_tokens(df, "reviews")
    assert {r.doc_id: r.sentiment for r in bayes.score_bayes(words, model, "doc_id").collect()} == expected
    path = new_folder(spark, "bayes-test")
    model.save(path)
    again = bayes.BayesTables.load(spark, path)
    assert {r.doc_id: r.sentiment for r in bayes.score_bayes(words, again, "doc_id").collect()} == expected
    assert set(model.terms.toPandas()["term"]) == set(fitted.stages[2].vocabulary)


def test_no_vocabulary_in_the_plan(spark):
    df = _texts(spark, 50)
    model = bayes.train_bayes(bayes.balanced_training(df, "doc_id"), "doc_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = bayes.score_bayes(bayes.filtered_tokens(df, "reviews"), model, "doc_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan and "Python" not in plan and "UDF" not in plan


def test_frequent_terms_move_no_rows_of_theirs(spark, monkeypatch):
    df = _texts(spark)
    model = bayes.train_bayes(bayes.balanced_training(df, "doc_id"), "doc_id")
    odd = spark.createDataFrame([(1, ["c0w1", "c0w2"]), (1, ["c0w1"]), (None, ["any1", "c2w3"]), (900, ["unseen"]), (901, None)], "doc_id long, words array<string>")
    words = bayes.filtered_tokens(df, "reviews").select("doc_id", "words").unionByName(odd)
    scores = lambda: bayes.score_bayes(words, model, "doc_id")
    rows = lambda: sorted((r.doc_id or -1, r.sentiment) for r in scores().collect())
    whole = rows()
    monkeypatch.setattr(bayes, "FREQUENT", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = scores()._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
        assert rows() == whole
        monkeypatch.setattr(bayes, "FREQUENT", 0)
        assert rows() == whole
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_edges(spark):
    df = spark.createDataFrame([(1, ["a"] * 3, 0, 9), (2, ["b"], 2, 10), (3, [], 2, 1), (4, ["b"], 7, 5), (5, None, 0, 1)], "k int, words array<string>, sentiment int, copies int")
    model = bayes.train_bayes(df, "k", max_df=1.0)
    assert {r.term: r.df for r in model.terms.collect()} == {"a": 9, "b": 10}
    texts = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, []), (None, ["a"]), (5, None), (6, ["unseen"])], "k int, words array<string>")
    assert sorted((r.k or 0, r.sentiment) for r in bayes.score_bayes(texts, model, "k").collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (5, 2), (6, 2)]
    nothing = bayes.train_bayes(df.limit(0), "k")
    assert [r.sentiment for r in bayes.score_bayes(texts.where("k = 1"), nothing, "k").collect()] == [None]
    assert bayes.score_bayes(texts.limit(0), model, "k").count() == 0
    assert model.classes.where(F.col("sentiment") == 1).count() == 0


def test_repeated_words_of_a_lexicon(spark, monkeypatch):
    from opinara.operators import features

    docs = spark.createDataFrame([(1, "good bad good"), (2, "bad"), (3, "none")], "k int, t string").withColumn("sentiment", F.lit(1))
    lexicon = spark.createDataFrame([("good", 1.0), ("good", 0.5), ("bad", -1.0), ("none", None)], "word string, polarity double")
    rows = lambda: {r.k: round(r.polarity, 6) for r in features.feature_table(docs, "k", "t", lexicon).collect()}
    few = rows()
    monkeypatch.setattr(features, "IN_ROW", 1)
    assert few == rows() == {1: round((0.75 + 0.75 - 1) / 3, 6), 2: -1.0, 3: 0.0}


def test_texts_are_not_shuffled_to_their_labels(spark, tmp_path, monkeypatch):
    from opinara.plans import learning
    from opinara.plans import tables as t

    sf = str(tmp_path)
    docs = [(i, f"one{i % 3} two", "en", "s", 8) for i in range(60)] + [(7, "again", None, "s", 5), (None, "no key", "en", "s", 6), (61, None, "en", "s", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    labels = [(i, i % 2, i % 5 // 4) for i in range(0, 60, 2)] + [(6, 1, None), (7, 0, 1), (9, None, 1), (None, 1, 1), (999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    plan = lambda: learning.cleaned(learning.rated(spark, sf))._jdf.queryExecution().executedPlan().toString()
    rows = lambda: sorted(map(repr, t.documents(spark, sf).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in plan() and "hashpartitioning" not in plan()
        whole = rows()
        monkeypatch.setattr(t, "LABELS", len(labels) - 1)
        assert "SortMergeJoin" in plan()
        assert rows() == whole
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_models_are_trained_on_kept_rows(spark, tmp_path, monkeypatch):
    from opinara.plans import learning, streams

    sf = str(tmp_path)
    spark.createDataFrame([(1, "one two", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    class Seen(Exception):
        pass

    def fit(estimator, train):
        assert train.is_cached
        raise Seen

    monkeypatch.setattr(modelling, "fit", fit)
    for query in (streams.stream_scores, learning.score_bayes):
        with pytest.raises(Seen):
            query(spark, sf)
