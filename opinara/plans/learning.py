"""Queries on splits, models and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions.labels import label_from_rating, sentiment_label
from opinara.functions.text import clean_text
from opinara.operators import aggregates, bayes, features, metrics, modelling, sampling, training
from opinara.plans import tables as t
from opinara.plans.registry import query
from opinara.plans.text import TERM_COUNTS
from opinara.workspace import new_folder, stored

RD = "WITH " + t.DOCUMENTS_SQL + "\n"
PR = "WITH " + t.PREDICTIONS_SQL


def _hash_sql(purpose: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('{purpose}:42:' || {key}), 1, 6) AS BIGINT)"


_RATED_SQL = f""", h AS (SELECT doc_id, CASE WHEN overall = 3 THEN 1 WHEN overall IN (1, 2) THEN 0 ELSE 2 END AS sentiment,
  {_hash_sql("split", "doc_id")} % 10 AS b FROM rd WHERE overall IS NOT NULL),
sp AS (SELECT doc_id, sentiment, CASE WHEN b < 8 THEN 'train' WHEN b < 9 THEN 'validation' ELSE 'test' END AS split FROM h)
"""


def rated(spark, sf):
    """Documents with a rating: the rows models are trained and tested on."""
    rows = t.documents(spark, sf).where(F.col("overall").isNotNull())
    return rows.select("doc_id", "review_text", label_from_rating(F.col("overall")).alias("sentiment"))


def cleaned(df):
    return df.select("doc_id", clean_text(F.col("review_text")).alias("reviews"), "sentiment")


@query("hash_split", RD + _RATED_SQL + "SELECT doc_id, sentiment, split FROM sp")
def hash_split(spark, sf):
    return sampling.hash_split(rated(spark, sf).select("doc_id", "sentiment"), "doc_id")


@query(
    "oversample_balanced",
    RD
    + _RATED_SQL
    + f""", tr AS (SELECT doc_id, sentiment FROM sp WHERE split = 'train'),
c AS (SELECT sentiment, count(*) AS n FROM tr GROUP BY 1),
f AS (SELECT tr.doc_id, tr.sentiment, (SELECT max(n) FROM c) / c.n AS f, {_hash_sql("copy", "tr.doc_id")} / 16777216.0 AS u
  FROM tr JOIN c ON tr.sentiment = c.sentiment),
k AS (SELECT doc_id, sentiment, floor(f) + CASE WHEN u < f - floor(f) THEN 1 ELSE 0 END AS k FROM f)
SELECT doc_id, sentiment, unnest(range(1, CAST(k AS BIGINT) + 1)) AS copy FROM k""",
)
def oversample_balanced(spark, sf):
    parts = hash_split(spark, sf)
    return sampling.oversample(parts.where("split = 'train'").drop("split"), "doc_id").select("doc_id", "sentiment", "copy")


# Quality of rule-made predictions

_CELLS = ", ".join(f"count(*) FILTER (sentiment = {i} AND prediction = {j}) AS c{i}{j}" for i in range(3) for j in range(3))
_CM = PR + f", cm AS (SELECT {_CELLS} FROM pr)\n"
_NAMES = ["Negative", "Neutral", "Positive"]


def _div(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif({b}, 0), 0.0)"


def _support(i: int) -> str:
    return f"(c{i}0 + c{i}1 + c{i}2)"


def _precision(i: int) -> str:
    return _div(f"c{i}{i}", f"(c0{i} + c1{i} + c2{i})")


def _recall(i: int) -> str:
    return _div(f"c{i}{i}", _support(i))


def _f1(i: int) -> str:
    return _div(f"2 * {_precision(i)} * {_recall(i)}", f"({_precision(i)} + {_recall(i)})")


def _specificity(i: int) -> str:
    a, b = [k for k in range(3) if k != i]
    tn = f"(c{a}{a} + c{a}{b} + c{b}{a} + c{b}{b})"
    return _div(tn, f"({tn} + c{a}{i} + c{b}{i})")


_TOTAL = f"({_support(0)} + {_support(1)} + {_support(2)})"
_ACCURACY = _div("c00 + c11 + c22", _TOTAL)


def _weighted(metric) -> str:
    return _div(" + ".join(f"{metric(i)} * {_support(i)}" for i in range(3)), _TOTAL)


def _macro(metric) -> str:
    return "(" + " + ".join(metric(i) for i in range(3)) + ") / 3"


def _union(rows: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {row} FROM cm" for row in rows)


def _counts(spark, sf):
    return metrics.confusion_counts(t.predictions(spark, sf))


@query("confusion_matrix", _CM + _union([f"{i} AS label, {j} AS prediction, c{i}{j} AS n" for i in range(3) for j in range(3)]))
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_counts(spark, sf))


@query(
    "confusion_normalised",
    _CM + _union([f"{i} AS label, {j} AS prediction, {_div(f'c{i}{j}', _support(i))} AS rate" for i in range(3) for j in range(3)]),
)
def confusion_normalised(spark, sf):
    return metrics.confusion_matrix(_counts(spark, sf), normalise=True)


@query("accuracy_f1", _CM + f"SELECT {_ACCURACY} AS accuracy, {_weighted(_f1)} AS f1 FROM cm")
def accuracy_f1(spark, sf):
    return metrics.accuracy_f1(_counts(spark, sf))


@query(
    "class_metrics",
    _CM
    + _union(
        [f"'{n}' AS class, {_precision(i)} AS precision, {_recall(i)} AS recall, {_f1(i)} AS f1, {_support(i)} AS support" for i, n in enumerate(_NAMES)]
        + [
            f"'{n}' AS class, {m(_precision)} AS precision, {m(_recall)} AS recall, {m(_f1)} AS f1, {_TOTAL} AS support"
            for n, m in (("macro avg", _macro), ("weighted avg", _weighted))
        ]
    ),
)
def class_metrics(spark, sf):
    return metrics.class_metrics(_counts(spark, sf))


@query("class_specificity", _CM + _union([f"'{n}' AS class, {_specificity(i)} AS specificity" for i, n in enumerate(_NAMES)]))
def class_specificity(spark, sf):
    return metrics.class_specificity(_counts(spark, sf))


@query(
    "model_statistics",
    _CM
    + _union(
        [
            f"'overall' AS scope, 'all' AS class, '{m}' AS metric, CAST({v} AS DOUBLE) AS value"
            for m, v in (("accuracy", _ACCURACY), ("precision", _weighted(_precision)), ("recall", _weighted(_recall)), ("f1", _weighted(_f1)))
        ]
        + [
            f"'class' AS scope, '{n}' AS class, '{m}' AS metric, CAST({v(i)} AS DOUBLE) AS value"
            for i, n in enumerate(_NAMES)
            for m, v in (("precision", _precision), ("recall", _recall), ("f1", _f1), ("specificity", _specificity))
        ]
        + [
            f"'confusion' AS scope, '{_NAMES[i]}' AS class, '{_NAMES[j]}' AS metric, CAST(c{i}{j} AS DOUBLE) AS value"
            for i in range(3)
            for j in range(3)
        ]
    ),
)
def model_statistics(spark, sf):
    return metrics.model_statistics(_counts(spark, sf))


@query("prediction_distribution", PR + "SELECT prediction, count(*) AS n FROM pr GROUP BY 1 ORDER BY 1")
def prediction_distribution(spark, sf):
    return aggregates.class_distribution(t.predictions(spark, sf), "prediction")


# Trained models. Bayes is arithmetic that SQL can repeat; for the others SQL states what must hold on the same splits.


def trained(spark, sf, name: str):
    train, _, _ = modelling.balanced_splits(cleaned(rated(spark, sf)), "doc_id")
    model = modelling.fit(modelling.classifiers()[name], train.persist())
    train.unpersist()
    return model


def _scored(spark, sf, model):
    texts = t.texts(spark, sf).select("doc_id", clean_text(F.col("review_text")).alias("reviews"))
    code = F.col("prediction")
    return model.transform(texts).select("doc_id", code.cast("int").alias("sentiment"), sentiment_label(code).alias("sentiment_label"))


_FACTS_SQL = (
    RD
    + _RATED_SQL
    + """SELECT coalesce(sp.split, 'unrated') AS split, count(*) AS n, true AS in_domain, true AS learned
FROM documents d LEFT JOIN sp ON d.doc_id = sp.doc_id GROUP BY 1"""
)


def _score_facts(spark, sf, name: str):
    """Per split: rows scored, whether all scores are classes, and whether training rows are met as often as by naming their largest class."""
    scores = _scored(spark, sf, trained(spark, sf, name)).select("doc_id", F.col("sentiment").alias("given"))
    true = hash_split(spark, sf)
    met = F.avg((F.col("given") == F.col("sentiment")).cast("double"))
    largest = F.greatest(*[F.avg((F.col("sentiment") == c).cast("double")) for c in (0, 1, 2)])
    return (
        scores.join(true, "doc_id", "left")
        .groupBy(F.coalesce("split", F.lit("unrated")).alias("split"))
        .agg(F.count(F.lit(1)).alias("n"), F.every(F.col("given").between(0, 2)).alias("in_domain"), met.alias("met"), largest.alias("largest"))
        .select("split", "n", "in_domain", F.when(F.col("split") == "train", F.col("met") >= F.col("largest")).otherwise(True).alias("learned"))
    )


@query("score_logistic", _FACTS_SQL)
def score_logistic(spark, sf):
    return _score_facts(spark, sf, "LogisticRegression")


@query("score_forest", _FACTS_SQL)
def score_forest(spark, sf):
    return _score_facts(spark, sf, "RandomForest")


def bayes_sql(texts: str, result: str) -> str:
    """SQL for scores of the Bayes model: trained on the balanced training part, on TF-IDF of its copies, with smoothing 1.

    ``texts`` gives ``tg(doc_id, term, tf)`` of the texts to score, ``result`` selects from ``best(doc_id, sentiment)``.
    """
    return f"""WITH {t.DOCUMENTS_SQL}, {TERM_COUNTS}{_RATED_SQL},
tr AS (SELECT doc_id, sentiment FROM sp WHERE split = 'train'), n AS (SELECT sentiment, count(*) AS n FROM tr GROUP BY 1),
f AS (SELECT tr.doc_id, tr.sentiment, (SELECT max(n) FROM n) / n.n AS f, {_hash_sql("copy", "tr.doc_id")} / 16777216.0 AS u FROM tr JOIN n ON tr.sentiment = n.sentiment),
k AS (SELECT doc_id, sentiment, floor(f) + CASE WHEN u < f - floor(f) THEN 1 ELSE 0 END AS k FROM f),
c AS (SELECT sentiment, sum(k) AS n FROM k GROUP BY 1), m AS (SELECT sum(n) AS m, count(*) AS classes FROM c),
d AS (SELECT term, sum(k) AS df FROM tf JOIN k ON tf.doc_id = k.doc_id GROUP BY term),
idf AS (SELECT term, ln((m + 1) / (df + 1)) AS idf FROM d, m WHERE df >= 5 AND df <= 0.8 * m),
x AS (SELECT sentiment, tf.term, sum(k * tf * idf) AS s FROM tf JOIN k ON tf.doc_id = k.doc_id JOIN idf ON tf.term = idf.term GROUP BY 1, 2),
w AS (SELECT c.sentiment, ln(c.n + 1) - ln(m + classes) AS prior, ln((SELECT sum(s) FROM x WHERE x.sentiment = c.sentiment) + (SELECT count(*) FROM idf)) AS norm FROM c, m),
{texts},
v AS (SELECT doc_id, tg.term, tf * idf AS v FROM tg JOIN idf ON tg.term = idf.term), vs AS (SELECT doc_id, sum(v) AS v FROM v GROUP BY 1),
vx AS (SELECT doc_id, sentiment, sum(v * ln(1 + s)) AS a FROM v JOIN x ON v.term = x.term GROUP BY 1, 2),
p AS (SELECT dd.doc_id, w.sentiment, prior + coalesce(a, 0) - coalesce(vs.v, 0) * norm AS p FROM documents dd CROSS JOIN w
  LEFT JOIN vs ON dd.doc_id = vs.doc_id LEFT JOIN vx ON dd.doc_id = vx.doc_id AND w.sentiment = vx.sentiment),
best AS (SELECT doc_id, CAST(arg_max(sentiment, p) AS INTEGER) AS sentiment FROM p GROUP BY doc_id)
{result}"""


LABEL_SQL = "CASE best.sentiment WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' ELSE 'Positive' END AS sentiment_label"


@query("score_bayes", bayes_sql("tg AS (SELECT * FROM tf)", f"SELECT doc_id, sentiment, {LABEL_SQL} FROM best"))
def score_bayes(spark, sf):
    return _scored(spark, sf, trained(spark, sf, "NaiveBayes"))


def _bayes_tables(spark, sf):
    return bayes.train_bayes(bayes.balanced_training(cleaned(rated(spark, sf)), "doc_id"), "doc_id")


@query("score_bayes_tables", bayes_sql("tg AS (SELECT * FROM tf)", f"SELECT doc_id, sentiment, {LABEL_SQL} FROM best"))
def score_bayes_tables(spark, sf):
    """Scores of the model kept as tables, stored and loaded."""
    path = new_folder(spark, "bayes")
    _bayes_tables(spark, sf).save(path)
    texts = t.texts(spark, sf).select("doc_id", clean_text(F.col("review_text")).alias("reviews"))
    words = features.filtered_tokens(texts, "reviews").select("doc_id", "words")
    scores = bayes.score_bayes(words, bayes.BayesTables.load(spark, path), "doc_id")
    return scores.select("doc_id", "sentiment", sentiment_label(F.col("sentiment")).alias("sentiment_label"))


@query(
    "bayes_weights",
    bayes_sql("tg AS (SELECT * FROM tf)", "SELECT idf.term, CAST(w.sentiment AS INTEGER) AS sentiment, round(idf, 9) AS idf, round(coalesce(ln(1 + s), 0), 6) AS weight "
              "FROM idf CROSS JOIN w LEFT JOIN x ON idf.term = x.term AND w.sentiment = x.sentiment"),
)
def bayes_weights(spark, sf):
    """The model itself: each term's weight in each class."""
    model = _bayes_tables(spark, sf)
    weights = F.inline(F.array(*[F.struct(F.lit(c).alias("sentiment"), F.col(f"w{c}").alias("w")) for c in bayes.CLASSES]))
    return model.terms.select("term", F.round("idf", 9).alias("idf"), weights).withColumn("weight", F.round("w", 6)).drop("w")


@query("pipeline_scores", bayes_sql("tg AS (SELECT * FROM tf)", f"SELECT doc_id, sentiment, {LABEL_SQL} FROM best"))
def pipeline_scores(spark, sf):
    """Scores of a whole pipeline fitted as one, from text to prediction."""
    train, _, _ = modelling.balanced_splits(cleaned(rated(spark, sf)), "doc_id")
    return _scored(spark, sf, modelling.pipeline("NaiveBayes").fit(train))


@query("saved_model_scores", "SELECT doc_id, true AS equal FROM documents")
def saved_model_scores(spark, sf):
    """Whether a model gives the same scores after it was stored and loaded.

    The first scores are written before the second are made, so that a task never has two models with their vocabularies.
    """
    model, path = trained(spark, sf, "NaiveBayes"), new_folder(spark, "model")
    modelling.save_model(model, path)
    before = stored(_scored(spark, sf, model).select("doc_id", F.col("sentiment").alias("before")), "scores")
    after = _scored(spark, sf, modelling.load_model(path)).join(before, "doc_id")
    return after.select("doc_id", (F.col("sentiment") == F.col("before")).alias("equal"))


@query(
    "model_leaderboard",
    "SELECT * FROM (VALUES ('LogisticRegression', false, true), ('RandomForest', false, true), ('NaiveBayes', false, true)) v(model, failed, rightly_chosen)",
)
def model_leaderboard(spark, sf):
    """The candidates, and whether the first of the most accurate ones, and no other, is the chosen one."""
    best, candidates, _ = modelling.train_and_choose(cleaned(rated(spark, sf)), "doc_id", rows_per_task=1_000)
    first = next(c.name for c in candidates if c.accuracy == max(x.accuracy for x in candidates))
    board = modelling.leaderboard(spark, candidates, best)
    rightly = F.col("chosen") == (F.col("model") == first)
    return board.select("model", F.col("error").isNotNull().alias("failed"), rightly.alias("rightly_chosen"))


@query(
    "training_report",
    RD
    + f""", h AS (SELECT CASE WHEN overall = 3 THEN 'Neutral' WHEN overall IN (1, 2) THEN 'Negative' ELSE 'Positive' END AS class,
  {_hash_sql("split", "md5(review_text || chr(10) || summary)")} % 10 AS b FROM rd WHERE overall IS NOT NULL AND summary IS NOT NULL)
SELECT c.class, (SELECT count(*) FROM h WHERE h.class = c.class AND b = 9) AS n, true AS in_range, CAST(3 AS BIGINT) AS candidates
FROM (VALUES ('Negative'), ('Neutral'), ('Positive')) c(class)""",
)
def training_report(spark, sf):
    """The whole training job over the rated documents as a file, with all candidates, the regression's grid and its folds.

    From what it has written: the test rows of each class, whether all overall figures are between 0 and 1 with the recall being the
    accuracy, and how many candidates could be trained.
    """
    folder = new_folder(spark, "training")
    rows = t.documents(spark, sf).where(F.col("overall").isNotNull())
    rows.select(F.col("review_text").alias("reviewText"), "summary", "overall").write.json(f"{folder}/reviews")
    training.run_training(spark, f"{folder}/reviews", f"{folder}/report", f"{folder}/model", f"{folder}/board", rows_per_task=1_000)
    report = spark.read.parquet(f"{folder}/report")
    overall = F.col("scope") == "overall"
    figure = lambda name: F.max(F.when(overall & (F.col("metric") == name), F.col("value")))
    ranges = report.agg(
        (F.every(F.when(overall, F.col("value").between(0, 1))) & (F.abs(figure("recall") - figure("accuracy")) < 1e-9)).alias("in_range")
    )
    trained = spark.read.parquet(f"{folder}/board").agg(F.count_if(F.col("error").isNull()).alias("candidates"))
    cells = report.where("scope = 'confusion'").groupBy("class").agg(F.sum("value").cast("long").alias("n"))
    return cells.withColumns({"in_range": ranges.scalar(), "candidates": trained.scalar()})
