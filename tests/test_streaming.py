"""Streams give what the batch operators give, whatever the number of batches, and survive restarts."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions.text import clean_text
from opinara.operators import aggregates, modelling
from opinara.sources import readers, sinks
from opinara.streaming import running, scoring
from opinara.workspace import new_folder

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("asin", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("sentiment_label", T.StringType()),
    ]
)
START = datetime(2024, 1, 1)


def make_events(n, seed=1):
    rng = random.Random(seed)
    return [
        (
            i,
            START + timedelta(seconds=30 * i),
            "HOT" if rng.random() < 1 / 3 else f"P{rng.randrange(12)}",
            rng.choice(["positive", "neutral", "negative", "odd"]),
            None,
        )
        for i in range(n)
    ]


def write_files(spark, folder, events, parts):
    """One file per part, in order."""
    size = -(-len(events) // parts)
    for k in range(parts):
        spark.createDataFrame(events[k * size : (k + 1) * size], EVENTS).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    return readers.stream_files(spark, folder, EVENTS, maxFilesPerTrigger=1)


@pytest.fixture(scope="module")
def events(spark):
    folder = new_folder(spark, "events")
    rows = make_events(900)
    write_files(spark, folder, rows, 5)
    return folder, spark.createDataFrame(rows, EVENTS).cache()


def rows_of(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()))


COUNTS = ["asin", "positive", "neutral", "negative"]


def batch_counters(df):
    return aggregates.known_events(df).groupBy("asin").agg(*aggregates.category_counts(F.col("category")))


def test_counters_over_several_batches(spark, events):
    folder, df = events
    out = new_folder(spark, "counters")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    with running.state_on_disk(spark):
        sink = running.versioned_rows(f"{out}/rows", ["asin"], every=2)
        sinks.run_available(running.running_counters(stream_of(spark, folder)), sink, f"{out}/cp", "counters", "update")
    assert spark.conf.get(provider) == before
    assert spark.read.parquet(f"{out}/rows/changes").select("batch_id").distinct().count() == 5
    now = running.current_rows(spark, f"{out}/rows", ["asin"], every=2)
    assert rows_of(now, COUNTS) == rows_of(batch_counters(df), COUNTS)
    assert {f.rsplit("/", 2)[1] for f in now.inputFiles()} == {"batch_id=3", "batch_id=4"}


def test_a_bad_date_does_not_stop_the_stream(spark):
    lines = [('{"asin":"A","date":"yesterday","reviewText":"x"}',), ('{"asin":"B","date":"2199-01-01"}',), ('{"asin":"C","date":"2024-03-05"}',)]
    got = scoring.records(spark.createDataFrame(lines, "value string"), collected=True).select("asin", "unixReviewTime").collect()
    assert dict(map(tuple, got)) == {"A": None, "B": None, "C": 1709596800}


def test_running_top_over_several_batches(spark, events):
    folder, df = events
    order = [F.desc("total"), F.col("asin")]
    total = aggregates.total_of_counts()
    out = new_folder(spark, "top")
    stream = running.running_counters(stream_of(spark, folder)).withColumn("total", total)
    sinks.run_available(stream, running.best_so_far(f"{out}/rows", order, 5, key="asin"), f"{out}/cp", "top", "update")
    expected = batch_counters(df).withColumn("total", total).orderBy(*order).limit(5)
    assert rows_of(running.current_best(spark, f"{out}/rows"), ["asin", "total"]) == rows_of(expected, ["asin", "total"])


def test_running_latest_over_several_batches(spark, events):
    folder, df = events
    order = [F.desc("ts"), F.col("event_id")]
    out = new_folder(spark, "latest")
    sinks.run_available(stream_of(spark, folder), running.best_so_far(f"{out}/rows", order, 100), f"{out}/cp", "latest")
    assert rows_of(running.current_best(spark, f"{out}/rows"), ["event_id"]) == rows_of(df.orderBy(*order).limit(100), ["event_id"])


def test_hourly_append_leaves_open_hours_and_late_rows_out(spark):
    folder = new_folder(spark, "late")
    on_time = make_events(600)
    late = [(9000, START + timedelta(minutes=1), "HOT", "positive", None)]
    write_files(spark, folder, on_time, 2)
    spark.createDataFrame(late, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    out = new_folder(spark, "hourly")
    sinks.run_available(running.hourly_counts(stream_of(spark, folder)), sinks.batch_folder(f"{out}/rows"), f"{out}/cp", "hourly", "append")
    got = {(r["hour"], r["category"]): r["n"] for r in spark.read.parquet(f"{out}/rows").collect()}
    closed = START + timedelta(hours=3)
    expected = {}
    for _, ts, _, category, _ in on_time:
        hour = ts.replace(minute=0, second=0)
        if category != "odd" and hour < closed:
            expected[hour, category] = expected.get((hour, category), 0) + 1
    assert got == expected


def test_redelivered_records_are_dropped(spark):
    folder = new_folder(spark, "redelivered")
    first = make_events(100)
    write_files(spark, folder, first, 1)
    write_files(spark, folder, [(i, ts + timedelta(seconds=5), *rest) for i, ts, *rest in first], 1)
    out = new_folder(spark, "dedup")
    stream = running.drop_redelivered(stream_of(spark, folder), ["asin", "event_id"], "ts", "1 day")
    sinks.run_available(stream, sinks.batch_folder(f"{out}/rows"), f"{out}/cp", "dedup")
    assert spark.read.parquet(f"{out}/rows").count() == 100


def test_restart_resumes_without_repeats(spark):
    folder, out = new_folder(spark, "restart"), new_folder(spark, "restart-out")
    rows = make_events(200)
    write_files(spark, folder, rows[:100], 1)
    for part in (rows[100:], []):
        sinks.run_available(stream_of(spark, folder), sinks.batch_folder(f"{out}/rows"), f"{out}/cp", "restart")
        if part:
            write_files(spark, folder, part, 1)
    stored = spark.read.parquet(f"{out}/rows")
    assert stored.count() == 200 and stored.select("event_id").distinct().count() == 200


def test_replayed_batch_replaces_itself(spark):
    out = new_folder(spark, "replay")
    batch = spark.createDataFrame(make_events(50), EVENTS)
    best = running.best_so_far(f"{out}/best", [F.desc("ts"), F.col("event_id")], 10)
    for sink in (sinks.batch_folder(f"{out}/rows"), best):
        sink(batch, 0)
        sink(batch, 0)
    assert spark.read.parquet(f"{out}/rows").count() == 50
    assert running.current_best(spark, f"{out}/best").count() == 10


def test_fan_out_writes_everywhere_and_fails_loudly(spark, events, capsys):
    folder, df = events
    out = new_folder(spark, "fan")
    sink = sinks.fan_out(sinks.batch_folder(f"{out}/a"), sinks.console_sink(1), sinks.batch_folder(f"{out}/b"))
    sinks.run_available(stream_of(spark, folder), sink, f"{out}/cp", "fan")
    assert spark.read.parquet(f"{out}/a").count() == spark.read.parquet(f"{out}/b").count() == df.count()
    assert "batch 0" in capsys.readouterr().out

    def broken(batch, batch_id):
        raise OSError("sink is down")

    with pytest.raises(Exception, match="sink is down"):
        sinks.run_available(stream_of(spark, folder), sinks.fan_out(broken), f"{out}/cp2", "broken")


def test_malformed_json(spark):
    lines = ["not json", '{"overall":"bad","reviewText":"y"}', '{"reviewText":"z","extra":1}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = scoring.records(df).select("reviewText", "overall").collect()
    assert [(r["reviewText"], r["overall"]) for r in got] == [(None, None), ("y", None), ("z", None)]
    assert "extra" not in scoring.records(df).columns


def test_envelope_omits_nulls(spark):
    df = spark.createDataFrame([("A", "r1", None)], "asin string, review_id string, title string")
    row = sinks.kafka_envelope(df).first()
    assert (row["key"], row["value"]) == ("A_r1", '{"asin":"A","review_id":"r1"}')


def training_rows(n=240):
    rng = random.Random(5)
    words = {0: "awful broken poor", 1: "average fine okay", 2: "great lovely superb"}
    rows = []
    for i in range(n):
        s = 2 if i % 2 else rng.choice([0, 1])
        text = " ".join(rng.choice(words[s].split()) if rng.random() < 0.8 else "thing" for _ in range(8))
        rows.append((i, text, "sum", [1.0, 3.0, 5.0][s]))
    return rows


@pytest.fixture(scope="module")
def prepared(spark):
    raw = spark.createDataFrame(training_rows(), "doc_id int, reviewText string, summary string, overall double")
    return scoring.prepare_training(raw).cache()


def test_training_chooses_the_best_and_skips_failures(spark, prepared, monkeypatch):
    best, candidates, test = modelling.train_and_choose(prepared, "doc_id", reg=[0.01, 1.0], elastic=[0.0], folds=2)
    assert [x.name for x in candidates] == ["LogisticRegression", "RandomForest", "NaiveBayes"]
    assert best.accuracy == max(x.accuracy for x in candidates)
    assert best is next(x for x in candidates if x.accuracy == best.accuracy)
    board = modelling.leaderboard(spark, candidates, best).collect()
    assert [r["model"] for r in board if r["chosen"]] == [best.name]
    assert test.where("copy IS NOT NULL").count() == 0 if "copy" in test.columns else test.count() > 0

    def fail(*_):
        raise RuntimeError("no fit")

    monkeypatch.setattr(modelling, "fit", fail)
    with pytest.raises(RuntimeError, match="no model"):
        modelling.train_and_choose(prepared, "doc_id", names=["NaiveBayes"])


def test_saved_model_scores_the_same_and_stream_equals_batch(spark, prepared):
    model = modelling.fit(modelling.classifiers()["NaiveBayes"], prepared)
    path = new_folder(spark, "model")
    modelling.save_model(model, path)
    loaded = modelling.load_model(path)
    records = spark.createDataFrame(
        [(f"R{i}", "B1", t, s) for i, t, s, _ in training_rows(60)] + [("RX", "B1", None, "s"), ("RY", "B1", "Great [x] superb 4you", None)],
        "reviewerID string, asin string, reviewText string, summary string",
    )
    lines = sinks.json_envelope(records)
    batch = scoring.score_stream(lines, model)
    again = scoring.score_stream(lines, loaded)
    columns = ["reviewerID", "sentiment", "sentiment_label"]
    expected = rows_of(batch, columns)
    assert expected == rows_of(again, columns) and len(expected) == 61
    folder, out = new_folder(spark, "topic"), new_folder(spark, "scored")
    lines.repartition(3).write.text(folder)
    stream = readers.stream_files(spark, folder, T.StructType([T.StructField("value", T.StringType())]), "text", maxFilesPerTrigger=1)
    sinks.run_available(scoring.score_stream(stream, model), sinks.batch_folder(f"{out}/rows"), f"{out}/cp", "scores")
    assert rows_of(spark.read.parquet(f"{out}/rows"), columns) == expected


def test_collected_records_are_scored(spark, prepared):
    model = modelling.fit(modelling.classifiers()["NaiveBayes"], prepared)
    raw = spark.createDataFrame([("Ann", "B1", "R1", "superb", 5.0, "great great lovely", "2024-03-05", 1, 2, "2024-03-06 10:00")],
        "reviewer_name string, asin string, review_id string, title string, overall double, reviewText string, date string, helpful_votes int, total_votes int, scrape_time string")
    row = scoring.score_stream(sinks.json_envelope(raw), model, collected=True).first()
    assert (row["reviewerName"], row["summary"], row["reviewTime"], row["sentiment_label"]) == ("Ann", "superb", "2024-03-05", "Positive")


def test_fits_take_the_cores_and_the_memory_there_are(spark, prepared):
    features = modelling.fit_features(prepared)
    rows = features.transform(prepared).select("features").repartition(40).cache()
    cores = spark.sparkContext.defaultParallelism
    assert modelling.in_tasks(rows, None).rdd.getNumPartitions() == 40
    assert modelling.in_tasks(rows, None, fits=1).rdd.getNumPartitions() == cores
    assert modelling.in_tasks(rows, 1, fits=4).rdd.getNumPartitions() == max(1, cores // 4)
    assert modelling.in_tasks(rows, 10_000).rdd.getNumPartitions() == 1
    rows.unpersist()
    assert modelling.fits_at_once(spark, features, 8) == 8
    heap = spark.sparkContext._jvm.Runtime.getRuntime().maxMemory()

    class Wide(CountVectorizerModel):
        def __init__(self):
            pass

        _java_obj = None
        vocabulary = range(heap // 2_000)

    assert modelling.fits_at_once(spark, SimpleNamespace(stages=[Wide()]), 8) == 1


def test_training_preparation(spark):
    raw = spark.createDataFrame([(None, "s", 3.0), ("x", None, 1.0), ("Good [a]", "!", None)], "reviewText string, summary string, overall double")
    got = scoring.prepare_training(raw).select("reviews", "sentiment").collect()
    assert [tuple(r) for r in got] == [("missings", 1), (clean_of("good ", spark), 2)]


def clean_of(text, spark):
    return spark.createDataFrame([(text,)], "t string").select(clean_text(F.col("t"))).first()[0]
