"""Queries on sources, sinks and streams. Streams work off what is there and the stored result is read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions.labels import canonical_category
from opinara.operators import aggregates, filters, modelling, rollup
from opinara.plans import learning
from opinara.plans import tables as t
from opinara.plans.registry import query
from opinara.plans.text import words_sql
from opinara.schema import EXPORT_COLUMNS, REVIEW_SCHEMA
from opinara.sources import readers, sinks
from opinara.sources.keyed import KeyedTable
from opinara.streaming import running, scoring, versions
from opinara.workspace import names_in, new_folder

RV = "WITH " + t.REVIEWS_SQL + "\n"
RD = "WITH " + t.DOCUMENTS_SQL + "\n"
EV = "WITH " + t.EVENTS_SQL + "\n"
FACTS = ", ".join(t.FACT_COLUMNS)


def _ntz(df, *columns):
    """Times without zone, as the test tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# Batch sources and sinks


def _canonical(spark, sf):
    return t.reviews(spark, sf).select(
        "review_id",
        "asin",
        "reviewer_id",
        "reviewer_name",
        "title",
        F.lit(None).cast("string").alias("review_text"),
        "overall",
        F.col("review_ts").cast("timestamp").alias("review_ts"),
        "helpful_votes",
        F.col("helpful_votes").alias("total_votes"),
        F.col("review_ts").cast("timestamp").alias("scrape_ts"),
    )


_CANONICAL_SQL = """SELECT review_id, asin, reviewer_id, reviewer_name, title, CAST(NULL AS VARCHAR) AS review_text, overall, review_ts,
helpful_votes, helpful_votes AS total_votes, review_ts AS scrape_ts FROM rv"""


@query("scan_reviews_json", RV + _CANONICAL_SQL)
def scan_reviews_json(spark, sf):
    path = new_folder(spark, "reviews-json")
    # The lines are about nine times their compressed size; a file is one writer's, so one reader's is no more.
    _canonical(spark, sf).write.option("compression", "gzip").json(path)
    return _ntz(readers.read_reviews(spark, path, REVIEW_SCHEMA), "review_ts", "scrape_ts")


@query(
    "kafka_envelope",
    RV
    + """SELECT asin || '_' || review_id AS key, '{"asin":"' || asin || '","review_id":"' || review_id || '","reviewer_name":"' || reviewer_name ||
'","title":"' || title || '","overall":' || overall || ',"helpful_votes":' || helpful_votes || ',"date":"' || strftime(review_ts, '%Y-%m-%d') || '"}' AS value FROM rv""",
)
def kafka_envelope(spark, sf):
    record = t.reviews(spark, sf).select(
        "asin", "review_id", "reviewer_name", "title", "overall", "helpful_votes", F.date_format("review_ts", "yyyy-MM-dd").alias("date")
    )
    return sinks.kafka_envelope(record)


@query("json_envelope", RD + "SELECT doc_id, review_text, overall, lang FROM rd")
def json_envelope(spark, sf):
    rows = t.documents(spark, sf).select("doc_id", "review_text", "overall", "lang")
    return readers.parse_json(sinks.json_envelope(rows), rows.schema)


@query("parse_json_events", EV + "SELECT event_id, asin, category, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM ev")
def parse_json_events(spark, sf):
    rows = t.as_events(t.table(spark, sf, "events")).withColumn("category", canonical_category(F.col("sentiment")))
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    return readers.parse_json(rows, schema, "props", keep=("event_id", "asin", "category"))


def _export_rows(spark, sf):
    none = F.lit(None).cast("string")
    return t.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("reviewerID"),
        "asin",
        F.col("lang").alias("reviewer_name"),
        F.col("summary").alias("title"),
        "overall",
        F.col("review_text").alias("reviewText"),
        none.alias("date"),
        F.lit(0).alias("helpful_votes"),
        F.lit(0).alias("total_votes"),
        none.alias("scrape_time"),
    )


_EXPORT_SQL = """SELECT CAST(doc_id AS VARCHAR) AS reviewerID, asin, lang AS reviewer_name, summary AS title, overall, review_text AS reviewText,
CAST(NULL AS VARCHAR) AS date, 0 AS helpful_votes, 0 AS total_votes, CAST(NULL AS VARCHAR) AS scrape_time FROM rd"""


def _export_roundtrip(spark, sf, fmt: str):
    path = new_folder(spark, f"export-{fmt}")
    rows = _export_rows(spark, sf)
    sinks.export_reviews(rows, path, fmt)
    return readers.read_export(spark, path, fmt, rows.select(*EXPORT_COLUMNS).schema)


@query("export_csv_roundtrip", RD + _EXPORT_SQL)
def export_csv_roundtrip(spark, sf):
    return _export_roundtrip(spark, sf, "csv")


@query("export_json_roundtrip", RD + _EXPORT_SQL)
def export_json_roundtrip(spark, sf):
    return _export_roundtrip(spark, sf, "json")


def _results(spark, sf, **conditions):
    """Results of the last 90 days, read back from storage."""
    path = new_folder(spark, "results")
    facts = t.facts_only(spark, sf)
    sinks.write_results(facts, path)
    return readers.read_results(spark, path, time_range="last-90d", as_of=filters.latest_time(facts), **conditions).select(*t.FACT_COLUMNS)


_RECENT = RV + f"SELECT {FACTS} FROM rv WHERE review_ts >= (SELECT max(review_ts) FROM rv) - INTERVAL 90 DAY"


@query("read_results", _RECENT)
def read_results(spark, sf):
    return _results(spark, sf)


@query("read_results_latest", _RECENT + " ORDER BY review_ts DESC, " + ", ".join(["review_id", *[c for c in t.FACT_COLUMNS if c not in ("review_ts", "review_id")]]) + " LIMIT 50")
def read_results_latest(spark, sf):
    return _results(spark, sf, limit=50)


# Streams


def _stream(spark, sf, name: str):
    """A test table as a stream. The pattern matches its one name; a stream takes a plain path for a folder."""
    schema = t.table(spark, sf, name).schema
    return readers.stream_files(spark, f"{sf}/{name}[.]parquet", schema)


def _stored(spark, stream, name: str, mode: str = "append", sink=sinks.batch_folder) -> str:
    """Runs a stream to the end of its input and returns where its batches are."""
    folder = new_folder(spark, name)
    with running.state_on_disk(spark):
        sinks.run_available(stream, sink(f"{folder}/rows"), f"{folder}/checkpoint", folder.rsplit("/", 1)[1], mode)
    return f"{folder}/rows"


@query("stream_source", EV + "SELECT event_id, ts, asin, category, props FROM ev")
def stream_source(spark, sf):
    path = _stored(spark, t.as_events(_stream(spark, sf, "events")), "stream-source")
    rows = spark.read.parquet(path).withColumn("category", canonical_category(F.col("sentiment")))
    return _ntz(rows, "ts").select("event_id", "ts", "asin", "category", "props")


@query(
    "stream_sink_batches",
    "SELECT l_orderkey || '-' || l_linenumber AS review_id, 'P' || l_partkey AS asin, l_shipdate AS review_ts FROM lineitem",
)
def stream_sink_batches(spark, sf):
    rows = _stream(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("review_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("asin"),
        F.col("l_shipdate").alias("review_ts"),
    )
    return spark.read.parquet(_stored(spark, rows, "stream-sink")).drop("batch_id")


_EV_COUNTS = """SELECT asin, count(*) FILTER (category = 'positive') AS positive, count(*) FILTER (category = 'neutral') AS neutral,
count(*) FILTER (category = 'negative') AS negative"""


def _counters(spark, sf):
    return running.running_counters(t.as_events(_stream(spark, sf, "events")))


@query("stream_counters", EV + _EV_COUNTS + " FROM ev GROUP BY asin")
def stream_counters(spark, sf):
    path = _stored(spark, _counters(spark, sf), "stream-counters", "update", lambda p: running.versioned_rows(p, ["asin"]))
    return running.current_rows(spark, path, ["asin"])


@query(
    "stream_counters_retained",
    EV + _EV_COUNTS + ", true AS few_folders FROM ev GROUP BY asin",
)
def stream_counters_retained(spark, sf):
    """Counters over a stream of many batches: after all of them, and whether only those folders are left that reading and a replay need."""
    every, folder = 3, new_folder(spark, "events-by-batch")
    t.table(spark, sf, "events").repartition(11).write.parquet(folder)
    files = readers.stream_files(spark, folder, t.table(spark, sf, "events").schema, maxFilesPerTrigger=1)
    counters = running.running_counters(t.as_events(files))
    path = _stored(spark, counters, "retained-counters", "update", lambda p: running.versioned_rows(p, ["asin"], every))
    few = len(names_in(spark, f"{path}/changes")) <= 2 * every and len(names_in(spark, f"{path}/snapshots")) <= 2
    return running.current_rows(spark, path, ["asin"], every).withColumn("few_folders", F.lit(few))


@query(
    "stream_sink_tiers",
    "SELECT event_id, ts, 'U' || user_id AS asin FROM events",
)
def stream_sink_tiers(spark, sf):
    """Rows of a stream of many batches, from folders that are put together as they grow in number."""
    folder = new_folder(spark, "events-by-batch")
    t.table(spark, sf, "events").repartition(11).write.parquet(folder)
    rows = readers.stream_files(spark, folder, t.table(spark, sf, "events").schema, maxFilesPerTrigger=1)
    rows = rows.select("event_id", "ts", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("asin"))
    path = _stored(spark, rows, "tiers", sink=lambda p: sinks.tiered_batches(p, every=3))
    return sinks.read_tiers(spark, path, every=3)


def _upserted(spark, sf):
    """Reviews arriving in four batches by year, one of them twice; the first two are compacted, the others are deltas still."""
    facts = t.facts_only(spark, sf)
    table = KeyedTable(spark, new_folder(spark, "keyed-reviews"), ["review_id"], "review_ts", buckets=8)
    for i in (0, 1, 2, 2, 3):
        table.upsert(facts.where(F.year("review_ts") % 4 == i), i)
        if i == 1:
            table.compact()
            table.clean(keep=1)
    return table


@query(
    "upsert_reviews",
    RV
    + f"""SELECT {FACTS} FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY review_ts DESC, asin, overall, ord_hint) AS k
FROM rv) WHERE k = 1""",
)
def upsert_reviews(spark, sf):
    return _upserted(spark, sf).read().select(*t.FACT_COLUMNS)


@query(
    "upsert_find",
    RV + f"SELECT {FACTS} FROM rv WHERE review_id = '7-1' ORDER BY review_ts DESC, asin, overall, ord_hint LIMIT 1",
)
def upsert_find(spark, sf):
    """One review by its key, from its bucket only, after all is compacted."""
    table = _upserted(spark, sf)
    table.compact()
    table.clean(keep=1)
    return table.find("7-1").select(*t.FACT_COLUMNS)


_COUNTS = "count(*) FILTER (sentiment = 2) AS positive, count(*) FILTER (sentiment = 1) AS neutral, count(*) FILTER (sentiment = 0) AS negative"


def _rolled_up(spark, sf):
    """Titled reviews arriving in seven batches, by hash, and the counts kept up with them."""
    results = t.titled(spark, sf).select("review_id", "asin", "sentiment", "sentiment_label", "review_ts", "title")
    path = new_folder(spark, "rollup")
    write = rollup.rollup_sink(path, every=3)
    for i in range(7):
        write(results.where(F.pmod(F.hash("review_id"), F.lit(7)) == i), i)
    return rollup.read_rollup(spark, path, every=3), results


@query(
    "rollup_product_counters",
    RV
    + f"""SELECT asin, {_COUNTS}, min(review_ts) AS first_seen, arg_min(coalesce(nullif(title, ''), 'Product ' || asin), (review_ts, coalesce(nullif(title, ''), 'Product ' || asin))) AS title
FROM rv GROUP BY asin""",
)
def rollup_product_counters(spark, sf):
    return rollup.rolled_counters(_rolled_up(spark, sf)[0])


@query(
    "rollup_dashboard",
    RV
    + f"""SELECT 'product' AS shown, {_COUNTS}, count(*) AS total FROM rv WHERE asin = 'P7' AND sentiment = 2 AND review_ts >= (SELECT max(review_ts) FROM rv) - INTERVAL 90 DAY
UNION ALL SELECT 'range', {_COUNTS}, count(*) FROM rv WHERE review_ts >= (SELECT max(review_ts) FROM rv) - INTERVAL 30 DAY
UNION ALL SELECT 'all', {_COUNTS}, count(*) FROM rv""",
)
def rollup_dashboard(spark, sf):
    """The dashboard's counts under three filters, from the counts kept up."""
    rolled, results = _rolled_up(spark, sf)
    now = filters.latest_time(t.facts_only(spark, sf))
    shown = {"product": {"product": "P7", "sentiment": "positive", "time_range": "last-90d"}, "range": {"time_range": "30d"}, "all": {}}
    rows = [rollup.rolled_stats(rolled, results, now, **given).select(F.lit(name).alias("shown"), "*") for name, given in shown.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("stream_hourly_late", EV + "SELECT date_trunc('hour', ts) AS hour, category, count(*) AS n, true AS some_late FROM ev GROUP BY 1, 2")
def stream_hourly_late(spark, sf):
    """Hourly counts over batches that bring old rows: those on time and the late ones kept apart are together all rows."""
    folder = new_folder(spark, "events-by-batch")
    t.table(spark, sf, "events").repartition(6, "event_id").write.parquet(folder)
    files = readers.stream_files(spark, folder, t.table(spark, sf, "events").schema, maxFilesPerTrigger=1)
    path = _stored(spark, t.as_events(files), "hourly-late", sink=lambda p: running.hourly_sink(p, every=3))
    late = running.late_rows(spark, path)
    some = not late.isEmpty()
    counted = late.groupBy(F.date_trunc("hour", "ts").alias("hour"), "category").agg(F.count(F.lit(1)).alias("n"))
    both = running.hours_so_far(spark, path, every=3).unionByName(counted).groupBy("hour", "category").agg(F.sum("n").alias("n"))
    return _ntz(both, "hour").withColumn("some_late", F.lit(some))


@query(
    "stream_scores_by_version",
    """SELECT CAST(doc_id AS VARCHAR) AS "reviewerID", CAST(doc_id % 2 AS INTEGER) AS model_version, true AS as_in_batch FROM documents WHERE text IS NOT NULL""",
)
def stream_scores_by_version(spark, sf):
    """Documents on a stream, the odd ones after a second model was published: each is scored as that version scores it in a batch."""
    rows = learning.cleaned(learning.rated(spark, sf))
    store = versions.ModelStore(spark, new_folder(spark, "models"))
    topic, folder = new_folder(spark, "topic"), new_folder(spark, "versions")
    records = t.documents(spark, sf).select(F.col("doc_id").cast("string").alias("reviewerID"), F.col("review_text").alias("reviewText"), "summary")
    keep = ["reviewerID", "reviewText", "summary"]
    score = lambda batch, model: scoring.scored(batch, model, keep)
    with running.state_on_disk(spark):
        for odd, part in enumerate((rows, rows.where("sentiment < 2"))):
            store.publish(modelling.fit(modelling.classifiers()["NaiveBayes"], part))
            records.where(F.col("reviewerID").cast("long") % 2 == odd).coalesce(1).write.mode("append").parquet(topic)
            stream = scoring.prepare_scoring(readers.stream_files(spark, topic, records.schema))
            sinks.run_available(stream, versions.versioned_scores(store, folder, score), f"{folder}/checkpoint", folder.rsplit("/", 1)[1])
    streamed = spark.read.parquet(f"{folder}/rows").select("reviewerID", "model_version", "sentiment")
    expected = None
    for version in (0, 1):
        batch = score(scoring.prepare_scoring(records.where(F.col("reviewerID").cast("long") % 2 == version)), store.load(version))
        batch = batch.select("reviewerID", F.col("sentiment").alias("alone"))
        expected = batch if expected is None else expected.unionByName(batch)
    return streamed.join(expected, "reviewerID").select("reviewerID", "model_version", F.col("sentiment").eqNullSafe(F.col("alone")).alias("as_in_batch"))


@query("stream_top", EV + _EV_COUNTS + ", count(*) AS total FROM ev GROUP BY asin ORDER BY total DESC, asin LIMIT 5")
def stream_top(spark, sf):
    totals = _counters(spark, sf).withColumn("total", aggregates.total_of_counts())
    order = [F.desc("total"), F.col("asin")]
    path = _stored(spark, totals, "stream-top", "update", lambda p: running.best_so_far(p, order, 5, key="asin"))
    return running.current_best(spark, path)


@query("stream_latest", EV + "SELECT event_id, ts, asin, category FROM ev ORDER BY ts DESC, event_id LIMIT 100")
def stream_latest(spark, sf):
    events = aggregates.known_events(t.as_events(_stream(spark, sf, "events"))).select("event_id", "ts", "asin", "category")
    order = [F.desc("ts"), F.col("event_id")]
    path = _stored(spark, events, "stream-latest", sink=lambda p: running.best_so_far(p, order, 100))
    return _ntz(running.current_best(spark, path), "ts")


@query("stream_hourly", EV + "SELECT date_trunc('hour', ts) AS hour, category, count(*) AS n FROM ev GROUP BY 1, 2")
def stream_hourly(spark, sf):
    hourly = running.hourly_counts(t.as_events(_stream(spark, sf, "events")))
    path = _stored(spark, hourly, "stream-hourly", "update", lambda p: running.versioned_rows(p, ["hour", "category"]))
    return _ntz(running.current_rows(spark, path, ["hour", "category"]), "hour")


@query("stream_deduplicated", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def stream_deduplicated(spark, sf):
    """Line items come again under the same order and line; the delay spans all of them."""
    keys = ["l_orderkey", "l_linenumber"]
    lines = _stream(spark, sf, "lineitem").select(*keys, F.col("l_shipdate").cast("timestamp").alias("ts"))
    path = _stored(spark, running.drop_redelivered(lines, keys, "ts", "4000 days"), "stream-dedup")
    return spark.read.parquet(path).select(*keys)


_SCORED_TEXTS = words_sql("tg", "SELECT doc_id, review_text || coalesce(summary, '') AS text FROM rd WHERE review_text IS NOT NULL")


@query(
    "stream_scores",
    learning.bayes_sql(
        _SCORED_TEXTS,
        f"""SELECT CAST(rd.doc_id AS VARCHAR) AS "reviewerID", asin, lang AS "reviewerName", review_text AS "reviewText", CAST(overall AS FLOAT) AS overall,
coalesce(summary, '') AS summary, CAST(NULL AS VARCHAR) AS "reviewTime", best.sentiment, {learning.LABEL_SQL}
FROM rd JOIN best ON rd.doc_id = best.doc_id WHERE review_text IS NOT NULL""",
    ),
)
def stream_scores(spark, sf):
    """Documents as JSON records on a file stream, scored by a model trained on the rated ones."""
    model = learning.trained(spark, sf, "NaiveBayes")
    records = t.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("reviewerID"),
        "asin",
        F.col("lang").alias("reviewerName"),
        F.col("review_text").alias("reviewText"),
        F.col("overall").cast("float").alias("overall"),
        "summary",
    )
    topic = new_folder(spark, "topic")
    sinks.json_envelope(records).write.text(topic)
    lines = readers.stream_files(spark, topic, T.StructType([T.StructField("value", T.StringType())]), "text")
    path = _stored(spark, scoring.score_stream(lines, model), "stream-scores")
    return spark.read.parquet(path).select(*scoring.PASSTHROUGH, "sentiment", "sentiment_label")
