"""Late rows kept apart, and models that change while a stream runs."""

import datetime as dt

import pytest

from opinara.streaming import running, versions
from opinara.workspace import names_in, new_folder

EVENTS = "asin string, sentiment int, sentiment_label string, ts timestamp"


def _at(hour, minute=0):
    return dt.datetime(2024, 3, 1) + dt.timedelta(hours=hour, minutes=minute)


def test_late_rows_are_kept_apart(spark):
    path = new_folder(spark, "late")
    write = running.hourly_sink(path, delay="1 hour", every=2)
    batches = [[_at(1), _at(5, 30)], [_at(3, 10), _at(3, 59), _at(4, 20), _at(9)], [_at(3, 59), _at(7, 59), _at(8)], [None, _at(2)], [_at(9, 5)]]
    for i, times in enumerate(batches):
        for _ in range(2 if i in (1, 3) else 1):
            write(spark.createDataFrame([("A", 2, None, x) for x in times] + [(None, 2, None, _at(20)), ("A", None, "odd", _at(21))], EVENTS), i)
    late = sorted((r.batch_id, r.ts) for r in running.late_rows(spark, path).collect())
    assert late == [(1, _at(3, 10)), (1, _at(3, 59)), (2, _at(3, 59)), (2, _at(7, 59)), (3, _at(2))]
    hours = {r.hour: r.n for r in running.hours_so_far(spark, path, every=2).collect()}
    assert hours == {_at(1): 1, _at(5): 1, _at(4): 1, _at(9): 2, _at(8): 1, None: 1}
    assert sum(hours.values()) + len(late) == sum(map(len, batches))
    assert len(names_in(spark, f"{path}/marks")) <= 2


def test_a_batch_keeps_its_version(spark):
    folder = new_folder(spark, "store")
    saved = lambda model, path: spark.createDataFrame([(model,)], "m string").write.mode("overwrite").parquet(path)
    loaded = lambda path: spark.read.parquet(path).first()[0]
    store = versions.ModelStore(spark, folder, saved, loaded)
    out = new_folder(spark, "scores")
    write = versions.versioned_scores(store, out, lambda batch, model: batch.selectExpr("id", f"'{model}' AS by"))
    with pytest.raises(LookupError):
        write(spark.range(1), 0)
    assert store.publish("first") == 0
    write(spark.range(2), 0)
    saved("half", f"{folder}/version=1/model")
    write(spark.range(2, 4), 1)
    assert store.versions() == [0] and store.publish("second") == 1
    write(spark.range(2, 4), 1)
    write(spark.range(4, 6), 2)
    rows = sorted((r.id, r.by, r.model_version) for r in spark.read.parquet(f"{out}/rows").collect())
    assert rows == [(0, "first", 0), (1, "first", 0), (2, "first", 0), (3, "first", 0), (4, "second", 1), (5, "second", 1)]
