"""Upserts by bucket, retention of stream folders, tiers of batches."""

import random

import pytest
from pyspark.sql import functions as F

from opinara.sources.keyed import KeyedTable
from opinara.sources.sinks import read_tiers, tiered_batches
from opinara.streaming.running import current_rows, versioned_rows
from opinara.workspace import names_in, new_folder

SCHEMA = "asin string, review_id string, ts long, text string"


def _batches(n, size, seed=1):
    rng = random.Random(seed)
    return [[(f"p{rng.randint(0, 9)}", f"r{rng.randint(0, 30)}", rng.randint(0, 50), f"{b}-{i}") for i in range(size)] for b in range(n)]


def _newest(batches):
    """Per key the latest record; of equal times the later batch, and in a batch the first text."""
    best = {}
    for b, rows in enumerate(batches):
        for asin, rid, ts, text in rows:
            key, old = (asin, rid), best.get((asin, rid))
            if old is None or (ts, b) > old[:2] or ((ts, b) == old[:2] and text < old[2]):
                best[key] = ts, b, text
    return sorted((*k, v[0], v[2]) for k, v in best.items())


def _rows(df):
    return sorted(tuple(r) for r in df.select("asin", "review_id", "ts", "text").collect())


def _files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_upserts_equal_the_newest_record_per_key(spark):
    table = KeyedTable(spark, new_folder(spark, "keyed"), ["asin", "review_id"], "ts", buckets=4)
    batches = _batches(6, 25)
    assert table.read() is None
    for i, rows in enumerate(batches):
        table.upsert(spark.createDataFrame(rows, SCHEMA), i)
        if i == 2:
            table.compact()
        if i in (1, 2, 5):
            assert _rows(table.read()) == _newest(batches[: i + 1])
    table.upsert(spark.createDataFrame(batches[5], SCHEMA), 5)
    table.compact()
    table.compact()
    table.clean(1)
    expected = _newest(batches)
    assert _rows(table.read()) == expected
    asin, review_id, ts, text = expected[3]
    assert _rows(table.find(asin, review_id)) == [(asin, review_id, ts, text)]
    assert table.find("none", "none").count() == 0


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}", ["asin", "review_id"], "ts", buckets=8)
    rows = [("p", f"r{i}", 1, "old") for i in range(200)] + [(None, None, 1, "no key")]
    table.upsert(spark.createDataFrame(rows, SCHEMA), 0)
    table.compact()
    before = _files(tmp_path / "base")
    table.upsert(spark.createDataFrame([("p", "r7", 2, "new")], SCHEMA), 1)
    table.compact()
    made = _files(tmp_path / "base") - before
    assert len({f.split("/")[1] for f in made}) == 1 and before <= _files(tmp_path / "base")
    table.clean(1)
    left = _files(tmp_path / "base")
    touched = made.copy().pop().split("/")[1]
    assert left == made | {f for f in before if f.split("/")[1] != touched}
    assert not _files(tmp_path / "delta")
    assert table.read().count() == 201 and [r.text for r in table.find("p", "r7").collect()] == ["new"]
    plan = table.find("p", "r8")._jdf.queryExecution().executedPlan().toString()
    assert table.find(None, None).count() == 1 and "_bucket" in plan


def test_an_unfinished_compaction_is_no_version(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}", ["asin", "review_id"], "ts", buckets=2)
    table.upsert(spark.createDataFrame([("p", "r", 1, "a")], SCHEMA), 0)
    table.compact()
    table.upsert(spark.createDataFrame([("p", "r", 2, "b")], SCHEMA), 1)
    table.compact()
    (tmp_path / "versions/version=1/_SUCCESS").unlink()
    assert [r.text for r in table.read().collect()] == ["b"]
    table.compact()
    table.clean(1)
    assert [r.text for r in table.read().collect()] == ["b"] and not _files(tmp_path / "delta")


def test_counters_keep_a_bounded_number_of_folders(spark):
    path, batches = new_folder(spark, "versions"), _batches(50, 6, seed=2)
    write = versioned_rows(path, ["asin"], every=5)
    expected = {}
    for i, rows in enumerate(batches):
        changed = {asin: (asin, i, text) for asin, _, _, text in rows}
        expected |= changed
        df = spark.createDataFrame(list(changed.values()), "asin string, n long, text string").coalesce(1)
        write(df, i)
        if i in (9, 49):
            write(df, i)
    assert len(names_in(spark, f"{path}/changes")) <= 10 and len(names_in(spark, f"{path}/snapshots")) <= 2
    assert {r.asin: tuple(r) for r in current_rows(spark, path, ["asin"], every=5).collect()} == expected


def test_tiers_keep_every_row_in_few_folders(spark):
    path = new_folder(spark, "tiers")
    write = tiered_batches(path, every=3)
    for i in range(60):
        df = spark.createDataFrame([(i, k) for k in range(2)], "batch int, k int").coalesce(1)
        write(df, i)
        if i % 9 == 8:
            write(df, i)
    rows = read_tiers(spark, path, every=3)
    assert sorted(tuple(r) for r in rows.collect()) == [(i, k) for i in range(60) for k in range(2)]
    folders = sum(len(names_in(spark, f"{path}/{t}")) for t in names_in(spark, path, finished=False))
    assert folders <= 12


@pytest.mark.parametrize("every", [1])
def test_sink_compacts(spark, every):
    path = new_folder(spark, "keyed-sink")
    table = KeyedTable(spark, path, ["asin", "review_id"], "ts", buckets=2)
    write = table.sink(every, keep=1)
    for i, rows in enumerate(_batches(3, 10, seed=3)):
        write(spark.createDataFrame(rows, SCHEMA), i)
    assert _rows(table.read()) == _newest(_batches(3, 10, seed=3))
    assert names_in(spark, f"{path}/delta") == [] and len(names_in(spark, f"{path}/versions")) == 1
    assert table.read().where(F.col("ts").isNull()).count() == 0
