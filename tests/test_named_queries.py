"""Every named query gives the rows its SQL gives; the others run and keep their schema."""

import pytest

import __spark_entry__ as entry_module
from checking import compare, connect

CHECKED = entry_module.oracle_sql()
UNCHECKED = [n for n in entry_module.queries() if n not in CHECKED]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, sf_dir, con, name):
    assert compare(entry_module.queries()[name](spark, sf_dir), con, CHECKED[name]) is None


@pytest.mark.parametrize("name", UNCHECKED)
def test_runs(spark, sf_dir, name):
    assert entry_module.queries()[name](spark, sf_dir).count() > 0


def test_checks_belong_to_queries():
    assert set(CHECKED) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 5


def test_reviews_are_written_compressed_and_read_whole(spark, sf_dir):
    from opinara.plans import streams, tables

    got = streams.scan_reviews_json(spark, sf_dir)
    assert all(name.endswith(".json.gz") for name in got.inputFiles())
    assert got.count() == tables.table(spark, sf_dir, "lineitem").count()
    assert got.where("review_id IS NULL OR overall IS NULL OR review_ts IS NULL").count() == 0
