"""Every registered query against its SQL twin, or for rows, on the smallest data."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import database, differences

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


def test_entry_has_rows(spark):
    assert entry(spark).columns == ["term", "n"]
    assert entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert differences(result, con, ORACLES[name]) is None
    else:
        assert result.count() > 0


@pytest.mark.parametrize("name", ["cache_lookup", "reroute_endgame_closed", "fill_status_after", "recover_stopped"])
def test_queries_on_keys_alone_store_no_cached_texts(spark, con, name, monkeypatch):
    # They had the texts of the whole cache shuffled and written for the sake of its keys.
    def refused(self):
        raise AssertionError("the cache's texts were asked for")

    monkeypatch.setattr("lectern.plans.tables.Tables.cache", refused)
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None


def test_states_are_counted_without_keys(spark, con, monkeypatch):
    # The glossary was mined and matched, and the whole ledger written, for one column that goes by the place.
    def refused(self):
        raise AssertionError("keys were asked for")

    monkeypatch.setattr("lectern.plans.tables.Tables.keyed", refused)
    monkeypatch.setattr("lectern.plans.tables.Tables.work_items", refused)
    assert differences(QUERIES["state_counts"](spark, SF_DIR), con, ORACLES["state_counts"]) is None


@pytest.mark.parametrize("name", ["import_report", "batch_import", "import_ledger", "import_repeated_ids", "verify_findings",
                                  "verify_repeated", "stream_import"])
def test_queries_that_judge_texts_store_no_cache(spark, con, name, monkeypatch):
    # The log and the cache were written, and all texts shuffled, up to four times, to be judged beside each other.
    def refused(self):
        raise AssertionError("the cache's texts were asked for")

    monkeypatch.setattr("lectern.plans.tables.Tables.cache", refused)
    monkeypatch.setattr("lectern.plans.tables.Tables.cache_log", refused)
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) is None
