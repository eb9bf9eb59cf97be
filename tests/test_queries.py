"""Every query against its SQL, on the smallest tables."""

import pytest

from checks import compare, entries, sql

FOLDER = "/root/testdata/sf0.001"
QUERIES = entries.build()
SQL = sql.build()


@pytest.fixture(scope="module")
def duck():
    con = compare.tables(FOLDER)
    yield con
    con.close()


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    line = compare.compare(spark, duck, FOLDER, name, QUERIES[name], SQL[name])
    assert line.startswith("equal"), line


@pytest.mark.parametrize("name", [
    "delay_by_position_all", "turnaround_pairs", "planned_buffer_pairs", "or_day_classification", "day_examples",
    "delay_curve_by_day_type", "corrected_days", "increasing_days", "replay_days", "running_delay",
    "cascade_day_candidates", "scheduling_signal_table", "feasible_whatif_days",
])
def test_query_with_split_days_equals_sql(spark, duck, monkeypatch, name):
    """Room-days above two rows take the split path."""
    from slotwise.operators import hot_days

    monkeypatch.setattr(entries, "hot_days", lambda log: hot_days(log, rows=2))
    line = compare.compare(spark, duck, FOLDER, name, QUERIES[name], SQL[name])
    assert line.startswith("equal"), line
