"""Every registered query against its SQL twin, value by value."""

import pytest

import __spark_entry__ as driver
from changeflow.plans.oracles import ORACLES
from changeflow.plans.queries import QUERIES
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, duck, name):
    result = driver.queries()[name](spark, SF_DIR)
    assert compare(result, duck, driver.oracle_sql()[name]) > 0


def test_entry(spark):
    report = driver.entry(spark)
    assert report.columns == [
        "schema_name", "table_name", "insert_count", "update_count", "delete_count"
    ]
    assert report.count() == 12


def test_golden_numbers(spark):
    """Counts known from the inputs' description."""
    run = driver.queries()
    audit = {r.outcome: r for r in run["q_delivery_audit"](spark, SF_DIR).collect()}
    assert {k: (r.n_rows, r.new_cents, r.old_cents) for k, r in audit.items()} == {
        "delivered": (6381, 31999080, 15633039),
        "arity_mismatch": (2122, 10523309, 4985988),
        "unknown_table": (2080, 10483329, 5589551),
    }
    ddl = run["q_ddl_report"](spark, SF_DIR).collect()
    assert {r.schema_name: r.ddl_count for r in ddl} == {"db0": 660, "db1": 658, "db2": 0}
    assert run["q_alert_silence"](spark, SF_DIR).count() == 4185
    batches = run["q_micro_batches"](spark, SF_DIR).collect()
    assert (len(batches), sum(r.n_events for r in batches)) == (174, 7986)


def test_result_does_not_depend_on_session_zone(spark, duck):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        result = driver.queries()["q_kafka_records"](spark, SF_DIR)
        compare(result, duck, driver.oracle_sql()["q_kafka_records"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
