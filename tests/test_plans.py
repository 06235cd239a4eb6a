"""The plans: what is pushed down, broadcast, pruned, and never there."""

import re

import pytest

import __spark_entry__ as driver
from changeflow.operators import filters
from changeflow.plans import inputs
from changeflow.session import scratch_path
from changeflow.sinks import write_change_log
from changeflow.sources import from_position, read_changes

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in driver.queries() if "stream" not in n])
def test_no_cross_join(spark, name):
    plan = plan_of(driver.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


@pytest.mark.parametrize(
    "name", ["q_change_events", "q_backlog", "q_metric_series", "q_schema_as_of", "q_alert_silence"]
)
def test_rows_are_never_windowed_by_key_alone(spark, name):
    """Windows over rows partition by block too; others see aggregates only."""
    lines = plan_of(driver.queries()[name](spark, SF_DIR)).split("\n")
    for i, line in enumerate(lines):
        window = re.search(r" Window \[.*?\], \[([^\[\]]*_(?:block|part|span)[^\]]*)\], \[", line)
        if re.search(r"\bWindow \[", line) and not window:
            below = next(
                below for below in lines[i + 1 :]
                if not re.search(r"- (Sort|Exchange|Project|Filter|WindowGroupLimit)\b", below)
            )
            assert "Aggregate" in below or "Generate" in below, line


def test_catalog_is_broadcast_without_a_hint(spark):
    assert "BroadcastHashJoin" in plan_of(driver.queries()["q_catalog_lookup"](spark, SF_DIR))


def test_report_reads_few_columns_and_builds_no_json(spark):
    plan = plan_of(driver.queries()["q_table_report"](spark, SF_DIR))
    assert "to_json" not in plan and "Generate" not in plan


def test_scan_prunes_columns(spark):
    plan = plan_of(driver.queries()["q_latest_position"](spark, SF_DIR))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"event_id", "user_id"}


def test_log_by_file_prunes_files(spark):
    path = scratch_path(spark, "log")
    log = inputs.change_log(spark, "/root/testdata/sf0.01").select(
        "seq", "ts_s", "binlog_file", "binlog_pos", "schema_name", "table_name", "action"
    )
    write_change_log(log, path)
    landed = read_changes(spark, path, schema=log.schema)
    plan = plan_of(filters.allow_rows(from_position(landed, "bin.000003", 4), ["db0"]))
    assert re.search(r"PartitionFilters: \[.*binlog_file.*>= bin.000003", plan)
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "schema_name" in pushed and "action" in pushed
    assert from_position(landed, "bin.000003", 4).count() == 5000


def test_second_pass_of_the_scan_reuses_the_shuffle(spark):
    df = driver.queries()["q_micro_batches"](spark, SF_DIR)
    df.collect()
    assert "ReusedExchange" in plan_of(df)


def test_top_samples_are_pruned_before_the_shuffle(spark):
    plan = plan_of(driver.queries()["q_metric_series"](spark, SF_DIR))
    assert "WindowGroupLimit" in plan and "Partial" in plan
