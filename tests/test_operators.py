"""Edge cases of the operators on hand-made rows."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions import body_bytes, bytes_to_text, named_values, resume_gtid_set
from changeflow.operators import alerts, catalog, envelope, filters, progress, reports, rows
from changeflow.sources import (
    bootstrap,
    catalog_scan,
    from_position,
    read_checkpoint,
    skip_executed,
)

CHANGE = (
    "seq long, ts_s long, schema_name string, table_name string, action string, "
    "row_images array<array<string>>"
)


def changes(spark, *events):
    return spark.createDataFrame(
        [(i, 100 + i, s, t, a, images) for i, (s, t, a, images) in enumerate(events)], CHANGE
    )


def catalog_of(spark, *tables):
    return spark.createDataFrame(
        [(s, t, cols, len(cols), 0) for s, t, cols in tables],
        "schema_name string, table_name string, columns array<string>, n_cols int, valid_from long",
    )


# Filters


def test_empty_lists_allow_everything(spark):
    log = changes(spark, ("a", "t", "insert", []), ("b", "u", "update", []), ("b", "u", "ddl", []))
    assert filters.allow_rows(log).count() == 2
    assert filters.allow_rows(log, ["a"]).count() == 1
    assert filters.allow_rows(log, [], ["u"]).count() == 1
    assert filters.allow_rows(log, ["a"], ["u"]).count() == 0


def test_a_table_list_stops_all_ddl(spark):
    log = changes(spark, ("a", "t", "ddl", []), ("b", "t", "ddl", []))
    assert filters.allow_ddl(log, ["a"]).count() == 1
    assert filters.allow_ddl(log, ["a"], ["t"]).count() == 0
    assert filters.allow_ddl(log, ["a"], ["t"], ddl_ignores_table_list=True).count() == 1


def test_allow_changes_is_the_union_of_both(spark):
    log = changes(spark, ("a", "t", "ddl", []), ("a", "t", "insert", []), ("a", "u", "update", []))
    for tables, relaxed in [((), False), (("t",), False), (("t",), True)]:
        both = filters.allow_changes(log, ["a"], tables, relaxed)
        parts = filters.allow_rows(log, ["a"], tables).unionByName(
            filters.allow_ddl(log, ["a"], tables, relaxed)
        )
        assert sorted(r.seq for r in both.collect()) == sorted(r.seq for r in parts.collect())
        again = filters.allow_changes(both, ["a"], tables, relaxed)
        assert again.count() == both.count()


# Row shaping


images = st.lists(st.lists(st.sampled_from(["x", "y", None]), max_size=2), max_size=5)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["insert", "update", "delete", "ddl"]), images),
                min_size=1, max_size=8))
def test_row_messages(spark, events):
    log = changes(spark, *[("a", "t", action, imgs) for action, imgs in events])
    got = sorted(
        (r.seq, r.row_index, r.old_row, r.new_row) for r in rows.row_messages(log).collect()
    ) if events else []
    expected = []
    for seq, (action, imgs) in enumerate(events):
        if action == "update":
            expected += [
                (seq, i, imgs[2 * i], imgs[2 * i + 1]) for i in range(len(imgs) // 2)
            ]
        elif action != "ddl":
            expected += [(seq, i, None, image) for i, image in enumerate(imgs)]
    assert got == sorted(expected, key=lambda r: r[:2])


def test_named_values_need_equal_lengths(spark):
    df = spark.createDataFrame(
        [(["a", "b"], ["1", None]), (["a"], ["1", "2"])], "c array<string>, r array<string>"
    )
    got = [r[0] for r in df.select(named_values(F.col("c"), F.col("r"))).collect()]
    assert got == [{"a": "1", "b": None}, None]


def test_changed_columns_see_nulls(spark):
    df = spark.createDataFrame(
        [(1, 0, "update", ["a", "b", "c"], ["1", None, "3"], ["1", "2", None])],
        "seq long, row_index int, action string, columns array<string>, "
        "old_row array<string>, new_row array<string>",
    )
    got = {tuple(r)[2:] for r in rows.changed_columns(df).collect()}
    assert got == {("b", None, "2"), ("c", "3", None)}


def test_bytes_to_text_reaches_nested_arrays(spark):
    schema = T.StructType([
        T.StructField("b", T.BinaryType()),
        T.StructField("a", T.ArrayType(T.BinaryType())),
        T.StructField("n", T.ArrayType(T.ArrayType(T.BinaryType()))),
        T.StructField("i", T.LongType()),
    ])
    df = spark.createDataFrame([(b"\xc3\xa9", [b"x", None], [[b"y"]], 1)], schema)
    assert tuple(bytes_to_text(df).first()) == ("é", ["x", None], [["y"]], 1)


def test_typed_values_stay_typed(spark):
    """VARIANT values reach the envelope as JSON numbers, texts and nulls."""
    typed = changes(
        spark,
        ("a", "t", "update", [["1", '"x"', "null"], ["2", '"x"', "null"]]),
        ("a", "t", "insert", [["1.5", '{"k":[1]}', "true"]]),
    ).withColumn(
        "row_images",
        F.transform("row_images", lambda image: F.transform(image, lambda v: F.parse_json(v))),
    )
    shaped = rows.row_messages(typed)
    known = catalog_of(spark, ("a", "t", ["n", "s", "z"]))
    bodies = [
        json.loads(r.value)
        for r in envelope.delivered(envelope.audit(shaped, known)).orderBy("seq").collect()
    ]
    assert bodies[0]["values"] == {"n": 2, "s": "x", "z": None}
    assert bodies[0]["oldvalues"] == {"n": 1, "s": "x", "z": None}
    assert bodies[1]["values"] == {"n": 1.5, "s": {"k": [1]}, "z": True}
    changed = rows.changed_columns(catalog.catalog_lookup(shaped, known)).collect()
    assert [(r.column_name, r.new_value.toPython()) for r in changed] == [("n", 2)]
    dump = spark.createDataFrame([(7, bytearray(b"y"))], "n long, s binary")
    first = bootstrap({("a", "u"): dump}, shaped).filter("phase = 0").first()
    assert [v.toPython() for v in first.new_row] == [7, "y"]


# Resuming


@pytest.mark.parametrize(
    "saved, purged, expected",
    [
        ("u1:70", "u1:1-50,u2:1-9", "u1:1-70,u2:1-9"),
        ("u1:70", "u1:5-50,\n u2:1-9:12-14", "u1:5-70,u2:1-9:12-14"),
        ("u1:70", "u1:5-50:60-65,u2:7", "u1:5-70,u2:7"),
        ("u3:70", "u1:1-50,\nu2:1-9", "u1:1-50,u2:1-9"),
        ("u1:7:9", "u1:1-50", ""),
        ("u1", "u1:1-50", ""),
        ("", "u1:1-50", ""),
        ("u1:70", "", ""),
        ("u1:70", "u1", "u1"),
    ],
)
def test_resume_gtid_set(spark, saved, purged, expected):
    df = spark.createDataFrame([(saved, purged)], "s string, p string")
    assert df.select(resume_gtid_set(F.col("s"), F.col("p"))).first()[0] == expected


def test_read_checkpoint(spark):
    saved = spark.createDataFrame([("u:1", 5), ("u:9\n", 7)], "gtid_set string, saved_seq long")
    assert tuple(read_checkpoint(saved).first()) == ("u:9", 7)
    assert tuple(read_checkpoint(saved.filter("false")).first()) == ("", None)


def test_from_position_is_inclusive(spark):
    df = spark.createDataFrame(
        [("bin.000001", 900), ("bin.000002", 10), ("bin.000002", 20), ("bin.000010", 4)],
        "binlog_file string, binlog_pos long",
    )
    got = {tuple(r) for r in from_position(df, "bin.000002", 20).collect()}
    assert got == {("bin.000002", 20), ("bin.000010", 4)}


@pytest.mark.parametrize("width", [3, 1 << 20])
def test_skip_executed_over_block_borders(spark, width):
    log = spark.range(1, 41).select(
        F.lit("u").alias("server_uuid"), F.col("id").alias("gno")
    ).unionByName(spark.createDataFrame([("w", 5)], "server_uuid string, gno long"))
    executed = spark.createDataFrame(
        [("u", 1, 7), ("u", 9, 9), ("u", 12, 30), ("v", 1, 99)],
        "server_uuid string, gno_start long, gno_end long",
    )
    left = skip_executed(log, executed, width).collect()
    assert sorted(r.gno for r in left if r.server_uuid == "u") == [8, 10, 11, *range(31, 41)]
    assert [r.gno for r in left if r.server_uuid == "w"] == [5]


def test_bootstrap_scope(spark):
    log = rows.row_messages(changes(spark, ("s", "t", "insert", [["1"]])))
    dump = {(s, t): spark.range(2) for s, t in [("s", "t"), ("s", "u"), ("r", "t")]}
    keys = lambda **scope: sorted({
        r.key for r in bootstrap(dump, log, **scope).filter("phase = 0").collect()
    })
    assert keys() == ["r.t", "s.t", "s.u"]
    assert keys(databases=("s",)) == ["s.t", "s.u"]
    assert keys(databases=("s",), tables=("u",)) == ["s.u"]
    assert keys(databases=("s", "r"), tables=("u",)) == ["r.t", "s.t", "s.u"]


# Catalog and outcomes


def test_catalog_scan_orders_columns(spark):
    df = spark.createDataFrame(
        [("a", "t", 10, "c10"), ("a", "t", 2, "c2"), ("a", "t", 1, "z"), ("b", "t", 1, "x")],
        "schema_name string, table_name string, ordinal int, column_name string",
    )
    got = catalog_scan(df, ["a"], ["t"]).collect()
    assert [tuple(r) for r in got] == [("a", "t", ["z", "c2", "c10"], 3)]


def test_short_old_image_is_a_mismatch(spark):
    log = changes(
        spark, ("a", "t", "update", [["1"], ["1", "2"]]), ("a", "t", "insert", [["1", "2"]])
    )
    known = catalog_of(spark, ("a", "t", ["x", "y"]))
    audited = envelope.audit(rows.row_messages(log), known)
    assert {(r.seq, r.outcome) for r in audited.collect()} == {
        (0, "arity_mismatch"), (1, "delivered")
    }
    report = reports.table_report(known, reports.delivered_counts(log, known))
    assert tuple(report.first())[2:] == (1, 0, 0)


def test_body_of_exactly_the_limit_is_sent(spark):
    df = spark.createDataFrame(
        [("a" * 1_000_000,), ("a" * 1_000_001,), ("é" * 500_000,), ("é" * 500_000 + "a",)],
        "body string",
    )
    fits = df.select(envelope.fits_message(F.col("body")), body_bytes(F.col("body")))
    assert [tuple(r) for r in fits.collect()] == [
        (True, 1_000_000), (False, 1_000_001), (True, 1_000_000), (False, 1_000_001)
    ]


def test_outcomes_cover_all_rows(spark):
    log = changes(
        spark,
        ("a", "t", "insert", [["1", "2"], ["1"], ["é" * 200, "2"]]),
        ("a", "gone", "delete", [["1"]]),
    )
    known = catalog_of(spark, ("a", "t", ["x", "y"]))
    audited = envelope.audit(rows.row_messages(log), known, limit=300)
    counts = {r.outcome: r["count"] for r in audited.groupBy("outcome").count().collect()}
    assert counts == {"delivered": 1, "arity_mismatch": 1, "oversize": 1, "unknown_table": 1}
    assert envelope.dead_letters(audited).count() == 3
    kept = reports.table_report(known, reports.delivered_counts(log, known)).first()
    assert kept.insert_count == 2, "an oversize row counts in the report"


def test_row_envelope_is_complete_json(spark):
    log = changes(
        spark,
        ("a", "t", "update", [["1", None], ["1", 'q"<&>\n']]),
        ("a", "t", "delete", [[None, "é"]]),
    )
    audited = envelope.audit(
        rows.row_messages(log), catalog_of(spark, ("a", "t", ["z", "b"]))
    ).orderBy("seq")
    bodies = [json.loads(r.value) for r in audited.collect()]
    assert bodies == [
        {"action": "update", "timestamp": 100, "schema": "a", "table": "t",
         "values": {"b": 'q"<&>\n', "z": "1"}, "oldvalues": {"b": None, "z": "1"}},
        {"action": "delete", "timestamp": 101, "schema": "a", "table": "t",
         "values": {"b": "é", "z": None}, "oldvalues": None},
    ]
    assert [list(b["values"]) for b in bodies] == [["b", "z"]] * 2


def test_ddl_envelope_does_not_break_long_base64(spark):
    df = spark.createDataFrame(
        [("ddl", "a", "ALTER", 0, 3, bytearray(b"x" * 300))],
        "action string, schema_name string, query string, error_code int, "
        "execution_time long, status_vars binary",
    )
    body = json.loads(envelope.ddl_envelope(df).first().value)
    assert list(body) == ["Action", "Schema", "Query", "ErrorCode", "ExecutionTime", "StatusVars"]
    assert body["StatusVars"] == "eHh4" * 100


def test_record_keys(spark):
    df = spark.createDataFrame(
        [(7, 60, "a", "t", "{}")],
        "seq long, ts_s long, schema_name string, table_name string, value string",
    )
    assert envelope.queue_records(df, "log").first().key == "7"
    assert envelope.queue_records(df, "log", "table").first().key == "a.t"
    with pytest.raises(ValueError):
        envelope.queue_records(df, "log", "random")


def test_upsert_keeps_the_newest_version(spark):
    versions = catalog_of(spark, ("a", "t", ["x"]), ("b", "t", ["x"])).unionByName(
        catalog_of(spark, ("a", "t", ["x", "y"])).withColumn("valid_from", F.lit(9).cast("long"))
    )
    got = catalog.upsert_catalog(versions, ["a"]).collect()
    assert [(r.table_name, r.n_cols, r.valid_from) for r in got] == [("t", 2, 9)]


# Reports, health and alerts


def test_progress_without_a_saved_id(spark):
    positions = spark.createDataFrame(
        [("u", 1, "f1", 4), ("u", 2, "f1", 90), ("v", 3, "f2", 4)],
        "server_uuid string, seq long, binlog_file string, binlog_pos long",
    )
    saved = spark.createDataFrame([("u", 1, "u:1")], "server_uuid string, seq long, gtid_set string")
    got = {tuple(r) for r in progress.progress_info(positions, saved).collect()}
    assert got == {("u", "f1", 90, "u:1"), ("v", "f2", 4, "")}


def test_health_checks(spark):
    states = spark.createDataFrame(
        [("canal", 1, 1, 1), ("endpoint", 1, 7, 2), ("transfer", 0, 8, 3), ("canal", 0, 11, 4),
         ("canal", 1, 11, 5), ("endpoint", 0, 16, 6), ("endpoint", 1, 31, 7)],
        "component string, state int, ts_s long, seq long",
    )
    got = sorted(tuple(r) for r in alerts.health_alerts(states).collect())
    # Checks at 5..35; the endpoint has not reported at 5, and is down 20..30.
    assert got == [(5, 1, 0), (20, 1, 0), (25, 1, 0), (30, 1, 0)]


def test_samples_hold_between_events(spark):
    queue = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 9, -1)], "seq long, ts_s long, delta int")
    samples = reports.sample_backlog(queue, 2)
    assert sorted(tuple(r) for r in samples.collect()) == [
        (2, 2), (4, 2), (6, 2), (8, 2), (10, 1)
    ]
    assert sorted(r.ts_s for r in reports.newest_samples(samples, keep=2).collect()) == [8, 10]


def test_long_gaps_are_cut(spark):
    """Three days between two events give all samples, in rows of bounded size."""
    queue = spark.createDataFrame([(1, 1, 1), (2, 260_000, 1)], "seq long, ts_s long, delta int")
    samples = reports.sample_backlog(queue, 2)
    assert samples.count() == 130_000
    got = samples.agg(F.min("ts_s"), F.max("ts_s"), F.sum("backlog"), F.countDistinct("ts_s"))
    assert tuple(got.first()) == (2, 260_000, 130_001, 130_000)


def test_alert_texts(spark):
    df = spark.createDataFrame([(1, 0)], "canal_state int, endpoint_state int")
    fanned = alerts.fan_out(df, ["email", "dingtalk", "wechat_work"])
    bodies = {
        r.channel: r.body
        for r in alerts.render_alerts(fanned, "T", "h", "ip", "db:1", "kafka").collect()
    }
    assert bodies["email"] == (
        "<div>主机 : h  <br>IP : ip  <br>数据库 : db:1   <br>canal  状态 : ok.   "
        "<br>endpoint : kafka  状态 : failed</div>"
    )
    assert bodies["dingtalk"].startswith("### T\n> 主机 : h  \n\n> IP : ip")
    assert bodies["dingtalk"].endswith("状态 : **failed**")
    lines = bodies["wechat_work"].split("\n")
    assert lines[0] == "### T"
    assert lines[3] == '> 数据库 :<font color="comment"> db:1   </font>'
    assert lines[5] == (
        '> endpoint :<font color="comment"> kafka  状态 : '
        '<font color="warning">**failed**</font></font>'
    )


def test_no_channel_no_alert(spark):
    assert alerts.fan_out(spark.range(3), []).count() == 0
