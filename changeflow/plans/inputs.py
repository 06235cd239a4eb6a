"""Operator inputs derived from the given tables."""

from pyspark.sql import functions as F

from changeflow.operators.filters import allow_ddl
from changeflow.operators.ordered import BLOCK_ROWS, block_of, running_total
from changeflow.operators.rows import gtid_events

EVENTS_PER_FILE = 2500
BASE_COLUMNS = ["id", "kind", "cents", "props"]
ALLOWED_SCHEMAS = ("db0", "db1")
ALLOWED_TABLES = ("t0", "t1")
CHECKPOINT_GAP_S = 3600
HEALTH_PERIOD_S = 60
SAMPLE_INTERVAL_S = 600
BATCH_TICK_S = 86400
DUMP_BEGINS = 500
CHUNK_KEYS = 50
CHUNK_STEP = 150


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts):
    """Seconds since 1970 of a timestamp without zone, in any session zone."""
    days = F.unix_date(F.to_date(ts)).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _image(shift):
    return F.array(
        F.col("user_id").cast("string"),
        F.col("event_type"),
        (F.col("cents") + shift).cast("string"),
        F.col("props"),
    )


def row_images():
    """Images of an event: single ones, or before and after of an update, where
    every seventh update has one image too many; none for DDL."""
    steps = F.sequence(F.lit(0).cast("bigint"), F.col("n_rows") - 1)
    single = F.transform(steps, lambda i: _image(i))
    pairs = F.flatten(F.transform(steps, lambda i: F.array(_image(i), _image(i + 100))))
    odd = F.concat(pairs, F.array(_image(F.col("n_rows"))))
    return (
        F.when(F.col("action") == "ddl", F.array().cast("array<array<string>>"))
        .when(F.col("action") != "update", single)
        .when(F.col("seq") % 7 == 0, odd)
        .otherwise(pairs)
    )


def changes_of(events):
    """The change log of an events table or stream, all but ``gno``."""
    return (
        events.select(
            F.col("event_id").alias("seq"),
            epoch_seconds(F.col("ts")).alias("ts_s"),
            F.concat(F.lit("srv"), (F.col("user_id") % 2).cast("string")).alias("server_uuid"),
            F.concat(
                F.lit("bin."),
                F.lpad(
                    F.expr(f"event_id div {EVENTS_PER_FILE} + 1").cast("string"), 6, "0"
                ),
            ).alias("binlog_file"),
            (4 + 40 * (F.col("event_id") % EVENTS_PER_FILE)).alias("binlog_pos"),
            F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")).alias("schema_name"),
            F.concat(
                F.lit("t"), ((F.col("user_id") + F.col("event_id")) % 5).cast("string")
            ).alias("table_name"),
            F.when(F.col("event_type") == "signup", "insert")
            .when(F.col("event_type") == "purchase", "delete")
            .when(F.col("event_type") == "error", "ddl")
            .otherwise("update")
            .alias("action"),
            (1 + F.col("event_id") % 3).alias("n_rows"),
            "user_id",
            "event_type",
            F.round(F.col("value") * 100).cast("bigint").alias("cents"),
            "props",
        )
        .withColumn(
            "query",
            F.when(
                F.col("action") == "ddl",
                F.concat(
                    F.lit("ALTER TABLE "), F.col("table_name"), F.lit(" ADD COLUMN c"),
                    F.col("seq").cast("string"), F.lit(" INT"),
                ),
            ),
        )
        .withColumns(
            {
                "error_code": F.when(F.col("action") == "ddl", F.lit(0)),
                "execution_time": F.when(F.col("action") == "ddl", F.col("seq") % 4),
                "status_vars": F.when(F.col("action") == "ddl", F.encode("props", "utf-8")),
                "row_images": row_images(),
            }
        )
    )


def change_log(spark, sf_dir):
    return changes_of(table(spark, sf_dir, "events"))


def numbered(changes, width=BLOCK_ROWS):
    """Add ``gno``: the number of the transaction on its server."""
    return running_total(
        changes.withColumns({"_one": F.lit(1), "_block": block_of("seq", width)}),
        "_one", ["server_uuid"], ["seq"], ["_block"], "gno",
    ).drop("_one", "_block")


def rows_only(changes):
    """The columns a row message needs."""
    return changes.select(
        "seq", "ts_s", "schema_name", "table_name", "action", "row_images"
    )


def catalog(spark):
    """The current catalog: ``t3`` has one column more than its rows have values
    and ``t4`` is missing."""
    columns = F.array(*map(F.lit, BASE_COLUMNS))
    with_extra = F.array(*map(F.lit, [*BASE_COLUMNS, "extra"]))
    return (
        spark.range(12)
        .select(
            F.concat(F.lit("db"), F.expr("id div 4").cast("string")).alias("schema_name"),
            F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("table_name"),
            F.when(F.col("id") % 4 == 3, with_extra).otherwise(columns).alias("columns"),
            F.lit(0).cast("bigint").alias("valid_from"),
        )
        .withColumn("n_cols", F.size("columns"))
    )


def catalog_columns(spark, sf_dir):
    """A table of columns for every table the log has changes of, but ``t4``."""
    names = F.when(F.col("table_name") == "t3", F.array(*map(F.lit, [*BASE_COLUMNS, "extra"])))
    names = names.otherwise(F.array(*map(F.lit, BASE_COLUMNS)))
    return (
        change_log(spark, sf_dir)
        .filter("table_name <> 't4'")
        .select("schema_name", "table_name")
        .distinct()
        .select("schema_name", "table_name", F.posexplode(names).alias("_i", "column_name"))
        .select("schema_name", "table_name", (F.col("_i") + 1).alias("ordinal"), "column_name")
    )


def catalog_versions(spark, sf_dir):
    """A schema history: every DDL on a catalog table sets a new version, with one
    more column after odd events."""
    return catalog(spark).unionByName(versions_of(change_log(spark, sf_dir)).drop("ts_s"))


def versions_of(log):
    """The versions that a log's DDL sets, with its time; a table or a stream."""
    base = F.array(*map(F.lit, BASE_COLUMNS))
    more = F.array(*map(F.lit, [*BASE_COLUMNS, "extra"]))
    return (
        log.filter("action = 'ddl' AND table_name <> 't4'")
        .select(
            "schema_name", "table_name",
            F.when(F.col("seq") % 2 == 1, more).otherwise(base).alias("columns"),
            F.col("seq").alias("valid_from"), "ts_s",
        )
        .withColumn("n_cols", F.size("columns"))
    )


def gtids(spark, sf_dir):
    log = numbered(change_log(spark, sf_dir).select("seq", "ts_s", "server_uuid"))
    return gtid_events(log, F.col("seq") % 500 == 0)


def queue_events(spark, sf_dir):
    """Each event enters the queue at its time and leaves it minutes later."""
    return queue_of(change_log(spark, sf_dir))


def queue_of(changes):
    """What each event adds to the queue and takes from it; a table or a stream."""
    log = changes.select("seq", "ts_s", "server_uuid")
    entering = log.withColumn("delta", F.lit(1))
    leaving = log.withColumn("ts_s", F.col("ts_s") + 60 * (1 + F.col("seq") % 5)).withColumn(
        "delta", F.lit(-1)
    )
    return entering.unionByName(leaving)


def state_changes(spark, sf_dir):
    return states_of(change_log(spark, sf_dir))


def states_of(log):
    """A state of one component per event; a table or a stream."""
    names = F.array(F.lit("canal"), F.lit("endpoint"), F.lit("transfer"))
    return log.select(
        "seq", "ts_s",
        F.get(names, (F.col("user_id") % 3).cast("int")).alias("component"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("state"),
    )


def ddl_events(spark, sf_dir):
    return allow_ddl(change_log(spark, sf_dir), ALLOWED_SCHEMAS).select(
        "seq", "action", "schema_name", "query", "error_code", "execution_time", "status_vars"
    )


def typed_images(changes):
    """The log with typed values: the id and cents are numbers, an empty text is null."""

    def typed(image):
        def value(i, kind="string"):
            text = F.get(image, F.lit(i))
            return F.when(text != "", text).cast(kind).cast("variant")

        return F.array(value(0, "bigint"), value(1), value(2, "bigint"), value(3))

    return changes.withColumn("row_images", F.transform("row_images", typed))


def chunk_of(key):
    """The dump's chunk of a row: a range of keys."""
    return F.expr(f"CAST({key} AS BIGINT) div {CHUNK_KEYS}")


def chunk_marks(rows):
    """Where the log was before and after each chunk was read, and when it was; chunks overlap in time."""
    low = DUMP_BEGINS + CHUNK_STEP * F.col("chunk")
    return rows.select("chunk").distinct().select(
        "chunk", low.alias("low"), (low + CHUNK_STEP * 2).alias("high"), (low + CHUNK_STEP).alias("read_at")
    )
