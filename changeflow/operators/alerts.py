"""Health alerts: when, to whom, and in which words."""

from pyspark.sql import functions as F

from changeflow.operators.ordered import (
    block_of,
    carry_forward,
    explode_ticks,
    next_after,
    next_multiple,
)

#: Seconds between health checks, and the alert text.
HEALTH_PERIOD = 5
STATE_WORDS = {1: "ok", 0: "failed"}
HOST_LABEL = "主机 : "
ADDRESS_LABEL = "  \nIP : "
DATABASE_LABEL = "  \n数据库 : "
SOURCE_LABEL = "   \n"
ENDPOINT_LABEL = ".   \nendpoint : "
STATE_LABEL = "  状态 : "
CHANNELS = ("email", "dingtalk", "wechat_work")


def health_alerts(state_changes, period=HEALTH_PERIOD):
    """The health checks that find the canal or the endpoint down.

    Checks run at multiples of ``period`` from the first state change to the
    last; a component that has not reported yet is down. The changes between two
    checks shrink to one row, and only the spans that alert are expanded into
    checks.
    """
    watched = (
        state_changes.filter(F.col("component").isin("canal", "endpoint"))
        .groupBy("component", "ts_s")
        .agg(F.max_by("state", "seq").alias("state"))
    )

    def last_state(component):
        return F.max_by("state", F.when(F.col("component") == component, F.col("ts_s")))

    at_tick = (
        watched.groupBy(next_multiple("ts_s", period).alias("tick_s"))
        .agg(
            last_state("canal").alias("canal_state"),
            last_state("endpoint").alias("endpoint_state"),
        )
        .withColumn("_span", block_of("tick_s", 3600 * period))
    )
    states = ["canal_state", "endpoint_state"]
    filled = carry_forward(at_tick, states, [], ["tick_s"], ["_span"])
    spans = next_after(filled, "tick_s", [], ["tick_s"], ["_span"], "_next").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in states}
    )
    until = F.coalesce(F.col("_next") - period, F.col("tick_s"))
    down = spans.filter((F.col("canal_state") == 0) | (F.col("endpoint_state") == 0))
    checks = explode_ticks(down, F.col("tick_s"), until, period, "ts_s", states)
    return checks.select("ts_s", *states)


def fan_out(alerts, channels=CHANNELS):
    """Every alert once per enabled channel."""
    names = F.array(*[F.lit(name) for name in channels]).cast("array<string>")
    return alerts.select("*", F.explode(names).alias("channel"))


def _state_word(column):
    return F.when(F.col(column) == 1, STATE_WORDS[1]).otherwise(STATE_WORDS[0])


def alert_text(hostname, address, database, endpoint, source="canal"):
    """The plain text of an alert, from the two state columns."""
    return F.concat(
        F.lit(HOST_LABEL), F.lit(hostname),
        F.lit(ADDRESS_LABEL), F.lit(address),
        F.lit(DATABASE_LABEL), F.lit(database),
        F.lit(SOURCE_LABEL), F.lit(source),
        F.lit(STATE_LABEL), _state_word("canal_state"),
        F.lit(ENDPOINT_LABEL), F.lit(endpoint),
        F.lit(STATE_LABEL), _state_word("endpoint_state"),
    )


def dingtalk_text(title, text):
    """Markdown: a heading, then quoted lines with failures in bold."""
    quoted = F.replace(text, F.lit("\n"), F.lit("\n\n> "))
    bold = F.replace(quoted, F.lit("failed"), F.lit("**failed**"))
    return F.concat(F.lit(f"### {title}\n> "), bold)


def wechat_work_text(title, text):
    """Markdown: quoted lines, the part after a line's first colon dimmed."""

    def rendered(line):
        marked = F.replace(
            line, F.lit("failed"), F.lit('<font color="warning">**failed**</font>')
        )
        parts = F.split(marked, ":", 2)
        dimmed = F.concat(
            F.lit("> "), F.get(parts, F.lit(0)),
            F.lit(':<font color="comment">'), F.get(parts, F.lit(1)), F.lit("</font>"),
        )
        return F.when(F.size(parts) == 2, dimmed).otherwise(F.concat(F.lit("> "), marked))

    lines = F.transform(F.split(text, "\n"), rendered)
    return F.concat(F.lit(f"### {title}\n"), F.array_join(lines, "\n"))


def email_html(text, head="<div>", tail="</div>"):
    """HTML: line ends become breaks, between a given head and tail."""
    return F.concat(F.lit(head), F.replace(text, F.lit("\n"), F.lit("<br>")), F.lit(tail))


def render_alerts(fanned, title, hostname, address, database, endpoint):
    """Add ``body``, the alert as its channel shows it. Nothing is sent."""
    text = alert_text(hostname, address, database, endpoint)
    body = (
        F.when(F.col("channel") == "dingtalk", dingtalk_text(title, text))
        .when(F.col("channel") == "wechat_work", wechat_work_text(title, text))
        .when(F.col("channel") == "email", email_html(text))
    )
    return fanned.withColumn("body", body)
