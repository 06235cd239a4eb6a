"""Column functions over transaction-id (GTID) texts."""

from pyspark.sql import functions as F

WHITESPACE = " \t\r\n"


def trim_space(col):
    """Strip blanks, tabs and line ends; servers print one set entry per line."""
    return F.btrim(col, F.lit(WHITESPACE))


def gtid_text(server_uuid, gno):
    return F.concat_ws(":", F.col(server_uuid), F.col(gno).cast("string"))


def resume_gtid_set(saved, purged):
    """The set to resume from, given a saved ``uuid:pos`` and the purged set.

    The entry of the saved server becomes ``uuid:<start of its first purged
    interval>-<pos>``; other entries stay. A saved server the purged set does
    not name adds nothing. A saved text without exactly one ``:`` and an empty
    purged set both give the empty set.
    """
    saved_parts = F.split(saved, ":")
    uuid = F.get(saved_parts, F.lit(0))
    pos = F.get(saved_parts, F.lit(1))

    def resume_entry(entry):
        parts = F.split(entry, ":")
        interval = trim_space(F.get(parts, F.lit(1)))
        start = F.get(F.split(interval, "-"), F.lit(0))
        is_saved = (trim_space(F.get(parts, F.lit(0))) == uuid) & start.isNotNull()
        merged = F.concat(uuid, F.lit(":"), start, F.lit("-"), pos)
        return F.when(is_saved, trim_space(merged)).otherwise(trim_space(entry))

    merged_set = F.array_join(F.transform(F.split(purged, ","), resume_entry), ",")
    usable = (F.size(saved_parts) == 2) & (trim_space(purged) != "")
    return F.when(usable, merged_set).otherwise(F.lit(""))


def set_ranges(gtid_set):
    """The intervals of ``uuid:a-b:c,uuid:d`` as an array of (server_uuid, gno_start, gno_end).

    A single number is an interval of one. Parts that are no interval are skipped.
    """

    def of_entry(entry):
        parts = F.transform(F.split(entry, ":"), trim_space)
        uuid = F.get(parts, F.lit(0))

        def interval(text):
            ends = F.split(text, "-")
            start = F.get(ends, F.lit(0)).try_cast("bigint")
            end = F.when(F.size(ends) == 1, start).otherwise(F.get(ends, F.lit(1)).try_cast("bigint"))
            return F.struct(uuid.alias("server_uuid"), start.alias("gno_start"), end.alias("gno_end"))

        return F.transform(F.slice(parts, 2, 1 << 30), interval)

    intervals = F.flatten(F.transform(F.split(F.coalesce(gtid_set, F.lit("")), ","), of_entry))
    return F.filter(intervals, lambda r: r["gno_start"] <= r["gno_end"])
