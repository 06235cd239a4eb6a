"""Cross-site boilerplate lines, found by distinct-site spread; DataFrame functions only.

Every line is named by a hash of its trimmed text. One HyperLogLog sketch of sites per line is
built in each partition and merged by aggregation, so a line that fills a third of the input costs
a partition one sketch. The sketch's estimate settles lines far from the threshold; those near it,
where the estimate could be on the wrong side, get an exact distinct count over their own rows.
Lines seen on at least ``min_sites`` sites are removed from every document.

Only positions travel: hashes and sites are shuffled, texts meet the positions to remove in one join
by row.
"""

import pyspark.sql.functions as F

from changeflow.session import written

from .tables import row_key, text_of

MIN_SITES = 10
LG_K = 12
#: Relative half-width of the zone around the threshold in which sites are counted exactly: over
#: five standard errors of a sketch with 2**12 registers.
MARGIN = 0.1
BLANKS = " \t\x0b\x0c\r"


def lines_of(docs):
    """The lines of each document, as an array; null text has none."""
    return F.when(docs["text"].isNull(), F.array().cast("array<string>")).otherwise(
        F.split(docs["text"].cast("string"), "\n", -1)
    )


def line_hash(line):
    """64 bits of the trimmed line; null for a blank line, which is never boilerplate."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.xxhash64(bare))


def site_of(docs, column):
    """The site, with null as a site of its own."""
    return F.coalesce(docs[column].cast("string"), F.lit("\x00"))


def spread_lines(docs, site="source", min_sites=MIN_SITES, margin=MARGIN):
    """Hashes of the lines seen on at least ``min_sites`` sites, in column ``line``."""
    seen = docs.select(
        site_of(docs, site).alias("site"),
        F.explode(F.array_distinct(F.transform(lines_of(docs), line_hash))).alias("line"),
    ).where("line is not null")
    estimates = seen.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate")
    )
    likely = estimates.where(F.col("estimate") >= min_sites * (1 - margin))
    sure = likely.where(F.col("estimate") > min_sites * (1 + margin)).select("line")
    near = likely.where(F.col("estimate") <= min_sites * (1 + margin)).select("line")
    exact = (
        seen.join(near, "line", "left_semi")
        .groupBy("line", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("line")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("line")
    )
    return sure.unionByName(exact)


def dedup_lines(docs, site="source", min_sites=MIN_SITES, margin=MARGIN):
    """Every row of ``docs`` without its boilerplate lines.

    Returns doc_id, n_lines, n_removed, text. A null text stays null with no lines; a document of
    boilerplate alone becomes an empty text; blank lines stay. Rows that repeat an id are cleaned
    each; repeated rows do not add to a line's spread. A very long text costs time in proportion to its lines. An
    empty table gives no rows. Columns other than doc_id, text and ``site`` are not read, whatever their names.
    """
    spread = written(spread_lines(docs, site, min_sites, margin), "spread-lines")
    rows = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"), row_key(docs).alias("row"))
    lines = rows.select("row", F.posexplode(lines_of(rows)).alias("at", "content")).select(
        "row", "at", line_hash(F.col("content")).alias("line")
    )
    removed = (
        lines.join(spread, "line", "left_semi")
        .groupBy("row")
        .agg(F.collect_set("at").alias("places"))
        .withColumnRenamed("row", "removed_row")
    )
    joined = rows.join(removed, rows["row"] == removed["removed_row"], "left")
    parts, places = F.col("parts"), F.col("places")
    # By place and not by search, so that a document costs time in proportion to its lines. A document with
    # places has lines, so the sequence ascends.
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), places)
    kept = F.transform(stay, lambda at: F.get(parts, at))
    return joined.select("doc_id", "text", "places", lines_of(joined).alias("parts")).select(
        "doc_id",
        F.size(parts).alias("n_lines"),
        F.coalesce(F.size(places), F.lit(0)).alias("n_removed"),
        F.when(places.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
