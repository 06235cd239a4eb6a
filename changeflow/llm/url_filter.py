"""URL rules and empirical-Bayes host reputation, in DataFrame functions only.

A url that a rule fits gets the rule's verdict. Every other page is judged by its host: the labelled
outcomes of a host are shrunk towards its registered domain, those of the domain towards its suffix,
and those of the suffix towards all pages, each through a beta-binomial prior whose strength is
estimated from how much the groups of that level differ. A page is allowed if the lower bound of
its host's posterior good rate reaches a threshold.

Outcomes are counted by host before anything is shuffled; the posterior table has one row per host.
"""

import pyspark.sql.functions as F

from changeflow.session import written

from .shrinkage import overall, shrunk
from .tables import lower_ascii

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_GOOD = 0.75
Z = 1.645
MAX_RULES = 1000

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url):
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def last_labels(host, n):
    return F.substring_index(host, ".", -n)


def matched_rule(host, path, rules=RULES):
    """The longest rule that fits, as text, and its verdict; both null where none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    text, verdict = F, F
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = text.when(fits, F.lit(rule_host + rule_path))
        verdict = verdict.when(fits, F.lit(action))
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, verdict


def host_reputation(pages, outcomes):
    """Posterior good rate of every host of ``pages(page_id, host)``.

    ``outcomes(page_id, good)`` are labelled pages; good is 0 or 1. Returns host, n, s, p_good, low.
    """
    by_page = outcomes.groupBy("page_id").agg(F.min("good").alias("good"))
    labelled = pages.join(by_page, "page_id", "left")
    counted = labelled.groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("s")
    )
    # One row per host, read by every level below and by the prior strengths: written once.
    hosts = written(
        counted.select(
            "*", last_labels(F.col("host"), 2).alias("domain"), last_labels(F.col("host"), 1).alias("suffix")
        ),
        "hosts",
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    level = shrunk(suffixes.withColumn("parent", overall(suffixes)))
    below = domains.join(level.select("suffix", F.col("p").alias("parent")), "suffix")
    level = shrunk(below)
    below = hosts.join(level.select("domain", "suffix", F.col("p").alias("parent")), ["domain", "suffix"])
    level = shrunk(below)
    sd = F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("n") + F.col("k") + 1))
    return level.select("host", "n", "s", F.col("p").alias("p_good"), (F.col("p") - Z * sd).alias("low"))


def filter_urls(pages, outcomes, rules=RULES, min_good=MIN_GOOD):
    """Judge every row of ``pages(page_id, url)``: page_id, host, path, rule, verdict.

    A null url, or one without ``://``, has an empty host and path and is judged as the host of that
    name. Without any outcome all hosts share the prior, one half. Rows that repeat a page_id are
    judged each; outcomes that repeat one count once, as bad if any is bad.
    """
    parts = pages.select(
        pages["page_id"], host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path")
    )
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    known = host_reputation(parts.select("page_id", "host"), outcomes).select(
        F.col("host").alias("known_host"), "low"
    )
    judged = parts.join(known, F.col("host") == F.col("known_host"), "left")
    method = F.when(F.col("low") >= min_good, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict")
    )
