"""Document quality by hierarchical empirical Bayes: the document's own evidence and its site's record.

A logistic classifier over a few measures of the text gives each document its odds of being good.
Labelled outcomes are counted by site and by path within a site; a path's rate is shrunk towards its
site's and a site's towards the rate of all, through beta-binomial priors estimated from how much
they differ, so a sparse site says little. A document's posterior odds are the classifier's, times the
odds of its path over the odds of all.

Texts are read once, to be measured; everything after works on one narrow row per document. The
classifier is fitted on at most ``SAMPLE`` labelled rows, chosen by hash; outcomes are counted over
all of them.
"""

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from changeflow.session import written

from .shrinkage import overall, shrunk
from .tables import row_key
from .words import SPACES, blocks, byte_set, cut, word_hashes

SAMPLE = 20_000
MIN_GOOD = 0.5
RIDGE = 1e-2
STEPS = 25
LIMIT = 12.0

MEASURES = ("upper", "symbols", "digits", "word_bytes", "log_words", "fresh_words", "stops", "common_word")
WORD_BYTES = byte_set(SPACES, inverted=True)
_UPPER = byte_set(range(0x41, 0x5B))
_LETTER = byte_set([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_DIGIT = byte_set(range(0x30, 0x3A))
_STOP = byte_set(b".\n")
_SYMBOL = byte_set(b"!\"#$%&*+/<=>@[\\]^_`{|}~")


def measures(column):
    """One row of measures per text of an Arrow column, all zero for a text without words."""
    out = np.zeros((len(column), len(MEASURES)))
    for row, data, offsets in blocks(column):
        upper = _UPPER[data]
        # Capitals of Latin-1 letters: a lead byte followed by one of the lower half.
        wide = np.zeros(len(data), bool)
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] < 0x9F)
        count = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets])
        starts, ends, first = cut(data, offsets, WORD_BYTES)
        n = np.diff(first)
        rows = np.repeat(np.arange(len(n)), n)
        hashes = word_hashes(data, starts, ends)
        order = np.lexsort((hashes, rows))
        hashes, sorted_rows = hashes[order], rows[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (sorted_rows[1:] != sorted_rows[:-1])
        heads = np.flatnonzero(fresh)
        repeats = np.diff(np.append(heads, len(hashes)))
        most = np.zeros(len(n), np.int64)
        np.maximum.at(most, sorted_rows[heads], repeats)
        distinct = np.bincount(sorted_rows[fresh], minlength=len(n))
        words, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
        out[row : row + len(n)] = np.column_stack(
            [
                (count(upper) + count(wide)) / np.maximum(count(_LETTER[data]), 1),
                count(_SYMBOL[data]) / size,
                count(_DIGIT[data]) / size,
                np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[first]) / words / 10,
                np.log1p(n) / 10,
                distinct / words,
                count(_STOP[data]) / words,
                most / words,
            ]
        ) * (n > 0)[:, None]
    return out


def measured(docs, site, path):
    """doc_id, row_key, site, path and the measures of every row."""
    rows = docs.select(
        docs["doc_id"],
        row_key(docs).alias("row_key"),
        F.coalesce(docs[site].cast("string"), F.lit("")).alias("site"),
        F.coalesce(docs[path].cast("string"), F.lit("")).alias("path"),
        docs["text"].cast("string").alias("text"),
    )

    def measure(batches):
        for batch in batches:
            found = measures(batch.column("text"))
            kept = [batch.column(c) for c in ("doc_id", "row_key", "site", "path")]
            names = ["doc_id", "row_key", "site", "path", *MEASURES]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x) for x in found.T.copy())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{m} double" for m in MEASURES)
    return rows.mapInArrow(measure, f"doc_id {kind}, row_key long, site string, path string, {fields}")


def expand(x):
    """Measures with their squares and a constant, as the classifier sees them."""
    return np.column_stack([np.ones(len(x)), x, x * x])


def fit(x, y):
    """Weights of a ridge logistic regression by Newton steps; None unless both kinds occur."""
    if len(np.unique(y)) < 2:
        return None
    design = expand(x)
    center, scale = design.mean(0), design.std(0)
    center[0], scale[scale == 0] = 0, 1
    z = (design - center) / scale
    w, penalty = np.zeros(z.shape[1]), RIDGE * len(y) * np.eye(z.shape[1])
    penalty[0, 0] = 0
    penalty /= 100
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty @ w
        curve = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    w = w / scale
    w[0] -= (w[1:] * center[1:]).sum()
    return w


def _log_odds(weights):
    terms = [F.lit(float(weights[0]))]
    for i, m in enumerate(MEASURES):
        terms.append(F.col(m) * float(weights[1 + i]))
        terms.append(F.col(m) * F.col(m) * float(weights[1 + len(MEASURES) + i]))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(F.least(total, F.lit(LIMIT)), F.lit(-LIMIT))


def _logit(p):
    return F.log(p / (1 - p))


def quality(docs, labels, site="source", path="lang", min_good=MIN_GOOD, sample=SAMPLE):
    """Judge every row of ``docs``: doc_id, row_key, p_document, p_site, p_path, p_good, kept.

    ``labels(doc_id, quality)`` says 1 for good; rows that repeat an id count once, as bad if any is,
    and null quality is no label. Without labels of both kinds the text has no say and all sites are
    as good as all. A null site or path is one of its own. Null text and text without words are
    judged by their path alone.
    """
    rows = written(measured(docs, site, path), "measures")
    outcomes = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    labelled = rows.join(outcomes.withColumnRenamed("doc_id", "labelled_id"), F.col("doc_id") == F.col("labelled_id"))
    # A hash range of about the sample's size first, so that sorting it is small whatever the input.
    place = F.pmod(F.xxhash64("row_key"), F.lit(1 << 30))
    share = min(1.0, 1.2 * sample / max(1, labelled.count()))
    near = labelled.where(place < int(share * (1 << 30)))
    seen = near.orderBy(place, "row_key").limit(sample).select("good", *MEASURES).toPandas()
    weights = fit(seen[list(MEASURES)].to_numpy(float), seen["good"].to_numpy(float))
    paths = labelled.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("good").alias("s"))
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rate = overall(sites)
    site_rates = written(
        shrunk(sites.withColumn("parent", rate)).select(F.col("site").alias("its_site"), F.col("p").alias("p_site"), F.col("parent").alias("p_all")),
        "site-rates",
    )
    path_rates = written(
        shrunk(
            paths.join(site_rates, F.col("site") == F.col("its_site")).withColumn("parent", F.col("p_site"))
        ).select(F.col("site").alias("path_site"), F.col("path").alias("its_path"), F.col("p").alias("p_path")),
        "path-rates",
    )
    judged = (
        rows.join(site_rates.drop("p_all"), F.col("site") == F.col("its_site"), "left")
        .join(path_rates, (F.col("site") == F.col("path_site")) & (F.col("path") == F.col("its_path")), "left")
        .withColumn("p_all", rate)
        .withColumn("p_site", F.coalesce("p_site", "p_all"))
        .withColumn("p_path", F.coalesce("p_path", "p_site"))
    )
    silent = F.col("log_words") == 0
    own = F.lit(0.0) if weights is None else F.when(silent, _logit(F.col("p_all"))).otherwise(_log_odds(weights))
    base = F.lit(0.0) if weights is None else _logit(F.col("p_all"))
    odds = own - base + _logit(F.col("p_path"))
    p_good = 1 / (1 + F.exp(-odds))
    return judged.select(
        "doc_id",
        "row_key",
        (1 / (1 + F.exp(-own))).alias("p_document"),
        "p_site",
        "p_path",
        p_good.alias("p_good"),
        (p_good >= min_good).alias("kept"),
    )
