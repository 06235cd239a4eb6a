"""The registered queries over the standard tables, and the SQL twins of those SQL can express."""

import os

import pyspark.sql.functions as F

from changeflow.session import scratch_path

from . import (
    decontamination,
    exact_dedup,
    feistel,
    jaccard_join,
    line_dedup,
    packing,
    quality,
    sharding,
    spelling,
    substring_dedup,
    suffix_dedup,
    url_filter,
    whitening,
)
from .tables import table

QUERIES = {}
ORACLES = {}

TOKENIZER = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
LABEL_OF_URL = r"^/[a-z]{2}/([0-9]{1,18})"


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_line_dedup(spark, sf_dir):
    """Documents without lines seen on many sites; texts as digests."""
    clean = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query
def op2_ngram_jaccard_join(spark, sf_dir):
    """Each document with its group of similar documents."""
    groups = jaccard_join.similar_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


@query
def op3_token_shards(spark, sf_dir):
    """All sequences as read back from the shards written in training order."""
    records, layout = feistel.token_sequences(table(spark, sf_dir, "documents"), TOKENIZER)
    path = scratch_path(spark, "token-shards")
    feistel.write_shards(records, layout, path)
    return feistel.read_shards(spark, path, layout)


@query
def op4_exact_dedup(spark, sf_dir):
    """Each document with the one that stays of its group of equal texts."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def page_outcomes(pages, labels):
    """Labelled pages: a page's path ends in the number of its document; good if of quality, not toxic."""
    numbered = pages.select(
        "page_id", F.regexp_extract(url_filter.path_of(F.col("url")), LABEL_OF_URL, 1).alias("number")
    ).where("number <> ''")
    good = labels.groupBy("doc_id").agg(
        F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good")
    )
    return numbered.join(good, F.col("number").cast("long") == F.col("doc_id")).select("page_id", "good")


@query
def op5_url_filter(spark, sf_dir):
    """Every page judged by rule or else by its host's reputation."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = page_outcomes(pages, table(spark, sf_dir, "labels"))
    return url_filter.filter_urls(pages, outcomes)


@query
def op6_quality_classifier(spark, sf_dir):
    """Each document judged by its text and its site's record."""
    judged = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.drop("row_key")


@query
def op7_decontamination(spark, sf_dir):
    """What of each document occurs in the benchmark's items."""
    found = decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op8_sharding(spark, sf_dir):
    """Each document's shard in the extendible hash directory."""
    return sharding.shards(table(spark, sf_dir, "documents"))


@query
def op9_suffix_dedup(spark, sf_dir):
    """Each document's repeated strings of 200 bytes, removed."""
    clean = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op10_best_fit_packing(spark, sf_dir):
    """Each piece of each document with its bin, in tokens."""
    return packing.best_fit(table(spark, sf_dir, "documents"), tokenizer=TOKENIZER)


@query
def op11_substring_dedup(spark, sf_dir):
    """Each document without its windows of 20 words that start earlier."""
    clean = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op12_spelling_variants(spark, sf_dir):
    """Each word of the corpus with the more frequent word it is a variant of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op13_embedding_whitening(spark, sf_dir):
    """The whitened components of each embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


ORACLES["op1_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents WHERE text IS NOT NULL),
bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM lines),
spread AS (SELECT bare FROM bare WHERE bare <> '' GROUP BY bare
           HAVING count(DISTINCT coalesce(source, chr(0))) >= 10),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(spread.bare) AS n_removed,
         string_agg(line, chr(10) ORDER BY place) FILTER (WHERE spread.bare IS NULL) AS text
  FROM bare LEFT JOIN spread USING (bare) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines,
       CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS text_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op4_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
           FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

_RULES = [
    ("block", "example.org", "/en/1"),
    ("block", "example.org", "/es/"),
    ("block", "com", "/de/"),
    ("allow", "com", "/fr/"),
    ("allow", "org", "/"),
]


def _rule_case(what):
    whens = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else a}'"
        for a, h, p in _RULES
    )
    return f"CASE {whens} END"


def _level(name, groups):
    """SQL for one level: prior strength by moments, then the shrunk rate of each group."""
    return f"""
{name}_k AS (
  SELECT CASE WHEN sum(n - 1) > 0 THEN
           CASE WHEN (sum(n * power(s / n - parent, 2) / (parent * (1 - parent))) - count(*)) / sum(n - 1) > 0
                THEN least(greatest(1 / ((sum(n * power(s / n - parent, 2) / (parent * (1 - parent))) - count(*)) / sum(n - 1)) - 1, 2.0), 1000.0)
                ELSE 1000.0 END
         ELSE 1000.0 END AS k FROM {groups} WHERE n > 0),
{name}_p AS (SELECT g.*, k, (s + k * parent) / (n + k) AS p FROM {groups} g, {name}_k)"""


ORACLES["op5_url_filter"] = rf"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
good AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good
         FROM labels GROUP BY doc_id),
outcomes AS (
  SELECT page_id, min(good) AS good
  FROM parts JOIN good ON doc_id = try_cast(regexp_extract(path, '^/[a-z]{{2}}/([0-9]{{1,18}})', 1) AS BIGINT)
  GROUP BY page_id),
hosts AS (
  SELECT host, list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') AS domain, string_split(host, '.')[-1] AS suffix,
         count(good) AS n, coalesce(sum(good), 0) AS s
  FROM parts LEFT JOIN outcomes USING (page_id) GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(s) AS s FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM domains GROUP BY suffix),
suffix_in AS (SELECT *, (SELECT (sum(s) + 1.0) / (sum(n) + 2.0) FROM suffixes) AS parent FROM suffixes),
{_level("suffix", "suffix_in")},
domain_in AS (SELECT d.*, p AS parent FROM domains d JOIN suffix_p USING (suffix)),
{_level("domain", "domain_in")},
host_in AS (SELECT h.*, p AS parent FROM hosts h JOIN domain_p d ON h.domain = d.domain AND h.suffix = d.suffix),
{_level("host", "host_in")},
low AS (SELECT host, p - 1.645 * sqrt(p * (1 - p) / (n + k + 1)) AS low FROM host_p)
SELECT page_id, host, path, {_rule_case("rule")} AS rule,
       coalesce({_rule_case("verdict")}, CASE WHEN low >= 0.75 THEN 'allow' ELSE 'block' END) AS verdict
FROM parts JOIN low USING (host)
"""

ORACLES["op8_sharding"] = """
WITH RECURSIVE sizes AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS bits,
         coalesce(strlen(text), 0) AS n_bytes FROM documents),
look AS (
  SELECT 0 AS depth, 0::BIGINT AS prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs FROM sizes
  UNION ALL
  SELECT depth, prefix, shard_bytes, shard_docs FROM (
    SELECT look.depth + 1 AS depth, bits >> (59 - look.depth) AS prefix,
           sum(n_bytes) AS shard_bytes, count(*) AS shard_docs
    FROM look JOIN sizes ON bits >> (60 - look.depth) = look.prefix
    WHERE look.shard_bytes > 67108864 AND look.depth < 60 GROUP BY ALL))
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(prefix), depth) END AS shard,
       CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs,
       shard_bytes <= 67108864 AS fits
FROM sizes JOIN look ON bits >> (60 - depth) = prefix
WHERE shard_bytes <= 67108864 OR depth >= 60
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op2_ngram_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
          FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
          WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)
"""

_BENCH_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op7_decontamination"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_BENCH_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCH_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS words
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS words
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT r, n, i, item FROM g JOIN win USING (n, words)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""

ORACLES["op11_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS words
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE r > 1),
kept AS (SELECT u.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY u.p) AS text
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) u
         ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.p = gone.p GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES["op12_spelling_variants"] = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS crc FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs),
checked AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(1, len(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM hashed, crc),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
  FROM checked),
vocabulary AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
rests AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM rests a JOIN rests b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT r.word, v.word, v.n FROM rests r JOIN vocabulary v ON r.rest = v.word
  UNION SELECT v.word, r.word, r.n FROM rests r JOIN vocabulary v ON r.rest = v.word),
best AS (
  SELECT word, other, other_n, n_near FROM (
    SELECT *, count(*) OVER (PARTITION BY word) AS n_near,
           row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM near) WHERE r = 1),
judged AS (
  SELECT v.word, n, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n,
         coalesce(n_near, 0) AS n_near FROM vocabulary v LEFT JOIN best USING (word)),
follow AS (
  SELECT word, word AS root FROM judged
  UNION ALL SELECT f.word, j.form FROM follow f JOIN judged j ON f.root = j.word WHERE j.form IS NOT NULL)
SELECT j.word, j.n, j.form, root, j.n_near, j.form_n
FROM judged j JOIN follow f ON f.word = j.word JOIN judged e ON f.root = e.word AND e.form IS NULL
"""
