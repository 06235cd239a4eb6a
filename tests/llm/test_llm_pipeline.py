"""The pipeline stage by stage against brute force, and as a registered query."""

import random
import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from changeflow.llm import feistel, quality
from changeflow.llm.queries import ORACLES, QUERIES, TOKENIZER
from llm_cases import SCHEMA, odd_rows, table_of, words
from oracle import compare, connect
from test_llm_dedup import brute_groups
from test_llm_operators import brute_hits


def write_tables(spark, path, docs, labels, items):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def brute_run(rows):
    """What the stages after the classifier keep, from (doc_id, text) rows."""
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for doc_id, text in rows:
        key = norm(text)
        if key not in first or (doc_id is not None and (first[key][0] is None or doc_id < first[key][0])):
            first[key] = (doc_id, text)
    rows = list(first.values())
    component = {d: c for d, _, c in brute_groups(rows)}
    return [(d, t) for d, t in rows if d is None or component[d] == d]


def staged(spark, path):
    """run() with the result of every stage."""
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = stage(spark, docs, path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        docs.write.parquet(f"{path}/stage-{i}")
        docs = spark.read.parquet(f"{path}/stage-{i}")
        out.append(docs)
    return out


def test_stages_keep_what_brute_force_keeps(spark, tmp_path):
    rng = random.Random(4)
    item = words(rng, 20, 9000)
    rows = [(d, t) for d, t, *_ in odd_rows() if d != 9]
    good = [(100 + i, words(rng, 80, 9000).capitalize() + ".") for i in range(120)]
    bad = [(300 + i, "!! ".join(words(rng, 60, 9000).upper().split())) for i in range(60)]
    copies = [(400 + i, good[i][1] + (" " if i % 2 else "  ")) for i in range(10)]
    near = [(420 + i, good[i][1].replace(" ", " x ", 1)) for i in range(20)]
    leaked = [(450 + i, f"{words(rng, 60, 9000)} {item} {words(rng, 9, 9000)}") for i in range(5)]
    touched = [(460, f"{words(rng, 900, 9000)} {item}")]
    rows += good + bad + copies + near + leaked + touched
    labels = [(d, 1, 0) for d, _ in good[:80]] + [(d, 0, 0) for d, _ in bad[:40]]
    path = str(tmp_path)
    docs = table_of(spark, rows)
    write_tables(spark, path, docs, labels, [(1, item), (2, words(rng, 30, 9000))])
    kept = staged(spark, path)
    after_quality = [(r.doc_id, r.text) for r in kept[0].collect()]
    judged = quality.quality(docs, spark.read.parquet(f"{path}/labels.parquet")).collect()
    assert Counter(d for d, _ in after_quality) == Counter(r.doc_id for r in judged if r.kept)
    assert {d for d, _ in good + near + leaked} <= {d for d, _ in after_quality}
    assert not {d for d, _ in bad} & {d for d, _ in after_quality}
    unique = [(r.doc_id, r.text) for r in kept[2].collect()]
    assert Counter(d for d, _ in unique) == Counter(d for d, _ in brute_run(after_quality))
    assert not {d for d, _ in copies + near} & {d for d, _ in unique}
    clean = {r.doc_id: r.text for r in kept[3].collect()}
    hits = {d: (n_hit, out) for d, _, n_hit, _, _, out in brute_hits(unique, [(1, item)])}
    assert set(clean) == {d for d, (_, out) in hits.items() if not out}
    assert not {d for d, _ in leaked} & set(clean) and item not in clean[460] and len(clean[460]) > 3000
    encode, _ = feistel.encoder(TOKENIZER)
    packed = defaultdict(int)
    for r in kept[4].collect():
        packed[r.doc_id] += r.n_tokens
    assert packed == {d: n for d, t in clean.items() if (n := len(encode.encode_ordinary(t or "")))}
    again = corpus_pipeline.run(spark, path)
    assert sorted(again.collect(), key=repr) == sorted(kept[4].collect(), key=repr)


def test_stages_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path)
    write_tables(spark, path, spark.createDataFrame([], SCHEMA), [], [])
    assert [s.count() for s in staged(spark, path)] == [0] * len(corpus_pipeline.STAGES)


def test_registered_queries():
    names = [n for n in driver.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted(names) == sorted([*QUERIES, "pipeline"])
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and set(ORACLES.items()) <= set(driver.oracle_sql().items())


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_match_their_sql(spark, testdata, name):
    sf_dir = f"{testdata}/sf0.01"
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and n != "op13_embedding_whitening"])
def test_queries_without_sql_cover_every_document(spark, testdata, name):
    sf_dir = f"{testdata}/sf0.001"
    ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    found = QUERIES[name](spark, sf_dir).select("doc_id").distinct().collect()
    assert {r.doc_id for r in found} == ids
