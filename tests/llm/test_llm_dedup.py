"""Exact, near-duplicate, line and substring deduplication against brute force."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow.compute as pc
import pytest

from changeflow.llm import bloom, components, exact_dedup, jaccard_join, line_dedup, suffix_dedup
from llm_cases import SCHEMA, corpus, odd_rows, table_of, words


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- exact -------------------------------------------------------------------------------------


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", text or "") for _, text, *_ in rows]
    groups = defaultdict(list)
    for (doc_id, *_), text in zip(rows, norm):
        groups[text].append(doc_id)
    out = []
    for (doc_id, *_), text in zip(rows, norm):
        ids = [d for d in groups[text] if d is not None]
        keep = min(ids, default=None)
        out.append((doc_id, keep, len(groups[text]), doc_id == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [odd_rows(), corpus(3), odd_rows() * 3])
def test_exact_groups(spark, rows):
    assert rows_of(exact_dedup.exact_dedup(table_of(spark, rows))) == brute_exact(rows)


def test_exact_verifies_bytes_of_shared_fingerprints(spark):
    """With few fingerprint bits many texts share one; only equal texts may be grouped."""
    rows = corpus(4)
    texts = table_of(spark, rows)
    assert rows_of(exact_dedup.exact_dedup(texts, bits=4)) == brute_exact(rows)


def test_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 50, 400).astype(np.uint64) << np.uint64(30)
    parts = np.array_split(keys, 7)
    merged = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    for part in parts:
        one = exact_dedup._merged(part, np.ones(len(part), np.int64))
        merged = exact_dedup._merged(*(np.concatenate(x) for x in zip(merged, one)))
    assert dict(zip(*(x.tolist() for x in merged))) == Counter(keys.tolist())


def test_drop_copies_keeps_one_row_and_all_columns(spark):
    rows = odd_rows()
    docs = table_of(spark, rows)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    norm = lambda t: re.sub(r"\s+", " ", t or "")
    kept = [norm(r.text) for r in left.collect()]
    assert sorted(kept) == sorted({norm(t) for _, t, *_ in rows})
    assert {r.doc_id for r in left.collect() if norm(r.text) == norm(rows[0][1])} == {1}


# --- lines -------------------------------------------------------------------------------------


def test_lines_of_a_very_long_document(spark):
    """200,000 lines, half of them removed, in seconds and by brute force."""
    common = "\n".join(f"common {i % 500}" for i in range(100_000))
    own = "\n".join(f"own {i}" for i in range(100_000))
    rows = [(i, common, "en", f"s{i}") for i in range(10)]
    rows.append((99, "\n".join(x for pair in zip(common.split("\n"), own.split("\n")) for x in pair), "en", "s3"))
    began = time.time()
    found = {r.doc_id: r for r in line_dedup.dedup_lines(table_of(spark, rows)).collect()}
    assert time.time() - began < 120
    assert found[99].text == own and (found[99].n_lines, found[99].n_removed) == (200_000, 100_000)
    assert found[0].text == "" and found[0].n_removed == 100_000


# --- near --------------------------------------------------------------------------------------


def shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < 5:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def test_counts_are_combined_before_they_are_sent(spark):
    """A phrase in every document of a partition is one key with a count; runs are bounded by COMBINE."""
    column = jaccard_join.pa.array([f"a b c d e own{i} x{i}" for i in range(3000)])
    batches = [jaccard_join.pa.RecordBatch.from_arrays([column], names=["text"])] * 2
    sent = list(jaccard_join._counted_in_task(5, 4)(iter(batches)))
    table = jaccard_join.pa.Table.from_batches(sent)
    counted = [
        (f, k, c)
        for f in range(4)
        for k, c in zip(*(x.tolist() for x in jaccard_join._summed(table.filter(pc.equal(table["fragment"], f)))))
    ]
    grams = Counter(g for i in range(3000) for g in shingles(f"a b c d e own{i} x{i}"))
    assert sum(c for *_, c in counted) == sum(grams.values()) == 9000
    assert sorted(c for *_, c in counted) == sorted(grams.values())
    keys = sum(len(c.as_buffer()) for c in table["steps"]) // 4
    assert keys == len(grams)


def test_long_tasks_send_in_runs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COMBINE", 50)
    rows = corpus(5) + odd_rows()
    found = jaccard_join.similar_groups(table_of(spark, rows)).select("doc_id", "n_shingles", "component_id")
    assert rows_of(found) == brute_groups(rows)


def brute_groups(rows):
    sets = [shingles(text) for _, text, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, *_) in enumerate(rows):
        if sets[i] and doc_id is not None:
            r = find(i)
            smallest[r] = min(smallest.get(r, doc_id), doc_id)
    return sorted(
        (
            (d, len(s), smallest[find(i)] if s and d is not None else d)
            for i, ((d, *_), s) in enumerate(zip(rows, sets))
        ),
        key=repr,
    )


@pytest.mark.parametrize("seed", range(3))
def test_near_groups(spark, seed):
    rows = corpus(seed) + (odd_rows() if seed == 0 else [])
    found = jaccard_join.similar_groups(table_of(spark, rows)).select("doc_id", "n_shingles", "component_id")
    assert rows_of(found) == brute_groups(rows)


def test_near_groups_of_a_large_group_and_a_common_passage(spark):
    """More than ``GROUP`` near copies, and a passage that most documents share."""
    import random

    rng = random.Random(9)
    base, passage = words(rng, 60, 9000).split(), words(rng, 40, 9000)
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randrange(0, 4)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    for i in range(200, 320):
        rows.append((i, f"{words(rng, rng.randrange(1, 14), 9000)} {passage} {words(rng, rng.randrange(1, 14), 9000)}"))
    found = jaccard_join.similar_groups(table_of(spark, rows)).select("doc_id", "n_shingles", "component_id")
    assert rows_of(found) == brute_groups(rows)


def placed_groups(spark, parts):
    """Members of groups, from lists of (key, root, number of members, smallest size)."""
    rows, class_id = [], 10_000
    for key, root, number, size in parts:
        for i in range(number):
            rows.append((key, class_id, size + i % 7, size + i % 7 - i % 3, root))
            class_id += 7 if class_id % 2 else -3
    return rows, spark.createDataFrame(rows, "key long, class_id long, size long, rest long, root long")


@pytest.mark.parametrize("salt_rows", [1024, 50])
def test_open_groups_meet_across_components_only(spark, monkeypatch, salt_rows):
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", salt_rows)
    rows, placed = placed_groups(
        spark, [(1, 5, 700, 100), (1, 6, 3, 100), (1, 7, 2, 90), (1, 8, 4, 300), (2, 5, 90, 10), (2, 6, 90, 11), (3, 9, 500, 50)]
    )
    cross, expected = 0, set()
    for i, (key, a, size_a, rest_a, root_a) in enumerate(rows):
        for other, b, size_b, rest_b, root_b in rows[:i]:
            if key == other and root_a != root_b:
                cross += 1
                if min(size_a, size_b) * 100 >= max(size_a, size_b) * 80 and min(rest_a, rest_b) * 180 >= (size_a + size_b) * 80:
                    expected.add((a, b, size_a, size_b) if a < b else (b, a, size_b, size_a))
    assert {tuple(r) for r in jaccard_join.apart_pairs(placed, 80).collect()} == expected
    # Joined on the key alone, 709 * 709 + 180 * 180 = 535,081 pairs were formed.
    assert jaccard_join.meetings(placed, 80).count() <= 4 * cross


def test_bands_of_sizes_part_no_similar_sets(spark):
    sizes = [(s, -(-s * 100 // 80) if s * 100 % 80 else s * 100 // 80) for s in range(1, 3000)]
    pairs = [(s, t) for s, b in sizes for t in (b - 1, b) if s * 100 >= t * 80]
    frames = [spark.createDataFrame([(p[i],) for p in pairs], "size long").select(jaccard_join._bands(80).alias("n")).collect() for i in (0, 1)]
    assert max(b.n - a.n for a, b in zip(*frames)) <= 1


def test_frequent_list_is_bounded_and_changes_nothing(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i // 40) * 3 + j}" for j in range(30)) + f" u{i}") for i in range(160)]
    docs = table_of(spark, rows).select("doc_id", "text")
    listed = jaccard_join.frequent_grams(docs, 5, 16, most=1)
    assert len(listed) <= 1 < len(jaccard_join.frequent_grams(docs, 5, 16))
    monkeypatch.setattr(jaccard_join, "FREQUENT_KEYS", 1)
    found = jaccard_join.similar_groups(table_of(spark, rows)).select("doc_id", "n_shingles", "component_id")
    assert rows_of(found) == brute_groups(rows)


def test_drop_similar_leaves_one_of_each_group(spark):
    rows = corpus(5) + odd_rows()
    docs = table_of(spark, rows)
    left = jaccard_join.drop_similar(docs)
    assert left.columns == docs.columns
    groups = {}
    kept = Counter(r.doc_id for r in left.collect())
    for doc_id, n, component in brute_groups(rows):
        if doc_id is None or n == 0:
            assert kept[doc_id] >= 1
        else:
            groups.setdefault(component, set()).add(doc_id)
    for component, members in groups.items():
        assert kept[component] >= 1
    assert kept[1] == 1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (201, 200)]
    found = components.components(spark.createDataFrame(edges, "u long, v long"))
    roots = {r.node: r.root for r in found.collect()}
    expected = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    assert roots == expected


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(0, 5000, 7)
    held = bloom.build(keys, "id", 715)
    assert held.contains(np.arange(0, 5000, 7)).all()
    assert held.contains(np.arange(10**6, 10**6 + 5000)).mean() < 0.05


# --- lines -------------------------------------------------------------------------------------


def brute_lines(rows, min_sites):
    sites = defaultdict(set)
    for _, text, _, source in rows:
        for line in (text or "").split("\n"):
            sites[line.strip(" \t\x0b\x0c\r")].add(source)
    out = []
    for doc_id, text, _, _ in rows:
        lines = [] if text is None else text.split("\n")
        bare = [line.strip(" \t\x0b\x0c\r") for line in lines]
        kept = [x for x, b in zip(lines, bare) if not b or len(sites[b]) < min_sites]
        out.append((doc_id, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_sites", [2, 5])
def test_lines(spark, min_sites):
    import random

    rng = random.Random(2)
    common = [f"common line {i}" for i in range(12)]
    rows = []
    for i in range(80):
        lines = [words(rng, 3) for _ in range(rng.randrange(0, 3))] + rng.sample(common, rng.randrange(0, 4))
        rows.append((i, " \n".join(lines), "en", rng.choice([None, *(f"s{j}" for j in range(7))])))
    rows += [(80, None, "en", "s1"), (81, "", "en", "s1"), (82, "\n\n", "en", "s2"), rows[0], (None, common[0], "en", "s3")]
    for margin in (0.1, 1.0):
        found = line_dedup.dedup_lines(table_of(spark, rows), min_sites=min_sites, margin=margin)
        assert rows_of(found) == brute_lines(rows, min_sites)


# --- substrings --------------------------------------------------------------------------------


def brute_repeats(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, *_), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length,gram", [(200, 32), (40, 8)])
def test_repeats(spark, length, gram):
    rows = corpus(6, groups=20) + odd_rows()
    rows += [(500, "ab" * 400), (501, "x" + "ab" * 150), (502, "é" * 300), (503, "z" * length), (504, "y" * (length - 1))]
    found = suffix_dedup.remove_repeats(table_of(spark, rows), length, gram).drop("kept")
    assert rows_of(found) == brute_repeats(rows, length)


def test_repeats_with_every_offset(spark):
    """Shared passages at all offsets and lengths around the threshold, so cells break everywhere."""
    import random

    rng = random.Random(11)
    source = "".join(rng.choice("abcdefgh") for _ in range(3000))
    other = lambda n: "".join(rng.choice("ijklmnop") for _ in range(n))
    rows = [(0, source)]
    for i in range(1, 60):
        a, n = rng.randrange(0, 2500), rng.randrange(30, 300)
        rows.append((i, other(rng.randrange(0, 90)) + source[a : a + n] + other(rng.randrange(0, 90))))
    found = suffix_dedup.remove_repeats(table_of(spark, rows), 64, 16).drop("kept")
    assert rows_of(found) == brute_repeats(rows, 64)


def test_long_rows_are_cut_in_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 1000)
    data = np.frombuffer(("".join(chr(97 + (i * i + i // 7) % 26) for i in range(5000))).encode(), np.uint8)
    whole = set()
    for hashes, row, place, first, last, sums, low in suffix_dedup.anchors(data, np.array([0, 1700, 5000]), 64, 16):
        for a, b, r in zip(first, last, row):
            whole.update((int(low + s), int(r)) for s in range(a, b + 1))
    expected = {(s, 0) for s in range(0, 1700 - 63)} | {(s, 1) for s in range(1700, 5000 - 63)}
    assert whole == expected


# --- empty -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "run",
    [
        exact_dedup.exact_dedup,
        exact_dedup.drop_copies,
        jaccard_join.similar_groups,
        jaccard_join.drop_similar,
        line_dedup.dedup_lines,
        suffix_dedup.remove_repeats,
    ],
)
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
