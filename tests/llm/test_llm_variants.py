"""Repeated windows of words, spelling variants and whitening against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from changeflow.llm import spelling, substring_dedup, whitening
from llm_cases import corpus, odd_rows, table_of, words


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- windows of words ----------------------------------------------------------------------------


def brute_windows(rows, length=20):
    """Ids must be unique here: a window stays where (id, start) is least."""
    texts = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t, *_ in rows}
    first = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - length + 1):
            first.setdefault(tuple(texts[d][i : i + length]), (d, i))
    out = []
    for d, found in texts.items():
        gone = set()
        for i in range(len(found) - length + 1):
            if first[tuple(found[i : i + length])] != (d, i):
                gone.update(range(i, i + length))
        kept = " ".join(w for i, w in enumerate(found) if i not in gone)
        out.append((d, len(found), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def unique(rows):
    return [(i, *r[1:]) for i, r in enumerate(rows)]


def cleaned(df):
    return rows_of(df.select("doc_id", "n_words", "n_removed", "kept_sha256"))


@pytest.mark.parametrize("seed", range(3))
def test_windows_that_start_earlier_go(spark, seed):
    rows = unique(corpus(seed) + odd_rows())
    assert cleaned(substring_dedup.remove_repeats(table_of(spark, rows))) == brute_windows(rows)


@pytest.mark.parametrize("length, shortest", [(6, 4), (9, 2), (50, 4), (3, 4)])
def test_windows_of_other_lengths(spark, length, shortest):
    rows = unique(corpus(7))
    found = substring_dedup.remove_repeats(table_of(spark, rows), length, shortest)
    assert cleaned(found) == brute_windows(rows, length)


def test_window_repeated_inside_one_document(spark):
    rng = random.Random(3)
    loop = words(rng, 23)
    rows = [(5, " ".join([loop] * 40)), (2, loop), (9, "a " * 300), (7, "a " * 19)]
    assert cleaned(substring_dedup.remove_repeats(table_of(spark, rows))) == brute_windows(rows)


def test_levels_end_where_nothing_is_met_twice(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 60, 10**9)) for i in range(20)]
    assert substring_dedup.piece_filters(table_of(spark, rows).selectExpr("cast(text as binary) as text")) is None
    assert cleaned(substring_dedup.remove_repeats(table_of(spark, rows))) == brute_windows(rows)
    assert substring_dedup.levels(20) == [5, 10]


def test_false_survivors_change_nothing(spark, monkeypatch):
    """A full filter lets every window through to the last level."""
    monkeypatch.setattr(substring_dedup.bloom.Bloom, "contains", lambda self, keys: np.ones(len(keys), bool))
    text = table_of(spark, unique(corpus(2))).selectExpr("cast(text as binary) as text").collect()
    column = substring_dedup.pa.array([r.text for r in text])
    for _, _, _, _, first, hashes in substring_dedup.words_of(column):
        every = substring_dedup.block_windows(hashes, first, 20, [(5, substring_dedup.bloom.Bloom(3, None))], 5)
        assert len(every[0]) == np.maximum(np.diff(first) - 19, 0).sum()


def test_slices_of_a_long_text_agree(monkeypatch):
    rng = random.Random(5)
    column = substring_dedup.pa.array([words(rng, 3000, 3).encode(), words(rng, 10).encode()])
    (_, _, _, _, first, hashes), = substring_dedup.words_of(column)
    whole = substring_dedup.block_windows(hashes, first, 20, [], 5)
    monkeypatch.setattr(substring_dedup, "SLICE", 64)
    sliced = substring_dedup.block_windows(hashes, first, 20, [], 5)
    assert all((a == b).all() for a, b in zip(whole, sliced))


def test_windows_of_repeated_and_missing_ids(spark):
    """Rows equal in id and text count as one; rows sharing an id are ordered; null ids come last."""
    rng = random.Random(6)
    text, other = words(rng, 40), words(rng, 30)
    rows = [(1, text), (1, text), (None, text), (3, other), (3, other + " x"), (None, None)]
    found = {(r.doc_id, r.n_words): [] for r in []}
    found = defaultdict(list)
    for r in substring_dedup.remove_repeats(table_of(spark, rows)).collect():
        found[r.doc_id].append((r.n_words, r.n_removed))
    assert found[1] == [(40, 0), (40, 0)]
    assert sorted(found[None]) == [(0, 0), (40, 40)]
    assert sorted(n for _, n in found[3]) == [0, 30]


def test_windows_of_an_empty_table(spark):
    assert rows_of(substring_dedup.remove_repeats(table_of(spark, []))) == []


# --- spelling ------------------------------------------------------------------------------------


def brute_spelling(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if a < b and one_edit(a, b):
                near[a].add(b)
                near[b].add(a)
    forms = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return sorted(
        ((w, c, forms.get(w), root(w), len(near[w]), n[forms[w]] if w in forms else None) for w, c in n.items()), key=repr
    )


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(seed, alphabet, groups=25):
    """Words with variants of falling frequency, chains of variants among them."""
    rng = random.Random(seed)
    found = []
    for _ in range(groups):
        word, times = "".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 12))), rng.choice([3, 30, 200])
        while times:
            found += [word] * times
            for _ in range(rng.randrange(1, 4)):
                at, letter = rng.randrange(len(word)), rng.choice(alphabet)
                variant = rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])
                found += [variant] * max(1, times // rng.choice([4, 10, 12]))
            word, times = variant, times // 12
    rng.shuffle(found)
    return [(i, rng.choice(" .,9\n").join(found[i::40])) for i in range(40)]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop", "abéÉÿxyzQ×"])
def test_variants(spark, alphabet):
    rows = spelled(len(alphabet), alphabet) + odd_rows()
    found = rows_of(spelling.spelling_variants(table_of(spark, rows)))
    assert found == brute_spelling(rows)
    if alphabet != "ab":
        assert any(r[2] is not None for r in found)


@pytest.mark.parametrize("count", [1, 2, 40])
def test_result_does_not_depend_on_the_symbols(spark, count):
    rows = spelled(9, "abcdefgh", 12)
    assert rows_of(spelling.spelling_variants(table_of(spark, rows), count=count)) == brute_spelling(rows)


def test_many_words_with_one_reduced_word(spark):
    """All words share one reduced word; a group still holds one word per letter at most."""
    rng = random.Random(1)
    made = sorted({"".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(4000)})
    words_frame = spark.createDataFrame([(i, w, 2) for i, w in enumerate(made)], "wid long, word string, n long")
    members = spelling.near_groups(words_frame, count=1)
    sizes = Counter()
    for m in members.collect():
        word = made[m.wid]
        sizes[(m.kind, m.place, word[: m.place] + word[m.place + 1 :])] += 1
    assert max(sizes.values()) <= 10
    assert members.count() < 4000 * 7


def test_very_long_run_of_letters(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    changed = long[:1000] + "z" + long[1001:]
    rows = [(1, long), (2, long), (3, changed), (4, changed), (5, long[:-1]), (6, long[:-1])]
    found = spelling.spelling_variants(table_of(spark, rows)).selectExpr("length(word) as size", "n", "n_near").collect()
    assert [r.n for r in found] == [2, 2, 2]
    # A letter may be lost to the test of spelling, so either two or all three stay near.
    assert sorted(r.n_near for r in found) in ([1, 1, 2], [0, 1, 1])


def test_spelling_of_an_empty_table(spark):
    assert rows_of(spelling.spelling_variants(table_of(spark, []))) == []
    assert rows_of(spelling.spelling_variants(table_of(spark, [(1, None), (2, ""), (3, "once uniquely")]))) == []


# --- whitening -----------------------------------------------------------------------------------

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        *(T.StructField(c, T.StringType()) for c in ("x", "n", "count", "label", "component", "whitened")),
    ]
)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, *["c"] * 6) for i, v in rows], VECTORS)


def some_vectors(seed, n, d, copies=0):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed.astype(np.float32))]
    return rows + [(n + i, rows[0][1]) for i in range(copies)]


def check_whitening(rows, found, most=16, weights="one"):
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000 for i, v in rows}
    counts = Counter(tuple(v.tolist()) for v in x.values())
    fit = np.array(list(counts), np.int64)
    w = np.array([counts[tuple(v)] if weights == "count" else 1 for v in fit.tolist()])
    n, total = int(w.sum()), (fit * w[:, None]).sum(axis=0)
    centre = (fit * n - total) / n
    cov = (centre * w[:, None]).T @ centre / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    by_row = defaultdict(dict)
    for r in found:
        by_row[r.vec_id][r.component] = r
    assert sorted(by_row) == sorted(x) and all(sorted(c) == list(range(1, len(values) + 1)) for c in by_row.values())
    signs = np.ones(len(values))
    for i, v in x.items():
        expected = ((v * n - total) / n) @ vectors / np.sqrt(values)
        actual = np.array([by_row[i][c + 1].whitened for c in range(len(values))])
        if i == rows[0][0]:
            signs = np.sign(expected * actual)
        assert np.allclose(actual, expected * signs, atol=1e-6)
        r = by_row[i][1]
        assert (r.n, r.deviation) == (n, int(((v * n - total) ** 2).sum()))
        assert r.identity_error < 1e-8
        assert np.allclose([by_row[i][c + 1].explained for c in range(len(values))], values / np.trace(cov), rtol=1e-6)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    rows = some_vectors(1, 300, 24, copies=200)
    found = whitening.whiten(vectors_of(spark, rows).repartition(7), weights=weights).collect()
    check_whitening(rows, found, weights=weights)


def test_fewer_dimensions_than_components(spark):
    rows = some_vectors(2, 50, 3)
    check_whitening(rows, whitening.whiten(vectors_of(spark, rows)).collect())


def test_unusable_vectors_are_left_out(spark):
    rows = some_vectors(3, 60, 5)
    odd = [
        (900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5),
        (904, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (905, [1.0, 2.0]), (906, [3e38] * 5),
    ]
    check_whitening(rows, whitening.whiten(vectors_of(spark, rows + odd)).collect())


def test_repeated_and_missing_ids_stay(spark):
    rows = some_vectors(4, 40, 4)
    extra = [(None, rows[1][1]), (None, rows[2][1]), (7, rows[3][1])]
    found = whitening.whiten(vectors_of(spark, rows + extra)).collect()
    assert Counter(r.vec_id for r in found) == Counter(i for i, _ in rows + extra for _ in range(4))
    by_value = {(r.vec_id, r.component): r.whitened for r in found if r.vec_id != 7}
    assert {r.whitened for r in found if r.vec_id is None and r.component == 1} == {by_value[1, 1], by_value[2, 1]}


def test_components_without_variance_are_null(spark):
    """Three distinct vectors in five dimensions span two components; equal ones span none."""
    rows = some_vectors(5, 3, 5)
    found = whitening.whiten(vectors_of(spark, rows)).collect()
    assert {r.component for r in found if r.whitened is not None} == {1, 2}
    assert {r.component for r in found if r.whitened is None} == {3, 4, 5}
    assert all(r.identity_error < 1e-8 for r in found)
    same = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, 0.0, 0.0)}


def test_exact_beyond_longs(spark):
    """Sums and distances past 2**63 stay exact; a deviation no long can hold is null."""
    big = [(1, [2.0**50, 1.0]), (2, [-(2.0**50), 2.0]), (3, [2.0**49, 7.0])]
    found = whitening.whiten(vectors_of(spark, big)).collect()
    assert {r.deviation for r in found} == {None} and {r.n for r in found} == {3}
    assert all(r.identity_error < 1e-4 for r in found)


def test_common_vectors_are_joined_apart(spark):
    rows = some_vectors(6, 30, 3, copies=500)
    frame = vectors_of(spark, rows)
    distinct = whitening.quantized(frame).groupBy("x").count()
    back = whitening.joined_back(whitening.quantized(frame), distinct, len(rows), hot=2)
    assert back.count() == len(rows)
    assert "BroadcastHashJoin" in back._jdf.queryExecution().toString()


def test_whitening_of_an_empty_table(spark):
    assert whitening.whiten(vectors_of(spark, [])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, None)])).collect() == []
