"""Token shards, url filter, quality, decontamination, sharding and packing against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changeflow.llm import decontamination, feistel, packing, quality, sharding, url_filter
from changeflow.llm.queries import QUERIES
from llm_cases import SCHEMA, corpus, odd_rows, table_of, words

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- token shards ------------------------------------------------------------------------------


@pytest.mark.parametrize("count", [1, 2, 3, 10, 1000, 4097])
def test_permutation_and_its_inverse(count):
    numbers = np.arange(count)
    slots = feistel.permuted(numbers, count, key=7)
    assert sorted(slots.tolist()) == list(range(count))
    assert (feistel.permuted(slots, count, key=7, inverse=True) == numbers).all()
    if count > 100:
        assert (slots != feistel.permuted(numbers, count, key=8)).any()


ODD_TEXTS = [
    "", " ", "  two  spaces ", "tab\tand\nline \n end ", "it's 3.14 don't!!", "\u00a0nb\u00a0sp \u2003em sp", "é à ü 你好 世界",
    "a  b   c", " lead", "trail ", "x \u3000 y", "\r\n win \r\n", "word's 's", None, "a" * 3000, "…  … \u0085 next",
]


def test_tokens_equal_the_tokenizer_on_whole_texts():
    encode, _ = feistel.encoder(RANKS)
    texts = ODD_TEXTS + [t for _, t, *_ in corpus(2)]
    expected = [encode.encode_ordinary(t or "") for t in texts]
    column = pa.array(texts, pa.string())
    assert feistel.token_counts(column, RANKS).tolist() == [len(x) for x in expected]
    found = []
    for _, ids, at in feistel.token_ids(column, RANKS):
        found += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    assert found == expected


@pytest.mark.parametrize("end_id", [50256, 70000])
def test_shards_round_trip_and_fixed_stride(spark, tmp_path, end_id):
    rows = odd_rows() + corpus(1)
    path = str(tmp_path / "docs")
    table_of(spark, rows).repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    records, layout = feistel.token_sequences(docs, RANKS, sequence=64, end_id=end_id, shard_records=50)
    out = str(tmp_path / "shards")
    feistel.write_shards(records, layout, out)
    encode, _ = feistel.encoder(RANKS)
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = [*encode.encode_ordinary(text or ""), end_id]
        for c in range(0, max(1, -(-len(ids) // 64))):
            part = ids[c * 64 : c * 64 + 64]
            held = np.array(part + [end_id] * (64 - len(part)), layout.kind)
            expected[(doc_id, c, len(part), hashlib.sha256(held.tobytes()).hexdigest())] += 1
    found = feistel.read_shards(spark, out, layout).collect()
    assert Counter((r.doc_id, r.chunk, r.n_tokens, r.tokens_sha256) for r in found) == expected
    assert sorted(r.slot for r in found) == list(range(layout.count))
    assert all((r.shard, r.byte_offset) == layout.place(r.slot) for r in found)
    # A reader seeks to a slot without reading what is before it.
    files = {int(f.parent.name.split("=")[1]): f for f in (tmp_path / "shards").glob("shard=*/*.txt")}
    assert len(files) == layout.n_shards
    for r in random.Random(1).sample(found, 20):
        with open(files[r.shard], "rb") as shard:
            shard.seek(r.byte_offset)
            record = np.frombuffer(shard.read(layout.stride)[:-1], layout.fields)[0]
        assert (record["doc_id"], record["chunk"]) == (feistel.NO_ID if r.doc_id is None else r.doc_id, r.chunk)


def test_no_documents_make_no_sequences(spark, tmp_path):
    records, layout = feistel.token_sequences(spark.createDataFrame([], SCHEMA), RANKS)
    assert layout.count == 0 and records.count() == 0


# --- url filter --------------------------------------------------------------------------------


URLS = [
    ("http://a.org/x", "a.org", "/x", "org/", "allow"),
    ("HTTP://WWW.Example.ORG/es/1?q#f", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://myexample.org/es/2", "myexample.org", "/es/2", "org/", "allow"),
    ("x://b.com/fr/z", "b.com", "/fr/z", "com/fr/", "allow"),
    ("x://b.com/de/z#x/fr/", "b.com", "/de/z", "com/de/", "block"),
    ("x://org?a/b", "org", "", None, None),
    ("x://\u00c9b.net\n/p\nq", "\u00c9b.net\n", "/p\nq", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("no host", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("://", "", "", None, None),
]


def test_rules_hosts_and_paths(spark):
    pages = spark.createDataFrame(
        [(i, u[0], "x", "x", "x") for i, u in enumerate(URLS)],
        "page_id long, url string, host string, rule string, n string",
    )
    outcomes = spark.createDataFrame([(0, 1), (0, 1), (0, 0), (99, 1)], "page_id long, good int")
    found = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes).collect()}
    assert len(found) == len(URLS)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        assert found[i].verdict == verdict if verdict else found[i].verdict in ("allow", "block")


def test_reputation_shrinks_sparse_hosts(spark):
    rows, outcomes, page = [], [], 0
    for host, n, good in [("good.a.net", 60, 58), ("bad.a.net", 60, 4), ("one.a.net", 1, 0), ("none.a.net", 0, 0), ("x.b.net", 40, 39)]:
        for i in range(max(n, 1)):
            rows.append((page, f"http://{host}/{i}"))
            if i < n:
                outcomes.append((page, int(i < good)))
            page += 1
    pages = spark.createDataFrame(rows, "page_id long, url string")
    parts = pages.select("page_id", url_filter.host_of(pages["url"]).alias("host"))
    known = {
        r.host: r
        for r in url_filter.host_reputation(parts, spark.createDataFrame(outcomes, "page_id long, good int")).collect()
    }
    assert known["good.a.net"].p_good > 0.85 > known["x.b.net"].p_good - 0.15
    assert known["bad.a.net"].p_good < 0.2
    assert 0.2 < known["one.a.net"].p_good < known["none.a.net"].p_good < 0.95
    assert known["none.a.net"].low < known["good.a.net"].low


def test_url_filter_without_pages_or_outcomes(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    outcomes = spark.createDataFrame([], "page_id long, good int")
    assert url_filter.filter_urls(none, outcomes).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(one, outcomes).collect()] == ["block"]


# --- quality -----------------------------------------------------------------------------------


def test_held_out_accuracy(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{testdata}/sf0.1/labels.parquet")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = quality.quality(docs, train).join(held, "doc_id").select("kept", "quality").collect()
    good = [r.kept for r in judged if r.quality == 1]
    bad = [not r.kept for r in judged if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.9


def test_sites_with_a_record_move_doubtful_documents(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        site = "good" if i % 2 else "bad"
        rows.append((i, words(rng, 30), "en", site))
        if i < 500:
            labels.append((i, int(rng.random() < (0.95 if site == "good" else 0.1))))
    rows += [(700, words(rng, 30), "en", "new"), (701, None, None, None), (702, "", "en", "good")]
    judged = quality.quality(table_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    found = {r.doc_id: r for r in judged.collect()}
    assert len(found) == len(rows)
    assert found[599].kept and not found[598].kept
    assert found[598].p_good < found[700].p_good < found[599].p_good
    assert found[702].kept and 0 < found[701].p_good < 1


def test_quality_without_labels_and_with_one_kind(spark):
    docs = table_of(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged = quality.quality(docs, none).collect()
    assert len(judged) == len(odd_rows()) and all(r.kept for r in judged)
    odd = [(1, 1), (1, None), (None, 0), (5, 1)]
    assert quality.quality(docs, spark.createDataFrame(odd, "doc_id long, quality int")).count() == len(odd_rows())
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.quality(empty, none).count() == 0


# --- decontamination ---------------------------------------------------------------------------

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bench_words(text):
    return re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items):
    windows = defaultdict(set)
    for item_id, text in items:
        found = bench_words(text)
        n = min(13, len(found))
        for i in range(max(1, len(found) - 12) if n else 0):
            windows[tuple(found[i : i + n])].add("null" if item_id is None else str(item_id))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text, *_ in rows:
        found, hit, ids = bench_words(text), set(), set()
        for n in sizes:
            for i in range(len(found) - n + 1):
                if tuple(found[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids |= windows[tuple(found[i : i + n])]
        out.append((doc_id, len(found), len(hit), len(ids), ",".join(sorted(ids)), bool(hit) and 20 * len(hit) >= len(found)))
    return sorted(out, key=repr)


def contaminated_case(seed):
    rng = random.Random(seed)
    items = [(i, words(rng, rng.choice([2, 3, 7, 12, 13, 14, 40]), 200)) for i in range(30)]
    items += [(30, items[0][1] + " tail"), (31, ""), (32, None), (None, words(rng, 15)), (5, words(rng, 20)), (33, items[3][1])]
    rows = odd_rows()
    for i in range(120):
        text = words(rng, rng.randrange(0, 60), 200).split()
        for _ in range(rng.randrange(0, 3)):
            source = bench_words(rng.choice(items)[1])
            a = rng.randrange(len(source)) if source else 0
            text[rng.randrange(len(text) + 1) : 0] = source[a : a + rng.randrange(1, 20)]
        rows.append((100 + i, " ".join(text).title().replace(" W1", ", w1")))
    return rows, items


@pytest.mark.parametrize("seed,block_words", [(0, 100_000), (1, 100_000), (2, 150)])
def test_contamination(spark, seed, block_words):
    rows, items = contaminated_case(seed)
    benchmark = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, items string")
    found = decontamination.contamination(table_of(spark, rows), benchmark, block_words=block_words)
    got = sorted(
        ((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.items), r.contaminated) for r in found.collect()), key=repr
    )
    assert got == brute_hits(rows, items)


def test_decontaminate_drops_and_cuts(spark):
    rng = random.Random(8)
    item, long_text = words(rng, 15, 90), words(rng, 600, 5000)
    rows = [(1, item), (2, f"{long_text}, {item.title()}! end"), (3, long_text), (3, long_text), (None, None)]
    docs = table_of(spark, rows)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontamination.decontaminate(docs, benchmark)
    assert left.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in left.collect())
    assert texts == Counter({(2, f"{long_text}, ! end"): 1, (3, long_text): 2, (None, None): 1})
    assert {r.n_chars for r in left.collect() if r.doc_id == 2} == {len(f"{long_text}, ! end")}


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = table_of(spark, odd_rows())
    assert {r.n_hit for r in decontamination.contamination(docs, none).collect()} == {0}
    assert decontamination.decontaminate(docs, none).count() == len(odd_rows())
    one = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.contamination(spark.createDataFrame([], SCHEMA), one).count() == 0


# --- sharding ----------------------------------------------------------------------------------


def brute_shards(rows, limit):
    bits = lambda d: format(int(hashlib.md5(("null" if d is None else str(d)).encode()).hexdigest()[:15], 16), "060b")
    sized = [(d, len((t or "").encode()), bits(d)) for d, t, *_ in rows]
    out = []
    for doc_id, n, b in sized:
        for depth in range(61):
            inside = [m for _, m, c in sized if c[:depth] == b[:depth]]
            if sum(inside) <= limit or depth == 60:
                out.append((doc_id, n, b[:depth], depth, sum(inside), len(inside), sum(inside) <= limit))
                break
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [600, 5000, 10**9])
def test_shards(spark, limit):
    rows = corpus(7) + odd_rows() + [(77, "x" * 700)] * 4
    assert rows_of(sharding.shards(table_of(spark, rows), limit)) == brute_shards(rows, limit)


def test_shard_files_hold_whole_rows(spark, tmp_path):
    rows = corpus(7)
    docs = table_of(spark, rows)
    assigned = sharding.shards(docs, 5000)
    sharding.write_shards(docs, assigned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == [*docs.columns, "shard_folder"]
    assert {r.shard for r in back.collect()} == {"x"}
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(rows)
    sharding.write_shards(docs.drop("shard"), assigned, str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "plain")).columns[-1] == "shard"
    sizes = defaultdict(int)
    for r in back.collect():
        sizes[r.shard_folder] += len(r.text)
    assert max(sizes.values()) <= 5000


def test_no_shards_of_no_documents(spark):
    assert sharding.shards(spark.createDataFrame([], SCHEMA)).count() == 0


# --- packing -----------------------------------------------------------------------------------


def plain_pack(lengths, capacities, bin_cost):
    """The same rules by plain search: every open bin and every capacity is looked at."""
    left = sorted(lengths)
    bins, placed = [], []
    while left:
        length = left.pop()
        fitting = [b for b in bins if b["room"] >= length]
        if fitting:
            chosen = min(fitting, key=lambda b: (b["room"], b["age"]))
        else:
            best = None
            for c in sorted(c for c in capacities if c >= length):
                room, pool = c - length, list(left)
                while True:
                    pool = [x for x in pool if x <= room]
                    if not pool:
                        break
                    room -= pool.pop()
                cost = (c + bin_cost) / (c - room)
                if best is None or cost < best[0]:
                    best = (cost, c)
            chosen = {"room": best[1], "age": len(bins), "used": 0}
            bins.append(chosen)
        placed.append((length, chosen["age"], chosen["used"]))
        chosen["room"] -= length
        chosen["used"] += length
    return placed, [b["used"] for b in bins]


@pytest.mark.parametrize("seed", range(6))
def test_pack_follows_the_plain_rules(seed):
    rng = random.Random(seed)
    capacities = (16, 32, 64)
    lengths = sorted(rng.randrange(1, 65) for _ in range(rng.randrange(1, 150)))
    bins, offsets, used = packing.pack(lengths, capacities, 4)
    placed, expected = plain_pack(lengths, capacities, 4)
    assert used == expected
    assert list(zip(lengths, bins, offsets))[::-1] == placed
    sizes = packing.downsized(used, capacities)
    assert all(c >= u and all(d < u for d in capacities if d < c) for c, u in zip(sizes, used))


def plain_fill(length, capacity, left):
    """Tokens in a bin after taking the longest piece that fits, one at a time, until none does."""
    room, pool = capacity - length, sorted(left)
    while pool := [x for x in pool if x <= room]:
        room -= pool.pop()
    return capacity - room


@pytest.mark.parametrize("length", [1, 20, 25, 60, 100, 150, 200, 240])
def test_many_short_pieces_open_the_least_cost_bin(length):
    lengths = [length] * 5000
    capacities, bin_cost = packing.CAPACITIES, packing.BIN_COST
    cost = {c: (c + bin_cost) / (c // length * length) for c in capacities}
    assert packing.cheapest(length, capacities, bin_cost, lengths, 4999) == min(cost, key=lambda c: (cost[c], c))
    _, _, used = packing.pack(lengths[:4096], capacities, bin_cost)
    assert used[0] == 4096 // length * length


@pytest.mark.parametrize("seed", range(4))
def test_a_bin_is_filled_on_paper_until_nothing_fits(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.choice((3, 10, 40, 300)) if rng.random() < 0.6 else rng.randrange(1, 200) for _ in range(400))
    for capacity in packing.CAPACITIES:
        for left in (0, 1, 5, 60, 200, 399):
            found = packing.expected_fill(lengths[left], capacity, lengths, left)
            assert found == plain_fill(lengths[left], capacity, lengths[:left])


def test_an_id_in_every_row_fills_no_group(spark):
    """100,000 rows without an id, and as many with one id, of one length."""
    for doc_id in (None, 7):
        rows = spark.range(100_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit(0).alias("piece"),
                                           F.lit(0).cast("long").alias("piece_start"), F.lit(9).alias("n_tokens"))
        sizes = [r["count"] for r in packing.dealt(rows, 13).groupBy("pack_group").count().collect()]
        assert len(sizes) == 13 and sum(sizes) == 100_000 and max(sizes) < 2 * packing.GROUP_PIECES


def test_pieces_of_one_id_are_all_packed(spark):
    rows = [(None, "a b c")] * 700 + [(1, "d e")] * 300 + [(2, None), (3, " ")]
    packed = packing.best_fit(table_of(spark, rows), (16, 32), 4, group_pieces=200).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in packed) == {(None, 3): 700, (1, 2): 300}
    assert len({r.bin_id.split("-")[0] for r in packed}) >= 4
    assert packing.best_fit(table_of(spark, [])).collect() == []


def test_packing_is_whole_and_better_than_one_capacity(spark):
    rows = corpus(2, groups=60) + odd_rows()
    docs = table_of(spark, rows)
    packed = packing.best_fit(docs, (32, 64, 128), 8, group_pieces=40).collect()
    held = defaultdict(list)
    for r in packed:
        held[r.doc_id].append((r.piece_start, r.n_tokens))
    counts = Counter()
    for doc_id, text, *_ in rows:
        counts[doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert {d: sum(n for _, n in x) for d, x in held.items()} == {d: n for d, n in counts.items() if n}
    bins = defaultdict(list)
    for r in packed:
        bins[r.bin_id].append(r)
    for parts in bins.values():
        parts.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in parts] == np.cumsum([0, *(r.n_tokens for r in parts)])[:-1].tolist()
        assert {(r.bin_used, r.bin_capacity) for r in parts} == {(sum(r.n_tokens for r in parts), parts[0].bin_capacity)}
        assert parts[0].bin_used <= parts[0].bin_capacity
    cost = lambda found: sum(c + 8 for c in {r.bin_id: r.bin_capacity for r in found}.values())
    assert cost(packed) <= cost(packing.best_fit(docs, (128,), 8, group_pieces=40).collect())
    again = packing.best_fit(docs.repartition(7), (32, 64, 128), 8, group_pieces=40).collect()
    assert sorted(packed, key=repr) == sorted(again, key=repr)


def test_missing_ids_leave_large_ids_as_they_are(spark):
    large = [(1 << 53) + 1 + i for i in range(6)] + [-(1 << 62) - 3, (1 << 63) - 1]
    rows = [(d, "a b c") for d in large] + [(None, "a b"), (None, "a b c")]
    packed = packing.best_fit(table_of(spark, rows)).collect()
    assert Counter(r.doc_id for r in packed) == Counter(d for d, _ in rows)
    # Equal lengths are placed by id, ascending, and rows without one first.
    same = [r.doc_id for r in sorted(packed, key=lambda r: r.bin_offset) if r.n_tokens == 3]
    assert same == [None, *sorted(large)]


def test_packing_query_counts_tokens(spark, tmp_path):
    texts = {1: "x7Qz" * 9000, 2: "one two three", 3: "", 4: None, 5: " ".join(f"w{i}" for i in range(3000)), 6: " \n "}
    table_of(spark, list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    encode, _ = feistel.encoder(RANKS)
    tokens = {d: len(encode.encode(t)) for d, t in texts.items() if t}
    assert tokens[1] > packing.CAPACITIES[-1] and tokens[5] > packing.CAPACITIES[-1]
    held = defaultdict(list)
    for r in QUERIES["op10_best_fit_packing"](spark, str(tmp_path)).collect():
        held[r.doc_id].append((r.piece, r.piece_start, r.n_tokens))
        assert r.bin_offset + r.n_tokens <= r.bin_used <= r.bin_capacity
    assert {d: sum(n for *_, n in x) for d, x in held.items()} == tokens
    for parts in held.values():
        assert [s for _, s, _ in sorted(parts)] == np.cumsum([0, *(n for *_, n in sorted(parts))])[:-1].tolist()


def test_nothing_to_pack(spark):
    assert packing.best_fit(spark.createDataFrame([], SCHEMA)).count() == 0
    assert packing.best_fit(table_of(spark, [(1, None), (2, " ")])).count() == 0
