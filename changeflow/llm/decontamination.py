"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised words of all items of a block go into one suffix automaton. A document's words are
streamed through it; its state always tells the longest run of words ending here that occurs in an
item. Where that run reaches the window length, the last window's words are hit; a shorter item is
hit where the run contains it whole. Words outside any item's word sequences cannot be part of a
match, so only the runs of words whose every n-gram occurs in some item are streamed; they are found
by array operations.

An automaton holds a bounded number of words and is what is sent to the executors. A benchmark of
more words is dealt into blocks with an automaton each, and the hits are joined by document.
"""

import math

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from .tables import row_key, text_of
from .words import U, blocks, byte_set, cut, ngrams, word_hashes

WINDOW = 13
MIN_SHARE = 20
BLOCK_WORDS = 100_000
GRAM = 4

WORD_BYTES = byte_set([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)])
BENCH_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class SuffixAutomaton:
    """All runs of words of several items, with the items of each window.

    ``window_items`` maps the state that holds a window to the items it occurs in; ``whole_items``
    maps a state to the items shorter than a window that it holds whole, as (words, items).
    """

    def __init__(self, items, window):
        self.window = window
        self.next, self.link, self.length = [{}], [-1], [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.window_items, self.whole_items = {}, {}
        for item, words in items:
            self._mark(item, words)
        self._shortcuts()

    def _new(self, length, link, follows):
        self.next.append(follows)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state, word, target):
        """A state for the runs of ``target`` that are also one word after ``state``'s longest."""
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last, word):
        known = self.next[last].get(word)
        if known is not None:
            fits = self.length[known] == self.length[last] + 1
            return known if fits else self._split(last, word, known)
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            fits = self.length[target] == self.length[state] + 1
            self.link[new] = target if fits else self._split(state, word, target)
        return new

    def _holder(self, state, n):
        """The state on the way to the root that holds the run's last ``n`` words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _mark(self, item, words):
        state, n = 0, len(words)
        for i, word in enumerate(words):
            state = self.next[state][word]
            if i + 1 >= self.window:
                self.window_items.setdefault(self._holder(state, self.window), set()).add(item)
        if 0 < n < self.window:
            at = self.whole_items.setdefault(self._holder(state, n), {})
            at.setdefault(n, set()).add(item)

    def _shortcuts(self):
        """For each state, the nearest one towards the root (itself too) with a whole item."""
        self.near_whole = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            near = self.near_whole[self.link[state]]
            self.near_whole[state] = state if state in self.whole_items else near

    def hits(self, words):
        """Stream words; yield (first word, last word, items) of every window or whole item met."""
        state, matched = 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word not in self.next[state]:
                continue
            state, matched = self.next[state][word], matched + 1
            if matched >= self.window:
                held = self._holder(state, self.window)
                yield i - self.window + 1, i, self.window_items[held]
            whole = self.near_whole[state]
            while whole > 0:
                for n, items in self.whole_items[whole].items():
                    if n <= matched:
                        yield i - n + 1, i, items
                whole = self.near_whole[self.link[whole]]


class Scanner:
    """The automaton of a block of items with the n-grams that let words be skipped."""

    def __init__(self, rows, window=WINDOW):
        """``rows`` are pairs of an item's id, as text, and its text."""
        column = pa.array([text for _, text in rows], pa.string())
        items, grams = [], [np.zeros(0, U)]
        hashed = []
        for row, data, offsets in blocks(column):
            starts, ends, first = cut(data, offsets, WORD_BYTES)
            hashes = word_hashes(data, starts, ends)
            for k in range(len(offsets) - 1):
                words = hashes[first[k] : first[k + 1]]
                if len(words):
                    items.append((rows[row + k][0], words.tolist()))
                    hashed.append(words)
        self.window = window
        self.shortest = min([window, *(len(w) for w in hashed)])
        self.gram = min(GRAM, self.shortest)
        for words in hashed:
            grams.append(ngrams(words, np.array([0, len(words)]), self.gram)[0])
        self.grams = np.unique(np.concatenate(grams))
        self.quick = np.zeros(1 << 20, bool)
        self.quick[self.grams & U((1 << 20) - 1)] = True
        self.automaton = SuffixAutomaton(items, window)

    def known(self, grams):
        found = self.quick[grams & U((1 << 20) - 1)]
        likely = np.flatnonzero(found)
        at = np.minimum(np.searchsorted(self.grams, grams[likely]), len(self.grams) - 1)
        return likely[self.grams[at] == grams[likely]] if len(self.grams) else likely[:0]

    def scan(self, hashes, first):
        """Hits of a block of rows: lists of (row, first word, last word, items), words by row."""
        grams, rows = ngrams(hashes, first, self.gram)
        counts = np.diff(first)
        long_rows = counts >= self.gram
        # n-grams of rows with fewer words than one stand at the end; they cannot match.
        n = int(np.maximum(counts[long_rows] - self.gram + 1, 0).sum())
        found = self.known(grams[:n])
        if not len(found):
            return
        row = rows[found]
        skipped = np.cumsum(np.where(long_rows, self.gram - 1, counts)) - np.where(long_rows, self.gram - 1, counts)
        word = found + skipped[row]
        breaks = np.flatnonzero((np.diff(word) != 1) | (np.diff(row) != 0)) + 1
        for low, high in zip(np.r_[0, breaks], np.r_[breaks, len(word)]):
            words = high - low + self.gram - 1
            if words < self.shortest:
                continue
            base = word[low] - first[row[low]]
            run = hashes[word[low] : word[low] + words].tolist()
            for a, b, items in self.automaton.hits(run):
                yield int(row[low]), int(base + a), int(base + b), items


def _scan_batches(scanner, every_row):
    def scan(batches):
        for batch in batches:
            text = batch.column("text")
            n = len(text)
            n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
            hit_words, items, clean = [None] * n, [None] * n, [None] * n
            for start, data, offsets in blocks(text):
                starts, ends, first = cut(data, offsets, WORD_BYTES)
                n_words[start : start + len(offsets) - 1] = np.diff(first)
                by_row = {}
                for row, a, b, names in scanner.scan(word_hashes(data, starts, ends), first):
                    by_row.setdefault(row, []).append((a, b, names))
                for row, found in by_row.items():
                    marks = np.zeros(first[row + 1] - first[row], bool)
                    for a, b, _ in found:
                        marks[a : b + 1] = True
                    k = start + row
                    hit_words[k] = np.flatnonzero(marks)
                    n_hit[k] = len(hit_words[k])
                    items[k] = sorted(set().union(*(names for _, _, names in found)))
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array(n_words),
                    pa.array(hit_words, pa.list_(pa.int64())),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["doc_id", "row_key", "n_words", "hit_words", "items"],
            )
            yield out if every_row else out.filter(pa.array(n_hit > 0))

    return scan


def contamination(docs, benchmark, window=WINDOW, block_words=BLOCK_WORDS, min_share=MIN_SHARE):
    """What of each document occurs in the benchmark.

    Returns per row of ``docs``: doc_id, row_key, n_words, n_hit, n_items, items (ids as sorted
    text), hit_words (places of hit words, ascending), contaminated (``min_share`` times the hit
    words reach all words). Null and empty texts have no words; items without words, and an empty
    benchmark, hit nothing. Items that repeat an id count once.
    """
    rows = docs.select(docs["doc_id"], row_key(docs).alias("row_key"), docs["text"].cast("string").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key long, n_words long, hit_words array<long>, items array<string>"
    items = benchmark.select(
        F.coalesce(benchmark["item_id"].cast("string"), F.lit("null")).alias("item_id"),
        text_of(benchmark).alias("text"),
    ).where(F.regexp_like("text", F.lit(BENCH_WORD)))
    total = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(BENCH_WORD))), F.lit(0))).first()[0]
    n_blocks = max(1, math.ceil(total / block_words))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    found = None
    for block in range(n_blocks):
        held = [(r.item_id, r.text) for r in dealt.where(F.col("block") == block).collect()]
        scanned = rows.mapInArrow(_scan_batches(Scanner(held, window), block == 0), schema)
        if found is None:
            found, more = scanned, None
        else:
            part = scanned.select("row_key", "hit_words", "items")
            more = part if more is None else more.unionByName(part)
    if n_blocks > 1:
        more = more.groupBy(F.col("row_key").alias("more_key")).agg(
            F.array_distinct(F.flatten(F.collect_list("hit_words"))).alias("more_words"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items"),
        )
        none = F.array()
        found = found.join(more, F.col("row_key") == F.col("more_key"), "left").select(
            "doc_id",
            "row_key",
            "n_words",
            F.array_union(F.coalesce("hit_words", none.cast("array<bigint>")), F.coalesce("more_words", none.cast("array<bigint>"))).alias("hit_words"),
            F.array_union(F.coalesce("items", none.cast("array<string>")), F.coalesce("more_items", none.cast("array<string>"))).alias("items"),
        )
    empty = F.array()
    found = found.select(
        "doc_id",
        "row_key",
        "n_words",
        F.array_sort(F.coalesce("hit_words", empty.cast("array<bigint>"))).alias("hit_words"),
        F.array_sort(F.coalesce("items", empty.cast("array<string>"))).alias("items"),
    )
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id",
        "row_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "hit_words",
        ((n_hit > 0) & (n_hit * min_share >= F.col("n_words"))).alias("contaminated"),
    )


def _without(words_of_hits):
    """Cut the hit words, and what lies between neighbouring ones, out of texts."""

    def clean(batches):
        for batch in batches:
            texts = []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hit_words").to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                starts, ends, _ = cut(data, np.array([0, len(data)]), WORD_BYTES)
                keep = np.ones(len(data), bool)
                hits = np.array(hits)
                breaks = np.flatnonzero(np.diff(hits) != 1) + 1
                for run in np.split(hits, breaks):
                    keep[starts[run[0]] : ends[run[-1]]] = False
                texts.append(data[keep].tobytes().decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), pa.array(texts, pa.string())], names=["row_key", "text"]
            )

    return words_of_hits.mapInArrow(clean, "row_key long, text string")


def decontaminate(docs, benchmark, window=WINDOW, min_share=MIN_SHARE):
    """``docs`` without contaminated rows, and without hit spans in the others; no new columns."""
    hits = contamination(docs, benchmark, window, min_share=min_share).where("n_hit > 0")
    hit_rows = hits.select(
        F.col("row_key").alias("__hit_row"), F.col("hit_words").alias("__hit_words"), F.col("contaminated").alias("__out")
    ).dropDuplicates(["__hit_row"])
    marked = docs.join(hit_rows, row_key(docs) == hit_rows["__hit_row"], "left")
    untouched = marked.where(marked["__hit_row"].isNull()).select(*[docs[c] for c in docs.columns])
    cleaned = marked.where(~marked["__out"])
    texts = _without(
        cleaned.select(cleaned["__hit_row"].alias("row_key"), docs["text"].alias("text"), cleaned["__hit_words"].alias("hit_words"))
    ).dropDuplicates(["row_key"])
    renamed = texts.select(F.col("row_key").alias("__text_row"), F.col("text").alias("__text"))
    # n_chars, where a table has it, is the length of the text.
    changed = {"text": renamed["__text"], "n_chars": F.length(renamed["__text"]).cast(dict(docs.dtypes).get("n_chars", "long"))}
    trimmed = cleaned.join(renamed, cleaned["__hit_row"] == renamed["__text_row"]).select(
        *[changed.get(c, docs[c]).alias(c) for c in docs.columns]
    )
    return untouched.unionByName(trimmed)
