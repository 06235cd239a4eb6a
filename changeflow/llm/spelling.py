"""Groups of spelling variants: words of a vocabulary that are one edit apart, by a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols, so that a word becomes a reduced word over a small alphabet
and its whole one-edit neighbourhood can be generated. Two words one edit apart have reduced words that
are equal or one edit apart, so the neighbourhood of a word's reduced word is joined with the reduced
vocabulary, and only edits that lead to a reduced word go on.

An edit that goes on is checked on the original strings by what it leaves: for a replaced letter the word
without the letter at that place, for an inserted or deleted one the shorter word. Words with the same rest
are near, so they meet by an aggregation on it and never pair by pair. A group holds at most one word per
letter of the alphabet (replaced), or per place and letter (inserted), however many words share a
reduced word.

Neighbourhoods are numbers, taken from running sums of a word's letters: a word costs time and memory in
proportion to its length, not to the square of it.
"""

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from changeflow.session import written

from . import bloom
from .tables import lower_ascii, text_of
from .words import U, mix, salted

SYMBOLS = 8
LEAST = 7
RATIO = 10
#: Edits of a batch that are held at once.
EDITS = 1 << 20

REPLACED, LONGER, SHORTER = 0, 1, 2
_BASE = int(salted(1, 11)[0])
_STEP = U(_BASE)
_BACK = U(pow(_BASE, -1, 1 << 64))
_SYMBOL_VALUES = salted(64, 12)


def vocabulary(docs, least=LEAST):
    """``wid, word, n``: the words of all texts with their occurrences, those met once left out.

    A word is a maximal run of Latin letters with A-Z lowered; every 31st by checksum of id and word
    loses a letter first, as a test of spelling. A null id counts as the empty string.
    """
    run = F.regexp_extract_all(text_of(docs), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("of"), F.explode(run).alias("run"))
    lowered = runs.select("of", lower_ascii(F.col("run")).alias("run"))
    check = F.crc32(F.concat("of", F.lit(":"), "run").cast("binary"))
    at = (F.col("check") % F.length("run")).cast("int")
    words = lowered.withColumn("check", check).select(
        F.when(
            F.col("check") % 31 == 0,
            F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))),
        ).otherwise(F.col("run")).alias("word")
    )
    counted = words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    return written(counted.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "vocabulary")


def symbols(letters, count=SYMBOLS):
    """The symbol of each code point."""
    return (mix(letters.astype(U) + U(0x51ED)) % U(count)).astype(np.int64)


def _powers(n):
    steps = np.full(n, _STEP, U)
    steps[:1] = 1
    return np.cumprod(steps)


def _sums(values, powers):
    out = np.zeros((values.shape[0], values.shape[1] + 1), U)
    np.cumsum(values * powers[: values.shape[1]], axis=1, out=out[:, 1:])
    return out


def _name(sums, length):
    """The name of a string from its polynomial and its length."""
    return mix(sums + U(length * 0x9E3779B97F4A7C15 % (1 << 64)))


def by_length(words):
    """Words as matrices of code points, one per length: positions in the batch, matrix."""
    sizes = np.array([len(w) for w in words], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, EDITS // int(size))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            letters = np.frombuffer("".join(words[j] for j in part).encode("utf-32-le"), np.uint32)
            yield part, letters.reshape(len(part), size)


def reduced_names(letters, count=SYMBOLS):
    values = _SYMBOL_VALUES[symbols(letters, count)]
    return _name(_sums(values, _powers(letters.shape[1]))[:, -1], letters.shape[1])


def neighbourhood(letters, count=SYMBOLS):
    """The full one-edit neighbourhood of each word's reduced word, by ranges of places.

    Yields arrays: word, kind of edit, place, name of the reduced neighbour, name of the original rest, and
    whether the neighbour is the reduced word itself (a letter replaced by one of its own symbol).
    """
    m, size = letters.shape
    held = symbols(letters, count)
    powers = _powers(size + 1)
    reduced = _sums(_SYMBOL_VALUES[held], powers)
    original = _sums(mix(letters.astype(U) + U(0xA5)) | U(1), powers)
    whole = _name(original[:, -1], size)
    alphabet = _SYMBOL_VALUES[:count]
    step = max(1, EDITS // (m * count))
    for low in range(0, size + 1, step):
        high = min(low + step, size)
        at = np.arange(low, high)
        before, after = reduced[:, low:high], reduced[:, -1:] - reduced[:, low + 1 : high + 1]
        shorter = _name(before + after * _BACK, size - 1)
        rest = _name(original[:, low:high] + (original[:, -1:] - original[:, low + 1 : high + 1]) * _BACK, size - 1)
        word, place = np.repeat(np.arange(m), len(at)), np.tile(at, m)
        no = np.zeros(len(word), bool)
        yield word, LONGER, place, shorter.ravel(), rest.ravel(), no
        change = alphabet[None, None, :] - _SYMBOL_VALUES[held[:, low:high]][:, :, None]
        replaced = _name(reduced[:, -1:][:, :, None] + change * powers[at][None, :, None], size)
        same = held[:, low:high][:, :, None] == np.arange(count)
        # The place belongs to the rest: words without their letter there must agree at the same place.
        kept = mix(rest + at.astype(U) * U(2) + U(1))
        yield (
            np.repeat(word, count), REPLACED, np.repeat(place, count), replaced.ravel(),
            np.repeat(kept.ravel(), count), same.ravel(),
        )
        spots = np.arange(low, min(low + step, size + 1))
        grown = (
            reduced[:, spots][:, :, None]
            + alphabet[None, None, :] * powers[spots][None, :, None]
            + ((reduced[:, -1:] - reduced[:, spots]) * _STEP)[:, :, None]
        )
        n = len(spots) * count
        yield (
            np.repeat(np.arange(m), n), SHORTER, np.zeros(m * n, np.int64), _name(grown, size + 1).ravel(),
            np.repeat(whole, n), np.zeros(m * n, bool),
        )


def _reduced(count):
    def made(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            for _, letters in by_length(words):
                yield pa.RecordBatch.from_arrays([pa.array(reduced_names(letters, count).view(np.int64))], names=["reduced"])

    return made


def _edits(count, known, shared):
    def made(batches):
        for batch in batches:
            wids, words = batch.column("wid").to_numpy(), batch.column("word").to_pylist()
            for part, letters in by_length(words):
                for word, kind, place, reduced, rest, same in neighbourhood(letters, count):
                    names = reduced.view(np.int64)
                    keep = np.where(same, False, known.contains(names))
                    own = np.flatnonzero(same)
                    if len(own):
                        keep[own] = shared.contains(names[own])
                    kept = np.flatnonzero(keep)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(wids[part[word[kept]]]),
                            pa.array(np.full(len(kept), kind, np.int8)),
                            pa.array(place[kept].astype(np.int32)),
                            pa.array(names[kept]),
                            pa.array(rest[kept].view(np.int64)),
                            pa.array(same[kept]),
                        ],
                        names=["wid", "kind", "place", "reduced", "rest", "same"],
                    )

    return made


def near_groups(words, count=SYMBOLS):
    """``rest, kind, place, wid``: words whose edit leaves the same rest, groups of one left out.

    Rests are 64-bit names here; ``near_words`` compares the strings.
    """
    reduced = written(
        words.select("word").mapInArrow(_reduced(count), "reduced long").groupBy("reduced").agg(F.count("*").alias("holders")),
        "reduced-words",
    )
    several = written(reduced.where("holders > 1").select("reduced"), "shared-reduced-words")
    known = bloom.build(reduced, "reduced", reduced.count())
    shared = bloom.build(several, "reduced", several.count())
    edits = words.select("wid", "word").mapInArrow(
        _edits(count, known, shared), "wid long, kind byte, place int, reduced long, rest long, same boolean"
    )
    met = edits.join(reduced, "reduced").where("not same or holders > 1")
    groups = (
        met.select("rest", F.struct("kind", "place", "wid").alias("member"))
        .groupBy("rest")
        .agg(F.collect_set("member").alias("members"))
        .where(F.size("members") > 1)
    )
    return groups.select(F.explode("members").alias("m")).select("m.*")


def near_words(words, count=SYMBOLS):
    """``word, n, near, near_n, n_near``: per word and rest the near word of largest n and how many are near.

    A word may have several rows, one per rest; every pair of near words shares exactly one.
    """
    members = near_groups(words, count).join(words, "wid")
    cut = F.concat(F.substring("word", F.lit(1), F.col("place")), F.substring("word", F.col("place") + 2, F.length("word")))
    replaced = F.col("kind") == REPLACED
    rest = F.when(F.col("kind") == SHORTER, F.col("word")).otherwise(cut)
    met = (
        members.select(
            replaced.alias("replaced"), F.when(replaced, F.col("place")).alias("place"), rest.alias("rest"),
            F.struct((-F.col("n")).alias("rank"), "word", (F.col("kind") == LONGER).alias("longer")).alias("m"),
        )
        .groupBy("replaced", "place", "rest")
        .agg(F.array_sort(F.collect_set("m")).alias("met"))
        .where(F.size("met") > 1)
    )
    # Of words that differ in a letter all others are near, of a word and its longer ones the other side.
    others = F.filter("met", lambda o: (o["word"] != F.col("m.word")) & (F.col("replaced") | (o["longer"] != F.col("m.longer"))))
    return (
        met.select("replaced", "met", F.explode("met").alias("m"))
        .select("m", others.alias("near"))
        .where(F.size("near") > 0)
        .select(
            "m.word",
            (-F.col("m.rank")).alias("n"),
            F.col("near")[0]["word"].alias("near"),
            (-F.col("near")[0]["rank"]).alias("near_n"),
            F.size("near").cast("long").alias("n_near"),
        )
    )


def roots(forms):
    """``word, root``: where following ``forms(word, form)`` from each word ends.

    Each round doubles how far a word looks; counts grow tenfold with each form, so a few rounds do.
    """
    current = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = current.select(F.col("word").alias("at"), F.col("root").alias("further"))
        stepped = current.join(ahead, current["root"] == ahead["at"], "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        stepped = written(stepped, "forms")
        if not stepped.where("moved").limit(1).count():
            return stepped.select("word", "root")
        current = stepped.select("word", "root")


def spelling_variants(docs, count=SYMBOLS, least=LEAST, ratio=RATIO):
    """word, n, form, root, n_near, form_n of every word of at least ``least`` letters met twice.

    form is the near word of largest n, of equal ones the first by code points, if it is at least ``ratio``
    times as frequent; root is where forms end. Near are words that differ by one inserted, deleted or
    replaced letter. Null and empty texts hold no words; repeated rows count each time; an empty table
    gives no rows. A very long run of letters is one word like any other. Columns beside doc_id and text
    are not read, whatever their names.
    """
    words = vocabulary(docs, least)
    best = (
        near_words(words, count)
        .groupBy("word", "n")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    )
    takes = -F.col("best.rank") >= ratio * F.col("n")
    judged = written(
        best.select(
            "word", "n_near", F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.rank")).alias("form_n")
        ),
        "near-words",
    )
    root = roots(judged.where("form is not null"))
    return (
        words.select("word", "n")
        .join(judged, "word", "left")
        .join(root, "word", "left")
        .select("word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
    )
