"""Exact similarity join on word n-grams by vertical partitioning of the n-gram order.

All n-grams have one global order: those of few documents first, then the frequent ones, each part
by hash. The order is cut into fragments, and a document's set into the segments that lie in them.
A pair of documents is found, and judged, by partial overlaps counted in each fragment on its own
and summed per pair.

1. Sets. Documents with equal sets form a class (128 bits of all their n-grams); what follows sees
   one set per class, so copies cost nothing.
2. Order. n-grams are counted over all documents, fragment by fragment, as sorted runs of keys. Those
   in more than ``GROUP`` classes move to the end of the order. That list has a size bound, kept by
   raising the count; the order only decides how fast the join is, not what it finds.
3. Candidates. Two sets that overlap enough share an n-gram among the first of each (prefix). Each
   fragment counts the shared prefix n-grams of its pairs; the sum drops pairs that could not reach
   the threshold even if all the rest were shared.
4. Frequent n-grams in a prefix mean a document made of common parts, or a large group of near
   copies. Members are first paired with the group's most common document alone. After verification,
   groups whose members are linked into one component need no more; only members of different
   components and of near sizes are compared further, where the n-gram can be the first that the two
   share. A group's most common component is never joined with itself.
5. Verification. Segments of the classes in a candidate pair meet fragment by fragment; their
   overlaps are summed, and pairs that reach the threshold are links.
6. Components of links give each document its group.

n-grams are 64-bit hashes and classes 63-bit ones: a wrong link needs a collision, at odds of about
one in a million for a billion classes.
"""

import math

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from changeflow.session import written

from . import bloom
from .components import components
from .tables import row_key
from .words import U, SPACES, blocks, byte_set, cut, mix, ngrams, word_hashes

N = 5
PERCENT = 80
GROUP = 32
FREQUENT_KEYS = 1_000_000
FRAGMENT_GRAMS = 4_000_000
SEGMENTS = 8
SALT_ROWS = 1024
SALTS = 64
#: n-grams a task holds before it sends what it has counted or placed.
COMBINE = 4_000_000

WORD_BYTES = byte_set(SPACES, inverted=True)
LOW = U(0xFFFFFFFF)


# --- sets --------------------------------------------------------------------------------------


def gram_sets(column, n):
    """Sorted distinct n-grams of each text, block by block: first row, n-grams, offset of each row."""
    for row, data, offsets in blocks(column):
        starts, ends, first = cut(data, offsets, WORD_BYTES)
        grams, rows = ngrams(word_hashes(data, starts, ends), first, n)
        order = np.lexsort((grams, rows))
        grams, rows = grams[order], rows[order]
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
        grams, rows = grams[fresh], rows[fresh]
        yield row, grams, np.searchsorted(rows, np.arange(len(offsets)))


def class_ids(grams, at):
    """A positive number for each set, equal for equal sets; 0 for the empty set."""
    sums = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(grams ^ U(salt)), dtype=U)])
        sums.append(total[at[1:]] - total[at[:-1]])
    sizes = np.diff(at)
    found = mix(mix(sums[0]) ^ (mix(sums[1]) * U(3)) ^ sizes.astype(U)) >> U(1)
    return np.where(sizes > 0, np.maximum(found, U(1)), U(0)).astype(np.int64)


def document_sets(docs, n):
    """doc_id, row_key, n_shingles and class_id of every row."""

    def sized(batches):
        for batch in batches:
            sizes, classes = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for row, grams, at in gram_sets(batch.column("text"), n):
                sizes[row : row + len(at) - 1] = np.diff(at)
                classes[row : row + len(at) - 1] = class_ids(grams, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes), pa.array(classes)],
                names=["doc_id", "row_key", "n_shingles", "class_id"],
            )

    return docs.mapInArrow(sized, "doc_id long, row_key long, n_shingles long, class_id long")


def _each_class_once(batches, n):
    """Sets of a partition, one per class: n-grams, offsets, class ids."""
    seen = set()
    for batch in batches:
        for _, grams, at in gram_sets(batch.column("text"), n):
            classes = class_ids(grams, at)
            keep = np.zeros(len(classes), bool)
            for i, c in enumerate(classes.tolist()):
                if c and c not in seen:
                    seen.add(c)
                    keep[i] = True
            sizes = np.diff(at)
            yield grams[np.repeat(keep, sizes)], sizes[keep], classes[keep]


# --- order -------------------------------------------------------------------------------------


def _planes(values, kind):
    """Bytes of numbers, all first bytes before all second ones, so that small numbers compress."""
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(data, kind):
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def fragment_of(grams, fragments):
    """Fragments of equal ranges of the hash order."""
    return ((grams >> U(32)) * U(fragments)) >> U(32)


def _counted_in_task(n, fragments):
    """Distinct keys of a task with their counts, sent whenever ``COMBINE`` n-grams are held."""

    def combined(held):
        grams = np.sort(np.concatenate(held))
        cuts = np.searchsorted(fragment_of(grams, fragments), np.arange(fragments + 1, dtype=U))
        for fragment in range(fragments):
            low = (grams[cuts[fragment] : cuts[fragment + 1]] & LOW).astype(np.uint32)
            if len(low):
                keys, counts = np.unique(low, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([fragment], pa.int32()),
                        pa.array([_planes(np.diff(keys, prepend=np.uint32(0)), "<u4")], pa.binary()),
                        pa.array([_planes(counts - 1, "<u4")], pa.binary()),
                    ],
                    names=["fragment", "steps", "again"],
                )

    def count(batches):
        held, size = [], 0
        for grams, _, _ in _each_class_once(batches, n):
            held.append(grams)
            size += len(grams)
            if size >= COMBINE:
                yield from combined(held)
                held, size = [], 0
        if held:
            yield from combined(held)

    return count


def _summed(table):
    """Keys of one fragment with their counts over all tasks."""
    keys = np.concatenate([np.cumsum(_from_planes(c.as_buffer(), "<u4"), dtype=np.uint32) for c in table.column("steps")])
    counts = np.concatenate([_from_planes(c.as_buffer(), "<u4").astype(np.int64) + 1 for c in table.column("again")])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint32(1)))
    return keys[first], np.add.reduceat(counts, first)


def _frequent(least):
    def find(table):
        keys, counts = _summed(table)
        fragment = table.column("fragment")[0].as_py()
        often = counts > least
        return pa.table(
            {
                "key": pa.array((np.int64(fragment) << np.int64(32)) | keys[often].astype(np.int64)),
                "n": pa.array(counts[often].astype(np.int64)),
            }
        )

    return find


def frequent_grams(docs, n, fragments, most=FREQUENT_KEYS):
    """Keys (fragment, low bits) of the n-grams in more than ``GROUP`` sets, ``most`` at most, sorted.

    Where there are more, the least count goes up until they fit.
    """
    runs = docs.select("text").mapInArrow(_counted_in_task(n, fragments), "fragment int, steps binary, again binary")
    found = written(runs.groupBy("fragment").applyInArrow(_frequent(GROUP), "key long, n long"), "frequent")
    number = found.count()
    while number > most:
        least = found.agg(F.percentile_approx("n", 1 - most / number / 2)).first()[0]
        found = found.where(F.col("n") > least)
        number = found.count()
    return np.sort(np.array([r.key for r in found.select("key").collect()], np.int64))


# --- candidates --------------------------------------------------------------------------------


def prefix_length(sizes, percent=PERCENT):
    """How many first n-grams of a set must share one with any set that is similar enough."""
    return sizes - -(-sizes * percent // 100) + 1


def least_overlap(a, b, percent=PERCENT):
    """The least number of shared n-grams with which sets of sizes ``a`` and ``b`` are linked."""
    return -(-(a + b) * percent // (100 + percent))


def _postings(n, fragments, frequent, percent):
    """Light prefix n-grams as blobs by fragment of the prefix range; frequent ones row by row."""
    low_part = max(1, fragments * 7 // 8)
    quarter = U(1 << 62)

    def place(grams):
        inside = ((grams >> U(30)) * U(low_part)) >> U(32)
        beyond = U(low_part) + (((grams >> U(32)) * U(fragments - low_part)) >> U(32))
        return np.where(grams < quarter, inside, np.minimum(beyond, U(fragments - 1))).astype(np.int64)

    def blobs(held):
        fragment, key, classes, sizes, rest = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((key, fragment))
        fragment, key, classes, sizes, rest = (x[order] for x in (fragment, key, classes, sizes, rest))
        cuts = np.searchsorted(fragment, np.arange(fragments + 1))
        for f in range(fragments):
            a, b = cuts[f], cuts[f + 1]
            if b > a:
                yield _blob(f, key[a:b], classes[a:b], sizes[a:b], rest[a:b])

    def post(batches):
        held, size = [], 0
        for grams, sizes, classes in _each_class_once(batches, n):
            row = np.repeat(np.arange(len(sizes)), sizes)
            keys = ((fragment_of(grams, fragments) << U(32)) | (grams & LOW)).astype(np.int64)
            at = np.minimum(np.searchsorted(frequent, keys), max(len(frequent) - 1, 0))
            often = frequent[at] == keys if len(frequent) else np.zeros(len(keys), bool)
            order = np.lexsort((grams, often, row))
            first = np.cumsum(sizes) - sizes
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - first[row]
            chosen = rank < prefix_length(sizes, percent)[row]
            n_light = np.bincount(row[chosen & ~often], minlength=len(sizes))
            light = np.flatnonzero(chosen & ~often)
            r = row[light]
            held.append((place(grams[light]), (grams[light] & LOW).astype(np.uint32), classes[r], sizes[r], (sizes - n_light)[r]))
            heavy = np.flatnonzero(chosen & often)
            if len(heavy):
                yield _rows(
                    -1 - (mix(grams[heavy] ^ classes[row[heavy]].astype(U)) % U(fragments)).astype(np.int64),
                    keys[heavy], classes[row[heavy]], sizes[row[heavy]], sizes[row[heavy]] - rank[heavy], n_light[row[heavy]],
                )
            size += len(light)
            if size >= COMBINE:
                yield from blobs(held)
                held, size = [], 0
        if held:
            yield from blobs(held)

    return post


POSTED = "fragment long, key long, class_id long, size long, rest long, light long, keys binary, classes binary, sizes binary, rests binary"


def _rows(fragment, key, classes, sizes, rest, light):
    none = pa.nulls(len(key), pa.binary())
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x.astype(np.int64)) for x in (fragment, key, classes, sizes, rest, light)), none, none, none, none],
        names=[c.split()[0] for c in POSTED.split(", ")],
    )


def _blob(fragment, key, classes, sizes, rest):
    number = pa.nulls(1, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([fragment]), number, number, number, number, number,
            pa.array([_planes(np.diff(key, prepend=np.uint32(0)), "<u4")]),
            pa.array([classes.astype("<i8").tobytes()]),
            pa.array([_planes(sizes, "<u4")]),
            pa.array([_planes(rest, "<u4")]),
        ],
        names=[c.split()[0] for c in POSTED.split(", ")],
    )


FOUND = "a long, b long, size_a long, size_b long, rest long, shared long, key long"


def _found(a, b, size_a, size_b, rest, shared, key):
    return pa.table({"a": a, "b": b, "size_a": size_a, "size_b": size_b, "rest": rest, "shared": shared, "key": key})


def _fragment_pairs(percent):
    """Pairs of a fragment with the number of light prefix n-grams they share in it."""

    def pairs(table):
        if table.column("fragment")[0].as_py() < 0:
            n = len(table)
            zero = np.zeros(n, np.int64)
            return _found(table.column("class_id"), zero, table.column("size"), zero, table.column("rest"), table.column("light"), table.column("key"))
        key = np.concatenate([np.cumsum(_from_planes(c.as_buffer(), "<u4"), dtype=np.uint32) for c in table.column("keys")])
        classes, sizes, rest = (
            np.concatenate([decode(c.as_buffer()) for c in table.column(name)])
            for name, decode in (
                ("classes", lambda x: np.frombuffer(x, "<i8")),
                ("sizes", lambda x: _from_planes(x, "<u4").astype(np.int64)),
                ("rests", lambda x: _from_planes(x, "<u4").astype(np.int64)),
            )
        )
        # Only keys of several entries matter; ``_each_class_once`` leaves one class per task.
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        several = np.zeros(len(key), bool)
        several[1:] |= same
        several[:-1] |= same
        order, key = order[several], key[several]
        classes, sizes, rest = classes[order], sizes[order], rest[order]
        order = np.lexsort((classes, key))
        key, classes, sizes, rest = key[order], classes[order], sizes[order], rest[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (classes[1:] != classes[:-1])
        key, classes, sizes, rest = key[fresh], classes[fresh], sizes[fresh], rest[fresh]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.append(heads, len(key)))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in np.unique(counts):
            if 2 <= m <= GROUP:
                at = heads[counts == m]
                i, j = np.triu_indices(m, 1)
                left.append((at[:, None] + i).ravel())
                right.append((at[:, None] + j).ravel())
        large = np.flatnonzero(counts > GROUP)
        left, right = np.concatenate(left), np.concatenate(right)
        small, big = np.minimum(sizes[left], sizes[right]), np.maximum(sizes[left], sizes[right])
        fits = small * 100 >= big * percent
        left, right = left[fits], right[fits]
        pair, shared = _counted_pairs(classes, left, right)
        l, r = left[pair], right[pair]
        members = np.concatenate([np.arange(heads[g], heads[g] + counts[g]) for g in large]) if len(large) else np.zeros(0, np.int64)
        zero = np.zeros(len(members), np.int64)
        fragment = np.int64(table.column("fragment")[0].as_py())
        # Groups too large for all pairs join the frequent ones, under a key of their own.
        own = -1 - ((fragment << np.int64(32)) | key[members].astype(np.int64))
        return _found(
            *(
                np.concatenate(x)
                for x in (
                    (classes[l], classes[members]),
                    (classes[r], zero),
                    (sizes[l], sizes[members]),
                    (sizes[r], zero),
                    (np.maximum(rest[l], rest[r]), sizes[members]),
                    (shared, sizes[members] - rest[members]),
                    (np.zeros(len(l), np.int64), own),
                )
            )
        )

    return pairs


def _counted_pairs(classes, left, right):
    """The first place of each distinct pair, and how often it occurs."""
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((classes[right], classes[left]))
    a, b = classes[left][order], classes[right][order]
    heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return order[heads], np.diff(np.append(heads, len(order)))


def _fits(a, b, percent):
    small, big = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    return small * 100 >= big * percent


def light_pairs(found, percent):
    """Pairs by light n-grams that the summed overlaps do not rule out."""
    least = F.ceil((F.col("size_a") + F.col("size_b")) * percent / (100 + percent))
    summed = (
        found.where("b <> 0")
        .groupBy("a", "b")
        .agg(
            F.sum("shared").alias("shared"),
            *[F.max(c).alias(c) for c in ("size_a", "size_b", "rest")],
        )
    )
    return summed.where(F.col("shared") + F.col("rest") >= least).select("a", "b", "size_a", "size_b")


def _may_link(percent):
    """Whether two members of a group could be similar if its n-gram is the first they share.

    ``rest`` counts a member's n-grams from this one on in the global order. If it is the first shared
    one, no more than the smaller rest can be shared; and every pair meets at its first.
    """
    most = F.least(F.col("rest_a"), F.col("rest_b"))
    enough = most * (100 + percent) >= (F.col("size_a") + F.col("size_b")) * percent
    return _fits("size_a", "size_b", percent) & enough


def star_pairs(members, percent):
    """Every member of a frequent n-gram's group with the group's most common document.

    That is the one with the fewest n-grams that are not frequent: of near copies the least changed, so
    most of the group links to it and the second comparison has little left.
    """
    heads = members.groupBy("key").agg(F.min(F.struct("light", "class_id", "size", "rest")).alias("head"))
    joined = members.join(heads, "key").where("class_id <> head.class_id")
    swap = F.col("class_id") > F.col("head.class_id")
    ends = {c: (F.col(c), F.col(f"head.{c}")) for c in ("class_id", "size", "rest")}
    named = {"class_id": ("a", "b"), "size": ("size_a", "size_b"), "rest": ("rest_a", "rest_b")}
    return (
        joined.select(
            *[F.when(swap, y).otherwise(x).alias(named[c][0]) for c, (x, y) in ends.items()],
            *[F.when(swap, x).otherwise(y).alias(named[c][1]) for c, (x, y) in ends.items()],
        )
        .where(_may_link(percent))
        .select("a", "b", "size_a", "size_b")
    )


def _bands(percent):
    """A member's band of sizes: those of similar sets are equal or neighbours.

    A band is a little wider than the threshold's ratio, so that rounding cannot part two sets.
    """
    return F.floor(F.log("size") / math.log(1.01 * 100 / percent)).cast("long")


def meetings(placed, percent):
    """Pairs of a group's members ``placed(key, class_id, size, rest, root)`` that are brought together.

    A member meets members of its band of sizes and of the next one: a cell. The cell's most common
    component is kept from meeting itself. Any other is no larger, so that its pairs within itself are
    no more than its pairs with the most common one: what is formed grows with the pairs of different
    components, however large a component is. Cells of one component form nothing, and cells of many
    members are dealt out over several tasks.
    """
    banded = placed.withColumn("band", _bands(percent))
    second = banded.select("*", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("cell"))
    shares = second.groupBy("key", "cell", "root").agg(F.count("*").alias("n"))
    cells = written(
        shares.groupBy("key", "cell")
        .agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("main"))
        .where("roots > 1")
        .select("key", "cell", "main", F.least(F.ceil(F.col("n") / SALT_ROWS), F.lit(SALTS)).cast("int").alias("salts")),
        "open-cells",
    )
    columns = ("class_id", "size", "rest", "root", "band")
    others = F.col("root") != F.col("main")
    one = banded.withColumn("cell", F.col("band")).join(cells, ["key", "cell"]).select(
        "key",
        "cell",
        F.explode(F.when(others, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("in_main"),
        F.pmod(F.xxhash64("class_id"), F.col("salts")).cast("int").alias("salt"),
        *[F.col(c).alias(f"{c}_a") for c in columns],
    )
    two = second.join(cells, ["key", "cell"]).select(
        "key",
        "cell",
        (~others).alias("in_main"),
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        *[F.col(c).alias(f"{c}_b") for c in columns],
    )
    # Written, so that the join deals rows out anew and splits what is skewed.
    return written(one, "meet").join(written(two, "met"), ["key", "cell", "in_main", "salt"])


def apart_pairs(placed, percent):
    """Pairs of a group's members in different components that may be similar, each listed once or more."""
    swap = F.col("class_id_a") > F.col("class_id_b")
    ends = (("a", "class_id"), ("size_a", "size"))
    named = {"a": "b", "size_a": "size_b"}
    return (
        meetings(placed, percent)
        .where("root_a <> root_b and (band_a <> band_b or class_id_a < class_id_b)")
        .where(_may_link(percent))
        .select(
            *[F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(name) for name, c in ends],
            *[F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(named[name]) for name, c in ends],
        )
        .select("a", "b", "size_a", "size_b")
    )


# --- verification ------------------------------------------------------------------------------


def _segments(n, wanted):
    def cut_up(batches):
        for batch in batches:
            keep = wanted.contains(batch.column("row_key").to_numpy())
            if not keep.any():
                continue
            batch = batch.filter(pa.array(keep))
            for _, grams, at in gram_sets(batch.column("text"), n):
                classes, sizes = class_ids(grams, at), np.diff(at)
                row = np.repeat(np.arange(len(sizes)), sizes)
                segment = fragment_of(grams, SEGMENTS).astype(np.int64)
                heads = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(segment) != 0)])) if len(row) else np.zeros(0, np.int64)
                grams_of = pa.ListArray.from_arrays(
                    pa.array(np.append(heads, len(row)).astype(np.int32)), pa.array(grams.view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(classes[row[heads]]), pa.array(segment[heads]), grams_of],
                    names=["class_id", "segment", "grams"],
                )

    return cut_up


def verified(docs, sets, pairs, n, percent):
    """Those of ``pairs(a, b, size_a, size_b)`` that are similar enough, by partial overlaps."""
    classes = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id"))).distinct()
    rows = written(
        sets.join(classes, "class_id", "left_semi").groupBy("class_id").agg(F.min("row_key").alias("row_key")),
        "candidate-rows",
    )
    wanted = bloom.build(rows, "row_key", rows.count())
    segments = (
        docs.mapInArrow(_segments(n, wanted), "class_id long, segment long, grams array<long>")
        .join(rows.select("class_id"), "class_id", "left_semi")
        .dropDuplicates(["class_id", "segment"])
    )
    segments = written(segments, "segments")
    each = pairs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SEGMENTS - 1).cast("long"))).alias("segment"))
    left = segments.select(F.col("class_id").alias("a"), "segment", F.col("grams").alias("grams_a"))
    right = segments.select(F.col("class_id").alias("b"), "segment", F.col("grams").alias("grams_b"))
    partial = each.join(left, ["a", "segment"]).join(right, ["b", "segment"]).select(
        "a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("shared")
    )
    summed = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("shared").alias("shared"))
    return summed.where((100 + percent) * F.col("shared") >= percent * (F.col("size_a") + F.col("size_b"))).select("a", "b")


# --- join --------------------------------------------------------------------------------------


def links(docs, sets, n=N, percent=PERCENT):
    """Links between classes that connect all that are connected, and the components' labels.

    Every pair of similar classes is in one component; of a large group's pairs only some are listed.
    Returns (links(a, b), labels(node, root)).
    """
    grams = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    fragments = max(16, math.ceil(grams / FRAGMENT_GRAMS))
    frequent = frequent_grams(docs, n, fragments, FREQUENT_KEYS)
    found = written(
        docs.select("text")
        .mapInArrow(_postings(n, fragments, frequent, percent), POSTED)
        .groupBy("fragment")
        .applyInArrow(_fragment_pairs(percent), FOUND),
        "fragment-pairs",
    )
    members = found.where("b = 0").select("key", F.col("a").alias("class_id"), F.col("size_a").alias("size"), "rest", F.col("shared").alias("light")).distinct()
    first = written(
        light_pairs(found, percent).unionByName(star_pairs(members, percent)).distinct(), "candidates"
    )
    linked = written(verified(docs, sets, first, n, percent), "links")
    labels = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # Members of one group in different components: compare what has not been compared.
    placed = written(
        members.join(labels, F.col("class_id") == F.col("node"), "left").select(
            "key", "class_id", "size", "rest", F.coalesce("root", "class_id").alias("root")
        ),
        "placed",
    )
    second = written(
        apart_pairs(placed, percent).distinct().join(first, ["a", "b"], "left_anti"), "candidates"
    )
    if second.isEmpty():
        return linked, labels
    more = written(verified(docs, sets, second, n, percent), "links")
    linked = linked.unionByName(more)
    return linked, components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")))


def similar_groups(docs, n=N, percent=PERCENT):
    """Every row with its group of similar documents: doc_id, row_key, n_shingles, component_id.

    Two documents link when their sets of distinct word n-grams share at least ``percent`` in a hundred
    of their union; a group is what links connect, named by its smallest doc_id. A text of fewer
    words is one n-gram; null text, or one without words, has none and links with nothing. A row
    without an id has no component. Rows that repeat an id are told apart by their text.
    """
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("row_key"), docs["text"].cast("string").alias("text")
    )
    sets = written(document_sets(rows, n), "gram-sets")
    _, labels = links(rows.where("doc_id is not null"), sets.where("class_id <> 0 and doc_id is not null"), n, percent)
    joined = sets.join(labels, F.col("class_id") == F.col("node"), "left").select(
        "doc_id", "row_key", "n_shingles", "class_id", F.coalesce("root", "class_id").alias("root")
    )
    smallest = joined.where("class_id <> 0").groupBy("root").agg(F.min("doc_id").alias("smallest")).withColumnRenamed("root", "its_root")
    return joined.join(smallest, F.col("root") == F.col("its_root"), "left").select(
        "doc_id",
        "row_key",
        "n_shingles",
        F.when((F.col("class_id") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
    )


def drop_similar(docs, n=N, percent=PERCENT):
    """``docs`` with one document of each group, the one with the smallest id; columns unchanged.

    Rows without an id, or without words, stay. Of rows that repeat the staying id, those of the
    group's other texts go too, and one stays.
    """
    groups = similar_groups(docs, n, percent)
    grouped = groups.where("doc_id is not null and n_shingles > 0")
    out = grouped.where("doc_id <> component_id").select("row_key")
    rows = docs.join(out.withColumnRenamed("row_key", "__out"), row_key(docs) == F.col("__out"), "left_anti")
    repeats = grouped.where("doc_id = component_id").groupBy("component_id").agg(
        F.count("*").alias("n"), F.min("row_key").alias("__first")
    ).where("n > 1").select(F.col("component_id").alias("__repeated"), "__first")
    single = rows.join(repeats, docs["doc_id"] == F.col("__repeated"), "left_anti")
    first = repeats.select("__first")
    once = rows.join(first, row_key(docs) == F.col("__first"), "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(once)
