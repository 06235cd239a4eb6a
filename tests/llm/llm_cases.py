"""Small tables shared by the tests of the training-data operators."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use for columns of their own.
        *(T.StructField(c, T.StringType()) for c in ("kept", "row_key", "component_id", "key", "n", "norm", "line", "shard", "size", "site")),
    ]
)
CLASHES = len(SCHEMA) - 5


def table_of(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns."""
    full = []
    for doc_id, text, *more in rows:
        lang, source = more or ("en", "src0")
        full.append((doc_id, text, lang, source, None if text is None else len(text), *["x"] * CLASHES))
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows(seed=5):
    """Nulls, empty and blank texts, repeated rows, an id with two texts, a long text."""
    rng = random.Random(seed)
    base = words(rng, 60)
    long_text = words(rng, 60_000, 5000)
    return [
        (1, base),
        (1, base),
        (2, None, None, None),
        (3, ""),
        (4, " \n\t "),
        (None, base, None, "src1"),
        (None, None),
        (5, "one two"),
        (6, "one  two"),
        (7, long_text),
        (8, long_text + " end"),
        (9, words(rng, 30)),
        (9, words(rng, 31)),
        (-3, "ÀÉ ünï œ 你好 世界"),
        (10, base.upper() + "!"),
    ]


def corpus(seed=1, groups=12, alone=20):
    """Documents with exact and near copies, shared passages and short texts."""
    rng = random.Random(seed)
    passage = words(rng, 70, 10_000)
    rows, doc_id = [], 100
    for g in range(groups):
        base = words(rng, rng.randrange(20, 200), 3000).split()
        for c in range(rng.randrange(1, 6)):
            text = list(base)
            for _ in range(c * rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10_000)}"
            rows.append((doc_id, " ".join(text)))
            doc_id += rng.randrange(1, 3)
    for _ in range(alone):
        text = words(rng, rng.randrange(1, 40), 3000)
        rows.append((doc_id, f"{text} {passage} {words(rng, 5)}" if rng.random() < 0.5 else text))
        doc_id += 1
    rng.shuffle(rows)
    return rows
