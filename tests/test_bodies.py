"""The bytes of message bodies, against a plain encoder."""

import random

import pytest
from pyspark.sql import functions as F

from changeflow.functions import canonical_body
from changeflow.operators import envelope
from changeflow.schemas import CATALOG_SCHEMA

SHORT = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def plain(text):
    """One character at a time."""
    out = []
    for c in text:
        if c in SHORT:
            out.append(SHORT[c])
        elif ord(c) < 0x20 or c in "<>&\u2028\u2029":
            out.append(f"\\u{ord(c):04x}")
        else:
            out.append(c)
    return "".join(out)


CASES = [
    "", "plain", "<a href='x'>&</a>", "\u2028\u2029", "\\", "\\\\", "\\b", "\\\b", "\\\\b", "\b\b\f", "\\u001F", "\\\x1f",
    "\x1f\x0b\\\x0b", "\x7f", "\u00fc\u20ac\U0001f600", "a\tb\nc\rd", '"', '\\"', "\\\\\\f\f", "\x00\x01\x1a", "C:\\new\\bin\\folder",
]


@pytest.fixture(scope="module")
def encoded(spark):
    rng = random.Random(3)
    alphabet = "ab\\\\\\ufF0\"<&\b\f\n\x0b\x1f\u2028é"
    texts = CASES + ["".join(rng.choices(alphabet, k=rng.randrange(12))) for _ in range(400)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    json = F.to_json(F.struct("t"))
    rows = frame.select("i", canonical_body(json).alias("body")).collect()
    return [(texts[r.i], r.body) for r in rows]


def test_bodies_equal_the_plain_encoder(encoded):
    assert len(encoded) == len(CASES) + 400
    for text, body in encoded:
        assert body == '{"t":"' + plain(text) + '"}'


def test_a_null_and_a_long_text(spark):
    long = "<\\b\b" * 200_000
    frame = spark.createDataFrame([(None,), (long,)], "t string")
    json = F.to_json(F.struct("t"), {"ignoreNullFields": "false"})
    bodies = {r.body for r in frame.select(canonical_body(json).alias("body")).collect()}
    assert bodies == {'{"t":null}', '{"t":"' + plain(long) + '"}'}


def test_the_limit_decides_by_the_bytes_that_are_sent(spark):
    """Six bytes for each ``<``: a body that fits as plain JSON is too large as it is sent."""
    rows = spark.createDataFrame(
        [(1, 0, 7, "s", "t", "s.t", "insert", None, ["<" * 100])],
        "seq long, row_index int, ts_s long, schema_name string, table_name string, key string, action string,"
        " old_row array<string>, new_row array<string>",
    )
    catalog = spark.createDataFrame([("s", "t", ["c"], 1, 0)], CATALOG_SCHEMA)
    assert envelope.audit(rows, catalog, 300).first().outcome == "delivered"
    exact = envelope.audit(rows, catalog, 300, exact=True).first()
    assert exact.outcome == "oversize"
    assert exact.value == (
        '{"action":"insert","timestamp":7,"schema":"s","table":"t","values":{"c":"' + "\\u003c" * 100 + '"},"oldvalues":null}'
    )
