"""The bytes of a message body as the relay being rebuilt writes them."""

from functools import reduce

from pyspark.sql import functions as F

#: Characters that stand as themselves in Spark's JSON and as escapes in a body.
ESCAPED = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}
#: Control characters with a short escape in Spark's JSON and a long one in a body.
LONG_ESCAPES = {"b": "0008", "f": "000c"}
#: Control characters whose escape has a letter; Spark's JSON writes it as a capital.
LETTERED = [f"{code:04x}" for code in range(0x20) if f"{code:04x}" != f"{code:04X}"]


def _escape_replaced(json, escape, other):
    """An escape after an even number of backslashes; after an odd one its own is a text's backslash."""
    return F.regexp_replace(json, rf"(?<!\\)((?:\\\\)*)\\{escape}", rf"$1\\u{other}")


def canonical_body(json):
    """The JSON text that ``to_json`` gives, with the escapes of a message body.

    ``<``, ``>``, ``&`` and the two line separators can stand in strings only, so they are replaced anywhere. Bodies
    without a rare control character skip its step. Text must be valid UTF-8.
    """
    body = reduce(lambda text, c: F.replace(text, F.lit(c), F.lit(ESCAPED[c])), ESCAPED, json)
    rare = F.regexp_like(body, F.lit(r"\\[bf]"))
    short = reduce(lambda text, c: _escape_replaced(text, c, LONG_ESCAPES[c]), LONG_ESCAPES, body)
    body = F.when(rare, short).otherwise(body)
    lettered = reduce(lambda text, code: _escape_replaced(text, f"u{code.upper()}", code), LETTERED, body)
    return F.when(F.regexp_like(body, F.lit(r"\\u00[01][A-F]")), lettered).otherwise(body)
