"""Unicode-aware text primitives as column expressions.

The patterns mean the same to Java's and RE2's regular expressions, so that SQL twins can share them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, for use in a character class.
WS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
#: A run of letters, numbers and underscores, or one other character that isn't white space.
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]"
EDGES = rf"^[{WS}]+|[{WS}]+$"
#: A segment may end here.
BOUNDARY = rf"[.!?][{WS}]*$"
#: ASCII white space without what RE2's \s leaves out: a line with another character is kept.
INK = r"[^ \t\n\r\f\x{0b}]"
#: Cell texts that a reader takes as missing, before it strips them.
NA_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
#: Stripped texts that stand for a missing value.
NA_TOKENS = ("nan",)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def n_tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TOKEN))


def ends_segment(c: Column) -> Column:
    return F.regexp_like(c, F.lit(BOUNDARY))


def present(c: Column) -> Column:
    """Neither null, nor blank, nor a token for a missing value."""
    return reduce(lambda a, b: a & b, (c != t for t in NA_TOKENS), c.isNotNull() & (c != ""))
