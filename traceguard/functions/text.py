"""Text normalisation before matching."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that ``cap`` leaves of a text (a fixed value); scans read texts to their end.
TEXT_CAP = 100_000
# Invisible code points that are removed.
INVISIBLE = "\\u200B\\u200C\\u200D\\u2060\\uFEFF\\u180E\\u00AD\\u034F\\u061C\\u115F\\u1160\\u17B4\\u17B5\\u3164\\uFFA0\\u200E\\u200F"
CONTROLS = "\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F"
#: A text of these characters only is its own NFKC form: ASCII, precomposed Latin and Cyrillic letters, common
#: punctuation, kana, unified ideographs and Hangul syllables.
PLAIN = "\\x00-\\x7F\\u00C0-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u0410-\\u044F\\u2013\\u2014\\u2018\\u2019\\u201C\\u201D\\u3041-\\u3096\\u30A1-\\u30FA\\u4E00-\\u9FFF\\uAC00-\\uD7A3"
#: A character that NFKC can change, and an invisible one. A class of many ranges is slow, so only what is not ASCII comes to it.
NOT_PLAIN = f"[^\\x00-\\x7F](?<![{PLAIN}])"
UNSEEN = f"[^\\x00-\\x7F](?<=[{INVISIBLE}])"


@F.arrow_udf(T.StringType())
def _nfkc(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in text.to_pylist()], pa.string())


def cap(text: Column, n: int = TEXT_CAP) -> Column:
    return F.substring(text, 1, n)


def blank(text: Column) -> Column:
    """Null, empty, or white space only."""
    return F.coalesce(~text.rlike("(?U)\\S"), F.lit(True))


def fold(text: Column) -> Column:
    """What ``normalize_text`` does to a text in NFKC."""
    text = F.regexp_replace(text, UNSEEN, "")
    text = F.regexp_replace(text, f"[{CONTROLS}]", "")
    return F.regexp_replace(text, "(?U)\\s+", " ")


def normalize_text(text: Column) -> Column:
    """NFKC, without invisible and control characters, every run of white space as one space; case is kept.

    Spark has no NFKC, so a Python function does it, but only texts that it can change are sent there.
    """
    return fold(F.coalesce(_nfkc(F.when(text.rlike(NOT_PLAIN), text)), text))
