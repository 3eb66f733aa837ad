"""Reading JSON events whose shapes vary: truth and text of VARIANT values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FALSE = ("null", "false", "0", "0.0", '""', "[]", "{}")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it stands there.

    Expressions that repeat their argument and are nested grow by a power of their depth; a bound variable doesn't.
    """
    return F.get(F.transform(F.array(value), use), 0)


def parse(json: Column) -> Column:
    """A VARIANT, null for malformed JSON."""
    return F.try_parse_json(json)


def at(value: Column, *keys: str) -> Column:
    """The member named by the keys, which may hold dots."""
    path = "$" + "".join(f'["{k}"]' for k in keys)
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """The first character of the value's JSON: one of [ { " t f n - 0-9; null if missing."""
    return F.substring(F.to_json(value), 1, 1)


def truthy(value: Column) -> Column:
    """False for missing values, null, false, 0, and empty strings, arrays and objects."""
    return F.coalesce(~F.to_json(value).isin(*_FALSE), F.lit(False))


def first_true(*values: Column) -> Column:
    """The first of the values that is truthy; null without one."""
    return F.coalesce(*(let(v, lambda x: F.when(truthy(x), x)) for v in values))


def text(value: Column) -> Column:
    """A string as it is, anything else as JSON; null for missing values and null."""
    return let(value, lambda v: F.when(kind(v) == "n", F.lit(None).cast("string")).otherwise(F.when(kind(v) == '"', F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))))


def string(value: Column) -> Column:
    """The value if it is a string, else null."""
    return let(value, lambda v: F.when(kind(v) == '"', F.try_variant_get(v, "$", "string")))


def items(value: Column) -> Column:
    """The members of an array; null for other values."""
    return let(value, lambda v: F.when(kind(v) == "[", F.try_variant_get(v, "$", "array<variant>")))


def maybe_json(value: Column) -> Column:
    """A string that holds a JSON array or object, parsed; other values as they are."""
    parsed = lambda v: let(string(v), lambda s: F.when(s.rlike(r"^\s*[\[{]"), F.try_parse_json(s)))
    return let(value, lambda v: F.coalesce(parsed(v), v))
