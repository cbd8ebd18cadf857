"""JSON containment: a filter given as a dict is compiled to a predicate on a variant column.

An object holds a filter if it has each of its keys with a value that holds the filter's value; an array holds a list if
each element of the list is held by some element, in any order; scalars are equal in type and value, and numbers by value.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$"


def parsed(text: Column) -> Column:
    """JSON text as a variant; null if it is not JSON."""
    return F.try_parse_json(text)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def metadata_of(text: Column) -> Column:
    """Metadata as given: `{}` for blank or null, null where it is not a JSON object."""
    own = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("{}")).otherwise(text)
    # the parser takes what follows a whole value; within a list it does not
    alone = F.size(F.try_variant_get(parsed(F.concat(F.lit("["), own, F.lit("]"))), "$", "array<variant>")) == 1
    return F.when(is_object(parsed(own)) & alone, own)


def path(key: str) -> str:
    """The path of an object's key."""
    return "$[" + ("'" + key + "'" if "'" not in key else '"' + key + '"') + "]"


def contains(v: Column, needle) -> Column:
    kind = F.schema_of_variant(v)
    if isinstance(needle, Mapping):
        out = kind.startswith("OBJECT")
        for key, value in needle.items():
            out = out & contains(F.try_variant_get(v, path(str(key)), "variant"), value)
    elif isinstance(needle, list | tuple):
        own = F.try_variant_get(v, "$", "array<variant>")
        out = kind.startswith("ARRAY")
        for value in needle:
            out = out & F.exists(F.coalesce(own, F.array().cast("array<variant>")), _held(value))
    elif needle is None:
        out = F.is_variant_null(v)
    elif isinstance(needle, bool):
        out = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == needle)
    elif isinstance(needle, int | float):
        exact = isinstance(needle, int) and abs(needle) > 2**53
        out = kind.rlike(_NUMBER) & (F.try_variant_get(v, "$", "decimal(38,0)" if exact else "double") == F.lit(needle))
    else:
        out = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == str(needle))
    return F.coalesce(out, F.lit(False))


def _held(value):
    return lambda x: contains(x, value)


def checked(filters) -> dict | None:
    """A filter as a dict; None if there is none. Raises ValueError for anything but an object."""
    if filters is None or filters == "":
        return None
    if isinstance(filters, str):
        filters = json.loads(filters)
    if not isinstance(filters, Mapping):
        raise ValueError("a filter must be a JSON object")
    return dict(filters) or None


def filtered(df: DataFrame, filters, metadata: str = "metadata") -> DataFrame:
    """The rows whose JSON metadata holds the filter; all rows for an empty filter."""
    own = checked(filters)
    return df if own is None else df.filter(contains(parsed(F.col(metadata)), own))
