"""Equality conditions of the query language, compiled to column predicates.

Conditions compare as Python values do: a string never equals a number, True
equals 1, NaN equals nothing, None finds nulls and missing fields. Literals are
brought to the column's type on the driver, so a predicate is a bare
comparison that reaches the Parquet scan.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtable.functions.canonical import json_fragment
from sealtable.types import EXTRA, LONG_MAX, LONG_MIN

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Comparisons of the extended form ``{"column": {"$lt": 5}}``.
_OPERATORS = {
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
}


def compile_conditions(conditions: Mapping[str, Any] | None, schema: T.StructType, operators: bool = False) -> Column | None:
    """The conjunction of ``conditions``, or None where there are none.

    With ``operators``, a dict of ``$lt $lte $gt $gte $ne $in`` compares; without
    it, a dict is a value, which no plain column equals.
    """
    if not conditions:
        return None
    return reduce(lambda x, y: x & y, [_condition(n, v, schema, operators) for n, v in conditions.items()])


def _condition(name: str, value: Any, schema: T.StructType, operators: bool) -> Column:
    if name not in schema.names or name == EXTRA:
        if EXTRA not in schema.names:
            return F.lit(value is None)
        field = F.try_element_at(F.col(EXTRA), F.lit(name))
        return field.isNull() | (field == "null") if value is None else field == _fragment(value)
    column, kind = F.col(f"`{name}`"), schema[name].dataType
    if operators and isinstance(value, dict) and value and set(value) <= {*_OPERATORS, "$in"}:
        tests = [_any_of(column, v, kind) if op == "$in" else _OPERATORS[op](column, v) for op, v in value.items()]
        return reduce(lambda x, y: x & y, tests)
    return equals(column, value, kind)


def _any_of(column: Column, values: Any, kind: T.DataType) -> Column:
    return reduce(lambda x, y: x | y, [equals(column, v, kind) for v in values], F.lit(False))


def _fragment(value: Any) -> str:
    try:
        return json.dumps(value, sort_keys=True)
    except TypeError:
        return ""


def equals(column: Column, value: Any, kind: T.DataType) -> Column:
    """Where the column's value equals ``value`` in Python's sense."""
    never = F.lit(False)
    if value is None:
        return column.isNull()
    if isinstance(value, float) and math.isnan(value):
        return never
    number = isinstance(value, (bool, int, float, decimal.Decimal))
    if isinstance(kind, T.StringType):
        return column == value if isinstance(value, str) else never
    if isinstance(kind, T.BooleanType):
        return column == bool(value) if number and value in (0, 1) else never
    if isinstance(kind, _INTEGERS):
        if not number or math.isinf(value) or value != int(value) or not LONG_MIN <= int(value) <= LONG_MAX:
            return never
        return column == F.lit(int(value)).cast("long")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        try:
            return column == F.lit(float(value)) if number and float(value) == value else never
        except OverflowError:
            return never
    if isinstance(kind, T.DecimalType):
        return column == F.lit(decimal.Decimal(value)) if number and not isinstance(value, float) else never
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return column == F.lit(value).cast(kind) if isinstance(value, datetime.datetime) else never
    if isinstance(kind, T.DateType):
        return column == F.lit(value) if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime) else never
    if isinstance(kind, T.BinaryType):
        return column == F.lit(bytearray(value)) if isinstance(value, bytes) else never
    if isinstance(value, (list, tuple, dict)):
        text = json_fragment(column, kind)
        return column.isNotNull() & (text == _fragment(value))
    return never
