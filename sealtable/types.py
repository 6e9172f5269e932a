"""Column types: names, Python classes and Spark types, and the checks of a row's values."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Mapping
from typing import Any

from pyspark.sql import types as T

#: Declared name or class -> Spark type.
SPARK_TYPES: dict[Any, T.DataType] = {
    "str": T.StringType(),
    "int": T.LongType(),
    "float": T.DoubleType(),
    "bool": T.BooleanType(),
    "datetime": T.TimestampNTZType(),
    "bytes": T.BinaryType(),
    str: T.StringType(),
    int: T.LongType(),
    float: T.DoubleType(),
    bool: T.BooleanType(),
    datetime.datetime: T.TimestampNTZType(),
    bytes: T.BinaryType(),
    decimal.Decimal: T.DecimalType(38, 18),
}
#: Engine columns: hidden insertion order, row id, undeclared fields as JSON fragments, row hash.
SEQ, ID, EXTRA, HASH = "_seq", "id", "_extra", "hash"
#: Names that never take part in a row's hash.
UNHASHED = {ID, HASH, "_metadata", SEQ, EXTRA}
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def spark_type(declared: Any) -> T.DataType:
    """The Spark type of a declared column; an unknown name is a string, as imports have it."""
    if isinstance(declared, T.DataType):
        return declared
    if declared in SPARK_TYPES:
        return SPARK_TYPES[declared]
    if isinstance(declared, str):
        return T.StringType()
    raise TypeError(f"No column type for {declared!r}")


def type_name(kind: T.DataType) -> str:
    """The name under which a type is exported."""
    names = {T.StringType: "str", T.LongType: "int", T.DoubleType: "float", T.BooleanType: "bool", T.TimestampNTZType: "datetime", T.BinaryType: "bytes"}
    return names.get(type(kind), kind.simpleString())


def table_schema(columns: Mapping[str, Any]) -> T.StructType:
    """The stored schema of a table with these declared columns."""
    fields = [T.StructField(SEQ, T.LongType()), T.StructField(ID, T.LongType())]
    fields += [T.StructField(name, spark_type(kind)) for name, kind in columns.items() if name not in (ID, HASH)]
    fields += [T.StructField(EXTRA, T.MapType(T.StringType(), T.StringType())), T.StructField(HASH, T.StringType())]
    return T.StructType(fields)


def checked(name: str, value: Any, kind: T.DataType, nullable: bool = False) -> Any:
    """``value`` as it is stored in a column of ``kind``, or TypeError/OverflowError. Bools are ints 0 and 1."""
    if value is None and nullable:
        return None
    classes = {
        T.StringType: str,
        T.LongType: int,
        T.DoubleType: float,
        T.BooleanType: bool,
        T.TimestampNTZType: datetime.datetime,
        T.BinaryType: bytes,
        T.DecimalType: decimal.Decimal,
        T.ArrayType: (list, tuple),
        T.MapType: dict,
        T.StructType: dict,
    }
    wanted = classes.get(type(kind), object)
    if not isinstance(value, wanted):
        raise TypeError(f"Field {name} must be of type {type_name(kind)}, not {type(value).__name__}")
    if isinstance(kind, T.LongType):
        value = int(value)
        if not LONG_MIN <= value <= LONG_MAX:
            raise OverflowError(f"Field {name} does not fit 64 bits")
    return value
