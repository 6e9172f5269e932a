"""The canonical JSON of a row, and its SHA-256, as native column expressions.

The form is that of a JSON object with sorted keys, ``", "`` and ``": "``
between its parts, and every character outside printable ASCII escaped. The
keys are sorted when the plan is made; at run time a row's JSON is one
concatenation, and its hash stays inside generated code.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtable.errors import HashError
from sealtable.types import EXTRA, UNHASHED

# The short escapes of JSON.
_SHORT_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def json_string(value: Column) -> Column:
    """A string as JSON. Plain texts are only quoted; only texts with rare characters are taken apart."""
    short = value
    for char, escape in _SHORT_ESCAPES:
        short = F.replace(short, F.lit(char), F.lit(escape))
    utf16 = lambda run: F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(.{4})", r"\\u$1")
    # By runs, not characters: a long text in a Latin script has few rare ones.
    runs = F.regexp_extract_all(short, F.lit("([ -~]+|[^ -~]+)"), F.lit(1))
    rare = F.array_join(F.transform(runs, lambda run: F.when(run.rlike("^[ -~]"), run).otherwise(utf16(run))), "")
    plain = ~value.rlike(r'[^ -~]|["\\]')
    body = F.when(plain, value).when(~short.rlike("[^ -~]"), short).otherwise(rare)
    return F.concat(F.lit('"'), body, F.lit('"'))


def json_double(value: Column) -> Column:
    """A double as the shortest decimal, plain from 1e-4 on and below 1e16, else with an exponent of two digits or more."""
    plain = value.cast("string")
    mantissa = F.regexp_extract(plain, r"^(-?[0-9.]+)E", 1)
    exponent = F.regexp_extract(plain, r"E(-?[0-9]+)$", 1)
    power = F.when(exponent == "", 0).otherwise(exponent.cast("int"))
    sign = F.when(F.startswith(mantissa, F.lit("-")), "-").otherwise("")
    whole = F.regexp_extract(mantissa, r"^-?([0-9]+)", 1)
    fraction = F.regexp_replace(F.regexp_extract(mantissa, r"\.([0-9]+)$", 1), "0+$", "")
    shown = F.when(fraction == "", whole).otherwise(F.concat(whole, F.lit("."), fraction))
    two_digits = F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0"))
    scientific = F.concat(sign, shown, F.lit("e"), F.when(power < 0, "-").otherwise("+"), two_digits)
    padded = F.rpad(fraction, F.greatest(power, F.length(fraction)), F.lit("0"))
    after = F.substring(padded, power + 1, F.lit(400))
    positional = F.concat(sign, whole, F.substring(padded, F.lit(1), power), F.lit("."), F.when(after == "", "0").otherwise(after))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), whole, fraction)
    return (
        F.when(exponent == "", plain)
        .when((power >= 0) & (power < 16), positional)
        .when((power < 0) & (power >= -4), small)
        .otherwise(scientific)
    )


def json_fragment(value: Column, kind: T.DataType) -> Column:
    """The JSON of a value of any storable type; null is ``null``."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        body = json_string(value)
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DecimalType)):
        body = value.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        body = json_double(value.cast("double"))
    elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        body = F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"'))
    elif isinstance(kind, T.DateType):
        body = F.concat(F.lit('"'), F.date_format(value, "yyyy-MM-dd"), F.lit('"'))
    elif isinstance(kind, T.BinaryType):
        body = F.concat(F.lit('"'), F.lower(F.hex(value)), F.lit('"'))
    elif isinstance(kind, T.ArrayType):
        parts = F.transform(value, lambda x: json_fragment(x, kind.elementType))
        body = F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("k"), json_fragment(e["value"], kind.valueType).alias("v"))))
        parts = F.transform(entries, lambda e: F.concat(json_string(e["k"]), F.lit(": "), e["v"]))
        body = F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        body = _object([(f.name, json_fragment(value[f.name], f.dataType)) for f in kind.fields])
        body = F.when(value.isNotNull(), body)
    else:
        raise HashError(f"No canonical form for {kind.simpleString()}")
    return F.coalesce(body, F.lit("null"))


def _object(members: Iterable[tuple[str, Column]]) -> Column:
    parts: list[Column] = []
    for name, fragment in sorted(members, key=lambda m: m[0]):
        parts += [F.lit((", " if parts else "{") + json.dumps(name) + ": "), fragment]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def row_json(schema: T.StructType) -> Column:
    """The canonical JSON of a row of ``schema``; engine columns are left out, undeclared fields are put in."""
    members = [(f.name, json_fragment(F.col(f"`{f.name}`"), f.dataType)) for f in schema.fields if f.name not in UNHASHED]
    declared = _object(members)
    if EXTRA not in schema.names:
        return declared
    extra = F.col(EXTRA)
    known = F.array(*[F.struct(F.lit(n).alias("k"), v.alias("v")) for n, v in members]) if members else F.array().cast("array<struct<k:string,v:string>>")
    more = F.transform(F.map_entries(extra), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    every = F.transform(F.array_sort(F.concat(known, more)), lambda e: F.concat(json_string(e["k"]), F.lit(": "), e["v"]))
    mixed = F.concat(F.lit("{"), F.array_join(every, ", "), F.lit("}"))
    return F.when(extra.isNull() | (F.size(extra) == 0), declared).otherwise(mixed)


def row_hash(schema: T.StructType) -> Column:
    """SHA-256 of the canonical JSON, in hex."""
    return F.sha2(row_json(schema), 256)


def value_hash(value: Column, kind: T.DataType) -> Column:
    """SHA-256 of one value: text and bytes as they are, numbers as Python prints them, nested values as JSON."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        text = value
    elif isinstance(kind, T.BooleanType):
        text = F.when(value, "True").when(~value, "False")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        number = json_double(value.cast("double"))
        text = F.when(F.isnan(value), "nan").when(number == "Infinity", "inf").when(number == "-Infinity", "-inf").otherwise(number)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.when(value.isNotNull(), json_fragment(value, kind))
    else:
        text = value.cast("string")
    return F.sha2(F.coalesce(text, F.lit("None")), 256)


def calculate_hash(value: Any) -> str:
    """The hash of a Python value on the driver, as :func:`value_hash` has it for columns."""
    try:
        if isinstance(value, (dict, list)):
            data = json.dumps(value, sort_keys=True).encode()
        else:
            data = value if isinstance(value, bytes) else str(value).encode()
        return hashlib.sha256(data).hexdigest()
    except Exception as error:
        raise HashError(f"Can't hash a {type(value).__name__}") from error


def calculate_row_hash(row: dict[str, Any]) -> str:
    """The hash of a Python row on the driver, as :func:`row_hash` has it for columns."""
    return calculate_hash({k: v for k, v in row.items() if k not in UNHASHED})
