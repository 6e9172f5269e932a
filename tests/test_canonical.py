"""Native canonical JSON and hashes against the standard library."""

import datetime
import hashlib
import json
import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtable.functions.canonical import calculate_hash, calculate_row_hash, row_hash, row_json, value_hash

SCHEMA = T.StructType(
    [
        T.StructField("s", T.StringType()),
        T.StructField("é", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("list", T.ArrayType(T.LongType())),
        T.StructField("map", T.MapType(T.StringType(), T.DoubleType())),
    ]
)


def _hashes(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return [(r[0], r[1]) for r in frame.select(row_json(SCHEMA), row_hash(SCHEMA)).collect()]


def _expected(row):
    text = json.dumps(dict(zip(SCHEMA.names, row)), sort_keys=True)
    return text, hashlib.sha256(text.encode()).hexdigest()


# Doubles whose digits Java prints shortest; see the README for the range where it does not.
doubles = st.builds(lambda m, e: float(f"{m}e{e}"), st.integers(-(10**9), 10**9), st.integers(-13, 5))
texts = st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=12)
long = st.integers(-(1 << 63), (1 << 63) - 1)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(texts, st.none() | texts, long, doubles, st.none() | st.booleans(), st.none() | st.lists(long, max_size=3), st.none() | st.dictionaries(texts, doubles, max_size=3)), min_size=1, max_size=60))
def test_row_hash_is_that_of_json(spark, rows):
    assert _hashes(spark, rows) == [_expected(r) for r in rows]


def test_rare_values(spark):
    strings = ["", "plain", 'q"\\/', "\n\r\t\b\f", "\x01\x1f\x7f", "naïve Ünïcode", "漢字", "😀 and 🧬", "  "]
    numbers = [0.0, -0.0, 1.0, 999.99, 1e-5, 1.5e-7, 1e-4, 1.25e-4, 1e7, 1e15, 1.5e15, 123456789.125, 1e16, 1.5e300, -2.5e-10, math.inf, -math.inf, math.nan]
    rows = [(s, None, 1, 1.0, True, None, None) for s in strings] + [("", "", 0, x, None, [], {}) for x in numbers]
    assert _hashes(spark, rows) == [_expected(r) for r in rows]


def test_value_hash_matches_the_driver(spark):
    cases = [("s", "Alice"), ("n", 30), ("x", 2.5), ("x", 1e-7), ("b", True), ("list", [1, 2]), ("map", {"b": 1.0, "a": 2.0})]
    for name, value in cases:
        frame = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", SCHEMA[name].dataType)]))
        assert frame.select(value_hash(F.col("v"), SCHEMA[name].dataType)).first()[0] == calculate_hash(value)


def test_engine_columns_do_not_count():
    assert calculate_row_hash({"id": 1, "a": 2, "hash": "x", "_metadata": 3}) == calculate_row_hash({"a": 2})


def test_timestamps_and_structs(spark):
    schema = T.StructType([T.StructField("t", T.TimestampNTZType()), T.StructField("r", T.StructType([T.StructField("z", T.LongType()), T.StructField("a", T.StringType())]))])
    frame = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5, 678), (1, "x")), (None, None)], schema)
    assert [r[0] for r in frame.select(row_json(schema)).collect()] == [
        '{"r": {"a": "x", "z": 1}, "t": "2024-01-02T03:04:05.000678"}',
        '{"r": null, "t": null}',
    ]
