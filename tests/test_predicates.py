"""Compiled conditions against Python's own comparison of dicts."""

import pytest
from pyspark.sql import types as T

from sealtable.functions.predicates import compile_conditions
from sealtable.operators.rows import delete_rows, select_rows

SCHEMA = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("s", T.StringType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("l", T.ArrayType(T.LongType())),
    ]
)
ROWS = [
    (1, "1", 1.0, True, [1]),
    (0, "", 0.0, False, []),
    (None, None, None, None, None),
    (30, "x", float("nan"), None, [1, 2]),
    (-5, "True", 2.5, True, None),
]
VALUES = [None, True, False, 0, 1, 1.0, 30, 30.0, 2.5, "1", "x", "", "True", float("nan"), float("inf"), 1 << 70, {"$lt": 5}, [1], [1, 2], b"x"]


@pytest.mark.parametrize("value", VALUES, ids=repr)
def test_each_column(spark, value):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for name in [*SCHEMA.names, "missing"]:
        rows = [dict(zip(SCHEMA.names, r)) for r in ROWS]
        meets = [r for r in rows if r.get(name) == value]
        assert len(select_rows(frame, {name: value}).collect()) == len(meets), name
        assert delete_rows(frame, {name: value}).count() == len(rows) - len(meets), name


def test_conjunction_and_nothing(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    assert compile_conditions({}, SCHEMA) is None
    assert select_rows(frame, {"n": 1, "b": True}).count() == 1
    assert select_rows(frame, {"n": 1, "b": False}).count() == 0


def test_operators_are_an_option(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    assert select_rows(frame, {"n": {"$lt": 5}}).count() == 0
    assert select_rows(frame, {"n": {"$gte": 0, "$lt": 5}}, operators=True).count() == 2
    assert select_rows(frame, {"s": {"$in": ["x", "1"]}}, operators=True).count() == 2


def test_pushdown(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "t"))
    plan = select_rows(spark.read.parquet(str(tmp_path / "t")), {"s": "x", "n": 30})._jdf.queryExecution().toString()
    assert "EqualTo(s,x)" in plan and "EqualTo(n,30)" in plan
