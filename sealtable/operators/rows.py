"""Selecting and changing rows. Mutations return the table as it is afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sealtable.functions.canonical import row_hash
from sealtable.functions.predicates import compile_conditions
from sealtable.lineage import checkpointed
from sealtable.types import HASH, ID, SEQ, checked


def select_rows(
    rows: DataFrame,
    conditions: Mapping[str, Any] | None = None,
    limit: int | None = None,
    order_by: Sequence[str] = (SEQ,),
    operators: bool = False,
) -> DataFrame:
    """Rows that meet every condition. With a limit, the first ones in ``order_by``; 0 is no limit.

    Without a limit no order is asked for and nothing is shuffled; a limit is a
    distributed top-n.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    wanted = compile_conditions(conditions, rows.schema, operators)
    found = rows if wanted is None else rows.filter(wanted)
    if limit:
        found = found.orderBy(*[c for c in order_by if c in rows.columns]).limit(limit)
    return found


def append_rows(rows: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` under ``rows``; fields that one side lacks are null."""
    return rows.unionByName(more, allowMissingColumns=True)


def _changed(wanted: Column | None) -> Column:
    # A null comparison meets no condition, so the row is left as it is.
    return F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))


def update_rows(rows: DataFrame, conditions: Mapping[str, Any] | None, updates: Mapping[str, Any], rehash: bool = True, operators: bool = False) -> DataFrame:
    """The table with ``updates`` set where the conditions hold, and those rows hashed anew."""
    unknown = [name for name in updates if name not in rows.columns]
    if unknown:
        raise ValueError(f"Field {unknown[0]} does not exist")
    hit = _changed(compile_conditions(conditions, rows.schema, operators))
    marked = rows.withColumn("__hit", hit)
    values = {
        name: F.when(F.col("__hit"), F.lit(checked(name, value, _widened(rows.schema[name].dataType), nullable=True)).cast(rows.schema[name].dataType)).otherwise(F.col(f"`{name}`"))
        for name, value in updates.items()
    }
    changed = marked.withColumns(values)
    if rehash and HASH in rows.columns:
        changed = changed.withColumn(HASH, F.when(F.col("__hit"), row_hash(rows.schema)).otherwise(F.col(HASH)))
    return changed.drop("__hit")


def _widened(kind):
    from pyspark.sql import types as T

    return T.LongType() if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)) else kind


def delete_rows(rows: DataFrame, conditions: Mapping[str, Any] | None, operators: bool = False) -> DataFrame:
    """The table without the rows that meet the conditions; no conditions delete all."""
    return rows.filter(~_changed(compile_conditions(conditions, rows.schema, operators)))


def count_matching(rows: DataFrame, conditions: Mapping[str, Any] | None, name: str = "n", operators: bool = False) -> DataFrame:
    """One row: how many rows meet the conditions."""
    return select_rows(rows, conditions, operators=operators).agg(F.count(F.lit(1)).alias(name))


def with_ids(rows: DataFrame, order_by: Sequence[str], start: int = 1, id_col: str = ID) -> DataFrame:
    """Dense ids from ``start`` on, in the order of the columns ``order_by``.

    Rows are range-partitioned and sorted once, and numbered within their
    partitions; the partitions' sizes, one number each, give the offsets. The
    sorted rows are checkpointed: ranges are drawn from a sample, and counting
    and numbering must see the same ones.
    """
    ordered = rows.repartitionByRange(*[F.col(f"`{c}`") for c in order_by]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order_by])
    placed = checkpointed(
        ordered.withColumns(
            {"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}
        )
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition, so this side may be broadcast, and one task may add them up.
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    numbered = placed.join(F.broadcast(offsets), "__part")
    return numbered.withColumn(id_col, F.col("__ahead") + F.col("__at") + F.lit(start)).drop("__part", "__at", "__ahead")


def seal_rows(rows: DataFrame) -> DataFrame:
    """Rows with the hash of each."""
    return rows.withColumn(HASH, row_hash(rows.schema))
