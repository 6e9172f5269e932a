"""Secondary indexes, derived from the table whenever they are asked for."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealtable.functions.predicates import equals
from sealtable.types import ID


def build_index(rows: DataFrame, column: str) -> DataFrame:
    """(key, id) sorted by key within ranges of it, nulls included.

    The entries are rows, not lists, so a key that a third of the table has is
    many rows in several partitions; files of it are pruned by their key range.
    """
    entries = rows.select(F.col(f"`{column}`").alias("key"), ID)
    return entries.repartitionByRange("key", ID).sortWithinPartitions("key", ID)


def index_keys(rows: DataFrame, column: str) -> DataFrame:
    """(key, n_ids) of each value."""
    return rows.groupBy(F.col(f"`{column}`").alias("key")).agg(F.count(F.lit(1)).alias("n_ids"))


def index_lookup(rows: DataFrame, index: DataFrame, value: Any) -> DataFrame:
    """The rows that the index lists under ``value``: a semi-join on the ids."""
    ids = index.filter(equals(F.col("key"), value, index.schema["key"].dataType)).select(ID)
    return rows.join(ids, ID, "left_semi")


def index_statistics(rows: DataFrame, column: str) -> DataFrame:
    """One row: unique_values (a null is one) and total_entries."""
    return index_keys(rows, column).agg(
        F.count(F.lit(1)).alias("unique_values"), F.coalesce(F.sum("n_ids"), F.lit(0)).alias("total_entries")
    )
