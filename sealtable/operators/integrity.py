"""Looking rows up by hash, and checking stored hashes against the rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtable.functions.canonical import calculate_hash, calculate_row_hash, row_hash, value_hash
from sealtable.functions.predicates import compile_conditions
from sealtable.types import HASH, ID, UNHASHED


def find_by_hash(rows: DataFrame, digest: str, exact: bool = True) -> DataFrame:
    """Rows of this hash, or, not ``exact``, whose hash begins so; both are pushed down to the scan."""
    return rows.filter(F.col(HASH) == digest if exact else F.col(HASH).startswith(digest))


def find_by_hash_and_column(rows: DataFrame, digest: str, column: str, value: Any) -> DataFrame:
    return find_by_hash(rows, digest).filter(compile_conditions({column: value}, rows.schema))


def find_by_hashed_value(rows: DataFrame, value: Any) -> DataFrame:
    """A dict finds the rows of its row hash, any other value the rows with a column of its hash."""
    if isinstance(value, dict):
        return find_by_hash(rows, calculate_row_hash(value))
    digest = calculate_hash(value)
    fields = [f for f in rows.schema.fields if f.name not in UNHASHED and _same_kind(value, f.dataType)]
    tests = [value_hash(F.col(f"`{f.name}`"), f.dataType) == digest for f in fields]
    found = F.lit(False)
    for test in tests:
        found = found | test
    return rows.filter(found)


def _same_kind(value: Any, kind: T.DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, int):
        return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if isinstance(value, float):
        return isinstance(kind, (T.DoubleType, T.FloatType))
    return isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))


def verify_summary(rows: DataFrame) -> DataFrame:
    """One row, one pass: total_rows, valid_hashes, invalid_hashes. A missing hash is invalid."""
    valid = F.coalesce(F.col(HASH) == row_hash(rows.schema), F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(F.when(valid, 1)).alias("valid_hashes"),
        F.count(F.when(~valid, 1)).alias("invalid_hashes"),
    )


def corrupted_rows(rows: DataFrame) -> DataFrame:
    """(id, stored_hash, computed_hash) of the rows whose stored hash is not theirs."""
    checked = rows.select(ID, F.col(HASH).alias("stored_hash"), row_hash(rows.schema).alias("computed_hash"))
    return checked.filter(~F.col("stored_hash").eqNullSafe(F.col("computed_hash")))


def duplicate_hashes(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(hash, n, ids) of hashes that several rows share; empty and missing hashes are passed over.

    Counting comes first, so only ids of duplicates are gathered, never those of
    all rows. With ``most`` it is a report: the first hashes, and the least ids of
    each, that many at most. Without, a hash's ids are one list, as long as its
    group; :func:`duplicate_counts` has no lists.
    """
    twice = duplicate_counts(rows).select(HASH, "n")
    if most is None:
        return rows.join(twice, HASH).groupBy(HASH, "n").agg(F.array_sort(F.collect_list(ID)).alias("ids"))
    found = rows.select(HASH, ID).join(F.broadcast(twice.orderBy(HASH).limit(most)), HASH)
    # A running top of the group, which Spark keeps in bounded partial results before the shuffle.
    ranked = found.withColumn("__at", F.row_number().over(Window.partitionBy(HASH).orderBy(ID))).filter(F.col("__at") <= most)
    return ranked.groupBy(HASH, "n").agg(F.array_sort(F.collect_list(ID)).alias("ids"))


def duplicate_counts(rows: DataFrame) -> DataFrame:
    """(hash, n, min_id, max_id) of hashes that several rows share."""
    groups = rows.filter(F.col(HASH) != "").groupBy(HASH)
    return groups.agg(F.count(F.lit(1)).alias("n"), F.min(ID).alias("min_id"), F.max(ID).alias("max_id")).filter("n > 1")


def hash_statistics(rows: DataFrame) -> DataFrame:
    """One row: total_rows, unique_hashes, duplicate_hash_count, hash_collision_rate (the share of repeats)."""
    # Rows without a hash count as rows alone.
    counted = rows.groupBy(F.nullif(F.col(HASH), F.lit("")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("h").isNotNull()
    stats = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(F.when(known, 1)).alias("unique_hashes"),
        F.count(F.when(known & (F.col("n") > 1), 1)).alias("duplicate_hash_count"),
    )
    rate = (F.col("total_rows") - F.col("unique_hashes")).cast("double") / F.greatest(F.col("total_rows"), F.lit(1))
    return stats.withColumn("hash_collision_rate", rate)


def repair_hashes(rows: DataFrame, recompute: bool = False) -> DataFrame:
    """The table with missing hashes filled in, or all of them made anew."""
    computed = row_hash(rows.schema)
    return rows.withColumn(HASH, computed if recompute else F.coalesce(F.nullif(F.col(HASH), F.lit("")), computed))


def repair_summary(rows: DataFrame, recompute: bool = False) -> DataFrame:
    """One row: repaired_rows (rows in the rebuilt index), unique_hashes."""
    repaired = repair_hashes(rows, recompute)
    return repaired.groupBy(HASH).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("repaired_rows"), F.count(F.lit(1)).alias("unique_hashes")
    )


def compare_hashes(rows: DataFrame, row_id: int) -> DataFrame:
    """One row: whether the row of this id is there and its hash its own."""
    same = F.coalesce(F.col(HASH) == row_hash(rows.schema), F.lit(False))
    return rows.filter(F.col(ID) == row_id).select(same.alias("same")).agg(F.coalesce(F.bool_and("same"), F.lit(False)).alias("matches"))
