"""Registered queries of the table engine: each applies an operator to whole tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealtable.database import Database
from sealtable.functions.canonical import calculate_row_hash, row_hash, value_hash
from sealtable.lineage import checkpointed, shared_folder
from sealtable.managers import IndexManager
from sealtable.operators import indexes, integrity
from sealtable.operators.rows import append_rows, count_matching, delete_rows, seal_rows, select_rows, update_rows, with_ids
from sealtable.sources import admin, jsonio
from sealtable.transactions import TransactionManager
from sealtable.types import HASH, ID

#: Columns that order lineitem totally, and those of its rows that are hashed.
LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
LINE_HASHED = ["l_linestatus", "l_partkey", "l_quantity", "l_returnflag"]
BUILDING = {"c_mktsegment": "BUILDING"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer")


def _sealed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(seal_rows(_customers(spark, sf_dir)), ["c_custkey"])


def _line_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashed projection of lineitem, without ids: all that counts and statistics need."""
    return seal_rows(_table(spark, sf_dir, "lineitem").select(*LINE_HASHED))


def _sealed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return with_ids(lines, LINE_ORDER).select(ID, *LINE_HASHED, row_hash(lines.select(*LINE_HASHED).schema).alias(HASH))


def _hash_of(rows: DataFrame, key: str, value: int) -> str:
    """The hash of one known row, as a caller has it at hand."""
    return rows.filter(F.col(key) == value).first()[HASH]


def hash_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row hashes of all customers, verified and counted."""
    rows = seal_rows(_customers(spark, sf_dir))
    return integrity.hash_statistics(rows).join(integrity.verify_summary(rows).drop("total_rows"), how="cross")


def scan_all(spark, sf_dir):
    return select_rows(_customers(spark, sf_dir))


def select_eq(spark, sf_dir):
    return select_rows(_customers(spark, sf_dir), BUILDING)


def select_conjunction(spark, sf_dir):
    found = select_rows(_table(spark, sf_dir, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F"})
    return found.select("l_orderkey", "l_linenumber", "l_quantity")


def select_limit_ordered(spark, sf_dir):
    return select_rows(_customers(spark, sf_dir), limit=10, order_by=["c_custkey"]).select("c_custkey", "c_name")


def select_eq_limit(spark, sf_dir):
    return select_rows(_customers(spark, sf_dir), BUILDING, 5, ["c_custkey"]).select("c_custkey", "c_name")


def select_type_mismatch_count(spark, sf_dir):
    return count_matching(_customers(spark, sf_dir), {"c_custkey": "30"})


def select_eq_null(spark, sf_dir):
    rows = update_rows(_customers(spark, sf_dir), {"c_nationkey": 7}, {"c_mktsegment": None})
    return select_rows(rows.select("c_custkey", F.col("c_mktsegment").alias("seg")), {"seg": None})


def _atlantis(spark, rows: DataFrame, region: int) -> DataFrame:
    return append_rows(rows, spark.createDataFrame([(25, "ATLANTIS", region)], rows.schema))


def insert_rows(spark, sf_dir):
    return _atlantis(spark, _table(spark, sf_dir, "nation"), 0)


def insert_autoincrement_id(spark, sf_dir):
    return with_ids(_customers(spark, sf_dir).select("c_custkey"), ["c_custkey"])


def update_eq(spark, sf_dir):
    return update_rows(_customers(spark, sf_dir), BUILDING, {"c_acctbal": 0.0}).select("c_custkey", "c_acctbal", "c_mktsegment")


def update_count(spark, sf_dir):
    return count_matching(_customers(spark, sf_dir), BUILDING, "updated_count")


def update_rehash(spark, sf_dir):
    return update_rows(seal_rows(_customers(spark, sf_dir)), BUILDING, {"c_acctbal": 0.0}).select("c_custkey", HASH)


def delete_eq(spark, sf_dir):
    return delete_rows(_customers(spark, sf_dir), BUILDING)


def delete_count(spark, sf_dir):
    return count_matching(_customers(spark, sf_dir), BUILDING, "deleted_count")


def delete_all_remaining(spark, sf_dir):
    return count_matching(delete_rows(_customers(spark, sf_dir), {}), None)


def value_hashes(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    return parts.select("p_partkey", value_hash(F.col("p_name"), parts.schema["p_name"].dataType).alias("value_hash"))


def row_hashes(spark, sf_dir):
    return seal_rows(_customers(spark, sf_dir)).select("c_custkey", HASH)


def find_by_hash(spark, sf_dir):
    rows = _sealed_customers(spark, sf_dir)
    return integrity.find_by_hash(rows, _hash_of(rows, ID, 42)).select(ID, "c_custkey", "c_name")


def find_by_hash_prefix(spark, sf_dir):
    return integrity.find_by_hash(_sealed_customers(spark, sf_dir), "a", exact=False).select(ID, "c_custkey", HASH)


def find_by_hash_duplicates(spark, sf_dir):
    rows = _sealed_lines(spark, sf_dir)
    twice = _line_hashes(spark, sf_dir).groupBy(HASH).count().filter("count > 1").agg(F.min(HASH)).first()[0]
    return integrity.find_by_hash(rows, twice).select(ID, "l_partkey")


def find_by_hashed_value(spark, sf_dir):
    rows = _sealed_customers(spark, sf_dir)
    row = rows.filter("c_custkey = 7").drop(ID, HASH).first().asDict()
    return integrity.find_by_hashed_value(rows, row).select(ID, "c_custkey")


def find_by_hash_and_column(spark, sf_dir):
    rows = _sealed_customers(spark, sf_dir)
    row = rows.filter(F.col(ID) == 42).first()
    return integrity.find_by_hash_and_column(rows, row[HASH], "c_nationkey", row["c_nationkey"]).select(ID, "c_custkey")


def _damaged(rows: DataFrame) -> DataFrame:
    return rows.withColumn(HASH, F.when(F.col("c_custkey") % 100 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.col(HASH)))


def verify_integrity_summary(spark, sf_dir):
    return integrity.verify_summary(_damaged(seal_rows(_customers(spark, sf_dir))))


def verify_integrity_corrupted(spark, sf_dir):
    return integrity.corrupted_rows(_damaged(_sealed_customers(spark, sf_dir)))


def hash_stats(spark, sf_dir):
    return integrity.hash_statistics(_line_hashes(spark, sf_dir))


def hash_duplicates(spark, sf_dir):
    return integrity.duplicate_counts(_sealed_lines(spark, sf_dir))


def repair_hash_index(spark, sf_dir):
    lost = _line_hashes(spark, sf_dir).withColumn(HASH, F.when(F.col("l_partkey") % 3 != 0, F.col(HASH)))
    return integrity.repair_summary(lost)


def compare_hash_row(spark, sf_dir):
    return integrity.compare_hashes(_sealed_customers(spark, sf_dir), 42)


def index_build(spark, sf_dir):
    rows = _sealed_customers(spark, sf_dir)
    return indexes.build_index(rows, "c_mktsegment").groupBy("key").agg(F.count(F.lit(1)).alias("n_ids"))


def index_lookup(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").withColumn(ID, F.col("o_orderkey"))
    first = orders.agg(F.min("o_orderpriority")).first()[0]
    return indexes.index_lookup(orders, indexes.build_index(orders, "o_orderpriority"), first).select("o_orderkey", "o_totalprice")


def index_statistics(spark, sf_dir):
    return indexes.index_statistics(_table(spark, sf_dir, "orders"), "o_orderpriority")


def _scratch(spark: SparkSession) -> str:
    """A folder for a database, under the shared checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def _nations(spark, sf_dir) -> Database:
    db = Database(spark, _scratch(spark))
    db.create_table("nation", {"n_nationkey": int, "n_name": str, "n_regionkey": int})
    db.insert_frame("nation", _table(spark, sf_dir, "nation"), ["n_nationkey"])
    return db


def _customer_db(spark, sf_dir, parts: int = 4) -> Database:
    """All customers in a database, inserted in so many commits by ranges of their key."""
    db = Database(spark, _scratch(spark))
    db.create_table("customer", {"c_custkey": int, "c_name": str, "c_nationkey": int, "c_acctbal": float, "c_mktsegment": str}, enable_hash_index=True)
    rows = _customers(spark, sf_dir)
    ends = [float("-inf"), *rows.approxQuantile("c_custkey", [k / parts for k in range(1, parts)], 0.01), float("inf")]
    for low, high in zip(ends, ends[1:]):
        db.insert_frame("customer", rows.filter((F.col("c_custkey") > low) & (F.col("c_custkey") <= high)), ["c_custkey"])
    return db


def _customer_rows(db: Database) -> DataFrame:
    return db.frame("customer").select(ID, "c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment", HASH)


def db_insert(spark, sf_dir):
    db = _customer_db(spark, sf_dir)
    db.insert("customer", {"c_custkey": -1, "c_name": "ATLANTIS", "c_nationkey": 1, "c_acctbal": 0.5, "c_mktsegment": "NONE"})
    return _customer_rows(db)


def db_update(spark, sf_dir):
    db = _customer_db(spark, sf_dir)
    db.update("customer", BUILDING, {"c_acctbal": 0.0})
    return _customer_rows(db)


def db_update_one(spark, sf_dir):
    """One row of one segment: the other segments stay as they are."""
    db = _customer_db(spark, sf_dir)
    db.update("customer", {"c_custkey": 7}, {"c_name": "SEVEN"})
    return _customer_rows(db)


def db_delete(spark, sf_dir):
    db = _customer_db(spark, sf_dir)
    db.delete("customer", BUILDING)
    return _customer_rows(db)


def db_select_limit(spark, sf_dir):
    return _customer_db(spark, sf_dir).query("customer", BUILDING, limit=7).select("c_custkey", "c_name")


def db_find_by_hash(spark, sf_dir):
    db = _customer_db(spark, sf_dir)
    digest = db.select("customer", {ID: 42})[0][HASH]
    found = db.find_by_hash("customer", digest) + db.find_by_hash("customer", digest[:12], exact_match=False)
    return spark.createDataFrame([(r[ID], r["c_custkey"], r[HASH]) for r in found], "id long, c_custkey long, hash string")


def db_verify(spark, sf_dir):
    """Half of the hashes damaged in a commit, found, and made anew by a repair."""
    db = _customer_db(spark, sf_dir)
    state = db.catalog.draft()
    table = db.catalog.table("customer", state)
    hurt = db.frame("customer").withColumn(HASH, F.when(F.col("c_custkey") % 2 == 0, F.col(HASH)).otherwise(F.lit("0")))
    table["segments"] = [db.catalog.write_segment("customer", table, hurt)]
    db.catalog.commit(state)
    counts = [("damaged", db.verify_hash_integrity("customer", listed=1))]
    db.repair_hash_index("customer", recompute=True)
    counts.append(("repaired", db.verify_hash_integrity("customer")))
    return spark.createDataFrame([(when, c["total_rows"], c["valid_hashes"], c["invalid_hashes"]) for when, c in counts], "state string, total_rows long, valid_hashes long, invalid_hashes long")


def db_index(spark, sf_dir):
    """An index, statistics of it, and what it finds after an update."""
    db = _customer_db(spark, sf_dir)
    manager = IndexManager(db)
    manager.create_index("customer", "c_mktsegment", "by_segment")
    db.update("customer", BUILDING, {"c_mktsegment": "HOUSES"})
    return manager.entries("by_segment").groupBy("key").agg(F.count(F.lit(1)).alias("n_ids"))


def db_info(spark, sf_dir):
    db = _customer_db(spark, sf_dir)
    info, size = admin.get_database_info(db), admin.get_table_size(db, "customer")
    return spark.createDataFrame([(info["tables_count"], info["total_rows"], info["version"], size["page_count"])], "tables_count long, total_rows long, version long, page_count long")


def db_time_travel(spark, sf_dir):
    """A transaction over all customers, committed and taken back; the rows are the ones before it."""
    db = _customer_db(spark, sf_dir)
    manager = TransactionManager(db)
    with manager.begin() as work:
        work.update("customer", BUILDING, {"c_name": "X"})
        work.delete("customer", {"c_nationkey": 7})
        gone = work.id
    manager.rollback_to(gone)
    return _customer_rows(db)


def _like(rows: DataFrame, model: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in model.schema.fields])


def txn_commit(spark, sf_dir):
    db = _nations(spark, sf_dir)
    with TransactionManager(db).begin() as work:
        work.insert("nation", {"n_nationkey": 25, "n_name": "ATLANTIS", "n_regionkey": 1})
        work.delete("nation", {"n_regionkey": 0})
        for row in db.frame("nation").filter("n_regionkey = 1").collect():
            work.update("nation", {"n_nationkey": row["n_nationkey"]}, {"n_name": "AMERICAS_" + row["n_name"]})
        work.update("nation", {"n_nationkey": 25}, {"n_name": "AMERICAS_ATLANTIS"})
    return _like(db.frame("nation"), _table(spark, sf_dir, "nation"))


def txn_rollback(spark, sf_dir):
    db = _nations(spark, sf_dir)
    manager = TransactionManager(db)
    work = manager.begin()
    work.delete("nation", {})
    manager.rollback()
    work = manager.begin()
    work.update("nation", {"n_regionkey": 1}, {"n_name": "GONE"})
    manager.rollback_to(manager.commit())
    return _like(db.frame("nation"), _table(spark, sf_dir, "nation"))


def export_json_rows(spark, sf_dir):
    regions = _table(spark, sf_dir, "region")
    db = Database(spark, _scratch(spark))
    db.create_table("region", {"r_regionkey": int, "r_name": str})
    db.insert_frame("region", regions, ["r_regionkey"])
    with tempfile.NamedTemporaryFile(suffix=".json") as file:
        jsonio.export_to_json(db, file.name)
        rows = json.load(open(file.name, encoding="utf-8"))["tables"]["region"]["rows"]
    assert all(row["hash"] == calculate_row_hash(row) for row in rows)
    return spark.createDataFrame([tuple(row[c] for c in regions.columns) for row in rows], regions.schema)


def import_json_roundtrip(spark, sf_dir):
    db, copy = _nations(spark, sf_dir), Database(spark, _scratch(spark))
    with tempfile.NamedTemporaryFile(suffix=".json") as file:
        jsonio.export_to_json(db, file.name)
        jsonio.import_from_json(copy, file.name)
    return _like(copy.frame("nation"), _table(spark, sf_dir, "nation"))


def table_row_counts(spark, sf_dir):
    return admin.row_counts({name: _table(spark, sf_dir, name) for name in ("customer", "orders", "lineitem")})


def database_info(spark, sf_dir):
    counts = table_row_counts(spark, sf_dir)
    return counts.agg(F.count(F.lit(1)).cast("int").alias("tables_count"), F.sum("row_count").alias("total_rows"))


#: Rows of a hash and two numbers that a join may broadcast: some 10 MB.
FEW = 100_000


def document_row_hash_dedup(spark, sf_dir):
    """The texts there more than once: hashes are counted first, in one pass, and only texts of repeated ones are gathered."""
    texts = _table(spark, sf_dir, "documents").select("text")
    digest = F.xxhash64("text").alias("digest")
    twice = checkpointed(
        seal_rows(texts).groupBy(F.col(HASH).alias("wanted")).agg(F.count(F.lit(1)).alias("n"), F.min(digest).alias("digest")).filter("n > 1")
    )
    found = texts.join(F.broadcast(twice) if twice.count() <= FEW else twice, digest == F.col("digest"))
    # Next to always one text, however often it is there; one that merely shares the short digest has another hash.
    each = found.groupBy("wanted", "n").agg(F.collect_set("text").alias("texts")).select("wanted", "n", F.explode("texts").alias("text"))
    return each.filter(row_hash(texts.schema) == F.col("wanted")).select("text", "n")


def event_row_hash(spark, sf_dir):
    return seal_rows(_table(spark, sf_dir, "events")).select("event_id", HASH)


def conversation_row_hash(spark, sf_dir):
    return seal_rows(_table(spark, sf_dir, "conversations")).select("conv_id", "turn", HASH)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain: list[Any] = [
        scan_all, select_eq, select_conjunction, select_limit_ordered, select_eq_limit, select_type_mismatch_count,
        select_eq_null, insert_rows, insert_autoincrement_id, update_eq, update_count, update_rehash, delete_eq,
        delete_count, delete_all_remaining, find_by_hash, find_by_hash_prefix, find_by_hash_duplicates,
        find_by_hashed_value, find_by_hash_and_column, verify_integrity_summary, verify_integrity_corrupted,
        hash_stats, hash_duplicates, repair_hash_index, compare_hash_row, index_build, index_lookup,
        index_statistics, txn_commit, txn_rollback, export_json_rows, import_json_roundtrip, table_row_counts,
        database_info, document_row_hash_dedup, event_row_hash, conversation_row_hash, db_insert, db_update,
        db_update_one, db_delete, db_select_limit, db_find_by_hash, db_verify, db_index, db_info, db_time_travel,
    ]
    return {f.__name__: f for f in plain} | {"value_hash": value_hashes, "row_hash": row_hashes}
