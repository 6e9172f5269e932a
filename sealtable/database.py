"""The database: tables of sealed rows in a catalog folder."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealtable.errors import DuplicateError
from sealtable.functions.canonical import calculate_row_hash, row_hash
from sealtable.operators import integrity
from sealtable.operators.rows import delete_rows, select_rows, update_rows, with_ids
from sealtable.sources.catalog import WRITING, Catalog, now
from sealtable.types import EXTRA, HASH, ID, SEQ, checked, table_schema


#: Rows that a report on hashes lists on the driver, unless told otherwise.
LISTED = 10_000


class Database:
    """Reads are lazy DataFrames; ``select`` and its kin return Python rows, as small lookups want.

    ``frame``, ``query`` and ``sql`` give DataFrames for everything larger.
    """

    def __init__(self, spark: SparkSession, path: str, auto_create: bool = True):
        self.spark, self.path = spark, path
        self.catalog = Catalog(spark, path, auto_create)

    # Tables

    @property
    def tables(self) -> dict[str, dict[str, Any]]:
        return self.catalog.state["tables"]

    def create_table(self, name: str, schema: Mapping[str, Any], enable_hash_index: bool = False) -> dict[str, Any]:
        state = self.catalog.draft()
        self.stage_table(state, name, schema, enable_hash_index)
        self.catalog.commit(state)
        return self.tables[name]

    @staticmethod
    def stage_table(state: dict[str, Any], name: str, schema: Mapping[str, Any], enable_hash_index: bool = False) -> None:
        if name in state["tables"]:
            raise DuplicateError(f"Table {name} already exists")
        state["tables"][name] = {
            "schema": table_schema(schema).jsonValue(),
            "columns": list(schema),
            "segments": [],
            "auto_increment": 0,
            "next_seq": 0,
            "enable_hash_index": enable_hash_index,
            "created_at": now(),
        }

    def drop_table(self, name: str) -> None:
        state = self.catalog.draft()
        self.catalog.table(name, state)
        del state["tables"][name]
        state["indexes"] = {k: v for k, v in state["indexes"].items() if v["table"] != name}
        self.catalog.commit(state)

    def frame(self, name: str) -> DataFrame:
        """The current rows of a table, engine columns included."""
        return self.catalog.read(self.catalog.table(name))

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over all tables, each a temporary view of its name without the engine's hidden columns."""
        for name in self.tables:
            self.frame(name).drop(SEQ, EXTRA).createOrReplaceTempView(f"`{name}`")
        return self.spark.sql(text)

    # Writing

    def insert(self, name: str, data: Mapping[str, Any], return_hash: bool = False) -> int | tuple[int, str]:
        """Insert one row: its id, or id and hash. Many rows belong in :meth:`insert_many`."""
        ids = self.insert_many(name, [data])
        return (ids[0], calculate_row_hash(self._stored_view(name, data))) if return_hash else ids[0]

    def insert_many(self, name: str, rows: Iterable[Mapping[str, Any]]) -> list[int]:
        """Insert rows from the driver in one commit; all of them or none. Their ids."""
        state = self.catalog.draft()
        ids = self.stage_insert(state, name, list(rows))
        self.catalog.commit(state)
        return ids

    def stage_insert(self, state: dict[str, Any], name: str, rows: Sequence[Mapping[str, Any]]) -> list[int]:
        added, ids = self.sealed_rows(state, name, rows)
        if ids:
            table = self.catalog.table(name, state)
            table["segments"].append(self.catalog.write_segment(name, table, added))
        return ids

    def sealed_rows(self, state: dict[str, Any], name: str, rows: Sequence[Mapping[str, Any]]) -> tuple[DataFrame, list[int]]:
        """Checked rows as a DataFrame of the table's stored columns, numbered in ``state``; and their ids."""
        table = self.catalog.table(name, state)
        schema = self.catalog.schema(table)
        stored, ids = [], []
        for data in rows:
            row = self._validated(table, schema, data)
            table["auto_increment"] += 1
            row[ID] = data.get(ID, table["auto_increment"])
            row[SEQ] = table["next_seq"]
            table["next_seq"] += 1
            stored.append(tuple(row.get(f.name) for f in schema.fields))
            ids.append(row[ID])
        added = self.spark.createDataFrame(stored, schema).withColumn(HASH, row_hash(schema))
        return added.select(*schema.names), ids

    def _validated(self, table: dict[str, Any], schema: T.StructType, data: Mapping[str, Any]) -> dict[str, Any]:
        row: dict[str, Any] = {}
        for field in table["columns"]:
            if field not in data:
                raise ValueError(f"Missing field: {field}")
            kind = schema[field].dataType if field in schema.names else T.StringType()
            row[field] = checked(field, data[field], kind)
        extra = {k: json.dumps(v, sort_keys=True) for k, v in data.items() if k not in table["columns"] and k not in (ID, HASH, SEQ, EXTRA)}
        row[EXTRA] = extra or None
        return row

    def _stored_view(self, name: str, data: Mapping[str, Any]) -> dict[str, Any]:
        schema = self.catalog.schema(self.catalog.table(name))
        return {k: checked(k, v, schema[k].dataType) if k in schema.names else v for k, v in data.items()}

    def insert_frame(self, name: str, rows: DataFrame, order_by: Sequence[str] | None = None) -> int:
        """Insert a DataFrame in one commit: ids follow ``order_by`` (default: all columns). The number of rows.

        The columns must be the table's, of castable types without nulls lost;
        the work and the size of a commit grow with the new rows alone.
        """
        state = self.catalog.draft()
        added = self.stage_frame(state, name, rows, order_by)
        self.catalog.commit(state)
        return added

    def stage_frame(self, state: dict[str, Any], name: str, rows: DataFrame, order_by: Sequence[str] | None = None) -> int:
        table = self.catalog.table(name, state)
        schema = self.catalog.schema(table)
        missing = [c for c in table["columns"] if c not in rows.columns]
        if missing:
            raise ValueError(f"Missing field: {missing[0]}")
        first, seq = table["auto_increment"], table["next_seq"]
        keep = [c for c in rows.columns if c in schema.names and c not in (SEQ, EXTRA, HASH)]
        numbered = with_ids(rows.select(*[F.col(f"`{c}`") for c in keep]), order_by or keep, start=1, id_col="__n")
        if ID not in keep:
            numbered = numbered.withColumn(ID, F.col("__n") + first)
        sealed = numbered.withColumn(SEQ, F.col("__n") + (seq - 1)).withColumn(EXTRA, F.lit(None).cast("map<string,string>"))
        typed = sealed.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields if f.name != HASH])
        segment = self.catalog.write_segment(name, table, typed.withColumn(HASH, row_hash(schema)))
        added = self.spark.read.schema(schema).parquet(self.catalog.files.at(segment)).count()
        table["segments"].append(segment)
        table["auto_increment"], table["next_seq"] = first + added, seq + added
        return added

    def update(self, name: str, conditions: Mapping[str, Any] | None, updates: Mapping[str, Any], operators: bool = False) -> int:
        """Set fields where the conditions hold: the number of rows changed. Nothing is written if there are none."""
        state = self.catalog.draft()
        count = self.stage_update(state, name, conditions, updates, operators)
        if count:
            self.catalog.commit(state)
        return count

    def stage_update(self, state, name, conditions, updates, operators: bool = False) -> int:
        return self._rewrite(state, name, conditions, operators, lambda table, rows: self.updated_rows(table, rows, conditions, updates, operators))

    def _rewrite(self, state, name, conditions, operators: bool, change) -> int:
        """Change the segments that hold rows which meet the conditions, and no others: the number of those rows."""
        table = self.catalog.table(name, state)
        # Names and values are checked also where no row is met.
        change(table, self.catalog.read(table))
        counts = self.catalog.matching(table, conditions, operators)
        hit = [s for s in table["segments"] if s in counts]
        if hit:
            rows = change(table, self.catalog.read({**table, "segments": hit}))
            table["segments"] = [s for s in table["segments"] if s not in counts] + [self.catalog.write_segment(name, table, rows)]
        return sum(counts.values())

    @staticmethod
    def updated_rows(table, rows: DataFrame, conditions, updates, operators: bool = False) -> DataFrame:
        unknown = [field for field in updates if field not in table["columns"]]
        if unknown:
            raise ValueError(f"Field {unknown[0]} does not exist")
        return update_rows(rows, conditions, updates, operators=operators)

    def delete(self, name: str, conditions: Mapping[str, Any] | None, operators: bool = False) -> int:
        """Delete the rows that meet the conditions, all without any: their number. Ids are not used again."""
        state = self.catalog.draft()
        count = self.stage_delete(state, name, conditions, operators)
        if count:
            self.catalog.commit(state)
        return count

    def stage_delete(self, state, name, conditions, operators: bool = False) -> int:
        return self._rewrite(state, name, conditions, operators, lambda _, rows: delete_rows(rows, conditions, operators))

    # Reading

    def query(self, name: str, conditions: Mapping[str, Any] | None = None, limit: int | None = None, operators: bool = False) -> DataFrame:
        """The rows that meet the conditions, as a DataFrame without the hidden order."""
        return select_rows(self.frame(name), conditions, limit, operators=operators)

    def select(
        self, name: str, conditions: Mapping[str, Any] | None = None, use_hash: bool = False, limit: int | None = None, operators: bool = False
    ) -> list[dict[str, Any]]:
        """Python rows in insertion order. ``use_hash`` is no different: a hash among the conditions is always pushed down."""
        return self.plain(self.query(name, conditions, limit, operators).orderBy(SEQ))

    @staticmethod
    def plain(rows: DataFrame) -> list[dict[str, Any]]:
        """Rows as dicts, undeclared fields among the others, hidden columns left out."""
        found = []
        for row in rows.toLocalIterator():
            data = {k: _plain(v) for k, v in row.asDict().items() if k not in (SEQ, EXTRA)}
            digest = data.pop(HASH, None)
            for key, text in (row[EXTRA] or {}).items() if EXTRA in rows.columns else ():
                data[key] = json.loads(text)
            found.append({**data, HASH: digest} if HASH in rows.columns else data)
        return found

    # Hashes

    def find_by_hash(self, name: str, digest: str, exact_match: bool = True) -> list[dict[str, Any]]:
        """Rows of a hash, or whose hash begins so; an unknown table has none."""
        if name not in self.tables:
            return []
        return self.plain(integrity.find_by_hash(self.frame(name), digest, exact_match).orderBy(SEQ))

    def find_by_hashed_value(self, name: str, value: Any) -> list[dict[str, Any]]:
        if name not in self.tables:
            return []
        return self.plain(integrity.find_by_hashed_value(self.frame(name), value).orderBy(SEQ))

    def find_by_hash_and_column(self, name: str, digest: str, column: str, value: Any) -> list[dict[str, Any]]:
        if name not in self.tables:
            return []
        return self.plain(integrity.find_by_hash_and_column(self.frame(name), digest, column, value).orderBy(SEQ))

    def _known(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"Table {name} does not exist")
        return self.frame(name)

    def verify_hash_integrity(self, name: str, listed: int | None = LISTED) -> dict[str, Any]:
        """Counts, and the first ``listed`` corrupted rows by id (None: all); :meth:`corrupted_rows` is the DataFrame of all."""
        rows = self._known(name)
        summary = integrity.verify_summary(rows).first().asDict()
        bad: list[dict[str, Any]] = []
        if summary["invalid_hashes"]:
            found = self.corrupted_rows(name).orderBy(ID)
            bad = [r.asDict() for r in (found if listed is None else found.limit(listed)).toLocalIterator()]
        return {**summary, "corrupted_rows": bad, "verified_at": now()}

    def corrupted_rows(self, name: str) -> DataFrame:
        return integrity.corrupted_rows(self._known(name))

    def get_hash_statistics(self, name: str, listed: int | None = LISTED) -> dict[str, Any]:
        """Counts, and of the first ``listed`` repeated hashes (None: all) as many ids; :meth:`duplicate_counts` is the DataFrame of all."""
        rows = self._known(name)
        stats = integrity.hash_statistics(rows).first().asDict()
        groups = ()
        if stats["duplicate_hash_count"]:
            groups = integrity.duplicate_hashes(rows, listed).toLocalIterator()
        return {**stats, "duplicate_hashes": {r[HASH]: r["ids"] for r in groups}}

    def duplicate_counts(self, name: str) -> DataFrame:
        return integrity.duplicate_counts(self._known(name))

    def repair_hash_index(self, name: str, recompute: bool = False) -> dict[str, int]:
        """Fill in missing hashes (or make all anew) and rewrite the table."""
        self._known(name)
        state = self.catalog.draft()
        table = self.catalog.table(name, state)
        rows = self.catalog.read(table)
        summary = integrity.repair_summary(rows, recompute).first().asDict()
        table["segments"] = [self.catalog.write_segment(name, table, integrity.repair_hashes(rows, recompute))] if table["segments"] else []
        self.catalog.commit(state)
        return summary

    def compare_hashes(self, name: str, row_id: int) -> bool:
        return name in self.tables and integrity.compare_hashes(self.frame(name), row_id).first()["matches"]

    def hash_index(self, name: str) -> DataFrame:
        """(hash, id): the hash index, derived from the current rows, sorted by hash in ranges of it."""
        rows = self.frame(name).filter(F.col(HASH) != "")
        return rows.select(HASH, ID).repartitionByRange(HASH, ID).sortWithinPartitions(HASH, ID)

    # Upkeep

    def vacuum(self, writing: float = WRITING) -> dict[str, int]:
        """Put each table's segments into one sorted by insertion, and delete what no table needs any more.

        Folders that a writer may be at, those changed less than ``writing`` seconds ago, stay.
        """
        state = self.catalog.draft()
        for name, table in state["tables"].items():
            if len(table["segments"]) > 1:
                rows = self.catalog.read(table)
                table["segments"] = [self.catalog.write_segment(name, table, rows.repartitionByRange(SEQ).sortWithinPartitions(SEQ))]
        self.catalog.commit(state)
        return {"deleted_folders": self.catalog.vacuum(writing)}

    def close(self) -> None:
        """Nothing is held open: every commit is complete when it returns."""

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def _plain(value: Any) -> Any:
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, bytearray):
        return bytes(value)
    return value
