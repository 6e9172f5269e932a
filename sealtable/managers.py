"""Hash and index managers: the same operators under the names users of such engines know."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from sealtable.database import Database
from sealtable.errors import IndexFailure, TableError
from sealtable.functions.canonical import calculate_hash, calculate_row_hash
from sealtable.operators import indexes
from sealtable.sources.catalog import now

INDEX_TYPES = ("btree", "hash", "bitmap")


class HashManager:
    def __init__(self, db: Database):
        self.db = db

    calculate_hash = staticmethod(calculate_hash)
    calculate_row_hash = staticmethod(calculate_row_hash)

    def find_by_hash(self, table: str, digest: str, exact_match: bool = True) -> list[dict[str, Any]]:
        return self.db.find_by_hash(table, digest, exact_match)

    def find_by_hashed_value(self, table: str, value: Any) -> list[dict[str, Any]]:
        return self.db.find_by_hashed_value(table, value)

    def find_by_hash_and_column(self, table: str, digest: str, column: str, value: Any) -> list[dict[str, Any]]:
        return self.db.find_by_hash_and_column(table, digest, column, value)

    def verify_hash_integrity(self, table: str) -> dict[str, Any]:
        return self.db.verify_hash_integrity(table)

    def get_hash_statistics(self, table: str) -> dict[str, Any]:
        return self.db.get_hash_statistics(table)

    def repair_hash_index(self, table: str, recompute: bool = False) -> dict[str, int]:
        return self.db.repair_hash_index(table, recompute)

    def compare_hashes(self, table: str, row_id: int) -> bool:
        return self.db.compare_hashes(table, row_id)

    def update_hash_index(self, table: str, digest: str, row_id: int, operation: str = "insert") -> None:
        """Nothing to do: the index is derived from the rows, so it is never behind them."""


class IndexManager:
    """Definitions are kept in the manifest; entries are derived from the current rows, so they are never stale."""

    def __init__(self, db: Database):
        self.db = db

    @property
    def indexes(self) -> dict[str, dict[str, Any]]:
        return self.db.catalog.state["indexes"]

    def create_index(self, table: str, column: str, index_name: str, index_type: str = "btree") -> dict[str, Any]:
        if index_name in self.indexes:
            raise IndexFailure(f"Index {index_name} already exists")
        if table not in self.db.tables:
            raise TableError(f"Table {table} does not exist")
        if column not in self.db.frame(table).columns:
            raise IndexFailure(f"Table {table} has no column {column}")
        if index_type not in INDEX_TYPES:
            raise IndexFailure(f"Index type {index_type} is not known")
        state = self.db.catalog.draft()
        state["indexes"][index_name] = {"table": table, "column": column, "type": index_type, "created_at": now()}
        self.db.catalog.commit(state)
        return self.indexes[index_name]

    def drop_index(self, index_name: str) -> None:
        self._known(index_name)
        state = self.db.catalog.draft()
        del state["indexes"][index_name]
        self.db.catalog.commit(state)

    def _known(self, index_name: str) -> dict[str, Any]:
        if index_name not in self.indexes:
            raise IndexFailure(f"Index {index_name} does not exist")
        return self.indexes[index_name]

    def entries(self, index_name: str) -> DataFrame:
        index = self._known(index_name)
        return indexes.build_index(self.db.frame(index["table"]), index["column"])

    def find_by_index(self, index_name: str, value: Any) -> list[dict[str, Any]]:
        """The rows with this value: the filter reaches the scan, which is what a derived index amounts to."""
        index = self._known(index_name)
        return self.db.select(index["table"], {index["column"]: value})

    def index_statistics(self, index_name: str) -> dict[str, Any]:
        index = self._known(index_name)
        rows = self.db.frame(index["table"])
        stats = indexes.index_statistics(rows, index["column"]).first().asDict()
        table = self.db.tables[index["table"]]
        size = sum(self.db.catalog.files.size(self.db.catalog.files.at(s)) for s in table["segments"])
        return {"name": index_name, "table": index["table"], "column": index["column"], "type": index["type"], **stats, "size": size}
