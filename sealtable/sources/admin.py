"""Backups, restores, sizes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from sealtable.database import Database
from sealtable.errors import DatabaseError
from sealtable.sources.catalog import Catalog, now
from sealtable.sources.files import Files


def backup(db: Database, path: str) -> dict[str, Any]:
    """Copy the current manifest and the segments it names to a new folder."""
    source, target = db.catalog.files, Files(db.spark, path)
    if target.exists(target.root) and target.names(target.root):
        raise DatabaseError(f"{path} is there already")
    target.make(target.at("manifests"))
    for table in db.tables.values():
        for segment in table["segments"]:
            source.copy(source.at(segment), target.at(segment))
    for entry in db.catalog.state["history"]:
        if source.exists(source.at("transactions", f"{entry['id']}.json")):
            source.copy(source.at("transactions", f"{entry['id']}.json"), target.at("transactions", f"{entry['id']}.json"))
    name = f"{db.catalog.state['version']:012d}.json"
    source.copy(source.at("manifests", name), target.at("manifests", name))
    return {"backup_path": path, "timestamp": now(), "size": target.size(target.root)}


def restore(db: Database, path: str) -> dict[str, Any]:
    """Make a backup's state the current one, by a commit on top: it can be taken back like any other."""
    copy = Catalog(db.spark, path, auto_create=False)
    state = db.catalog.draft()
    for table in copy.state["tables"].values():
        for segment in table["segments"]:
            if not db.catalog.files.exists(db.catalog.files.at(segment)):
                copy.files.copy(copy.files.at(segment), db.catalog.files.at(segment))
    state["tables"], state["indexes"] = copy.state["tables"], copy.state["indexes"]
    db.catalog.commit(state)
    return {"restored_from": path, "timestamp": now()}


def get_table_size(db: Database, name: str) -> dict[str, Any]:
    if name not in db.tables:
        raise ValueError(f"Table {name} does not exist")
    table, files = db.tables[name], db.catalog.files
    return {
        "table_name": name,
        "row_count": db.frame(name).count(),
        "page_count": len(table["segments"]),
        "estimated_size_bytes": sum(files.size(files.at(s)) for s in table["segments"]),
        "hash_index_enabled": table["enable_hash_index"],
    }


def get_database_info(db: Database) -> dict[str, Any]:
    counts = row_counts({name: db.frame(name) for name in db.tables})
    total = sum(r["row_count"] for r in counts.collect()) if counts is not None else 0
    return {
        "path": db.path,
        "file_size_bytes": db.catalog.files.size(db.catalog.files.root),
        "tables_count": len(db.tables),
        "tables": list(db.tables),
        "total_rows": total,
        "version": db.catalog.state["version"],
    }


def row_counts(tables: dict):
    """(table_name, row_count) of each DataFrame, or None without any."""
    found = None
    for name, rows in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        found = one if found is None else found.unionByName(one)
    return found
