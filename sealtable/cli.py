"""Command line: ``python -m sealtable.cli --db PATH COMMAND``. Each call opens the database anew."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession

from sealtable.database import Database
from sealtable.errors import SealError
from sealtable.sources import admin, jsonio


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sealtable", description=__doc__)
    parser.add_argument("--db", help="database folder")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("install", help="nothing to set up; for scripts that call it")
    for name in ("create", "open"):
        commands.add_parser(name).add_argument("name", nargs="?", help="database folder, if not given by --db")
    table = commands.add_parser("table").add_subparsers(dest="action", required=True).add_parser("create")
    table.add_argument("table")
    table.add_argument("--schema", required=True, type=json.loads, help='{"column": "str|int|float|bool"}')
    table.add_argument("--hash-index", action="store_true")
    insert = commands.add_parser("insert")
    insert.add_argument("table")
    insert.add_argument("--data", required=True, type=json.loads, help="a row, or a list of rows")
    select = commands.add_parser("select")
    select.add_argument("table")
    select.add_argument("--where", type=json.loads)
    select.add_argument("--hash")
    select.add_argument("--limit", type=int)
    update = commands.add_parser("update")
    update.add_argument("table")
    update.add_argument("--where", required=True, type=json.loads)
    update.add_argument("--set", required=True, type=json.loads)
    delete = commands.add_parser("delete")
    delete.add_argument("table")
    delete.add_argument("--where", required=True, type=json.loads)
    for action in ("hash",):
        deeds = commands.add_parser(action).add_subparsers(dest="action", required=True)
        for name in ("verify", "repair", "stats"):
            deeds.add_parser(name).add_argument("table")
    for name in ("import", "export"):
        commands.add_parser(name).add_argument("json_file")
    commands.add_parser("info")
    for name in ("backup", "restore"):
        commands.add_parser(name).add_argument("backup_path")
    commands.add_parser("vacuum")
    commands.add_parser("close", help="nothing is held open")
    return parser


def run(arguments: Sequence[str], spark: SparkSession | None = None) -> Any:
    """What a command answers."""
    args = _parser().parse_args(arguments)
    if args.command in ("install", "close"):
        return {"status": "ok"}
    path = args.db or getattr(args, "name", None)
    if not path:
        raise SystemExit("a database folder is needed: --db PATH")
    spark = spark or SparkSession.builder.appName("sealtable").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    db = Database(spark, path, auto_create=args.command != "open")
    match args.command:
        case "create" | "open" | "info":
            return admin.get_database_info(db)
        case "table":
            return {"table": args.table, "columns": db.create_table(args.table, args.schema, args.hash_index)["columns"]}
        case "insert":
            if isinstance(args.data, list):
                return {"ids": db.insert_many(args.table, args.data)}
            return dict(zip(("id", "hash"), db.insert(args.table, args.data, return_hash=True)))
        case "select":
            conditions = {**(args.where or {}), **({"hash": args.hash} if args.hash else {})}
            return db.select(args.table, conditions, limit=args.limit)
        case "update":
            return {"updated": db.update(args.table, args.where, args.set)}
        case "delete":
            return {"deleted": db.delete(args.table, args.where)}
        case "hash":
            deed = {"verify": db.verify_hash_integrity, "repair": db.repair_hash_index, "stats": db.get_hash_statistics}
            return deed[args.action](args.table)
        case "import":
            return jsonio.import_from_json(db, args.json_file)
        case "export":
            return jsonio.export_to_json(db, args.json_file)
        case "backup":
            return admin.backup(db, args.backup_path)
        case "restore":
            return admin.restore(db, args.backup_path)
        case "vacuum":
            return db.vacuum()


def main(arguments: Sequence[str] | None = None) -> int:
    try:
        print(json.dumps(run(sys.argv[1:] if arguments is None else arguments), indent=2, default=str))
    except (SealError, ValueError, TypeError) as error:
        print(f"{type(error).__name__}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
