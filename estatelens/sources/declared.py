"""Declared tables as a Spark data source: a partition for each YAML file, parsed by the task that reads it.

    spark.dataSource.register(DeclaredTables)
    spark.read.format("declared_tables").load(root)

A file that breaks the contract gives rows with `error` set and everything else null, so that
a reader decides whether to stop. YAML files without a `sources` section and empty ones give no
row. Paths are local ones or addresses of a store that pyarrow's file systems reach (s3a is read as s3).
"""

from __future__ import annotations

import os

import yaml
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import SOURCES


def _store(root: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path in it, and what stands before a path in an address."""
    address = root if ":" in root else os.path.abspath(root)
    store, path = fs.FileSystem.from_uri(address.replace("s3a://", "s3://", 1))
    if isinstance(store, fs.LocalFileSystem):
        return store, path, "file:"
    return store, path, address[: address.rindex(path)] if path in address else ""


def fields_error(value, keys: set[str], need: set[str]) -> str | None:
    """Why value isn't a mapping of these fields."""
    if not isinstance(value, dict) or set(value) - keys or need - set(value):
        return f"expected the fields {sorted(keys)}, at least {sorted(need)}"
    return None


def _table_row(path: str, source: dict, table) -> tuple[tuple | None, str | None]:
    if error := fields_error(table, {"name", "columns"}, {"name"}):
        return None, error
    listed = table.get("columns") or []
    if error := next((e for c in listed if (e := fields_error(c, {"name"}, {"name"}))), None):
        return None, error
    columns = [str(c["name"]).strip() for c in listed]
    if len(set(columns)) < len(columns):
        return None, f"{table['name']} declares a column twice"
    name, own = source["name"], table["name"]
    database, schema = source.get("database"), source.get("schema")
    relation = ".".join(p for p in (database, schema or name, own) if p)
    pointer = ("dbt_yaml", path, f"source={name}.{own}", None, None)
    return (f"source.{name}.{own}", name, own, database, schema, relation, columns, path, [pointer]), None


def declared_rows(path: str, body: str):
    """(row, error) for each table that one file declares; one of the two is null."""
    try:
        spec = yaml.safe_load(body)
    except yaml.YAMLError as e:
        yield None, f"not YAML: {e}"
        return
    if not isinstance(spec, dict) or "sources" not in spec:
        return
    if error := fields_error(spec, {"version", "sources"}, {"sources"}):
        yield None, error
        return
    for source in spec["sources"] or []:
        if error := fields_error(source, {"name", "database", "schema", "tables"}, {"name", "tables"}):
            yield None, error
            continue
        for table in source["tables"] or []:
            yield _table_row(path, source, table)


class _File(InputPartition):
    def __init__(self, path: str, shown: str):
        self.path, self.shown = path, shown


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[_File]:
        store, base, prefix = _store(self.root)
        hidden = lambda p: any(part[:1] in "._" for part in p[len(base) :].strip("/").split("/"))
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.extension in ("yml", "yaml") and not hidden(f.path))
        return [_File(p, prefix + p) for p in paths]

    def read(self, partition: _File):
        if partition is None:  # no file at all
            return
        store, _, _ = _store(self.root)
        with store.open_input_stream(partition.path) as f:
            body = f.read().decode()
        for row, error in declared_rows(partition.shown, body):
            yield (*row, None) if row else (None,) * 7 + (partition.shown, None, error)


class DeclaredTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "declared_tables"

    def schema(self) -> str:
        return f"{SOURCES}, error string"

    def reader(self, schema) -> _Reader:
        if "path" not in self.options:
            raise ValueError("declared_tables needs the path of a project")
        return _Reader(self.options["path"])
