"""Databases, collections and aliases under one folder."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from orrery.errors import AlreadyExistsError, NotFoundError, SchemaError, StateError
from orrery.functions.temporal import check_timezone
from orrery.schema import CollectionSpec
from orrery.sources.files import Files, Versions
from orrery.sources.store import Collection

DEFAULT = "default"
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,254}")


class Catalog:
    """``root/DATABASE/database/NUMBER.json`` and ``root/DATABASE/COLLECTION/``; the database ``default`` always exists."""

    def __init__(self, spark: SparkSession, root: object):
        self.spark, self.files, self.closed = spark, Files(spark, root), False
        if not self._version(DEFAULT).exists():
            self._version(DEFAULT).write(0, {"properties": {}, "aliases": {}})

    def _version(self, database: str) -> Versions:
        return Versions(self.files.sub(database), "database")

    def _db(self, name: str) -> dict:
        if self.closed:
            raise StateError("the catalog is closed")
        if not self.has_database(name):
            raise NotFoundError(f"no database is called {name!r}")
        return self._version(name).read()[1]

    def _save(self, name: str, value: dict) -> None:
        if not self._version(name).write(self._version(name).read()[0], value):
            raise StateError("another writer was faster; nothing was changed")

    def _is_collection(self, database: str, name: str) -> bool:
        return self.files.exists(f"{database}/{name}/spec.json")

    # databases

    def create_database(self, name: str, properties: dict | None = None) -> None:
        _check(name)
        if self.has_database(name):
            raise AlreadyExistsError(f"there is a database {name!r}")
        if "timezone" in (properties or {}):
            check_timezone(properties["timezone"])
        self._version(name).write(0, {"properties": properties or {}, "aliases": {}})

    def drop_database(self, name: str) -> None:
        self._db(name)
        if name == DEFAULT or self.list_collections(name):
            raise StateError(f"{name} is the default database or not empty")
        self.files.remove(name)

    def has_database(self, name: str) -> bool:
        return self._version(name).exists()

    def list_databases(self) -> list[str]:
        return [n for n in self.files.list() if self._version(n).exists()]

    def describe_database(self, name: str = DEFAULT) -> dict:
        return {"name": name, "properties": self._db(name)["properties"], "collections": self.list_collections(name)}

    def alter_database_properties(self, name: str = DEFAULT, properties: dict | None = None, delete_keys: list[str] | None = None) -> None:
        d = self._db(name)
        if "timezone" in (properties or {}):
            check_timezone(properties["timezone"])
        d["properties"] = {k: v for k, v in (d["properties"] | (properties or {})).items() if k not in (delete_keys or [])}
        self._save(name, d)

    def drop_database_properties(self, name: str = DEFAULT, keys: list[str] | None = None) -> None:
        self.alter_database_properties(name, delete_keys=keys)

    # collections

    def create_collection(self, name: str, spec: CollectionSpec, properties: dict | None = None, database: str = DEFAULT) -> Collection:
        _check(name)
        d = self._db(database)
        if name in d["aliases"] or self.has_collection(name, database):
            raise AlreadyExistsError(f"the name {name!r} is taken")
        zone = {"timezone": d["properties"]["timezone"]} if "timezone" in d["properties"] else {}
        return Collection.create(self.spark, self.files.at(f"{database}/{name}"), spec, zone | (properties or {}))

    def collection(self, name: str, database: str = DEFAULT) -> Collection:
        real = self.resolve(name, database)
        return Collection(self.spark, self.files.at(f"{database}/{real}"))

    def drop_collection(self, name: str, database: str = DEFAULT) -> None:
        """Drops the collection and its aliases; nothing happens if there is none."""
        d = self._db(database)
        self.files.remove(f"{database}/{name}")
        d["aliases"] = {a: c for a, c in d["aliases"].items() if c != name}
        self._save(database, d)

    def rename_collection(self, old: str, new: str, database: str = DEFAULT) -> None:
        _check(new)
        d = self._db(database)
        if not self.has_collection(old, database):
            raise NotFoundError(f"no collection is called {old!r}")
        if new in d["aliases"] or self.has_collection(new, database):
            raise AlreadyExistsError(f"the name {new!r} is taken")
        self.files.rename(f"{database}/{old}", f"{database}/{new}")
        d["aliases"] = {a: new if c == old else c for a, c in d["aliases"].items()}
        self._save(database, d)

    def has_collection(self, name: str, database: str = DEFAULT) -> bool:
        return self._is_collection(database, self._db(database)["aliases"].get(name, name))

    def list_collections(self, database: str = DEFAULT) -> list[str]:
        self._db(database)
        return [n for n in self.files.list(database) if self._is_collection(database, n)]

    def truncate_collection(self, name: str, database: str = DEFAULT) -> None:
        self.collection(name, database).truncate()

    def collection_stats(self, name: str, database: str = DEFAULT) -> dict:
        return {"row_count": self.collection(name, database).num_entities()}

    def partition_stats(self, name: str, partition: str, database: str = DEFAULT) -> dict:
        return {"row_count": self.collection(name, database).num_entities(partition)}

    def alter_collection_properties(self, name: str, properties: dict | None = None, delete_keys: list[str] | None = None, database: str = DEFAULT) -> None:
        self.collection(name, database).alter_properties(properties, delete_keys)

    # snapshots

    def create_snapshot(self, collection: str, snapshot: str, description: str = "", database: str = DEFAULT) -> None:
        self.collection(collection, database).create_snapshot(snapshot, description)

    def list_snapshots(self, collection: str, database: str = DEFAULT) -> list[str]:
        return self.collection(collection, database).list_snapshots()

    def drop_snapshot(self, collection: str, snapshot: str, database: str = DEFAULT) -> None:
        self.collection(collection, database).drop_snapshot(snapshot)

    def restore_snapshot(self, collection: str, snapshot: str, new: str, database: str = DEFAULT) -> Collection:
        """A new collection with the rows that the snapshot saw."""
        c = self.collection(collection, database)
        rows = c.snapshot_rows(snapshot)
        out = self.create_collection(new, c.spec, c.state["properties"], database)
        s = c.state["snapshots"][snapshot]
        entry = out._write(rows, 1, s["seq"], live=True)  # noqa: SLF001
        out._set(data=[entry], next_seq=s["seq"] + 1, next_id=c.state["next_id"], partitions=s["partitions"])  # noqa: SLF001
        return out

    # aliases

    def create_alias(self, collection: str, alias: str, database: str = DEFAULT) -> None:
        d = self._db(database)
        _check(alias)
        if alias in d["aliases"] or self.has_collection(alias, database):
            raise AlreadyExistsError(f"the name {alias!r} is taken")
        self._point(d, alias, collection, database)

    def alter_alias(self, collection: str, alias: str, database: str = DEFAULT) -> None:
        d = self._db(database)
        if alias not in d["aliases"]:
            raise NotFoundError(f"no alias is called {alias!r}")
        self._point(d, alias, collection, database)

    def _point(self, d: dict, alias: str, collection: str, database: str) -> None:
        if not self._is_collection(database, collection):
            raise NotFoundError(f"no collection is called {collection!r}")
        d["aliases"][alias] = collection
        self._save(database, d)

    def drop_alias(self, alias: str, database: str = DEFAULT) -> None:
        d = self._db(database)
        d["aliases"].pop(alias, None)
        self._save(database, d)

    def describe_alias(self, alias: str, database: str = DEFAULT) -> dict:
        d = self._db(database)
        if alias not in d["aliases"]:
            raise NotFoundError(f"no alias is called {alias!r}")
        return {"alias": alias, "collection": d["aliases"][alias], "database": database}

    def list_aliases(self, collection: str | None = None, database: str = DEFAULT) -> list[str]:
        return sorted(a for a, c in self._db(database)["aliases"].items() if collection in (None, c))

    def resolve(self, name: str, database: str = DEFAULT) -> str:
        real = self._db(database)["aliases"].get(name, name)
        if not self._is_collection(database, real):
            raise NotFoundError(f"no collection is called {name!r}")
        return real

    def close(self) -> None:
        self.closed = True


def _check(name: str) -> None:
    if not _NAME.fullmatch(name or ""):
        raise SchemaError(f"{name!r} is no name: letters, digits and underscores, not beginning with a digit")
