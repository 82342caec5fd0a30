"""Tables that change together: immutable folders, numbered manifests, one commit.

A store is a folder.  Data is written to new folders under ``data`` and never
changed; a manifest ``versions/<number>.json`` names the folders of every table.
A change is staged against a version: nothing of it can be seen until its
manifest is moved to the next number, which only one of several writers can
do.  So tables and files (audio, say) appear together or not at all, a job that
dies leaves the version before it readable, a reader keeps the version that it
opened, and a change may read what it replaces.

A keyed table lies in groups by the hash of its key; a merge reads and rewrites
only the groups that hold its keys, the others are named again.  The move must
fail where the number is taken: HDFS and local folders do, for object stores
without such a move another committer is needed.  Folders of changes that were
given up are named by no manifest; ``unreferenced`` lists them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.catalog import upsert
from tessera.sources.scratch import stored

GROUP = "__group"


def listed(rows: DataFrame, key: str) -> DataFrame:
    """The keys of a table as the side of a join that is never broadcast: files of a few MB, of a wide table above all, may hold millions of them."""
    return rows.select(key).hint("merge")


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change was staged against."""


@dataclass(frozen=True)
class Version:
    """What a reader sees: table -> schema, key, folders by group."""

    store: Store
    number: int
    tables: dict = field(default_factory=dict)

    def read(self, table: str, groups: Iterable[int] | None = None) -> DataFrame:
        found = self.tables[table]
        schema = T.StructType.fromJson(found["schema"])
        wanted = None if groups is None else {str(g) for g in groups}
        paths = [p for g, parts in found["parts"].items() if wanted is None or g in wanted for p in parts]
        spark = self.store.spark
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def find(self, table: str, keys: DataFrame) -> DataFrame:
        """Rows of some keys; only their groups are read."""
        key = self.tables[table]["key"]
        return self.read(table, self.store.groups_of(keys, key)).join(keys.select(key).distinct(), key, "left_semi")

    def folders(self) -> set[str]:
        return {p for t in self.tables.values() for parts in t["parts"].values() for p in parts}


class Store:
    def __init__(self, spark: SparkSession, root: str, groups: int = 64) -> None:
        self.spark, self.root, self.groups = spark, root.rstrip("/"), groups

    def group(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.groups)).cast("int")

    def groups_of(self, rows: DataFrame, key: str) -> list[int]:
        """The groups that hold the keys of ``rows``: at most ``groups`` numbers."""
        return [r[0] for r in rows.select(self.group(key)).distinct().collect()]

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def listed(self, folder: str) -> list[str]:
        at, fs = self._path(f"{self.root}/{folder}" if folder else self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def current(self) -> Version:
        numbers = [int(n[: -len(".json")]) for n in self.listed("versions") if n.endswith(".json") and not n.startswith(".")]
        return self.at(max(numbers)) if numbers else Version(self, 0)

    def at(self, number: int) -> Version:
        text = self.spark.read.text(f"{self.root}/versions/{number:012d}.json", wholetext=True).first()[0]
        return Version(self, number, json.loads(text)["tables"])

    def claim(self, number: int, tables: dict) -> None:
        """The manifest is written beside its place and moved there, unless the number is taken."""
        jvm = self.spark._jvm
        staged, fs = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps({"tables": tables}).encode()))
        out.close()
        final, _ = self._path(f"{self.root}/versions/{number:012d}.json")
        never = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(staged, final, never)
        except Py4JJavaError as e:
            fs.delete(staged, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {number} of {self.root} is another writer's") from None
            raise

    def change(self, base: Version | None = None) -> Change:
        return Change(self, self.current() if base is None else base)

    def unreferenced(self) -> list[str]:
        """Data folders that no version names: of changes that failed, or are still being staged."""
        known = set()
        for n in self.listed("versions"):
            if n.endswith(".json") and not n.startswith("."):
                known |= {p.removeprefix(f"{self.root}/data/").split("/")[0] for p in self.at(int(n[:-5])).folders()}
        return [d for d in self.listed("data") if d not in known]


class Change:
    """Staged writes against a version; ``commit`` makes all of them visible."""

    def __init__(self, store: Store, base: Version) -> None:
        self.store, self.base, self.tables = store, base, {k: dict(v) for k, v in base.tables.items()}

    def folder(self, name: str) -> str:
        """A new folder for files that tasks write; it belongs to the version once ``attach_folder`` names it."""
        return f"{self.store.root}/data/{name}-{uuid.uuid4().hex}"

    def attach_folder(self, name: str, path: str) -> None:
        held = self.tables.get(name, {"schema": T.StructType([]).jsonValue(), "key": None, "parts": {"files": []}})
        self.tables[name] = {**held, "parts": {"files": [*held["parts"]["files"], path]}}

    def _write(self, table: str, df: DataFrame, key: str | None) -> dict[str, list[str]]:
        path = self.folder(table)
        if key is None:
            df.write.parquet(path)
            return {"all": [path]}
        grouped = df.withColumn(GROUP, self.store.group(key))
        grouped.repartition(self.store.groups, GROUP).write.partitionBy(GROUP).parquet(path)
        name = path.rsplit("/", 1)[1]
        return {d.split("=")[1]: [f"{path}/{d}"] for d in self.store.listed(f"data/{name}") if d.startswith(GROUP)}

    def _checked(self, df: DataFrame, key: str) -> DataFrame:
        """Rows to be written, made once; a key is there, once."""
        rows = stored(df, "change")
        bad = rows.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).collect()
        if bad:
            raise ValueError(f"{key} {bad[0][0]!r} is {'null' if bad[0][0] is None else 'there more than once'}")
        return rows

    def replace(self, table: str, df: DataFrame, key: str | None = None) -> Change:
        """The whole table; ``df`` may read the version that it replaces."""
        rows = df if key is None else self._checked(df, key)
        self.tables[table] = {"schema": df.schema.jsonValue(), "key": key, "parts": self._write(table, rows, key)}
        return self

    def append(self, table: str, df: DataFrame, key: str) -> Change:
        """Rows with new keys: no old file is read but those that could hold the keys, none is rewritten."""
        if table not in self.tables:
            return self.replace(table, df, key)
        rows = self._checked(df, key)
        now = Version(self.store, self.base.number, self.tables)
        held = now.read(table, self.store.groups_of(rows, key)).join(listed(rows, key), key, "left_semi").limit(1).collect()
        if held:
            raise ValueError(f"{table} has {key} {held[0][key]!r} already")
        parts = {g: list(p) for g, p in self.tables[table]["parts"].items()}
        names = T.StructType.fromJson(self.tables[table]["schema"]).names
        for g, p in self._write(table, rows.select(*names), key).items():
            parts[g] = parts.get(g, []) + p
        self.tables[table] = {**self.tables[table], "parts": parts}
        return self

    def merge(self, table: str, df: DataFrame, insert: bool = True, on_insert: Iterable[str] = ()) -> Change:
        """Rows by key: columns that ``df`` has replace the old ones, but those of ``on_insert`` only where the key is new.

        Only the groups that hold the keys are read and rewritten.  Without
        ``insert`` an unknown key is an error.
        """
        key = self.tables[table]["key"]
        rows = self._checked(df, key)
        groups = self.store.groups_of(rows, key)
        old = Version(self.store, self.base.number, self.tables).read(table, groups)
        if not insert:
            lost = rows.join(listed(old, key), key, "left_anti").limit(1).collect()
            if lost:
                raise ValueError(f"{table} has no {key} {lost[0][key]!r}")
        merged = upsert(old, rows, key, {c: F.col(f"o.{c}") for c in on_insert if c in df.columns})
        parts = {g: p for g, p in self.tables[table]["parts"].items() if int(g) not in set(groups)}
        self.tables[table] = {**self.tables[table], "parts": {**parts, **self._write(table, merged, key)}}
        return self

    def commit(self) -> Version:
        number = self.base.number + 1
        self.store.claim(number, self.tables)
        return Version(self.store, number, self.tables)
