"""A table of versions on plain Parquet files: changes are written beside, and merged when read.

A version is a manifest that lists data files and files of deleted keys, each with the
number of the version that brought it. A change writes its own rows and keys only, and
the next manifest, which must not exist yet: of two writers of one version the second
fails and may try again. Older versions stay readable until they are ``expired``.
A row is part of a version if no later change deleted its key.

Defined cases: a null key deletes nothing and is never replaced; a key that an upsert
has twice is there twice; an unknown key deletes nothing; columns may be added, and
older rows have nulls in them; a table without rows keeps its columns.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.storage import freed, new_folder

#: Deleted keys that are sent to every task; more are joined by a shuffle.
FEW_KEYS = 1_000_000
#: Keys that are looked up one by one.
NAMED = 1000
_AT, _GONE = "__version", "__gone"


@dataclass(frozen=True)
class Entry:
    """Files of one change: rows, or keys (``by`` names their column) that it deletes."""

    folder: str
    version: int
    by: str | None
    rows: int


class VersionedTable:
    """``found_by`` names columns whose values Parquet's Bloom filters find (see ``of``)."""

    def __init__(self, spark: SparkSession, path: str, found_by: tuple[str, ...] = ()):
        self.spark, self.path, self.found_by = spark, path, found_by

    @classmethod
    def create(cls, rows: DataFrame, path: str | None = None, found_by: tuple[str, ...] = ()) -> VersionedTable:
        """A table of version 0."""
        table = cls(rows.sparkSession, path or new_folder(rows.sparkSession, "table"), found_by)
        table._commit(0, [table._written(rows, 0)], rows.schema)
        return table

    def _files(self, path: str):
        name = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return name.getFileSystem(self.spark._jsc.hadoopConfiguration()), name

    def versions(self) -> list[int]:
        files, path = self._files(f"{self.path}/versions")
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in files.listStatus(path) if s.getPath().getName().endswith(".json"))

    def _manifest(self, version: int | None = None) -> tuple[int, list[Entry], StructType]:
        version = self.versions()[-1] if version is None else version
        files, path = self._files(f"{self.path}/versions/{version:012d}.json")
        stream = files.open(path)
        try:
            told = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return version, [Entry(**e) for e in told["entries"]], StructType.fromJson(told["schema"])

    def _commit(self, version: int, entries: list[Entry], schema: StructType) -> int:
        files, path = self._files(f"{self.path}/versions/{version:012d}.json")
        stream = files.create(path, False)  # fails where the version is there already
        stream.write(bytearray(json.dumps({"entries": [vars(e) for e in entries], "schema": json.loads(schema.json())}).encode()))
        stream.close()
        return version

    def _written(self, rows: DataFrame, version: int, by: str | None = None) -> Entry:
        folder = new_folder(self.spark, "change")
        blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in self.found_by if c in rows.columns}
        with freed(self.spark):
            rows.write.options(compression="zstd", **blooms).parquet(folder)
        return Entry(folder, version, by, self.spark.read.schema(rows.schema).parquet(folder).count())

    def change(self, rows: DataFrame | None = None, gone: tuple[tuple[DataFrame, str], ...] = ()) -> int:
        """The version without the rows of some keys, each of whichever column, and then with ``rows``."""
        version, entries, schema = self._manifest()
        new = [self._written(keys.select(F.col(by).cast(schema[by].dataType)).where(F.col(by).isNotNull()).distinct(), version + 1, by) for keys, by in gone]
        if rows is not None:
            new.append(self._written(rows, version + 1))
            schema = StructType([*schema.fields, *(f for f in rows.schema.fields if f.name not in schema.names)])
        return self._commit(version + 1, [*entries, *new], schema)

    def upsert(self, rows: DataFrame, key: str) -> int:
        """The version with ``rows`` in place of what has their keys."""
        return self.change(rows, ((rows, key),))

    def delete(self, keys: DataFrame, key: str) -> int:
        """The version without the rows of some keys."""
        return self.change(None, ((keys, key),))

    def reset(self) -> int:
        """The version without rows."""
        version, _, schema = self._manifest()
        return self._commit(version + 1, [], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last by default."""
        _, entries, schema = self._manifest(version)
        data, deletes = [e for e in entries if e.by is None], [e for e in entries if e.by]
        if not data:
            return self.spark.createDataFrame([], schema)
        # rows that no later change may have deleted skip the merge
        last = max((e.version for e in deletes), default=-1)
        new, old = [e for e in data if e.version >= last], [e for e in data if e.version < last]
        parts = [self.spark.read.schema(schema).parquet(*[e.folder for e in new])] if new else []
        if old:
            rows = reduce(DataFrame.union, [self.spark.read.schema(schema).parquet(e.folder).withColumn(_AT, F.lit(e.version)) for e in old])
            for by in sorted({e.by for e in deletes}):
                own = [e for e in deletes if e.by == by]
                kind = StructType([schema[by]])
                gone = reduce(DataFrame.union, [self.spark.read.schema(kind).parquet(e.folder).withColumn(_GONE, F.lit(e.version)) for e in own])
                gone = gone.groupBy(by).agg(F.max(_GONE).alias(_GONE))
                gone = F.broadcast(gone) if sum(e.rows for e in own) <= FEW_KEYS else gone
                rows = rows.join(gone, by, "left").where(F.col(_GONE).isNull() | (F.col(_GONE) <= F.col(_AT))).drop(_GONE)
            parts.append(rows.select(*schema.names))
        return reduce(DataFrame.unionByName, parts)

    def of(self, keys: DataFrame, key: str) -> DataFrame:
        """The rows of some keys: a few are named in the scan's filter, more are joined."""
        own = keys.select(key).distinct()
        few = [r[0] for r in own.limit(NAMED + 1).collect()]
        rows = self.read()
        return rows.where(F.col(key).isin(few)) if len(few) <= NAMED else rows.join(own, key, "left_semi").select(*rows.columns)

    def compact(self) -> int:
        """The version with the same rows in one place and nothing to merge."""
        version, _, schema = self._manifest()
        return self._commit(version + 1, [self._written(self.read(version), version + 1)], schema)

    def changed(self, version: int) -> DataFrame:
        """The rows that a version brought, as it wrote them."""
        _, entries, schema = self._manifest(version)
        own = [e.folder for e in entries if e.by is None and e.version == version]
        return self.spark.read.schema(schema).parquet(*own) if own else self.spark.createDataFrame([], schema)

    def expired(self, keep: int) -> int:
        """Forgets all but the last ``keep`` versions, and deletes what only they had; tells how many folders went."""
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        used = {e.folder for v in kept for e in self._manifest(v)[1]}
        gone = {e.folder for v in old for e in self._manifest(v)[1]} - used
        for version in old:
            files, path = self._files(f"{self.path}/versions/{version:012d}.json")
            files.delete(path, False)
        for folder in gone:
            files, path = self._files(folder)
            files.delete(path, True)
        return len(gone)
