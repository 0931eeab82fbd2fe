"""Named tables whose versions are committed together: snapshots, compaction, vacuum, and the two-tier vector store.

Rows lie in folders that never change. A manifest lists the folders of every table, and properties (such as high-water marks); it is written aside and
renamed to the next number, which the file system does as a whole or not at all. So an interrupted write leaves the last version as it was, readers
keep the version they began with, and of two writers of the same version one fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass
class Manifest:
    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)
    note: str = ""


@dataclass
class Versions:
    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def numbers(self) -> list[int]:
        fs, at = self._fs()
        folder = at(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def manifest(self, number: int | None = None) -> Manifest:
        """The latest, or that of a version; an empty one where nothing is committed."""
        known = self.numbers()
        if number is None and not known:
            return Manifest()
        number = known[-1] if number is None else number
        if number not in known:
            raise ValueError(f"there is no version {number}")
        return Manifest(**json.loads(self.spark.read.text(f"{self.path}/manifests/v{number}").first()[0]))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        entry = self.manifest(version).tables[table]
        schema = StructType.fromJson(entry["schema"])
        if not entry["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in entry["folders"]])

    def _stored(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, properties: dict[str, str] | None = None, note: str = "", base: Manifest | None = None) -> int:
        """One new version: tables with new rows, or with rows added (of the table's schema); all of it or nothing. base: the version it was derived from, by default the latest."""
        base = self.manifest() if base is None else base
        tables = dict(base.tables)
        for name, df in (replace or {}).items():
            tables[name] = {"schema": df.schema.jsonValue(), "folders": [self._stored(df)]}
        for name, df in (append or {}).items():
            old = tables.get(name, {"schema": df.schema.jsonValue(), "folders": []})
            if [(f["name"], f["type"]) for f in old["schema"]["fields"]] != [(f["name"], f["type"]) for f in df.schema.jsonValue()["fields"]]:
                raise ValueError(f"{name} has other columns")
            tables[name] = {"schema": old["schema"], "folders": [*old["folders"], self._stored(df)]}
        return self._publish(Manifest(base.number + 1, tables, {**base.properties, **(properties or {})}, note))

    def _publish(self, new: Manifest) -> int:
        fs, at = self._fs()
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(new.__dict__),)], "value string").coalesce(1).write.text(aside)
        fs.mkdirs(at(f"{self.path}/manifests"))
        target = at(f"{self.path}/manifests/v{new.number}")
        # a rename onto a folder would move into it, so it is looked for before and after
        if fs.exists(target) or not fs.rename(at(aside), target) or fs.exists(at(f"{self.path}/manifests/v{new.number}/{aside.rpartition('/')[2]}")):
            raise Conflict(f"version {new.number} was committed by another writer")
        return new.number

    def compact(self, table: str, files: int) -> int:
        """The table's rows in so many files, as a new version; older versions keep theirs."""
        base = self.manifest()
        return self.commit(replace={table: self.read(table, base.number).repartition(files)}, note=f"compact {table}", base=base)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions but the last so many, and folders that none of these lists; returns how many folders went. No writer may be at work."""
        fs, at = self._fs()
        known = self.numbers()
        kept = [self.manifest(n) for n in known[-keep:]] if keep > 0 else []
        live = {f for m in kept for t in m.tables.values() for f in t["folders"]}
        for n in known[: len(known) - len(kept)]:
            fs.delete(at(f"{self.path}/manifests/v{n}"), True)
        data = at(f"{self.path}/data")
        dead = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in live] if fs.exists(data) else []
        for p in dead:
            fs.delete(p, True)
        fs.delete(at(f"{self.path}/aside"), True)
        return len(dead)


# --- two tiers of vectors: vec_id, file_path, chunk_index, v; stale: vec_id ------------


def rebuild_tiers(store: Versions, vectors: DataFrame) -> int:
    """A new major tier of all the vectors; the minor tier and the stale ids start empty."""
    return store.commit(replace={"major": vectors, "minor": vectors.limit(0), "stale": vectors.limit(0).select("vec_id")}, note="rebuild")


def add_to_tiers(store: Versions, new: DataFrame) -> int:
    """New vectors into the minor tier; those of the same files leave it, and in the major tier they become stale."""
    base = store.manifest()
    major, minor = (store.read(t, base.number) for t in ("major", "minor"))
    files = new.select("file_path").distinct()
    left = minor.join(files, "file_path", "left_anti").select(*minor.columns).unionByName(new)
    stale = major.join(files, "file_path", "left_semi").select("vec_id").join(store.read("stale", base.number), "vec_id", "left_anti")
    return store.commit(replace={"minor": left}, append={"stale": stale}, note="add", base=base)


def compact_tiers(store: Versions, files: int = 8) -> int:
    """The minor tier's vectors join the major tier; stale ids stay, as ids are never used again."""
    base = store.manifest()
    major, minor = (store.read(t, base.number) for t in ("major", "minor"))
    return store.commit(replace={"major": major.unionByName(minor).repartition(files), "minor": minor.limit(0)}, note="compact", base=base)


def live_vectors(store: Versions, version: int | None = None) -> DataFrame:
    """Vectors of both tiers that are not stale in the major one."""
    number = store.manifest(version).number
    major, minor, stale = (store.read(t, number) for t in ("major", "minor", "stale"))
    return major.join(stale, "vec_id", "left_anti").select(*minor.columns).unionByName(minor)


# --- rows that changed since the last run ----------------------------------------------


def take_changed(store: Versions, table: str, rows: DataFrame, key: str, updated: str, created: str, lag: str = "0 seconds") -> DataFrame:
    """The rows whose `updated` lies after the table's high-water mark, by `created`; they replace their keys' rows in the table, and the mark moves with them in one commit.

    rows may be any source; the comparison is a plain filter, which sources can push down. A row that turns up later with a time at or before the mark is missed, unless it lies
    within `lag` before it: so much is read again, and rows that are already in the table as they are don't count as changed. Rows with a null time are never taken; of
    several rows of a key the last by `updated` counts.
    """
    base = store.manifest()
    mark = base.properties.get(f"{table}.mark")
    fresh = rows.where(F.col(updated).isNotNull())
    if mark is not None:
        fresh = fresh.where(F.col(updated) > F.lit(mark).cast(rows.schema[updated].dataType) - F.expr(f"interval {lag}"))
    others = [c for c in rows.columns if c not in (key, updated)]
    last = fresh.groupBy(key).agg(F.max(F.struct(updated, *others)).alias("r")).select(key, "r.*").select(*rows.columns)
    if table in base.tables:
        have = store.read(table, base.number)
        same = have.select(*[F.col(c).alias(f"__{c}") for c in have.columns])
        last = last.join(same, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in have.columns], "left_anti")
    name = f"{table}.changed"
    number = store.commit(replace={name: last}, base=base, note=f"changes of {table}")
    changed, staged = store.read(name, number), store.manifest(number)
    high = changed.agg(F.max(updated).cast("string")).first()[0]
    if high is not None:
        kept = store.read(table, number).join(changed.select(key), key, "left_anti").select(*rows.columns).unionByName(changed) if table in staged.tables else changed
        high = high if mark is None else max(high, mark)  # times as text of one form sort as times do
        store.commit(replace={table: kept}, properties={f"{table}.mark": high}, base=staged, note=f"{table} up to {high}")
    return changed.orderBy(created, key)
