"""Versioned tables: immutable folders, named by one manifest per version.

A table is a folder with
  `data/commit=<id>/<partition>=<value>/*.parquet`   written once, never changed
  `_manifests/<version>.json`                        which folders make up that version
  `_backups/<date>.json`                             a manifest kept under a date (A8), by reference

A writer puts its rows under a new commit id, checks them, and publishes by creating the next manifest,
which fails if another writer has created it meanwhile. Readers resolve the newest manifest (or a
named version or backup) and read exactly its folders, so a job killed at any point before the
publish changes nothing for them, and a reader's files never change under it.

Every commit carries (source, batch). A pair that is already in the manifest is not committed again:
replays are harmless, and different sources can use the same batch numbers.

Manifests hold one entry per partition folder and one per commit; rows never pass the driver.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark's folder name for a NULL partition value
NULL_PART = "__HIVE_DEFAULT_PARTITION__"
COMMIT = "commit"
#: ids are text of hashed digits, which only an entropy coder shortens
CODEC = "zstd"


class Conflict(RuntimeError):
    """Another writer changed the same partitions first; nothing was published."""


class Damaged(RuntimeError):
    """Written rows don't read back in full; nothing was published."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    schema: str | None = None  # JSON of the rows' schema
    parts: dict[str, list[str]] = field(default_factory=dict)  # partition value -> folders, oldest first
    rows: dict[str, int] = field(default_factory=dict)  # folder -> rows
    commits: dict[str, int] = field(default_factory=dict)  # "[source, batch]" -> version that holds it

    @property
    def folders(self) -> list[str]:
        return [f for p in sorted(self.parts) for f in self.parts[p]]

    @property
    def count(self) -> int:
        return sum(self.rows[f] for f in self.folders)

    def has(self, source: str, batch: object) -> bool:
        return commit_key(source, batch) in self.commits


def commit_key(source: str, batch: object) -> str:
    return json.dumps([source, str(batch)])


def part_name(value: object) -> str:
    """Folder name of a partition value (dates and integers; NULL has its own)."""
    return NULL_PART if value is None else value.isoformat() if isinstance(value, dt.date) else str(value)


class Files:
    """The few operations on the shared file system that a manifest needs, through Spark's own access to it."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(base).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def age_seconds(self, folder: str) -> float:
        now = self._jvm.java.lang.System.currentTimeMillis()
        return (now - self._fs.getFileStatus(self._path(folder)).getModificationTime()) / 1000

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str, overwrite: bool = False) -> bool:
        """Put a whole file in place at once; False if it exists already (unless `overwrite`).

        The text is written beside it and renamed, which the file system does as one step."""
        draft = f"{path.rsplit('/', 1)[0]}/.draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft))
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if overwrite else kind.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(self._path(draft)), self._fs.makeQualified(self._path(path)), how)
        except Py4JJavaError as e:
            self._fs.delete(self._path(draft), False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)


class Table:
    """A versioned table at `path`, in folders by the column `partition` (a date or an integer).

    One folder per partition and commit: choose a column with few values per batch (a month, a hash
    bucket). Without a partition column all rows of a commit lie in one folder."""

    def __init__(self, spark: SparkSession, path: str, partition: str | None = None):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self.files = Files(spark, self.path)

    # ---- reading ----------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/_manifests") if n.endswith(".json") and n[0] != "."]

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest version's manifest, or a named one's; version 0 is the empty table."""
        if version is None:
            version = max(self.versions(), default=0)
        return self._load(f"{self.path}/_manifests/{version:012d}.json") if version else Manifest()

    def _load(self, path: str) -> Manifest:
        return Manifest(**json.loads(self.files.read(path)))

    def read(self, parts: Iterable[object] | None = None, version: int | None = None, backup: dt.date | None = None) -> DataFrame:
        """Rows of the newest version (or of a version or backup); with `parts` only of these partition
        values - other folders are not even listed."""
        m = self._load(self._backup_path(backup)) if backup else self.manifest(version)
        return self.rows_of(m, parts)

    def rows_of(self, m: Manifest, parts: Iterable[object] | None = None) -> DataFrame:
        if m.schema is None:
            raise ValueError(f"{self.path} has no version yet")
        names = sorted(m.parts) if parts is None else sorted({part_name(p) for p in parts} & set(m.parts))
        return self._scan([f for n in names for f in m.parts[n]], T.StructType.fromJson(json.loads(m.schema)))

    def _scan(self, folders: list[str], schema: T.StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/{f}" for f in folders])
        return df.select(*schema.fieldNames())

    def changes(self, since: int, until: Manifest) -> tuple[DataFrame, list[str]]:
        """What versions after `since` up to `until` changed, as rows with a `sign`: 1 for rows of folders
        that came, -1 for rows of folders that went; and the partitions concerned. A rewritten partition gives its
        old rows and its new ones, so any sum over signs is exact. The folders of both versions must
        still exist (`vacuum` keeps the last ones)."""
        old = self.manifest(since)
        names = sorted(n for n in {**old.parts, **until.parts} if old.parts.get(n) != until.parts.get(n))
        before, after = ({f for n in names for f in m.parts.get(n, [])} for m in (old, until))
        schema = T.StructType.fromJson(json.loads(until.schema))
        came = self._scan(sorted(after - before), schema).withColumn("sign", F.lit(1))
        went = self._scan(sorted(before - after), schema).withColumn("sign", F.lit(-1))
        return came.unionByName(went), names

    # ---- writing ----------------------------------------------------------------------------

    def append(self, df: DataFrame, source: str, batch: object, base: Manifest | None = None) -> Manifest:
        """Add the rows of (source, batch); a pair that is committed already changes nothing.
        Appends of other writers don't conflict, unless `base` says from which state `df` was computed
        and one of its own partitions has changed since."""
        m = self.manifest()
        if m.has(source, batch):
            return m
        return self.add(self.write(df), source, batch, base)

    def add(self, written: Manifest, source: str, batch: object, base: Manifest | None = None) -> Manifest:
        """`append` of rows that `write` has put in place."""

        def changed(now: Manifest) -> dict[str, list[str]]:
            if base is not None:
                self._same(now, base, written.parts)
            return _merged(now.parts, written.parts)

        return self._publish(source, batch, written, changed)

    def replace(self, df: DataFrame, parts: Iterable[object], source: str, batch: object, base: Manifest) -> Manifest:
        """Let the partitions `parts` consist of the rows of `df` alone; all other partitions keep their
        folders. `base` is the manifest that `df` was computed from: `Conflict` if one of `parts` has changed since."""
        if self.manifest().has(source, batch):
            return self.manifest()
        names = {part_name(p) for p in parts}
        written = self._write(df)
        if not set(written.parts) <= names:
            raise ValueError(f"rows outside the replaced partitions: {sorted(set(written.parts) - names)[:5]}")

        def changed(now: Manifest) -> dict[str, list[str]]:
            self._same(now, base, names)
            return {**{n: f for n, f in now.parts.items() if n not in names}, **written.parts}

        return self._publish(source, batch, written, changed)

    def _same(self, now: Manifest, base: Manifest, names: Iterable[str]) -> None:
        if any(now.parts.get(n) != base.parts.get(n) for n in names):
            raise Conflict(f"partitions of {self.path} changed since version {base.version}")

    def overwrite(self, df: DataFrame, source: str, batch: object, base: Manifest | None = None) -> Manifest:
        """A new version of the whole table (A7); with `base`, only if nothing was committed since."""
        if self.manifest().has(source, batch):
            return self.manifest()
        written = self._write(df)

        def changed(now: Manifest) -> dict[str, list[str]]:
            if base is not None and now.parts != base.parts:
                raise Conflict(f"{self.path} changed since version {base.version}")
            return dict(written.parts)

        return self._publish(source, batch, written, changed)

    def compact(self, parts: Iterable[object]) -> Manifest:
        """Rewrite partitions that many commits have added to as one folder each; same rows."""
        base, values = self.manifest(), list(parts)
        return self.replace(self.rows_of(base, values), values, "compact", uuid.uuid4().hex, base)

    def write(self, df: DataFrame) -> Manifest:
        """Rows that no version holds yet: `add` publishes them, `rows_of` reads them."""
        return self._write(df)

    def _write(self, df: DataFrame) -> Manifest:
        """Rows under a new commit id, counted while written and again when read back."""
        seen = Observation()
        root = f"data/{COMMIT}={self._commit_id()}"
        self._save(df.observe(seen, F.count(F.lit(1)).alias("n")), root)
        if self.partition:
            found = {n.split("=", 1)[1]: [f"{root}/{n}"] for n in self.files.names(f"{self.path}/{root}") if n.startswith(f"{self.partition}=")}
        else:
            found = {"": [root]}
        back = self._scan([f for x in found.values() for f in x], df.schema)
        per_part = back.groupBy(F.col(self.partition) if self.partition else F.lit("").alias("all")).count().collect()
        rows = {found[part_name(r[0])][0]: r["count"] for r in per_part}
        if sum(rows.values()) != seen.get["n"]:
            raise Damaged(f"{self.path}/{root}: wrote {seen.get['n']} rows, read {sum(rows.values())}")
        return Manifest(0, df.schema.json(), {n: f for n, f in found.items() if rows.get(f[0])}, rows)

    def _commit_id(self) -> str:
        return uuid.uuid4().hex

    def _save(self, df: DataFrame, root: str) -> None:
        w = df.write.partitionBy(self.partition) if self.partition else df.write
        w.option("compression", CODEC).parquet(f"{self.path}/{root}")

    def _publish(self, source: str, batch: object, written: Manifest, parts: Callable[[Manifest], dict]) -> Manifest:
        while True:
            now = self.manifest()
            if now.has(source, batch):
                return now
            if now.schema is not None and T.StructType.fromJson(json.loads(now.schema)).simpleString() != T.StructType.fromJson(json.loads(written.schema)).simpleString():
                raise ValueError(f"{self.path} holds other columns than the new rows")
            new_parts = parts(now)
            known = {**now.rows, **written.rows}
            new = Manifest(now.version + 1, written.schema, new_parts, {f: known[f] for x in new_parts.values() for f in x},
                           {**now.commits, commit_key(source, batch): now.version + 1})
            if self._put(new, f"{self.path}/_manifests/{new.version:012d}.json"):
                return new

    def _put(self, m: Manifest, path: str, overwrite: bool = False) -> bool:
        return self.files.create(path, json.dumps(m.__dict__), overwrite)

    # ---- backups and cleaning -----------------------------------------------------------------

    def _backup_path(self, date: dt.date) -> str:
        return f"{self.path}/_backups/{date.isoformat()}.json"

    def backup(self, date: dt.date) -> bool:
        """Keep the current version under a date, replacing the same day's; no row is copied, as the
        folders that it names never change. An empty table is skipped (False)."""
        m = self.manifest()
        return m.count > 0 and self._put(m, self._backup_path(date), overwrite=True)

    def backups(self) -> list[dt.date]:
        return [dt.date.fromisoformat(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/_backups") if n[0] != "."]

    def restore(self, backup: dt.date | None = None, version: int | None = None) -> Manifest:
        """Publish an earlier state as the newest version; commits made since stay known."""
        old = self._load(self._backup_path(backup)) if backup else self.manifest(version)
        while True:
            now = self.manifest()
            new = replace(old, version=now.version + 1, commits={**now.commits, **old.commits})
            if self._put(new, f"{self.path}/_manifests/{new.version:012d}.json"):
                return new

    def vacuum(self, keep: int = 10, min_age_seconds: float = 7 * 86400) -> list[str]:
        """Delete manifests before the last `keep` versions, and commits that neither the others nor a
        backup name; folders younger than `min_age_seconds` may belong to a running writer and stay. Returns
        the deleted commits."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]] + [self._load(self._backup_path(d)) for d in self.backups()]
        used = {f.split("/")[1] for m in kept for f in m.folders}
        gone = []
        for n in self.files.names(f"{self.path}/data"):
            if n.startswith(f"{COMMIT}=") and n not in used and self.files.age_seconds(f"{self.path}/data/{n}") >= min_age_seconds:
                self.files.delete(f"{self.path}/data/{n}")
                gone.append(n)
        for v in versions[:-keep]:
            self.files.delete(f"{self.path}/_manifests/{v:012d}.json")
        return gone


class Clustered(Table):
    """A partitioned table whose rows Spark also deals into `buckets` by `columns` within each folder: read `in_place`, they
    meet others by these columns, or are grouped by them, without an exchange. To all other readers
    it is a table like any other. A commit's id ends with its number of buckets; commits of another
    number, or of none, are read as plain folders."""

    def __init__(self, spark: SparkSession, path: str, partition: str, columns: Sequence[str], buckets: int):
        super().__init__(spark, path, partition)
        self.columns, self.buckets = list(columns), buckets

    def _commit_id(self) -> str:
        return f"{uuid.uuid4().hex}-{self.buckets}"

    def _save(self, df: DataFrame, root: str) -> None:
        name = f"clustered_{uuid.uuid4().hex}"
        w = df.write.partitionBy(self.partition).bucketBy(self.buckets, *self.columns).format("parquet")
        w.option("compression", CODEC).option("path", f"{self.path}/{root}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # external: the files stay

    @contextlib.contextmanager
    def in_place(self, folders: list[str], schema: T.StructType) -> Iterator[DataFrame]:
        """The rows of `folders` with their commit, as `COMMIT`, in place of the partition column. The frame holds as long
        as the context: Spark knows buckets of catalog tables only, and the entry goes with it."""
        fields = [f for f in schema.fields if f.name != self.partition]
        commits = {f: f.split("/")[1].split("=", 1)[1] for f in folders}
        if not folders or any(not c.endswith(f"-{self.buckets}") for c in commits.values()):
            parts = [self._scan([f for f in folders if commits[f] == c], schema).withColumn(COMMIT, F.lit(c)) for c in sorted({*commits.values()})]
            parts = parts or [self._scan([], schema).withColumn(COMMIT, F.lit(""))]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            yield out.select(*[f.name for f in fields], COMMIT)
            return
        name = f"clustered_{uuid.uuid4().hex}"
        cols, by = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), ", ".join(f"`{c}`" for c in self.columns)
        self.spark.sql(f"CREATE TABLE {name} ({cols}, `{COMMIT}` STRING, `_folder` STRING) USING parquet OPTIONS (path '{self.path}/data') "
                       f"PARTITIONED BY (`{COMMIT}`, `_folder`) CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS")
        try:
            parts = " ".join(f"PARTITION (`{COMMIT}`='{commits[f]}', `_folder`='{i}') LOCATION '{self.path}/{f}'" for i, f in enumerate(folders))
            self.spark.sql(f"ALTER TABLE {name} ADD {parts}")
            yield self.spark.table(name).select(*[f.name for f in fields], COMMIT)
        finally:
            self.spark.sql(f"DROP TABLE {name}")


def _merged(old: dict[str, list[str]], new: dict[str, list[str]]) -> dict[str, list[str]]:
    return {n: [*old.get(n, []), *new.get(n, [])] for n in {**old, **new}}


def part_value(name: str) -> dt.date | int | None:
    """The partition value of a folder name."""
    return None if name == NULL_PART else dt.date.fromisoformat(name) if "-" in name[1:] else int(name)


class Follower:
    """A table kept in step with another one from that one's manifest differences.

    Either `fold(rows, changes)` gets the follower's rows of the partitions concerned (both tables have the
    same partitions) and the signed changes, and returns those partitions' new rows; or `delta(changes, before)`
    returns rows to append, `before` being the followed table as it was (None: empty). Each step is one commit
    named by the version it reaches: a step that was killed is done again, one that was done isn't repeated."""

    SOURCE = "follows"

    def __init__(self, of: Table, table: Table, fold: Callable[[DataFrame | None, DataFrame], DataFrame] | None = None,
                 delta: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None):
        self.of, self.table, self.fold, self.delta = of, table, fold, delta

    def reached(self) -> int:
        return max((int(json.loads(k)[1]) for k in self.table.manifest().commits if json.loads(k)[0] == self.SOURCE), default=0)

    def catch_up(self) -> Manifest:
        """Apply all versions of the followed table that are not in yet, in one step."""
        base, until, since = self.table.manifest(), self.of.manifest(), self.reached()
        if until.version <= since:
            return base
        changed, names = self.of.changes(since, until)
        if self.fold is None:
            return self.table.append(self.delta(changed, self.of.read(version=since) if since else None), self.SOURCE, until.version, base)
        values = [part_value(n) for n in names]
        old = self.table.rows_of(base, values) if base.schema is not None else None
        return self.table.replace(self.fold(old, changed), values, self.SOURCE, until.version, base)


def month_table(spark: SparkSession, path: str) -> Table:
    """A table in folders by `month`."""
    return Table(spark, path, "month")
