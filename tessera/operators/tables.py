"""Versioned tables on Parquet: immutable data directories and one manifest per version.

A manifest names the data directories of a version and its columns. Committing
writes the manifest of the next version under a temporary name and renames it to
one that must not exist yet, through the Hadoop file system of the path, so no
reader sees half a manifest and two writers cannot both make the same version;
the loser reads the new head and retries. Data files are never changed, so older
versions stay readable. Deletes and upserts rewrite only the data directories
that hold rows they touch.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RETRIES = 3
#: Seconds for which a request id is remembered.
REQUEST_TTL = 300
#: Bytes of a file that compaction aims at.
FILE_BYTES = 128 << 20


class Conflict(RuntimeError):
    """Another writer made the version that was to be committed."""


class StaleRead(RuntimeError):
    """The table has not reached the version that the reader asks for."""


@dataclass
class Manifest:
    version: int
    schema: str
    schema_version: int
    #: Data directories, each with the names its columns had when it was written, by their present name.
    parts: list[dict] = field(default_factory=list)
    parent: int | None = None
    requests: dict[str, dict] = field(default_factory=dict)
    operation: str = "create"


@dataclass
class Commit:
    """What a write did."""

    affected: int
    version: int


class _Files:
    """The few file operations that manifests need, on any file system Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.gateway = spark.sparkContext._gateway
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str, overwrite: bool = False) -> bool:
        """Write a file, whole or not at all; False if it is there and may not be overwritten."""
        at = name.rfind("/")
        draft = f"{name[:at]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        modes = self.jvm.org.apache.hadoop.fs.Options.Rename
        mode = self.gateway.new_array(modes, 1)
        mode[0] = modes.OVERWRITE if overwrite else modes.NONE
        try:
            self.context.rename(self.path(draft), self.path(name), mode)
        except Exception as e:
            self.fs.delete(self.path(draft), False)
            if "exist" in str(e).lower() and not overwrite:
                return False
            raise
        return True

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()

    def names(self, directory: str) -> list[str]:
        at = self.path(directory)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class VersionedTable:
    """A table with append, upsert, delete, schema changes, tags and restore."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = _Files(spark, self.path)
        if not self.versions():
            raise ValueError(f"no table at {path}")

    # -- creation and metadata

    @staticmethod
    def create(df: DataFrame, path: str, partitions: int | None = None, on_columns: Sequence[str] = ()) -> VersionedTable:
        """A new table with the rows of ``df``; fails if one exists or ``df`` has no columns."""
        if not df.columns:
            raise ValueError("a table needs columns")
        spark, path = df.sparkSession, path.rstrip("/")
        files = _Files(spark, path)
        if files.names(f"{path}/_manifest"):
            raise ValueError(f"a table exists at {path}")
        rows = df.repartition(partitions, *on_columns) if partitions and on_columns else df.repartition(partitions) if partitions else df
        part = _write(rows, path)
        manifest = Manifest(1, df.schema.json(), 1, [part])
        if not files.create(f"{path}/_manifest/v1.json", json.dumps(asdict(manifest))):
            files.delete(f"{path}/{part['dir']}")
            raise ValueError(f"a table exists at {path}")
        return VersionedTable(spark, path)

    @staticmethod
    def list(spark: SparkSession, root: str, namespace: str = "") -> list[str]:
        """Names of the tables below ``root``, optionally of one namespace (``ns__table`` directories)."""
        files = _Files(spark, root)
        prefix = f"{namespace}__" if namespace else ""
        return sorted(n for n in files.names(root) if n.startswith(prefix) and files.names(f"{root}/{n}/_manifest"))

    def versions(self) -> list[int]:
        names = self.files.names(f"{self.path}/_manifest")
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | str | None = None) -> Manifest:
        """The manifest of a version or tag, of the head by default."""
        if isinstance(version, str):
            tags = self.tags()
            if version not in tags:
                raise ValueError(f"no tag {version!r}")
            version = tags[version]
        version = version or self.versions()[-1]
        try:
            return Manifest(**json.loads(self.files.read(f"{self.path}/_manifest/v{version}.json")))
        except Exception as e:
            raise ValueError(f"no version {version}") from e

    def schema(self, version: int | str | None = None) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.manifest(version).schema))

    # -- reading

    def read(self, version: int | str | None = None, *, min_version: int = 0, min_schema_version: int = 0) -> DataFrame:
        """The rows of a version. The guards raise StaleRead if the head is older than the reader requires."""
        manifest = self.manifest(version)
        if manifest.version < min_version or manifest.schema_version < min_schema_version:
            raise StaleRead(f"version {manifest.version}, schema version {manifest.schema_version}")
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        found = None
        for part in manifest.parts:
            rows = self._rows(part, schema)
            found = rows if found is None else found.unionAll(rows)
        return found if found is not None else self.spark.createDataFrame([], schema)

    def _rows(self, part: dict, schema: T.StructType) -> DataFrame:
        """The rows of a data directory under the present names."""
        rows = self.spark.read.parquet(f"{self.path}/{part['dir']}")
        have = set(rows.columns)

        def column(f: T.StructField):
            name = part["names"].get(f.name, f.name)
            return (F.col(f"`{name}`") if name in have and f.name not in part.get("nulls", ()) else F.lit(None)).cast(f.dataType).alias(f.name)

        return rows.select(*[column(f) for f in schema])

    def _without(self, head: Manifest, hit: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame]) -> tuple[list[dict], int]:
        """(parts, removed rows): directories without a hit stay as they are, those that are all hits go, the others are rewritten."""
        schema = T.StructType.fromJson(json.loads(head.schema))
        parts, removed = [], 0
        for part in head.parts:
            rows = self._rows(part, schema)
            n = hit(rows).count()  # the predicate reaches the scan, so files without a hit are skipped by their statistics
            removed += n
            if not n:
                parts.append(part)
            elif n < part["rows"]:
                parts.append(_write(rest(rows), self.path))
        return parts, removed

    def count(self, filter: str | None = None) -> int:
        rows = self.read()
        return (rows.where(filter) if filter else rows).count()

    # -- writing

    def _commit(self, change: Callable[[Manifest], tuple[Manifest, int]], request_id: str | None = None) -> Commit:
        """Apply ``change`` to the head until its result is the next version."""
        for _ in range(RETRIES + 1):
            head = self.manifest()
            now = time.time()
            live = {k: v for k, v in head.requests.items() if now - v["at"] <= REQUEST_TTL}
            if request_id and request_id in live:
                return Commit(live[request_id]["affected"], live[request_id]["version"])
            new, affected = change(head)
            new.version, new.parent = head.version + 1, head.version
            new.requests = live
            if request_id:
                new.requests[request_id] = {"affected": affected, "version": new.version, "at": now}
            if self.files.create(f"{self.path}/_manifest/v{new.version}.json", json.dumps(asdict(new))):
                return Commit(affected, new.version)
        raise Conflict(f"{RETRIES} retries failed")

    def append(self, df: DataFrame, request_id: str | None = None, partition_by: Sequence[str] = ()) -> Commit:
        """Add rows. A request id that has been seen returns its first result and adds nothing."""
        schema = self.schema()
        rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        rows = rows.repartition(*partition_by) if partition_by else rows

        def change(head: Manifest) -> tuple[Manifest, int]:
            part = _write(rows, self.path)
            return _next(head, "append", parts=[*head.parts, part]), part["rows"]

        return self._commit(change, request_id)

    def delete(self, filter: str, request_id: str | None = None) -> Commit:
        """Remove rows for which the predicate is true; rows for which it is null stay."""
        if not filter:
            raise ValueError("a filter is required")

        def change(head: Manifest) -> tuple[Manifest, int]:
            parts, removed = self._without(head, lambda rows: rows.where(filter), lambda rows: rows.where(~F.coalesce(F.expr(filter), F.lit(False))))
            return _next(head, "delete", parts=parts), removed

        return self._commit(change, request_id)

    def upsert(self, df: DataFrame, on_columns: Sequence[str], request_id: str | None = None) -> Commit:
        """Replace rows that match on ``on_columns``, add the others. Duplicate keys in ``df`` are refused."""
        if not on_columns:
            raise ValueError("upsert needs key columns")
        if df.groupBy(*on_columns).count().where("count > 1").limit(1).count():
            raise ValueError("the source has duplicate keys")
        schema = self.schema()
        source = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

        def change(head: Manifest) -> tuple[Manifest, int]:
            keys, on = source.select(*on_columns), list(on_columns)
            parts, _ = self._without(head, lambda rows: rows.join(keys, on, "left_semi"), lambda rows: rows.join(keys, on, "left_anti").select(*schema.names))
            new = _write(source, self.path)
            return _next(head, "upsert", parts=[*parts, new]), new["rows"]

        return self._commit(change, request_id)

    def alter(self, *, add: Sequence[tuple[str, str]] = (), drop: Sequence[str] = (), rename: dict[str, str] | None = None, expected_schema_version: int | None = None) -> int:
        """Add nullable columns, drop and rename columns, in that order; returns the schema version.

        Only the manifest changes. Additions and drops that are in place already,
        and renames that have happened, are no errors; renaming what is not there is.
        """
        rename = rename or {}
        if not (add or drop or rename):
            raise ValueError("nothing to alter")

        def change(head: Manifest) -> tuple[Manifest, int]:
            if expected_schema_version is not None and head.schema_version != expected_schema_version:
                raise Conflict(f"schema version is {head.schema_version}")
            schema = T.StructType.fromJson(json.loads(head.schema))
            parts = [p | {"names": dict(p["names"]), "nulls": list(p.get("nulls", ()))} for p in head.parts]
            fields = list(schema.fields)
            for name, kind in add:
                if name not in [f.name for f in fields]:
                    fields.append(T.StructField(name, T._parse_datatype_string(kind), True))
                    for p in parts:  # a file may still hold a dropped column of that name
                        p["nulls"].append(name)
            fields = [f for f in fields if f.name not in set(drop)]
            for old, new in rename.items():
                names = [f.name for f in fields]
                if old not in names:
                    if new in names:
                        continue
                    raise ValueError(f"no column {old!r}")
                fields[names.index(old)] = T.StructField(new, fields[names.index(old)].dataType, True)
                for p in parts:
                    p["names"][new] = p["names"].pop(old, old)
                    p["nulls"] = [new if x == old else x for x in p["nulls"]]
            new = _next(head, "alter", parts=parts)
            new.schema, new.schema_version = T.StructType(fields).json(), head.schema_version + 1
            return new, 0

        return self.manifest(self._commit(change).version).schema_version

    def compact(self, files: int | None = None) -> Commit:
        """Rewrite the head into ``files`` files, by default of about FILE_BYTES each."""

        def change(head: Manifest) -> tuple[Manifest, int]:
            size = sum(self.files.size(f"{self.path}/{p['dir']}") for p in head.parts)
            count = files or max(1, -(-size // FILE_BYTES))
            return _next(head, "compact", parts=[_write(self.read(head.version).repartition(count), self.path)]), 0

        return self._commit(change)

    # -- tags, restore, removal

    def tags(self) -> dict[str, int]:
        names = self.files.names(f"{self.path}/_tags")
        return {n: int(self.files.read(f"{self.path}/_tags/{n}")) for n in names if not n.startswith(".")}

    def tag(self, name: str, version: int = 0) -> None:
        """Name a version, the head for 0."""
        at = self.manifest(version or None).version
        if not self.files.create(f"{self.path}/_tags/{name}", str(at)):
            raise ValueError(f"tag {name!r} exists")

    def untag(self, name: str) -> None:
        if name not in self.tags():
            raise ValueError(f"no tag {name!r}")
        self.files.delete(f"{self.path}/_tags/{name}")

    def restore(self, version: int | None = None, tag: str | None = None) -> Commit:
        """Make an earlier version the head again, as a new version."""
        if (version is None) == (tag is None):
            raise ValueError("give a version or a tag")
        old = self.manifest(version if version is not None else tag)

        def change(head: Manifest) -> tuple[Manifest, int]:
            new = _next(head, "restore", parts=old.parts)
            new.schema, new.schema_version = old.schema, head.schema_version + (old.schema != head.schema)
            return new, 0

        return self._commit(change)

    def drop(self) -> None:
        self.files.delete(self.path)

    def vacuum(self, older_than_seconds: float = 7 * 86400) -> list[str]:
        """Delete data directories of an age that no version names, as failed writes leave."""
        named = {p["dir"] for v in self.versions() for p in self.manifest(v).parts}
        gone = []
        for status in self.files.fs.listStatus(self.files.path(f"{self.path}/data")):
            name = f"data/{status.getPath().getName()}"
            if name not in named and status.getModificationTime() / 1000 < time.time() - older_than_seconds:
                self.files.delete(f"{self.path}/{name}")
                gone.append(name)
        return gone


def _next(head: Manifest, operation: str, parts: list[dict]) -> Manifest:
    return Manifest(head.version + 1, head.schema, head.schema_version, parts, head.version, {}, operation)


def _write(df: DataFrame, path: str) -> dict:
    """Write rows to a new data directory; the row count comes with the write."""
    from pyspark.sql import Observation

    name = f"data/{uuid.uuid4().hex}"
    seen = Observation()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/{name}")
    except Exception:
        _Files(df.sparkSession, path).delete(f"{path}/{name}")
        raise
    return {"dir": name, "rows": seen.get["rows"], "names": {}, "nulls": []}
