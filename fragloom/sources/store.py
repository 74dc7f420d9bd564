"""The fragment store: immutable writes of Parquet, a record of each version, and a pointer to the version that counts.
[A7-A10, A16-A19, E13]

data/w=<write>/                   rows, sorted by file, written once and never changed; writes of before have a folder cst_file=<file> for each file
files/<write>/                    of a version: the files it has and the write that holds each
v=<n>.json                        of a version: its schema, its files table, its writes, whether these hold nothing else, the last batch of each stream
CURRENT-<n>.json                  the pointers; the largest counts

A writer prepares rows beside what counts, has them checked, and commits: a version takes over the files it did not write. Records and
pointers are renamed to names that must not be there, so of two writers that began at the same version one gets a Conflict, and readers see
the old or the new version whenever a writer stops. What readers have opened does not change under them.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fragloom import schema
from fragloom.functions import codes as cd

POINTER, RECORD = "CURRENT-{}.json", "v={}.json"
KEPT = 5
#: Writes of a version from which the next one puts all files into one write.
COMPACT = 32
#: Rows of a files table up to which it is broadcast.
BROADCAST_FILES = 200_000
#: The form of the rows that this code writes. 1: frag_idx, a whole number; 2: frag_idx_code.
SCHEMA = 2


class Conflict(OSError):
    """Another writer has committed since."""


@dataclass
class Pending:
    """Rows that are written and do not count yet."""

    write: str
    rows: DataFrame
    base: dict | None


class FragmentStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FragmentStore:
        """[A7] The store, its rows brought to the form SCHEMA: pending migrations run, one after another, into a new version."""
        store = cls(spark, path)
        if store.exists() and store.schema_number() != SCHEMA:
            store.migrate()
        return store

    # -- files

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []

    def _numbers(self, form: str) -> list[int]:
        """Numbers of names of a form, whatever stands behind the number."""
        pattern = re.escape(form.format("#").removesuffix(".json")).replace(r"\#", r"(\d+)") + r"(\.json)?$"
        return sorted({int(m[1]) for n in self._names() if (m := re.match(pattern, n))})

    def _read_json(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()["value"])

    def _create(self, name: str, value: dict) -> None:
        """A file that must not be there, whole or not at all."""
        jvm, beside = self.spark._jvm, self._at(f".{name}-{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri() if beside.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(beside), self._fs.makeQualified(self._at(name)), options)
        except Exception as e:
            self._fs.delete(beside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{name} is there already: another writer") from e
            raise

    # -- versions

    def pointer(self) -> dict | None:
        """The record of the version that counts, with the number of the pointer."""
        known = self._numbers(POINTER)
        if not known:
            return None
        record = self._read_json(POINTER.format(known[-1]))
        return {"schema": None, "files": None, "writes": [], "applied": {}} | record | {"pointer": known[-1]}

    def version(self) -> int:
        return (self.pointer() or {"version": 0})["version"]

    def _point(self, record: dict, base: dict | None) -> None:
        """[A16] The pointer after that of base; the KEPT last ones stay."""
        number = base["pointer"] + 1 if base else 1
        self._create(POINTER.format(number), {k: v for k, v in record.items() if k != "pointer"})
        for old in self._numbers(POINTER)[:-KEPT]:
            self._fs.delete(self._at(POINTER.format(old)), False)

    def exists(self) -> bool:
        return self.version() > 0

    def _record(self, version: int | None) -> dict | None:
        now = self.pointer()
        if version is None or now and now["version"] == version:
            return now
        if self._fs.exists(self._at(RECORD.format(version))):
            return {"applied": {}} | self._read_json(RECORD.format(version))
        return {"version": version, "schema": None, "files": None, "writes": [], "applied": {}}  # a folder of the first layout

    def _rows(self, record: dict) -> DataFrame:
        """The rows of a version as they were written."""
        if record["files"] is None:
            return self.spark.read.parquet(f"{self.path}/v={record['version']}")
        if not record["writes"]:
            return self.spark.createDataFrame([], schema.FRAGMENT)
        form = T.StructType([*(schema.FRAGMENT if record["schema"] == SCHEMA else self._first_schema(record)), T.StructField("w", T.StringType())])
        by_file = [w for w in record["writes"] if self._has_folders(w)]
        read = lambda writes: self.spark.read.schema(form).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/w={w}" for w in writes)).select(*form.names)
        parts = [read(writes) for writes in (by_file, [w for w in record["writes"] if w not in by_file]) if writes]
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if record.get("whole"):
            return rows.drop("w")
        return rows.join(self._marked(record), ["cst_file", "w"], "left_semi").drop("w")

    def _has_folders(self, write: str) -> bool:
        """Whether a write has a folder for each file, as those of before have. Only the first names are listed."""
        listed = self._fs.listStatusIterator(self._at(f"data/w={write}"))
        while listed.hasNext():
            if (name := listed.next().getPath().getName())[0] not in "._":
                return name.startswith("cst_file=")
        return False

    def _first_schema(self, record: dict) -> list:
        return [f for f in self.spark.read.parquet(f"{self.path}/data/w={record['writes'][0]}").schema if f.name != "cst_file"] + [T.StructField("cst_file", T.StringType())]

    def _files(self, record: dict | None) -> DataFrame:
        if record is None or record["files"] is None:
            none = self.spark.createDataFrame([], "cst_file string, w string")
            return none
        return self.spark.read.schema("cst_file string, w string").parquet(f"{self.path}/files/{record['files']}")

    def _marked(self, record: dict) -> DataFrame:
        files = self._files(record)
        return F.broadcast(files) if files.count() <= BROADCAST_FILES else files

    def schema_number(self, version: int | None = None) -> int:
        record = self._record(version)
        if record["schema"] is not None:
            return record["schema"]
        return 1 if "frag_idx" in self._rows(record).columns else SCHEMA

    def read(self, version: int | None = None) -> DataFrame:
        """[A7] Rows of a version, an older form brought up to SCHEMA; a store of other columns is refused."""
        return self._brought_up(self._record(version))

    def read_files(self, files: DataFrame, version: int | None = None) -> DataFrame | None:
        """The rows of files (cst_file) in a version, None if it has none of them. Only the writes that hold one of them are read, so
        what new files cost does not grow with the store."""
        record, names = self._record(version), files.select("cst_file").distinct()
        if record is not None and record["files"] is not None:
            held = self._files(record).join(names, "cst_file", "left_semi").select("w").distinct()
            record = record | {"writes": sorted(r["w"] for r in held.collect())}  # of each write its name
        if record is None or record["files"] is not None and not record["writes"]:
            return None
        return self._brought_up(record).join(names, "cst_file", "left_semi")

    def _brought_up(self, record: dict | None) -> DataFrame:
        if record is None:
            return self.spark.createDataFrame([], schema.FRAGMENT)
        rows = self._rows(record)
        rows = migrated(rows, record["schema"] or (1 if "frag_idx" in rows.columns else SCHEMA))
        if set(rows.columns) != set(schema.COLUMNS):
            raise ValueError(f"store of other columns: {sorted(set(rows.columns) ^ set(schema.COLUMNS))}")
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.FRAGMENT))

    # -- writes

    def prepare(self, rows: DataFrame, form: int = SCHEMA, base: dict | None = None) -> Pending:
        """Writes rows beside the version that counts, which is the one to be replaced unless base is given. The number of Parquet files is that of
        the tasks, not of the files in rows; rows are sorted, so that a reader of one file skips the row groups of others."""
        base = base or self.pointer()
        write = f"{(base or {'version': 0})['version'] + 1}-{uuid.uuid4().hex}"
        index = "frag_idx_code" if form == SCHEMA else "frag_idx"
        order = cd.version_order(F.col(index)) if form == SCHEMA else [F.col(index)]
        rows = rows.select(*(index if c == "frag_idx_code" else c for c in schema.COLUMNS))
        rows.repartition("cst_file").sortWithinPartitions("cst_file", *order).write.parquet(f"{self.path}/data/w={write}")
        return Pending(write, self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/w={write}"), base)

    def discard(self, pending: Pending) -> None:
        for name in (f"data/w={pending.write}", f"files/{pending.write}"):
            self._fs.delete(self._at(name), True)

    def commit(self, pending: Pending, whole: bool = False, gone: DataFrame | None = None, form: int = SCHEMA, batch: tuple[str, int] | None = None) -> int:
        """[A9, A10, A16] A new version: the files of pending, and, unless whole, all others as they were, less those in gone (cst_file). batch: of
        which stream and which number. Raises Conflict if the version that pending began with no longer counts."""
        base = pending.base
        new = pending.rows.select("cst_file").distinct().select("cst_file", F.lit(pending.write).alias("w"))
        old = self._files(base) if not whole else None
        if base is not None and base["files"] is None and not whole:
            raise ValueError("a store of the first layout: open() it first")
        if old is not None:
            old = old.join(new.select("cst_file"), "cst_file", "left_anti")
            new = new.unionByName(old.join(gone.select("cst_file"), "cst_file", "left_anti") if gone is not None else old)
        new.write.parquet(f"{self.path}/files/{pending.write}")
        version = max([0, *self._numbers(RECORD)]) + 1
        applied = dict(base["applied"] if base else {})
        if batch:
            applied[batch[0]] = batch[1]
        writes = [r["w"] for r in self._files({"files": pending.write}).select("w").distinct().collect()]  # COMPACT at most
        record = {"version": version, "schema": form, "files": pending.write, "writes": sorted(writes), "whole": whole, "applied": applied}
        self._create(RECORD.format(version), record)
        try:
            self._point(record, base)
        except Conflict:
            self._fs.delete(self._at(RECORD.format(version)), False)
            raise
        return version

    def publish(self, fragments: DataFrame) -> int:
        """[A10, A16] Writes a new version of all files and makes it the one that counts; the one before stays as a snapshot."""
        return self.commit(self.prepare(fragments), whole=True)

    def replace_files(self, fragments: DataFrame, gone: DataFrame | None = None) -> int:
        """[A9] A new version in which all rows of the files in fragments are replaced and the files in gone are gone; other files stay."""
        base = self.pointer()
        if base and len(base["writes"]) >= COMPACT:
            stays = self.read().join(fragments.select("cst_file").distinct(), "cst_file", "left_anti")
            stays = stays.join(gone.select("cst_file"), "cst_file", "left_anti") if gone is not None else stays
            return self.commit(self.prepare(stays.unionByName(fragments.select(*stays.columns)), base=base), whole=True)
        return self.commit(self.prepare(fragments, base=base), whole=base is None, gone=gone)

    def edit(self, cst_file: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """A new version with one file changed: change takes its rows and returns them all."""
        return self.replace_files(change(self.read().where(F.col("cst_file") == cst_file)))

    def applied(self, stream: str) -> int:
        """The last batch of a stream that is in the version that counts, -1 without one."""
        return ((self.pointer() or {}).get("applied") or {}).get(stream, -1)

    def rollback(self, version: int) -> None:
        """The version counts again; what was written since stays."""
        self._point(self._record(version), self.pointer())

    def vacuum(self, kept: int = KEPT) -> list[str]:
        """Deletes the writes that neither the kept last versions nor the pointers need, and what stopped writers left; returns their names. Not while others
        write."""
        versions = self._numbers(RECORD)
        records = [self._record(v) for v in versions[-kept:]] + [self._read_json(POINTER.format(p)) for p in self._numbers(POINTER)]
        need = {w for r in records for w in (*r.get("writes", ()), r.get("files"))}
        lost = []
        for folder, prefix in (("data", "w="), ("files", "")):
            if self._fs.exists(self._at(folder)):
                for f in self._fs.listStatus(self._at(folder)):
                    if (name := f.getPath().getName()).removeprefix(prefix) not in need:
                        self._fs.delete(f.getPath(), True)
                        lost.append(f"{folder}/{name}")
        return lost

    # -- work tables

    def staged(self, rows: DataFrame) -> DataFrame:
        """rows, written once beside the versions and read again. unstage() deletes it."""
        path = f"{self.path}/.staged-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        out = self.spark.read.schema(rows.schema).parquet(path)
        out._staged = path
        return out

    def unstage(self, rows: DataFrame) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(vars(rows)["_staged"]), True)

    # -- migrations

    def migrate(self, to: int = SCHEMA) -> int:
        """[A7, A17, A18] A new version in another form; the one before stays."""
        record = self._record(None)
        rows, now = self._rows(record), self.schema_number()
        return self.commit(self.prepare(migrated(rows, now, to), to), whole=True, form=to)

    # -- the collections

    def structures(self) -> DataFrame:
        rows = [(n, list(k)) for n, k in schema.LEVELS.items()]
        return self.spark.createDataFrame(rows, "nikaya string, levels array<string>")

    # -- subsets

    def subset(self, files: list[str]) -> DataFrame:
        """[A19] Rows of the given files and of all files with checked or moved rows."""
        return subset(self.read(), files)


def subset(rows: DataFrame, files: list[str]) -> DataFrame:
    """[A19] Rows of the given files and of all files with checked or moved rows."""
    keep = rows.where(F.col("frag_review").isin("checked", "moved") | F.col("cst_file").isin(files)).select("cst_file").distinct()
    return rows.join(keep, "cst_file", "left_semi")


def subset_counts(rows: DataFrame, files: list[str]) -> DataFrame:
    """[E13] One row: rows and files before and after subset()."""
    is_kept: Column = F.col("frag_review").isin("checked", "moved") | F.col("cst_file").isin(files)
    each = rows.groupBy("cst_file").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(is_kept), F.lit(False)).alias("kept"))
    return each.agg(F.sum("n").alias("rows_before"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("n"))), F.lit(0).cast("long")).alias("rows_after"), F.count(F.lit(1)).alias("files_before"), F.count_if("kept").alias("files_after"))


def changed(rows: DataFrame, cst_file: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows of a store with those of one file changed: change takes its rows and returns them all."""
    return rows.where(F.col("cst_file") != cst_file).unionByName(change(rows.where(F.col("cst_file") == cst_file)))


def ignore_known(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """[A8] Rows to append: those of keys that are not there, one a key."""
    return new.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def upgraded(rows: DataFrame) -> DataFrame:
    """[A17] frag_idx to frag_idx_code."""
    return rows.withColumn("frag_idx_code", cd.legacy_index(F.col("frag_idx"))).drop("frag_idx")


def downgraded(rows: DataFrame) -> DataFrame:
    """[A18] frag_idx_code to frag_idx; inserted rows are lost."""
    return rows.withColumn("frag_idx", cd.legacy_number(F.col("frag_idx_code"))).where("frag_idx is not null").drop("frag_idx_code")


#: By the form that they lead to: up from the one before, and down to it.
MIGRATIONS = {2: (upgraded, downgraded)}


def migrated(rows: DataFrame, now: int, to: int = SCHEMA) -> DataFrame:
    """[A7] Rows of one form in another: the migrations between them, in order."""
    if not (1 <= now <= SCHEMA and 1 <= to <= SCHEMA):
        raise ValueError(f"no way from form {now} to form {to}")
    for number in range(now + 1, to + 1):
        rows = MIGRATIONS[number][0](rows)
    for number in range(now, to, -1):
        rows = MIGRATIONS[number][1](rows)
    return rows


__all__ = ["Conflict", "FragmentStore", "Pending", "changed", "downgraded", "ignore_known", "migrated", "subset", "subset_counts", "upgraded"]
