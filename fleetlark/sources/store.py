"""Stored tables: parquet files, and a log of commits that says which of them count.

A commit writes its files below ``data/commit=<id>/``, then a manifest with one row for each file added or removed (partition,
rows, least and greatest time and vehicle), and last the log entry of the next version, which no two commits can
create. A reader takes the newest entry and the files it leads to; what a commit replaces stays on disk until ``vacuum``, so a
slow reader is not disturbed. Deletes, retention, emptying and compaction choose files by the manifest.

A write names its writer and epoch. The log keeps the last epoch of every writer, and one that comes again
changes nothing. A stream's writer is kept with its checkpoint (``writer_of``): two streams, or a stream with a new checkpoint, are
different writers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlark.functions.values import moment

MANIFEST = "action string, file string, part string, n_rows long, lo timestamp, hi timestamp, key_lo string, key_hi string, writer string"
# A manifest of all files in place of so many of changes.
SNAPSHOT_EVERY = 32
# Files of fewer rows are merged by compaction.
SMALL_FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Entry:
    """One version of a table."""
    version: int = -1
    manifests: list[str] = field(default_factory=list)
    epochs: dict[str, int] = field(default_factory=dict)
    schema: dict | None = None


class Store:
    """A table below ``path``, in files by ``part`` (a column that its rows have when they are written). ``time`` and ``key``
    are the columns whose bounds the manifest keeps."""

    def __init__(self, spark: SparkSession, path: str, part: str = "event_date"):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part

    # --- log -----------------------------------------------------------------------

    def current(self) -> Entry:
        fs, log = _filesystem(self.spark, f"{self.path}/log")
        if not fs.exists(log):
            return Entry()
        names = [s.getPath().getName() for s in fs.listStatus(log)]
        newest = max((n for n in names if n.endswith(".json") and not n.startswith(".")), default=None)
        return Entry(**json.loads(_read_text(self.spark, f"{self.path}/log/{newest}"))) if newest else Entry()

    def files(self, at: Entry | None = None) -> DataFrame:
        """The files that count, one row each, with their bounds."""
        at = at or self.current()
        if not at.manifests:
            return self.spark.createDataFrame([], MANIFEST)
        rows = self.spark.read.schema(MANIFEST).parquet(*[f"{self.path}/log/m-{m}" for m in at.manifests])
        return rows.where("action = 'add'").join(rows.where("action = 'remove'").select("file"), "file", "left_anti").select(*[f.name for f in rows.schema])

    def _commit(self, make: Callable[[Entry], tuple[DataFrame, dict, int] | None], writer: str | None = None, epoch: int | None = None) -> int:
        """Tries ``make`` (changes, schema, count of rows) on the newest version until its entry is the next one."""
        while True:
            at = self.current()
            if writer is not None and epoch <= at.epochs.get(writer, -1):
                return 0
            made = make(at)
            if made is None:
                return 0
            changes, schema, count = made
            manifest, manifests = uuid.uuid4().hex, at.manifests
            if len(manifests) + 1 > SNAPSHOT_EVERY:
                gone = changes.where("action = 'remove'").select("file")
                changes = self.files(at).join(gone, "file", "left_anti").unionByName(changes.where("action = 'add'"))
                manifests = []
            changes.select(*[f.name for f in T.StructType.fromDDL(MANIFEST)]).coalesce(8).write.parquet(f"{self.path}/log/m-{manifest}")
            epochs = at.epochs if writer is None else {**at.epochs, writer: int(epoch)}
            entry = replace(at, version=at.version + 1, manifests=[*manifests, manifest], epochs=epochs, schema=schema)
            if _create(self.spark, f"{self.path}/log/{entry.version:020d}.json", json.dumps(entry.__dict__)):
                return count

    # --- reading -------------------------------------------------------------------

    def read(self, start: str | None = None, end: str | None = None, vehicle: str | None = None) -> DataFrame:
        """The rows of the table, with ``commit`` and the partition column; bounds leave out files that hold nothing within
        them, and rows."""
        at = self.current()
        if at.schema is None:
            raise ValueError(f"there is no table at {self.path}")
        chosen = self.files(at).where(_may_hold(start, end, vehicle))
        rows = self._rows(at, [r["file"] for r in chosen.select("file").toLocalIterator()])
        names = at.schema["metadata"]
        if start is not None:
            rows = rows.where(F.col(names["time"]) >= moment(start))
        if end is not None:
            rows = rows.where(F.col(names["time"]) <= moment(end))
        if vehicle is not None:
            rows = rows.where(F.col(names["key"]) == vehicle)
        return rows.drop("_metadata")

    def time(self) -> str | None:
        """The column whose bounds the manifest keeps."""
        schema = self.current().schema
        return schema and schema["metadata"]["time"]

    def _schema(self, at: Entry) -> T.StructType:
        return T.StructType.fromJson({"type": "struct", "fields": at.schema["fields"]})

    def _rows(self, at: Entry, files: list[str]) -> DataFrame:
        schema = self._schema(at).add("commit", "string")
        if not files:
            return self.spark.createDataFrame([], self._in_order(schema))
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/{f}" for f in files])
        return read.select(*self._in_order(schema).names, "_metadata")

    def _in_order(self, schema: T.StructType) -> T.StructType:
        last = ("commit", self.part)
        return T.StructType([f for f in schema if f.name not in last] + [schema[name] for name in last])

    # --- writing -------------------------------------------------------------------

    def _written(self, rows: DataFrame, time: str, key: str, writer: str | None, order: list[str], files: int | None = None) -> DataFrame:
        """Writes rows as files that count for nothing yet; returns their manifest. Ranges over partition and order keep tasks
        even when most rows are of one day or one vehicle."""
        commit = uuid.uuid4().hex
        folder = f"{self.path}/data/commit={commit}"
        (rows.repartitionByRange(*([files] if files else []), self.part, *order).sortWithinPartitions(self.part, *order)
         .write.partitionBy(self.part).parquet(folder))
        back = self.spark.read.schema(T.StructType([rows.schema[c] for c in dict.fromkeys([time, key, self.part])])).parquet(folder)
        return (back.groupBy(F.regexp_extract("_metadata.file_path", "data/commit=[^/]*/.*$", 0).alias("file"), F.col(self.part).cast("string").alias("part"))
                .agg(F.count("*").alias("n_rows"), F.min(time).cast("timestamp").alias("lo"), F.max(time).cast("timestamp").alias("hi"),
                     F.min(key).cast("string").alias("key_lo"), F.max(key).cast("string").alias("key_hi"))
                .select(F.lit("add").alias("action"), "*", F.lit(writer).cast("string").alias("writer")))

    @staticmethod
    def _described(rows: DataFrame, at: Entry, time: str, key: str) -> dict:
        known = [] if at.schema is None else at.schema["fields"]
        fresh = [f.jsonValue() for f in rows.schema if f.name not in {k["name"] for k in known}]
        return {"fields": [*known, *fresh], "metadata": {"time": time, "key": key}}

    def append(self, rows: DataFrame, time: str, key: str, writer: str, epoch: int, unique: list[str] | None = None, same_time: bool = True) -> int:
        """Adds rows once for a writer's epoch. Rows that another writer has stored, told by the columns of ``unique`` (not null) and
        with ``same_time`` by their time, are left out: a source that is read again from its start adds nothing twice. The files of
        this writer need not be looked at, and with ``same_time`` others only where their times overlap."""
        def make(at: Entry):
            fresh = rows
            if unique and at.schema is not None:
                others, keys = self.files(at).where(~F.col("writer").eqNullSafe(writer)), list(unique)
                if same_time:
                    others, keys = others.where(_may_hold(*rows.agg(F.min(time), F.max(time)).first())), [*keys, time]
                files = [r["file"] for r in others.select("file").toLocalIterator()]
                if files:
                    known = self._rows(at, files).select(*keys).distinct().alias("k")
                    fresh = rows.alias("n").join(known, [F.col(f"n.{c}") == F.col(f"k.{c}") for c in keys], "left_anti")
            added = _kept(self._written(fresh, time, key, writer, _order(rows)))
            return added, self._described(rows, at, time, key), added.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
        return self._commit(make, writer, epoch)

    def replace_parts(self, rows_of: Callable[[DataFrame], DataFrame], parts: Callable[[], list[str]], schema: T.StructType, time: str, key: str,
                      writer: str | None = None, epoch: int | None = None) -> int:
        """Rewrites the partitions ``parts()`` with what ``rows_of`` makes of their rows; the others stay as they are."""
        def make(at: Entry):
            wanted = parts()
            if not wanted and writer is None:
                return None
            at_or_new = at if at.schema is not None else replace(at, schema={"fields": schema.jsonValue()["fields"], "metadata": {"time": time, "key": key}})
            touched = _kept(self.files(at).where(F.col("part").isin(wanted)))
            rows = rows_of(self._rows(at_or_new, [r["file"] for r in touched.select("file").toLocalIterator()]).drop("_metadata", "commit"))
            added = _kept(self._written(rows, time, key, writer, [key]))
            return added.unionByName(_removed(touched)), at_or_new.schema, added.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
        return self._commit(make, writer, epoch)

    def delete(self, condition: Column, start: str | None = None, end: str | None = None, vehicle: str | None = None) -> int:
        """Deletes the rows that meet a condition (and lie within the bounds, which spare files), and returns how many. Only
        files with such a row are written anew."""
        def make(at: Entry):
            if at.schema is None:
                return None
            names, hit = at.schema["metadata"], condition
            if start is not None:
                hit &= F.col(names["time"]) >= moment(start)
            if end is not None:
                hit &= F.col(names["time"]) <= moment(end)
            if vehicle is not None:
                hit &= F.col(names["key"]) == vehicle
            hit = F.coalesce(hit, F.lit(False))
            may = [r["file"] for r in self.files(at).where(_may_hold(start, end, vehicle)).select("file").toLocalIterator()]
            if not may:
                return None
            where = F.regexp_extract("_metadata.file_path", "data/commit=[^/]*/.*$", 0).alias("file")
            hits = _kept(self._rows(at, may).where(hit).groupBy(where).agg(F.count("*").alias("gone")))
            touched = [r["file"] for r in hits.select("file").toLocalIterator()]
            if not touched:
                return None
            left = self._rows(at, touched).where(~hit).drop("_metadata", "commit")
            added = _kept(self._written(left, names["time"], names["key"], None, _order(left)))
            removed = _removed(self.files(at).join(hits.select("file"), "file", "left_semi"))
            return added.unionByName(removed), at.schema, hits.agg(F.sum("gone")).first()[0]
        return self._commit(make)

    def truncate(self) -> int:
        """Empties the table and returns how many rows it had, without reading one."""
        def make(at: Entry):
            files = self.files(at)
            count = files.agg(F.sum("n_rows")).first()[0]
            return None if count is None else (_removed(files), at.schema, count)
        return self._commit(make)

    def drop_before(self, cutoff: str) -> int:
        """Deletes the rows older than the cutoff and returns how many. Files that end before it go unread, only those on both
        sides of it are written anew."""
        def make(at: Entry):
            old = self.files(at).where(F.col("hi") < moment(cutoff))
            count = old.agg(F.sum("n_rows")).first()[0]
            return None if count is None else (_removed(old), at.schema, count)
        dropped = self._commit(make)
        at = self.current()
        return dropped if at.schema is None else dropped + self.delete(F.col(at.schema["metadata"]["time"]) < moment(cutoff), end=cutoff)

    def compact(self, small: int = SMALL_FILE_ROWS) -> int:
        """Merges the small files of every partition that has more than one of them; returns how many files went."""
        def make(at: Entry):
            few = self.files(at).where(F.col("n_rows") < small)
            crowded = few.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part")
            touched = _kept(few.join(crowded, "part", "left_semi"))
            files = [r["file"] for r in touched.select("file").toLocalIterator()]
            if not files:
                return None
            names = at.schema["metadata"]
            rows = self._rows(at, files).drop("_metadata", "commit")
            # files that are all of one writer stay its own
            owner = touched.agg(F.when((F.count("writer") == F.count("*")) & (F.min("writer") == F.max("writer")), F.min("writer"))).first()[0]
            total = touched.agg(F.sum("n_rows")).first()[0]
            added = _kept(self._written(rows, names["time"], names["key"], owner, _order(rows), max(1, total // small)))
            return added.unionByName(_removed(touched)), at.schema, len(files)
        return self._commit(make)

    def vacuum(self, older_than_ms: int) -> int:
        """Removes from disk what no reader of the last while can need: commits of which no file counts, manifests and entries
        that the newest entry does not lead to, written so long ago. Returns how many folders and entries went."""
        at = self.current()
        live = {r["commit"] for r in self.files(at).select(F.regexp_extract("file", "commit=([^/]*)/", 1).alias("commit")).distinct().toLocalIterator()}
        fs, root = _filesystem(self.spark, self.path)
        now, gone = max((s.getModificationTime() for s in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log"))), default=0), 0
        keep = {f"commit={c}" for c in live} | {f"m-{m}" for m in at.manifests} | {f"{at.version:020d}.json"}
        for folder in ("data", "log"):
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            for status in fs.listStatus(place) if fs.exists(place) else []:
                if status.getPath().getName() not in keep and status.getModificationTime() < now - older_than_ms:
                    gone += bool(fs.delete(status.getPath(), True))
        return gone


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The identity of the stream with this checkpoint, made on its first start and kept in its folder."""
    place = f"{checkpoint.rstrip('/')}/writer.json"
    fs, at = _filesystem(spark, place)
    if not fs.exists(at):
        _create(spark, place, json.dumps({"writer": uuid.uuid4().hex}))
    return json.loads(_read_text(spark, place))["writer"]


def _order(rows: DataFrame) -> list[str]:
    return [c for c in ("vehicle_id", "key", "event_timestamp", "detected_at", "window_start", "failed_at", "id", "payload") if c in rows.columns]


def _may_hold(start=None, end=None, vehicle: str | None = None) -> Column:
    """Whether a file may hold rows within bounds, by its manifest."""
    may = F.lit(True)
    if start is not None:
        may &= F.col("hi").isNull() | (F.col("hi") >= (moment(start) if isinstance(start, str) else F.lit(start)))
    if end is not None:
        may &= F.col("lo").isNull() | (F.col("lo") <= (moment(end) if isinstance(end, str) else F.lit(end)))
    if vehicle is not None:
        may &= F.col("key_lo").isNull() | F.lit(vehicle).between(F.col("key_lo"), F.col("key_hi"))
    return may


def _removed(files: DataFrame) -> DataFrame:
    return files.withColumn("action", F.lit("remove"))


def _kept(rows: DataFrame) -> DataFrame:
    """Rows of a manifest, worked out once: one for each file that changes, as the driver's own listing of files has."""
    found = rows.toArrow()
    return rows.sparkSession.createDataFrame(found, schema=rows.schema) if found.num_rows else rows.sparkSession.createDataFrame([], rows.schema)


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _read_text(spark: SparkSession, path: str) -> str:
    fs, place = _filesystem(spark, path)
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file whole, or says that there is one already: written beside it and renamed without overwriting."""
    folder, name = path.rsplit("/", 1)
    fs, beside = _filesystem(spark, f"{folder}/.{uuid.uuid4().hex}.{name}")
    stream = fs.create(beside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(hadoop.Path(path)), no_options)
        return True
    except Py4JJavaError as error:
        fs.delete(beside, False)
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
            return False
        raise
