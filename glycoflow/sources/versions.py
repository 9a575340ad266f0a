"""A day-partitioned table in versions, and the index that tells on which days an event is stored.

Data files are written under fresh names and never changed. A version is one small file that names the folders of every day;
it appears under its final name at once, or not at all. A load that stops half way leaves the last version as it was,
readers keep the version they began with, and of two writers of one day the later one starts again from what the
earlier one has committed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed a day that this one has replaced, too."""


@dataclass(frozen=True)
class Version:
    """Folders by day, and the last batch of every stream that has loaded into the table."""

    number: int = 0
    days: dict[str, list[str]] = field(default_factory=dict)
    loads: dict[str, int] = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, schema: StructType) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = StructType([f for f in schema.fields if f.name != "event_date"])

    # -- reading ----------------------------------------------------------------------

    def current(self) -> Version:
        """The last version; the empty one if there is none."""
        files, folder = self._at(f"{self.root}/versions")
        if not files.exists(folder):
            return Version()
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."]
        return self.version(max(numbers)) if numbers else Version()

    def version(self, number: int) -> Version:
        text = self.spark.read.text(f"{self.root}/versions/{number:012}.json", wholetext=True).first()[0]
        return Version(number, **json.loads(text))

    def read(self, version: Version | None = None, days: list[str] | None = None) -> DataFrame:
        """Rows of a version, of some days only if they are named; no other day's files are looked at."""
        version = version or self.current()
        wanted = version.days if days is None else {d: version.days[d] for d in days if d in version.days}
        paths = [f"{self.root}/data/{folder}/event_date={day}" for day, folders in sorted(wanted.items()) for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema).withColumn("event_date", F.lit(None).cast("date"))
        # The day stands in the path; folders of several loads are not below one base path.
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        return rows.withColumn("event_date", F.regexp_extract(F.col("_metadata.file_path"), r"event_date=([0-9-]+)", 1).cast("date"))

    # -- writing ----------------------------------------------------------------------

    def stage(self, rows: DataFrame, day: Column | None = None) -> dict[str, list[str]]:
        """Write rows under a fresh name, by day; nothing reads them before they are committed."""
        folder = uuid.uuid4().hex
        if day is not None:
            rows = rows.withColumn("event_date", day)
        rows.select(*self.schema.names, "event_date").write.partitionBy("event_date").parquet(f"{self.root}/data/{folder}")
        files, where = self._at(f"{self.root}/data/{folder}")
        names = [s.getPath().getName() for s in files.listStatus(where)]
        return {n.removeprefix("event_date="): [folder] for n in names if n.startswith("event_date=")}

    def commit(
        self, base: Version, replaced: dict[str, list[str]], added: dict[str, list[str]] | None = None,
        load: tuple[str, int] | None = None,
    ) -> Version:
        """Make the next version: days that are replaced (by nothing, if empty), and folders added to days.

        Versions that others have made since `base` are kept if they touch none of the replaced days; else it is a
        conflict, and nothing has changed.
        """
        while True:
            last = self.current()
            if any(last.days.get(d) != base.days.get(d) for d in replaced):
                raise Conflict(f"days replaced since version {base.number}: {sorted(replaced)}")
            if load is not None and last.loads.get(load[0], -1) >= load[1]:
                return last
            days = {d: f for d, f in {**last.days, **replaced}.items() if f}
            for d, folders in (added or {}).items():
                days[d] = days.get(d, []) + folders
            loads = last.loads | ({load[0]: load[1]} if load else {})
            new = Version(last.number + 1, days, loads)
            if self._put(new):
                return new

    def replace(self, change: Callable[[Version], tuple[dict[str, list[str]], tuple[str, int] | None]], attempts: int = 10) -> Version:
        """Commit what `change` makes of the current version; made anew after a conflict."""
        for left in range(attempts, 0, -1):
            base = self.current()
            replaced, load = change(base)
            try:
                return self.commit(base, replaced, load=load)
            except Conflict:
                if left == 1:
                    raise
        raise ValueError("attempts must be positive")

    def remove_unused(self, keep: int = 10) -> None:
        """Delete versions but for the last `keep`, and folders that none of those names.

        Run it while no load is staged: a folder that is not committed yet looks unused.
        """
        last = self.current().number
        kept = [self.version(n) for n in range(max(1, last - keep + 1), last + 1)]
        used = {f"{folder}/event_date={d}" for v in kept for d, folders in v.days.items() for folder in folders}
        files, data = self._at(f"{self.root}/data")
        for load in files.listStatus(data) if files.exists(data) else []:
            days = files.listStatus(load.getPath())
            gone = [d for d in days if f"{load.getPath().getName()}/{d.getPath().getName()}" not in used]
            if all(d in gone or not d.isDirectory() for d in days):
                files.delete(load.getPath(), True)
                continue
            for d in gone:
                if d.isDirectory():
                    files.delete(d.getPath(), True)
        for number in range(1, last - keep + 1):
            files.delete(self._at(f"{self.root}/versions/{number:012}.json")[1], False)

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _put(self, version: Version) -> bool:
        """Write a version beside its place and move it there, unless there is one already."""
        files, place = self._at(f"{self.root}/versions/{version.number:012}.json")
        _, draft = self._at(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps({"days": version.days, "loads": version.loads}).encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        option = getattr(hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.NONE
        try:
            hadoop.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, place, options)
            return True
        except Exception as refused:
            files.delete(draft, False)
            if isinstance(refused, PySparkException) or not files.exists(place):
                raise
            return False


class KeyIndex:
    """Days of stored events by the hash of their id, in buckets.

    A batch reads the buckets of its own ids only. The index may name a day that an event has left; it never misses one.
    Two ids of one hash share their days, which costs a look but changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _keys(self, rows: DataFrame) -> DataFrame:
        key = F.xxhash64("id")
        return rows.select(key.alias("key"), F.pmod(key, F.lit(self.buckets)).cast("int").alias("bucket"), "event_date").distinct()

    def known(self, rows: DataFrame) -> DataFrame:
        """key, bucket and event_date of what is stored under the ids of `rows`."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], "key long, bucket int, event_date date")
        keys = self._keys(rows)
        buckets = [r[0] for r in keys.select("bucket").distinct().collect()]
        stored = self.spark.read.schema("key long, event_date date, bucket int").parquet(self.path).filter(F.col("bucket").isin(buckets))
        return stored.join(keys.select("key").distinct(), "key", "left_semi").select("key", "bucket", "event_date")

    def add(self, rows: DataFrame, known: DataFrame) -> None:
        """Add the days of `rows` that are not among those known."""
        new = self._keys(rows).join(known, ["key", "bucket", "event_date"], "left_anti")
        new.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("append").partitionBy("bucket").parquet(self.path)

    def rebuild(self, rows: DataFrame) -> None:
        """Write the index anew from all rows of a table, for example after many small batches."""
        keys = self._keys(rows).repartition("bucket").sortWithinPartitions("bucket", "key")
        keys.write.mode("overwrite").partitionBy("bucket").parquet(self.path)


def compact_days(table: VersionedTable, days: list[str], rows_per_file: int = 5_000_000) -> Version:
    """Rewrite days into files of about `rows_per_file` rows in (subject, time) order, as one new version.

    Ranges of (day, subject, time) are written, so a crowded subject is cut into as many files as it needs.
    """

    def change(base: Version) -> tuple[dict[str, list[str]], None]:
        rows = table.read(base, days)
        order = ["event_date", "subject_id", "ts"]
        n_files = max(1, -(-rows.count() // rows_per_file))
        staged = table.stage(rows.repartitionByRange(n_files, *order).sortWithinPartitions(*order))
        return {d: staged.get(d, []) for d in days if d in base.days}, None

    return table.replace(change)


def days_of(rows: DataFrame) -> list[str]:
    """Different days of some rows, as text; the driver gets one value a day."""
    return sorted(r[0].isoformat() for r in rows.select("event_date").distinct().collect() if isinstance(r[0], date))
