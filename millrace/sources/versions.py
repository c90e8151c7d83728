"""Parquet tables whose files never change: each write adds files and then publishes the list of those that count.

Below the table's folder::

    data/<write>/…                      Parquet files of one write
    filters/<write>/…                   key filters of those files, see ``key_filters``
    _versions/00000000000000000007.json  schema, applied batches and live files of version 7

A write that dies before its list is published leaves files that no list names; readers never see a part of a write. A
list is published by a rename that fails if the version is already there, so of two writers one looks again. ``vacuum``
removes old lists and files that no kept list names.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from millrace.sources import key_filters

FILE_ROWS = 1 << 20
FILE_BYTES = 128 << 20
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Another writer has replaced the files that this one started from."""


@dataclass(frozen=True)
class DataFile:
    """A live file: its place below the table, rows and bytes, the range of its first key and the size of its filter.

    ``rows`` is None where no keys are kept. ``part`` holds the values of the partition columns as text.
    """

    path: str
    size: int
    rows: int | None = None
    low: object = None
    high: object = None
    blocks: int = 0
    part: tuple = ()

    @property
    def write(self) -> str:
        """The write that made it."""
        return self.path.split("/")[1]


@dataclass(frozen=True)
class Version:
    """What is published: the live files, for each writer the last batch that they hold, and its running counts."""

    number: int = 0
    schema: T.StructType = field(default_factory=T.StructType)
    files: tuple[DataFile, ...] = ()
    done: dict[str, int] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def to_text(self) -> str:
        head = {"schema": self.schema.jsonValue(), "done": self.done, "counts": self.counts}
        return "\n".join([json.dumps(head), *[json.dumps(asdict(f)) for f in self.files]])

    @classmethod
    def from_text(cls, number: int, text: str) -> Version:
        head, *files = map(json.loads, text.split("\n"))
        made = tuple(DataFile(**{**f, "part": tuple(f["part"])}) for f in files)
        return cls(number, T.StructType.fromJson(head["schema"]), made, head["done"], head["counts"])


def merged_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """The old columns and after them the new ones; a column that changes its type is refused."""
    known = {f.name: f.dataType for f in old.fields}
    for f in new.fields:
        if f.name in known and known[f.name] != f.dataType:
            raise ValueError(f"column {f.name!r} is {known[f.name].simpleString()}, not {f.dataType.simpleString()}")
    fields = [*old.fields, *[f for f in new.fields if f.name not in known]]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


class VersionedTable:
    """A table below ``path``. ``keys``: columns by which rows are found again; ``partition_by``: columns whose values never share a file.

    ``probe_from``: bytes of candidate files from which their filters are looked up. ``filter_from``: bytes of a write's
    largest file from which filters are made; smaller files are read sooner than looked up, and have ranges only.

    The driver holds the list of live files, as Spark itself does for any table it reads; ``compact`` keeps it short.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), partition_by: Sequence[str] = (), file_rows: int = FILE_ROWS, probe_from: int = 16 << 20, filter_from: int = 1 << 20):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.partition_by, self.file_rows, self.probe_from = list(keys), list(partition_by), file_rows, probe_from
        self.filter_from = filter_from
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    # ------------------------------------------------------------ versions

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        """The versions that can be read, oldest first."""
        folder = self._at("_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """A published version, the newest by default; an empty one before the first write."""
        if number is None:
            number = self._newest()
        if not number:
            return Version()
        return Version.from_text(number, self._text(self._at(f"_versions/{number:020d}.json")))

    def _newest(self) -> int:
        """The number of the newest version: from the hint that each writer leaves, and on from there."""
        hint = self._at("_versions/_hint")
        try:
            number = int(self._text(hint))
        except Exception:  # noqa: BLE001 - missing, or just being written: look at all of them
            return max(self.numbers(), default=0)
        while self._fs.exists(self._at(f"_versions/{number + 1:020d}.json")):
            number += 1
        return number

    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path, text: str, over: bool) -> None:
        stream = self._fs.create(path, over)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _publish(self, version: Version) -> bool:
        """Whether this writer was the first to publish this version."""
        spare, final = self._at(f"_versions/.{uuid.uuid4().hex}"), self._at(f"_versions/{version.number:020d}.json")
        self._put(spare, version.to_text(), False)
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        gateway = self.spark.sparkContext._gateway
        never_over = gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(spare), self._fs.makeQualified(final), never_over)
        except Exception:
            self._fs.delete(spare, False)
            if self._fs.exists(final):
                return False
            raise
        self._put(self._at("_versions/_hint"), str(version.number), True)
        return True

    def applied(self, writer: str | None, batch: int | None) -> bool:
        """Whether the table already holds this batch of this writer."""
        return writer is not None and batch is not None and self.version().done.get(writer, -1) >= batch

    def commit(
        self,
        schema: T.StructType,
        added: Iterable[DataFile],
        removed: Iterable[str] = (),
        writer: str | None = None,
        batch: int | None = None,
        only_after: int | None = None,
        counted: Mapping[str, int] | None = None,
    ) -> Version:
        """Publish the next version: ``removed`` files go and ``added`` ones come; ``counted`` is added to the running counts.

        Raises ``Conflict`` if a removed file is no longer live, or if ``only_after`` is given and another version has come
        after it. A batch that is already there is not added again.
        """
        added, removed = tuple(added), set(removed)
        while True:
            newest = self.version()
            if writer is not None and batch is not None and newest.done.get(writer, -1) >= batch:
                return newest
            if only_after is not None and newest.number != only_after or not removed <= {f.path for f in newest.files}:
                raise Conflict(f"version {newest.number} of {self.path} has replaced files this write started from")
            done = {**newest.done, **({writer: batch} if writer is not None and batch is not None else {})}
            files = tuple(f for f in newest.files if f.path not in removed) + added
            counts = {**newest.counts, **{k: newest.counts.get(k, 0) + n for k, n in (counted or {}).items()}}
            made = Version(newest.number + 1, merged_schema(newest.schema, schema), files, done, counts)
            if self._publish(made):
                return made

    # ------------------------------------------------------------ data

    def frame(self, files: Iterable[DataFile], schema: T.StructType) -> DataFrame:
        """The rows of some files."""
        paths = [f"{self.path}/{f.path}" for f in files]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        version = self.version(number)
        return self.frame(version.files, version.schema)

    def write_files(self, df: DataFrame, rows: int | None = None) -> list[DataFile]:
        """Write files that no version names yet. With ``rows`` given, they are sorted by the keys into files of ``file_rows``."""
        write = uuid.uuid4().hex
        folder = f"{self.path}/data/{write}"
        parts = {f"_p{i}": F.col(c).cast("string") for i, c in enumerate(self.partition_by)}
        marked = df.withColumns(parts) if parts else df
        if self.keys and rows is not None:
            order = [*parts, *self.keys]
            files = -(-rows // self.file_rows)
            dealt = marked.repartitionByRange(files, *order) if files > 1 else marked.repartition(1)
            marked = dealt.sortWithinPartitions(*order)
        elif parts:
            marked = marked.hint("rebalance", *parts)
        writer = marked.write.partitionBy(*parts) if parts else marked.write
        writer.parquet(folder)
        files = self._listed(write)
        return self._measured(write, files, df.schema) if self.keys and files else files

    def _listed(self, write: str) -> list[DataFile]:
        """The files of a write, without a Spark job."""
        found, todo = [], [self._at(f"data/{write}")]
        prefix = len(self._fs.makeQualified(self._at("")).toString().rstrip("/")) + 1
        while todo:
            for status in self._fs.listStatus(todo.pop()):
                if status.isDirectory():
                    todo.append(status.getPath())
                elif status.getPath().getName().startswith("part-"):
                    path = status.getPath().toString()[prefix:]
                    values = [unquote(p.split("=", 1)[1]) for p in path.split("/")[2:-1]]
                    part = tuple(None if v == NO_VALUE else v for v in values)
                    found.append(DataFile(path, status.getLen(), part=part))
        return sorted(found, key=lambda f: f.path)

    def _measured(self, write: str, files: list[DataFile], schema: T.StructType) -> list[DataFile]:
        """The files with rows, range of the first key and a filter over all keys; one row for each file comes to the driver."""
        narrow = self.frame(files, T.StructType([schema[k] for k in self.keys]))
        ranged = isinstance(schema[self.keys[0]].dataType, key_filters.RANGED)
        largest, blocks, measured = max(f.size for f in files), 0, {}
        if largest < self.filter_from:
            per_file = key_filters.ranges(narrow, self.keys[0])
        else:
            target = f"{self.path}/filters/{write}"
            blocks = key_filters.build(narrow, self.keys, largest, target)
            per_file = self.spark.read.parquet(target)
        for row in key_filters.summary(per_file, ranged):
            name = unquote(row["file"]).rsplit("/data/", 1)[1]
            measured[f"data/{name}"] = (row["rows"], row["low"], row["high"], blocks)
        return [replace(f, **dict(zip(("rows", "low", "high", "blocks"), measured.get(f.path, (0, None, None, blocks))))) for f in files]

    def add(
        self, df: DataFrame, writer: str | None = None, batch: int | None = None, rows: int | None = None, counted: Mapping[str, int] | None = None
    ) -> Version:
        """Append rows; once only for each batch of a writer."""
        if self.applied(writer, batch):
            return self.version()
        return self.commit(df.schema, self.write_files(df, rows), writer=writer, batch=batch, counted=counted)

    def overwrite(
        self, df: DataFrame, writer: str | None = None, batch: int | None = None, counted: Mapping[str, int] | None = None
    ) -> Version:
        """Replace all rows; readers see the old ones until the new ones are complete."""
        if self.applied(writer, batch):
            return self.version()
        base = self.version()
        return self.commit(df.schema, self.write_files(df), [f.path for f in base.files], writer, batch, counted=counted)

    # ------------------------------------------------------------ keys

    def holding(self, version: Version, touched: DataFrame) -> list[DataFile]:
        """The files that may hold one of the keys of ``touched``: by the range of their first key, then by their filters."""
        return key_filters.holding(self.path, version.files, version.schema, self.keys, touched, self.probe_from)[0]

    def rewrite(
        self, touched: DataFrame, change: Callable[[DataFrame], DataFrame], writer: str | None = None, batch: int | None = None, whole_parts: bool = False
    ) -> Version:
        """Replace the files that may hold a key of ``touched`` by ``change`` of their rows; the others stay as they are.

        ``change`` also brings the rows of new keys. With ``whole_parts`` the other files of the same partitions, and of
        those that ``touched`` names by its partition columns, are replaced too. Starts again when another writer was faster.
        """
        while True:
            if self.applied(writer, batch):
                return self.version()
            base = self.version()
            if self.keys and base.files:
                hit, new_rows = key_filters.holding(self.path, base.files, base.schema, self.keys, touched, self.probe_from)
            else:
                hit, new_rows = [], touched.count()
            if whole_parts and self.partition_by:
                named = {tuple(r) for r in touched.select(*[F.col(c).cast("string") for c in self.partition_by]).distinct().collect()}
                parts = {f.part for f in hit} | named
                hit = [f for f in base.files if f.part in parts]
            schema = base.schema if base.files else None
            old = self.frame(hit, schema) if schema else None
            new = change(old)
            rows = sum(f.rows or 0 for f in hit) + new_rows
            added = self.write_files(new, rows)
            try:
                return self.commit(new.schema, added, [f.path for f in hit], writer, batch, only_after=base.number)
            except Conflict:
                continue

    # ------------------------------------------------------------ upkeep

    def small_files(self, version: Version, file_bytes: int = FILE_BYTES) -> int:
        """The greatest number of files below half the wanted size in one partition."""
        counts: dict[tuple, int] = {}
        for f in version.files:
            if f.size < file_bytes // 2:
                counts[f.part] = counts.get(f.part, 0) + 1
        return max(counts.values(), default=0)

    def compact(self, file_bytes: int = FILE_BYTES) -> Version:
        """Gather small files of a partition into files of about ``file_bytes``, in one job.

        Files below half that size are packed first-fit decreasing; each bin becomes one file. Rows are sorted only where the
        table has keys; others pass from the shuffle into their file. Safe beside running writers: they only add files, or replace
        some; if one of the gathered files was replaced meanwhile, nothing is published.
        """
        base = self.version()
        bins = pack_files([f for f in base.files if f.size < file_bytes // 2], file_bytes)
        bins = [b for b in bins if len(b) > 1]
        if not bins:
            return base
        numbered = [(f.path, i) for i, b in enumerate(bins) for f in b]
        rows = self.frame([f for b in bins for f in b], base.schema)
        place = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"/(data/[0-9a-f]{32}/.*)$", 1)
        of_file = self.spark.createDataFrame(numbered, "_file string, _bin int")  # a row for each gathered file
        gathered = rows.withColumn("_file", place).join(of_file, "_file").drop("_file")
        spread = gathered.repartitionByRange(len(bins), "_bin")
        spread = (spread.sortWithinPartitions("_bin", *self.keys) if self.keys else spread).drop("_bin")
        added = self.write_files(spread) if not self.partition_by else self._gathered_parts(spread)
        try:
            return self.commit(base.schema, added, [p for p, _ in numbered])
        except Conflict:
            return self.version()

    def _gathered_parts(self, spread: DataFrame) -> list[DataFile]:
        """Files of rows that are already gathered, one or more partitions in a task."""
        write = uuid.uuid4().hex
        parts = {f"_p{i}": F.col(c).cast("string") for i, c in enumerate(self.partition_by)}
        spread.withColumns(parts).write.partitionBy(*parts).parquet(f"{self.path}/data/{write}")
        files = self._listed(write)
        return self._measured(write, files, spread.schema) if self.keys and files else files

    def vacuum(self, keep: int = 10, older_than_seconds: float = 24 * 3600) -> int:
        """Forget all but the newest ``keep`` versions and remove the files that none of those names; returns the number removed.

        Files of writes that are still running are younger than ``older_than_seconds``, and stay.
        """
        numbers = self.numbers()
        kept = {f.path for n in numbers[-keep:] for f in self.version(n).files}
        writes = {p.split("/")[1] for p in kept}
        limit, removed = (time.time() - older_than_seconds) * 1000, 0
        for number in numbers[:-keep]:
            self._fs.delete(self._at(f"_versions/{number:020d}.json"), False)
        for kind in ("data", "filters"):
            if not self._fs.exists(self._at(kind)):
                continue
            for status in self._fs.listStatus(self._at(kind)):
                write = status.getPath().getName()
                if status.getModificationTime() > limit:
                    continue
                if write not in writes:
                    removed += self._fs.delete(status.getPath(), True)
                elif kind == "data":
                    for f in self._listed(write):
                        if f.path not in kept:
                            removed += self._fs.delete(self._at(f.path), False)
        return removed


def pack_files(files: Iterable[DataFile], file_bytes: int) -> list[list[DataFile]]:
    """First-fit decreasing: files of one partition in bins of at most ``file_bytes``."""
    bins: dict[tuple, list[list]] = {}
    for f in sorted(files, key=lambda f: (-f.size, f.path)):
        mine = bins.setdefault(f.part, [])
        for b in mine:
            if b[0] + f.size <= file_bytes:
                b[0] += f.size
                b[1].append(f)
                break
        else:
            mine.append([f.size, [f]])
    return [b[1] for mine in bins.values() for b in mine]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table; only published rows."""
    return VersionedTable(spark, path).read()

