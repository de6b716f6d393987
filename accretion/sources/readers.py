"""Spark data sources: a file-table image, journal buffers, a directory walk, and a journal as a stream.

    spark.dataSource.register(FileTable)
    spark.read.format("filetable").option("path", image).load()

Image files must lie where every executor can open them. Journal buffers are read through Spark's own binaryFile reader,
and so from any store.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from accretion.scratch import saved

from . import ntfs
from .usn import UsnJournal

RECORDS = (
    "kind string, record long, parent long, name string, is_dir boolean, bytes long, logical_bytes long, created double, modified double, attributes long, hard_links long, base long, unnamed long, named long, logical long, wof boolean"
)
FIELDS = [c.split()[0] for c in RECORDS.split(", ")]
EVENTS = "usn long, file long, parent long, file_full long, parent_full long, timestamp double, reason long, is_dir boolean, name string"
EVENT_FIELDS = [c.split()[0] for c in EVENTS.split(", ")]
CHUNK, LINK = 8192, 0x400


class _Extent(InputPartition):
    def __init__(self, offset: int, records: int, first: int):
        super().__init__((offset, records, first))
        self.offset, self.records, self.first = offset, records, first


class _FileTableReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.low, self.high, self.kinds = options["path"], 0, 1 << 48, None
        with open(self.path, "rb") as f:
            self.shape = ntfs.geometry(f.read(512))
            f.seek(self.shape.table_at)
            self.runs = ntfs.table_runs(f.read(self.shape.record), self.shape.sector)

    def pushFilters(self, filters):
        """Ranges of records choose what is read, kinds what is decoded in full."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("record",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and value is not None:
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, value + (not isinstance(f, LessThan)))
            elif column == ("kind",) and isinstance(f, EqualTo | In):
                own = {value} if isinstance(f, EqualTo) else set(value)
                self.kinds = own if self.kinds is None else own & self.kinds
            elif not (isinstance(f, IsNotNull) and column in (("record",), ("kind",))):  # these never are
                yield f

    def partitions(self):
        """Ranges of records: a sparse run has none, but its numbers count."""
        out, number, size = [], 0, self.shape.record
        for run in self.runs:
            n = run.length * self.shape.cluster // size
            if run.lcn is not None:
                low, high = max(0, self.low - number), min(n, self.high - number)
                out += [_Extent(run.lcn * self.shape.cluster + k * size, min(CHUNK, high - k), number + k) for k in range(low, high, CHUNK)]
            number += n
        return out or [_Extent(0, 0, 0)]

    def read(self, part):
        size = self.shape.record
        with open(self.path, "rb") as f:
            f.seek(part.offset)
            data = f.read(part.records * size)
        found = (ntfs.file_record(data[i * size : (i + 1) * size], part.first + i, self.shape.sector, self.kinds) for i in range(len(data) // size))
        yield record_batch([r for r in found if r])


def record_batch(rows: list[dict]):
    """Decoded records as an Arrow batch of RECORDS."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    columns = [c.split() for c in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds[k]) for c, k in columns], names=FIELDS)


class FileTable(DataSource):
    """Records of a volume image's file table: entries, extensions, and the torn and unnamed ones by kind."""

    @classmethod
    def name(cls):
        return "filetable"

    def schema(self):
        return RECORDS

    def reader(self, schema):
        return _FileTableReader(self.options)


class _WalkReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]

    def partitions(self):
        """One for each directory at the top, and one for the files beside them."""
        tops = sorted(e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False))
        return [InputPartition(""), *map(InputPartition, tops)]

    def level(self, here):
        """What a directory holds; itself as failed if it can't be read."""
        try:
            found = sorted(os.scandir(os.path.join(self.root, here.replace("\\", os.sep))), key=lambda e: e.name)
        except OSError:
            yield (here, True, 0, None, None, 0, True)
            return
        for e in found:
            yield self._row(e, f"{here}\\{e.name}" if here else e.name, e.is_dir(follow_symlinks=False), e.is_symlink())

    def read(self, part):
        todo = [part.value]
        while todo:
            for row in self.level(todo.pop()):
                yield row
                if part.value and row[1] and not row[5] & LINK and not row[6]:
                    todo.append(row[0])

    @staticmethod
    def _row(e, path, is_dir, link):
        try:
            s = e.stat(follow_symlinks=False)
        except OSError:
            return (path, is_dir, 0, None, None, 0, True)
        born = getattr(s, "st_birthtime", s.st_ctime)
        return (path, is_dir, 0 if is_dir or link else s.st_size, born, s.st_mtime, LINK if link else 0x10 if is_dir else 0x20, False)


class Walk(DataSource):
    """A directory's entries, by path; links are listed, never followed, and take nothing; what can't be read is marked failed."""

    @classmethod
    def name(cls):
        return "walk"

    def schema(self):
        return "path string, is_dir boolean, bytes long, created double, modified double, attributes long, failed boolean"

    def reader(self, schema):
        return _WalkReader(self.options)


def walked(spark: SparkSession, root: str, budget: int = 5000, tasks: int | None = None) -> DataFrame:
    """The entries that Walk gives, by tasks that share the work evenly, whatever the shape of the tree.

    A task lists directories from what it was dealt, depth first, and stops after so many (budget); those that it found
    but didn't come to are dealt anew among all tasks in the next round. Each round is a table, so neither a lost
    executor nor a later round lists anything twice. The folder must be open to all executors.
    """
    tasks, mounted = tasks or 4 * spark.sparkContext.defaultParallelism, _WalkReader({"path": root})
    schema = Walk({}).schema() + ", todo boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator) -> Iterator[pd.DataFrame]:
        for b in batches:
            stack, left = b["path"].tolist(), budget
            while stack and left:
                left -= 1
                rows = list(mounted.level(stack.pop()))
                stack += [r[0] for r in rows if r[1] and not r[5] & LINK and not r[6]]
                yield pd.DataFrame([(*r, False) for r in rows], columns=names)
            yield pd.DataFrame([(p, True, 0, None, None, 0, False, True) for p in stack], columns=names)

    found, frontier, n = [], spark.createDataFrame([("",)], "path string"), 1
    while n:
        dealt = frontier.select("path", F.rand(7).alias("r")).repartition(min(n, tasks), "r").select("path")
        found.append(saved(dealt.mapInPandas(run, schema), "walked"))
        frontier = found[-1].where("todo")
        n = frontier.count()
    return reduce(DataFrame.unionByName, found).where("NOT todo").drop("todo")


def journal_buffers(spark: SparkSession, path: str) -> DataFrame:
    """Events of files that each hold one journal buffer."""

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decoded, EVENTS)


def decoded(batches: Iterator) -> Iterator:
    """Events of batches with buffers in column content; of no more than one buffer at a time, handed on in batches of CHUNK."""
    for b in batches:
        for blob in b.column("content"):
            events = ntfs.journal_events(blob.as_py() or b"")[1]
            for i in range(0, len(events), CHUNK):
                yield event_batch(events[i : i + CHUNK])


def event_batch(rows: list[dict]):
    """Decoded events as an Arrow batch of EVENTS."""
    import pyarrow as pa

    columns = [[_signed(r[c]) if c.endswith("_full") else r[c] for r in rows] for c in EVENT_FIELDS]
    kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=EVENT_FIELDS)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ingest(spark: SparkSession, sources: list) -> tuple[DataFrame, str, str | None]:
    """(entries, source, reason): the first of (name, function) that works; reason is why the one before didn't."""
    reason = None
    for name, make in sources:
        try:
            rows = make(spark)
            rows.limit(1).count()
            return rows, name, reason
        except Exception as error:
            reason = f"{name}: {str(error).splitlines()[0]}"
    raise RuntimeError(reason)


class _Events(InputPartition):
    """A file of events, and which of them: those of a journal from usn low up to high, with a reason of the mask if there is one."""

    def __init__(self, name: str, journal_id: int, low: int, high: int, reset: bool, mask: int):
        super().__init__((name, journal_id, low, high, reset, mask))
        self.name, self.journal_id, self.low, self.high, self.reset, self.mask = name, journal_id, low, high, reset, mask


def journal_state(path: str) -> dict:
    """What journal.json says: journal_id, lowest_valid_usn, next_usn."""
    with open(os.path.join(path, "journal.json"), encoding="utf-8") as f:
        return json.load(f)


def _files(path: str, journal_id: int, low: int, high: int, reset: bool, mask: int) -> list[_Events]:
    return [_Events(n, journal_id, low, high, reset, mask) for n in sorted(os.listdir(path)) if n.startswith("events-")] if low < high else []


def _events_of(path: str, part: _Events):
    """A batch of each so many events."""
    import pyarrow as pa

    def batch(rows: list[dict]):
        kinds = (("drive", pa.string()), ("usn", pa.int64()), ("timestamp", pa.float64()), ("reason", pa.int64()), ("is_dir", pa.bool_()), ("name", pa.string()), ("path", pa.string()), ("bytes", pa.int64()))
        columns = [pa.array([e.get(c) for e in rows], k) for c, k in kinds]
        return pa.RecordBatch.from_arrays([*columns, pa.array([part.reset] * len(rows), pa.bool_())], names=[*(c for c, _ in kinds), "journal_reset"])

    with open(os.path.join(path, part.name), encoding="utf-8") as f:
        rows = []
        for e in map(json.loads, f):
            if e["journal_id"] == part.journal_id and part.low <= e["usn"] < part.high and (not part.mask or e["reason"] & part.mask):
                rows.append(e)
                if len(rows) == CHUNK:
                    yield batch(rows)
                    rows = []
        yield batch(rows)


class _JournalReader(DataSourceReader):
    """All that the journal holds, or what is in usns [start, end) and has a reason of reasonMask: options of the source."""

    def __init__(self, options):
        self.path, self.options = options["path"], options

    def partitions(self):
        state = journal_state(self.path)
        return _files(self.path, state["journal_id"], int(self.options.get("start", state["lowest_valid_usn"])), int(self.options.get("end", state["next_usn"])), False, int(self.options.get("reasonMask", 0)))

    def read(self, part):
        yield from _events_of(self.path, part)


class _JournalStream(DataSourceStreamReader):
    """Folders of JSON lines play the journal: journal.json has its state, events-*.json its events.

    The driver only reads the state; executors read the files, each for the usns of the batch. The offset carries the
    journal's id and lowest usn, as numbers of different journals can't be compared: with another id, or with a cursor
    older than what the journal still holds, reading starts over at its lowest event.
    """

    def __init__(self, options):
        self.path = options["path"]
        self.most, self.mask = int(options.get("maxUsnsPerBatch", 0)), int(options.get("reasonMask", 0))
        self.at: dict | None = None

    def initialOffset(self):
        state = journal_state(self.path)
        self.at = {"journal_id": state["journal_id"], "lowest": state["lowest_valid_usn"], "next_usn": state["lowest_valid_usn"]}
        return self.at

    @staticmethod
    def _begin(start, end):
        """(where reading begins, whether it starts over)."""
        reset = start["journal_id"] != end["journal_id"] or start["next_usn"] < end["lowest"]
        return end["lowest"] if reset else start["next_usn"], reset

    def latestOffset(self):
        """The journal's end, or so many usns on from where the last batch ended, if this reader has seen one."""
        state = journal_state(self.path)
        end = {"journal_id": state["journal_id"], "lowest": state["lowest_valid_usn"], "next_usn": state["next_usn"]}
        if self.most and self.at:
            end["next_usn"] = max(end["lowest"], min(end["next_usn"], self._begin(self.at, end)[0] + self.most))
        return end

    def partitions(self, start, end):
        self.at = end
        low, reset = self._begin(start, end)
        return _files(self.path, end["journal_id"], low, end["next_usn"], reset, self.mask)

    def read(self, part):
        yield from _events_of(self.path, part)


class JournalFolder(DataSource):
    @classmethod
    def name(cls):
        return "journalfolder"

    def schema(self):
        return "drive string, usn long, timestamp double, reason long, is_dir boolean, name string, path string, bytes long, journal_reset boolean"

    def reader(self, schema):
        return _JournalReader(self.options)

    def streamReader(self, schema):
        return _JournalStream(self.options)


def capacity(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(drive, total_bytes, free_bytes, present) of the volumes at roots, {drive: folder}; one that is gone isn't present."""
    import shutil

    rows = []
    for drive, root in roots.items():
        try:
            space = shutil.disk_usage(root)
            rows.append((drive, space.total, space.free, True))
        except OSError:
            rows.append((drive, None, None, False))
    return spark.createDataFrame(rows, "drive string, total_bytes long, free_bytes long, present boolean")


def doctor(spark: SparkSession, path: str) -> DataFrame:
    """(source, works, reason): what could read this path, each tried as far as its head."""
    from .usn import Segments

    tries = {
        "filetable": lambda: _FileTableReader({"path": path}), "walk": lambda: next(iter(os.scandir(path)), None), "usnjournal": lambda: (Segments(path).state(), Segments(path).all()),
        "journalfolder": lambda: journal_state(path), "capacity": lambda: capacity(spark, {"": path}).where("present").first().total_bytes,
    }
    rows = []
    for name, attempt in tries.items():
        try:
            attempt()
            rows.append((name, True, None))
        except Exception as error:
            rows.append((name, False, f"{type(error).__name__}: {error}"))
    return spark.createDataFrame(rows, "source string, works boolean, reason string")


def register(spark: SparkSession) -> None:
    """Make the sources known, and let Spark leave filters to those that take them: it refuses to read from them otherwise."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FileTable, Walk, JournalFolder, UsnJournal):
        spark.dataSource.register(source)


def run_lists(column: str):
    """A column of run-list bytes as array<struct<vcn, lcn, length>>; null where it is broken."""
    @F.pandas_udf("array<struct<vcn:bigint,lcn:bigint,length:bigint>>")
    def decode(data: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else [r._asdict() for r in ntfs.runs(bytes(x))]
            except ValueError:
                return None

        return data.map(one)

    return decode(column)


def image_entries(spark: SparkSession, path: str) -> DataFrame:
    """Scan entries of a volume image."""
    from accretion.operators import filetable

    # decoded once and used three times, from a table: nothing stays held when the entries have been read
    raw = saved(spark.read.format("filetable").load(path), "records")
    entries = filetable.merged_sizes(raw.where("kind = 'entry'"), raw.where("kind = 'extension'"))
    paths = filetable.resolved_paths(raw.where("kind = 'entry' AND is_dir").select("record", "parent", "name"))
    return filetable.as_entries(entries, paths)
