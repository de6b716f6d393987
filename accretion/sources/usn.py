"""A journal of binary buffers as a table and as a stream: the source `usnjournal`.

    spark.dataSource.register(UsnJournal)
    spark.readStream.format("usnjournal").option("path", folder).option("drive", "C:").option("maxEventsPerBatch", 100000).load()

A folder has `journal.info`, the journal's own data (id, lowest and next usn), and segments, files `*.usn` of one buffer each
as the system hands them out. A segment's first and next usn are in its first bytes. The index of segments reads these bytes
of files that it doesn't know yet, and nothing else; a batch, a table of some usns or a filter on usn opens the segments
that it needs. Segments are complete when they appear under their names.

The driver reads heads, executors read segments: both must be able to open the folder.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from accretion.functions import reasons as R

from . import ntfs

SCHEMA = "drive string, usn long, file long, parent long, file_full long, parent_full long, timestamp double, reason long, kind string, is_dir boolean, name string, journal_reset boolean"
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]
INFO, SUFFIX = "journal.info", ".usn"
#: Bytes of a segment that tell its usns, and the least that an event takes: a segment has no more events than that.
HEAD_BYTES, LEAST_EVENT = 128, 64
#: Bytes of segments that a task reads, and events of a batch that it hands on.
TASK_BYTES, CHUNK = 16 << 20, 8192
LAST = (1 << 63) - 1


def local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


class Segment(NamedTuple):
    first: int
    next: int
    name: str
    size: int

    @property
    def most(self) -> int:
        """No more events than that are in it."""
        return self.size // LEAST_EVENT


class Segments:
    """The index of a folder's segments, in order of usn. heads: how many files it has looked into."""

    def __init__(self, folder: str):
        self.folder, self.known, self.heads = local(folder), {}, 0

    def state(self) -> ntfs.Journal:
        with open(os.path.join(self.folder, INFO), "rb") as f:
            return ntfs.journal_info(f.read())

    def all(self) -> list[Segment]:
        there = {e.name: e.stat().st_size for e in os.scandir(self.folder) if e.name.endswith(SUFFIX)}
        self.known = {n: s for n, s in self.known.items() if n in there}
        for name, size in there.items():
            if name not in self.known:
                self.heads += 1
                with open(os.path.join(self.folder, name), "rb") as f:
                    usns = ntfs.buffer_head(f.read(HEAD_BYTES))
                self.known[name] = Segment(*usns, name, size) if usns else None
        return sorted(s for s in self.known.values() if s)

    def between(self, low: int, high: int) -> list[Segment]:
        """Those that may have usns from low up to high. A segment ends before the next one begins."""
        found = self.all()
        begin = bisect.bisect_right([s.next for s in found], low)
        return found[begin : bisect.bisect_left([s.first for s in found], high)]


class Wanted(NamedTuple):
    """What a reading is of: a range of usns, reasons of a mask (0: any), and kinds (None: any)."""

    low: int = 0
    high: int = LAST
    mask: int = 0
    kinds: frozenset | None = None

    def test(self, usn: int, reason: int) -> bool:
        return self.low <= usn < self.high and (not self.mask or bool(reason & self.mask)) and (self.kinds is None or kind(reason) in self.kinds)


def kind(reason: int) -> str:
    """As the column function of this name: the first kind, by its order, whose bit is set."""
    return next((k for k, mask in R.KIND_MASKS if reason & mask), R.OTHER)


class Task(InputPartition):
    def __init__(self, names: list[str], wanted: Wanted, reset: bool = False):
        super().__init__(tuple(names))
        self.names, self.wanted, self.reset = names, wanted, reset


def tasks(found: list[Segment], wanted: Wanted, reset: bool = False) -> list[Task]:
    """Segments in tasks of TASK_BYTES, or one larger segment."""
    out, size = [], 0
    for s in found:
        if not out or size + s.size > TASK_BYTES:
            out.append([])
            size = 0
        out[-1].append(s.name)
        size += s.size
    return [Task(names, wanted, reset) for names in out]


def read(folder: str, drive: str, task: Task) -> Iterator:
    """Batches of a task's events."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for name in task.names:
        with open(os.path.join(local(folder), name), "rb") as f:
            events = ntfs.journal_events(f.read(), task.wanted.test)[1]
        for i in range(0, len(events), CHUNK):
            rows = [e | {"drive": drive, "kind": kind(e["reason"]), "journal_reset": task.reset, "file_full": signed(e["file_full"]), "parent_full": signed(e["parent_full"])} for e in events[i : i + CHUNK]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[k]) for c, k in (x.split() for x in SCHEMA.split(", "))], names=FIELDS)


class _Reader(DataSourceReader):
    """What the journal holds from options start up to end, with a reason of reasonMask; filters on usn and kind are taken over."""

    def __init__(self, options):
        self.folder, self.drive, self.segments = options["path"], options.get("drive", "C:"), Segments(options["path"])
        self.wanted = Wanted(int(options.get("start", 0)), int(options.get("end", LAST)), int(options.get("reasonMask", 0)))

    def pushFilters(self, filters):
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("usn",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and value is not None:
                low = value + isinstance(f, GreaterThan) if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual) else 0
                high = value + (not isinstance(f, LessThan)) if isinstance(f, EqualTo | LessThan | LessThanOrEqual) else LAST
                self.wanted = self.wanted._replace(low=max(self.wanted.low, low), high=min(self.wanted.high, high))
            elif column == ("kind",) and isinstance(f, EqualTo | In):
                own = frozenset([value] if isinstance(f, EqualTo) else value)
                self.wanted = self.wanted._replace(kinds=own if self.wanted.kinds is None else own & self.wanted.kinds)
            elif not (isinstance(f, IsNotNull) and column in (("usn",), ("kind",))):  # these never are
                yield f

    def partitions(self):
        return tasks(self.segments.between(self.wanted.low, self.wanted.high), self.wanted) or [Task([], self.wanted)]

    def read(self, task):
        yield from read(self.folder, self.drive, task)


class _Stream(DataSourceStreamReader):
    """Batches of whole segments.

    An offset has the journal's id, its lowest usn and the usn where reading goes on. Numbers of different journals can't be
    compared: with another id, or from before what the journal still holds, reading starts over at its lowest event. A batch
    has as many segments as surely hold no more than maxEventsPerBatch events, and one at least. After a restart Spark tells
    the last offset before it asks for the next, so the first batch is no larger than any other.
    """

    def __init__(self, options):
        self.folder, self.drive, self.segments = options["path"], options.get("drive", "C:"), Segments(options["path"])
        self.most, self.mask = int(options.get("maxEventsPerBatch", 0)), int(options.get("reasonMask", 0))
        self.at: dict | None = None

    def initialOffset(self):
        state = self.segments.state()
        self.at = {"journal_id": state.journal_id, "lowest": state.lowest_valid_usn, "next_usn": state.lowest_valid_usn}
        return self.at

    @staticmethod
    def begin(start: dict, end: dict) -> tuple[int, bool]:
        """(where reading begins, whether it starts over)."""
        reset = start["journal_id"] != end["journal_id"] or start["next_usn"] < end["lowest"]
        return end["lowest"] if reset else start["next_usn"], reset

    def latestOffset(self):
        state, at = self.segments.state(), self.at or self.initialOffset()
        end = {"journal_id": state.journal_id, "lowest": state.lowest_valid_usn, "next_usn": state.next_usn}
        low, _ = self.begin(at, end)
        left, reached = self.most, low
        for k, s in enumerate(self.segments.between(low, state.next_usn)):
            left -= s.most
            if self.most and k and left < 0:
                break
            reached = s.next
        return end | {"next_usn": min(reached, state.next_usn)}

    def partitions(self, start, end):
        self.at = end
        low, reset = self.begin(start, end)
        return tasks(self.segments.between(low, end["next_usn"]) if low < end["next_usn"] else [], Wanted(low, end["next_usn"], self.mask), reset)

    def read(self, task):
        yield from read(self.folder, self.drive, task)


class UsnJournal(DataSource):
    @classmethod
    def name(cls):
        return "usnjournal"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)
