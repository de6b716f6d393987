"""What a front end asks for, as DataFrames: parameters are checked and clamped here, results can be written as JSON."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from accretion.functions import paths as P
from accretion.operators import buckets, hotspots, journal, snapshots as N, timeline as T, tree


def drive_of(raw: str | None, known: list[str] = ()) -> str:
    """c, C: and c:\\ are C:; nothing is the first known drive, or C:. ValueError for anything else."""
    text = (raw or "").strip()
    if not text:
        return known[0] if known else "C:"
    found = re.fullmatch(r"([A-Za-z]):?\\?", text.replace("/", "\\"))
    if not found:
        raise ValueError(f"not a drive: {raw!r}")
    return found[1].upper() + ":"


def number(raw, default: int, low: int, high: int) -> int:
    """Clamped to low..high; ValueError for what isn't a whole number."""
    return max(low, min(high, int(str(default if raw in (None, "") else raw).strip())))


def path_of(raw: str | None) -> str:
    return re.sub(r"^[A-Za-z]:(?=\\|$)", "", (raw or "").strip().replace("/", "\\")).strip("\\")


def _has_nan(value: Column, kind: DataType) -> Column | None:
    """Whether a value holds NaN, at any depth; None for types that can't."""
    if isinstance(kind, DoubleType | FloatType):
        return F.isnan(value)
    if isinstance(kind, StructType):
        found = [x for x in (_has_nan(value.getField(f.name), f.dataType) for f in kind) if x is not None]
        return reduce(lambda x, y: x | y, [F.coalesce(x, F.lit(False)) for x in found]) if found else None
    if isinstance(kind, MapType):
        return _has_nan(F.map_values(value), ArrayType(kind.valueType))
    if isinstance(kind, ArrayType) and _has_nan(F.lit(None), kind.elementType) is not None:
        return F.exists(value, lambda x: F.coalesce(_has_nan(x, kind.elementType), F.lit(False)))
    return None


def as_json(df: DataFrame) -> DataFrame:
    """(value): a JSON text for each row, nulls included; NaN, which JSON hasn't, fails the query wherever it is."""
    bad = [x for x in (_has_nan(F.col(f"`{c.name}`"), c.dataType) for c in df.schema) if x is not None]
    for b in bad:
        df = df.where(F.when(b, F.raise_error(F.lit("NaN can't be written as JSON"))).isNull())
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


class Engine:
    """Answers from tables: snapshots, dirs, files, buckets (each with snapshot_id) and events, status of the journal.

    boundary: the first snapshot id that counts bytes by today's rules. capacity: (drive, total_bytes, free_bytes, present).
    """

    def __init__(self, snapshots: DataFrame, dirs: DataFrame, files: DataFrame, age_buckets: DataFrame, events: DataFrame, status: DataFrame, now: float, tz: str = "UTC", defaults: tuple[str, ...] = ("C:",), boundary: int | None = None, capacity: DataFrame | None = None):
        self.snapshots_, self.dirs, self.files, self.buckets, self.events, self.status_, self.now, self.tz, self.defaults = snapshots, dirs, files, age_buckets, events, status, now, tz, list(defaults)
        self.boundary, self.capacity = boundary, capacity

    def _newest(self, drive: str) -> int | None:
        row = N.latest(self.snapshots_.where(F.col("drive") == drive)).select("id").first()
        return row and row.id

    def _of(self, rows: DataFrame, snapshot_id: int | None) -> DataFrame:
        return rows.where(F.col("snapshot_id") == snapshot_id if snapshot_id is not None else F.lit(False))

    def _coverage(self, drive: str | None = None) -> DataFrame:
        of = (lambda x: x.where(F.col("drive") == drive)) if drive else (lambda x: x)
        return journal.coverage(of(self.events), of(self.status_), self.tz)

    def status(self) -> DataFrame:
        """A row for each drive: its newest snapshot, what the journal covers, and the volume's space if that is known."""
        out = N.drive_status(self.snapshots_, self.events, self.defaults).join(self._coverage().drop("events"), "drive", "left")
        if self.capacity is None:
            return out
        used = (F.col("total_bytes") - F.col("free_bytes")).alias("live_used_bytes")
        live = self.capacity.select("drive", F.col("total_bytes").alias("live_total_bytes"), F.col("free_bytes").alias("live_free_bytes"), used, "present")
        return out.join(live, "drive", "left").withColumn("present", F.coalesce("present", F.lit(False)))

    def timeline_days(self, drive=None, days=None) -> DataFrame:
        drive, days = drive_of(drive), number(days, 90, 1, 3650)
        rows = T.timeline(self.snapshots_.where(F.col("drive") == drive), self.dirs, self.buckets.drop("drive"), self.now, days, tz=self.tz)
        return T.with_journal(rows, journal.daily(self.events.where(F.col("drive") == drive), self.now, days, self.tz))

    def timeline(self, drive=None, days=None, top=None) -> dict[str, DataFrame]:
        """The days; their summary; who grew and shrank on measured days, what was written on others; the journal's coverage."""
        return {
            "days": self.timeline_days(drive, days), "summary": self.timeline_summary(drive, days), "contributors": self.timeline_contributors(drive, top), "written": self.timeline_written(drive, top), "coverage": self._coverage(drive_of(drive)),
        }

    def timeline_summary(self, drive=None, days=None) -> DataFrame:
        return T.summary(self.timeline_days(drive, days))

    def timeline_contributors(self, drive=None, top=None) -> DataFrame:
        drive = drive_of(drive)
        return T.contributors(T.deltas(self.snapshots_.where(F.col("drive") == drive), self.dirs, tz=self.tz), number(top, 5, 1, 50))

    def timeline_written(self, drive=None, top=None) -> DataFrame:
        """(day, rank, path, bytes): the largest of each creation day, from the newest snapshot's buckets."""
        return buckets.retro_contributors(self._of(self.buckets, self._newest(drive_of(drive))), number(top, 5, 1, 50))

    def tree(self, drive=None, path=None, limit=None, snapshot=None) -> dict[str, DataFrame]:
        """One level: the snapshot it is of (no row if there is none), the directory's own row, and its children."""
        drive, path = drive_of(drive), path_of(path)
        snapshot = number(snapshot, 0, 0, 1 << 62) or self._newest(drive)
        head = self.snapshots_.where(F.col("id") == snapshot if snapshot is not None else F.lit(False))
        if snapshot is not None and not head.limit(1).count():
            raise LookupError(f"no snapshot {snapshot}")
        dirs = self._of(self.dirs, snapshot)
        kids = tree.children(dirs, path, number(limit, 200, 1, 2000)).withColumn("name", P.basename("path", drive))
        return {"snapshot": head.withColumn("demoted", N.is_demoted()), "node": dirs.where(F.col("path") == path).withColumns({"name": P.basename("path", drive), "parent": P.parent("path")}), "children": kids}

    def hotspots(self, drive=None, limit=None) -> dict[str, DataFrame]:
        limit, newest = number(limit, 30, 1, 200), self._newest(drive_of(drive))
        dirs, files = self._of(self.dirs, newest), self._of(self.files, newest)
        return {
            "dirs": hotspots.biggest_dirs(dirs, limit), "files": hotspots.biggest_files(files, limit), "grown": hotspots.recently_grown(dirs, self.now, limit=limit), "cleanup": hotspots.cleanup_candidates(dirs, files, limit),
            "ages": buckets.age_profile(self._of(self.buckets, newest), self.now, self.tz),
        }

    def diff(self, drive=None, before=None, after=None, back=None, limit=None) -> dict[str, DataFrame] | None:
        """Two snapshots in order of time, or the newest and the back-th before it; None if there aren't so many. 0 is none given."""
        limit, before, after = number(limit, 40, 1, 500), number(before, 0, 0, 1 << 62), number(after, 0, 0, 1 << 62)
        if not before or not after:
            pair = N.back(self.snapshots_.where(F.col("drive") == drive_of(drive)), number(back, 1, 1, 1000)).first()
            if pair is None:
                return None
            before, after = pair.before_id, pair.after_id
        heads = {r.id: r for r in self.snapshots_.where(F.col("id").isin(before, after)).collect()}
        if len(heads) < len({before, after}):
            raise LookupError(f"no snapshot {before} or {after}")
        b, a = heads[before], heads[after]
        if b.drive != a.drive:
            raise ValueError(f"snapshots of two drives: {b.drive} and {a.drive}")
        if b.taken_at > a.taken_at:
            b, a = a, b
        return {
            "dirs": N.top_differences(N.diff_dirs(self.dirs, b.id, a.id), limit), "files": N.top_differences(N.diff_files(self.files, b.id, a.id), limit), "caveats": N.caveats(self.snapshots_, self.files, b.id, a.id, self.boundary),
            "snapshots": self.snapshots_.where(F.col("id").isin(b.id, a.id)).withColumns({"demoted": N.is_demoted(), "side": F.when(F.col("id") == b.id, "before").otherwise("after")}),
        }

    def snapshots(self, drive=None, limit=None) -> DataFrame:
        return N.listed(self.snapshots_, number(limit, 60, 1, 2000), drive_of(drive) if drive else None)

    def changes(self, drive=None, days=None, limit=None, kind=None) -> dict[str, DataFrame]:
        """What the journal saw of one kind, how far back it goes, and what the list can't say."""
        drive = drive_of(drive)
        rows = journal.changes(self.events, drive, self.now, number(days, 30, 1, 3650), number(limit, 200, 1, 5000), (kind or "").strip() or "delete")
        return {"events": rows, "coverage": self._coverage(drive), "quality": journal.quality(rows)}
