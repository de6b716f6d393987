"""Snapshots and journal events kept as partitioned Parquet, in generations (manifest.py).

A scan's rows and its row in `snapshots` become visible in one change, and so do a reading's events, cursor and status; thinning
out, dropping, merging and repairing replace parts by new ones in one change each. Nothing is overwritten: whatever fails, and
wherever, leaves what was, and only folders that the sweep takes later.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accretion import files
from accretion.functions import stamps as S
from accretion.scratch import saved

from . import buckets as B
from . import journal as J
from . import snapshots as N
from . import tree
from .manifest import GRACE, Conflict, Part, Tables

EVENTS = "drive string, usn long, timestamp double, reason long, kind string, is_dir boolean, name string, path string, bytes long"
#: Each table's columns, without the keys of its folders.
SCHEMAS = {
    "dirs": "path string, depth int, bytes long, own_bytes long, files long, dirs long, newest_mtime double, newest_ctime double, folded_children long, folded_bytes long",
    "files": "path string, bytes long, mtime double, ctime double",
    "age_buckets": "day string, attribution string, bytes long, files long",
    "events": EVENTS,
    "snapshots": "id long, drive string, taken_at double, method string, complete boolean, note string, scanned_bytes long, file_count long, dir_count long",
    "cursors": "drive string, journal_id long, next_usn long, updated_at double",
    "status": "drive string, available boolean, reason string, updated_at double",
    "references": "drive string, reference long, path string, asked_at double",
    "progress": "name string, state string, batches long, rows long, position string, metrics string, reason string, updated_at double",
    "meta": "key string, value string",
}
#: Keys of the tables with a folder for each snapshot. Where a column has a key's name, the key is the column.
TABLES = ("dirs", "files", "age_buckets")
KEYS = {t: [("drive", "string"), ("snapshot_id", "long")] for t in TABLES} | {"events": [("drive", "string"), ("day", "string")], "references": [("drive", "string")]}
#: What rows are sorted by, so that footers and page indexes tell where a level or a path lies.
ORDER = {"dirs": ["depth", "path"], "files": ["path"], "age_buckets": ["day", "attribution"], "events": ["usn"], "references": ["reference"]}
#: Row groups are small, and single paths are found by Bloom filters.
LAYOUT = {"dirs": {"parquet.block.size": str(1 << 20), "parquet.bloom.filter.enabled#path": "true"}}
#: Stamps of these columns are repaired; RULES is the repair that today's rows need no more.
STAMPS, RULES = {"dirs": ["newest_mtime", "newest_ctime"], "files": ["mtime", "ctime"]}, 1
#: Seconds for which a reference's path, and the answer that it has none, are believed.
BELIEVED, BELIEVED_NONE = 30 * 86400, 86400
#: A folder's parts are merged when there are so many.
MOST_PARTS = 8

log = logging.getLogger(__name__)


def snapshot_id(drive: str, taken_at: float) -> int:
    """Grows with time, in milliseconds, and differs by drive."""
    return int(taken_at * 1000) * 32 + (ord(drive[:1].upper() or "@") & 31)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        columns = {t: ", ".join(c for c in s.split(", ") if c.split()[0] not in {k for k, _ in KEYS.get(t, ())}) for t, s in SCHEMAS.items()}
        self.tables = Tables(spark, root, columns, KEYS)

    def read(self, table: str, **keys) -> DataFrame:
        """A table's rows; keys: only of folders with these values, which are told without listing any."""
        return self.tables.rows(table, self.tables.manifest().of(table, **keys))

    def snapshots(self) -> DataFrame:
        return self.read("snapshots")

    def _write(self, rows: DataFrame, table: str, **facts) -> list[Part]:
        """The parts of rows, in the table's order."""
        order = [k for k, _ in KEYS.get(table, ())] + ORDER[table]
        return self.tables.write(rows.repartitionByRange(*order).sortWithinPartitions(*order), table, LAYOUT.get(table), **({"rules": RULES} | facts))

    def commit(self, entries: DataFrame, snapshot_id: int, drive: str, taken_at: float, method: str, note: str | None = None, limits: dict | None = None) -> None:
        """Roll entries up and keep them as a snapshot, in place of one with this id. limits: keyword arguments of prune, select_files and age_buckets."""
        limits = limits or {}
        tag = {"drive": F.lit(drive), "snapshot_id": F.lit(snapshot_id).cast("long")}
        # used many times, and sorting by range reads its rows twice: each is made once, and is a table from then on
        entries = saved(entries, "entries")
        dirs = saved(tree.prune(saved(tree.rollup(entries, taken_at), "rollup"), **limits.get("prune", {})), "dirs")
        parts = self._write(dirs.withColumns(tag), "dirs")
        # entries that repeat a path are one file, the largest
        once = entries.where("NOT is_dir").groupBy("path").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "path"]), "bytes").alias("row")).select("path", "row.*")
        chosen = saved(tree.select_files(once, taken_at, **limits.get("select_files", {})), "files")
        parts += self._write(chosen.withColumns(tag), "files")
        buckets = saved(B.age_buckets(entries, **limits.get("age_buckets", {})), "buckets")
        parts += self._write(buckets.withColumns(tag), "age_buckets")
        head = tree.totals(entries).select(
            F.lit(snapshot_id).cast("long").alias("id"), F.lit(drive).alias("drive"), F.lit(float(taken_at)).alias("taken_at"), F.lit(method).alias("method"), F.lit(True).alias("complete"), F.lit(note).cast("string").alias("note"),
            F.col("total_bytes").alias("scanned_bytes"), "file_count", "dir_count",
        )
        head = self._held(head)
        before = [p for t in TABLES for p in self.tables.manifest().of(t, drive=drive, snapshot_id=snapshot_id)]
        self.tables.swap(parts, before, {"snapshots": lambda held: held.where(F.col("id") != snapshot_id).unionByName(head)})

    def _held(self, rows: DataFrame) -> DataFrame:
        """A few rows as they are now."""
        return self.spark.createDataFrame(rows.collect(), rows.schema)

    def _of(self, ids: list[int], tables=TABLES) -> list[Part]:
        return [p for t in tables for p in self.tables.manifest().of(t, snapshot_id=ids)]

    def demote(self, drive: str, keep_id: int) -> int:
        """Thin out the drive's other snapshots, once each; how many there were."""
        ids = [r.id for r in N.to_demote(self.snapshots(), drive, keep_id).collect()]  # one number for each snapshot of a drive
        if ids:
            before = self._of(ids, ("dirs",))
            thinner = self._write(N.demote_dirs(self.tables.rows("dirs", before), ids), "dirs", rules=min((p.facts.get("rules", 0) for p in before), default=RULES))
            self.tables.swap(thinner, before + self._of(ids, ("files",)), {"snapshots": lambda held: N.marked_demoted(held, ids)})
        return len(ids)

    def retain(self, now: float, keep_daily: int = N.KEEP_DAILY) -> int:
        """Drop what retention() doesn't keep; how many."""
        gone = [r.id for r in N.retention(self.snapshots(), now, keep_daily).where("NOT keep").collect()]  # one number for each dropped snapshot
        if gone:
            self.tables.swap(drop=self._of(gone), small={"snapshots": lambda held: held.where(~F.col("id").isin(gone))})
        return len(gone)

    def drop_old_buckets(self, drive: str) -> None:
        """Buckets are only read of the newest snapshot."""
        ids = [r.id for r in self.snapshots().where(F.col("drive") == drive).select("id", "taken_at").orderBy(F.desc("taken_at")).collect()[1:]]
        if old := self._of(ids, ("age_buckets",)):
            self.tables.swap(drop=old)

    def compact(self, table: str, most: int = MOST_PARTS) -> int:
        """Merge the parts of each folder that has so many; how many folders."""
        of: dict[tuple, list[Part]] = {}
        for p in self.tables.manifest().of(table):
            of.setdefault(tuple(sorted(p.keys.items())), []).append(p)
        many = [parts for parts in of.values() if len(parts) >= most]
        if many:
            before = [p for parts in many for p in parts]
            self.tables.swap(self._write(self.tables.rows(table, before), table, rules=min(p.facts.get("rules", 0) for p in before)), before)
        return len(many)

    # -- what the manifest knows of parts

    def adopt(self, table: str, rows: DataFrame) -> int:
        """Take in a table of rows from elsewhere, keys included, as they are: repair() looks at them later. How many parts."""
        if table in KEYS:
            parts = self._write(rows, table, rules=0)
            self.tables.swap(parts)
            return len(parts)
        fixed = self._held(rows.select(*self.tables.schema(table).names))
        self.tables.swap(small={table: lambda held: held.unionByName(fixed)})
        return 1

    def repair(self) -> int:
        """Repair the stamps of parts that no repair has seen, a snapshot at a time; how many parts.

        Each snapshot's parts are swapped in by themselves with the mark that they are done, so that a run that is cut off
        goes on where it was.
        """
        done = 0
        for table, columns in STAMPS.items():
            todo = [p for p in self.tables.manifest().of(table) if p.facts.get("rules", 0) < RULES]
            for keys in sorted({tuple(sorted(p.keys.items())) for p in todo}):
                before = [p for p in todo if tuple(sorted(p.keys.items())) == keys]
                self.tables.swap(self._write(N.repaired(self.tables.rows(table, before), self.snapshots(), columns), table), before)
                done += len(before)
        return done

    def analyze(self, table: str) -> int:
        """Note rows, files, bytes and the bounds of the columns that rows are sorted by with each part that lacks them; how many parts."""
        parts = [p for p in self.tables.manifest().of(table) if "rows" not in p.facts]
        if not parts:
            return 0
        order = ORDER.get(table, [])
        rows = self.spark.read.schema(self.tables.schema(table)).parquet(*[f"{self.root}/{p.path}" for p in parts]) if table not in KEYS else self._located(table, parts)
        file = F.col("_metadata.file_path")
        found = rows.groupBy(F.regexp_extract(file, r"(generation=.*)/[^/]*$", 1).alias("part")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct(file).alias("files"), F.sum_distinct(F.col("_metadata.file_size")).alias("bytes"), *[f(c).cast("string").alias(f"{n}_{c}") for c in order for n, f in (("least", F.min), ("most", F.max))]
        )
        # a row for each part; its path there is a URI
        known = {files.unescaped(self.spark, r.part): {k: v for k, v in r.asDict().items() if k != "part"} for r in found.collect()}
        told = [p.but(**known.get(p.path.split("/", 1)[1], {"rows": 0, "files": 0, "bytes": 0})) for p in parts]
        self.tables.swap(told, parts)
        return len(parts)

    def _located(self, table: str, parts: list[Part]) -> DataFrame:
        schema = self.tables.schema(table).add("generation", "string")
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{p.path}" for p in parts])

    def statistics(self) -> DataFrame:
        """(table, path, rows, files, bytes) of all parts, as analyze() found them."""
        rows = [(p.table, p.path, *(p.facts.get(k) for k in ("rows", "files", "bytes"))) for p in self.tables.manifest().parts]
        return self.spark.createDataFrame(rows, "table string, path string, rows long, files long, bytes long")

    # -- the journal

    def events(self) -> DataFrame:
        return self.read("events").select(*[c.split()[0] for c in EVENTS.split(", ")])

    def cursors(self) -> DataFrame:
        return self.read("cursors")

    def status(self) -> DataFrame:
        """How the last reading of each drive's journal went; a drive never read has no row."""
        return self.read("status")

    def collect(self, readings: DataFrame, journals: DataFrame, now: float, dir_paths: DataFrame | None = None, looked_up: DataFrame | None = None, keep_days: int = J.KEEP_DAYS, tz: str = "UTC", resolvers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> dict[str, dict]:
        """Take in what journals have: their new events, their cursors and how it went; counts for each drive.

        journals has a row for each drive asked: (drive, journal_id, lowest_valid_usn, available, reason). One that
        couldn't be read only leaves its reason; its events and its cursor stay as they are. Conflict if another reading of
        one of these drives came in meanwhile. resolvers: for a drive, what gives (reference, path) of the references that
        neither dir_paths nor an earlier answer knows.
        """
        able = journals.where("available")
        # a row for each drive: what reading was planned from
        before = self._held(self.cursors())
        plan = self._held(J.cursor_plan(before, able))
        answers: list[Part] = []
        if resolvers and "parent_full" in readings.columns:
            if dir_paths is None:
                dir_paths = self.spark.createDataFrame([], "record long, path string")
            answers, looked_up = self._asked(readings.join(plan.select("drive", "start_usn"), "drive").where(F.col("usn") >= F.col("start_usn")), dir_paths, now, resolvers)
        new = J.arrivals(readings, plan, self.events(), now, dir_paths, looked_up)
        if self.tables.manifest().of("files"):
            new = J.enriched(new, self.read("files"), self.snapshots())
        day = F.coalesce(S.day("timestamp", tz), F.lit("none"))
        parts = self._write(new.withColumn("day", day), "events")
        cursors = self._held(J.cursors_after(readings, plan, able, now))
        status = self._held(journals.select("drive", "available", F.when(~F.col("available"), F.col("reason")).alias("reason"), F.lit(float(now)).alias("updated_at")))

        def moved(held: DataFrame) -> DataFrame:
            if held.join(able, "drive", "left_semi").exceptAll(before).count():
                raise Conflict("another reading came first")
            return J.kept_last(held, cursors)

        self.tables.swap(parts + answers, small={"cursors": moved, "status": lambda held: J.kept_last(held, status)})
        counts = J.collected(readings.join(plan.select("drive", "start_usn"), "drive").where(F.col("usn") >= F.col("start_usn")))
        out = {r.drive: r.asDict() for r in plan.join(counts, "drive", "left").collect()}
        self.prune_events(now, keep_days, tz)
        return out

    def references(self, now: float) -> DataFrame:
        """(drive, reference, path): the last answers that are still believed."""
        last = self.read("references").groupBy("drive", "reference").agg(F.max_by(F.struct("path", "asked_at"), "asked_at").alias("a")).select("drive", "reference", "a.*")
        return last.where(F.col("asked_at") >= now - F.when(F.col("path").isNotNull(), BELIEVED).otherwise(BELIEVED_NONE)).drop("asked_at")

    def _asked(self, readings: DataFrame, dir_paths: DataFrame, now: float, resolvers: dict) -> tuple[list[Part], DataFrame]:
        """(parts of new answers, all answers): each reference that the kept events have is asked for once."""
        known, parts = self.references(now), []
        for drive, resolve in resolvers.items():
            own = J.stored(readings).where((F.col("drive") == drive) & F.col("parent_full").isNotNull())
            ask = J.references_to_ask(own, dir_paths, known.where(F.col("drive") == drive))
            parts += self._write(resolve(ask).select(F.lit(drive).alias("drive"), "reference", "path", F.lit(float(now)).alias("asked_at")), "references")
        return parts, known.unionByName(self.tables.rows("references", parts).drop("asked_at"))

    def prune_events(self, now: float, keep_days: int = J.KEEP_DAYS, tz: str = "UTC") -> int:
        """Drop the days before the one keep_days ago, which are folders; how many."""
        first = self.spark.range(1).select(F.date_format(F.date_sub(F.to_date(S.day(F.lit(float(now)), tz)), keep_days), "yyyy-MM-dd")).first()[0]
        gone = [p for p in self.tables.manifest().of("events") if p.keys["day"][:4].isdigit() and p.keys["day"] < first]
        if gone:
            self.tables.swap(drop=gone)
        return len({(p.keys["drive"], p.keys["day"]) for p in gone})

    def maintain(self, drive: str, keep_id: int, now: float, grace: float = GRACE) -> dict[str, str]:
        """What follows a scan: thin out, drop, merge, repair, note statistics, sweep. A step that fails takes nothing else with it; why it did, by step."""
        failed = {}
        steps = {
            "demote": lambda: self.demote(drive, keep_id), "buckets": lambda: self.drop_old_buckets(drive), "retain": lambda: self.retain(now), "events": lambda: self.prune_events(now), "repair": self.repair,
            "compact": lambda: [self.compact(t) for t in KEYS], "analyze": lambda: [self.analyze(t) for t in KEYS], "sweep": lambda: self.tables.sweep(grace),
        }
        for name, step in steps.items():
            try:
                step()
            except Exception as error:
                log.exception("upkeep of %s: %s failed", self.root, name)
                failed[name] = str(error).splitlines()[0]
        return failed

    def rules_boundary(self) -> int:
        """The first snapshot id that counts bytes by today's rules: set once, to one more than any id there was."""
        found = self.read("meta").where("key = 'byte_rules'").first()
        if found is None:
            top = self.snapshots().agg(F.max("id")).first()[0]
            new = self.spark.createDataFrame([("byte_rules", str((top or 0) + 1))], SCHEMAS["meta"])
            self.tables.swap(small={"meta": lambda held: held.unionByName(new.join(held, "key", "left_anti"))})
            found = self.read("meta").where("key = 'byte_rules'").first()
        return int(found.value)

    def size(self) -> int:
        """Bytes of all that counts."""
        return sum(p.facts.get("bytes") or files.size(self.spark, f"{self.root}/{p.path}") for p in self.tables.manifest().parts)
