"""The change journal: events (drive, usn, timestamp, reason, is_dir, name, path, bytes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accretion.functions import paths as P
from accretion.functions import reasons as R
from accretion.functions import stamps as S

DAYS, TOP_N, LIMIT, KEEP_DAYS, ENRICH = 30, 5, 200, 180, 5000
#: Parts in which each drive's first events are looked for.
CUT_PARTS = 64
#: Seconds of the window in which a day's deletions are ranked; two hours of the next day are in it, too.
DAY_WINDOW = 86400 + 7200


def classified(events: DataFrame) -> DataFrame:
    return events.withColumns({"kind": R.kind("reason"), "reason_text": R.describe("reason")})


def stored(events: DataFrame, kinds: tuple[str, ...] = R.STORED_KINDS) -> DataFrame:
    """Events of the kinds that are kept; the mask is tested first, as it can reach the source."""
    return events.where(F.col("reason").bitwiseAND(F.lit(R.SPACE_MASK)) != 0).withColumn("kind", R.kind("reason")).where(F.col("kind").isin(*kinds))


def deduplicated(held: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """New events whose (drive, usn) isn't held, once each: the first by order, or any where rows are the same."""
    fresh = new.join(held.select("drive", "usn"), ["drive", "usn"], "left_anti")
    if order is None:
        return fresh.dropDuplicates(["drive", "usn"])
    w = Window.partitionBy("drive", "usn").orderBy(order)
    return fresh.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def resolved(events: DataFrame, dir_paths: DataFrame, looked_up: DataFrame | None = None) -> DataFrame:
    """events (…, parent_full, name) with path: by the parent's record, else by its full reference, else null.

    dir_paths (record, path) comes from a scan, looked_up (reference, path, and drive if there are several) from asking for
    references, where a null path means asked in vain.
    """
    out = events.join(dir_paths.select(F.col("record").alias("rec"), F.col("path").alias("p1")), R.record_number("parent_full") == F.col("rec"), "left")
    if looked_up is not None:
        several = "drive" in looked_up.columns
        asked = looked_up.select(F.col("reference").alias("ref"), F.col("path").alias("p2"), *([F.col("drive").alias("of")] if several else []))
        out = out.join(asked, (F.col("parent_full") == F.col("ref")) & (F.col("drive") == F.col("of") if several else F.lit(True)), "left")
    above = F.coalesce("p1", "p2") if looked_up is not None else F.col("p1")
    path = F.when(above.isNotNull(), F.when(above == "", F.col("name")).otherwise(F.concat(above, F.lit(P.SEP), "name")))
    return out.withColumn("path", path).drop("rec", "ref", "p1", "p2", "of")


def cursor_plan(cursors: DataFrame, journals: DataFrame) -> DataFrame:
    """(drive, start_usn, first_run, journal_reset): where reading each journal goes on."""
    out = journals.join(cursors.select("drive", F.col("journal_id").alias("known_id"), F.col("next_usn").alias("known_next")), "drive", "left")
    first = F.col("known_id").isNull()
    reset = ~first & ((F.col("known_id") != F.col("journal_id")) | (F.col("known_next") < F.col("lowest_valid_usn")))
    return out.select("drive", F.when(first | reset, F.col("lowest_valid_usn")).otherwise(F.col("known_next")).alias("start_usn"), first.alias("first_run"), reset.alias("journal_reset"))


def arrivals(readings: DataFrame, plan: DataFrame, held: DataFrame, now: float, dir_paths: DataFrame | None = None, looked_up: DataFrame | None = None, kinds: tuple[str, ...] = R.STORED_KINDS) -> DataFrame:
    """What a reading adds to the events held: (drive, usn, timestamp, reason, kind, is_dir, name, path, bytes).

    readings has (drive, usn, timestamp, reason, is_dir, name), and path or parent_full or neither; plan is cursor_plan()'s.
    An event without a time gets now; one whose (drive, usn) is held, of whatever journal, is not added.
    """
    new = stored(readings.join(plan.select("drive", "start_usn"), "drive").where(F.col("usn") >= F.col("start_usn")).drop("start_usn"), kinds)
    if "path" not in new.columns and "parent_full" in new.columns and dir_paths is not None:
        new = resolved(new, dir_paths, looked_up)
    more = {c: F.lit(None).cast(k) for c, k in (("path", "string"), ("bytes", "long")) if c not in new.columns}
    new = new.withColumns(more | {"timestamp": F.coalesce("timestamp", F.lit(float(now)))})
    # nothing before the start can be among what is read
    old = held.join(plan.select("drive", "start_usn"), "drive").where(F.col("usn") >= F.col("start_usn"))
    return deduplicated(old, new).select("drive", "usn", "timestamp", "reason", "kind", "is_dir", "name", "path", "bytes")


def cursors_after(readings: DataFrame, plan: DataFrame, journals: DataFrame, now: float) -> DataFrame:
    """(drive, journal_id, next_usn, updated_at): behind the last event read, or where reading began if there was none."""
    last = readings.join(plan.select("drive", "start_usn"), "drive").where(F.col("usn") >= F.col("start_usn")).groupBy("drive").agg((F.max("usn") + 1).alias("after"))
    out = plan.join(journals.select("drive", "journal_id"), "drive").join(last, "drive", "left")
    return out.select("drive", "journal_id", F.coalesce("after", "start_usn").alias("next_usn"), F.lit(float(now)).alias("updated_at"))


def within(events: DataFrame, now: float, days: int) -> DataFrame:
    return events.where(F.col("timestamp") >= now - days * 86400)


def unexpired(events: DataFrame, now: float, keep_days: int = KEEP_DAYS, tz: str = "UTC") -> DataFrame:
    """Events from the local midnight keep_days ago on."""
    midnight = S.day_start(F.date_format(F.date_sub(F.to_date(S.day(F.lit(float(now)), tz)), keep_days), "yyyy-MM-dd"), 0, tz)
    return events.where(F.col("timestamp") >= midnight)


def _unknown(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == 0)


def daily(events: DataFrame, now: float, days: int = DAYS, tz: str = "UTC") -> DataFrame:
    """(drive, day, created, deleted, renamed, written, deleted_bytes_known, deleted_bytes_unknown_files)."""
    rows = within(events, now, days).withColumn("day", S.day("timestamp", tz)).where("day IS NOT NULL")
    is_ = lambda *k: F.col("kind").isin(*k)
    return rows.groupBy("drive", "day").agg(
        F.count_if(is_("create")).alias("created"), F.count_if(is_("delete")).alias("deleted"), F.count_if(is_("rename_old", "rename_new")).alias("renamed"), F.count_if(is_("write")).alias("written"),
        F.coalesce(F.sum(F.when(is_("delete"), F.col("bytes"))), F.lit(0)).alias("deleted_bytes_known"), F.count_if(is_("delete") & _unknown("bytes")).alias("deleted_bytes_unknown_files"),
    )


def _each_path(*keys: str):
    """Events of one path are one thing; those without a path are one each."""
    return [*keys, "path", F.when(F.col("path").isNull() | (F.col("path") == ""), F.col("usn")).otherwise(F.lit(0)).alias("own")]


def _last(c: str) -> Column:
    return F.max_by(c, F.struct("timestamp", "usn"))


def top_deleted(events: DataFrame, now: float, days: int = DAYS, top_n: int = TOP_N, tz: str = "UTC") -> DataFrame:
    """(drive, day, rank, path, bytes, is_dir, at, count) of each day's largest deletions.

    A day's window is 26 hours from its midnight, so an event just after midnight is looked at for two days. Days are
    those that daily() has deletions for.
    """
    gone = events.where("kind = 'delete'")
    day = S.day("timestamp", tz)
    start = lambda d: S.day_start(d, 0, tz)
    before = F.date_format(F.date_sub(F.to_date(day), 1), "yyyy-MM-dd")
    windows = F.array_compact(F.array(day, F.when(F.col("timestamp") < start(before) + DAY_WINDOW, before)))
    rows = gone.where(day.isNotNull()).select("*", F.explode(windows).alias("day"))
    listed = within(gone, now, days).select("drive", day.alias("day")).distinct()
    rows = rows.join(listed, ["drive", "day"], "left_semi")
    groups = rows.groupBy(*_each_path("drive", "day")).agg(F.max("bytes").alias("bytes"), _last("is_dir").alias("is_dir"), F.max("timestamp").alias("at"), F.count(F.lit(1)).alias("count"), _last("name").alias("name"))
    order = Window.partitionBy("drive", "day").orderBy(F.desc(F.coalesce("bytes", F.lit(0))), F.desc("at"), "path", "own")
    out = groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    shown = F.when(F.col("path").isNull() | (F.col("path") == ""), F.col("name")).otherwise(F.col("path"))
    return out.select("drive", "day", "rank", shown.alias("path"), "bytes", "is_dir", "at", "count")


def changes(events: DataFrame, drive: str, now: float, days: int = DAYS, limit: int = LIMIT, kind: str = "delete") -> DataFrame:
    """(usn, at, kind, is_dir, name, path, bytes, count) of one kind, largest first, those with a path before those without."""
    rows = within(events, now, days).where((F.col("drive") == drive) & (F.col("kind") == kind))
    groups = rows.groupBy(*_each_path("kind")).agg(F.max("usn").alias("usn"), F.max("timestamp").alias("at"), _last("is_dir").alias("is_dir"), _last("name").alias("name"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("count"))
    known = F.col("path").isNotNull() & (F.col("path") != "")
    out = groups.orderBy(F.desc(F.coalesce("bytes", F.lit(0))), F.desc(known), F.desc("at"), "path", "usn").limit(limit)
    return out.select("usn", "at", "kind", "is_dir", "name", "path", "bytes", "count")


def quality(rows: DataFrame) -> DataFrame:
    """What a list of changes can't say: (unknown_size, no_path)."""
    return rows.agg(F.count_if(F.col("bytes").isNull()).alias("unknown_size"), F.count_if(F.col("path").isNull() | (F.col("path") == "")).alias("no_path"))


def coverage(events: DataFrame, status: DataFrame, tz: str = "UTC") -> DataFrame:
    """(drive, events, first_day, last_day, days, available, reason): available is null for a drive never read."""
    seen = events.groupBy("drive").agg(F.count(F.lit(1)).alias("events"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    out = seen.join(status.select("drive", "available", "reason"), "drive", "full_outer").withColumns({"first_day": S.day("lo", tz), "last_day": S.day("hi", tz)})
    span = F.datediff(F.to_date("last_day"), F.to_date("first_day")) + 1
    return out.select("drive", F.coalesce("events", F.lit(0)).alias("events"), "first_day", "last_day", F.coalesce(span, F.lit(0)).cast("long").alias("days"), "available", "reason")


def _cuts(wanted: DataFrame, limit: int) -> DataFrame:
    """(drive, last): the limit-th usn of each drive's rows, in two steps, so that no task sorts a drive's whole journal."""
    some = wanted.select("drive", "usn", F.pmod(F.xxhash64("usn"), F.lit(CUT_PARTS)).alias("part"))
    for keys in (["drive", "part"], ["drive"]):
        some = some.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("usn"))).where(F.col("nth") <= limit).drop("nth")
    return some.groupBy("drive").agg(F.max("usn").alias("last"))


def enriched(events: DataFrame, files: DataFrame, snapshots: DataFrame, limit: int | None = ENRICH) -> DataFrame:
    """Events with sizes of deleted files where they are unknown: that of the path in the drive's newest snapshot that has it.

    Incomplete snapshots and later ones than the event count, too. At most limit events of each drive are looked at, in
    order of usn. Only those are joined, and of the files only those with their paths are compared.
    """
    wants = F.coalesce((F.col("kind") == "delete") & F.col("bytes").isNull() & F.col("path").isNotNull() & ~F.col("is_dir"), F.lit(False))
    marked = events.withColumn("looked", wants)
    if limit is not None:
        marked = marked.join(_cuts(events.where(wants), limit), "drive", "left").withColumn("looked", F.col("looked") & (F.col("usn") <= F.col("last")))
    looked = marked.where("looked").select(*events.columns)
    heads = snapshots.select(F.col("id").alias("snapshot_id"), "drive", "taken_at")
    same = files.select("snapshot_id", "path", F.col("bytes").alias("found")).join(heads, "snapshot_id").join(looked.select("drive", "path").distinct(), ["drive", "path"], "left_semi")
    sizes = same.groupBy("drive", "path").agg(F.max_by("found", F.struct("taken_at", "snapshot_id")).alias("found"))
    known = looked.join(sizes, ["drive", "path"], "left").select(*[F.col("found").alias(c) if c == "bytes" else F.col(c) for c in events.columns])
    return marked.where(~F.col("looked")).select(*events.columns).unionByName(known)


def kept_last(held: DataFrame, new: DataFrame, order: str = "updated_at") -> DataFrame:
    """One row for each drive after an upsert: the latest; of equally late ones the new one."""
    both = held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("drive").agg(F.max_by(F.struct(*held.columns), F.struct(order, "_new")).alias("s")).select("s.*")


def read_outcome(drive: str, at: float, error: str | None = None) -> tuple:
    """(drive, available, reason, updated_at) of a reading: a success clears what failed before."""
    return drive, error is None, error, at


def references_to_ask(events: DataFrame, dir_paths: DataFrame, asked: DataFrame) -> DataFrame:
    """(reference) of parents that neither a scan nor an earlier question knows, each once; what was asked in vain isn't asked again."""
    refs = events.select("parent_full").distinct()
    refs = refs.join(dir_paths.select(F.col("record").alias("rec")), R.record_number("parent_full") == F.col("rec"), "left_anti")
    return refs.join(asked.select(F.col("reference").alias("ref")), F.col("parent_full") == F.col("ref"), "left_anti").select(F.col("parent_full").alias("reference"))


def collected(batch: DataFrame) -> DataFrame:
    """Counts of one reading by drive: (events_read, first_usn, last_usn, no_time)."""
    return batch.groupBy("drive").agg(F.count(F.lit(1)).alias("events_read"), F.min("usn").alias("first_usn"), F.max("usn").alias("last_usn"), F.count_if(F.col("timestamp").isNull()).alias("no_time"))
