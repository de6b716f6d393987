"""Snapshots over time: listing, pairs, differences, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accretion.functions import stamps as S

DEMOTED = "[已降级]"  # a fixed value: the mark in a snapshot's note
DEMOTE_DEPTH, DEMOTE_BYTES, DIFF_DEPTH, DIFF_BYTES, KEEP_DAILY = 3, 64 << 20, 4, 1 << 20, 120


def is_demoted(note: str = "note"):
    return F.contains(F.coalesce(note, F.lit("")), F.lit(DEMOTED))


def listed(snapshots: DataFrame, limit: int = 400, drive: str | None = None) -> DataFrame:
    """Complete snapshots, newest first, with whether they are demoted."""
    rows = snapshots.where("complete")
    rows = rows.where(F.col("drive") == drive) if drive else rows
    return rows.withColumn("demoted", is_demoted()).orderBy(F.desc("taken_at"), F.desc("id")).limit(limit)


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest complete snapshot of each drive."""
    order = Window.partitionBy("drive").orderBy(F.desc("taken_at"), F.desc("id"))
    return snapshots.where("complete").withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def pairs(snapshots: DataFrame) -> DataFrame:
    """(drive, before_id, after_id, before_at, after_at, net) of consecutive complete snapshots."""
    order = Window.partitionBy("drive").orderBy("taken_at", "id")
    was = lambda c: F.lag(c).over(order)
    out = snapshots.where("complete").select(
        "drive", was("id").alias("before_id"), F.col("id").alias("after_id"), was("taken_at").alias("before_at"), F.col("taken_at").alias("after_at"), (F.col("scanned_bytes") - was("scanned_bytes")).alias("net")
    )
    return out.where("before_id IS NOT NULL")


def back(snapshots: DataFrame, n: int = 1) -> DataFrame:
    """(drive, before_id, after_id): the newest complete snapshot and the n-th before it, for drives that have both."""
    order = Window.partitionBy("drive").orderBy(F.desc("taken_at"), F.desc("id"))
    rows = snapshots.where("complete").withColumn("rn", F.row_number().over(order)).where(F.col("rn").isin(1, n + 1))
    both = rows.groupBy("drive").agg(F.max(F.when(F.col("rn") == n + 1, F.col("id"))).alias("before_id"), F.max(F.when(F.col("rn") == 1, F.col("id"))).alias("after_id"))
    return both.where("before_id IS NOT NULL")


def differences(before: DataFrame, after: DataFrame, min_bytes: int = DIFF_BYTES) -> DataFrame:
    """(path, before, after, delta, kind) of two (path, bytes): appeared, vanished, grew or shrank by min_bytes at least."""
    b, a = before.select("path", F.col("bytes").alias("b")), after.select("path", F.col("bytes").alias("a"))
    delta = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    kind = F.when(F.col("b").isNull(), "appeared").when(F.col("a").isNull(), "vanished").when(F.col("a") > F.col("b"), "grew").otherwise("shrank")
    out = b.join(a, "path", "full_outer").where(F.abs(delta) >= min_bytes)
    return out.select("path", F.coalesce("b", F.lit(0)).alias("before"), F.coalesce("a", F.lit(0)).alias("after"), delta.alias("delta"), kind.alias("kind"))


def diff_dirs(dirs: DataFrame, before_id: int, after_id: int, max_depth: int = DIFF_DEPTH, min_bytes: int = DIFF_BYTES) -> DataFrame:
    rows = dirs.where(F.col("depth").between(1, max_depth))
    return differences(rows.where(F.col("snapshot_id") == before_id), rows.where(F.col("snapshot_id") == after_id), min_bytes)


def diff_files(files: DataFrame, before_id: int, after_id: int, min_bytes: int = DIFF_BYTES) -> DataFrame:
    """As differences(); nothing unless both snapshots have files."""
    b, a = files.where(F.col("snapshot_id") == before_id), files.where(F.col("snapshot_id") == after_id)
    have = files.where(F.col("snapshot_id").isin(before_id, after_id)).agg(F.count_distinct("snapshot_id").alias("sides"))
    return differences(b, a, min_bytes).join(F.broadcast(have), F.col("sides") == (1 if before_id == after_id else 2)).drop("sides")


def top_differences(rows: DataFrame, limit: int = 40) -> DataFrame:
    """The largest growths and the largest losses: (direction, rank, ...)."""
    both = rows.where("delta <> 0").withColumn("direction", F.when(F.col("delta") > 0, "grown").otherwise("shrunk"))
    order = Window.partitionBy("direction").orderBy(F.desc(F.abs("delta")), "path")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def inserted(held: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Rows after an insert that keeps what is there: those held, and of the new ones with other keys the first by order."""
    first = new.join(held.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min_by(F.struct(*new.columns), order).alias("row")).select("row.*")
    return held.unionByName(first)


def caveats(snapshots: DataFrame, files: DataFrame, before_id: int, after_id: int, boundary: int | None = None) -> DataFrame:
    """(ordinal, code, n, depth, bytes, before_method, after_method) of what to keep in mind when two snapshots are compared.

    depth and bytes say what demoted snapshots have lost: what is deeper and smaller. boundary is the first id that counts
    bytes by today's rules.
    """
    head = snapshots.where(F.col("id").isin(before_id, after_id)).agg(
        F.count_if(is_demoted()).alias("n"), F.max(F.when(F.col("id") == before_id, F.col("method"))).alias("bm"), F.max(F.when(F.col("id") == after_id, F.col("method"))).alias("am")
    )
    sides = files.where(F.col("snapshot_id").isin(before_id, after_id)).agg(F.count_distinct("snapshot_id").alias("sides"))
    crossed = F.lit(boundary is not None and before_id < boundary <= after_id)
    none = F.lit(None).cast("string")
    one = lambda i, test, code, n=None, bm=none, am=none: F.when(test, F.struct(F.lit(i).alias("ordinal"), F.lit(code).alias("code"), (n if n is not None else F.lit(None)).cast("long").alias("n"), F.lit(DEMOTE_DEPTH if code == "demoted" else None).cast("long").alias("depth"), F.lit(DEMOTE_BYTES if code == "demoted" else None).cast("long").alias("bytes"), bm.alias("before_method"), am.alias("after_method")))
    found = F.array(
        one(1, F.col("n") > 0, "demoted", F.col("n")), one(2, F.col("bm") != F.col("am"), "mixedMethod", None, F.col("bm"), F.col("am")), one(3, (F.col("bm") == "mft") & (F.col("am") == "mft") & crossed, "rulesChanged", None, F.col("bm"), F.col("am")),
        one(4, F.col("sides") == 0, "noFilesEitherSide"), one(5, F.col("sides") == 1, "noFilesOneSide"), one(6, F.col("sides") == 2, "fileThreshold"),
    )
    return head.join(F.broadcast(sides), F.lit(True)).select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.*")


def retention(snapshots: DataFrame, now: float, keep_daily: int = KEEP_DAILY, tz: str = "UTC") -> DataFrame:
    """(drive, id, keep): the last of each day for keep_daily days, then the last of each month. Incomplete ones count, too."""
    recent = F.col("taken_at") >= now - keep_daily * 86400
    slot = F.when(recent, F.date_format(S.clock("taken_at", tz), "yyyy-MM-dd")).otherwise(F.date_format(S.clock("taken_at", tz), "yyyy-MM"))
    order = Window.partitionBy("drive", "slot").orderBy(F.desc("taken_at"), F.desc("id"))
    return snapshots.withColumn("slot", slot).select("drive", "id", (F.row_number().over(order) == 1).alias("keep"))


def demote_dirs(dirs: DataFrame, ids: list[int], max_depth: int = DEMOTE_DEPTH, min_bytes: int = DEMOTE_BYTES) -> DataFrame:
    """dirs without the deep and small ones of the snapshots that are demoted."""
    return dirs.where(~(F.col("snapshot_id").isin(ids) & (F.col("depth") > max_depth) & (F.col("bytes") < min_bytes)))


def marked_demoted(snapshots: DataFrame, ids: list[int]) -> DataFrame:
    note = F.when(F.col("id").isin(ids) & ~is_demoted(), F.concat(F.coalesce(F.concat("note", F.lit(" ")), F.lit("")), F.lit(DEMOTED))).otherwise(F.col("note"))
    return snapshots.withColumn("note", note)


def to_demote(snapshots: DataFrame, drive: str, keep_id: int) -> DataFrame:
    """(id) of a drive's other snapshots that aren't demoted yet."""
    return snapshots.where((F.col("drive") == drive) & (F.col("id") != keep_id) & ~is_demoted()).select("id")


def repaired(rows: DataFrame, snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """Stamps before 1970 or more than two days after their own snapshot become null."""
    top = snapshots.select(F.col("id").alias("snapshot_id"), S.ceiling(F.col("taken_at")).alias("top"))
    out = rows.join(top, "snapshot_id", "left")
    bad = lambda c: F.col(c).isNotNull() & F.col("top").isNotNull() & (F.isnan(F.col(c).cast("double")) | (F.col(c) > F.col("top")) | (F.col(c) < S.LEAST))
    return out.select(*[F.when(~bad(c), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def drive_status(snapshots: DataFrame, events: DataFrame, defaults: list[str]) -> DataFrame:
    """(ordinal, drive, snapshots, latest_id, latest_at, events): known drives first, then defaults, once each."""
    spark = snapshots.sparkSession
    known = snapshots.select("drive").distinct().withColumn("source", F.lit(0)).withColumn("place", F.lit(0))
    given = spark.createDataFrame([(d, 1, i) for i, d in enumerate(defaults)], "drive string, source int, place int") if defaults else known.limit(0)
    drives = known.unionByName(given).groupBy("drive").agg(F.min(F.struct("source", "place")).alias("o"))
    counts = snapshots.where("complete").groupBy("drive").agg(F.count(F.lit(1)).alias("n"), F.max_by("id", F.struct("taken_at", "id")).alias("latest_id"), F.max("taken_at").alias("latest_at"))
    seen = events.groupBy("drive").agg(F.count(F.lit(1)).alias("events"))
    out = drives.join(counts, "drive", "left").join(seen, "drive", "left").withColumn("ordinal", F.row_number().over(Window.orderBy("o", "drive")))
    return out.select("ordinal", "drive", F.coalesce("n", F.lit(0)).alias("snapshots"), "latest_id", "latest_at", F.coalesce("events", F.lit(0)).alias("events"))
