"""The journal as a stream: kinds that are kept, each event once, and a table that only grows by new events.

The time for which the journal's events are kept is the watermark: an event that comes again within it is dropped by its
key; later ones would have expired anyway.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from accretion import files
from accretion.functions import reasons as R
from accretion.operators import journal

KEEP = "180 days"


def prepared(events: DataFrame, kinds: tuple[str, ...] = R.STORED_KINDS) -> DataFrame:
    """Stored kinds with event_time; an event without a time gets the batch's.

    In a stream that is the time which the query's own log has for the batch, so a batch that runs again gets it again.
    """
    known = F.coalesce(F.timestamp_seconds("timestamp"), F.current_timestamp())
    return events.where(F.col("reason").bitwiseAND(F.lit(R.SPACE_MASK)) != 0).withColumn("kind", R.kind("reason")).where(F.col("kind").isin(*kinds)).withColumn("event_time", known)


def once(events: DataFrame, keep: str = KEEP) -> DataFrame:
    """Each (drive, usn) once, in a stream as in a table."""
    if not events.isStreaming:
        return events.dropDuplicates(["drive", "usn"])
    return events.withWatermark("event_time", keep).dropDuplicatesWithinWatermark(["drive", "usn"])


def daily(events: DataFrame) -> DataFrame:
    """(drive, day, kind, events, bytes) in tumbling days."""
    days = events.groupBy("drive", F.window("event_time", "1 day"), "kind").agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return days.select("drive", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "kind", "events", "bytes")


def deleted_groups(events: DataFrame, late: str | None = "1 hour") -> DataFrame:
    """(drive, day, path, own, bytes, is_dir, at, count, name, own_day): deletions of one path in the 26 hours from a day's midnight (UTC).

    Windows of 26 hours begin every 24, so an event just after midnight is in two. The state has a row for each path and
    open window, and a window's rows come out and are dropped together, when no event can be later than late (None: events
    have a watermark already).
    """
    gone = (events.withWatermark("event_time", late) if late else events).where("kind = 'delete'")
    unknown = F.col("path").isNull() | (F.col("path") == "")
    window = F.window("event_time", f"{journal.DAY_WINDOW} seconds", "24 hours")
    last = lambda c: F.max_by(c, F.struct("event_time", "usn"))
    rows = gone.withColumns({"own": F.when(unknown, F.col("usn")).otherwise(0), "at": F.unix_micros("event_time") / 1e6})
    groups = rows.groupBy("drive", window.alias("window"), "path", "own").agg(
        F.max("bytes").alias("bytes"), last("is_dir").alias("is_dir"), F.max("at").alias("at"), F.min("at").alias("first"), F.count(F.lit(1)).alias("count"), last("name").alias("name")
    )
    own_day = F.col("first") < F.unix_seconds("window.start") + 86400
    return groups.select("drive", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "path", "own", "bytes", "is_dir", "at", "count", "name", own_day.alias("own_day"))


def top_deleted(groups: DataFrame, top_n: int = journal.TOP_N) -> DataFrame:
    """(drive, day, rank, path, bytes, is_dir, at, count) of closed windows: for foreachBatch, as all rows of a window come in one batch.

    Days without a deletion of their own (only just after midnight, of the next day) aren't listed.
    """
    days, order = Window.partitionBy("drive", "day"), [F.desc(F.coalesce("bytes", F.lit(0))), F.desc("at"), "path", "own"]
    out = groups.withColumn("listed", F.max("own_day").over(days)).where("listed").withColumn("rank", F.row_number().over(days.orderBy(*order))).where(F.col("rank") <= top_n)
    shown = F.when(F.col("path").isNull() | (F.col("path") == ""), F.col("name")).otherwise(F.col("path"))
    return out.select("drive", "day", "rank", shown.alias("path"), "bytes", "is_dir", "at", "count")


def top_deleted_sink(target: str, top_n: int = journal.TOP_N):
    """For foreachBatch of deleted_groups() in append mode: the days' rankings, a folder for each batch, which a batch that runs again overwrites."""

    def put(batch: DataFrame, batch_id: int) -> None:
        top_deleted(batch, top_n).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    return put


def sink(target: str):
    """For foreachBatch: appends events whose key the table at target doesn't have, in a folder for each day and batch.

    Events of one key have one time, so only the batch's own days are read for keys. A batch that runs again overwrites
    its own folders, so a restart repeats nothing.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(["drive", "usn"]).withColumns({"day": F.date_format("event_time", "yyyy-MM-dd"), "batch": F.lit(batch_id)}).persist()
        if files.exists(spark, target):
            days = [r.day for r in batch.select("day").distinct().collect()]  # a batch has few days
            held = spark.read.parquet(target).where(F.col("day").isin(days) & (F.col("batch") != batch_id)).select("drive", "usn")
            new = batch.join(held, ["drive", "usn"], "left_anti")
        else:
            new = batch
        # by day, not a file of each day from each task
        new.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(target)
        batch.unpersist()

    return put


def drain(writer: DataStreamWriter) -> None:
    """Runs a stream, batch after batch, until it has taken in all that is there.

    For sources written in Python, which can't tell Spark where the end is: with availableNow the end is that of their first batch.
    """
    query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
