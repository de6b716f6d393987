"""Bytes by creation day and path prefix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accretion.functions import paths as P
from accretion.functions import stamps as S

BUCKET_BYTES, PARTS = 2 << 20, 3


def age_buckets(entries: DataFrame, min_bytes: int = BUCKET_BYTES, parts: int = PARTS, tz: str = "UTC", by: Sequence[str] = ()) -> DataFrame:
    """(day, attribution, bytes, files): groups below min_bytes count for '' (other). Files without a possible stamp don't count."""
    by = list(by)
    rows = entries.where(~F.col("is_dir") & (F.col("bytes") > 0)).select(*by, S.day(F.coalesce("created", "modified"), tz).alias("day"), P.attribution("path", parts).alias("attribution"), "bytes").where("day IS NOT NULL")
    fine = rows.groupBy(*by, "day", "attribution").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
    merged = F.when(F.col("bytes") >= min_bytes, F.col("attribution")).otherwise(F.lit(""))
    return fine.groupBy(*by, "day", merged.alias("attribution")).agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))


def accumulated(held: DataFrame, new: DataFrame, by: Sequence[str] = ("snapshot_id",)) -> DataFrame:
    """Buckets after an upsert that adds to what is there."""
    return held.unionByName(new).groupBy(*by, "day", "attribution").agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))


def retro_days(buckets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What each day's files still there amount to: (day, added, net, files_added)."""
    return buckets.groupBy(*by, "day").agg(F.sum("bytes").alias("added"), F.sum("bytes").alias("net"), F.sum("files").alias("files_added"))


def retro_contributors(buckets: DataFrame, top_n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """(day, rank, path, bytes) of each day's largest attributions."""
    order = Window.partitionBy(*by, "day").orderBy(F.desc("bytes"), "attribution")
    rows = buckets.where("attribution <> ''").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    return rows.select(*by, "day", "rank", F.col("attribution").alias("path"), "bytes")


def age_profile(buckets: DataFrame, now: float, tz: str = "UTC") -> DataFrame:
    """(band, bytes, files) by the age of a day's noon; all six bands, none for a day that can't be read."""
    spark = buckets.sparkSession
    noon = S.day_start("day", 12, tz)
    rows = buckets.where(noon.isNotNull()).select(S.age_band(F.when(noon == 0, F.lit(1.0)).otherwise(noon), now).alias("band"), "bytes", "files")
    bands = spark.createDataFrame([(i, code) for i, (code, _) in enumerate(S.BANDS)], "ordinal int, band string")
    summed = rows.groupBy("band").agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))
    return F.broadcast(bands).join(summed, "band", "left").select("ordinal", "band", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("files", F.lit(0)).alias("files"))
