"""Where space goes: largest and recently written directories, and what can be cleaned up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accretion.functions import rules as R
from accretion.functions import stamps as S
from accretion.scratch import saved

from .tree import suppressed

GROWN_BYTES, CLEANUP_BYTES = 64 << 20, 32 << 20


def _order():
    return [F.desc("bytes"), F.asc("path")]  # a directory sorts before what is in it, so it wins ties


def biggest_dirs(dirs: DataFrame, limit: int = 30, max_depth: int = 6, rules=R.RULES) -> DataFrame:
    """The largest directories, none within another; picked from the limit * 6 largest, so there may be fewer than limit."""
    top = dirs.where(F.col("depth").between(1, max_depth)).orderBy(*_order()).limit(limit * 6)
    out = suppressed(top).withColumn("hint", R.classify("path", rules)).orderBy(*_order()).limit(limit)
    return out.select("path", "bytes", "files", F.col("newest_mtime").alias("newest"), "hint.rule", "hint.safety")


def biggest_files(files: DataFrame, limit: int = 40, rules=R.RULES) -> DataFrame:
    out = files.orderBy(*_order()).limit(limit).withColumn("hint", R.classify("path", rules))
    return out.select("path", "bytes", F.lit(1).cast("long").alias("files"), F.col("mtime").alias("newest"), "hint.rule", "hint.safety")


def recently_grown(dirs: DataFrame, now: float, days: int = 14, limit: int = 25, min_bytes: int = GROWN_BYTES) -> DataFrame:
    """Large directories last written within days (and not further ahead than clocks differ), none within another."""
    fresh = (F.col("depth") >= 1) & (F.col("newest_ctime") >= now - days * 86400) & (F.col("newest_ctime") <= S.ceiling(now)) & (F.col("bytes") >= min_bytes)
    top = dirs.where(fresh).orderBy(*_order()).limit(limit * 4)
    age = F.when(F.col("newest_ctime") != 0, F.greatest(F.lit(0.0), S.age_days("newest_ctime", now)))
    return suppressed(top).orderBy(*_order()).limit(limit).select("path", "bytes", F.col("newest_ctime").alias("newest"), age.alias("days_old"))


def cleanup_candidates(dirs: DataFrame, files: DataFrame, limit: int = 40, min_bytes: int = CLEANUP_BYTES, rules=R.RULES) -> DataFrame:
    """Directories and files that a rule names; of those within each other the outermost in order of size.

    What rules name is a small part of all, made once, as tables.
    """
    from accretion.functions import paths as P

    hint = R.classify("path", rules)
    named = saved(dirs.where((F.col("depth") >= 1) & (F.col("bytes") >= min_bytes)).select("path", "bytes", "files", "newest_mtime", hint.alias("hint")).where("hint IS NOT NULL"), "named")
    found = suppressed(named).select("path", "bytes", "files", F.col("newest_mtime").alias("newest"), "hint.rule", "hint.safety")
    loose = saved(files.where(F.col("bytes") >= min_bytes).select("path", "bytes", "mtime", hint.alias("hint")).where("hint IS NOT NULL"), "loose")
    # a file that a found directory holds, or that bears its path, doesn't count again
    held = loose.select("path", F.explode(P.ancestors_and_self("path")).alias("up")).where("up <> ''").join(found.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    single = loose.join(held, "path", "left_anti").select("path", "bytes", F.lit(1).cast("long").alias("files"), F.col("mtime").alias("newest"), "hint.rule", "hint.safety")
    return found.unionByName(single).orderBy(*_order()).limit(limit)


def cleanup_totals(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("all_bytes"), F.coalesce(F.sum(F.when(F.col("safety") == "safe", F.col("bytes"))), F.lit(0)).alias("safe_bytes"))
