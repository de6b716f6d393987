"""A daily timeline of two layers: what files still there were created on a day, and what snapshots measured.

The layers answer different questions, and their sums are never added: a day belongs to one of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accretion.functions import paths as P
from accretion.functions import stamps as S

from . import snapshots as N

COMPARE_DEPTH, DOMINANT, TOP_N, DAYS = 3, 0.9, 5, 90


def deltas(snapshots: DataFrame, dirs: DataFrame, max_depth: int = COMPARE_DEPTH, tz: str = "UTC") -> DataFrame:
    """(drive, day, path, delta): directories' changes between consecutive snapshots, summed over each day; none that is 0.

    Each snapshot's rows enter once as its pair's after, with plus, and once as the next pair's before, with minus: one
    aggregation in place of an outer join for each pair.
    """
    pairs = N.pairs(snapshots).withColumn("day", S.day("after_at", tz))
    signs = pairs.select("drive", "day", F.col("after_id").alias("snapshot_id"), F.lit(1).alias("sign")).unionByName(pairs.select("drive", "day", F.col("before_id").alias("snapshot_id"), F.lit(-1).alias("sign")))
    rows = dirs.where(F.col("depth").between(1, max_depth)).select("snapshot_id", "path", "bytes").join(signs, "snapshot_id")
    return rows.groupBy("drive", "day", "path").agg(F.sum(F.col("bytes") * F.col("sign")).alias("delta")).where("delta <> 0")


def measured_days(snapshots: DataFrame, changed: DataFrame, tz: str = "UTC") -> DataFrame:
    """(drive, day, added, removed, net): net is the drive's, added and removed are of top-level directories."""
    net = N.pairs(snapshots).groupBy("drive", S.day("after_at", tz).alias("day")).agg(F.sum("net").alias("net"))
    top = changed.where(P.separators("path") == 0).groupBy("drive", "day").agg(F.sum(F.when(F.col("delta") > 0, F.col("delta"))).alias("added"), F.sum(F.when(F.col("delta") < 0, -F.col("delta"))).alias("removed"))
    return net.join(top, ["drive", "day"], "left").select("drive", "day", F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"), "net")


def spanned_days(snapshots: DataFrame, tz: str = "UTC") -> DataFrame:
    """(drive, day) that a pair of snapshots reaches: after the earlier one's day, through the later one's."""
    ends = N.pairs(snapshots).select("drive", F.to_date(S.day("before_at", tz)).alias("a"), F.to_date(S.day("after_at", tz)).alias("b")).where("b > a")
    return ends.select("drive", F.explode(F.sequence(F.date_add("a", 1), F.col("b"))).alias("d")).select("drive", F.date_format("d", "yyyy-MM-dd").alias("day")).distinct()


def collapsed(items: list[tuple[str, int]], ratio: float = DOMINANT, drill: bool = True) -> list[tuple[str, int, str]]:
    """(path, bytes, picked) for one day's growing or shrinking paths.

    By size (deeper first among equals, then by path) a path is picked unless one above or below it was; each pick is then
    followed down as long as one child has at least ratio of its size. The order of picking matters in both directions,
    which no join expresses.
    """
    size = dict(items)
    kids: dict[str, list[str]] = {}
    for path in size:
        if P.SEP in path:
            kids.setdefault(path.rsplit(P.SEP, 1)[0], []).append(path)
    picked: set[str] = set()
    over: set[str] = set()  # everything above a picked path
    out = []
    for path, _ in sorted(items, key=lambda x: (-x[1], -x[0].count(P.SEP), x[0])):
        above = [path[:i] for i, c in enumerate(path) if c == P.SEP]
        if path in over or picked.intersection(above):
            continue
        picked.add(path)
        over.update(above)
        now = path
        while drill and now in kids:
            child = min(kids[now], key=lambda k: (-size[k], k))
            if size[child] < size[now] * ratio:
                break
            now = child
        out.append((now, size[now], path))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def contributors(changed: DataFrame, top_n: int | None = TOP_N, ratio: float = DOMINANT, drill: bool = True) -> DataFrame:
    """(drive, day, direction, rank, path, bytes, picked) from deltas().

    Paths only stand in each other's way below one top-level directory, so a group is that directory's changed paths of a
    day, of few levels; the groups' picks are ranked together.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = collapsed(list(zip(rows["path"], rows["bytes"].astype(int), strict=True)), ratio, drill)[:top_n]
        out = pd.DataFrame(found, columns=["path", "bytes", "picked"])
        for c in ("direction", "day", "drive"):
            out.insert(0, c, rows[c].iloc[0])
        return out

    rows = changed.select("drive", "day", F.when(F.col("delta") > 0, "up").otherwise("down").alias("direction"), "path", F.abs("delta").alias("bytes"), P.attribution("path", 1).alias("top"))
    picks = rows.groupBy("drive", "day", "direction", "top").applyInPandas(run, "drive string, day string, direction string, path string, bytes long, picked string")
    order = Window.partitionBy("drive", "day", "direction").orderBy(F.desc("bytes"), "path")
    ranked = picks.withColumn("rank", F.row_number().over(order).cast("long"))
    return (ranked if top_n is None else ranked.where(F.col("rank") <= top_n)).select("drive", "day", "direction", "rank", "path", "bytes", "picked")


def filled(days: DataFrame) -> DataFrame:
    """Days between each drive's first and last that have no row, as empty retro days: each day brings those up to the next one along."""
    day = F.to_date("day")
    following = F.lead(day).over(Window.partitionBy("drive").orderBy("day"))
    rows = days.withColumn("until", F.greatest(day, F.coalesce(F.date_sub(following, 1), day)))
    rows = rows.withColumn("d", F.explode(F.sequence(day, "until"))).drop("until")
    own = F.col("d") == day
    zero = {c: F.when(own, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast(days.schema[c].dataType) for c in ("added", "removed", "net", "files_added")}
    return rows.withColumns(zero | {"basis": F.when(own, F.coalesce("basis", F.lit("retro"))).otherwise(F.lit("retro")), "day": F.date_format("d", "yyyy-MM-dd")}).drop("d")


def timeline(snapshots: DataFrame, dirs: DataFrame, buckets: DataFrame, now: float, days: int = DAYS, fill_gaps: bool = True, tz: str = "UTC") -> DataFrame:
    """(drive, day, basis, added, removed, net, files_added).

    Days that snapshots span are measured (one of them without a pair that ends on it has no row of its own, and comes
    from filling gaps), all others are retro, from the newest complete snapshot's buckets. The window reaches from `days`
    before now to the newest snapshot's day.
    """
    newest = N.latest(snapshots).select("drive", F.col("id").alias("snapshot_id"), S.day("taken_at", tz).alias("horizon"))
    spanned = spanned_days(snapshots, tz)
    retro = buckets.join(newest, "snapshot_id").groupBy("drive", "day").agg(F.sum("bytes").alias("added"), F.sum("files").alias("files_added"))
    retro = retro.join(spanned, ["drive", "day"], "left_anti").select("drive", "day", F.lit("retro").alias("basis"), "added", F.lit(0).cast("long").alias("removed"), F.col("added").alias("net"), "files_added")
    measured = measured_days(snapshots, deltas(snapshots, dirs, tz=tz), tz).join(spanned, ["drive", "day"], "left_semi")
    measured = measured.select("drive", "day", F.lit("measured").alias("basis"), "added", "removed", "net", F.lit(0).cast("long").alias("files_added"))
    cutoff = S.day(F.lit(float(now - days * 86400)), tz)
    both = retro.unionByName(measured).join(newest.select("drive", "horizon"), "drive").where((F.col("day") >= cutoff) & (F.col("day") <= F.col("horizon"))).drop("horizon")
    return filled(both) if fill_gaps else both


def summary(days: DataFrame) -> DataFrame:
    """Counts and sums by layer (never across layers), the busiest day and the first measured one."""
    when = lambda basis, c: F.coalesce(F.sum(F.when(F.col("basis") == basis, F.col(c))), F.lit(0))
    return days.groupBy("drive").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("basis") == "retro").alias("retro_days"), F.count_if(F.col("basis") == "measured").alias("measured_days"), when("retro", "added").alias("retro_added"),
        when("measured", "added").alias("measured_added"), when("measured", "removed").alias("measured_removed"), when("measured", "net").alias("measured_net"),
        F.max_by("day", F.struct(F.col("added"), (-F.unix_date(F.to_date("day"))).alias("o"))).alias("busiest_day"), F.min(F.when(F.col("basis") == "measured", F.col("day"))).alias("first_measured_day"),
    )


def peak(days: DataFrame) -> Column:
    """The largest amount added or removed on a day of each drive."""
    return F.max(F.greatest("added", "removed")).over(Window.partitionBy("drive"))


def with_journal(days: DataFrame, journal: DataFrame) -> DataFrame:
    """Each day with what the journal saw on it, 0 where it saw nothing."""
    out = days.join(journal, ["drive", "day"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in journal.columns if c not in ("drive", "day")})


def viewport(days: DataFrame, center: str, width: int) -> DataFrame:
    """The width days around center, moved so that they stay on each drive's axis."""
    axis = Window.partitionBy("drive").orderBy("day")
    out = days.withColumns({"at": F.row_number().over(axis), "n": F.count(F.lit(1)).over(Window.partitionBy("drive")), "mid": F.count_if(F.col("day") <= center).over(Window.partitionBy("drive"))})
    first = F.greatest(F.lit(1), F.least(F.col("mid") - width // 2, F.col("n") - width + 1))
    return out.where(F.col("at").between(first, first + width - 1)).drop("at", "n", "mid")
