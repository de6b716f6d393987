"""Roll-ups over a path hierarchy.

Entries are rows (path, is_dir, bytes, created, modified); `by` names further columns that keep hierarchies apart, such as
a snapshot's id. Files are summed by their directory before anything is exploded to ancestors, so the expansion is by
directories, not files, and partial sums combine on the map side; a root that all rows share is one row for each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accretion.functions import paths as P
from accretion.functions import stamps as S

KEEP_BYTES, KEEP_DEPTH = 4 << 20, 4
FILE_BYTES, RECENT_DAYS, RECENT_BYTES, FILE_CAP = 8 << 20, 45, 1 << 20, 60_000


def totals(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return entries.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("bytes"))), F.lit(0)).alias("total_bytes"), F.count_if(~F.col("is_dir")).alias("file_count"), F.count_if("is_dir").alias("dir_count")
    )


def rollup(entries: DataFrame, now: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """A row for each directory, named or implied: depth, bytes, own_bytes, files, dirs, newest_mtime, newest_ctime.

    Stamps that can't be, or lie more than two days past now, count for nothing. The root is always there (for each
    value of by that has an entry).
    """
    by, top = list(by), S.ceiling(now)
    ok = lambda c: S.safe_until(c, top)
    named = entries.where("is_dir").select(*by, "path", F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("n"), ok("modified").alias("m"), ok("created").alias("c"))
    held = entries.where("NOT is_dir").select(*by, P.parent("path").alias("path"), F.col("bytes").alias("own"), F.lit(1).cast("long").alias("n"), ok("modified").alias("m"), ok("created").alias("c"))
    rooted = entries.select(*by).distinct() if by else entries.sparkSession.range(1).select()
    rooted = rooted.select(*by, F.lit("").alias("path"), F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("m"), F.lit(None).cast("double").alias("c"))
    direct = named.unionByName(held).unionByName(rooted).groupBy(*by, "path").agg(F.sum("own").alias("own"), F.sum("n").alias("n"), F.max("m").alias("m"), F.max("c").alias("c"))
    spread = direct.select(*by, F.explode(P.ancestors_and_self("path")).alias("node"), (F.col("path")).alias("source"), "own", "n", "m", "c")
    nodes = spread.groupBy(*by, F.col("node").alias("path")).agg(
        F.sum("own").alias("bytes"), F.coalesce(F.sum(F.when(F.col("node") == F.col("source"), F.col("own"))), F.lit(0)).alias("own_bytes"), F.sum("n").alias("files"), F.max("m").alias("newest_mtime"), F.max("c").alias("newest_ctime")
    )
    # directories below: each node counts for its proper ancestors, implied ones included
    below = nodes.select(*by, F.explode(P.ancestors("path")).alias("path")).groupBy(*by, "path").agg(F.count(F.lit(1)).alias("dirs"))
    out = nodes.join(below, [*by, "path"], "left")
    return out.select(*by, "path", P.depth("path").alias("depth"), "bytes", "own_bytes", "files", F.coalesce("dirs", F.lit(0)).alias("dirs"), "newest_mtime", "newest_ctime")


def sizes(entries: DataFrame, max_depth: int, by: Sequence[str] = ()) -> DataFrame:
    """(path, depth, bytes) of the directories down to max_depth, as rollup() has them; deeper ones are never made rows of."""
    by = list(by)
    home = P.attribution(F.when(F.col("is_dir"), F.col("path")).otherwise(P.parent("path")), max_depth)
    direct = entries.groupBy(*by, home.alias("path")).agg(F.sum(F.when(F.col("is_dir"), F.lit(0)).otherwise(F.col("bytes"))).alias("own"))
    nodes = direct.select(*by, F.explode(P.ancestors_and_self("path")).alias("path"), "own").groupBy(*by, "path").agg(F.sum("own").alias("bytes"))
    return nodes.select(*by, "path", P.depth("path").alias("depth"), "bytes")


def prune(dirs: DataFrame, min_bytes: int = KEEP_BYTES, max_depth: int = KEEP_DEPTH, by: Sequence[str] = ()) -> DataFrame:
    """Directories that are large or shallow, with folded_children and folded_bytes of what their subtrees lost.

    Each dropped directory counts for its nearest kept ancestor with its own bytes, so that a kept directory's bytes are
    its own, its kept children's and the folded ones together.
    """
    by = list(by)
    keep = (F.col("path") == "") | (F.col("bytes") >= min_bytes) | (F.col("depth") <= max_depth)
    kept = dirs.where(keep)
    # siblings have one home, so each parent is looked up once; only few rows meet at the root then
    lost = dirs.where(~keep).groupBy(*by, P.parent("path").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum("own_bytes").alias("own"))
    spread = lost.select(*by, "path", "n", "own", F.explode(P.ancestors_and_self("path")).alias("up"))
    nearest = spread.join(kept.select(*by, F.col("path").alias("up")), [*by, "up"]).groupBy(*by, "path", "n", "own").agg(F.max_by("up", F.length("up")).alias("home"))
    folds = nearest.groupBy(*by, F.col("home").alias("path")).agg(F.sum("n").alias("folded_children"), F.sum("own").alias("folded_bytes"))
    out = kept.join(folds, [*by, "path"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("folded_children", "folded_bytes")})


def children(dirs: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """Direct children, largest first; the range on path can be pruned by column statistics."""
    level = 1 + (0 if not path else path.count(P.SEP) + 1)
    out = dirs.where((F.col("depth") == level) & P.in_subtree_of_children("path", path)).orderBy(F.desc("bytes"), "path")
    return out.limit(limit) if limit is not None else out


def level_items(dirs: DataFrame, path: str) -> DataFrame:
    """What a map of one level shows: (kind, path, bytes) of the directory's own files, children and folded rest; none of it empty."""
    node = dirs.where(F.col("path") == path)
    kids = children(dirs, path).select(F.lit("child").alias("kind"), "path", "bytes")
    own = node.select(F.lit("files").alias("kind"), "path", F.col("own_bytes").alias("bytes"))
    rest = node.select(F.lit("folded").alias("kind"), "path", F.col("folded_bytes").alias("bytes"))
    return kids.unionByName(own).unionByName(rest).where("bytes > 0")


def largest(rows: DataFrame, cap: int) -> DataFrame:
    """The cap rows with the most bytes, of equal ones those whose path comes first.

    Counts by size class (64 to a power of two, so a few thousand at most) tell from which size on rows can be among them.
    Only those are sorted, so what reaches the last task is cap rows and those of one class, however many tasks there are.
    """
    classed = F.floor(F.log2(F.greatest("bytes", F.lit(1)).cast("double")) * 64).cast("int")
    counts = rows.groupBy(classed.alias("size_class")).agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("size_class"))) - F.col("n")
    least = counts.withColumn("above", above).where(F.col("above") < cap).agg(F.min("size_class").alias("least"))
    return rows.join(F.broadcast(least), classed >= F.col("least")).drop("least").orderBy(F.desc("bytes"), "path").limit(cap)


def select_files(entries: DataFrame, now: float, min_bytes: int = FILE_BYTES, recent_days: int = RECENT_DAYS, recent_bytes: int = RECENT_BYTES, cap: int = FILE_CAP) -> DataFrame:
    """Files that are large, or recent and not small; the largest `cap` of them. Stamps count as they are: a future one is recent."""
    stamp = F.coalesce("created", "modified")
    keep = (F.col("bytes") >= min_bytes) | ((stamp >= now - recent_days * 86400) & (F.col("bytes") >= recent_bytes))
    return largest(entries.where(~F.col("is_dir") & (F.col("bytes") > 0) & keep).select("path", "bytes", F.col("modified").alias("mtime"), F.col("created").alias("ctime")), cap)


def first_by_size() -> Column:
    """Largest first; a directory sorts before what is in it, so it wins ties."""
    return F.struct((-F.col("bytes")).alias("size"), F.col("path").alias("path"))


def suppressed(rows: DataFrame, key: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows of which no ancestor comes earlier, by ascending key: what picking one by one below nobody picked gives.

    An earlier ancestor was either picked or is itself below one that was; so neither a loop nor a rank is needed, only an
    anti-join on ancestors with earlier keys.
    """
    by = list(by)
    keyed = rows.withColumn("own_key", first_by_size() if key is None else key)
    up = keyed.select(*by, F.col("path").alias("up"), F.col("own_key").alias("up_key"))
    below = keyed.select(*by, "path", "own_key", F.explode(P.ancestors("path", with_root=False)).alias("up"))
    covered = below.join(up, [*by, "up"]).where("up_key < own_key").select(*by, "path").distinct()
    return rows.join(covered, [*by, "path"], "left_anti")


def level_total(dirs: DataFrame, path: str) -> DataFrame:
    """(path, total): the directory's bytes, or where it has no row those of its children."""
    kids = children(dirs, path).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("below"))
    own = dirs.where(F.col("path") == path).agg(F.max("bytes").alias("own"))
    return own.join(F.broadcast(kids), F.lit(True)).select(F.lit(path).alias("path"), F.coalesce("own", "below").alias("total"))


def counted(entries: DataFrame, name: str = "scan"):
    """(entries, observation): counts that come with whatever job reads the entries; observation.get waits for it."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return entries.observe(seen, F.count(F.lit(1)).alias("entries"), F.count_if("is_dir").alias("dirs"), F.sum("bytes").alias("bytes")), seen
