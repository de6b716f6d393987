"""Relations of a decoded file table: paths of an adjacency list, sizes from extension records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accretion.functions import paths as P
from accretion.scratch import saved

ROOT, FIRST_USER = 5, 16
#: Characters of the longest path there can be. Names of cycles would double for ever.
LONGEST = 32_767


def resolved_paths(dirs: DataFrame, root: int = ROOT) -> DataFrame:
    """(record, path, state) of directories (record, parent, name): state is ok, orphan or cycle; only ok has a path.

    Pointers double: after k joins each directory knows its ancestor 2^k steps up and the names between. Those that have
    reached the root, or a parent that isn't there, are through and join no more, so the k-th join moves only what is
    deeper than 2^k. As long as any of these is in no cycle, some get through with each join (those up to twice as deep);
    so where a join gets none through, all that are left lead into cycles.
    """
    # up: a record, -2 at the root, -1 where the parent is missing
    state = saved(dirs.where(F.col("record") != root).select("record", F.col("name").alias("path"), F.when(F.col("parent") == root, F.lit(-2)).otherwise(F.col("parent")).cast("long").alias("up")), "paths")
    through: list[DataFrame] = []
    left = state.where("up >= 0").count()
    while left:
        through.append(state.where("up < 0"))
        going = state.where("up >= 0")
        above = reduce(DataFrame.unionByName, [*through, going]).select(F.col("record").alias("r"), F.col("path").alias("p"), F.col("up").alias("u"))
        grown = F.when(F.col("r").isNull() | (F.length("path") + F.length("p") > LONGEST), F.col("path")).otherwise(F.concat("p", F.lit(P.SEP), "path"))
        state = saved(going.join(above, F.col("up") == F.col("r"), "left").select("record", grown.alias("path"), F.coalesce("u", F.lit(-1)).cast("long").alias("up")), "paths")
        now = state.where("up >= 0").count()
        if now == left:
            break
        left = now
    rows = reduce(DataFrame.unionByName, [*through, state])
    found = rows.select("record", F.when(F.col("up") == -2, F.col("path")).alias("path"), F.when(F.col("up") == -2, "ok").when(F.col("up") == -1, "orphan").otherwise("cycle").alias("state"))
    at_root = dirs.sparkSession.range(1).select(F.lit(root).cast("long").alias("record"), F.lit("").alias("path"), F.lit("ok").alias("state"))
    return found.unionByName(at_root)


def merged_sizes(entries: DataFrame, extensions: DataFrame) -> DataFrame:
    """Entries (record, is_dir, bytes, logical_bytes, wof, …) with what extension records (base, unnamed, named, logical, wof) add.

    Of a compressed file only named streams take space; sizes are the larger of what the base record and the extensions
    have, so a base is never lowered. Directories keep theirs, extensions without a base are dropped.
    """
    parts = extensions.groupBy(F.col("base").alias("of")).agg(F.sum("unnamed").alias("u"), F.sum("named").alias("n"), F.sum("logical").alias("l"), F.bool_or("wof").alias("w"))
    out = entries.join(parts, entries.record == parts.of, "left")
    there = F.col("of").isNotNull() & ~F.col("is_dir")
    wof = F.col("wof") | F.coalesce("w", F.lit(False))
    size = F.when(wof, F.col("n")).otherwise(F.col("u") + F.col("n"))
    new = {
        "bytes": F.when(there, F.greatest("bytes", size)).otherwise(F.col("bytes")),
        "logical_bytes": F.when(there, F.greatest("logical_bytes", "l")).otherwise(F.col("logical_bytes")),
        "wof": F.when(there, wof).otherwise(F.col("wof")),
    }
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in entries.columns])


def as_entries(records: DataFrame, paths: DataFrame, first_user: int = FIRST_USER, root: int = ROOT) -> DataFrame:
    """Scan entries (path, is_dir, bytes, created, modified, attributes) of files and directories whose parent is known.

    The file system's own files and the root are left out.
    """
    rows = records.where((F.col("record") != root) & ((F.col("record") >= first_user) | F.col("is_dir")))
    up = paths.where("path IS NOT NULL").select(F.col("record").alias("parent"), F.col("path").alias("above"))
    path = F.when(F.col("above") == "", F.col("name")).otherwise(F.concat("above", F.lit(P.SEP), "name"))
    return rows.join(up, "parent").select(path.alias("path"), "is_dir", "bytes", "created", "modified", "attributes")


def scan_warnings(records: DataFrame, paths: DataFrame, first_user: int = FIRST_USER, root: int = ROOT) -> DataFrame:
    """(metafile_bytes, orphan_files, orphan_bytes) of what as_entries() leaves out."""
    up = paths.where("path IS NOT NULL").select(F.col("record").alias("parent"), F.lit(True).alias("known"))
    rows = records.where(F.col("record") != root).join(up, "parent", "left")
    meta = (F.col("record") < first_user) & ~F.col("is_dir")
    lost = ~meta & F.col("known").isNull()
    return rows.agg(F.coalesce(F.sum(F.when(meta, F.col("bytes"))), F.lit(0)).alias("metafile_bytes"), F.count_if(lost).alias("orphan_files"), F.coalesce(F.sum(F.when(lost, F.col("bytes"))), F.lit(0)).alias("orphan_bytes"))
