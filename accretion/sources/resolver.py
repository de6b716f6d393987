"""Paths of references: records of a file-table image by number, as many as are asked for and no others.

A reference is a record's number and its sequence number, which grows when the record is used anew. References are sorted by
record and dealt by range, so that a task reads its part of the table once and forwards; a record whose sequence number is
another one, that is free or torn, has no name. Parents are asked for in the next round, each once, level by level to the
root; paths come from pointers (filetable.resolved_paths) over the references, so that a parent used anew gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accretion.functions import reasons as R
from accretion.operators import filetable
from accretion.scratch import saved

from . import ntfs
from .usn import local

MOST_LEVELS = 512


class Image:
    """Where the records of an image lie."""

    def __init__(self, path: str):
        self.path = local(path)
        with open(self.path, "rb") as f:
            self.shape = ntfs.geometry(f.read(512))
            f.seek(self.shape.table_at)
            runs = ntfs.table_runs(f.read(self.shape.record), self.shape.sector)
        self.extents, first = [], 0
        for run in runs:  # a sparse run has no records, but its numbers count
            n = run.length * self.shape.cluster // self.shape.record
            if run.lcn is not None:
                self.extents.append((first, first + n, run.lcn * self.shape.cluster))
            first += n

    def place(self, record: int) -> int | None:
        return next((at + (record - a) * self.shape.record for a, b, at in self.extents if a <= record < b), None)


def links(references: DataFrame, image: Image) -> DataFrame:
    """(reference, parent, name) of each distinct reference; nulls where the image has none of this sequence number."""
    size, sector, mask = image.shape.record, image.shape.sector, R.RECORD_MASK

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        with open(image.path, "rb") as f:
            for b in batches:
                parents, names = [], []
                for reference in b.column("reference").to_pylist():
                    at, found = image.place(reference & mask), None
                    if at is not None:
                        f.seek(at)
                        found = ntfs.link(f.read(size), sector)
                    ok = found is not None and found[0] == (reference >> 48) & 0xFFFF
                    parents.append(found[1] - (1 << 64) * (found[1] >> 63) if ok else None)
                    names.append(found[2] if ok else None)
                yield pa.RecordBatch.from_arrays([b.column("reference"), pa.array(parents, pa.int64()), pa.array(names, pa.string())], names=["reference", "parent", "name"])

    asked = references.where("reference IS NOT NULL").select("reference", R.record_number("reference").alias("record")).distinct()
    return asked.repartitionByRange("record").sortWithinPartitions("record").select("reference").mapInArrow(run, "reference long, parent long, name string")


def paths(spark: SparkSession, image_path: str, references: DataFrame) -> DataFrame:
    """(reference, path) of each distinct reference (the root's path is empty); null where there is no way up to the root."""
    image = Image(image_path)
    at_root = R.record_number("parent") == filetable.ROOT
    wanted = saved(references.select("reference").where("reference IS NOT NULL").distinct(), "references")
    frontier, found = wanted.where(R.record_number("reference") != filetable.ROOT), []
    for _ in range(MOST_LEVELS):
        found.append(saved(links(frontier, image), "links"))
        known = reduce(DataFrame.unionByName, found).select("reference")
        frontier = saved(found[-1].where(F.col("name").isNotNull() & ~at_root).select(F.col("parent").alias("reference")).distinct().join(known, "reference", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
    dirs = reduce(DataFrame.unionByName, found).where("name IS NOT NULL").select(F.col("reference").alias("record"), F.when(at_root, F.lit(filetable.ROOT)).otherwise(F.col("parent")).cast("long").alias("parent"), "name")
    resolved = filetable.resolved_paths(dirs).where("state = 'ok'").select("record", "path")
    out = wanted.join(resolved, F.col("reference") == F.col("record"), "left")
    return out.select("reference", F.when(R.record_number("reference") == filetable.ROOT, F.lit("")).otherwise(F.col("path")).alias("path"))
