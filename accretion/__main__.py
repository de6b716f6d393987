"""python -m accretion COMMAND WHAT --store DIR [--drive C:] [--path P] [--image FILE] [--whole]

scan FOLDER        takes a snapshot of a folder or a file-table image; with --whole nothing is left out of it
journal FOLDER     takes in what a journal has: journal.info and *.usn buffers (with --image for paths), or journal.json and events-*.json
doctor FOLDER      tells which sources would work here, and why others don't
folder FOLDER      lists a live folder's children by size, without a store
show WHAT          status, timeline, tree, snapshots, hotspots, diff or changes
"""

from __future__ import annotations

import argparse
import os
import sys
import time


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from accretion.functions import reasons
    from accretion.operators import store as kept, tree
    from accretion.plans import api
    from accretion.sources import readers, resolver, usn

    parser = argparse.ArgumentParser(prog="accretion", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["scan", "journal", "folder", "doctor", "show"])
    parser.add_argument("what")
    parser.add_argument("--store")
    parser.add_argument("--drive", default="C:")
    parser.add_argument("--path", default="")
    parser.add_argument("--image")
    parser.add_argument("--whole", action="store_true")
    given = parser.parse_args(argv)
    if given.command not in ("folder", "doctor") and not given.store:
        parser.error("--store is needed")
    spark = SparkSession.builder.appName("accretion").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    drive, now = api.drive_of(given.drive), time.time()
    readers.register(spark)
    walk = lambda s: readers.walked(s, given.what).where("NOT failed").drop("failed")

    def show(name: str, df) -> None:
        print(f"# {name}")
        for row in api.as_json(df).toLocalIterator():
            print(row.value)

    if given.command == "folder":
        show("children", tree.children(tree.rollup(walk(spark), now), api.path_of(given.path), 200))
        return 0
    if given.command == "doctor":
        show("sources", readers.doctor(spark, given.what))
        return 0
    store = kept.Store(spark, given.store)
    if given.command == "journal":
        if os.path.exists(os.path.join(given.what, usn.INFO)):
            state = usn.Segments(given.what).state()
            journals = spark.createDataFrame([(drive, state.journal_id, state.lowest_valid_usn, True, None)], "drive string, journal_id long, lowest_valid_usn long, available boolean, reason string")
            known = store.cursors().where((F.col("drive") == drive) & (F.col("journal_id") == state.journal_id)).first()
            start = max(state.lowest_valid_usn, known.next_usn if known else 0)  # older segments aren't opened
            readings = spark.read.format("usnjournal").option("path", given.what).option("drive", drive).option("start", start).option("reasonMask", reasons.SPACE_MASK).load().drop("kind", "journal_reset")
            print(store.collect(readings, journals, now, resolvers={drive: lambda ask: resolver.paths(spark, given.image, ask)} if given.image else None), file=sys.stderr)
            return 0
        try:
            state = readers.journal_state(given.what)
            journals = [(drive, state["journal_id"], state["lowest_valid_usn"], True, None)]
        except (OSError, ValueError, KeyError) as error:
            journals = [(drive, None, None, False, f"the journal can't be read: {error}")]
        readings = spark.read.format("journalfolder").option("reasonMask", str(reasons.SPACE_MASK)).load(given.what).where("drive = '%s'" % drive) if journals[0][3] else spark.createDataFrame([], "drive string, usn long, timestamp double, reason long, is_dir boolean, name string, path string, bytes long")
        counts = store.collect(readings, spark.createDataFrame(journals, "drive string, journal_id long, lowest_valid_usn long, available boolean, reason string"), now)
        print(counts or journals[0][4], file=sys.stderr)
        return 0 if counts else 1
    if given.command == "scan":
        image = lambda s: readers.image_entries(s, given.what)
        entries, method, note = readers.ingest(spark, [("mft", image), ("scandir", walk)])
        entries, seen = tree.counted(entries)
        entries = entries.persist()  # four tables are made from it
        boundary = store.rules_boundary()
        number = max(kept.snapshot_id(drive, now), boundary)
        whole = {"prune": {"min_bytes": 0}, "select_files": {"min_bytes": 1, "cap": 2**31 - 1}, "age_buckets": {"min_bytes": 1}}
        store.commit(entries, number, drive, now, method, note, whole if given.whole else None)
        entries.unpersist()
        failed = store.maintain(drive, number, now)
        print(seen.get, *(f"upkeep: {step} failed: {why}" for step, why in failed.items()), sep="\n", file=sys.stderr)
        return 2 if failed else 0
    engine = api.Engine(
        store.snapshots(), store.read("dirs"), store.read("files"), store.read("age_buckets"), store.events(), store.status(), now, boundary=store.rules_boundary(), capacity=readers.capacity(spark, {drive: given.path or "/"})
    )
    got = getattr(engine, given.what)(*([] if given.what == "status" else [given.drive]), *([given.path] if given.what == "tree" else []))
    for name, df in (got if isinstance(got, dict) else {given.what: got}).items() if got is not None else ():
        show(name, df)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
