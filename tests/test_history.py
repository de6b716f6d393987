"""Snapshots, timeline rules, journal, lifecycle and store on small hand-made histories."""

import json

import pytest
from pyspark.sql import functions as F

from accretion.functions import display, reasons
from accretion.functions import stamps as S
from accretion.operators import filetable, hotspots, journal, snapshots as N, timeline as T, tree
from accretion.operators.store import Store
from accretion.plans import api

DAY = 86400.0
HEAD = "id long, drive string, taken_at double, method string, complete boolean, note string, scanned_bytes long"
DIRS = "snapshot_id long, path string, depth int, bytes long"
BUCKETS = "snapshot_id long, day string, attribution string, bytes long, files long"


def history(spark, snaps, dirs, buckets=()):
    heads = spark.createDataFrame([(i, "C:", t, "mft", c, None, b) for i, t, c, b in snaps], HEAD)
    rows = [(i, p, len(p.split("\\")), b) for i, d in dirs.items() for p, b in d.items()]
    return heads, spark.createDataFrame(rows, DIRS), spark.createDataFrame(list(buckets), BUCKETS)


def day(n):
    return "2024-03-%02d" % n


def noon(n):
    return 1709251200.0 + (n - 1) * DAY + DAY / 2


def test_measured_day(spark):
    heads, dirs, _ = history(spark, [(1, noon(1), True, 1000), (2, noon(2), True, 650)], {1: {"Users": 600, "Games": 400}, 2: {"Users": 650}})
    got = T.measured_days(heads, T.deltas(heads, dirs)).collect()
    assert [tuple(r) for r in got] == [("C:", day(2), 50, 400, -350)]


def test_pairs_of_one_day_add_up(spark):
    snaps = [(1, noon(1), True, 1000), (2, noon(2), True, 1300), (3, noon(2) + 3600, True, 1700)]
    heads, dirs, _ = history(spark, snaps, {1: {"A": 1000}, 2: {"A": 1000, "B": 300}, 3: {"A": 1400, "B": 300}})
    deltas = T.deltas(heads, dirs)
    assert {r.path: r.delta for r in deltas.collect()} == {"A": 400, "B": 300}
    assert T.measured_days(heads, deltas).first().net == 700


def test_same_day_pair_spans_nothing(spark):
    heads, dirs, buckets = history(spark, [(1, noon(5) - 3 * 3600, True, 10), (2, noon(5) + 3600, True, 20)], {1: {"A": 10}, 2: {"A": 20}}, [(2, day(5), "A", 99999, 1)])
    got = T.timeline(heads, dirs, buckets, noon(5)).collect()
    assert [(r.day, r.basis, r.added) for r in got] == [(day(5), "retro", 99999)]


def test_skipped_days_are_empty(spark):
    heads, dirs, buckets = history(spark, [(1, noon(6), True, 1000), (2, noon(9), True, 1500)], {1: {"A": 1000}, 2: {"A": 1500}}, [(2, day(1), "A", 700, 1), (2, day(7), "A", 200, 1), (2, day(8), "A", 300, 1), (2, "2027-01-01", "A", 5, 1)])
    got = {r.day: (r.basis, r.added) for r in T.timeline(heads, dirs, buckets, noon(10)).collect()}
    assert got[day(1)] == ("retro", 700) and got[day(7)] == got[day(8)] == ("retro", 0) and got[day(9)] == ("measured", 500)
    assert max(got) == day(9) and len(got) == 9
    summary = T.summary(T.timeline(heads, dirs, buckets, noon(10))).first()
    assert (summary.retro_added, summary.measured_added, summary.busiest_day, summary.first_measured_day) == (700, 500, day(1), day(9))


def test_incomplete_and_single_snapshots(spark):
    heads, dirs, buckets = history(spark, [(1, noon(1), True, 10), (2, noon(2), False, 99)], {1: {"A": 10}, 2: {"A": 99}}, [(1, day(1), "A", 5, 1)])
    assert T.spanned_days(heads).count() == 0 and T.deltas(heads, dirs).count() == 0
    assert [r.basis for r in T.timeline(heads, dirs, buckets, noon(2)).collect()] == ["retro"]
    assert N.latest(heads).first().id == 1 and N.back(heads).count() == 0


def test_differences(spark):
    pair = lambda d: spark.createDataFrame(list(d.items()), "path string, bytes long")
    got = {r.path: (r.before, r.after, r.delta, r.kind) for r in N.differences(pair({"a": 5, "b": 9, "c": 4, "e": 0}), pair({"a": 9, "b": 5, "d": 7, "e": 0}), 1).collect()}
    assert got == {"a": (5, 9, 4, "grew"), "b": (9, 5, -4, "shrank"), "c": (4, 0, -4, "vanished"), "d": (0, 7, 7, "appeared")}
    top = N.top_differences(N.differences(pair({"a": 5, "b": 9}), pair({"a": 9, "b": 5, "d": 7}), 1), 1).collect()
    assert {(r.direction, r.path) for r in top} == {("grown", "d"), ("shrunk", "b")}


def test_files_differ_only_with_both_sides(spark):
    files = spark.createDataFrame([(1, "a", 5 << 20)], "snapshot_id long, path string, bytes long")
    assert N.diff_files(files, 1, 2).count() == 0
    heads = spark.createDataFrame([(1, "C:", 0.0, "mft", True, N.DEMOTED, 1), (2, "C:", 9.0, "scandir", True, None, 1)], HEAD)
    assert [r.code for r in N.caveats(heads, files, 1, 2, 2).orderBy("ordinal").collect()] == ["demoted", "mixedMethod", "noFilesOneSide"]


def test_retention(spark):
    now = noon(31)
    heads = spark.createDataFrame([(1, "C:", now - 3600), (2, "C:", now), (3, "C:", now - 200 * DAY), (4, "C:", now - 201 * DAY), (5, "D:", now - 200 * DAY)], "id long, drive string, taken_at double")
    assert {r.id for r in N.retention(heads, now).where("keep").collect()} == {2, 3, 5}


def test_repair(spark):
    heads = spark.createDataFrame([(1, 1000.0)], "id long, taken_at double")
    rows = spark.createDataFrame([(1, 5.0), (1, -1.0), (1, 1000.0 + 2 * DAY + 1), (1, None), (1, float("nan"))], "snapshot_id long, mtime double")
    assert [r.mtime for r in N.repaired(rows, heads, ["mtime"]).collect()] == [5.0, None, None, None, None]


def test_hot_spots_pick_from_the_largest(spark):
    rows = [("a", 1, 100, 1, 1.0, 1e9), ("a\\b", 2, 90, 1, 1.0, 1e9), ("a\\c", 2, 80, 1, 1.0, 2e9), ("d", 1, 10, 1, None, None)]
    dirs = spark.createDataFrame(rows, "path string, depth int, bytes long, files long, newest_mtime double, newest_ctime double")
    assert [r.path for r in hotspots.biggest_dirs(dirs, 2).collect()] == ["a", "d"]
    got = hotspots.recently_grown(dirs, 1e9 + DAY, min_bytes=1).collect()
    assert [(r.path, r.days_old) for r in got] == [("a", 1.0)]
    rules = (("b", "bee", "safe"), ("c", "sea", "review"))
    files = spark.createDataFrame([("a\\b\\x", 70, 1.0), ("zc", 60, 1.0), ("y", 99, 1.0)], "path string, bytes long, mtime double")
    got = hotspots.cleanup_candidates(dirs, files, 9, 1, rules).collect()
    assert [(r.path, r.rule) for r in got] == [("a\\b", "bee"), ("a\\c", "sea"), ("zc", "sea")]


EVENTS = "drive string, usn long, timestamp double, reason long, kind string, is_dir boolean, name string, path string, bytes long"


def test_reasons(spark):
    masks = [0x80000200, 0x102, 0x1000, 0x2000, 0x20, 0x800, 0x80000103, 0x400]
    got = spark.createDataFrame([(m,) for m in masks], "reason long").select(reasons.kind("reason"), reasons.describe("reason")).collect()
    assert [r[0] for r in got] == ["delete", "create", "rename_old", "rename_new", "write", "other", "create", "other"]
    assert got[0][1] == "删除+关闭" and got[-1][1] == "0x00000400"


def test_journal_groups(spark):
    t = noon(3)
    rows = [
        ("C:", 1, t, 512, "delete", False, "f", "p\\f", 10), ("C:", 2, t + 1, 512, "delete", False, "f", "p\\f", None), ("C:", 3, t, 512, "delete", False, "g", None, None), ("C:", 4, t, 512, "delete", False, "g", None, 0), ("C:", 5, t, 512, "delete", False, "h", "", 7),
        ("C:", 6, t - DAY / 2 + 3600, 512, "delete", False, "early", "e", 1), ("C:", 7, t, 256, "create", False, "n", "n", None), ("C:", 8, t - 40 * DAY, 512, "delete", False, "old", "o", 1),
    ]
    df = spark.createDataFrame(rows, EVENTS)
    d = {r.day: r for r in journal.daily(df, t + DAY).collect()}
    assert (d[day(3)].deleted, d[day(3)].deleted_bytes_known, d[day(3)].deleted_bytes_unknown_files, d[day(3)].created) == (6, 18, 3, 1)
    top = journal.top_deleted(df, t + DAY, top_n=2).collect()
    assert [(r.rank, r.path, r.bytes, r["count"]) for r in sorted(top, key=lambda r: r["rank"])] == [(1, "p\\f", 10, 2), (2, "h", 7, 1)]
    got = journal.changes(df, "C:", t + DAY).collect()
    assert [(r.name, r["count"]) for r in got] == [("f", 2), ("h", 1), ("early", 1), ("g", 1), ("g", 1)]
    assert journal.unexpired(df, t, 20).count() == 7
    status = spark.createDataFrame([("C:", True, None), ("E:", False, "no")], "drive string, available boolean, reason string")
    cover = {r.drive: r for r in journal.coverage(df, status).collect()}
    assert cover["C:"].days == 41 and cover["E:"].events == 0 and cover["E:"].available is False


def test_journal_upserts(spark):
    new = spark.createDataFrame([("C:", 1, "a", 2), ("C:", 1, "b", 1), ("C:", 2, "c", 1), ("D:", 1, "d", 1)], "drive string, usn long, name string, o int")
    held = spark.createDataFrame([("C:", 2)], "drive string, usn long")
    assert {(r.drive, r.name) for r in journal.deduplicated(held, new, "o").collect()} == {("C:", "b"), ("D:", "d")}


def test_sizes_from_the_newest_snapshot(spark):
    events = spark.createDataFrame([("C:", i, 0.0, 512, "delete", i == 4, "f", p, b) for i, (p, b) in enumerate([("x", None), ("x", 3), ("y", None), (None, None), ("x", None), ("x", None)])], EVENTS)
    files = spark.createDataFrame([(1, "x", 10), (2, "x", 20), (3, "x", 30)], "snapshot_id long, path string, bytes long")
    heads = spark.createDataFrame([(1, "C:", 5.0), (2, "C:", 9.0), (3, "D:", 99.0)], "id long, drive string, taken_at double")
    assert [r.bytes for r in journal.enriched(events, files, heads).orderBy("usn").collect()] == [20, 3, None, None, None, 20]
    assert [r.bytes for r in journal.enriched(events, files, heads, limit=1).orderBy("usn").collect()] == [20, 3, None, None, None, None]


def test_paths_of_records(spark):
    rows = [(10, 5, "a"), (11, 10, "b"), (12, 11, "c"), (20, 21, "x"), (21, 22, "y"), (22, 20, "z"), (23, 22, "in"), (30, 99, "lost"), (31, 30, "u"), (40, 40, "self")]
    got = {r.record: (r.path, r.state) for r in filetable.resolved_paths(spark.createDataFrame(rows, "record long, parent long, name string")).collect()}
    assert got[5] == ("", "ok") and got[12] == ("a\\b\\c", "ok") and got[30][1] == got[31][1] == "orphan"
    assert {got[i][1] for i in (20, 21, 22, 23, 40)} == {"cycle"} and got[20][0] is None


def test_stamps_and_display(spark):
    row = spark.range(1).select(
        S.day(F.lit(0.0)), S.day(F.lit(1709251199.0), "Europe/Berlin"), S.day_start(F.lit("2024-03-31"), 12, "Europe/Berlin"), S.day_start(F.lit("2024-3-1")), S.age_code(F.lit(1e9), 1e9 + 40 * DAY), S.age_band(F.lit(0.0), 1e9),
        display.size_text(F.lit(1536)), display.size_text(F.lit(None).cast("long")), display.short_size_text(F.lit(-(11 << 30))), display.signed_size_text(F.lit(5 << 20)), display.used_percent(F.lit(1), F.lit(4)),
    ).first()
    assert list(row) == ["1970-01-01", "2024-03-01", 1711879200.0, None, "1m", "older", "1.5 KB", "—", "−11 GB", "+5.0 MB", 25.0]


def test_store(spark, tmp_path):
    schema = "path string, is_dir boolean, bytes long, created double, modified double"
    store = Store(spark, str(tmp_path / "store"))
    limits = {"prune": {"min_bytes": 1}, "select_files": {"min_bytes": 1}, "age_buckets": {"min_bytes": 1}}
    for i in (1, 2, 3):
        rows = [("a\\b\\c\\d\\small", False, i, noon(i), None), ("a\\f", False, 100 * i, noon(i), None)]
        store.commit(spark.createDataFrame(rows, schema), i, "C:", noon(i), "scandir", limits=limits)
    assert [r.id for r in N.listed(store.snapshots()).collect()] == [3, 2, 1]
    assert store.rules_boundary() == 4 and store.rules_boundary() == 4 and store.size() > 0
    assert {r.bytes for r in store.read("dirs").where("path = ''").collect()} == {101, 202, 303}
    assert store.demote("C:", 3) == 2 and store.demote("C:", 3) == 0
    assert {(r.snapshot_id) for r in store.read("files").select("snapshot_id").distinct().collect()} == {3}
    assert {r.snapshot_id for r in store.read("dirs").where("depth = 4").collect()} == {3}
    store.drop_old_buckets("C:")
    assert {r.snapshot_id for r in store.read("age_buckets").collect()} == {3}
    assert store.retain(noon(3) + 400 * DAY) == 2 and [r.id for r in store.snapshots().collect()] == [3]
    assert {r.snapshot_id for r in store.read("dirs").collect()} == {3}
    assert store.compact("dirs") == 0 and [r.id for r in store.snapshots().collect()] == [3]


def test_store_journal(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    t = noon(200)
    schema = "drive string, usn long, timestamp double, reason long, is_dir boolean, name string, path string"
    read = lambda rows: spark.createDataFrame([("C:", u, at, 0x80000200 if u % 2 else 0x20, False, f"n{u}", p) for u, at, p in rows], schema)
    journals = lambda i, low, able=True: spark.createDataFrame([("C:", i, low, able, None if able else "no rights")], "drive string, journal_id long, lowest_valid_usn long, available boolean, reason string")
    got = store.collect(read([(1, t, "a"), (2, t, "b"), (3, None, None), (5, t - 181 * DAY, "old")]), journals(7, 1), t)["C:"]
    assert (got["first_run"], got["start_usn"], got["events_read"], got["no_time"]) == (True, 1, 4, 1)
    assert {(r.usn, r.kind, r.timestamp) for r in store.events().collect()} == {(1, "delete", t), (3, "delete", t)}  # the old one is gone
    assert store.cursors().first()[:3] == ("C:", 7, 6)
    got = store.collect(read([(5, t, "x"), (7, t + 1, "c")]), journals(7, 1), t + 1)["C:"]
    assert (got["first_run"], got["journal_reset"], got["start_usn"], got["events_read"]) == (False, False, 6, 1) and store.events().count() == 3
    assert store.collect(read([]), journals(None, None, False), t + 2) == {} and store.status().first()[:3] == ("C:", False, "no rights")
    assert store.cursors().first().next_usn == 8 and store.events().count() == 3
    got = store.collect(read([(7, t, "other"), (9, t, "d")]), journals(8, 2), t + 3)["C:"]  # another journal: from its start, known numbers are dropped
    assert got["journal_reset"] and {r.usn: r.path for r in store.events().collect()} == {1: "a", 3: None, 7: "c", 9: "d"}
    assert store.status().first()[:3] == ("C:", True, None) and store.cursors().first()[:3] == ("C:", 8, 10)
    assert store.prune_events(t + 400 * DAY) == 1 and store.events().count() == 0
    assert store.maintain("C:", 1, t) == {}


def test_inserts_keep_what_is_there(spark):
    held = spark.createDataFrame([(1, "a", 5)], "snapshot_id long, path string, bytes long")
    new = spark.createDataFrame([(1, "a", 9), (1, "b", 2), (1, "b", 7), (2, "a", 1)], held.schema)
    assert {tuple(r) for r in N.inserted(held, new, ["snapshot_id", "path"], -F.col("bytes")).collect()} == {(1, "a", 5), (1, "b", 7), (2, "a", 1)}


def test_sizes_are_the_rollups(spark):
    rows = [("a\\b\\c\\f", False, 5, None, None), ("a\\g", False, 7, None, None), ("d", True, 0, None, None), ("top", False, 1, None, None), ("d\\e\\x", True, 0, None, None)]
    entries = spark.createDataFrame(rows, "path string, is_dir boolean, bytes long, created double, modified double")
    whole = {(r.path, r.depth, r.bytes) for r in tree.rollup(entries, 1e9).where("depth <= 2").collect()}
    assert {tuple(r) for r in tree.sizes(entries, 2).collect()} == whole


def test_api(spark):
    assert [api.drive_of(x) for x in ("c", "C:", "c:\\", None, "d:/")] == ["C:", "C:", "C:", "C:", "D:"] and api.drive_of("", ["E:"]) == "E:"
    with pytest.raises(ValueError):
        api.drive_of("c:\\x")
    assert (api.number("9999", 5, 1, 50), api.number(None, 5, 1, 50), api.number("-3", 5, 1, 50)) == (50, 5, 1)
    with pytest.raises(ValueError):
        api.number("x", 1, 1, 2)
    assert api.path_of("C:/a/b/") == "a\\b" and api.path_of("c:\\") == ""
    heads, dirs, buckets = history(spark, [(1, noon(1), True, 1000), (2, noon(2), True, 90 << 20)], {1: {"Users": 600}, 2: {"Users": 90 << 20}}, [(2, day(2), "A", 5, 1)])
    dirs = dirs.withColumns({"files": F.lit(1).cast("long"), "newest_mtime": F.lit(noon(2)), "newest_ctime": F.lit(noon(2))})
    files = spark.createDataFrame([(2, "Users\\pagefile.sys", 80 << 20, 1.0)], "snapshot_id long, path string, bytes long, mtime double")
    events, status = spark.createDataFrame([], EVENTS), spark.createDataFrame([], "drive string, available boolean, reason string")
    engine = api.Engine(heads, dirs, files, buckets, events, status, noon(3))
    assert engine.status().first().snapshots == 2
    line = engine.timeline("c")
    assert line["days"].count() == 1 and line["summary"].first().measured_added == (90 << 20) - 600 and line["coverage"].count() == 0
    assert line["contributors"].first().path == "Users" and line["written"].first().path == "A"
    level = engine.tree(path="")
    assert level["children"].first().name == "Users" and level["snapshot"].first().id == 2 and level["node"].count() == 0
    assert engine.tree(path="Users")["node"].select("name", "parent").first()[:] == ("Users", "")
    assert engine.tree("D:")["snapshot"].count() == engine.tree("D:")["children"].count() == 0
    assert engine.snapshots("C:", 1).count() == 1 and engine.changes()["events"].count() == 0
    assert [r.rule for r in engine.hotspots()["cleanup"].collect()] == ["pagefile"] and engine.hotspots()["ages"].count() == 6
    found = engine.diff(before=2, after=1)
    assert found["dirs"].first().path == "Users" and [r.code for r in found["caveats"].collect()] == ["noFilesOneSide"]
    assert engine.diff(back=5) is None
    assert {r.side: r.id for r in engine.diff(before=0, after=0)["snapshots"].collect()} == {"before": 1, "after": 2}
    rules = api.Engine(heads, dirs, files, buckets, events, status, noon(3), boundary=2).diff()
    assert [r.code for r in rules["caveats"].orderBy("ordinal").collect()] == ["rulesChanged", "noFilesOneSide"]
    space = spark.createDataFrame([("C:", 100, 30, True)], "drive string, total_bytes long, free_bytes long, present boolean")
    live = {r.drive: r for r in api.Engine(heads, dirs, files, buckets, events, status, noon(3), defaults=("C:", "E:"), capacity=space).status().collect()}
    assert live["C:"].live_used_bytes == 70 and live["C:"].present and not live["E:"].present
    with pytest.raises(LookupError):
        engine.diff(before=1, after=77)
    with pytest.raises(LookupError):
        engine.tree(snapshot=77)
    assert json.loads(api.as_json(heads).first().value)["note"] is None
    with pytest.raises(Exception, match="NaN"):
        api.as_json(spark.range(1).select(F.lit(float("nan")).alias("x"))).collect()
