"""The store keeps all or nothing, whatever fails."""

import shutil

import pytest
from pyspark.sql import functions as F

from accretion import files
from accretion.operators import manifest as M
from accretion.operators.store import Store

from .test_history import DAY, noon

SCHEMA = "path string, is_dir boolean, bytes long, created double, modified double"
LIMITS = {"prune": {"min_bytes": 1}, "select_files": {"min_bytes": 1}, "age_buckets": {"min_bytes": 1}}


def put(spark, store, i, bytes_=None, at=None):
    rows = [("a\\b\\c\\d\\small", False, bytes_ or i, noon(i), None), ("a\\f", False, 100 * i, noon(i), None)]
    store.commit(spark.createDataFrame(rows, SCHEMA), i, "C:", at or noon(i), "scandir", limits=LIMITS)


def state(store):
    """All that a reader sees."""
    return {t: sorted(map(repr, store.read(t).collect())) for t in ("dirs", "files", "age_buckets", "snapshots", "cursors", "status", "meta")} | {"events": sorted(map(repr, store.events().collect()))}


@pytest.fixture(scope="module")
def three(spark, tmp_path_factory):
    out = Store(spark, str(tmp_path_factory.mktemp("three") / "store"))
    for i in (1, 2, 3):
        put(spark, out, i)
    return out.root


@pytest.fixture
def store(spark, three, tmp_path):
    """A store with three snapshots."""
    shutil.copytree(three, tmp_path / "store")
    return Store(spark, str(tmp_path / "store"))


def journal(spark, low=1):
    return spark.createDataFrame([("C:", 7, low, True, None)], "drive string, journal_id long, lowest_valid_usn long, available boolean, reason string")


def reading(spark, usns):
    return spark.createDataFrame([("C:", u, noon(3), 0x80000200, False, f"n{u}", f"p{u}") for u in usns], "drive string, usn long, timestamp double, reason long, is_dir boolean, name string, path string")


CHANGES = {
    "commit": lambda spark, s: put(spark, s, 4),
    "demote": lambda spark, s: s.demote("C:", 3),
    "retain": lambda spark, s: s.retain(noon(3) + 400 * DAY),
    "buckets": lambda spark, s: s.drop_old_buckets("C:"),
    "collect": lambda spark, s: s.collect(reading(spark, [1, 3, 5]), journal(spark), noon(3)),
    "compact": lambda spark, s: s.compact("dirs", most=1),
    "boundary": lambda spark, s: s.rules_boundary(),
}


@pytest.mark.parametrize("name", CHANGES)
def test_every_step_may_fail(spark, store, monkeypatch, name):
    """Each write and each publication fails in turn: readers see all that was, and the same change then goes through."""
    before, step = state(store), 0
    reader, there = Store(spark, store.root), store.tables.manifest()
    write, publish = M.Tables.write, M.Tables._publish
    while True:
        left = [step]

        def dies(f, left=left):
            def run(*a, **k):
                if not left[0]:
                    left[0] = -1
                    raise OSError("lost")
                left[0] -= 1
                return f(*a, **k)

            return run

        monkeypatch.setattr(M.Tables, "write", dies(write))
        monkeypatch.setattr(M.Tables, "_publish", dies(publish))
        try:
            CHANGES[name](spark, store)
            break
        except OSError:
            assert reader.tables.manifest() == there  # and its folders are never written again
            step += 1
    assert step >= 1
    reader.tables.manifest = lambda: there
    assert state(reader) == before
    monkeypatch.undo()
    after = state(Store(spark, store.root))
    assert after == before if name == "compact" else after != before


def test_lost_task(spark, store):
    """A job that dies while a part is written loses nothing."""
    before = state(store)
    bad = store.read("dirs").withColumn("bytes", F.when(F.col("bytes") < 300, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("bytes")))
    with pytest.raises(Exception, match="lost"):
        store.tables.swap(store._write(bad, "dirs"), store.tables.manifest().of("dirs"))
    assert state(store) == before
    assert store.tables.sweep(0.0) >= 1 and state(store) == before


def test_two_writers(spark, store):
    one, two = Store(spark, store.root), Store(spark, store.root)
    parts = one.tables.manifest().of("dirs")
    two.compact("dirs", most=1)
    with pytest.raises(M.Conflict):  # what it replaces is gone
        one.tables.swap(one._write(one.tables.rows("dirs", parts), "dirs"), parts)
    number = one.tables.manifest().number
    manifest = one.tables.manifest
    stale = [manifest()]
    put(spark, two, 4)
    one.tables.manifest = lambda: stale.pop() if stale else manifest()  # looked before the other published
    put(spark, one, 5)
    assert [r.id for r in store.snapshots().orderBy("id").collect()] == [1, 2, 3, 4, 5] and manifest().number == number + 2
    assert not files.put_new(spark, f"{store.root}/{M.FOLDER}/{number:020d}.json", "{}")


def test_readings_that_cross(spark, store, monkeypatch):
    store.collect(reading(spark, [1]), journal(spark), noon(3))
    late = Store(spark, store.root)
    write, first = Store._write, [True]

    def between(self, *a, **k):
        if first.pop() if first else False:
            store.collect(reading(spark, [1, 3]), journal(spark), noon(3) + 1)
        return write(self, *a, **k)

    monkeypatch.setattr(Store, "_write", between)
    with pytest.raises(M.Conflict):
        late.collect(reading(spark, [1, 3]), journal(spark), noon(3) + 2)
    assert sorted(r.usn for r in store.events().collect()) == [1, 3] and store.cursors().first().next_usn == 4


def test_sweep_keeps_what_readers_hold(spark, store):
    rows = store.read("dirs")  # by the manifest of now
    want = sorted(map(repr, rows.collect()))
    store.compact("dirs", most=1)
    assert store.tables.sweep() == 0 and sorted(map(repr, rows.collect())) == want
    assert store.tables.sweep(0.0) >= 3
    with pytest.raises(Exception, match=r"(?i)exist|not found"):
        rows.select(F.sum("bytes")).collect()
    assert sorted(map(repr, store.read("dirs").collect())) == want
    assert len(files.names(spark, f"{store.root}/{M.FOLDER}")) == 1


def test_repair_goes_on(spark, store, monkeypatch):
    """Stamps of adopted rows are repaired once, part by part, and a repair that is cut off goes on."""
    odd = store.read("dirs").where("snapshot_id < 3").withColumns({"snapshot_id": F.col("snapshot_id") + 10, "newest_mtime": F.lit(-5.0), "newest_ctime": F.lit(9e9)})
    assert store.adopt("dirs", odd) == 2
    store.adopt("snapshots", store.snapshots().where("id < 3").withColumn("id", F.col("id") + 10))
    swap, left = M.Tables.swap, [1]

    def once(self, *a, **k):
        if not left[0]:
            raise OSError("cut off")
        left[0] -= 1
        return swap(self, *a, **k)

    monkeypatch.setattr(M.Tables, "swap", once)
    with pytest.raises(OSError):
        store.repair()
    monkeypatch.undo()
    dirty = store.read("dirs").where("newest_mtime < 0 OR newest_ctime > 5e9").select("snapshot_id").distinct()
    assert dirty.count() == 1
    assert store.repair() == 1 and dirty.count() == 1  # the reader still holds the old parts
    assert store.read("dirs").where("newest_mtime < 0 OR newest_ctime > 5e9").count() == 0 and store.repair() == 0


def test_statistics(spark, store):
    assert store.analyze("dirs") == 3 and store.analyze("dirs") == 0
    rows = store.statistics().where("table = 'dirs'").collect()
    assert sum(r.rows for r in rows) == store.read("dirs").count() and all(r.bytes > 0 and r.files == 1 for r in rows)
    facts = store.tables.manifest().of("dirs", snapshot_id=2)[0].facts
    assert (facts["least_depth"], facts["most_depth"], facts["least_path"]) == ("0", "4", "")
    assert store.read("dirs", drive="C:", snapshot_id=[1, 2]).select("snapshot_id").distinct().count() == 2


def test_level_reads_a_few_row_groups(spark, tmp_path):
    """Of a million directories the children of one and a single path are found without reading the others."""
    from accretion.operators import tree

    n = F.col("id")
    path = F.concat_ws("\\", F.format_string("a%03d", n % 100), F.format_string("b%03d", F.floor(n / 100) % 100), F.format_string("c%03d", F.floor(n / 10_000)))
    zero = [F.lit(0).cast("long").alias(c) for c in ("own_bytes", "files", "dirs", "folded_children", "folded_bytes")] + [F.lit(None).cast("double").alias(c) for c in ("newest_mtime", "newest_ctime")]
    dirs = spark.range(1_000_000).select(path.alias("path"), F.lit(3).alias("depth"), n.alias("bytes"), *zero, F.lit("C:").alias("drive"), F.lit(1).cast("long").alias("snapshot_id"))
    store = Store(spark, str(tmp_path / "store"))
    store.tables.swap(store._write(dirs, "dirs"))

    def read(df):
        rows = df.collect()
        scans, todo = [], [df._jdf.queryExecution().executedPlan()]
        while todo:
            plan = todo.pop()
            if "FileSourceScan" in plan.getClass().getSimpleName():
                scans.append(plan.metrics().apply("numOutputRows").value())
            if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                todo.append(plan.executedPlan())
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
        return rows, sum(scans)

    rows, seen = read(tree.children(store.read("dirs", drive="C:", snapshot_id=1), "a007\\b042"))
    assert len(rows) == 100 and seen <= 60_000
    rows, seen = read(store.read("dirs").where("path = 'a007\\\\b042\\\\c050'"))
    assert len(rows) == 1 and seen <= 60_000
