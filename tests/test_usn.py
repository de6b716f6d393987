"""Journals of binary buffers: the index of segments, batches, filters, restarts; paths from an image."""

import struct
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from accretion.operators.store import Store
from accretion.plans import fixtures as X
from accretion.sources import readers, resolver, usn
from accretion.sources.usn import Segments, _Stream

TICKS = (int(time.time()) - 3600 + 11_644_473_600) * 10_000_000


def info(folder, next_usn, lowest=1, journal_id=7):
    Path(folder, usn.INFO).write_bytes(struct.pack("<QqqqqQQ", journal_id, 0, next_usn, lowest, 1 << 62, 0, 0))


def segment(folder, usns, reason=0x80000200):
    body = b"".join(X.usn_record(u, u + (3 << 48), 5, TICKS, reason if u % 5 else 0x100, 0, f"n{u}", 2 + u % 2) for u in usns)
    Path(folder, f"{usns[0]:020d}.usn").write_bytes((usns[-1] + 1).to_bytes(8, "little") + body)


@pytest.fixture
def folder(tmp_path):
    for a in range(1, 101, 10):
        segment(tmp_path, range(a, a + 10))
    info(tmp_path, 101)
    return str(tmp_path)


def test_batches_open_what_they_need(folder):
    stream = _Stream({"path": folder})
    start = stream.initialOffset()
    end = stream.latestOffset()
    assert end["next_usn"] == 101 and stream.segments.heads == 10
    assert sum(len(t.names) for t in stream.partitions(start, end)) == 10
    segment(folder, range(101, 111))
    info(folder, 111)
    after = stream.latestOffset()
    assert stream.segments.heads == 11  # heads of new files only
    assert [t.names for t in stream.partitions(end, after)] == [[f"{101:020d}.usn"]]
    read = [r for t in stream.partitions(end, after) for b in stream.read(t) for r in b.to_pylist()]
    assert [r["usn"] for r in read] == list(range(101, 111)) and {r["kind"] for r in read} == {"delete", "create"}
    assert stream.partitions(after, after) == []
    # another journal, and one that has lost what was next, start over
    info(folder, 111, lowest=50, journal_id=8)
    assert _Stream.begin(after, stream.latestOffset()) == (50, True)
    assert _Stream.begin({"journal_id": 7, "lowest": 1, "next_usn": 20}, {"journal_id": 7, "lowest": 30, "next_usn": 90}) == (30, True)


def test_admission(folder):
    size = next(Path(folder).glob("*.usn")).stat().st_size
    stream = _Stream({"path": folder, "maxEventsPerBatch": str(2 * (size // usn.LEAST_EVENT) + 5)})
    at, batches = stream.initialOffset(), []
    while (end := stream.latestOffset()) != at:
        batches.append(sum(len(t.names) for t in stream.partitions(at, end)))
        at = end
    assert sum(batches) == 10 and max(batches) == 2
    small = _Stream({"path": folder, "maxEventsPerBatch": "1"})
    small.initialOffset()
    assert small.latestOffset()["next_usn"] == 11  # one segment at least


def test_table_and_filters(spark, folder):
    readers.register(spark)
    rows = spark.read.format("usnjournal").option("path", folder).option("drive", "D:").load()
    assert rows.count() == 100 and rows.where("journal_reset").count() == 0
    some = rows.where("usn >= 35 AND usn < 52 AND kind = 'create'")
    assert sorted(r.usn for r in some.collect()) == [35, 40, 45, 50]
    # Spark leaves the comparisons to the source
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    reader = usn._Reader({"path": folder})
    left = list(reader.pushFilters([usn.GreaterThanOrEqual(("usn",), 35), usn.LessThan(("usn",), 52), usn.In(("kind",), ("create", "write")), usn.EqualTo(("name",), "n40")]))
    assert left == [usn.EqualTo(("name",), "n40")]
    assert [n for t in reader.partitions() for n in t.names] == [f"{a:020d}.usn" for a in (31, 41, 51)]
    assert [r["usn"] for t in reader.partitions() for b in reader.read(t) for r in b.to_pylist()] == [35, 40, 45, 50]


def test_odd_segments(tmp_path):
    segment(tmp_path, range(1, 4))
    (tmp_path / "empty.usn").write_bytes(b"")
    (tmp_path / "no_event.usn").write_bytes((9).to_bytes(8, "little") + b"\0" * 200)
    (tmp_path / "other.txt").write_bytes(b"x")
    info(tmp_path, 4)
    found = Segments(f"file://{tmp_path}")
    assert [(s.first, s.next) for s in found.all()] == [(1, 4)] and found.heads == 3 and found.all() and found.heads == 3
    assert found.between(4, 99) == [] and len(found.between(3, 4)) == 1


def test_restart_goes_on_within_the_limit(spark, folder, tmp_path_factory):
    readers.register(spark)
    out = tmp_path_factory.mktemp("out")
    size = next(Path(folder).glob("*.usn")).stat().st_size
    sizes = []

    def put(batch, batch_id):
        sizes.append(batch.count())
        batch.select("usn").write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    options = {"path": folder, "maxEventsPerBatch": str(2 * (size // usn.LEAST_EVENT) + 5)}
    for _ in range(8):  # each is a restart that does one batch
        before = len(sizes)
        query = spark.readStream.format("usnjournal").options(**options).load().writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/offsets").trigger(once=True).start()
        query.awaitTermination()
        if len(sizes) == before:
            break
    assert sizes == [20] * 5
    assert sorted(r.usn for r in spark.read.parquet(f"{out}/rows").select("usn").collect()) == list(range(1, 101))


# -- paths ------------------------------------------------------------------------------------------------------------------


def volume(path, rows, size=64):
    """An image with directories (record, sequence, parent, name)."""
    boot = bytearray(512)
    boot[3:11] = b"NTFS    "
    struct.pack_into("<HB", boot, 11, 512, 8)
    struct.pack_into("<QQQ", boot, 40, 1 << 20, 4, 2)
    boot[64] = 256 - 10
    runs = X.run_list_bytes([size // 4], [4])
    data = struct.pack("<IIBBHHHQQHHIQQQ", 0x80, 72, 1, 0, 64, 0, 0, 0, size // 4 - 1, 64, 0, 0, size * 1024, size * 1024, size * 1024) + runs.ljust(8, b"\0")
    image = bytearray(boot.ljust(16384, b"\0") + b"\0" * size * 1024)
    image[16384 : 16384 + 1024] = X.file_record_bytes(0, 1, 5 + (5 << 48), "$MFT", 1, data)
    for number, sequence, parent, name, *flags in rows:
        image[16384 + 1024 * number : 17408 + 1024 * number] = X.file_record_bytes(number, sequence, parent, name, *flags)
    path.write_bytes(image)


def ref(record, sequence):
    return record + (sequence << 48)


def test_resolver(spark, tmp_path):
    root = ref(5, 5)
    rows = [(20, 1, root, "a"), (21, 2, ref(20, 1), "b"), (22, 3, ref(21, 2), "c"), (23, 1, ref(20, 9), "under what was there before"), (24, 1, root, "free", 2), (25, 1, ref(26, 1), "x"), (26, 1, ref(25, 1), "y"), (27, 40_000, root, "high")]
    volume(tmp_path / "disk.img", rows)
    high = ref(27, 40_000) - (1 << 64)  # as a signed number
    asked = {ref(22, 3): "a\\b\\c", ref(21, 2): "a\\b", ref(21, 3): None, ref(23, 1): None, ref(24, 1): None, ref(25, 1): None, ref(99, 1): None, ref(5, 5): "", high: "high", 1 << 40: None}
    got = resolver.paths(spark, str(tmp_path / "disk.img"), spark.createDataFrame([(r,) for r in [*asked, None, ref(22, 3)]], "reference long"))
    assert {r.reference: r.path for r in got.collect()} == asked
    image = resolver.Image(f"file:{tmp_path / 'disk.img'}")
    assert image.place(3) == 16384 + 3 * 1024 and image.place(64) is None


def test_store_asks_once(spark, tmp_path):
    """Each reference is asked for once; misses are believed for a day, and a reading that is cut off asks again."""
    volume(tmp_path / "disk.img", [(20, 1, ref(5, 5), "a")])
    store, asked = Store(spark, str(tmp_path / "store")), []

    def resolve(references):
        asked.append(sorted(r.reference for r in references.collect()))
        return resolver.paths(spark, str(tmp_path / "disk.img"), references)

    def collect(usns, now):
        rows = [("C:", u, now, 0x200, False, f"n{u}", ref(20, 1 + u % 2)) for u in usns]
        readings = spark.createDataFrame(rows, "drive string, usn long, timestamp double, reason long, is_dir boolean, name string, parent_full long")
        store.collect(readings, spark.createDataFrame([("C:", 7, 1, True, None)], "drive string, journal_id long, lowest_valid_usn long, available boolean, reason string"), now, resolvers={"C:": resolve})

    t = 1_700_000_000.0
    collect([1, 2], t)
    collect([3, 4], t + 60)
    collect([5, 6], t + 2 * 86400)
    assert asked == [[ref(20, 1), ref(20, 2)], [], [ref(20, 2)]]
    assert {r.usn: r.path for r in store.events().collect()} == {1: None, 2: "a\\n2", 3: None, 4: "a\\n4", 5: None, 6: "a\\n6"}


def test_records_asked_for_are_read(tmp_path):
    """Ranges of records choose extents; kinds are told before attributes are decoded."""
    volume(tmp_path / "disk.img", [(k, 1, ref(5, 5), f"d{k}") for k in range(16, 60)])
    reader = readers._FileTableReader({"path": str(tmp_path / "disk.img")})
    whole = sum(p.records for p in reader.partitions())
    left = list(reader.pushFilters([readers.GreaterThan(("record",), 30), readers.LessThanOrEqual(("record",), 34), readers.EqualTo(("kind",), "entry")]))
    parts = reader.partitions()
    assert left == [] and whole == 64 and sum(p.records for p in parts) == 4
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record"] for r in rows] == [31, 32, 33, 34]
    other = readers._FileTableReader({"path": str(tmp_path / "disk.img")})
    assert list(other.pushFilters([readers.EqualTo(("kind",), "extension")])) == [] and not [r for p in other.partitions() for b in other.read(p) for r in b.to_pylist()]


def test_command_line(spark, folder, tmp_path, capsys):
    """A journal of buffers is taken in, with paths of an image, and a second time only what is new."""
    from accretion.__main__ import main

    volume(tmp_path / "disk.img", [(20, 1, ref(5, 5), "a")])
    given = [folder, "--store", str(tmp_path / "store"), "--image", str(tmp_path / "disk.img")]
    assert main(["journal", *given]) == 0
    segment(folder, range(101, 111))
    info(folder, 111)
    assert main(["journal", *given]) == 0
    store = Store(spark, str(tmp_path / "store"))
    assert store.cursors().first()[:3] == ("C:", 7, 111) and store.events().count() == 110
    assert {r.path for r in store.events().where("usn <= 2").collect()} == {"n1", "n2"}  # in the root
    assert main(["doctor", folder]) == 0 and '"source":"usnjournal","works":true' in capsys.readouterr().out
