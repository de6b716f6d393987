"""Binary decoders against bytes made here, data sources, and streams that resume."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from accretion.plans.fixtures import run_list_bytes, usn_record
from accretion.sources import ntfs, readers
from accretion.streaming import journal_stream

TICKS = (1_700_000_000 + ntfs.FILETIME_SHIFT) * 10_000_000


def attribute(kind, value=b"", name="", spread=None):
    text = name.encode("utf-16-le")
    head = 24 if spread is None else 64
    offset = head + (len(text) + 7) // 8 * 8
    body = struct.pack("<IH", len(value), offset).ljust(8, b"\0") if spread is None else struct.pack("<QQHHIQQQ", spread.get("lowest", 0), 0, offset, 0, 0, spread["allocated"], spread["real"], spread["real"])
    body = (body + text).ljust(offset - 16, b"\0") + value
    size = (16 + len(body) + 7) // 8 * 8
    return (struct.pack("<IIBBHHH", kind, size, spread is not None, len(name), head, 0, 0) + body).ljust(size, b"\0")


def name_of(text, parent=5, namespace=3):
    return attribute(ntfs.NAME, struct.pack("<QQQQQQQIIBB", parent + (9 << 48), TICKS, TICKS, 0, 0, 0, 0, 0x20, 0, len(text), namespace) + text.encode("utf-16-le"))


def record(*attributes, flags=1, base=0, number=0, torn=False):
    body = b"".join(attributes) + struct.pack("<I", ntfs.END)
    head = ntfs.RECORD_HEAD.pack(b"FILE", 48, 3, 0, 1, 1, 56, flags, 56 + len(body), 1024, base, 0, 0, number)
    raw = bytearray((head + b"\0" * 8 + body).ljust(1024, b"\0"))
    mark = b"\x07\x00"
    raw[48:50] = mark
    for i in (1, 2):
        raw[48 + 2 * i : 50 + 2 * i] = raw[i * 512 - 2 : i * 512]
        raw[i * 512 - 2 : i * 512] = mark if not torn else b"\xff\xff"
    return bytes(raw)


STANDARD = attribute(ntfs.STANDARD, struct.pack("<QQQQI", TICKS, TICKS + 10_000_000, 0, 0, 0x20))


def test_records():
    row = ntfs.file_record(record(STANDARD, name_of("DOS~1", namespace=2), name_of("file.bin"), attribute(ntfs.DATA, b"x" * 10), attribute(ntfs.DATA, b"y" * 5, "Zone")), 77)
    assert (row["kind"], row["record"], row["parent"], row["name"], row["bytes"], row["logical_bytes"], row["created"]) == ("entry", 77, 5, "file.bin", 15, 10, 1_700_000_000.0)
    packed = ntfs.file_record(record(name_of("k.dll"), attribute(ntfs.DATA, spread={"allocated": 800, "real": 800}), attribute(ntfs.DATA, b"", "WofCompressedData", {"allocated": 300, "real": 300})), 1)
    assert (packed["bytes"], packed["logical_bytes"], packed["wof"]) == (300, 800, True)
    extension = ntfs.file_record(record(attribute(ntfs.DATA, spread={"allocated": 64, "real": 60}), base=77 + (1 << 48)), 80)
    assert (extension["kind"], extension["base"], extension["unnamed"]) == ("extension", 77, 64)
    assert ntfs.file_record(record(attribute(ntfs.DATA, spread={"allocated": 64, "real": 60, "lowest": 9}), base=77), 80) is None
    assert ntfs.file_record(record(name_of("d"), flags=3), 2)["is_dir"] and ntfs.file_record(record(name_of("gone"), flags=0), 2) is None
    assert ntfs.file_record(record(name_of("t"), torn=True), 3)["kind"] == "torn" and ntfs.file_record(record(STANDARD), 4)["kind"] == "unnamed" and ntfs.file_record(b"BAAD" + b"\0" * 1020, 5) is None
    every = ntfs.mended(record(STANDARD, name_of("x")))
    assert [a[0] for a in ntfs.attributes(every)] == [ntfs.STANDARD, ntfs.NAME] and not list(ntfs.attributes(every, frozenset()))


def test_run_lists():
    data = run_list_bytes([3, 2, 700], [1000, None, -500])
    found = ntfs.runs(data)
    assert found == [(0, 1000, 3), (3, None, 2), (5, 500, 700)]
    assert ntfs.clusters(found) == 703 and ntfs.clusters(found, sparse=True) == 705 and list(ntfs.extents(found, 10)) == [(10000, 30), (5000, 7000)]
    for bad in (b"\x21\x05", b"\x10\x01", run_list_bytes([1], [-1])):
        with pytest.raises(ValueError):
            ntfs.runs(bad if bad[0] != 0x10 else b"\x20\x01\x01")


def boot(table_cluster=4, cluster=8):
    sector = bytearray(512)
    sector[3:11] = b"NTFS    "
    struct.pack_into("<HB", sector, 11, 512, cluster)
    struct.pack_into("<QQQ", sector, 40, 1 << 20, table_cluster, 2)
    sector[64] = 256 - 10
    return bytes(sector)


def test_geometry():
    shape = ntfs.geometry(boot())
    assert (shape.sector, shape.cluster, shape.table_at, shape.record) == (512, 4096, 16384, 1024)
    for bad in (b"x", b"\0" * 512):
        with pytest.raises(ValueError):
            ntfs.geometry(bad)


def image(path):
    """A volume whose table lies in two pieces with a sparse one between."""
    pieces = run_list_bytes([1, 3, 2], [4, None, 6])  # records 0..3, 4..15, 16..23
    table = [record(name_of("$MFT"), attribute(ntfs.DATA, pieces, spread={"allocated": 16384, "real": 16384})), *[b"\0" * 1024] * 3]
    second = [record(STANDARD, name_of("dir", 5), flags=3), record(STANDARD, name_of("f.bin", 16), attribute(ntfs.DATA, b"z" * 100)), record(STANDARD, name_of("lost", 99), attribute(ntfs.DATA, b"q")), record(attribute(ntfs.DATA, spread={"allocated": 4096, "real": 4000}), base=17), *[b"\0" * 1024] * 4]
    data = bytearray(boot().ljust(4 * 4096, b"\0") + b"".join(table))
    data = data.ljust(10 * 4096, b"\0") + b"".join(second)
    path.write_bytes(data)


def test_file_table_source(spark, tmp_path):
    readers.register(spark)
    image(tmp_path / "disk.img")
    rows = {r.record: r for r in spark.read.format("filetable").load(str(tmp_path / "disk.img")).collect()}
    assert set(rows) == {0, 16, 17, 18, 19} and rows[16].name == "dir" and rows[19].kind == "extension"
    got = {r.path: r.bytes for r in readers.image_entries(spark, str(tmp_path / "disk.img")).collect()}
    assert got == {"dir": 0, "dir\\f.bin": 4096}


def test_walk_and_fallback(spark, tmp_path):
    readers.register(spark)
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "f.txt").write_text("hello")
    (tmp_path / "top").write_text("xy")
    os.symlink(tmp_path, tmp_path / "a" / "loop")
    walk = lambda s: s.read.format("walk").load(str(tmp_path))
    got = {r.path: (r.is_dir, r.bytes) for r in walk(spark).collect()}
    assert got == {"a": (True, 0), "a\\b": (True, 0), "a\\b\\f.txt": (False, 5), "a\\loop": (False, 0), "top": (False, 2)}
    rows, source, reason = readers.ingest(spark, [("mft", lambda s: readers.image_entries(s, str(tmp_path / "none"))), ("scandir", walk)])
    assert source == "scandir" and reason.startswith("mft") and rows.count() == 5


def test_journal_buffers(spark, tmp_path):
    body = usn_record(10, 7 + (3 << 48), 5, TICKS, 0x200, 0x10, "dir") + usn_record(20, 8, 9, 0, 0x102, 0, "naïve", 3) + usn_record(30, 8, 9, 0, 1, 0, "v4", 4)
    usn, events = ntfs.journal_events((99).to_bytes(8, "little") + body)
    assert usn == 99 and [(e["usn"], e["parent"], e["name"], e["is_dir"], e["timestamp"]) for e in events] == [(10, 5, "dir", True, 1_700_000_000.0), (20, 9, "naïve", False, None)]
    assert len(ntfs.journal_events(b"\0" * 8 + body[:-20] + b"\xff" * 4)[1]) == 2 and ntfs.journal_events(b"x") == (0, [])
    assert ntfs.journal_info(struct.pack("<QqqqqQQ", 1, 2, 3, 4, 5, 6, 7)).lowest_valid_usn == 4
    with pytest.raises(ValueError):
        ntfs.journal_info(b"")
    (tmp_path / "1.bin").write_bytes((99).to_bytes(8, "little") + body)
    assert [r.name for r in readers.journal_buffers(spark, str(tmp_path)).orderBy("usn").collect()] == ["dir", "naïve"]


def put(folder, n, journal_id, usns, lowest=0):
    with open(folder / f"events-{n}.json", "w") as f:
        for u in usns:
            f.write(json.dumps({"journal_id": journal_id, "drive": "C:", "usn": u, "timestamp": 1.7e9 + u, "reason": 0x200 if u % 2 else 0x1, "is_dir": False, "name": f"n{u}"}) + "\n")
    (folder / "journal.json").write_text(json.dumps({"journal_id": journal_id, "lowest_valid_usn": lowest, "next_usn": max(usns) + 1}))


def test_journal_stream_resumes_and_resets(spark, tmp_path):
    readers.register(spark)
    source, target = tmp_path / "journal", tmp_path / "table"
    source.mkdir()

    def run():
        rows = journal_stream.once(journal_stream.prepared(spark.readStream.format("journalfolder").option("path", str(source)).option("maxUsnsPerBatch", "4").load()))
        query = rows.writeStream.foreachBatch(journal_stream.sink(str(target))).option("checkpointLocation", str(tmp_path / "offsets")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.usn for r in spark.read.parquet(str(target)).collect())

    put(source, 1, 7, range(1, 11))
    assert run() == [1, 3, 5, 7, 9]
    put(source, 2, 7, range(8, 14))  # with overlap
    assert run() == [1, 3, 5, 7, 9, 11, 13]
    put(source, 3, 8, [1, 15], lowest=1)  # another journal: read from its start, known keys are dropped
    assert run() == [1, 3, 5, 7, 9, 11, 13, 15]
    folder = spark.read.format("journalfolder").load(str(source))
    assert sorted(r.usn for r in folder.collect()) == [1, 15]
    assert spark.read.format("journalfolder").option("reasonMask", "1").load(str(source)).count() == 0
    assert [r.usn for r in spark.read.format("journalfolder").option("start", "2").load(str(source)).collect()] == [15]


def test_capacity(spark, tmp_path):
    got = {r.drive: r for r in readers.capacity(spark, {"C:": str(tmp_path), "X:": str(tmp_path / "none")}).collect()}
    assert got["C:"].present and 0 < got["C:"].free_bytes <= got["C:"].total_bytes and not got["X:"].present


def test_command_line(spark, tmp_path, capsys):
    from accretion.__main__ import main

    (tmp_path / "data" / "sub").mkdir(parents=True)
    (tmp_path / "data" / "sub" / "f.txt").write_text("hello")
    journal = tmp_path / "journal"
    journal.mkdir()
    put(journal, 1, 7, range(1, 4))
    store = ["--store", str(tmp_path / "store")]
    assert main(["scan", str(tmp_path / "data"), *store]) == 0
    assert main(["journal", str(journal), *store]) == 0 and main(["journal", str(tmp_path / "none"), *store]) == 1
    capsys.readouterr()
    assert main(["show", "tree", *store]) == 0 and main(["show", "snapshots", *store]) == 0 and main(["folder", str(tmp_path / "data")]) == 0
    shown = capsys.readouterr().out
    assert "# snapshot" in shown and "# children" in shown and '"name":"sub"' in shown


def test_watermark_needs_a_timestamp(spark):
    rows = spark.createDataFrame([("C:", 1, None, 0x200), ("C:", 1, 5.0, 0x200), ("C:", 2, 5.0, 0x1)], "drive string, usn long, timestamp double, reason long")
    got = journal_stream.prepared(rows)
    assert dict(got.dtypes)["event_time"] == "timestamp" and got.count() == 2 and journal_stream.once(got).count() == 1
    assert journal_stream.daily(got.withColumn("bytes", F.lit(3)).where("timestamp = 5")).first().day == "1970-01-01"


def test_walk_shares_the_work(spark, tmp_path):
    """One top directory with nearly all directories is listed by many tasks, and each directory once."""
    for i in range(12):
        for j in range(4):
            (tmp_path / "top" / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / "top" / f"d{i}" / f"e{j}" / "f").write_text("x" * i)
    (tmp_path / "file").write_text("abc")
    os.symlink(tmp_path / "top", tmp_path / "link")
    want = sorted(map(tuple, spark.read.format("walk").load(str(tmp_path)).collect()))
    rows = readers.walked(spark, str(tmp_path), budget=3, tasks=4)
    assert sorted(map(tuple, rows.collect())) == want and len(want) == 1 + 12 + 48 + 48 + 2
    assert rows.rdd.getNumPartitions() > 4
    assert readers.walked(spark, str(tmp_path / "none")).where("failed").count() == 1


def test_doctor(spark, tmp_path):
    got = {r.source: (r.works, r.reason) for r in readers.doctor(spark, str(tmp_path)).collect()}
    assert got["walk"] == (True, None) and got["capacity"][0] and not got["usnjournal"][0] and "journal.info" in got["usnjournal"][1] and not got["filetable"][0]


def test_stream_of_rankings_resumes(spark, tmp_path):
    """Days' rankings from a stream that is stopped in the middle are those of the whole table."""
    from accretion.operators import journal

    schema = "drive string, usn long, timestamp double, reason long, is_dir boolean, name string, path string, bytes long"
    day = 86400.0
    rows = [("C:", k, 1_700_006_400 + k * 5400.0, 0x200, False, f"n{k}", None if k % 7 == 0 else f"p{k % 5}", None if k % 6 == 0 else 100 * (k % 11)) for k in range(120)]  # a window closes when a later deletion comes
    ready, groups = str(tmp_path / "in"), None
    os.mkdir(ready)
    for part in (rows[:50], rows[50:90], rows[90:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(ready)
        groups = journal_stream.deleted_groups(journal_stream.prepared(spark.readStream.schema(schema).parquet(ready)), "0 seconds")
        groups.writeStream.outputMode("append").foreachBatch(journal_stream.top_deleted_sink(str(tmp_path / "top"))).option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r[c] for c in ("drive", "day", "rank", "path", "bytes", "is_dir", "at", "count")) for r in spark.read.parquet(str(tmp_path / "top")).collect())
    every = spark.createDataFrame(rows, schema).withColumn("kind", F.lit("delete"))
    last = rows[-1][2]
    want = journal.top_deleted(every, last, 3650).where(F.unix_timestamp(F.to_date("day")) + journal.DAY_WINDOW <= last)
    assert got == sorted(map(tuple, want.collect())) and len({r[1] for r in got}) == (last - 1_700_006_400) // day
