"""What goes wrong only in larger tables, on small ones that have it."""

import hashlib

import duckdb
import pyarrow as pa

from accretion.operators import filetable
from accretion.operators.store import Store
from accretion.plans import catalogue, fixtures as X
from accretion.sources import readers

from .conftest import DATA


def test_sizes_beyond_64_bits(spark, tmp_path):
    keys = [629_356 - 1, 629_356, 899_998, 9_000_000, 9]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_orderkey: r for r in catalogue.QUERIES["size_units"](spark, str(tmp_path)).collect()}
    exact = {k: (1 if k % 2 == 0 else -1) * k**3 * 37 for k in keys if k % 9}
    assert {k: r.n for k, r in got.items()} == {k: n if k in exact and abs(n := exact[k]) < 1 << 63 else None for k in keys}
    assert {k: r.unit for k, r in got.items()} == {k: "TB" if k in exact else None for k in keys}
    assert {k: r.thousandths for k, r in got.items() if k in exact} == {k: int(float(n) / 1024.0**4 * 1000 // 1) for k, n in exact.items()}
    assert got[9].thousandths is None


def test_batches_after_the_first(spark, monkeypatch):
    monkeypatch.setattr(X, "BATCH_EVENTS", 1)  # a segment each
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/sf0.01/events.parquet'")
    want = con.execute(catalogue.ORACLES["journal_stream_binary"]).fetchall()
    got = catalogue.QUERIES["journal_stream_binary"](spark, f"{DATA}/sf0.01").select("drive", "usn", "kind", "reason", "name").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_numbers_of_directories_differ(spark, monkeypatch):
    seen, paths = {}, None
    for k in range(4_000_000):  # two names whose hashes have the same 40 bits
        at = hashlib.md5(f"d{k}".encode()).hexdigest()[:10]
        if at in seen:
            paths = [f"d{seen[at]}", f"d{k}"]
            break
        seen[at] = k
    rows = spark.createDataFrame([(f"{p}\\f{i}", False, 10 + i, 0.0, 0.0, None, i) for i, p in enumerate(paths)], "path string, is_dir boolean, bytes long, created double, modified double, deleted_at double, key long")
    monkeypatch.setattr(X, "entries", lambda spark, sf: rows)
    records = X.records(spark, "")
    found = filetable.resolved_paths(records.where("is_dir").select("record", "parent", "name"))
    got = filetable.as_entries(records, found).select("path", "is_dir", "bytes").collect()
    assert sorted(map(tuple, got)) == sorted([(p, True, 0) for p in paths] + [(f"{p}\\f{i}", False, 10 + i) for i, p in enumerate(paths)])
    assert records.groupBy("record").count().where("count > 1").count() == 0


def test_buffers_are_decoded_one_by_one():
    blob = b"\0" * 8 + b"".join(X.usn_record(k, k, 5, 0, 2, 0, "name") for k in range(10_000))
    made = readers.decoded(iter([pa.RecordBatch.from_pylist([{"content": blob}] * 3 + [{"content": None}])]))
    assert [b.num_rows for b in made] == [readers.CHUNK, 10_000 - readers.CHUNK] * 3


def test_commit_makes_its_entries_once(spark, tmp_path):
    schema, seen = "path string, is_dir boolean, bytes long, created double, modified double", str(tmp_path / "seen")

    def run(batches):
        for b in batches:
            with open(seen, "a") as f:
                f.write("x")
            yield b

    rows = spark.createDataFrame([(f"a\\b{i}\\c", False, 1 << 30, 9e8, 9e8) for i in range(9)], schema).coalesce(1).mapInArrow(run, schema)
    store = Store(spark, str(tmp_path / "store"))
    store.commit(rows, 1, "C:", 1e9, "mft")
    assert open(seen).read() == "x"
    assert store.read("files").count() == 9 and store.read("dirs").count() == 11
