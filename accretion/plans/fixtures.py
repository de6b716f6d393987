"""The driver's tables as the relations that operators work on, in Spark and as SQL text with the same arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accretion.functions import paths as P
from accretion.functions import stamps as S
from accretion.operators import tree
from accretion.scratch import saved

NOW_ENTRIES, NOW_HISTORY, NOW_EVENTS = 996710400.0, 917870400.0, 1706659200.0  # 2001-08-02, 1999-02-01 12:00, 2024-01-31
PRUNE_BYTES, PRUNE_DEPTH, BUCKET_BYTES, FILE_BYTES, RECENT_BYTES = 64_000_000, 3, 20_000_000, 40_000_000, 10_000_000
BOUNDARY = 4
#: Deleted files of each drive whose sizes are looked up: the operator's limit.
ENRICHED = 300
#: Events of a batch of the binary journal's streams.
BATCH_EVENTS = 400_000
RULES = (("1-urgent", "urgentOrders", "review"), ("automobile", "automobileTrade", "safe"), ("c1", "customersOne", "careful"))
#: (id, taken_at, method, complete, note) of drive C:
SNAPSHOTS = (
    (1, 915192000.0, "scandir", True, None), (2, 915364800.0, "mft", True, "first " + "[已降级]"), (3, 915386400.0, "mft", True, None), (4, 915451200.0, "mft", True, None), (5, 917870400.0, "mft", True, None), (6, 917956800.0, "mft", False, "cancelled"),
)
TAKEN = {s[0]: s[1] for s in SNAPSHOTS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each order: region\\nation\\segment\\priority\\customer\\order."""
    t = lambda n: table(spark, sf_dir, n)
    shipped = t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    at = S.seconds("o_orderdate").cast("long")
    path = F.concat_ws(P.SEP, "r_name", "n_name", "c_mktsegment", "o_orderpriority", F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey"))
    return rows.select(
        path.alias("path"), F.lit(False).alias("is_dir"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").alias("bytes"), (at + 3600 * (F.col("o_orderkey") % 24)).cast("double").alias("created"),
        (at + 86400 * (F.col("o_orderkey") % 30)).cast("double").alias("modified"), F.when(F.col("o_orderstatus") == "F", S.seconds("last_ship").cast("long").cast("double")).alias("deleted_at"), F.col("o_orderkey").alias("key"),
    )


ENTRIES = r"""
fx AS (
  SELECT concat_ws(chr(92), r_name, n_name, c_mktsegment, o_orderpriority, 'c'||c_custkey, 'o'||o_orderkey) AS path, false AS is_dir,
         CAST(floor(o_totalprice*100+0.5) AS BIGINT) AS bytes, (CAST(epoch(o_orderdate) AS BIGINT) + 3600*(o_orderkey % 24))::DOUBLE AS created,
         (CAST(epoch(o_orderdate) AS BIGINT) + 86400*(o_orderkey % 30))::DOUBLE AS modified,
         CASE WHEN o_orderstatus='F' THEN CAST(epoch(last_ship) AS BIGINT)::DOUBLE END AS deleted_at, o_orderkey AS key
  FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
       LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey)"""


def depth_sql(p: str) -> str:
    return f"(CASE WHEN {p}='' THEN 0 ELSE len({p})-len(replace({p},chr(92),''))+1 END)"


def up_sql(p: str) -> str:
    """A list of the proper ancestors."""
    return f"(CASE WHEN {p}='' THEN CAST([] AS VARCHAR[]) ELSE list_transform(range(0, len(string_split({p},chr(92)))), lambda i: array_to_string(string_split({p},chr(92))[1:i], chr(92))) END)"


def dirs_sql(source: str, name: str = "dirs", key: str = "", now: str = str(NOW_ENTRIES)) -> str:
    """CTEs that roll `source` up; key: a leading column list such as 'snapshot_id, '."""
    ok = lambda c: f"CASE WHEN {c} >= 0 AND {c} <= least(4102444800, {now}+172800) THEN {c} END"
    return f"""
{name}_x AS (SELECT {key}path, bytes, {ok("modified")} AS m, {ok("created")} AS c, unnest({up_sql("path")}) AS up FROM {source}),
{name}_n AS (SELECT {key}up AS path, sum(bytes)::BIGINT AS bytes,
         coalesce(sum(CASE WHEN {depth_sql("path")} = {depth_sql("up")}+1 THEN bytes END), 0)::BIGINT AS own_bytes, count(*)::BIGINT AS files, max(m) AS newest_mtime, max(c) AS newest_ctime
         FROM {name}_x GROUP BY {key}up),
{name}_u AS (SELECT {key}unnest({up_sql("path")}) AS path FROM {name}_n),
{name}_d AS (SELECT {key}path, count(*)::BIGINT AS dirs FROM {name}_u GROUP BY {key}path),
{name} AS (SELECT {key}path, {depth_sql("path")}::BIGINT AS depth, bytes, own_bytes, files, coalesce(dirs, 0)::BIGINT AS dirs, newest_mtime, newest_ctime
         FROM {name}_n LEFT JOIN {name}_d USING ({key}path))"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = snap_entries(spark, sf_dir).groupBy("snapshot_id").agg(F.sum("bytes").alias("scanned_bytes"), F.count(F.lit(1)).alias("file_count"))
    head = heads(spark)
    return head.join(held, head.id == held.snapshot_id, "left").select("id", "drive", "taken_at", "method", "complete", "note", F.coalesce("scanned_bytes", F.lit(0)).alias("scanned_bytes"), F.coalesce("file_count", F.lit(0)).alias("file_count"))


def heads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, "C:", t, m, c, n) for i, t, m, c, n in SNAPSHOTS], "id long, drive string, taken_at double, method string, complete boolean, note string")


def snap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each snapshot's files: those created by then and not yet deleted."""
    at = F.array(*[F.struct(F.lit(i).cast("long").alias("snapshot_id"), F.lit(t).alias("taken_at")) for i, t in TAKEN.items()])
    rows = entries(spark, sf_dir)
    here = F.filter(at, lambda s: (F.col("created") <= s["taken_at"]) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > s["taken_at"])))
    return rows.select("*", F.explode(here).alias("s")).select("s.snapshot_id", "path", "is_dir", "bytes", "created", "modified")


def snap_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.rollup(snap_entries(spark, sf_dir), NOW_ENTRIES, ["snapshot_id"])


def snap_sizes(spark: SparkSession, sf_dir: str, max_depth: int) -> DataFrame:
    """Of snap_dirs() what comparisons of snapshots need: directories down to max_depth."""
    return tree.sizes(snap_entries(spark, sf_dir), max_depth, ["snapshot_id"])


def snap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap_entries(spark, sf_dir).select("snapshot_id", "path", "bytes", F.col("modified").alias("mtime"), F.col("created").alias("ctime"))


_VALUES = ", ".join(f"({i}, 'C:', {t}::DOUBLE, '{m}', {str(c).lower()}, {'NULL' if n is None else repr(n)})" for i, t, m, c, n in SNAPSHOTS)
HEADS = f"fx_heads(id, drive, taken_at, method, complete, note) AS (VALUES {_VALUES})"
HISTORY = f"""{ENTRIES}, {HEADS},
se AS (SELECT id AS snapshot_id, path, is_dir, bytes, created, modified FROM fx_heads JOIN fx ON created <= taken_at AND (deleted_at IS NULL OR deleted_at > taken_at)),
sn AS (SELECT id, drive, taken_at, method, complete, note, coalesce(b, 0)::BIGINT AS scanned_bytes, coalesce(n, 0)::BIGINT AS file_count
       FROM fx_heads LEFT JOIN (SELECT snapshot_id, sum(bytes) AS b, count(*) AS n FROM se GROUP BY 1) ON snapshot_id = id)"""
HISTORY_DIRS = HISTORY + "," + dirs_sql("se", "sd", "snapshot_id, ")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal events of two drives."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    masks = {"error": 2147484160, "signup": 256, "purchase": 4096, "click": 8192}
    reason = F.lit(2).cast("long")
    for name, mask in masks.items():
        reason = F.when(F.col("event_type") == name, F.lit(mask).cast("long")).otherwise(reason)
    return e.select(
        F.when(F.col("user_id") % 2 == 0, "C:").otherwise("D:").alias("drive"), F.col("event_id").alias("usn"), S.seconds("ts").alias("timestamp"), reason.alias("reason"), F.lit(False).alias("is_dir"), F.concat(F.lit("k"), "k").alias("name"),
        F.when(F.col("k") % 5 != 0, F.concat_ws(P.SEP, F.lit("Users"), F.concat(F.lit("u"), "user_id"), F.concat(F.lit("k"), "k"))).alias("path"), F.when(F.col("k") % 3 != 0, F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("bytes"),
    )


EVENTS = r"""
ev AS (SELECT CASE WHEN user_id%2=0 THEN 'C:' ELSE 'D:' END AS drive, event_id AS usn, epoch(ts) AS timestamp,
       CASE event_type WHEN 'error' THEN 2147484160 WHEN 'signup' THEN 256 WHEN 'purchase' THEN 4096 WHEN 'click' THEN 8192 ELSE 2 END::BIGINT AS reason,
       false AS is_dir, 'k'||k AS name, CASE WHEN k%5=0 THEN NULL ELSE concat_ws(chr(92),'Users','u'||user_id,'k'||k) END AS path,
       CASE WHEN k%3=0 THEN NULL ELSE CAST(floor(value*100+0.5) AS BIGINT) END AS bytes
       FROM (SELECT *, CAST(json_extract_string(props,'$.k') AS INT) AS k FROM events)),
evk AS (SELECT *, CASE reason WHEN 2147484160 THEN 'delete' WHEN 256 THEN 'create' WHEN 4096 THEN 'rename_old' WHEN 8192 THEN 'rename_new' ELSE 'write' END AS kind FROM ev)"""


def day_sql(ts: str) -> str:
    return f"strftime(make_timestamp(({ts}*1000000)::BIGINT), '%Y-%m-%d')"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, record) of the rolled-up directories but the root. Numbers go up by task, so none needs one task and none meet; even ones are left to directories."""
    rows = tree.rollup(entries(spark, sf_dir), NOW_ENTRIES).where("path <> ''").select("path")
    return saved(rows.withColumn("record", F.monotonically_increasing_id() * 2 + 1000), "numbered")


def _below(rows: DataFrame, dirs: DataFrame) -> DataFrame:
    """rows with their parents' records, 5 below the root."""
    up = dirs.select(F.col("path").alias("above"), F.col("record").alias("up"))
    return rows.withColumn("above", P.parent("path")).join(up, "above", "left").withColumn("parent", F.when(F.col("above") == "", F.lit(5)).otherwise(F.col("up")).cast("long"))


def dir_ids(spark: SparkSession, sf_dir: str, dirs: DataFrame | None = None) -> DataFrame:
    """The rolled-up directories as records of an adjacency list, with a cycle of three and a directory whose parent is gone."""
    dirs = _numbered(spark, sf_dir) if dirs is None else dirs
    real = _below(dirs, dirs).select("record", "parent", P.basename("path").alias("name"))
    odd = spark.createDataFrame([(101, 102, "x"), (102, 103, "y"), (103, 101, "z"), (104, 103, "below"), (105, 999, "lost"), (106, 105, "under")], "record long, parent long, name string")
    return real.unionByName(odd)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolled-up directories and their files as decoded records, with a file of the file system's own and one whose directory is gone."""
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    numbers = _numbered(spark, sf_dir)
    dirs = dir_ids(spark, sf_dir, numbers).select("record", "parent", "name", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("bytes"))
    files = _below(entries(spark, sf_dir), numbers).select((F.col("key") * 2 + 1001).alias("record"), "parent", P.basename("path").alias("name"), "is_dir", "bytes")
    odd = spark.createDataFrame([(6, 5, "$Bitmap", False, 4096), (900, 999, "lost.bin", False, 77)], "record long, parent long, name string, is_dir boolean, bytes long")
    return dirs.unionByName(files).unionByName(odd).select("*", *none("double", "created", "modified"), *none("long", "attributes"))


def collected(spark: SparkSession, sf_dir: str):
    """A store that has taken in the events of both drives in two readings."""
    from accretion.operators.store import Store
    from accretion.scratch import scratch

    store, now = Store(spark, scratch(spark, "store")), NOW_EVENTS
    journals = spark.createDataFrame([(d, 7, 0, True, None) for d in ("C:", "D:")], "drive string, journal_id long, lowest_valid_usn long, available boolean, reason string")
    readings = events(spark, sf_dir)
    half = readings.agg(F.percentile_approx("usn", 0.5)).first()[0]
    store.collect(readings.where(F.col("usn") <= half), journals, now, keep_days=15)
    store.collect(readings, journals, now, keep_days=15)
    return store


def filled_store(spark: SparkSession, sf_dir: str):
    """A store with snapshots 4 and 5, after what follows a scan."""
    from accretion.operators.store import Store
    from accretion.scratch import scratch

    store, rows = Store(spark, scratch(spark, "store")), saved(snap_entries(spark, sf_dir).where("snapshot_id IN (4, 5)"), "entries")
    limits = {"prune": {"min_bytes": PRUNE_BYTES, "max_depth": PRUNE_DEPTH}, "select_files": {"min_bytes": FILE_BYTES, "recent_bytes": RECENT_BYTES}, "age_buckets": {"min_bytes": BUCKET_BYTES}}
    for i in (4, 5):
        store.commit(rows.where(F.col("snapshot_id") == i).drop("snapshot_id"), i, "C:", TAKEN[i], "mft", limits=limits)
    failed = store.maintain("C:", 5, TAKEN[5])
    if failed:
        raise RuntimeError(str(failed))
    return store


def engine(spark: SparkSession, sf_dir: str):
    """The front end over the history and the events."""
    from accretion.functions import reasons
    from accretion.plans.api import Engine

    events_ = events(spark, sf_dir).withColumn("kind", reasons.kind("reason"))
    status = spark.createDataFrame([("C:", True, None)], "drive string, available boolean, reason string")
    held = snap_entries(spark, sf_dir).limit(0).select("snapshot_id", F.lit("").alias("day"), F.lit("").alias("attribution"), "bytes", F.lit(0).cast("long").alias("files"))
    return Engine(snapshots(spark, sf_dir), snap_dirs(spark, sf_dir), snap_files(spark, sf_dir), held, events_, status, NOW_EVENTS, boundary=BOUNDARY)


# -- bytes and streams --------------------------------------------------------------------------------------------------


def usn_record(usn: int, file_ref: int, parent_ref: int, ticks: int, reason: int, attributes: int, name: str, major: int = 2) -> bytes:
    """One journal record, padded to eight bytes."""
    import struct

    text = name.encode("utf-16-le")
    head = 60 if major == 2 else 76
    size = (head + len(text) + 7) // 8 * 8
    refs = struct.pack("<QQ", file_ref, parent_ref) if major == 2 else struct.pack("<QQQQ", file_ref, 0, parent_ref, 0)
    body = struct.pack("<IHH", size, major, 0) + refs + struct.pack("<qqIIIIHH", usn, ticks, reason, 0, 0, attributes, len(text), head) + text
    return body.ljust(size, b"\0")


def usn_folder(spark: SparkSession, events_: DataFrame, journal_id: int = 7) -> str:
    """A folder with the journal of events (usn, ticks, reason, name, parent_full) in segments of a few thousand, written by tasks."""
    import struct
    from pathlib import Path

    from accretion.scratch import scratch
    from accretion.sources.usn import INFO, SUFFIX, local

    folder = local(scratch(spark, "usn"))
    Path(folder).mkdir(parents=True)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            for i in range(0, len(rows), 2000):
                some = rows[i : i + 2000]
                body = b"".join(usn_record(r["usn"], r["usn"] + (3 << 48), r["parent_full"], r["ticks"], r["reason"], 0, r["name"], 2 + r["usn"] % 2) for r in some)
                # a file is there whole or not at all, and a task that runs again writes it again
                draft = Path(folder, f".{some[0]['usn']:020d}.{id(b)}")
                draft.write_bytes((some[-1]["usn"] + 1).to_bytes(8, "little") + body)
                draft.replace(Path(folder, f"{some[0]['usn']:020d}{SUFFIX}"))
            yield pa.RecordBatch.from_arrays([pa.array([r["usn"] for r in rows], pa.int64())], names=["usn"])

    # sorted as a whole: segments don't overlap
    last = events_.repartitionByRange("usn").sortWithinPartitions("usn").mapInArrow(run, "usn long").agg(F.min("usn"), F.max("usn")).first()
    Path(folder, INFO).write_bytes(struct.pack("<QqqqqQQ", journal_id, 0, last[1] + 1, last[0], 1 << 62, 1 << 25, 1 << 23))
    return folder


def ticks() -> Column:
    """The timestamp of an event as the journal has it."""
    return ((F.floor("timestamp") + 11_644_473_600) * 10_000_000).cast("long")


def file_record_bytes(number: int, sequence: int, parent: int, name: str, flags: int = 3, more: bytes = b"") -> bytes:
    """A record of 1,024 bytes with a name and what else is given, its sectors' ends moved to their table."""
    import struct

    from accretion.sources import ntfs

    text = name.encode("utf-16-le")
    value = struct.pack("<QQQQQQQIIBB", parent, 0, 0, 0, 0, 0, 0, 0x10, 0, len(name), 3) + text
    size = (24 + len(value) + 7) // 8 * 8
    body = struct.pack("<IIBBHHHIH", ntfs.NAME, size, 0, 0, 24, 0, 0, len(value), 24).ljust(24, b"\0") + value.ljust(size - 24, b"\0") + more + struct.pack("<I", ntfs.END)
    head = ntfs.RECORD_HEAD.pack(b"FILE", 48, 3, 0, sequence, 1, 56, flags, 56 + len(body), 1024, 0, 0, 0, number)
    raw = bytearray((head + b"\0" * 8 + body).ljust(1024, b"\0"))
    raw[48:50] = b"\x01\0"
    for end in (512, 1024):
        at = 48 + end // 256
        raw[at : at + 2], raw[end - 2 : end] = raw[end - 2 : end], raw[48:50]
    return bytes(raw)


#: Records of regions, nations and customers in image(), and the sequence number that they have.
REGION_AT, NATION_AT, CUSTOMER_AT, SEQUENCE = 16, 32, 64, 3


def image(spark: SparkSession, sf_dir: str) -> str:
    """A volume whose file table has the regions, in them the nations, and in them the customers as directories; its records are written by tasks."""
    import os
    import struct
    from pathlib import Path

    from accretion.scratch import scratch
    from accretion.sources.usn import local

    folder = local(scratch(spark, "image"))
    Path(folder).mkdir(parents=True)
    path, table_at = f"{folder}/disk.img", 4 * 4096
    reference = lambda at, c: (F.col(c) + at + (SEQUENCE << 48)).cast("long")
    root = F.lit(5 + (5 << 48)).cast("long")
    rows = table(spark, sf_dir, "region").select((F.col("r_regionkey") + REGION_AT).cast("long").alias("record"), root.alias("parent"), F.col("r_name").alias("name"))
    rows = rows.unionByName(table(spark, sf_dir, "nation").select((F.col("n_nationkey") + NATION_AT).cast("long").alias("record"), reference(REGION_AT, "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
    rows = rows.unionByName(table(spark, sf_dir, "customer").select((F.col("c_custkey") + CUSTOMER_AT).cast("long").alias("record"), reference(NATION_AT, "c_nationkey").alias("parent"), F.concat(F.lit("u"), "c_custkey").alias("name")))
    clusters = (rows.agg(F.max("record")).first()[0] * 1024) // 4096 + 1
    boot = bytearray(512)
    boot[3:11] = b"NTFS    "
    struct.pack_into("<HB", boot, 11, 512, 8)
    struct.pack_into("<QQQ", boot, 40, 1 << 20, 4, 2)
    boot[64] = 256 - 10
    runs = run_list_bytes([clusters], [4])
    data = struct.pack("<IIBBHHHQQHHIQQQ", 0x80, (64 + len(runs) + 7) // 8 * 8, 1, 0, 64, 0, 0, 0, clusters - 1, 64, 0, 0, clusters * 4096, clusters * 4096, clusters * 4096)
    first = file_record_bytes(0, 1, 5 + (5 << 48), "$MFT", 1, (data + runs).ljust((64 + len(runs) + 7) // 8 * 8, b"\0"))
    with open(path, "wb") as f:
        f.write(boot.ljust(table_at, b"\0") + first)
        f.truncate(table_at + clusters * 4096)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            with open(path, "r+b") as f:
                for r in b.to_pylist():
                    os.pwrite(f.fileno(), file_record_bytes(r["record"], SEQUENCE, r["parent"], r["name"]), table_at + r["record"] * 1024)
            yield pa.RecordBatch.from_arrays([b.column("record")], names=["record"])

    rows.mapInArrow(run, "record long").agg(F.count(F.lit(1))).first()
    return path


def usn_buffers(events_: DataFrame) -> DataFrame:
    """(content binary): the events of each batch as one journal buffer."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            body = b"".join(usn_record(r["usn"], r["usn"] + (3 << 48), r["usn"] % 1000 + (5 << 48), r["ticks"], r["reason"], 0, r["name"], 2 + r["usn"] % 2) for r in rows)
            last = max((r["usn"] for r in rows), default=0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([last.to_bytes(8, "little") + body], pa.binary())], names=["content"])

    ticks = ((F.floor("timestamp") + 11_644_473_600) * 10_000_000).cast("long")
    return events_.select("usn", ticks.alias("ticks"), "reason", "name").mapInArrow(run, "content binary")


def run_list_bytes(lengths: list[int], steps: list[int | None]) -> bytes:
    out = b""
    for n, step in zip(lengths, steps, strict=True):
        wide = max(1, (n.bit_length() + 7) // 8)
        far = 0 if step is None else max(1, (step.bit_length() + 8) // 8)
        out += bytes([wide | far << 4]) + n.to_bytes(wide, "little") + (b"" if step is None else step.to_bytes(far, "little", signed=True))
    return out + b"\0"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream in which every other event comes twice."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    e = raw.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    reason = F.when(F.col("event_type") == "error", F.lit(2147484160)).when(F.col("event_type") == "signup", F.lit(256)).when(F.col("event_type") == "purchase", F.lit(4096)).when(F.col("event_type") == "click", F.lit(8192)).otherwise(F.lit(2)).cast("long")
    rows = e.select(
        F.when(F.col("user_id") % 2 == 0, "C:").otherwise("D:").alias("drive"), F.col("event_id").alias("usn"), S.seconds("ts").alias("timestamp"), reason.alias("reason"), F.when(F.col("k") % 3 != 0, F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("bytes"),
        F.explode(F.when(F.col("event_id") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")
