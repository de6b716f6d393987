"""The named queries of the library and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from accretion.functions import display, paths as P, reasons, rules, stamps as S
from accretion.scratch import saved
from accretion.operators import buckets, filetable, hotspots, journal, snapshots as N, timeline as T, tree, treemap

from . import fixtures as X
from .fixtures import day_sql, depth_sql, dirs_sql, up_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
E_DIRS = X.ENTRIES + "," + dirs_sql("fx")


def query(sql: str | None = None):
    """Registers a query by its function's name, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _parent_sql(p: str) -> str:
    return f"CASE WHEN {p}='' THEN NULL WHEN NOT contains({p}, chr(92)) THEN '' ELSE array_to_string(string_split({p},chr(92))[1:-2], chr(92)) END"


# -- paths and single values --------------------------------------------------------------------------------------------


@query(f"""WITH {E_DIRS}, p AS (SELECT path FROM fx UNION ALL SELECT path FROM dirs)
SELECT path, {depth_sql("path")}::BIGINT AS depth, {_parent_sql("path")} AS parent, CASE WHEN path='' THEN 'C:' ELSE string_split(path,chr(92))[-1] END AS base,
 array_to_string(string_split(path,chr(92))[1:3], chr(92)) AS attribution, path <> 'ASIA' AND starts_with(path, 'ASIA'||chr(92)) AS under_asia FROM p""")
def path_algebra(spark, sf):
    e = X.entries(spark, sf)
    rows = e.select("path").unionByName(tree.rollup(e, X.NOW_ENTRIES).select("path"))
    return rows.select("path", P.depth("path").cast("long").alias("depth"), P.parent("path").alias("parent"), P.basename("path", "C:").alias("base"), P.attribution("path").alias("attribution"), P.is_ancestor(F.lit("ASIA"), "path").alias("under_asia"))


@query(f"""WITH {E_DIRS}, c AS (SELECT path, unnest(list_append({up_sql("path")}, path)) AS crumb FROM dirs)
SELECT path, {depth_sql("crumb")}::BIGINT AS level, crumb, crumb = path AS current FROM c""")
def breadcrumbs(spark, sf):
    rows = tree.rollup(X.entries(spark, sf), X.NOW_ENTRIES)
    return rows.select("path", F.explode(P.crumbs("path")).alias("c")).select("path", F.col("c.level").cast("long").alias("level"), "c.crumb", "c.current")


_SHOWN = "'Users' || chr(92) || replace(lower(p_name), ' ', chr(92)) || CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN chr(92)||'AppData'||chr(92)||'Local'||chr(92)||'Temp' WHEN 2 THEN chr(92)||'node_modules' WHEN 3 THEN chr(92)||'.cache' WHEN 4 THEN chr(92)||'pagefile.sys' ELSE chr(92)||'Target'||chr(92)||'debug' END"
_CASES = lambda field: "CASE " + " ".join(f"WHEN contains(lower(p), '{r[0]}') THEN '{r[field]}'" for r in rules.RULES) + " END"


@query(f"WITH q AS (SELECT p_partkey, {_SHOWN} AS p FROM part) SELECT p_partkey, p AS path, {_CASES(1)} AS rule, {_CASES(2)} AS safety FROM q")
def classify_paths(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, ("", r"\AppData\Local\Temp", r"\node_modules", r"\.cache", r"\pagefile.sys", r"\Target\debug"))), (F.col("p_size") % 6 + 1).cast("int"))
    rows = X.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("Users" + P.SEP), F.replace(F.lower("p_name"), F.lit(" "), F.lit(P.SEP)), tail).alias("path"))
    return rows.withColumn("hint", rules.classify("path")).select("p_partkey", "path", "hint.rule", "hint.safety")


@query(f"""WITH {E_DIRS}, a AS (SELECT path, newest_ctime AS t, ({X.NOW_ENTRIES} - newest_ctime)/86400 AS d FROM dirs)
SELECT path, CASE WHEN t IS NULL OR t=0 THEN 'older' WHEN d<=1 THEN 'd1' WHEN d<=7 THEN 'd7' WHEN d<=30 THEN 'd30' WHEN d<=90 THEN 'd90' WHEN d<=365 THEN 'd365' ELSE 'older' END AS band FROM a""")
def age_band_dirs(spark, sf):
    return tree.rollup(X.entries(spark, sf), X.NOW_ENTRIES).select("path", S.age_band("newest_ctime", X.NOW_ENTRIES).alias("band"))


@query(f"""WITH {X.ENTRIES}, s AS (SELECT key, CASE WHEN key%97=0 THEN NULL WHEN key%89=0 THEN NULL WHEN key%83=0 THEN 1915769744::DOUBLE ELSE created END AS t FROM fx)
SELECT key, t AS stamp, {day_sql("t")} AS day, CASE WHEN t <= least(4102444800, {X.NOW_ENTRIES}+172800) THEN t END AS newest FROM s""")
def safe_timestamps(spark, sf):
    key = F.col("key")
    raw = F.when(key % 97 == 0, F.lit(float("nan"))).when(key % 89 == 0, F.lit(-1.0)).when(key % 83 == 0, F.lit(1915769744.0)).otherwise(F.col("created"))
    rows = X.entries(spark, sf).select("key", raw.alias("raw"))
    return rows.select("key", S.safe("raw").alias("stamp"), S.day("raw").alias("day"), S.safe_until("raw", S.ceiling(X.NOW_ENTRIES)).alias("newest"))


@query("""WITH f AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '\\\\?\\C:\\' || o_orderstatus || chr(92) || o_orderkey WHEN 1 THEN '\\\\?\\c:\\' WHEN 2 THEN '\\\\?\\D:\\x' WHEN 3 THEN 'C:\\x' ELSE '\\\\?\\C:x' END AS raw FROM orders)
SELECT o_orderkey, raw, CASE o_orderkey % 5 WHEN 0 THEN substr(raw, 8) WHEN 1 THEN '' END AS path FROM f""")
def clean_final_path(spark, sf):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.concat(F.lit("\\\\?\\C:\\"), "o_orderstatus", F.lit(P.SEP), "o_orderkey")).when(k == 1, F.lit("\\\\?\\c:\\")).when(k == 2, F.lit("\\\\?\\D:\\x")).when(k == 3, F.lit("C:\\x")).otherwise(F.lit("\\\\?\\C:x"))
    return X.table(spark, sf, "orders").select("o_orderkey", raw.alias("raw")).withColumn("path", P.from_final_path("raw", F.lit("C:")))


@query(f"""WITH {X.ENTRIES}, f AS (SELECT key, CASE WHEN key%7=0 THEN 0 WHEN key%11=0 THEN 1000 ELSE (created::BIGINT + 11644473600)*10000000 + key END AS ticks FROM fx)
SELECT key, ticks, CASE WHEN ticks = 0 OR ticks::DOUBLE/10000000 - 11644473600 < 631152000 THEN NULL ELSE ticks::DOUBLE/10000000 - 11644473600 END AS stamp FROM f""")
def filetime_convert(spark, sf):
    key = F.col("key")
    ticks = F.when(key % 7 == 0, F.lit(0)).when(key % 11 == 0, F.lit(1000)).otherwise((F.col("created").cast("long") + 11644473600) * 10000000 + key).cast("long")
    return X.entries(spark, sf).select("key", ticks.alias("ticks")).withColumn("stamp", S.from_filetime("ticks"))


@query(f"""WITH {X.ENTRIES}, d AS (SELECT key, CASE WHEN key%13=0 THEN 'x'||key WHEN key%17=0 THEN '2001-02-30' ELSE {day_sql("created")} END AS text FROM fx)
SELECT key, text, epoch(try_strptime(CASE WHEN regexp_full_match(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN text END, '%Y-%m-%d'))::DOUBLE AS midnight,
 epoch(try_strptime(CASE WHEN regexp_full_match(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN text END, '%Y-%m-%d'))::DOUBLE + 43200 AS noon FROM d""")
def day_roundtrip(spark, sf):
    key = F.col("key")
    text = F.when(key % 13 == 0, F.concat(F.lit("x"), key)).when(key % 17 == 0, F.lit("2001-02-30")).otherwise(S.day("created"))
    rows = X.entries(spark, sf).select("key", text.alias("text"))
    return rows.select("key", "text", S.day_start("text").alias("midnight"), S.day_start("text", 12).alias("noon"))


@query(f"""WITH {X.HISTORY_DIRS}, w AS (SELECT id, lead(id) OVER (ORDER BY taken_at, id) AS nxt, lead(taken_at) OVER (ORDER BY taken_at, id) AS at FROM sn WHERE complete),
d AS (SELECT {day_sql("w.at")} AS day, path, sum(s.bytes * sg)::BIGINT AS delta FROM w, (VALUES (1), (-1)) g(sg), sd s WHERE nxt IS NOT NULL AND s.snapshot_id = CASE sg WHEN 1 THEN nxt ELSE id END AND depth BETWEEN 1 AND 3 GROUP BY 1, 2),
k AS (SELECT max(abs(delta)) AS peak FROM d)
SELECT day, path, floor(sign(delta) * log10(1 + abs(delta)/1048576.0) / log10(1 + peak/1048576.0) * 1000000 + 0.5)::BIGINT AS height_ppm FROM d, k WHERE delta <> 0""")
def symlog_scale(spark, sf):
    d = T.deltas(X.snapshots(spark, sf), X.snap_sizes(spark, sf, T.COMPARE_DEPTH))
    peak = d.agg(F.max(F.abs("delta")).alias("peak"))
    rows = d.join(F.broadcast(peak), F.col("peak").isNotNull())
    return rows.select("day", "path", F.floor(display.symlog("delta", F.col("peak")) * 1000000 + 0.5).cast("long").alias("height_ppm"))


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey%9=0 THEN NULL ELSE (CASE WHEN o_orderkey%2=0 THEN 1 ELSE -1 END) * (o_orderkey*o_orderkey*o_orderkey*37) END AS n FROM orders),
u AS (SELECT *, abs(n)::DOUBLE AS a FROM v),
w AS (SELECT *, CASE WHEN a < 1024 THEN 0 WHEN a < 1048576 THEN 1 WHEN a < 1073741824 THEN 2 WHEN a < 1099511627776 THEN 3 ELSE 4 END AS i FROM u)
SELECT o_orderkey, n, CASE WHEN n IS NULL THEN NULL ELSE ['B','KB','MB','GB','TB'][i+1] END AS unit, floor(n / power(1024.0, i) * 1000)::BIGINT AS thousandths FROM w""")
def size_units(spark, sf):
    """From key 629,356 on, sizes don't fit 64 bits: the SQL fails, here only n, which is of that type, is null."""
    k = F.col("o_orderkey")
    wide = k.cast("decimal(20,0)")
    rows = X.table(spark, sf, "orders").select("o_orderkey", F.when(k % 9 != 0, F.when(k % 2 == 0, F.lit(1)).otherwise(F.lit(-1)) * wide * wide * wide * 37).alias("n"))
    i = F.when(F.abs("n") < 1024, 0).when(F.abs("n") < 1 << 20, 1).when(F.abs("n") < 1 << 30, 2).when(F.abs("n") < 1 << 40, 3).otherwise(4)
    unit = F.when(F.col("n").isNotNull(), F.substring_index(display.size_text("n"), " ", -1))
    return rows.select("o_orderkey", F.col("n").try_cast("long").alias("n"), unit.alias("unit"), F.floor(F.col("n").cast("double") / F.pow(F.lit(1024.0), i) * 1000).cast("long").alias("thousandths"))


# -- the tree -----------------------------------------------------------------------------------------------------------


@query(f"WITH {X.ENTRIES} SELECT coalesce(sum(bytes),0)::BIGINT AS total_bytes, count(*)::BIGINT AS file_count, 0::BIGINT AS dir_count FROM fx")
def scan_totals(spark, sf):
    return tree.totals(X.entries(spark, sf))


@query(f"WITH {E_DIRS} SELECT path, depth, bytes, own_bytes, files, dirs, newest_mtime, newest_ctime FROM dirs")
def tree_rollup(spark, sf):
    return tree.rollup(X.entries(spark, sf), X.NOW_ENTRIES)


@query(f"WITH {E_DIRS} SELECT path, dirs, files FROM dirs")
def tree_dir_counts(spark, sf):
    return tree.rollup(X.entries(spark, sf), X.NOW_ENTRIES).select("path", "dirs", "files")


@query(f"WITH {E_DIRS.replace('FROM fx)', 'FROM (SELECT * REPLACE (CASE WHEN key%97=0 THEN NULL WHEN key%83=0 THEN 1915769744 ELSE modified END AS modified) FROM fx))')} SELECT path, newest_mtime FROM dirs")
def tree_newest(spark, sf):
    bad = F.when(F.col("key") % 97 == 0, F.lit(float("nan"))).when(F.col("key") % 83 == 0, F.lit(1915769744.0)).otherwise(F.col("modified"))
    return tree.rollup(X.entries(spark, sf).withColumn("modified", bad), X.NOW_ENTRIES).select("path", "newest_mtime")


_PRUNED = f"""{E_DIRS}, kept AS (SELECT * FROM dirs WHERE path='' OR bytes >= {X.PRUNE_BYTES} OR depth <= {X.PRUNE_DEPTH}),
lost AS (SELECT path, own_bytes, unnest({up_sql("path")}) AS up FROM dirs ANTI JOIN kept USING (path)),
home AS (SELECT lost.path, any_value(lost.own_bytes) AS own_bytes, arg_max(up, len(up)) AS up FROM lost JOIN kept ON kept.path = up GROUP BY lost.path),
pruned AS (SELECT kept.*, coalesce(n,0)::BIGINT AS folded_children, coalesce(b,0)::BIGINT AS folded_bytes FROM kept LEFT JOIN (SELECT up, count(*) AS n, sum(own_bytes) AS b FROM home GROUP BY up) ON up = path)"""


@query(f"WITH {_PRUNED} SELECT path, depth, bytes, own_bytes, files, dirs, newest_mtime, newest_ctime, folded_children, folded_bytes FROM pruned")
def tree_prune_fold(spark, sf):
    return tree.prune(tree.rollup(X.entries(spark, sf), X.NOW_ENTRIES), X.PRUNE_BYTES, X.PRUNE_DEPTH)


@query(f"WITH {E_DIRS} SELECT path, bytes, files FROM dirs WHERE depth = 2 AND starts_with(path, 'ASIA'||chr(92)) ORDER BY bytes DESC, path LIMIT 200")
def tree_children(spark, sf):
    return tree.children(tree.rollup(X.entries(spark, sf), X.NOW_ENTRIES), "ASIA", 200).select("path", "bytes", "files")


@query(f"""WITH {_PRUNED}, n AS (SELECT * FROM pruned WHERE path = 'ASIA')
SELECT 'child' AS kind, path, bytes FROM pruned WHERE depth=2 AND starts_with(path,'ASIA'||chr(92)) AND bytes>0 UNION ALL SELECT 'files', path, own_bytes FROM n WHERE own_bytes>0 UNION ALL SELECT 'folded', path, folded_bytes FROM n WHERE folded_bytes>0""")
def tree_level_items(spark, sf):
    return tree.level_items(tree.prune(tree.rollup(X.entries(spark, sf), X.NOW_ENTRIES), X.PRUNE_BYTES, X.PRUNE_DEPTH), "ASIA")


@query()
def treemap_layout(spark, sf):
    dirs = tree.rollup(X.entries(spark, sf), X.NOW_ENTRIES).where("depth BETWEEN 1 AND 4").select(P.parent("path").alias("level"), "path", "bytes")
    return treemap.layout(dirs, "level", 1200.0, 800.0)


_BUCKETS = f"""{X.ENTRIES}, fine AS (SELECT {day_sql("created")} AS day, array_to_string(string_split(path,chr(92))[1:3], chr(92)) AS a, sum(bytes) AS b, count(*) AS n FROM fx WHERE bytes > 0 GROUP BY 1, 2),
bk AS (SELECT day, CASE WHEN b >= {X.BUCKET_BYTES} THEN a ELSE '' END AS attribution, sum(b)::BIGINT AS bytes, sum(n)::BIGINT AS files FROM fine GROUP BY 1, 2)"""


@query(f"WITH {_BUCKETS} SELECT day, attribution, bytes, files FROM bk")
def age_buckets(spark, sf):
    return buckets.age_buckets(X.entries(spark, sf), X.BUCKET_BYTES)


@query(f"WITH {_BUCKETS} SELECT 1::BIGINT AS snapshot_id, day, attribution, (2*bytes)::BIGINT AS bytes, (2*files)::BIGINT AS files FROM bk WHERE day < '1998-01-01' UNION ALL SELECT 1, day, attribution, bytes, files FROM bk WHERE day >= '1998-01-01'")
def bucket_upsert_accumulate(spark, sf):
    rows = buckets.age_buckets(X.entries(spark, sf), X.BUCKET_BYTES).withColumn("snapshot_id", F.lit(1).cast("long"))
    return buckets.accumulated(rows, rows.where("day < '1998-01-01'"))


@query(f"""WITH {X.ENTRIES} SELECT path, bytes, modified AS mtime, created AS ctime FROM fx WHERE bytes > 0 AND (bytes >= {X.FILE_BYTES} OR (created >= {X.NOW_ENTRIES} - 45*86400 AND bytes >= {X.RECENT_BYTES})) ORDER BY bytes DESC, path LIMIT 60000""")
def select_files(spark, sf):
    return tree.select_files(X.entries(spark, sf), X.NOW_ENTRIES, X.FILE_BYTES, 45, X.RECENT_BYTES)


@query(f"""WITH {_BUCKETS}, a AS (SELECT bytes, files, ({X.NOW_ENTRIES} - epoch(strptime(day,'%Y-%m-%d')) - 43200)/86400 AS d FROM bk),
b AS (SELECT CASE WHEN d<=1 THEN 0 WHEN d<=7 THEN 1 WHEN d<=30 THEN 2 WHEN d<=90 THEN 3 WHEN d<=365 THEN 4 ELSE 5 END AS o, sum(bytes) AS bytes, sum(files) AS files FROM a GROUP BY 1)
SELECT i::BIGINT AS ordinal, n AS band, coalesce(bytes,0)::BIGINT AS bytes, coalesce(files,0)::BIGINT AS files FROM (VALUES (0,'d1'),(1,'d7'),(2,'d30'),(3,'d90'),(4,'d365'),(5,'older')) v(i,n) LEFT JOIN b ON o=i""")
def age_profile(spark, sf):
    return buckets.age_profile(buckets.age_buckets(X.entries(spark, sf), X.BUCKET_BYTES), X.NOW_ENTRIES).withColumn("ordinal", F.col("ordinal").cast("long"))


# -- snapshots ----------------------------------------------------------------------------------------------------------


@query(f"WITH {X.HISTORY} SELECT id, drive, taken_at, method, note, scanned_bytes, file_count, contains(coalesce(note,''), '{N.DEMOTED}') AS demoted FROM sn WHERE complete ORDER BY taken_at DESC, id DESC LIMIT 400")
def snapshot_list(spark, sf):
    return N.listed(X.snapshots(spark, sf)).drop("complete")


@query(f"WITH {X.HISTORY} SELECT id, drive, taken_at, scanned_bytes FROM sn WHERE complete QUALIFY row_number() OVER (PARTITION BY drive ORDER BY taken_at DESC, id DESC) = 1")
def latest_snapshots(spark, sf):
    return N.latest(X.snapshots(spark, sf)).select("id", "drive", "taken_at", "scanned_bytes")


_PAIRS = """pr AS (SELECT drive, lag(id) OVER w AS before_id, id AS after_id, lag(taken_at) OVER w AS before_at, taken_at AS after_at, scanned_bytes - lag(scanned_bytes) OVER w AS net
  FROM sn WHERE complete WINDOW w AS (PARTITION BY drive ORDER BY taken_at, id) QUALIFY lag(id) OVER w IS NOT NULL)"""


@query(f"WITH {X.HISTORY}, {_PAIRS} SELECT drive, before_id, after_id, before_at, after_at, net FROM pr")
def snapshot_pairs(spark, sf):
    return N.pairs(X.snapshots(spark, sf))


@query(f"""WITH {X.HISTORY}, {X.EVENTS}, d AS (SELECT drive, min(o) AS o FROM (SELECT drive, 0 AS o FROM sn UNION ALL VALUES ('D:', 1), ('C:', 2), ('E:', 3)) GROUP BY drive),
c AS (SELECT drive, count(*) AS n, arg_max(id, taken_at) AS latest_id, max(taken_at) AS latest_at FROM sn WHERE complete GROUP BY drive), e AS (SELECT drive, count(*) AS events FROM ev GROUP BY drive)
SELECT row_number() OVER (ORDER BY o, drive)::BIGINT AS ordinal, drive, coalesce(n,0)::BIGINT AS snapshots, latest_id, latest_at, coalesce(events,0)::BIGINT AS events FROM d LEFT JOIN c USING (drive) LEFT JOIN e USING (drive)""")
def drive_status(spark, sf):
    return N.drive_status(X.snapshots(spark, sf), X.events(spark, sf), ["D:", "C:", "E:"]).withColumn("ordinal", F.col("ordinal").cast("long"))


_MANY = "m AS (SELECT o_orderkey AS id, 'C:' AS drive, epoch(o_orderdate)::DOUBLE + 3600*(o_orderkey%24) AS taken_at FROM orders)"


@query(f"""WITH {_MANY}, s AS (SELECT id, drive, taken_at, CASE WHEN taken_at >= {X.NOW_ENTRIES} - 120*86400 THEN {day_sql("taken_at")} ELSE left({day_sql("taken_at")}, 7) END AS slot FROM m)
SELECT drive, id, row_number() OVER (PARTITION BY drive, slot ORDER BY taken_at DESC, id DESC) = 1 AS keep FROM s""")
def retention_plan(spark, sf):
    rows = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("C:").alias("drive"), (S.seconds("o_orderdate") + 3600 * (F.col("o_orderkey") % 24)).alias("taken_at"))
    return N.retention(rows, X.NOW_ENTRIES)


@query(f"WITH {X.HISTORY_DIRS} SELECT snapshot_id, path, depth, bytes FROM sd WHERE NOT (snapshot_id IN (1, 2, 3) AND depth > 3 AND bytes < {X.PRUNE_BYTES})")
def demote_dirs(spark, sf):
    return N.demote_dirs(X.snap_dirs(spark, sf), [1, 2, 3], 3, X.PRUNE_BYTES).select("snapshot_id", "path", "depth", "bytes")


@query(f"WITH {X.HISTORY} SELECT id, CASE WHEN id IN (1, 2) AND NOT contains(coalesce(note,''), '{N.DEMOTED}') THEN coalesce(note || ' ', '') || '{N.DEMOTED}' ELSE note END AS note FROM sn")
def demote_marks(spark, sf):
    return N.marked_demoted(X.snapshots(spark, sf), [1, 2]).select("id", "note")


@query(f"""WITH {X.HISTORY} SELECT snapshot_id, path, CASE WHEN modified <= taken_at + 172800 AND modified >= 0 THEN modified END AS mtime, CASE WHEN created <= taken_at + 172800 AND created >= 0 THEN created END AS ctime FROM se JOIN fx_heads ON id = snapshot_id""")
def repair_timestamps(spark, sf):
    return N.repaired(X.snap_files(spark, sf).drop("bytes"), X.heads(spark), ["mtime", "ctime"])


def _diff_sql(source: str, b: int, a: int, least: int) -> str:
    return f"""df AS (SELECT path, coalesce(b.bytes,0)::BIGINT AS before, coalesce(a.bytes,0)::BIGINT AS after, (coalesce(a.bytes,0)-coalesce(b.bytes,0))::BIGINT AS delta,
 CASE WHEN b.path IS NULL THEN 'appeared' WHEN a.path IS NULL THEN 'vanished' WHEN a.bytes > b.bytes THEN 'grew' ELSE 'shrank' END AS kind
 FROM (SELECT path, bytes FROM {source} AND snapshot_id={b}) b FULL JOIN (SELECT path, bytes FROM {source} AND snapshot_id={a}) a USING (path) WHERE abs(coalesce(a.bytes,0)-coalesce(b.bytes,0)) >= {least})"""


@query(f"WITH {X.HISTORY_DIRS}, {_diff_sql('sd WHERE depth BETWEEN 1 AND 4', 4, 5, N.DIFF_BYTES)} SELECT path, before, after, delta, kind FROM df")
def diff_dirs(spark, sf):
    return N.diff_dirs(X.snap_sizes(spark, sf, N.DIFF_DEPTH), 4, 5)


@query(f"WITH {X.HISTORY}, {_diff_sql('se WHERE true', 4, 5, N.DIFF_BYTES)} SELECT path, before, after, delta, kind FROM df")
def diff_files(spark, sf):
    return N.diff_files(X.snap_files(spark, sf), 4, 5)


@query(f"""WITH {X.HISTORY_DIRS}, {_diff_sql('sd WHERE depth BETWEEN 1 AND 4', 1, 5, N.DIFF_BYTES)}
SELECT CASE WHEN delta>0 THEN 'grown' ELSE 'shrunk' END AS direction, row_number() OVER (PARTITION BY delta>0 ORDER BY abs(delta) DESC, path)::BIGINT AS rank, path, before, after, delta, kind FROM df WHERE delta<>0
QUALIFY row_number() OVER (PARTITION BY delta>0 ORDER BY abs(delta) DESC, path) <= 40""")
def diff_top(spark, sf):
    return N.top_differences(N.diff_dirs(X.snap_sizes(spark, sf, N.DIFF_DEPTH), 1, 5)).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {X.HISTORY}, r AS (SELECT drive, id, row_number() OVER (PARTITION BY drive ORDER BY taken_at DESC, id DESC) AS rn FROM sn WHERE complete)
SELECT drive, max(CASE WHEN rn=3 THEN id END) AS before_id, max(CASE WHEN rn=1 THEN id END) AS after_id FROM r GROUP BY drive HAVING before_id IS NOT NULL""")
def diff_latest(spark, sf):
    return N.back(X.snapshots(spark, sf), 2)


@query(f"""WITH {X.HISTORY}, b AS (SELECT * FROM sn WHERE id=2), a AS (SELECT * FROM sn WHERE id=5)
SELECT 1::BIGINT AS ordinal, 'demoted' AS code, ((contains(coalesce(b.note,''),'{N.DEMOTED}'))::INT + (contains(coalesce(a.note,''),'{N.DEMOTED}'))::INT)::BIGINT AS n, {N.DEMOTE_DEPTH}::BIGINT AS depth, {N.DEMOTE_BYTES}::BIGINT AS bytes, NULL::VARCHAR AS before_method, NULL::VARCHAR AS after_method FROM a, b WHERE contains(coalesce(b.note,''),'{N.DEMOTED}') OR contains(coalesce(a.note,''),'{N.DEMOTED}')
UNION ALL SELECT 2, 'mixedMethod', NULL, NULL, NULL, b.method, a.method FROM a, b WHERE a.method <> b.method
UNION ALL SELECT 3, 'rulesChanged', NULL, NULL, NULL, b.method, a.method FROM a, b WHERE a.method='mft' AND b.method='mft' AND 2 < {X.BOUNDARY} AND {X.BOUNDARY} <= 5
UNION ALL SELECT 6, 'fileThreshold', NULL, NULL, NULL, NULL, NULL FROM a, b WHERE a.file_count > 0 AND b.file_count > 0""")
def diff_caveats(spark, sf):
    return N.caveats(X.heads(spark), X.snap_files(spark, sf), 2, 5, X.BOUNDARY).withColumn("ordinal", F.col("ordinal").cast("long"))


# -- the timeline -------------------------------------------------------------------------------------------------------


@query(f"WITH {_BUCKETS} SELECT day, sum(bytes)::BIGINT AS added, sum(bytes)::BIGINT AS net, sum(files)::BIGINT AS files_added FROM bk GROUP BY day")
def retro_days(spark, sf):
    return buckets.retro_days(buckets.age_buckets(X.entries(spark, sf), X.BUCKET_BYTES))


@query(f"WITH {_BUCKETS}, r AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY bytes DESC, attribution)::BIGINT AS rank, attribution AS path, bytes FROM bk WHERE attribution <> '') SELECT day, rank, path, bytes FROM r WHERE rank <= 5")
def retro_contributors(spark, sf):
    return buckets.retro_contributors(buckets.age_buckets(X.entries(spark, sf), X.BUCKET_BYTES)).withColumn("rank", F.col("rank").cast("long"))


_DELTAS = f"""{X.HISTORY_DIRS}, {_PAIRS},
dl AS (SELECT drive, {day_sql("after_at")} AS day, path, sum(x)::BIGINT AS delta FROM (
  SELECT drive, after_at, coalesce(a.path, b.path) AS path, coalesce(a.bytes,0) - coalesce(b.bytes,0) AS x
  FROM (SELECT pr.*, path, bytes FROM pr JOIN sd ON snapshot_id = after_id WHERE depth BETWEEN 1 AND 3) a FULL JOIN (SELECT pr.*, path, bytes FROM pr JOIN sd ON snapshot_id = before_id WHERE depth BETWEEN 1 AND 3) b
  USING (drive, before_id, after_id, before_at, after_at, path)) GROUP BY ALL HAVING sum(x) <> 0),
md AS (SELECT n.drive, n.day, coalesce(added,0)::BIGINT AS added, coalesce(removed,0)::BIGINT AS removed, n.net::BIGINT AS net FROM (SELECT drive, {day_sql("after_at")} AS day, sum(net) AS net FROM pr GROUP BY ALL) n
  LEFT JOIN (SELECT drive, day, sum(greatest(delta,0)) AS added, sum(greatest(-delta,0)) AS removed FROM dl WHERE NOT contains(path, chr(92)) GROUP BY ALL) t USING (drive, day)),
spn AS (SELECT DISTINCT drive, strftime(d, '%Y-%m-%d') AS day FROM (SELECT drive, unnest(generate_series(CAST({day_sql("before_at")} AS DATE) + INTERVAL 1 DAY, CAST({day_sql("after_at")} AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM pr))"""


def _deltas(spark, sf):
    return T.deltas(X.snapshots(spark, sf), X.snap_sizes(spark, sf, T.COMPARE_DEPTH))


@query(f"WITH {_DELTAS} SELECT drive, day, path, delta FROM dl")
def measured_deltas(spark, sf):
    return _deltas(spark, sf)


@query(f"WITH {_DELTAS} SELECT drive, day, added, removed, net FROM md")
def measured_days(spark, sf):
    return T.measured_days(X.snapshots(spark, sf), _deltas(spark, sf))


@query(f"WITH {_DELTAS} SELECT drive, day FROM spn")
def spanned_days(spark, sf):
    return T.spanned_days(X.snapshots(spark, sf))


_HISTORY_BUCKETS = f"""fineh AS (SELECT snapshot_id, {day_sql("created")} AS day, array_to_string(string_split(path,chr(92))[1:3], chr(92)) AS a, sum(bytes) AS b, count(*) AS n FROM se WHERE bytes > 0 GROUP BY ALL),
bh AS (SELECT snapshot_id, day, CASE WHEN b >= {X.BUCKET_BYTES} THEN a ELSE '' END AS attribution, sum(b)::BIGINT AS bytes, sum(n)::BIGINT AS files FROM fineh GROUP BY ALL)"""
_TIMELINE = f"""{_DELTAS}, {_HISTORY_BUCKETS},
nw AS (SELECT drive, arg_max(id, taken_at) AS id, {day_sql("max(taken_at)")} AS horizon FROM sn WHERE complete GROUP BY drive),
tl0 AS (SELECT drive, day, 'retro' AS basis, sum(bytes)::BIGINT AS added, 0::BIGINT AS removed, sum(bytes)::BIGINT AS net, sum(files)::BIGINT AS files_added FROM bh JOIN nw ON snapshot_id=id ANTI JOIN spn USING (drive, day) GROUP BY drive, day
  UNION ALL SELECT drive, day, 'measured', added, removed, net, 0 FROM md SEMI JOIN spn USING (drive, day)),
tl1 AS (SELECT t.* FROM tl0 t JOIN nw USING (drive) WHERE day >= {day_sql(f"({X.NOW_HISTORY}-90*86400)")} AND day <= horizon),
ax AS (SELECT drive, strftime(unnest(generate_series(min(day)::DATE::TIMESTAMP, max(day)::DATE::TIMESTAMP, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM tl1 GROUP BY drive),
tl AS (SELECT drive, day, coalesce(basis,'retro') AS basis, coalesce(added,0)::BIGINT AS added, coalesce(removed,0)::BIGINT AS removed, coalesce(net,0)::BIGINT AS net, coalesce(files_added,0)::BIGINT AS files_added FROM ax LEFT JOIN tl1 USING (drive, day))"""


def _timeline(spark, sf):
    held = buckets.age_buckets(X.snap_entries(spark, sf), X.BUCKET_BYTES, by=["snapshot_id"])
    heads = saved(X.snapshots(spark, sf), "snapshots")  # a table, as in a store
    return T.timeline(heads, X.snap_sizes(spark, sf, T.COMPARE_DEPTH), held, X.NOW_HISTORY)


@query(f"WITH {_TIMELINE} SELECT drive, day, basis, added, removed, net, files_added FROM tl")
def timeline(spark, sf):
    return _timeline(spark, sf).select("drive", "day", "basis", "added", "removed", "net", "files_added")


@query(f"""WITH {_BUCKETS}, d AS (SELECT 'C:' AS drive, day, sum(bytes)::BIGINT AS added, sum(files)::BIGINT AS files_added FROM bk GROUP BY day),
ax AS (SELECT strftime(unnest(generate_series(min(day)::DATE::TIMESTAMP, max(day)::DATE::TIMESTAMP, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM d)
SELECT 'C:' AS drive, day, 'retro' AS basis, coalesce(added,0)::BIGINT AS added, 0::BIGINT AS removed, coalesce(added,0)::BIGINT AS net, coalesce(files_added,0)::BIGINT AS files_added FROM ax LEFT JOIN d USING (day)""")
def fill_gaps(spark, sf):
    rows = buckets.retro_days(buckets.age_buckets(X.entries(spark, sf), X.BUCKET_BYTES))
    rows = rows.select(F.lit("C:").alias("drive"), "day", F.lit("retro").alias("basis"), "added", F.lit(0).cast("long").alias("removed"), "net", "files_added")
    return T.filled(rows)


@query(f"""WITH {_TIMELINE} SELECT drive, count(*)::BIGINT AS days, count(*) FILTER (basis='retro')::BIGINT AS retro_days, count(*) FILTER (basis='measured')::BIGINT AS measured_days, coalesce(sum(added) FILTER (basis='retro'),0)::BIGINT AS retro_added,
coalesce(sum(added) FILTER (basis='measured'),0)::BIGINT AS measured_added, coalesce(sum(removed) FILTER (basis='measured'),0)::BIGINT AS measured_removed, coalesce(sum(net) FILTER (basis='measured'),0)::BIGINT AS measured_net,
(SELECT day FROM tl x WHERE x.drive = tl.drive ORDER BY added DESC, day LIMIT 1) AS busiest_day, min(day) FILTER (basis='measured') AS first_measured_day FROM tl GROUP BY drive""")
def timeline_summary(spark, sf):
    return T.summary(_timeline(spark, sf))


@query(f"WITH {_TIMELINE} SELECT drive, day, added, removed, max(greatest(added, removed)) OVER (PARTITION BY drive) AS peak FROM tl")
def timeline_peak(spark, sf):
    return _timeline(spark, sf).select("drive", "day", "added", "removed", T.peak(None).alias("peak"))


_DAILY = f"""{X.EVENTS}, dy AS (SELECT drive, {day_sql("timestamp")} AS day, count(*) FILTER (kind='create')::BIGINT AS created, count(*) FILTER (kind='delete')::BIGINT AS deleted, count(*) FILTER (kind IN ('rename_old','rename_new'))::BIGINT AS renamed, count(*) FILTER (kind='write')::BIGINT AS written,
coalesce(sum(bytes) FILTER (kind='delete'),0)::BIGINT AS deleted_bytes_known, count(*) FILTER (kind='delete' AND coalesce(bytes,0)=0)::BIGINT AS deleted_bytes_unknown_files FROM evk WHERE timestamp >= {X.NOW_EVENTS} - 30*86400 GROUP BY ALL)"""


def _kinds(spark, sf):
    return X.events(spark, sf).withColumn("kind", reasons.kind("reason"))


@query(f"""WITH {_TIMELINE}, {_DAILY}, sh AS (SELECT drive, strftime(day::DATE - INTERVAL 9131 DAY, '%Y-%m-%d') AS day, created, deleted, deleted_bytes_known FROM dy)
SELECT drive, day, basis, added, removed, net, coalesce(created,0)::BIGINT AS created, coalesce(deleted,0)::BIGINT AS deleted, coalesce(deleted_bytes_known,0)::BIGINT AS deleted_bytes_known FROM tl LEFT JOIN sh USING (drive, day)""")
def timeline_with_journal(spark, sf):
    seen = journal.daily(_kinds(spark, sf), X.NOW_EVENTS).select("drive", F.date_format(F.date_sub(F.to_date("day"), 9131), "yyyy-MM-dd").alias("day"), "created", "deleted", "deleted_bytes_known")
    return T.with_journal(_timeline(spark, sf).drop("files_added"), seen)


_GREEDY = f"""WITH RECURSIVE {_DELTAS},
it AS (SELECT drive, day, CASE WHEN delta>0 THEN 'up' ELSE 'down' END AS direction, path, abs(delta)::BIGINT AS bytes FROM dl),
o AS (SELECT *, row_number() OVER (PARTITION BY drive, day, direction ORDER BY bytes DESC, len(path)-len(replace(path,chr(92),'')) DESC, path) AS rk FROM it),
g(drive, day, direction, rk, kept) AS (
  SELECT DISTINCT drive, day, direction, 0::BIGINT, CAST([] AS VARCHAR[]) FROM it
  UNION ALL
  SELECT o.drive, o.day, o.direction, o.rk, CASE WHEN len(list_filter(g.kept, lambda q: starts_with(o.path, q||chr(92)) OR starts_with(q, o.path||chr(92)))) > 0 THEN g.kept ELSE list_append(g.kept, o.path) END
  FROM g JOIN o ON o.drive=g.drive AND o.day=g.day AND o.direction=g.direction AND o.rk = g.rk + 1),
fin AS (SELECT drive, day, direction, arg_max(kept, rk) AS kept FROM g GROUP BY ALL),
sp AS (SELECT drive, day, direction, unnest(kept) AS picked FROM fin),
ch AS (SELECT drive, day, direction, array_to_string(string_split(path,chr(92))[1:-2], chr(92)) AS up, path, bytes FROM it WHERE contains(path, chr(92)) QUALIFY row_number() OVER (PARTITION BY drive, day, direction, up ORDER BY bytes DESC, path) = 1),
dr(drive, day, direction, picked, path, bytes, step) AS (
  SELECT sp.drive, sp.day, sp.direction, picked, path, bytes, 0 FROM sp JOIN it ON it.drive=sp.drive AND it.day=sp.day AND it.direction=sp.direction AND path = picked
  UNION ALL
  SELECT dr.drive, dr.day, dr.direction, picked, ch.path, ch.bytes, step + 1 FROM dr JOIN ch ON ch.drive=dr.drive AND ch.day=dr.day AND ch.direction=dr.direction AND ch.up = dr.path WHERE ch.bytes >= dr.bytes * 0.9),
dd AS (SELECT drive, day, direction, picked, arg_max(path, step) AS path, arg_max(bytes, step)::BIGINT AS bytes FROM dr GROUP BY ALL),
rk2 AS (SELECT drive, day, direction, row_number() OVER (PARTITION BY drive, day, direction ORDER BY bytes DESC, path)::BIGINT AS rank, path, bytes, picked FROM dd)"""


@query(f"{_GREEDY} SELECT drive, day, direction, rank, path, bytes, picked FROM rk2 WHERE rank <= 5")
def measured_contributors(spark, sf):
    return T.contributors(_deltas(spark, sf))


@query(f"{_GREEDY} SELECT drive, day, direction, picked, path, bytes FROM rk2")
def dominant_drilldown(spark, sf):
    return T.contributors(_deltas(spark, sf), top_n=None).select("drive", "day", "direction", "picked", "path", "bytes")


# -- hot spots ----------------------------------------------------------------------------------------------------------

_HINT = lambda field: "CASE " + " ".join(f"WHEN contains(lower(path), '{r[0]}') THEN '{r[field]}'" for r in X.RULES) + " END"


@query(f"""WITH {E_DIRS}, t AS (SELECT * FROM dirs WHERE depth BETWEEN 1 AND 6 ORDER BY bytes DESC, path LIMIT 24),
r AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, path) AS rk FROM t)
SELECT path, bytes, files, newest_mtime AS newest, {_HINT(1)} AS rule, {_HINT(2)} AS safety FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.rk < a.rk AND starts_with(a.path, b.path||chr(92))) ORDER BY bytes DESC, path LIMIT 4""")
def biggest_dirs(spark, sf):
    return hotspots.biggest_dirs(tree.rollup(X.entries(spark, sf), X.NOW_ENTRIES), 4, 6, X.RULES)


@query(f"WITH {X.ENTRIES} SELECT path, bytes, 1::BIGINT AS files, modified AS newest, {_HINT(1)} AS rule, {_HINT(2)} AS safety FROM fx ORDER BY bytes DESC, path LIMIT 40")
def biggest_files(spark, sf):
    return hotspots.biggest_files(X.entries(spark, sf).select("path", "bytes", F.col("modified").alias("mtime")), 40, X.RULES)


@query(f"""WITH {E_DIRS}, t AS (SELECT * FROM dirs WHERE depth >= 1 AND newest_ctime BETWEEN {X.NOW_ENTRIES} - 14*86400 AND {X.NOW_ENTRIES} + 172800 AND bytes >= {X.PRUNE_BYTES} ORDER BY bytes DESC, path LIMIT 100),
r AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, path) AS rk FROM t)
SELECT path, bytes, newest_ctime AS newest, greatest(0, ({X.NOW_ENTRIES} - newest_ctime)/86400) AS days_old FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.rk < a.rk AND starts_with(a.path, b.path||chr(92))) ORDER BY bytes DESC, path LIMIT 25""")
def recently_grown(spark, sf):
    return hotspots.recently_grown(tree.rollup(X.entries(spark, sf), X.NOW_ENTRIES), X.NOW_ENTRIES, min_bytes=X.PRUNE_BYTES)


_CLEAN = f"""{E_DIRS}, n AS (SELECT *, {_HINT(1)} AS rule, {_HINT(2)} AS safety FROM dirs WHERE depth >= 1 AND bytes >= {X.PRUNE_BYTES} AND {_HINT(1)} IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, path) AS rk FROM n),
fd AS (SELECT path, bytes, files, newest_mtime AS newest, rule, safety FROM r a WHERE NOT EXISTS (SELECT 1 FROM (SELECT path AS bp, rk AS brk FROM r) b WHERE brk < a.rk AND starts_with(a.path, bp||chr(92)))),
sg AS (SELECT path, bytes, 1::BIGINT AS files, modified AS newest, {_HINT(1)} AS rule, {_HINT(2)} AS safety FROM fx WHERE bytes >= {X.FILE_BYTES} AND {_HINT(1)} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fd WHERE starts_with(fx.path, fd.path||chr(92)) OR fx.path = fd.path)),
cl AS (SELECT * FROM (SELECT * FROM fd UNION ALL SELECT * FROM sg) ORDER BY bytes DESC, path LIMIT 40)"""


def _cleanup(spark, sf):
    e = X.entries(spark, sf)
    dirs = tree.rollup(e, X.NOW_ENTRIES).where(F.col("bytes") >= X.PRUNE_BYTES)
    return hotspots.cleanup_candidates(dirs, e.select("path", "bytes", F.col("modified").alias("mtime")), 40, X.FILE_BYTES, X.RULES)


@query(f"WITH {_CLEAN} SELECT path, bytes, files, newest, rule, safety FROM cl")
def cleanup_candidates(spark, sf):
    return _cleanup(spark, sf)


@query(f"WITH {_CLEAN} SELECT coalesce(sum(bytes),0)::BIGINT AS all_bytes, coalesce(sum(bytes) FILTER (safety='safe'),0)::BIGINT AS safe_bytes FROM cl")
def cleanup_totals(spark, sf):
    return hotspots.cleanup_totals(_cleanup(spark, sf))


# -- the journal --------------------------------------------------------------------------------------------------------


@query(f"WITH {X.EVENTS} SELECT drive, usn, reason, kind, CASE kind WHEN 'delete' THEN '删除+关闭' WHEN 'create' THEN '新建' WHEN 'rename_old' THEN '改名前' WHEN 'rename_new' THEN '改名后' ELSE '写入变大' END AS reason_text FROM evk")
def journal_classify(spark, sf):
    return journal.classified(X.events(spark, sf)).select("drive", "usn", "reason", "kind", "reason_text")


@query(f"WITH {X.EVENTS} SELECT drive, usn, timestamp, kind, path FROM evk WHERE kind IN ('create','delete','rename_old')")
def journal_filter_kinds(spark, sf):
    return journal.stored(X.events(spark, sf)).select("drive", "usn", "timestamp", "kind", "path")


@query(f"WITH {X.EVENTS} SELECT drive, usn, timestamp, kind FROM evk WHERE usn % 3 <> 0")
def journal_dedupe(spark, sf):
    e = _kinds(spark, sf)
    return journal.deduplicated(e.where("usn % 3 = 0"), e.unionByName(e.where("usn % 2 = 0"))).select("drive", "usn", "timestamp", "kind")


@query("""WITH e AS (SELECT event_id AS usn, user_id % 50 AS rec, (user_id % 50) + 7 * 281474976710656 AS full_ref, 'f' || event_id AS name FROM events)
SELECT usn, CASE WHEN rec % 7 = 0 THEN name WHEN rec % 3 = 0 THEN 'd' || rec || chr(92) || name WHEN rec % 3 = 1 AND rec % 2 = 0 THEN 'l' || rec || chr(92) || name END AS path FROM e""")
def journal_resolve_paths(spark, sf):
    rec = F.col("user_id") % 50
    e = X.table(spark, sf, "events").select(F.col("event_id").alias("usn"), (rec + 7 * (1 << 48)).alias("parent_full"), F.concat(F.lit("f"), "event_id").alias("name"))
    ids = spark.range(50)
    known = ids.where("id % 7 = 0 OR id % 3 = 0").select(F.col("id").alias("record"), F.when(F.col("id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("d"), "id")).alias("path"))
    asked = ids.where("id % 3 = 1").select((F.col("id") + 7 * (1 << 48)).alias("reference"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("l"), "id")).alias("path"))
    return journal.resolved(e, known, asked).select("usn", "path")


@query("""SELECT 'S'||s_suppkey AS drive, CASE WHEN s_suppkey%4=0 OR s_suppkey%4=1 OR s_suppkey%10 < 3 THEN s_suppkey*10 ELSE s_suppkey*10 - 30 + (s_suppkey%10)*10 END::BIGINT AS start_usn,
s_suppkey%4=0 AS first_run, s_suppkey%4<>0 AND (s_suppkey%4=1 OR s_suppkey%10 < 3) AS journal_reset FROM supplier""")
def journal_cursor_plan(spark, sf):
    k = F.col("s_suppkey")
    rows = X.table(spark, sf, "supplier").select(F.concat(F.lit("S"), k).alias("drive"), k.alias("k"))
    journals = rows.select("drive", F.lit(7).cast("long").alias("journal_id"), (F.col("k") * 10).alias("lowest_valid_usn"))
    cursors = rows.where("k % 4 <> 0").select("drive", F.when(F.col("k") % 4 == 1, 6).otherwise(7).cast("long").alias("journal_id"), (F.col("k") * 10 - 30 + (F.col("k") % 10) * 10).alias("next_usn"))
    return journal.cursor_plan(cursors, journals)


@query(f"WITH {X.EVENTS} SELECT drive, usn, timestamp FROM evk WHERE timestamp >= epoch(TIMESTAMP '2024-01-16 00:00:00')")
def journal_ttl(spark, sf):
    return journal.unexpired(_kinds(spark, sf), X.NOW_EVENTS, 15).select("drive", "usn", "timestamp")


@query(f"WITH {_DAILY} SELECT * FROM dy")
def journal_daily(spark, sf):
    return journal.daily(_kinds(spark, sf), X.NOW_EVENTS)


@query(f"""WITH {_DAILY}, z AS (SELECT drive, day, epoch(strptime(day,'%Y-%m-%d')) AS s FROM dy WHERE deleted > 0),
w AS (SELECT z.drive, z.day, e.path, CASE WHEN e.path IS NULL OR e.path='' THEN usn ELSE 0 END AS own, max(bytes) AS bytes, max(timestamp) AS "at", count(*)::BIGINT AS count, arg_max(name, (timestamp, usn)) AS name
 FROM z JOIN evk e ON e.drive = z.drive AND kind='delete' AND timestamp >= s AND timestamp < s + 93600 GROUP BY ALL)
SELECT drive, day, row_number() OVER (PARTITION BY drive, day ORDER BY coalesce(bytes,0) DESC, "at" DESC, path, own)::BIGINT AS rank, coalesce(path, name) AS path, bytes, false AS is_dir, "at", count FROM w
QUALIFY row_number() OVER (PARTITION BY drive, day ORDER BY coalesce(bytes,0) DESC, "at" DESC, path, own) <= 5""")
def journal_top_deleted(spark, sf):
    return journal.top_deleted(_kinds(spark, sf), X.NOW_EVENTS).withColumn("rank", F.col("rank").cast("long"))


_CHANGES = f"""{X.EVENTS}, cg AS (SELECT max(usn) AS usn, max(timestamp) AS at, 'delete' AS kind, false AS is_dir, arg_max(name, (timestamp, usn)) AS name, path, max(bytes) AS bytes, count(*)::BIGINT AS count FROM evk
 WHERE drive='C:' AND kind='delete' AND timestamp >= {X.NOW_EVENTS} - 30*86400 GROUP BY path, CASE WHEN path IS NULL OR path='' THEN usn ELSE 0 END ORDER BY coalesce(max(bytes),0) DESC, (path IS NOT NULL AND path <> '') DESC, max(timestamp) DESC, path NULLS FIRST, max(usn) LIMIT 200)"""


def _changes(spark, sf):
    return journal.changes(_kinds(spark, sf), "C:", X.NOW_EVENTS)


@query(f"WITH {_CHANGES} SELECT usn, \"at\", kind, is_dir, name, path, bytes, count FROM cg")
def journal_changes(spark, sf):
    return _changes(spark, sf)


@query(f"WITH {_CHANGES} SELECT count(*) FILTER (bytes IS NULL)::BIGINT AS unknown_size, count(*) FILTER (path IS NULL OR path='')::BIGINT AS no_path FROM cg")
def changes_quality(spark, sf):
    return journal.quality(_changes(spark, sf))


@query(f"""WITH {X.EVENTS}, s(drive, available, reason) AS (VALUES ('C:', true, NULL), ('E:', false, 'denied')), c AS (SELECT drive, count(*) AS n, min(timestamp) AS lo, max(timestamp) AS hi FROM ev GROUP BY drive)
SELECT drive, coalesce(n,0)::BIGINT AS events, {day_sql("lo")} AS first_day, {day_sql("hi")} AS last_day, coalesce(datediff('day', CAST({day_sql("lo")} AS DATE), CAST({day_sql("hi")} AS DATE)) + 1, 0)::BIGINT AS days, available, reason FROM c FULL JOIN s USING (drive)""")
def journal_coverage(spark, sf):
    status = spark.createDataFrame([("C:", True, None), ("E:", False, "denied")], "drive string, available boolean, reason string")
    return journal.coverage(X.events(spark, sf), status)


_LOST = "SELECT 'C:' AS drive, key AS usn, 'delete' AS kind, path, key%10=0 AS is_dir, CASE WHEN key%4=0 THEN bytes END AS bytes FROM fx WHERE deleted_at IS NOT NULL"


@query(f"""WITH {X.HISTORY}, e AS ({_LOST}), z AS (SELECT drive, path, arg_max(bytes, (taken_at, id)) AS found FROM (SELECT f.path, f.bytes, s.drive, s.taken_at, s.id FROM se f JOIN fx_heads s ON s.id = f.snapshot_id) GROUP BY ALL)
SELECT e.drive, usn, kind, e.path, is_dir, CASE WHEN bytes IS NULL AND NOT is_dir THEN found ELSE bytes END AS bytes FROM e LEFT JOIN z ON z.path = e.path AND z.drive = e.drive""")
def enrich_deleted_sizes(spark, sf):
    e = X.entries(spark, sf).where("deleted_at IS NOT NULL").select(F.lit("C:").alias("drive"), F.col("key").alias("usn"), F.lit("delete").alias("kind"), "path", (F.col("key") % 10 == 0).alias("is_dir"), F.when(F.col("key") % 4 == 0, F.col("bytes")).alias("bytes"))
    return journal.enriched(e, X.snap_files(spark, sf), X.heads(spark), limit=None)


@query(f"""WITH {X.HISTORY}, e AS ({_LOST}), w AS (SELECT *, bytes IS NULL AND NOT is_dir AS wants FROM e), k AS (SELECT *, row_number() OVER (PARTITION BY drive, wants ORDER BY usn) AS nth FROM w),
z AS (SELECT drive, path, arg_max(bytes, (taken_at, id)) AS found FROM (SELECT f.path, f.bytes, s.drive, s.taken_at, s.id FROM se f JOIN fx_heads s ON s.id = f.snapshot_id) GROUP BY ALL)
SELECT k.drive, usn, CASE WHEN wants AND nth <= {X.ENRICHED} THEN found ELSE bytes END AS bytes FROM k LEFT JOIN z ON z.path = k.path AND z.drive = k.drive""")
def enrich_first_deleted(spark, sf):
    e = X.entries(spark, sf).where("deleted_at IS NOT NULL").select(F.lit("C:").alias("drive"), F.col("key").alias("usn"), F.lit("delete").alias("kind"), "path", (F.col("key") % 10 == 0).alias("is_dir"), F.when(F.col("key") % 4 == 0, F.col("bytes")).alias("bytes"))
    return journal.enriched(e, X.snap_files(spark, sf), X.heads(spark), X.ENRICHED).select("drive", "usn", "bytes")


# -- file tables --------------------------------------------------------------------------------------------------------


@query(f"WITH {E_DIRS} SELECT path, 'ok' AS state FROM dirs UNION ALL VALUES (NULL, 'cycle'), (NULL, 'cycle'), (NULL, 'cycle'), (NULL, 'cycle'), (NULL, 'orphan'), (NULL, 'orphan')")
def mft_resolve_paths(spark, sf):
    return filetable.resolved_paths(X.dir_ids(spark, sf)).select("path", "state")


@query("""WITH b AS (SELECT o_orderkey AS record, o_orderkey%50=0 AS is_dir, CASE WHEN o_orderkey%3=0 THEN 0 ELSE floor(o_totalprice)::BIGINT END AS bytes, floor(o_totalprice)::BIGINT AS logical_bytes, o_orderkey%11=0 AS wof FROM orders),
x AS (SELECT l_orderkey AS base, sum(floor(l_extendedprice))::BIGINT AS u, sum(l_linenumber*1000)::BIGINT AS n, sum(floor(l_extendedprice)*2)::BIGINT AS l, bool_or(l_linenumber=4) AS w FROM lineitem GROUP BY 1)
SELECT record, is_dir, CASE WHEN base IS NULL OR is_dir THEN bytes ELSE greatest(bytes, CASE WHEN wof OR w THEN n ELSE u+n END) END::BIGINT AS bytes, CASE WHEN base IS NULL OR is_dir THEN logical_bytes ELSE greatest(logical_bytes, l) END::BIGINT AS logical_bytes, CASE WHEN base IS NULL OR is_dir THEN wof ELSE wof OR w END AS wof FROM b LEFT JOIN x ON base=record""")
def mft_extension_merge(spark, sf):
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    base = X.table(spark, sf, "orders").select(k.alias("record"), (k % 50 == 0).alias("is_dir"), F.when(k % 3 == 0, F.lit(0)).otherwise(price).alias("bytes"), price.alias("logical_bytes"), (k % 11 == 0).alias("wof"))
    floor = F.floor("l_extendedprice").cast("long")
    ext = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("base"), floor.alias("unnamed"), (F.col("l_linenumber") * 1000).cast("long").alias("named"), (floor * 2).alias("logical"), (F.col("l_linenumber") == 4).alias("wof"))
    return filetable.merged_sizes(base, ext)


@query(f"WITH {X.EVENTS} SELECT usn, usn AS file, (usn % 1000)::BIGINT AS parent, floor(timestamp)::DOUBLE AS timestamp, reason, is_dir, name FROM ev")
def usn_decode(spark, sf):
    from accretion.sources.readers import EVENTS, decoded

    return X.usn_buffers(X.events(spark, sf)).mapInArrow(decoded, EVENTS).select("usn", "file", "parent", "timestamp", "reason", "is_dir", "name")


@query("""SELECT p_partkey, CASE WHEN p_partkey%5=0 THEN NULL ELSE 3 END::BIGINT AS runs, CASE WHEN p_partkey%5=0 THEN NULL ELSE p_size + p_size*300 END::BIGINT AS on_disk, CASE WHEN p_partkey%5=0 THEN NULL ELSE p_size*2 + p_size*300 END::BIGINT AS clusters,
CASE WHEN p_partkey%5=0 THEN NULL ELSE p_partkey*3 + 100000 - p_size END::BIGINT AS last_lcn FROM part""")
def runlist_decode(spark, sf):
    from accretion.sources.readers import run_lists

    def encode(batches):
        import pyarrow as pa

        for b in batches:
            rows = zip(b.column("p_partkey").to_pylist(), b.column("p_size").to_pylist(), strict=True)
            # a list that starts before the volume can't be right
            data = [X.run_list_bytes([s, s, s * 300], [-5 if k % 5 == 0 else k * 3 + 100000, None, -s]) for k, s in rows]
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), pa.array(data, pa.binary())], names=["p_partkey", "data"])

    rows = X.table(spark, sf, "part").select("p_partkey", "p_size").mapInArrow(encode, "p_partkey long, data binary").withColumn("r", run_lists("data"))
    total = lambda kept: F.aggregate(F.filter("r", kept), F.lit(0).cast("long"), lambda a, x: a + x["length"])
    there = F.col("r").isNotNull()
    return rows.select(
        "p_partkey", F.when(there, F.size("r").cast("long")).alias("runs"), F.when(there, total(lambda x: x["lcn"].isNotNull())).alias("on_disk"), F.when(there, total(lambda x: F.lit(True))).alias("clusters"),
        F.when(there, F.array_max(F.transform(F.slice("r", 3, 1), lambda x: x["lcn"]))).alias("last_lcn"),
    )


@query(f"""WITH {X.EVENTS}, h AS (SELECT drive, usn % 7 AS slot, usn, timestamp FROM ev), k AS (SELECT drive || slot AS drive, max(usn) AS next_usn FROM h GROUP BY 1) SELECT drive, next_usn FROM k""")
def cursor_upsert(spark, sf):
    rows = X.events(spark, sf).select(F.concat("drive", (F.col("usn") % 7).cast("string")).alias("drive"), F.col("usn").alias("next_usn"), F.col("usn").cast("double").alias("updated_at"))
    return journal.kept_last(rows.where("next_usn % 2 = 0"), rows.where("next_usn % 2 = 1")).select("drive", "next_usn")


@query("""SELECT DISTINCT (user_id % 50) + 7 * 281474976710656 AS reference FROM events WHERE (user_id % 50) % 7 <> 0 AND (user_id % 50) % 3 = 2""")
def lookup_references(spark, sf):
    e = X.table(spark, sf, "events").select((F.col("user_id") % 50 + 7 * (1 << 48)).alias("parent_full"))
    ids = spark.range(50)
    known = ids.where("id % 7 = 0 OR id % 3 = 0").select(F.col("id").alias("record"))
    asked = ids.where("id % 3 = 1").select((F.col("id") + 7 * (1 << 48)).alias("reference"), F.lit(None).cast("string").alias("path"))
    return journal.references_to_ask(e, known, asked)


@query(f"WITH {E_DIRS} SELECT path, bytes AS total FROM dirs WHERE path = 'ASIA'")
def tree_level_total(spark, sf):
    return tree.level_total(tree.rollup(X.entries(spark, sf), X.NOW_ENTRIES), "ASIA")


@query(f"""WITH {_TIMELINE}, v AS (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY day) AS at_, count(*) OVER (PARTITION BY drive) AS n, count(*) FILTER (day <= '1999-01-25') OVER (PARTITION BY drive) AS mid FROM tl)
SELECT drive, day, basis, added FROM v WHERE at_ BETWEEN greatest(1, least(mid - 15, n - 29)) AND greatest(1, least(mid - 15, n - 29)) + 29""")
def timeline_viewport(spark, sf):
    return T.viewport(_timeline(spark, sf), "1999-01-25", 30).select("drive", "day", "basis", "added")


@query(f"WITH {X.EVENTS} SELECT drive, count(*)::BIGINT AS events_read, min(usn) AS first_usn, max(usn) AS last_usn, 0::BIGINT AS no_time FROM ev GROUP BY drive")
def journal_counts(spark, sf):
    return journal.collected(X.events(spark, sf))


# -- the store and the front end ------------------------------------------------------------------------------------------

_KEPT = "('create','delete','rename_old')"


@query(f"WITH {X.EVENTS} SELECT drive, usn, timestamp, kind, path, bytes FROM evk WHERE kind IN {_KEPT} AND timestamp >= epoch(TIMESTAMP '2024-01-16 00:00:00')")
def journal_collect(spark, sf):
    """Two readings, of which the second brings what the first had, too; days before the 15th last are dropped."""
    return X.collected(spark, sf).events().select("drive", "usn", "timestamp", "kind", "path", "bytes")


@query(f"WITH {X.EVENTS} SELECT drive, 7::BIGINT AS journal_id, max(usn) + 1 AS next_usn, true AS available FROM ev GROUP BY drive")
def journal_cursors(spark, sf):
    store = X.collected(spark, sf)
    return store.cursors().join(store.status(), "drive").select("drive", "journal_id", "next_usn", "available")


@query(f"""WITH {X.HISTORY_DIRS} SELECT snapshot_id, path, bytes, own_bytes, files FROM sd WHERE snapshot_id IN (4, 5) AND (path = '' OR bytes >= {X.PRUNE_BYTES} OR depth <= {X.PRUNE_DEPTH}) AND NOT (snapshot_id = 4 AND depth > {N.DEMOTE_DEPTH} AND bytes < {N.DEMOTE_BYTES})""")
def store_dirs(spark, sf):
    """Two snapshots, of which the earlier one is thinned out."""
    return X.filled_store(spark, sf).read("dirs").select(F.col("snapshot_id").cast("long").alias("snapshot_id"), "path", "bytes", "own_bytes", "files")


@query(f"""WITH {X.HISTORY} SELECT 5::BIGINT AS snapshot_id, path, bytes FROM se WHERE snapshot_id = 5 AND bytes > 0 AND (bytes >= {X.FILE_BYTES} OR (created >= {X.TAKEN[5]} - 45*86400 AND bytes >= {X.RECENT_BYTES})) ORDER BY bytes DESC, path LIMIT {tree.FILE_CAP}""")
def store_files(spark, sf):
    """Those of the thinned snapshot are gone."""
    return X.filled_store(spark, sf).read("files").select(F.col("snapshot_id").cast("long").alias("snapshot_id"), "path", "bytes")


@query(f"WITH {X.HISTORY}, {_HISTORY_BUCKETS} SELECT snapshot_id::BIGINT AS snapshot_id, day, attribution, bytes, files FROM bh WHERE snapshot_id = 5")
def store_buckets(spark, sf):
    """Those of older snapshots are dropped."""
    return X.filled_store(spark, sf).read("age_buckets").select(F.col("snapshot_id").cast("long").alias("snapshot_id"), F.col("day").cast("string").alias("day"), "attribution", "bytes", "files")


@query(f"WITH {X.HISTORY} SELECT id, drive, taken_at, scanned_bytes, file_count, id = 4 AS demoted, 6::BIGINT AS boundary FROM sn WHERE id IN (4, 5)")
def store_snapshots(spark, sf):
    store = X.filled_store(spark, sf)
    return store.snapshots().select("id", "drive", "taken_at", "scanned_bytes", "file_count", N.is_demoted().alias("demoted"), F.lit(store.rules_boundary()).cast("long").alias("boundary"))


@query("""WITH h AS (SELECT o_orderkey % 7 AS snapshot_id, o_orderkey::VARCHAR AS path, floor(o_totalprice)::BIGINT AS bytes FROM orders WHERE o_orderkey % 4 = 0),
n AS (SELECT l_orderkey % 7 AS snapshot_id, l_orderkey::VARCHAR AS path, arg_min(floor(l_extendedprice)::BIGINT, (l_linenumber, floor(l_extendedprice)::BIGINT)) AS bytes FROM lineitem GROUP BY ALL)
SELECT * FROM h UNION ALL SELECT * FROM n ANTI JOIN h USING (snapshot_id, path)""")
def insert_keep_first(spark, sf):
    """A quarter of the orders are held; lineitems come as new rows, several of each key."""
    row = lambda k, b: [(F.col(k) % 7).alias("snapshot_id"), F.col(k).cast("string").alias("path"), F.floor(b).cast("long").alias("bytes")]
    held = X.table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(*row("o_orderkey", "o_totalprice"))
    new = X.table(spark, sf, "lineitem").select(*row("l_orderkey", "l_extendedprice"), "l_linenumber")
    return N.inserted(held.withColumn("l_linenumber", F.lit(0)), new, ["snapshot_id", "path"], F.struct("l_linenumber", "bytes")).drop("l_linenumber")


@query(f"WITH {E_DIRS} SELECT path, false AS is_dir, bytes FROM fx UNION ALL SELECT path, true, 0 FROM dirs WHERE path <> ''")
def scan_entries(spark, sf):
    records = X.records(spark, sf)
    return filetable.as_entries(records, filetable.resolved_paths(records.where("is_dir").select("record", "parent", "name"))).select("path", "is_dir", "bytes")


@query("SELECT 4096::BIGINT AS metafile_bytes, 7::BIGINT AS orphan_files, 77::BIGINT AS orphan_bytes")
def scan_warnings(spark, sf):
    records = X.records(spark, sf)
    return filetable.scan_warnings(records, filetable.resolved_paths(records.where("is_dir").select("record", "parent", "name")))


@query(f"""WITH {X.HISTORY_DIRS} SELECT 'node' AS part, path, 'ASIA' AS name, '' AS parent, bytes, own_bytes, files, dirs FROM sd WHERE snapshot_id = 5 AND path = 'ASIA'
UNION ALL SELECT 'child', path, string_split(path, chr(92))[2], 'ASIA', bytes, own_bytes, files, dirs FROM sd WHERE snapshot_id = 5 AND depth = 2 AND starts_with(path, 'ASIA' || chr(92))""")
def tree_node(spark, sf):
    level = X.engine(spark, sf).tree(path="C:/ASIA/")
    columns = ["path", "name", "parent", "bytes", "own_bytes", "files", "dirs"]
    kids = level["children"].withColumn("parent", P.parent("path"))
    return level["node"].select(F.lit("node").alias("part"), *columns).unionByName(kids.select(F.lit("child").alias("part"), *columns))


@query(f"""WITH {X.HISTORY_DIRS}, {_diff_sql('sd WHERE depth BETWEEN 1 AND 4', 4, 5, N.DIFF_BYTES)}
SELECT CASE WHEN delta>0 THEN 'grown' ELSE 'shrunk' END AS direction, path, before, after, delta, kind FROM df WHERE delta<>0 QUALIFY row_number() OVER (PARTITION BY delta>0 ORDER BY abs(delta) DESC, path) <= 40""")
def api_diff(spark, sf):
    """0 for both sides is the newest pair."""
    return X.engine(spark, sf).diff(before=0, after="0")["dirs"].drop("rank")


@query(f"""WITH {X.EVENTS}, c AS (SELECT drive, count(*)::BIGINT AS events, {day_sql("min(timestamp)")} AS first_day, {day_sql("max(timestamp)")} AS last_day FROM evk WHERE drive = 'C:' GROUP BY drive)
SELECT drive, events, first_day, last_day, (last_day::DATE - first_day::DATE + 1)::BIGINT AS days FROM c""")
def api_changes_coverage(spark, sf):
    return X.engine(spark, sf).changes("c")["coverage"].select("drive", "events", "first_day", "last_day", "days")


@query(f"""WITH {E_DIRS}, k AS (SELECT path, bytes, array_to_string(string_split(path,chr(92))[1:-2], chr(92)) AS level FROM dirs WHERE depth BETWEEN 1 AND 4 AND bytes > 0)
SELECT level, count(*)::BIGINT AS boxes, sum(bytes)::BIGINT AS bytes, 960000::BIGINT AS area, true AS in_bounds, true AS in_proportion FROM k GROUP BY level""")
def treemap_areas(spark, sf):
    """What holds for a layout: all of a level's boxes together fill its area, none lies outside, each has its share."""
    boxes = treemap_layout(spark, sf).withColumns({"whole": F.sum("bytes").over(Window.partitionBy("level"))})
    near = lambda a, b: F.abs(a - b) <= 1e-6 * F.lit(960_000.0)
    inside = (F.col("x") >= -1e-6) & (F.col("y") >= -1e-6) & (F.col("x") + F.col("w") <= 1200 + 1e-6) & (F.col("y") + F.col("h") <= 800 + 1e-6)
    out = boxes.groupBy("level").agg(
        F.count(F.lit(1)).alias("boxes"), F.sum("bytes").alias("bytes"), F.round(F.sum(F.col("w") * F.col("h"))).cast("long").alias("area"), F.bool_and(inside).alias("in_bounds"),
        F.bool_and(near(F.col("w") * F.col("h"), F.col("bytes") / F.col("whole") * 960_000)).alias("in_proportion"),
    )
    return out


# -- streams ------------------------------------------------------------------------------------------------------------


@query(f"WITH {X.EVENTS} SELECT drive, usn, kind FROM evk WHERE kind IN ('create','delete','rename_old')")
def journal_stream_dedupe(spark, sf):
    from accretion.streaming import journal_stream

    from accretion.scratch import scratch

    target = scratch(spark, "journal")
    rows = journal_stream.once(journal_stream.prepared(X.event_stream(spark, sf))).select("drive", "usn", "kind", "event_time")
    rows.writeStream.foreachBatch(journal_stream.sink(target)).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).select("drive", "usn", "kind")


@query(f"""WITH {X.EVENTS} SELECT drive, {day_sql("timestamp")} AS day, kind, count(*)::BIGINT AS events, coalesce(sum(bytes),0)::BIGINT AS bytes FROM evk WHERE kind IN ('create','delete','rename_old') GROUP BY ALL""")
def journal_stream_daily(spark, sf):
    from accretion.streaming import journal_stream

    from accretion.scratch import scratch

    target = scratch(spark, "daily")
    rows = journal_stream.daily(journal_stream.once(journal_stream.prepared(X.event_stream(spark, sf))))
    put = lambda batch, _: batch.write.mode("overwrite").parquet(target)
    rows.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


@query(f"WITH {X.EVENTS} SELECT drive, usn, kind, reason, name FROM evk WHERE kind IN {_KEPT}")
def journal_stream_binary(spark, sf):
    """Journals of binary buffers, read as streams in batches of some segments, into one table."""
    from accretion.scratch import scratch
    from accretion.sources import readers
    from accretion.streaming import journal_stream

    readers.register(spark)
    target = scratch(spark, "journal")
    rows = X.events(spark, sf).select("drive", "usn", X.ticks().alias("ticks"), "reason", "name", F.lit(5).cast("long").alias("parent_full"))
    for drive in ("C:", "D:"):
        folder = X.usn_folder(spark, rows.where(F.col("drive") == drive))
        stream = spark.readStream.format("usnjournal").option("path", folder).option("drive", drive).option("maxEventsPerBatch", X.BATCH_EVENTS).load().drop("kind")
        kept = journal_stream.once(journal_stream.prepared(stream)).select("drive", "usn", "kind", "reason", "name", "event_time")
        put = journal_stream.sink(f"{target}/{drive[0]}")
        journal_stream.drain(kept.writeStream.foreachBatch(put).option("checkpointLocation", scratch(spark, "offsets")))
    rows = [spark.read.parquet(f"{target}/{d}").select("drive", "usn", "kind", "reason", "name") for d in "CD"]
    return rows[0].unionByName(rows[1])


@query(f"""WITH e AS (SELECT CASE WHEN user_id%2=0 THEN 'C:' ELSE 'D:' END AS drive, event_id AS usn, user_id, CAST(json_extract_string(props,'$.k') AS INT) AS k,
CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'rename_old' ELSE 'other' END AS kind FROM events),
d AS (SELECT c_custkey, concat_ws(chr(92), r_name, n_name, 'u'||c_custkey) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT drive, usn, kind, CASE WHEN user_id%7 <> 0 THEN path||chr(92)||'k'||k END AS path FROM e LEFT JOIN d ON c_custkey = user_id%150+1 WHERE kind IN {_KEPT}""")
def journal_resolved_paths(spark, sf):
    """Events with only their parents' references get paths from an image's records; a record that was used anew gives none."""
    from accretion.operators.store import Store
    from accretion.scratch import scratch
    from accretion.sources import resolver

    path = X.image(spark, sf)
    owner = X.table(spark, sf, "events").select(F.col("event_id").alias("usn"), "user_id")
    reference = (F.col("user_id") % 150 + 1 + X.CUSTOMER_AT + F.shiftleft(F.when(F.col("user_id") % 7 == 0, X.SEQUENCE + 1).otherwise(X.SEQUENCE).cast("long"), 48)).alias("parent_full")
    readings = X.events(spark, sf).drop("path").join(owner, "usn").select("drive", "usn", "timestamp", "reason", "is_dir", "name", "bytes", reference)
    journals = spark.createDataFrame([(d, 7, 0, True, None) for d in ("C:", "D:")], "drive string, journal_id long, lowest_valid_usn long, available boolean, reason string")
    store = Store(spark, scratch(spark, "store"))
    store.collect(readings, journals, X.NOW_EVENTS, keep_days=36_500, resolvers={d: lambda ask: resolver.paths(spark, path, ask) for d in ("C:", "D:")})
    return store.events().select("drive", "usn", "kind", "path")


@query(f"""WITH {X.EVENTS} SELECT 'journal C:' AS name, 'done' AS state, count(*)::BIGINT AS rows, NULL AS cause FROM ev
UNION ALL SELECT 'broken', 'failed', 0, 'DIVIDE_BY_ZERO'""")
def stream_health(spark, sf):
    """What the store knows of two streams: one that went through, and one that failed in its first batch."""
    from accretion.operators.store import Store
    from accretion.scratch import scratch
    from accretion.streaming import health

    watch, store = health.Watch(), Store(spark, scratch(spark, "store"))
    rows = spark.readStream.schema(X.table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")
    streams = {"journal C:": rows.where("user_id % 2 = 0").select("event_id"), "broken": rows.where("user_id % 2 = 0").select(F.assert_true(F.col("event_id") < 0, "DIVIDE_BY_ZERO"))}
    spark.streams.addListener(watch)
    try:
        for name, stream in streams.items():
            query = stream.writeStream.format("noop").queryName(name).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start()
            try:
                query.awaitTermination()
            except Exception:
                continue  # what the listener is for
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        watch.put(store)
    finally:
        spark.streams.removeListener(watch)
    out = store.read("progress")
    return out.select("name", "state", F.when(F.col("state") == "done", F.col("rows")).otherwise(0).alias("rows"), F.when(F.contains("reason", F.lit("DIVIDE_BY_ZERO")), "DIVIDE_BY_ZERO").alias("cause"))


@query(f"""WITH {X.EVENTS}, g AS (SELECT drive, strftime(make_timestamp((timestamp*1000000)::BIGINT), '%Y-%m-%d') AS day, * EXCLUDE (drive) FROM evk WHERE kind = 'delete'),
z AS (SELECT drive, day, epoch(strptime(day,'%Y-%m-%d')) AS s FROM g GROUP BY ALL HAVING epoch(strptime(day,'%Y-%m-%d')) + 93600 <= (SELECT max(timestamp) FROM evk WHERE kind IN {_KEPT})),
w AS (SELECT z.drive, z.day, g.path, CASE WHEN g.path IS NULL OR g.path='' THEN usn ELSE 0 END AS own, max(bytes) AS bytes, max(timestamp) AS "at", count(*)::BIGINT AS count, arg_max(name, (timestamp, usn)) AS name
 FROM z JOIN g ON g.drive = z.drive AND timestamp >= s AND timestamp < s + 93600 GROUP BY ALL)
SELECT drive, day, row_number() OVER (PARTITION BY drive, day ORDER BY coalesce(bytes,0) DESC, "at" DESC, path, own)::BIGINT AS rank, coalesce(path, name) AS path, bytes, false AS is_dir, "at", count FROM w
QUALIFY row_number() OVER (PARTITION BY drive, day ORDER BY coalesce(bytes,0) DESC, "at" DESC, path, own) <= 5""")
def journal_stream_top_deleted(spark, sf):
    """Rankings of the days whose 26 hours are over, from a stream; each event once."""
    from accretion.scratch import scratch
    from accretion.streaming import journal_stream

    target = scratch(spark, "top")
    rows = X.event_stream(spark, sf)
    e = X.events(spark, sf).select("drive", "usn", "is_dir", "name", "path")
    groups = journal_stream.deleted_groups(journal_stream.once(journal_stream.prepared(rows), "0 seconds").join(e, ["drive", "usn"]), None)
    groups.writeStream.outputMode("append").foreachBatch(journal_stream.top_deleted_sink(target)).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).drop("batch").withColumn("rank", F.col("rank").cast("long"))
