"""Roll-ups, folding, suppression and chains against brute force on random forests, and small known cases."""

import random

import pytest
from accretion.functions import paths as P
from accretion.operators import buckets, timeline, tree, treemap
from accretion.scratch import saved

MIB = 1 << 20
SCHEMA = "path string, is_dir boolean, bytes long, created double, modified double"


def forest(seed, n=80):
    r = random.Random(seed)
    out = {}
    for _ in range(n):
        path = "\\".join(r.choice("abcd") for _ in range(r.randrange(1, 6)))
        out[path + "\\f%d" % r.randrange(9)] = (r.randrange(1, 100), r.choice([None, -1.0, float("nan"), 5e9, 1e9 + r.randrange(999)]))
    return [(p, False, b, None, m) for p, (b, m) in out.items()] + [("empty\\below", True, 0, None, 1e9)]


def above(path):
    parts = path.split("\\") if path else []
    return ["\\".join(parts[:i]) for i in range(len(parts))]


def brute(rows, now):
    dirs = {}

    def node(p):
        return dirs.setdefault(p, {"bytes": 0, "own": 0, "files": 0, "dirs": 0, "m": None})

    node("")
    ok = lambda m: m is not None and 0 <= m <= now + 2 * 86400
    for path, is_dir, size, _, m in rows:
        ups = above(path) + ([path] if is_dir else [])
        for u in ups:
            d = node(u)
            d["bytes"] += size
            d["files"] += not is_dir
            if ok(m):
                d["m"] = max(m, d["m"] or 0)
        node(ups[-1])["own"] += size
    for p in list(dirs):
        for u in above(p):
            dirs[u]["dirs"] += 1
    return dirs


@pytest.mark.parametrize("seed", range(4))
def test_rollup_and_fold(spark, seed):
    rows = forest(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    now = 1.0e9 + 500
    dirs = saved(tree.rollup(df, now), "dirs")
    want = brute(rows, now)
    assert {r.path: (r.bytes, r.own_bytes, r.files, r.dirs, r.newest_mtime) for r in dirs.collect()} == {p: (d["bytes"], d["own"], d["files"], d["dirs"], d["m"]) for p, d in want.items()}
    for least, deep in ((150, 1), (10**9, 0), (0, 9)):
        kept = {r.path: r for r in tree.prune(dirs, least, deep).collect()}
        assert set(kept) == {p for p, d in want.items() if not p or d["bytes"] >= least or len(p.split("\\")) <= deep}
        for p, r in kept.items():
            kids = sum(k.bytes for q, k in kept.items() if q and q.rpartition("\\")[0] == p)
            assert r.bytes == r.own_bytes + kids + r.folded_bytes
        assert sum(r.folded_children for r in kept.values()) == len(want) - len(kept)


def test_rollup_of_nothing(spark):
    assert [tuple(r)[:5] for r in tree.rollup(spark.createDataFrame([], SCHEMA), 0).collect()] == [("", 0, 0, 0, 0)]


def test_fold_case(spark):
    rows = [("keep\\x.bin", False, 100 * MIB, None, None), ("keep\\drop1\\a.txt", False, 1000, None, None), ("keep\\drop1\\drop2\\b.txt", False, 2000, None, None)]
    got = {r.path: r for r in tree.prune(tree.rollup(spark.createDataFrame(rows, SCHEMA), 0), 4 * MIB, 1).collect()}
    assert (got["keep"].folded_children, got["keep"].folded_bytes) == (2, 3000)


@pytest.mark.parametrize("seed", range(3))
def test_suppression_is_greedy(spark, seed):
    r = random.Random(seed)
    rows = list({"\\".join(r.choice("ab") for _ in range(r.randrange(1, 6))): r.randrange(5) for _ in range(30)}.items())
    picked = []
    for p, _ in sorted(rows, key=lambda x: (-x[1], x[0])):
        if not any(p.startswith(q + "\\") for q in picked):
            picked.append(p)
    got = tree.suppressed(spark.createDataFrame(rows, "path string, bytes long"))
    assert {x.path for x in got.collect()} == set(picked)


@pytest.mark.parametrize(
    ("items", "want"),
    [
        ([("PF", 48), ("PF\\360", 48), ("PF\\360\\360Safe", 48)], [("PF\\360\\360Safe", 48)]),
        ([("Users", 200), ("Users\\a", 1), ("Users\\b", 1)], [("Users", 200)]),
        ([("PF", 1378), ("PF\\OneDrive", 1338)], [("PF\\OneDrive", 1338)]),
        ([("A", 1000), ("A\\b", 1000), ("A\\b\\x", 500), ("A\\b\\y", 500), ("A\\b\\x\\deep", 500)], [("A\\b", 1000)]),
        ([("A", 1000), ("A\\b", 900)], [("A\\b", 900)]),
        ([("A", 1000), ("A\\b", 899)], [("A", 1000)]),
        ([("A", 1000), ("A\\b", 910), ("B", 950)], [("B", 950), ("A\\b", 910)]),
        ([("A", 500), ("A\\b\\c", 500)], [("A\\b\\c", 500)]),
        ([("Windows\\Temp2", 50), ("Windows\\Temp", 40)], [("Windows\\Temp2", 50), ("Windows\\Temp", 40)]),
    ],
)
def test_chains(items, want):
    assert [x[:2] for x in timeline.collapsed(items)] == want


def test_chains_pick_in_both_directions():
    assert {x[2] for x in timeline.collapsed([("b\\b\\a", 4), ("b", 4), ("b\\a", 3)])} == {"b\\b\\a", "b\\a"}


def test_children_are_no_siblings(spark):
    rows = [("下载\\安装包\\x", False, 5, None, None), ("下载备份\\y\\z", False, 9, None, None)]
    dirs = tree.rollup(spark.createDataFrame(rows, SCHEMA), 0)
    assert [r.path for r in tree.children(dirs, "下载").collect()] == ["下载\\安装包"]
    assert {r.path for r in tree.children(dirs, "").collect()} == {"下载", "下载备份"}


def test_files_and_buckets(spark):
    now = 1e9
    rows = [("big", False, 9 * MIB, None, 1.0), ("new", False, 2 * MIB, now - 86400, None), ("old", False, 2 * MIB, 1.0, now), ("future", False, 2 * MIB, now * 2, None), ("empty", False, 0, now, None), ("dir", True, 99 * MIB, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.path for r in tree.select_files(df, now).collect()] == ["big", "future", "new"]
    assert [r.path for r in tree.select_files(df, now, cap=1).collect()] == ["big"]
    small = [("a\\b\\c\\f%d" % i, False, 100 * 1024, 1e9, None) for i in range(20)] + [("a\\b\\c\\bad", False, 5 * MIB, 5e9, None), ("x", False, 3 * MIB, 0.0, 1e9)]
    got = {(r.day, r.attribution): (r.bytes, r.files) for r in buckets.age_buckets(spark.createDataFrame(small, SCHEMA)).collect()}
    assert got == {("2001-09-09", ""): (2000 * 1024, 20), ("1970-01-01", "x"): (3 * MIB, 1)}


def test_paths(spark):
    df = spark.createDataFrame([("",), ("a",), ("a\\b",), ("a\\b\\c\\d",), (None,)], "p string")
    got = df.select(P.parent("p"), P.depth("p"), P.attribution("p"), P.basename("p", "C:"), P.ancestors("p"), P.ancestors("p", with_root=False)).collect()
    assert [r[0] for r in got] == [None, "", "a", "a\\b\\c", None]
    assert [r[1] for r in got] == [0, 1, 2, 4, None]
    assert [r[3] for r in got] == ["C:", "a", "b", "d", None]
    assert got[3][2] == "a\\b\\c" and got[3][4] == ["", "a", "a\\b", "a\\b\\c"] and got[1][5] == []
    raw = spark.createDataFrame([("C:/a/b/",), ("c:\\",), ("\\x\\y",), ("C:x",)], "p string").select(P.relative("p")).collect()
    assert [r[0] for r in raw] == ["a\\b", "", "x\\y", "C:x"]
    assert [r[0] for r in spark.createDataFrame([("a", "a\\b"), ("a", "ab"), ("", "a"), ("a", "a")], "a string, p string").select(P.is_ancestor("a", "p")).collect()] == [True, False, True, False]


def test_layout_covers_the_area():
    boxes = treemap.squarified([6, 6, 4, 3, 2, 2, 1], 0, 0, 6, 4)
    assert len(boxes) == 7 and sum(w * h for *_, w, h in boxes) == pytest.approx(24)
    assert boxes[0] == pytest.approx((0, 0, 3, 2)) and boxes[1] == pytest.approx((0, 2, 3, 2))
    assert treemap.squarified([], 0, 0, 1, 1) == [] and treemap.squarified([0], 0, 0, 1, 1) == []


def test_largest_rows_by_classes(spark):
    """Only rows of the sizes that can be among the largest are sorted."""
    from pyspark.sql import functions as F

    rows = spark.range(200_000, numPartitions=20).select(F.concat(F.lit("p"), "id").alias("path"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) + 1).alias("bytes"))
    got = tree.largest(rows, 500)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in rows.orderBy(F.desc("bytes"), "path").limit(500).collect()]
    same = spark.range(100).select(F.format_string("p%03d", "id").alias("path"), F.lit(7).cast("long").alias("bytes"))
    assert [r.path for r in tree.largest(same, 10).collect()] == [f"p{k:03d}" for k in range(10)] and tree.largest(same.limit(0), 5).count() == 0
    classes = F.floor(F.log2(F.col("bytes").cast("double")) * 64)
    least = rows.orderBy(F.desc("bytes")).limit(500).agg(F.min(classes)).first()[0]
    assert rows.where(classes >= least).count() < 20_000  # of 20 x 500 that each task alone would send


def test_layout_folds_what_is_small(spark):
    rows = spark.createDataFrame([("a", f"p{k}", 10 + k) for k in range(30)] + [("b", "q", 5), ("b", "none", 0), (None, "r", 1)], "level string, path string, bytes long")
    got = treemap.layout(rows, "level", 100.0, 50.0, most=4).collect()
    boxes = {(r.level, r.path): r.bytes for r in got}
    assert boxes == {("a", f"p{k}"): 10 + k for k in range(26, 30)} | {("a", None): sum(10 + k for k in range(26)), ("b", "q"): 5, (None, "r"): 1}
    assert all(abs(sum(r.w * r.h for r in got if r.level == level) - 5000) < 1e-6 for level in ("a", "b", None))


def test_json_without_nan_at_any_depth(spark):
    from accretion.plans import api

    schema = "a double, s struct<x:double,y:array<struct<z:float>>>, m map<string,double>, t string"
    fine = [(1.5, (None, [(0.5,), None]), {"k": 2.0}, "NaN"), (None, None, None, None)]
    assert [r.value for r in api.as_json(spark.createDataFrame(fine, schema)).collect()] == ['{"a":1.5,"s":{"x":null,"y":[{"z":0.5},null]},"m":{"k":2.0},"t":"NaN"}', '{"a":null,"s":null,"m":null,"t":null}']
    nan = float("nan")
    for row in ((nan, None, None, ""), (1.0, (nan, None), None, ""), (1.0, (1.0, [(1.0,), (nan,)]), None, ""), (1.0, None, {"k": nan}, "")):
        with pytest.raises(Exception, match="NaN"):
            api.as_json(spark.createDataFrame([row], schema)).collect()
