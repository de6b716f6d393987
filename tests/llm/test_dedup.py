"""Exact, substring, suffix, near and line dedup against their definitions, with odd rows."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from accretion.llm import components, exact_dedup, exchange, line_dedup, simhash_dedup, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=60, words=40):
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(30)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    rows = []
    for i in range(n):
        t = " ".join(r.choice(vocabulary) for _ in range(r.randrange(words)))
        if r.random() < 0.4:
            t += r.choice([" ", "\n", "  \t"]) + passage + " " + r.choice(vocabulary)
        rows.append((i * 3, t))
    rows += [(900, None), (901, ""), (902, "  \n "), (903, rows[4][1]), (904, rows[4][1]), (905, "é " * 300), (906, "a" * 3000), (907, " x y z " + passage), (908, passage.upper())]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, None if d is None else f"s{d % 7}", None) for d, t in rows], SCHEMA)


def test_exact_groups(spark):
    rows = corpus() + [(None, "alone"), (None, None)]
    got = {(r.doc_id, r.text): r for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()}
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    assert len(got) == len(rows)
    for (d, t), r in got.items():
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(own), d == keep)


def test_exact_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(exact_dedup, "SHARD_BITS", 1 << 10)
    rows = corpus(1, 300)
    sizes = Counter(t or "" for _, t in rows)
    assert exact_dedup.exact_dedup(frame(spark, rows)).where("group_size > 1").count() == sum(n for n in sizes.values() if n > 1)


def test_exact_clashing_columns_and_empty(spark):
    df = frame(spark, corpus()).withColumns({"keep_id": F.lit("x"), **{c: F.lit(1) for c in ("h", "shard", "words", "maybe", "salt", "gone", "kept_", "text_key")}})
    got = exact_dedup.exact_dedup(df)
    assert got.count() == df.count() and got.where("h = 1 AND shard = 1 AND words = 1 AND maybe = 1 AND salt = 1").count() == df.count()
    lines = line_dedup.line_dedup(df.withColumn("kept", F.lit(1)))
    assert lines.where("h = 1 AND gone = 1 AND kept = 1 AND text_key = 1 AND salt = 1").count() == df.count()
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_substring(spark, block_bytes):
    rows = corpus(2)
    got = substring_dedup.digest(substring_dedup.substring_dedup(frame(spark, rows), block_bytes=block_bytes)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == substring_dedup.brute_force(rows)


def test_substring_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, text), (5, text), (5, text), (7, text + " more"), (3, None)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect())
    assert got == [(0, 0), (3, 0), (5, 0), (5, 0), (7, 20)]
    assert substring_dedup.substring_dedup(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(("depth", "spread", "digit", "block_bytes", "segment"), [(40, 12, 4, 1 << 20, 1 << 17), (40, 12, 64, 500, 64), (30, 20, 7, 2000, 64)])
def test_suffix(spark, depth, spread, digit, block_bytes, segment):
    rows = corpus(3)
    got = suffix_dedup.digest(suffix_dedup.suffix_dedup(frame(spark, rows), depth, spread, digit, block_bytes, segment)).collect()
    want = {w[0]: w for w in suffix_dedup.brute_force(rows, depth)}
    assert {r.doc_id: (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_suffix_long_texts_of_several_segments(spark):
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = noise(5000)
    rows = [(1, noise(340_000) + passage + noise(60_000)), (2, passage[100:900] + noise(300)), (3, noise(131_072 - 200) + passage[:450] + noise(200_000)), (4, None)]
    got = suffix_dedup.digest(suffix_dedup.suffix_dedup(frame(spark, rows))).collect()
    assert sorted(tuple(x) for x in got) == sorted(suffix_dedup.brute_force(rows))


def test_long_texts(spark):
    """One text of over a megabyte, and its repetition, in every dedup operator."""
    r = random.Random(10)
    long = "\n".join(" ".join(f"w{r.randrange(5000)}" for _ in range(12)) for _ in range(20_000))
    rows = [(1, long), (2, long), (3, "short text")]
    df = frame(spark, rows)
    assert {(x.doc_id, x.kept) for x in exact_dedup.exact_dedup(df).collect()} == {(1, False), (2, True), (3, True)}
    assert {(x.doc_id, x.component_id) for x in simhash_dedup.simhash_dedup(df).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert {(x.doc_id, x.n_removed) for x in substring_dedup.substring_dedup(df).collect()} == {(1, 0), (2, 240_000), (3, 0)}
    assert {(x.doc_id, len(x.kept)) for x in suffix_dedup.suffix_dedup(df).collect()} == {(1, 0), (2, 0), (3, 10)}
    sites = df.withColumn("source", F.col("doc_id").cast("string"))
    assert {(x.doc_id, x.n_removed) for x in line_dedup.line_dedup(sites, min_sites=2).collect()} == {(1, 20_000), (2, 20_000), (3, 0)}


def test_repeated_rows_and_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, "other"), (None, text), (None, text), (None, None), (2, text)]
    df = frame(spark, rows)
    assert sorted((x.doc_id or 0, x.group_size, x.kept) for x in exact_dedup.exact_dedup(df).collect()) == [(0, 1, True), (0, 5, False), (0, 5, False), (1, 1, True), (1, 5, False), (1, 5, False), (2, 5, True)]
    got = simhash_dedup.simhash_dedup(df).collect()
    assert len(got) == 7 and {x.component_id for x in got if x.fp} == {1}
    assert sorted(len(x.kept) for x in suffix_dedup.suffix_dedup(df, 40, 12, 4).collect()) == [0, 0, 0, 0, 0, 0, 5]
    assert line_dedup.line_dedup(df).count() == 7


def test_suffix_empty(spark):
    df = frame(spark, corpus())
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0
    assert suffix_dedup.suffix_dedup(frame(spark, [(1, None), (None, "x")])).count() == 2


def linked(fps, radius):
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("block", [4096, 7])
def test_simhash(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_dedup, "BLOCK_FINGERPRINTS", block)
    r = random.Random(5)
    rows = []
    for i in range(12):
        words = [f"w{r.randrange(500)}" for _ in range(300)]
        for j in range(r.randrange(1, 5)):
            rows.append((100 * i + j, " ".join(words)))
            words[r.randrange(300)] = "new"
    rows += [(5000, None), (5001, " "), (5002, "One two"), (5003, "oNE  two")]
    fps = {d: simhash_dedup.fingerprint((t or "").encode()) for d, t in rows}
    want = linked(fps, 4)
    got = simhash_dedup.digest(simhash_dedup.simhash_dedup(frame(spark, rows))).collect()
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in got} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}
    assert len(set(want.values())) < len(rows)


def test_simhash_hash_is_sparks(spark):
    import xxhash

    assert spark.sql("SELECT xxhash64('one two')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"one two", 42)


def test_simhash_empty(spark):
    assert simhash_dedup.simhash_dedup(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_components(spark):
    r = random.Random(6)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.id: x.root for x in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_lines(spark):
    site = lambda d: f"s{d % 7}"
    rows = [(d, f"own {d}\n common \t\n\nrare\r" if d % 7 < 5 else f"own {d}\n\ncommon") for d in range(30)] + [(100, None), (101, "common")]
    seen = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            seen[line.strip(" \t\r")].add(site(d))
    got = {x.doc_id: x for x in line_dedup.line_dedup(frame(spark, rows), min_sites=5).collect()}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not x.strip(" \t\r") or len(seen[x.strip(" \t\r")]) < 5]
        assert got[d].text == "\n".join(kept)
        assert got[d].n_removed == len(lines) - len(kept)
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_removed"}
    assert line_dedup.line_dedup(frame(spark, rows).limit(0)).count() == 0
    unsited = frame(spark, [(None, "x\ny")] * 9)
    assert {x.text for x in line_dedup.line_dedup(unsited).collect()} == {"x\ny"}


def test_cells_of_ranges_that_are_there():
    """Cells and work go by the ranges that a block's hashes fall in, not by all there are."""
    ranges = 1_000_000
    keys = np.unique(exchange.short(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2), ranges))
    start = time.perf_counter()
    for block in range(50):
        cells = exchange.short_cells(block, keys)
    assert time.perf_counter() - start < 20 and cells.num_rows == len(np.unique(keys >> np.uint64(32))) <= 5000
    flags = exchange.judge_short([b.as_buffer() for b in cells.column("blob")])
    some = np.arange(cells.num_rows) % 3 == 0
    replies = cells.set_column(2, "blob", pa.array([exchange.bits(np.ones(len(f), bool)) for f in flags], pa.binary())).filter(pa.array(some))
    got = exchange.answers(replies, keys >> np.uint64(32))[:, 0]
    assert got.tolist() == np.isin(keys >> np.uint64(32), cells.column("rng").to_numpy()[some]).tolist()
    assert exchange.short_cells(0, keys[:0]).num_rows == 0


def test_bloom_blobs_by_partition(spark, monkeypatch):
    """A filter's bits are put together over many batches, and bits set in different parts count twice."""
    rows = spark.range(4000).select((F.xxhash64(F.col("id") % 3900)).alias("h")).coalesce(1)
    for partial in (1 << 21, 100):
        monkeypatch.setattr(exact_dedup, "PARTIAL", partial)
        words = {r.shard: r.words for r in exact_dedup.bloom(rows, 4, 2).collect()}
        hit = rows.distinct().join(spark.createDataFrame([(k, v) for k, v in words.items()], "shard int, words array<bigint>"), exact_dedup._shard_of(F.col("h"), 4) == F.col("shard")).where(exact_dedup._is_set(F.col("h"), F.col("words"))).count()
        assert 100 <= hit < 200
