"""SimHash near-dedup of whole texts, completed to an exact similarity join.

Texts are near copies if their sets of five-word shingles have a Jaccard similarity of SIMILARITY or more. Fingerprints
within RADIUS bits, which ball hashing finds (simhash_dedup.links_within), are linked first, where their shingle sets are
as similar as that. Few bits are no superset of the similarity, so a prefix filter finds the rest: similar texts share
SIMILARITY of either set and so, in any one order of all shingles, one of the first n - ceil(SIMILARITY * n) + 1 of their
n; no such pair is missed, wherever the texts differ. The order is by the number of blocks that have a shingle, those of
one text alone first; a text with more than a fifth of such shingles has no near copy and proposes nothing.

What a text shares with any other lies among its shared shingles. So texts with the same shared shingles and the same number
of all are one node: they have the same similarity to any text, and to each other if there are several. Only nodes are
compared, and a family of texts that have a passage in common and nothing else is a few nodes, one for each number.

Nodes that meet in a shingle are decided in rounds. In each value, some hubs (those with the fewest shingles of their own:
an original has none) are compared with all that aren't in their component yet; at last all pairs that are still open
are, block against block. A pair is left out only if its texts are linked already, or if its sizes and what each has alone
rule it out, so connected components are those of all pairs of SIMILARITY or more.

Defined results: null texts are empty, and empty texts are copies of each other; texts of fewer words than a shingle are
compared whole; rows are told apart by doc_id and text, a null doc_id is larger than any other; rows that are the same in
both are one; texts may be of any length; columns of other names are ignored, so none can clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import hashing as H
from .components import connected_components
from .simhash_dedup import links_within
from .store import written
from .tokens import LOWER

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 4
BLOCK_BYTES, RANGE_VALUES = 4 << 20, 4_000_000
#: A block of a value's members; blocks are compared with each other, so the results don't depend on it.
MEMBERS = 250
#: Hubs of each value by round.
HUBS = (1, 8)
#: Numbers of blocks from which a shingle counts as more common.
LEVELS = (2, 4, 16)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, A-Z as a-z; where each text's words begin and the last one's end)."""
    data = LOWER[data]
    starts, ends = H.spans_of_words(data, offsets[1:-1])
    return H.hashes_of_words(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The distinct shingles of each text."""
    h, at = word_hashes(data, offsets)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        c = H.prefix(h[a:b])
        out.append(np.unique(H.windows(c, min(size, b - a))) if b > a else np.zeros(0, np.uint64))
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = int(X.member(a, b).sum())
    return both / (len(a) + len(b) - both)


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash of a text's shingles: the bits that more than half of them have set."""
    if not len(shingles):
        return 0
    set_ = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > len(shingles)).view(np.int64)[0])


def set_hash(shingles: np.ndarray) -> int:
    """One hash of a set of hashes."""
    return int((H.mix(shingles).sum(dtype=np.uint64) ^ H.mix(shingles ^ np.uint64(H.BASES[1])).sum(dtype=np.uint64) << np.uint64(1)).view(np.int64))


def row_key() -> Column:
    """What tells rows (doc_id, text) apart."""
    return F.xxhash64("doc_id", "text")


def prefix_size(n: int, least: float) -> int:
    """How many of n shingles, the first in any common order, share one with every set of a similarity of least."""
    return n - math.ceil(least * n - 1e-9) + 1


def judge_levels(blobs: list) -> list[np.ndarray]:
    """For short_cells(): two bits a hash, how many LEVELS its number of blocks reaches."""
    lows = [X.opened(b, np.uint32)[0] for b in blobs]
    found, n = np.unique(np.concatenate(lows), return_counts=True)
    found, n = found[n > 1], n[n > 1]
    level = np.searchsorted(LEVELS, n, side="right").astype(np.uint8)
    out = []
    for x in lows:
        own = np.zeros(len(x), np.uint8)
        known = X.member(x, found)
        own[known] = level[np.searchsorted(found, x[known])]
        out.append(np.stack([own & 1, own >> 1], axis=1).ravel().astype(bool))
    return out


def candidates(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """(id, doc_id, n, shared, own_set, fp, values, shingles) of the rows that may have near copies: their number of shingles, how many other texts have, too, a hash of those, their fingerprint, and the shingles by which they meet."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks, ranges = X.n_blocks(total, BLOCK_BYTES), X.n_ranges(total / 6, RANGE_VALUES)
    by_block = docs.select(X.block_of(blocks, "id").alias("block"), "id", "doc_id", "text").groupBy("block")

    def sets(t: pa.Table) -> list[np.ndarray]:
        return [s for p in H.pieces(t.column("text").combine_chunks()) for s in shingles(*p, shingle)]

    def emit(t: pa.Table) -> pa.Table:
        return H.freed(X.short_cells(t.column("block")[0].as_py(), np.unique(X.short(np.concatenate(sets(t)), ranges))))

    kinds = pa.schema([("id", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("own_set", pa.int64()), ("fp", pa.int64()), ("values", pa.list_(pa.int64())), ("shingles", pa.binary())])

    def meet(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return kinds.empty_table()
        t = t.take(np.unique(t.column("id").to_numpy(), return_index=True)[1])
        found = sets(t)
        keys, at, n = np.unique(X.short(np.concatenate(found), ranges), return_inverse=True, return_counts=True)
        level = X.answers(replies, keys >> np.uint64(32), 2)
        level = level[:, 0] + 2 * level[:, 1].astype(np.int64)
        rank = np.where(level == 0, n > 1, level + 1)[at]
        rows, shared, own_sets, fps, values, a = [], [], [], [], [], 0
        for i, s in enumerate(found):
            r = rank[a : a + len(s)]
            a += len(s)
            alone, first = int((r == 0).sum()), prefix_size(len(s), least)
            if alone >= first:
                continue
            rows.append(i)
            shared.append(len(s) - alone)
            own_sets.append(set_hash(s[r > 0]))
            fps.append(fingerprint(s))
            values.append(s[np.lexsort((s, r))[alone:first]].view(np.int64) if len(s) else np.zeros(1, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))
        t = t.take(pa.array(rows, pa.int64()))
        sizes = pa.array([len(found[i]) for i in rows], pa.int64())
        return H.freed(pa.table([t.column("id"), t.column("doc_id"), sizes, pa.array(shared, pa.int64()), pa.array(own_sets, pa.int64()), pa.array(fps, pa.int64()), lists, pa.array([found[i].tobytes() for i in rows], pa.binary())], schema=kinds))

    replies = X.answered(by_block.applyInArrow(emit, X.CELLS), judge_levels)
    return by_block.cogroup(replies.groupBy("block")).applyInArrow(meet, "id long, doc_id long, n long, shared long, own_set long, fp long, values array<long>, shingles binary")


def open_pair(a: str, b: str, least: float) -> Column:
    """Whether texts a and b (n, shared, root) aren't linked yet and can have a similarity of least.

    What they have in common is at most what either shares with any text, and it is at least least / (1 + least) of both.
    """
    n, m, x, y = (F.col(f"{t}{c}") for c in ("n", "shared") for t in (a, b))
    return (F.col(f"{a}root") != F.col(f"{b}root")) & (F.least(x, y) >= least / (1 + least) * (n + m) - 1e-6)


def links(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def with_hubs(members: DataFrame, hubs: DataFrame, least: float) -> DataFrame:
    """(a, b): the open pairs of hubs and members of a value."""
    met = members.join(hubs.select("value", "hub"), "value")
    return met.where(open_pair("", "hub.", least)).select(*links(F.col("id"), F.col("hub.id"))).distinct()


def common(own: list[np.ndarray], others: list[np.ndarray]):
    """For each of own, how many shingles it shares with each of others."""
    values = np.concatenate([np.zeros(0, np.uint64), *others])
    owner = np.repeat(np.arange(len(others)), [len(x) for x in others])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for x in own:
        low, n = np.searchsorted(values, x), np.searchsorted(values, x, side="right")
        n -= low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        yield np.bincount(owner[at], minlength=len(others))


def all_pairs(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links that connect all open pairs of members of a value with a similarity of least, block against block.

    Blocks bring their shingles (id, shingles) along, so that pairs are decided where they meet and never become rows.
    """
    tasks = members.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("tasks"))
    dealt = members.join(tasks, "value").withColumn("part", F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int")).join(sets, "id")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    dealt = dealt.select("value", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "root", "shingles")

    def linked(t: pa.Table) -> pa.Table:
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        part, ids, root = (t.column(c).to_numpy().copy() for c in ("part", "id", "root"))
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        n = np.array([len(x) for x in own])
        here, there = np.flatnonzero(part == low), np.flatnonzero(part == high)
        a, b = [], []
        for i, both in zip(here.tolist(), common([own[i] for i in here], [own[j] for j in there]), strict=True):
            either = n[i] + n[there] - both
            near = there[(root[there] != root[i]) & ((either == 0) | (both / np.maximum(either, 1) >= least))]
            # what is in one component already needs one link
            for j in near[np.unique(root[near], return_index=True)[1]].tolist():
                a.append(max(ids[i], ids[j]))
                b.append(min(ids[i], ids[j]))
                root[root == root[j]] = root[i]
        return H.freed(pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]))

    return dealt.groupBy("value", "low", "high").applyInArrow(linked, "a long, b long").distinct()


def fingerprint_links(rows: DataFrame) -> DataFrame:
    """(a, b) of rows (id, fp) whose fingerprints are the same or within RADIUS bits, as far as components go."""
    fps = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "fingerprints")
    same = rows.select("id", "fp").join(fps.where("rows > 1").select("fp", "least"), "fp").where("id <> least").select(*links(F.col("id"), F.col("least")))
    one = lambda c: fps.select(F.col("fp").alias(c), F.col("least").alias(f"id_{c}"))
    near = links_within(fps, fps.count(), RADIUS).join(one("a"), "a").join(one("b"), "b").select(*links(F.col("id_a"), F.col("id_b")))
    return same.unionByName(near).distinct()


def components(docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """(id, doc_id, root) of the rows of docs (id, doc_id, text) that are near copies of others; root is one id of the group."""
    every = written(candidates(docs, shingle, least), "candidates")
    # rows of a node are near each other if what they share is enough of it; empty texts are
    near_each_other = (F.col("rows") > 1) & (F.col("shared") >= least * (2 * F.col("n") - F.col("shared")) - 1e-9)
    nodes = every.groupBy("own_set", "n", "shared").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("rows")).withColumn("together", near_each_other)
    nodes = written(nodes, "nodes")
    rows = written(every.join(nodes.select(F.col("node").alias("id")), "id", "left_semi"), "node_rows")
    sets = rows.select("id", "shingles")

    def decide(batches):
        for b in batches:
            a_, b_ = b.column("own_a"), b.column("own_b")
            ok = [similarity(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= least for x, y in zip(a_, b_, strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def held(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("own_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("own_b")), "b")
        return both.select("a", "b", "own_a", "own_b").mapInArrow(decide, "a long, b long")

    def grouped(new: DataFrame, roots: DataFrame | None) -> DataFrame:
        new = written(new, "new_links")
        if roots is not None and new.isEmpty():
            return roots
        known = new if roots is None else new.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))
        return written(connected_components(known), "roots")

    def still_open(members: DataFrame, roots: DataFrame) -> DataFrame:
        """members with their roots, without values of which all are one component."""
        left = members.drop("root", "linked").join(roots, "id", "left")
        left = left.select(*names, F.coalesce("root", "id").alias("root"), F.col("root").isNotNull().alias("linked"))
        still = left.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("value")
        return written(left.join(still, "value", "left_semi"), "members")

    names = ("value", "id", "n", "shared", "own")
    roots = grouped(held(fingerprint_links(rows)), None)
    met = rows.select(F.explode("values").alias("value"), "id", "n", "shared", (1 - F.col("shared") / F.greatest("n", F.lit(1))).alias("own"))
    # most values of a pair or group have the same members: one of them is enough
    other = lambda i: F.bit_xor(F.xxhash64("id", F.lit(i)))
    groups = met.groupBy("value").agg(F.count(F.lit(1)).alias("size"), other(0).alias("x0"), other(1).alias("x1")).where("size > 1").groupBy("size", "x0", "x1").agg(F.min("value").alias("value"))
    members = still_open(met.join(groups.select("value"), "value").select(*names), roots)
    for slots in HUBS:
        if members.isEmpty():
            break
        hubs = written(members.groupBy("value", F.pmod(F.xxhash64("id"), F.lit(slots)).alias("slot")).agg(F.min(F.struct("linked", "own", "id", "n", "shared", "root")).alias("hub")), "hubs")
        roots = grouped(held(with_hubs(members, hubs, least)), roots)
        # a hub's pairs in its value are decided
        members = still_open(members.join(hubs.select("value", F.col("hub.id").alias("id")), ["value", "id"], "left_anti"), roots)
    if not members.isEmpty():
        roots = grouped(all_pairs(members, sets, least), roots)
    of_nodes = nodes.join(roots.withColumnRenamed("id", "node"), "node", "left").select("own_set", "n", "shared", F.coalesce("root", F.when(F.col("together"), F.col("node"))).alias("root")).where("root IS NOT NULL")
    # few nodes have many rows, and Spark splits what it finds to be skewed
    return every.select("id", "doc_id", "own_set", "n", "shared").join(of_nodes, ["own_set", "n", "shared"]).select("id", "root", "doc_id")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def firsts(found: DataFrame) -> DataFrame:
    """(root, doc_id, id): of each group the row with the smallest doc_id."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("first"))
    return first.select("root", F.col("first.doc_id").alias("doc_id"), F.col("first.id").alias("id"))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, root, key) of the rows that are near copies of others: root is the smallest doc_id of the group, key the row_key()."""
    found = written(components(keyed(docs), shingle, least), "groups")
    return found.join(firsts(found).select("root", F.col("doc_id").alias("least")), "root").select("doc_id", F.col("least").alias("root"), F.col("id").alias("key"))


def copies(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """(key) row_key() of the rows that are near copies of one with a smaller doc_id in their group."""
    found = written(components(keyed(docs), shingle, least), "groups")
    return found.join(firsts(found).select("id"), "id", "left_anti").select(F.col("id").alias("key"))
