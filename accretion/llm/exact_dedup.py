"""Exact dedup: two Bloom filters find texts that may be repeated; only those rows shuffle.

First pass: every text's hash sets two bits of a filter; a bit that is set a second time is also set in a second filter.
Filters are cut into shards of fixed size by the hash, and partial filters of the input's partitions meet in their
shard. Second pass: a row both of whose bits the second filter has may be repeated; those rows alone are grouped by the
SHA-256 of their text, the rest pass straight through.

The second filter has some bits for each row of the corpus. Where it is too large to broadcast, hashes alone (no texts)
meet its shards, and a smaller filter is made of those that may be repeated; it has bits for each repeated text only. Where
even that is too large, rows are joined with its shards by a shuffle.

Defined results: null texts equal the empty text; of equal texts the row with the largest doc_id stays (a null doc_id is
smaller than any; of rows that tie, both report the same keep_id and the flag is true for each row with that id); texts
may be of any length; columns of docs named like the four results are dropped, all others stay, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .store import free_names, written

#: Bits of a shard, and of the filter for each row.
SHARD_BITS, BITS_A_ROW = 1 << 18, 16
#: Rows whose bits are put together before they are sent.
PARTIAL = 1 << 21
#: A filter is broadcast up to so many bytes (it has BITS_A_ROW / 8 a row).
BROADCAST_BYTES = 32 << 20
#: Groups of more rows than LARGE, and than the MOST_LARGE-th part of all, are told which row stays by a broadcast: at most MOST_LARGE groups.
LARGE, MOST_LARGE = 1000, 10_000
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def _shards(rows: int) -> int:
    return max(1, math.ceil(rows * BITS_A_ROW / SHARD_BITS))


def _shard_of(h: Column, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 40), F.lit(shards)).cast("int")


def _is_set(h: Column, words: Column) -> Column:
    """Whether a shard's words have both bits of h."""

    def one(k: int) -> Column:
        bit = F.pmod(F.shiftright(h, 20 * k), F.lit(SHARD_BITS))
        return F.getbit(F.element_at(words, (F.shiftright(bit, 6) + 1).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1

    return F.coalesce(one(0) & one(1), F.lit(False))


def bloom(hashes: DataFrame, shards: int, least: int) -> DataFrame:
    """(shard, words array<long>): the bits that at least one or (least = 2) two rows of hashes (h) have set."""

    def sent(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The bits of some rows, a blob for each shard that has any."""
        shard = ((h >> np.uint64(40)) % np.uint64(shards)) << np.uint64(32)
        once = [shard | ((h >> np.uint64(20 * k)) % np.uint64(SHARD_BITS)) for k in (0, 1)]
        once = np.concatenate([once[0], once[1][once[0] != once[1]]])
        slots, n = np.unique(once, return_counts=True)
        for slots, twice in ((slots, False), (slots[n > 1], True)):
            own, at = X.runs(slots >> np.uint64(32))
            blobs = [X.sealed((slots[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([twice] * len(own), pa.bool_()), pa.array(blobs, pa.binary())], names=["shard", "twice", "blob"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A filter for each PARTIAL rows of a partition: a batch alone would send more blobs than it has rows."""
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("h").to_numpy().view(np.uint64))
            n += len(held[-1])
            if n >= PARTIAL:
                yield from sent(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from sent(np.concatenate(held))

    def merged(t: pa.Table) -> pa.Table:
        once, twice = np.zeros(SHARD_BITS, bool), np.zeros(SHARD_BITS, bool)
        for again, blob in zip(t.column("twice").to_pylist(), t.column("blob"), strict=True):
            at = X.opened(blob.as_buffer(), np.uint32)[0]
            if again:
                twice[at] = True
            else:
                twice[at[once[at]]] = True
                once[at] = True
        words = np.packbits(twice if least > 1 else once, bitorder="little").view(np.int64)
        return pa.table([pa.array([t.column("shard")[0].as_py()], pa.int32()), pa.array([words.tolist()], pa.list_(pa.int64()))], names=["shard", "words"])

    return hashes.mapInArrow(partial, "shard int, twice boolean, blob binary").groupBy("shard").applyInArrow(merged, "shard int, words array<bigint>")


def exact_dedup(docs: DataFrame, normalised: Column | None = None) -> DataFrame:
    """One row for each row of docs, with its columns and keep_id, group_size, kept, text_sha256.

    normalised: the text's column expression if not the text as it is.
    """
    docs = docs.drop(*RESULTS)
    names = docs.columns
    h, shard, words, maybe = free_names(names, "h", "shard", "words", "maybe")
    text = F.coalesce(F.col("text") if normalised is None else normalised, F.lit(""))
    hashed = docs.withColumn(h, F.xxhash64(text))
    alone_hashes = hashed.select(F.col(h).alias("h"))
    rows = docs.count()
    shards = _shards(rows)
    found = bloom(alone_hashes, shards, 2)
    if shards * SHARD_BITS // 8 > BROADCAST_BYTES:
        again = alone_hashes.withColumn("shard", _shard_of(F.col("h"), shards)).join(found, "shard").where(_is_set(F.col("h"), F.col("words"))).select("h").distinct()
        again = written(again, "repeated")
        shards = _shards(again.count())
        found = bloom(again, shards, 1)
    if shards * SHARD_BITS // 8 <= BROADCAST_BYTES:
        found = F.broadcast(found)
    probed = hashed.withColumn(shard, _shard_of(F.col(h), shards)).join(found.toDF(shard, words), shard, "left").withColumn(maybe, _is_set(F.col(h), F.col(words)))
    probed = probed.select(*names, maybe, F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    alone = probed.where(~F.col(maybe)).select(*names, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    repeated = probed.where(maybe).drop(maybe)
    groups = repeated.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # a large group's rows don't meet: at most MOST_LARGE groups are as large as that
    is_large = F.col("group_size") > max(LARGE, rows // MOST_LARGE)
    large = F.broadcast(groups.where(is_large))
    told = repeated.join(large, "text_sha256").unionByName(repeated.join(large.select("text_sha256"), "text_sha256", "left_anti").join(groups.where(~is_large), "text_sha256"))
    return alone.unionByName(told.select(*names, "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
