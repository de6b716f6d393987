"""Lexical retrieval packing.

Documents are dealt into shards of bounded size by a lexical key, the smallest hash of their longer words, so that
documents with words in common are likely to share a shard; the bytes of each key's bucket are counted first, and a
bucket of more than a shard is split by a hash. Each shard has a BM25 inverted index of its own; each seed document asks
it with all of its terms for the unused documents nearest in words, which fill the seed's window of tokens one after
another, as many as it takes. The best neighbour that doesn't fit is cut to fill the window, and what is left of it is the
next seed; a window whose seed has no unused neighbour left goes on with the next document as seed. So only a shard's last
window has room to spare; that one is cut into windows whose lengths are powers of two.

Defined results: null and empty texts are documents of the closing id alone; a null doc_id is kept as one; ties in score
go to the earlier document in the order of (doc_id, text); rows that repeat one id are packed like any others; a text of
any length is cut into as many windows as it needs; columns of other names are ignored, so none can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import hashing as H
from . import tokens
from .store import written

LENGTH, CLOSING_ID = 4096, 2
#: Text of a shard, and of what is encoded at a time.
SHARD_BYTES, PIECE = 2 << 20, 1 << 18
#: Neighbours that are sorted at once; most windows need fewer.
SORTED = 64
#: Buckets of lexical keys for each shard, and the letters of a word that counts for the key.
BUCKETS, KEY_LETTERS = 0.5, 5
#: The buckets' parts, two numbers each, are broadcast up to so many, which spares the texts a shuffle; else they are joined by one.
BROADCAST_BUCKETS = 500_000
#: BM25.
K1, B = 1.2, 0.75
#: Bits of a sequence's number within its shard: more than any task can make.
OWN_BITS = 24
RESULT = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Index:
    """An inverted index of one shard: for each term, documents and BM25 weights; from (document, term, frequency) triples, ascending by document."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, documents: int):
        self.documents = documents
        df = np.bincount(term)
        length = np.bincount(doc, tf, minlength=documents)
        norm = K1 * (1 - B + B * length / max(1.0, length.mean()))
        self.idf = np.log1p((documents - df + 0.5) / (df + 0.5)) * (df > 1)
        self.terms, self.own = term, np.searchsorted(doc, np.arange(documents + 1))
        weight = (self.idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, self.at = doc[order], weight[order], np.r_[0, np.cumsum(df)]

    def scores(self, seed: int) -> np.ndarray:
        """Of each document, by all terms of the seed."""
        terms = self.terms[self.own[seed] : self.own[seed + 1]]
        terms = terms[self.idf[terms] > 0]
        sizes = self.at[terms + 1] - self.at[terms]
        at = np.repeat(self.at[terms] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        return np.bincount(self.doc[at], self.weight[at], minlength=self.documents)

    def neighbours(self, seed: int, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all unused documents that share terms with the seed, ascending; their scores)."""
        score = self.scores(seed)
        score[used] = 0
        score[seed] = 0
        found = np.flatnonzero(score > 0)
        return found, score[found]


def best_first(docs: np.ndarray, score: np.ndarray, still: Callable[[np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
    """docs by falling score: SORTED of them (and those that tie with the last), then the rest, of which still() says who is asked for at that time."""
    first = score >= (np.partition(score, -SORTED)[-SORTED] if len(score) > SORTED else 0.0)
    for some in (lambda: first, lambda: ~first & still(docs)):
        chosen = np.flatnonzero(some())
        yield docs[chosen[np.argsort(-score[chosen], kind="stable")]]


def encoded(encoder: tokens.Encoder, texts) -> tuple[np.ndarray, np.ndarray, Index]:
    """(ids, where each text's begin and the last one's end, index) of a shard's texts, worked through in pieces."""
    ids, sizes, triples, first = [], [], [], 0
    for data, offsets in H.pieces(texts, PIECE):
        own, at, doc, distinct, number = encoder.texts(data, offsets)
        ids.append(own)
        sizes.append(np.diff(at))
        pair, tf = np.unique(doc * len(distinct) + number, return_counts=True)
        doc, number = np.divmod(pair, max(1, len(distinct)))
        triples.append(((doc + first).astype(np.int32), distinct[number], tf.astype(np.int32)))
        first += len(offsets) - 1
    doc, hashes, tf = map(np.concatenate, zip(*triples, strict=True))
    term = np.unique(hashes, return_inverse=True)[1].astype(np.int32)
    return np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(sizes))], Index(doc, term, tf, first)


def fill(lengths: np.ndarray, neighbours, length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length); neighbours(document, used) gives the candidates and their scores."""
    used = np.zeros(len(lengths), bool)
    sequences, now, room, rest, following = [], [], length, None, 0

    def place(doc: int, start: int) -> int:
        """Take what fits; how far the document then is."""
        nonlocal room
        used[doc] = True
        n = min(room, int(lengths[doc]) - start)
        now.append((doc, start, n))
        room -= n
        return start + n

    while True:
        if rest is None:
            while following < len(lengths) and used[following]:
                following += 1
            if following == len(lengths):
                break
            rest = (following, 0)
        seed, start = rest
        end = place(seed, start)
        rest = (seed, end) if end < lengths[seed] else None
        if rest is None and room:
            misfit = None
            # room only shrinks: once there is a misfit, what doesn't fit needn't be sorted
            for docs in best_first(*neighbours(seed, used), lambda docs: lengths[docs] <= (room if misfit is not None else lengths[docs])):
                at = 0
                while room and at < len(docs):
                    fits = lengths[docs[at:]] <= room
                    skipped = int(fits.argmax()) if fits.any() else len(fits)
                    if skipped and misfit is None:
                        misfit = int(docs[at])
                    at += skipped
                    if at < len(docs):
                        place(int(docs[at]), 0)
                        at += 1
            if room and misfit is not None:
                rest = (misfit, place(misfit, 0))
        if not room:
            sequences.append(now)
            now, room = [], length
    left = length - room
    while left:  # the last window: powers of two, the largest first
        size = 1 << (left.bit_length() - 1)
        some, need = [], size
        while need:
            doc, start, n = now.pop(0)
            some.append((doc, start, min(n, need)))
            if n > need:
                now.insert(0, (doc, start + need, n - need))
            need -= min(n, need)
        sequences.append(some)
        left -= size
    return sequences


def key_of(text: Column) -> Column:
    """The smallest hash of a text's words of KEY_LETTERS characters or more."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"\S{{{KEY_LETTERS},}}+"), F.lit(0))
    return F.coalesce(F.array_min(F.transform(words, lambda w: F.xxhash64(w))), F.lit(0))


def sharded(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """(shard, doc_id, text) of docs (doc_id, text): shards hold about shard_bytes, or a longer text."""
    size = F.octet_length("text") + 64
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = X.n_blocks(int(total * BUCKETS), shard_bytes)
    # mixed again, as small hashes are likelier in long texts; written, as keys cost more than rereading the texts
    bucket = F.pmod(F.xxhash64(key_of(F.col("text"))), F.lit(buckets))
    # rows are told apart by a number, so that a bucket of rows that are all the same is split, too
    keyed = written(docs.select("doc_id", "text", bucket.alias("bucket"), size.alias("size"), F.monotonically_increasing_id().alias("row")), "keyed")
    parts = keyed.groupBy("bucket").agg(F.ceil(F.sum("size") / shard_bytes).cast("long").alias("parts"))
    dealt = keyed.join(F.broadcast(parts) if buckets <= BROADCAST_BUCKETS else parts, "bucket")
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    return dealt.select((part * buckets + F.col("bucket")).alias("shard"), "doc_id", "text")


def packed(docs: DataFrame, length: int = LENGTH, closing_id: int = CLOSING_ID, tokenizer_path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces of documents in sequences of at most length tokens: doc_id, start, length, doc_tokens, sequence_id, offset, ids (32-bit little-endian)."""
    path = tokenizer_path or tokens.default_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def pack(t: pa.Table) -> pa.Table:
        shard = t.column("shard")[0].as_py()
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        names = t.column("doc_id").to_pylist()
        ids, at, index = encoded(tokens.encoder(path), t.column("text"))
        lengths = np.diff(at) + 1
        out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
        for k, sequence in enumerate(fill(lengths, index.neighbours, length)):
            offset = 0
            for d, start, n in sequence:
                piece = ids[at[d] + start : min(at[d] + start + n, at[d + 1])]
                if len(piece) < n:
                    piece = np.append(piece, np.uint32(closing_id))
                for name, value in zip(out, (names[d], start, n, int(lengths[d]), (shard << OWN_BITS) + k, offset, piece.astype("<u4").tobytes()), strict=True):
                    out[name].append(value)
                offset += n
        return H.freed(pa.table(out, schema=pa.schema([*((n, pa.int64()) for n in list(out)[:-1]), ("ids", pa.binary())])))

    return sharded(docs, shard_bytes).groupBy("shard").applyInArrow(pack, RESULT)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
