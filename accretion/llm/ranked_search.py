"""Ranked lexical search over a tiered index: high-impact postings first, lower tiers only where a proof is missing.

Documents are scanned once into blocks, a row each: the block's documents, their lengths and the postings of every term that
an item asks for. A posting's impact is what it adds to a score for each unit of its term's weight. Counts of impacts by
term give each term's tiers: the first holds its postings of highest impact (all of them, if they are few), the next ones
those of lower impact, the last the rest. Each tier is a few columns of the block's row, so a search that ends in a tier
reads no column of those below.

Level by level, each block scores its documents by the tiers down to there. That is a lower bound; what a term's postings
below could add at most (its residual bound) gives an upper one. If the tenth lower bound of an item is above what its terms'
residual bounds add up to, no document unseen so far can be among its ten best: the item is proven, and only documents
whose upper bound reaches the tenth lower one are scored in full. All other items fall to the next level; the last leaves
nothing out, so that what it ranks is exact.

Blocks are bounded in rows and text, a document's postings lie in one block, and a task passes on at most the best `most`
documents of each item and block, so no term, however common, and no item meets in one task. Items go in groups whose terms
have a fixed bound; only these terms' counts and weights come to the driver and go to the tasks. Terms are told by 64 bits of hash.

Defined results: null texts have no terms; items without terms, or whose terms no document has, find nothing; documents
without any term don't count; rows that repeat a doc_id are documents of their own, a null doc_id comes last among equal scores;
rows of one item_id (null included) are one item; a text may be of any length; columns of other names are ignored, so none
can clash; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hashing as H
from .store import written

MOST = 10
#: Documents of a block, and their text.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Postings of a term in the tiers before the last: at least so many, and at least this share of all documents.
LEAST_DEEP, DEPTHS = 1024, (1 / 64, 1 / 8)
TIERS = len(DEPTHS) + 1
#: Impacts are below a million; tiers begin and end at multiples of this.
IMPACT_STEP = 1 << 12
STEPS = 1_000_000 // IMPACT_STEP + 1
#: Terms and (item, term) pairs of a group of items, which come to the driver and go to every task.
ASKED = 500_000
NO_ID = np.iinfo(np.int64).max
#: Bytes that terms are made of (letters and digits, and all beyond ASCII).
TERM = np.zeros(256, bool)
TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCKS = "n_docs long, n_terms long, ids array<long>, lengths array<int>, doc array<int>, term array<int>, tf array<int>"


def one_list(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A column of one row that holds x."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which text each term is in, its hash) of texts data[offsets[i]:offsets[i + 1]], in order."""
    inside = TERM[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begins)
    return np.searchsorted(offsets, starts, side="right") - 1, H.hashes_of_words(LOWER[data], starts, np.flatnonzero(ends) + 1)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats) of items (item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for data, offsets in H.pieces(batch.column("text"), BLOCK_BYTES):
                own, hashes = terms_of(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(own + at)), pa.array(hashes.view(np.int64))], names=["item_id", "term"])
                at += len(offsets) - 1

    found = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"item_id {kind}, term long")
    return found.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


class Asked:
    """The terms of a group of items, ascending, and each item's."""

    def __init__(self, rows: pa.Table):
        number, term = rows.column("number").to_numpy(), rows.column("term").to_numpy().view(np.uint64)
        self.terms, own = np.unique(term, return_inverse=True)
        order = np.argsort(number, kind="stable")
        self.number, self.own, self.repeats = number[order], own[order], rows.column("repeats").to_numpy()[order]

    def items(self, weights: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(item, its terms, weights times repeats)."""
        cuts = np.flatnonzero(np.r_[True, self.number[1:] != self.number[:-1]]) if len(self.number) else np.zeros(0, int)
        parts = zip(np.split(self.own, cuts[1:]), np.split(self.repeats, cuts[1:]), strict=True)
        return [(int(self.number[c]), t, weights[t] * r) for c, (t, r) in zip(cuts, parts, strict=True)]


def scanned(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """BLOCKS of docs (doc_id, text), with the postings of terms asked (ascending hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").fill_null(NO_ID).to_numpy(), batch.column("text")
            for i in range(0, len(texts), BLOCK_ROWS):
                at = i
                for data, offsets in H.pieces(texts.slice(i, BLOCK_ROWS), BLOCK_BYTES):
                    n = len(offsets) - 1
                    doc, hashes = terms_of(data, offsets)
                    lengths = np.bincount(doc, minlength=n)
                    place = np.minimum(np.searchsorted(asked, hashes), max(0, len(asked) - 1))
                    known = asked[place] == hashes if len(asked) else np.zeros(len(hashes), bool)
                    # by term and then by document
                    pairs, tf = np.unique(place[known].astype(np.int64) * n + doc[known], return_counts=True)
                    term, doc = np.divmod(pairs, n)
                    lists = [one_list(ids[at : at + n], pa.int64()), *(one_list(x, pa.int32()) for x in (lengths, doc, term, tf))]
                    yield H.freed(pa.RecordBatch.from_arrays([pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), *lists], names=["n_docs", "n_terms", "ids", "lengths", "doc", "term", "tf"]))
                    at += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, BLOCKS)


def impacts(lengths: np.ndarray, tf: np.ndarray, doc: np.ndarray, documents: int, terms: int) -> np.ndarray:
    m = 100 - 75 + (75 * lengths.astype(np.int64) * documents) // terms
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])


def _column(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy()


def histogram(blocks: DataFrame, documents: int, terms: int) -> DataFrame:
    """(term, step, postings, best): postings of each term and step of impact, and the highest impact among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                term, doc = _column(batch, "term", k), _column(batch, "doc", k)
                impact = impacts(_column(batch, "lengths", k), _column(batch, "tf", k), doc, documents, terms)
                slot = term.astype(np.int64) * STEPS + impact // IMPACT_STEP
                order = np.lexsort((impact, slot))
                last = np.flatnonzero(np.r_[slot[order][1:] != slot[order][:-1], len(slot) > 0])
                slots, best = slot[order][last], impact[order][last]
                yield pa.RecordBatch.from_arrays([pa.array((slots // STEPS).astype(np.int32)), pa.array((slots % STEPS).astype(np.int32)), pa.array(np.diff(np.r_[-1, last])), pa.array(best)], names=["term", "step", "postings", "best"])

    found = blocks.select("lengths", "doc", "term", "tf").mapInArrow(run, "term int, step int, postings long, best long")
    return found.groupBy("term", "step").agg(F.sum("postings").alias("postings"), F.max("best").alias("best"))


class Bounds:
    """Of each asked term: its weight, the least step of impact of every tier but the last, and the residual bound after each tier."""

    def __init__(self, terms: int, counts: pa.Table, documents: int):
        term, step, postings, best = (counts.column(c).to_numpy() for c in ("term", "step", "postings", "best"))
        df = np.bincount(term, postings, minlength=terms)
        self.weights = np.floor(1000 * np.log((2.0 * documents + 2) / (2 * df + 1))).astype(np.int64)
        order = np.lexsort((-step, term))
        term, step, postings, best = term[order], step[order], postings[order], best[order]
        sums = np.cumsum(postings)
        first = np.searchsorted(term, np.arange(terms))
        higher = sums - postings - np.r_[0, sums][first][term]  # postings of higher steps
        self.least, self.residual = np.full((TIERS - 1, terms), STEPS, np.int64), np.zeros((TIERS, terms), np.int64)
        for k, share in enumerate(DEPTHS):
            inside = higher < max(LEAST_DEEP, share * documents)
            np.minimum.at(self.least[k], term[inside], step[inside])
            np.maximum.at(self.residual[k], term[~inside], best[~inside])


def index(blocks: DataFrame, bounds: Bounds, documents: int, terms: int) -> DataFrame:
    """The tiered index: ids, and for each tier doc{k}, term{k}, impact{k} by term."""
    names = [f"{c}{k}" for k in range(TIERS) for c in ("doc", "term", "impact")]
    least = bounds.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc, term = _column(batch, "doc", row), _column(batch, "term", row)
                impact = impacts(_column(batch, "lengths", row), _column(batch, "tf", row), doc, documents, terms)
                tier = (impact // IMPACT_STEP < least[:, term]).sum(axis=0)
                lists = [one_list(x[tier == k], pa.int32()) for k in range(TIERS) for x in (doc, term, impact)]
                yield H.freed(pa.RecordBatch.from_arrays([batch.column("ids").slice(row, 1), *lists], names=["ids", *names]))

    return blocks.select("ids", "lengths", "doc", "term", "tf").mapInArrow(run, "ids array<long>, " + ", ".join(f"{n} array<int>" for n in names))


class Postings:
    """The postings of one block down to some tier, by tier and term."""

    def __init__(self, batch: pa.RecordBatch, row: int, tiers: range):
        self.tiers = [[_column(batch, f"{c}{k}", row) for c in ("doc", "term", "impact")] for k in tiers]

    def scores(self, terms: np.ndarray, weights: np.ndarray, n: int, residual: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(score of each of n documents by these tiers, what its own postings take off the sum of residual bounds)."""
        low, off = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for doc, term, impact in self.tiers:
            begin, end = np.searchsorted(term, terms), np.searchsorted(term, terms, side="right")
            for t, w, a, b in zip(terms.tolist(), weights.tolist(), begin.tolist(), end.tolist(), strict=True):
                if a < b:  # a term has a document once
                    low[doc[a:b]] += w * impact[a:b].astype(np.int64)
                    if residual is not None:
                        off[doc[a:b]] += w * int(residual[t])
        return low, off


def best(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores above 0, equal ones by id."""
    found = np.flatnonzero(score > 0)
    if len(found) > most:
        found = found[score[found] >= np.partition(score[found], -most)[-most]]
    return found[np.lexsort((ids[found], -score[found]))][:most]


def level(table: DataFrame, items: list, residual: np.ndarray | None, tiers: int, most: int, floors: dict[int, int] | None = None) -> DataFrame:
    """(number, doc_id, score): each block's best documents of each item by its first tiers.

    floors: for proven items the tenth lower bound; documents whose upper bound reaches it are scored by all tiers.
    """
    names = [f"{c}{k}" for k in range(TIERS if floors is not None else tiers) for c in ("doc", "term", "impact")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, numbers, docs, scores = _column(batch, "ids", row), [], [], []
                upper = Postings(batch, row, range(tiers))
                lower = Postings(batch, row, range(tiers, TIERS)) if floors is not None else None
                for number, terms, weights in items:
                    score, off = upper.scores(terms, weights, len(ids), residual if floors is not None else None)
                    if floors is not None:
                        bound = score + int((weights * residual[terms]).sum()) - off
                        reach = (bound >= floors[number]) & (score > 0)
                        if not reach.any():
                            continue
                        score = np.where(reach, score + lower.scores(terms, weights, len(ids))[0], 0)
                    own = best(score, ids, most)
                    numbers.append(np.full(len(own), number, np.int64))
                    docs.append(ids[own])
                    scores.append(score[own])
                if numbers:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (numbers, docs, scores)], names=["number", "doc_id", "score"])

    return table.select("ids", *names).mapInArrow(run, "number long, doc_id long, score long")


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The best of all blocks, with rank; Spark keeps each task's best before it shuffles."""
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def of_group(docs: DataFrame, rows: pa.Table, most: int) -> tuple[DataFrame | None, dict[int, int]]:
    """((number, doc_id, score, rank) of a group of items, {level: items proven there}); rows: number, term, repeats."""
    asked = Asked(rows)
    blocks = written(scanned(docs, asked.terms), "blocks")
    documents, terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    if not documents:
        return None, {}
    # at most STEPS rows for each asked term
    bounds = Bounds(len(asked.terms), histogram(blocks, documents, terms).toArrow(), documents)
    table = written(index(blocks, bounds, documents, terms), "index")
    left, out, proven = asked.items(bounds.weights), None, {}
    for k in range(TIERS):
        if not left:
            break
        residual = bounds.residual[k]
        done, floors = left, None
        if k + 1 < TIERS:
            tenth = {r["number"]: r["score"] for r in ranked(level(table, left, None, k + 1, most), most).where(F.col("rank") == most).collect()}  # a row an item
            floors = {n: tenth[n] for n, t, w in left if tenth.get(n, 0) > int((w * residual[t]).sum())}
            done = [x for x in left if x[0] in floors]
            left = [x for x in left if x[0] not in floors]
        if done:
            found = ranked(level(table, done, residual, k + 1, most, floors), most)
            out = found if out is None else out.unionByName(found)
        proven[k] = len(done)
    return out, proven


def ranked_search(docs: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item."""
    spark = docs.sparkSession
    asked = item_terms(items)
    # numbers for items, ascending with groups of bounded size
    sizes = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("terms"))
    sizes = written(sizes.withColumn("number", F.monotonically_increasing_id()), "items")
    total = sizes.agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0]
    groups = -(-total // ASKED)
    asked = asked.join(sizes.select(F.col("item_id").alias("own_id"), "number"), F.col("item_id").eqNullSafe(F.col("own_id"))).select("number", "term", "repeats")
    asked = written(asked.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(max(1, groups)))), "asked")
    out = spark.createDataFrame([], "number long, doc_id long, score long, rank int")
    for part in range(groups):
        found, _ = of_group(docs, asked.where(F.col("part") == part).drop("part").toArrow(), most)
        out = out if found is None else out.unionByName(found)
    out = out.join(sizes.select("number", "item_id"), "number")
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")


ORACLE = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
    a AS (SELECT count(*) FILTER (len(t) > 0)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
    p AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
    f AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM p GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY term, n_docs),
    q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    qt AS (SELECT item_id, term, count(*)::BIGINT AS q FROM q GROUP BY ALL),
    s AS (SELECT item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
          FROM qt JOIN f USING (term) JOIN w USING (term), a GROUP BY item_id, r, doc_id),
    k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {MOST}"""
