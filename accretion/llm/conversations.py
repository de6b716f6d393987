"""Conversation structure repair by dynamic programming over tensors with time first.

A conversation is in order if its roles' initials are `(s?(ua)+)?`. Each row may be kept (cost 0), given the role user or
assistant (1) or deleted (2; the only way for blank rows and duplicates); empty rows of user or assistant may be inserted
anywhere (5); a truncated row that isn't deleted costs 5 more. Of the cheapest edits the one whose initials (D, I, K, R)
come first in ASCII is taken.

Faults and places are found by windows over each conversation. What the edits depend on is a byte for each row, so a task
reads its sorted conversations as bytes, buckets those that are complete by length (a bucket doubles) and works a bucket
through from the last turn to the first, all conversations at once: `costs[turn, conversation, state]` is the least cost
from there on. Then all conversations are traced forward at once. The edits, a row each, are joined with the rows they are
for; no task gathers a conversation's text. A conversation's bytes and costs (17 a row) are in one task, and so is its
hash in digest(), which takes its rows one after another as they come sorted.

Defined results: null roles and texts are one space; rows without conv_id are one conversation; turns are in ascending order,
null first, and rows of one turn by role and text; rows that repeat are rows of their own (and duplicates); roles count by
their first character, and those with another than s, u or a (or none) can't be kept; texts may be of any length; columns
of other names are ignored, so none can clash; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import written

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after s, after u, after a. What a new user or assistant row leads to from each.
FOLLOWING = np.array([2, 2, 3, 2])
NEVER = 1 << 29
#: Costs that are held at once, of all conversations of a bucket.
MOST_COSTS = 1 << 23


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code (4 * initial + fault; initials: other, s, u, a) and state: the cost of keeping a row, where that leads, and the cost of a new role."""
    keep, to, rerole = np.full((16, 4), NEVER), np.tile(FOLLOWING, (16, 1)), np.full((16, 1), NEVER)
    for initial in range(4):
        for fault, more in ((NO_FAULT, 0), (TRUNCATED, CUT_OFF)):
            code = 4 * initial + fault
            rerole[code] = REROLE + more
            for state in range(4):
                if initial == 1 and state == 0:
                    keep[code, state], to[code, state] = KEEP + more, 1
                elif initial > 1 and FOLLOWING[state] == initial:
                    keep[code, state] = KEEP + more
    return keep.astype(np.int32), to, rerole.astype(np.int32)


KEEPING, KEPT_TO, REROLING = _tables()


def backward(codes: np.ndarray) -> np.ndarray:
    """costs[turn, conversation, state] of codes[turn, conversation]; the last has what the end costs."""
    turns, n = codes.shape
    costs = np.empty((turns + 1, n, 4), np.int32)
    costs[turns] = (0, 2 * INSERT, INSERT, 0)
    for t in range(turns - 1, -1, -1):
        after = costs[t + 1]
        now = np.minimum(after + DELETE, REROLING[codes[t]] + after[:, FOLLOWING])
        np.minimum(now, KEEPING[codes[t]] + np.take_along_axis(after, KEPT_TO[codes[t]], 1), out=now)
        for _ in range(3):
            np.minimum(now, INSERT + now[:, FOLLOWING], out=now)
        costs[t] = now
    return costs


def traced(codes: np.ndarray, costs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(conversation, edit, state after it) of all edits, by conversation and in order; first: each one's first turn."""
    turns = len(codes)
    who, at, state = np.arange(codes.shape[1]), first.copy(), np.zeros(codes.shape[1], np.int64)
    out: list[tuple] = []
    while True:
        going = (at < turns) | (state == 1) | (state == 2)
        who, at, state = who[going], at[going], state[going]
        if not len(who):
            break
        cost, new = costs[at, who, state], FOLLOWING[state]
        inside = at < turns
        following = np.minimum(at + 1, turns)
        code = codes[np.minimum(at, turns - 1), who]
        delete = inside & (DELETE + costs[following, who, state] == cost)
        insert = ~delete & (INSERT + costs[at, who, new] == cost)
        keep = ~delete & ~insert & (KEEPING[code, state] + costs[following, who, KEPT_TO[code, state]] == cost)
        edit = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R"))))
        state = np.where(delete, state, np.where(keep, KEPT_TO[code, state], new))
        at = at + ~insert
        out.append((who, edit, state))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, edit, state = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(who, kind="stable")
    return who[order], edit[order], state[order]


def repaired_codes(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(costs of all conversations, conversation, edit, state) of conversations whose codes are codes[at[i]:at[i + 1]]."""
    lengths, total = np.diff(at), np.zeros(len(at) - 1, np.int64)
    bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
    parts = []
    for b in np.unique(bucket):
        turns = 1 << int(b)
        own, each = np.flatnonzero(bucket == b), max(1, MOST_COSTS // (4 * turns))
        for some in (own[i : i + each] for i in range(0, len(own), each)):
            turns = int(lengths[some].max(initial=0))
            first = turns - lengths[some]  # they end together
            board = np.zeros((turns, len(some)), np.uint8)
            column = np.repeat(np.arange(len(some)), lengths[some])
            place = np.arange(int(lengths[some].sum())) - np.repeat(np.cumsum(lengths[some]) - lengths[some], lengths[some])
            board[place + first[column], column] = codes[np.repeat(at[some], lengths[some]) + place]
            costs = backward(board)
            total[some] = costs[first, np.arange(len(some)), 0]
            who, edit, state = traced(board, costs, first)
            parts.append((some[who], edit, state))
    who, edit, state = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    order = np.argsort(who, kind="stable")
    return total, who[order], edit[order], state[order]


def in_order(*more: Column):
    return Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text", *more)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32 of `conv_id:turn` modulo 20 (a null: one space): 0 drops a row, 1 empties its text, 2 takes its `.!?` out, 3 repeats it, 4 makes its role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("damage")).where("damage <> 0")
    new = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": new, "role": F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))})
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1)))).drop("col")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, seq, fault, initial, illegal) of rows (conv_id, turn, role, text): place from 1, first fault, initial (0: other) and whether it may not follow the row before."""
    role = F.coalesce(F.col("role"), F.lit(" "))
    rows = rows.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    letter = F.left("role", F.lit(1))
    initial = F.when(letter == "s", 1).when(letter == "u", 2).when(letter == "a", 3).otherwise(0)
    before = F.lag("initial").over(in_order())
    fits = F.concat(before.cast("string"), F.col("initial").cast("string")).isin("12", "23", "32")
    # one shuffle: rows of a conversation are together, and so are those that are the same
    rows = rows.withColumn("initial", initial).withColumns({"seq": F.row_number().over(in_order()).cast("long"), "illegal": before.isNotNull() & ~fits})
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("seq")) > 1
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(again, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT)
    return rows.withColumn("fault", fault)


def edits(faulty: DataFrame) -> DataFrame:
    """(conv_id, n, edit, seq, place, role, audit, cost) of what faults() gives: each edit's place, the row it is for (none for I), its place in the repaired conversation (none for D) and its new role (for R and I); a conversation's first edit also has the initials of all and their cost."""
    kind = faulty.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *(T.StructField(c, T.LongType()) for c in ("n", "seq", "place", "cost")), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "audit"))])

    def told(ids: pa.Array, codes: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """Conversations by their first rows' ids and all rows' codes."""
        total, who, edit, state = repaired_codes(codes, at)
        starts = np.searchsorted(who, np.arange(len(at)))
        n = np.arange(len(who)) - starts[who]
        is_row, stays = edit != ord("I"), edit != ord("D")
        count = lambda x: np.cumsum(x) - np.r_[0, np.cumsum(x)][starts[who]]
        role = np.where(state == 2, "user", "assistant")
        letters = edit.astype(np.uint8).tobytes().decode()
        head = np.flatnonzero(n == 0)
        audit, cost = np.full(len(who), None, object), np.zeros(len(who), np.int64)
        audit[head] = [letters[a:b] for a, b in zip(starts[:-1][who[head]].tolist(), starts[1:][who[head]].tolist(), strict=True)]
        cost[head] = total[who[head]]
        columns = [
            ids.take(pa.array(who)), pa.array(n + 1), pa.array(count(is_row), pa.int64(), mask=~is_row), pa.array(count(stays), pa.int64(), mask=~stays), pa.array(cost, pa.int64(), mask=n != 0), pa.array(list(letters), pa.string()),
            pa.array(role.astype(object), pa.string(), mask=(edit == ord("K")) | ~stays), pa.array(audit, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of sorted conversations; the last of a batch may go on in the next."""
        ids, open_codes = None, []
        for batch in batches:
            codes, starts = batch.column("code").to_numpy().astype(np.uint8), np.flatnonzero(batch.column("seq").to_numpy() == 1)
            if not len(starts):
                open_codes.append(codes)
                continue
            new = batch.column("conv_id").take(pa.array(starts))
            whole = np.concatenate([*open_codes, codes[: starts[-1]]])
            shift = sum(map(len, open_codes))
            at = starts + shift if ids is None else np.r_[0, starts + shift]
            if len(at) > 1:
                yield told(pa.concat_arrays([ids, new]) if ids is not None else new, whole, at)
            ids, open_codes = new.slice(len(new) - 1), [codes[starts[-1] :]]
        if ids is not None:
            whole = np.concatenate(open_codes)
            yield told(ids, whole, np.array([0, len(whole)]))

    narrow = faulty.select("conv_id", "seq", (F.col("initial") * 4 + F.col("fault")).alias("code"))
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(run, schema)


def repaired(faulty: DataFrame, made: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of the repaired conversations; made: what edits() gives for faulty."""
    stays = made.where("edit <> 'D'").select("conv_id", "seq", "place", "edit", F.col("role").alias("new_role"))
    rows = faulty.select(F.col("conv_id").alias("own_id"), F.col("seq").alias("own_seq"), F.col("role").alias("own_role"), "text")
    kept = stays.where("seq IS NOT NULL").join(rows, F.col("conv_id").eqNullSafe(F.col("own_id")) & (F.col("seq") == F.col("own_seq")))
    kept = kept.select("conv_id", "place", F.coalesce("new_role", "own_role").alias("role"), "text", "edit")
    return kept.unionByName(stays.where("seq IS NULL").select("conv_id", "place", F.col("new_role").alias("role"), F.lit("").alias("text"), "edit"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what faults() gives, edits, repaired conversations) of rows (conv_id, turn, role, text)."""
    faulty = written(faults(rows), "faults")
    made = written(edits(faulty), "edits")
    return faulty, made, repaired(faulty, made)


def hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `role:text` by place, joined by newlines."""
    schema = T.StructType([T.StructField("conv_id", conversations.schema["conv_id"].dataType), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, own = None, None
        for batch in batches:
            done, ids = [], batch.column("conv_id")
            parts = [] if own is None else [own]
            for k, (place, line) in enumerate(zip(batch.column("place").to_pylist(), batch.column("line").to_pylist(), strict=True)):
                if place == 1:
                    if state is not None:
                        done.append(state.hexdigest())
                    state = hashlib.sha256()
                    parts.append(ids.slice(k, 1))
                else:
                    state.update(b"\n")
                state.update(line.encode())
            known = pa.concat_arrays(parts) if parts else ids.slice(0, 0)
            yield pa.RecordBatch.from_arrays([known.slice(0, len(done)), pa.array(done, pa.string())], names=schema.names)
            own = known.slice(len(known) - 1) if len(known) else None
        if state is not None:
            yield pa.RecordBatch.from_arrays([own, pa.array([state.hexdigest()], pa.string())], names=schema.names)

    lines = conversations.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, schema)


def digest(ids: DataFrame, faulty: DataFrame, made: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of ids: gaps in its turns, faults, edits and their cost, and a hash of the repaired conversation."""
    count = lambda f: F.count_if(F.col("fault") == f)
    spans = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = faulty.groupBy("conv_id").agg(spans.alias("gaps"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"), F.count_if("illegal").alias("illegal"))
    audits = made.where("n = 1").select("conv_id", "cost", "audit")
    out = ids.select("conv_id").distinct()
    for k, part in enumerate((counts, audits, hashes(conversations))):
        own = part.withColumnRenamed("conv_id", f"id{k}")
        out = out.join(own, F.col("conv_id").eqNullSafe(F.col(f"id{k}")), "left").drop(f"id{k}")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
