"""Ranked search, SentencePiece and conversation repair against their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest

from accretion.llm import conversations, pieces, ranked_search


def ranking(docs, items, most=10):
    """{item: [(rank, doc_id, score)]} by the definition; docs and items: (id, text)."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(w), len(w)) for d, w in ((d, terms(t)) for d, t in docs)]
    n_docs, n_terms = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = {}
    for i, q in asked.items():
        found = []
        for d, bag, n in bags:
            score = 0
            for t, k in q.items():
                if bag[t]:
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    score += k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score:
                found.append((-score, d is None, d or 0, d))
        if found:
            out[i] = [(k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:most])]
    return out


def searched(spark, docs, items, most=10):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = ranked_search.ranked_search(d, spark.createDataFrame(items, "item_id long, text string"), most)
    out = {}
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return out


def test_ranked_odd_rows(spark):
    docs = [(1, "Alpha beta. gamma"), (2, None), (3, ""), (4, "alpha ALPHA alpha"), (5, "Ünï ünï çA"), (5, "Ünï ünï çA"), (None, "beta beta gamma x9"), (7, "beta beta gamma x9"), (8, "--- !!"), (9, "delta " * 30_000 + "alpha")]
    items = [(1, "alpha BETA beta"), (2, None), (3, "nothing here"), (4, "çA-ünï"), (None, "gamma"), (6, "x9"), (6, "delta"), (7, "")]
    want = ranking(docs, items)
    assert searched(spark, docs, items) == want
    assert want[1] and None in want and set(want) == {1, 4, None, 6}
    assert searched(spark, docs[:0] or [(1, None)], items) == {}
    assert searched(spark, docs, [(1, None)]) == {}


@pytest.fixture
def crowded():
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    docs = [(k, " ".join(r.choices(words, weights, k=r.choice([3, 8, 30, 200])))) for k in range(1500)]
    docs += [(2000 + k, docs[5][1]) for k in range(300)]  # one text a sixth of all
    items = [(k, " ".join(r.choices(words, weights, k=r.randrange(1, 9)))) for k in range(25)] + [(50, "w0"), (51, "w0 w1 w2"), (52, "w399 w398 w397"), (53, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("shape", ["tiers", "deep", "groups"])
def test_ranked_levels(spark, crowded, monkeypatch, shape):
    docs, items = crowded
    monkeypatch.setattr(ranked_search, "LEAST_DEEP", {"deep": 1}.get(shape, 40))
    monkeypatch.setattr(ranked_search, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ranked_search, "IMPACT_STEP", 1 << 12)
    if shape == "groups":
        monkeypatch.setattr(ranked_search, "ASKED", 40)
    seen = []
    of_group = ranked_search.of_group
    monkeypatch.setattr(ranked_search, "of_group", lambda *a: seen.append(x := of_group(*a)) or x)
    assert searched(spark, docs, items) == ranking(docs, items)
    levels = sum((Counter(p) for _, p in seen), Counter())
    assert sum(levels.values()) == len(items)
    assert (len(seen) > 1) == (shape == "groups")
    assert levels[0] and levels[ranked_search.TIERS - 1]  # some are proven at once, some fall through


def test_bounds_hold():
    """A tier's postings lie above its residual bound by whole steps, and the last leaves nothing."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    term, step = np.divmod(np.unique(r.integers(0, 50 * ranked_search.STEPS, 4000)), ranked_search.STEPS)
    best = step * ranked_search.IMPACT_STEP + r.integers(0, ranked_search.IMPACT_STEP, len(step))
    b = ranked_search.Bounds(50, pa.table({"term": term, "step": step, "postings": r.integers(1, 400, len(step)), "best": best}), 20_000)
    for k in range(ranked_search.TIERS - 1):
        below = step < b.least[k][term]
        assert (best[below] <= b.residual[k][term[below]]).all()
        assert all(b.residual[k][t] == best[below & (term == t)].max(initial=0) for t in range(50))
    assert (b.least[0] >= b.least[1]).all() and not b.residual[-1].any()


# -- SentencePiece ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def odd_texts():
    r = random.Random(5)
    known = list(pieces.encoder(pieces.default_path()).model.ids)
    single = [p for p in known if len(p) == 1]
    out = ["", " ", "  a", "hello  world\n\n x", "a▁b", "▁▁a", "\x00a", "ｆ你好 \U0001f600", "<s></s><unk> <0x0A>", "x" * 5000, " " * 3000, "ab " * 20_000]
    out += ["".join(r.choices(known, k=r.randint(1, 12))) for _ in range(700)]
    out += ["".join(r.choices("abcdeinrst ▁", k=r.randint(1, 40))) for _ in range(700)]
    out += ["".join(r.choices("abcdeinrst", k=r.randint(1, 400))) for _ in range(60)]
    out += ["".join(r.choices(single, k=r.randint(1, 60))) for _ in range(300)]
    out += ["".join(r.choices("  ▁\n1a", k=r.randint(1, 60))) for _ in range(300)]
    return out + [" " * k + w for k in range(40) for w in ("", "the", "1", "\n", "ñ")]


def test_pieces_as_the_library(library):
    own, texts = pieces.Encoder(pieces.default_path()), odd_texts()
    for some in (texts, texts[::-1], ["", ""], []):
        ids, at = own.encoded(some)
        raw, begins = own.decoded(ids, at)
        want = library.encode(some)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
        assert [raw[a:b].decode() for a, b in zip(begins[:-1], begins[1:], strict=True)] == [library.decode(x) for x in want]


def test_table_as_merging():
    """The prefix table gives what merging pair by pair gives."""
    model, r = pieces.encoder(pieces.default_path()).model, random.Random(2)
    many = [p for p in model.ids if "▁" not in p]
    for _ in range(800):
        text = "".join(r.choices(many, k=r.randint(1, 8)))
        assert model.table(text) == model.merged(text), text
    for _ in range(3000):
        x, y = r.choice(many), r.choice(many)
        both = [model.ids[x], model.ids[y]]
        assert model.fits(*both) == (model.merged(x + y) == both), (x, y)


def test_any_ids_decode(library):
    """Bytes that are no UTF-8, unknown and control pieces decode as in the library."""
    own, r = pieces.encoder(pieces.default_path()), random.Random(4)
    rows = [[r.choice([r.randrange(3, 259), r.randrange(259, 32_000)]) for _ in range(r.randint(0, 9))] for _ in range(400)]
    rows += [[own.model.bytes[b] for b in x] for x in (b"\xe2\x82", b"\xe2\x82\xac", b"\xff\xe2\x82\xac\xc3", b"\xf0\x9f\x98")]
    at = np.r_[0, np.cumsum([len(x) for x in rows])]
    raw, begins = own.decoded(np.array([i for x in rows for i in x], np.int32), at)
    assert [raw[a:b].decode() for a, b in zip(begins[:-1], begins[1:], strict=True)] == [library.decode(x) for x in rows]


def test_sentencepieces(spark, library, monkeypatch):
    texts = [None, *odd_texts()[:200], "same", "same"]
    df = spark.createDataFrame([(k if k else None, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id or 0: r for r in pieces.sentencepieces(df).collect()}
    for k, t in enumerate(texts):
        want = library.encode(t or "")
        assert (got[k].ids, got[k].decoded) == (want, library.decode(want))
    rows = {r.doc_id or 0: r for r in pieces.digest(pieces.sentencepieces(df)).collect()}
    for k, t in enumerate(texts):
        want = library.encode(t or "")
        assert tuple(rows[k])[1:] == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(library.decode(want).encode()).hexdigest())
    assert pieces.sentencepieces(df.limit(0)).count() == 0


def test_units_are_forgotten(library, monkeypatch):
    own = pieces.Encoder(pieces.default_path())
    monkeypatch.setattr(pieces, "REMEMBERED", 500)
    for k in range(20):
        text = " ".join(f"wort{k}{j}ung" for j in range(50))
        assert own.encoded([text])[0].tolist() == library.encode(text)
        assert own.characters < 3000


# -- conversations ------------------------------------------------------------------------------------------------------


def cheapest(codes, insert=5):
    """(cost, audit) by the definition, for codes 4 * initial + fault."""
    following = {0: 2, 1: 2, 2: 3, 3: 2}

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        options = [(0, "")] if i == len(codes) and state in (0, 3) else []
        if inserts < 3:
            options.append((insert, "I", i, following[state], inserts + 1))
        if i < len(codes):
            initial, fault = divmod(codes[i], 4)
            options.append((2, "D", i + 1, state, 0))
            if fault in (0, 3):
                more = 5 * (fault == 3)
                options.append((1 + more, "R", i + 1, following[state], 0))
                if initial == 1 and state == 0:
                    options.append((more, "K", i + 1, 1, 0))
                if initial in (2, 3) and following[state] == initial:
                    options.append((more, "K", i + 1, following[state], 0))
        found = []
        for cost, edit, *then in options:
            rest = best(*then) if then else (0, "")
            if rest:
                found.append((cost + rest[0], edit + rest[1]))
        return min(found, default=None)

    for i in range(len(codes), -1, -1):  # short recursions
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


@pytest.mark.parametrize("insert", [5, 1])  # at 5 an insertion is never among the cheapest
def test_repair_by_definition(monkeypatch, insert):
    monkeypatch.setattr(conversations, "INSERT", insert)
    r = random.Random(7)
    all_codes = [[r.choice([4, 8, 12, 8, 12, 9, 14, 15, 7, 11, 0, 3]) for _ in range(r.choice([0, 1, 2, 3, 5, 8, 13, 40]))] for _ in range(1500)]
    flat, at = np.array([c for x in all_codes for c in x], np.uint8), np.r_[0, np.cumsum([len(x) for x in all_codes])]
    cost, who, edit, _ = conversations.repaired_codes(flat, at)
    for k, codes in enumerate(all_codes):
        assert (int(cost[k]), bytes(edit[who == k].astype(np.uint8)).decode()) == cheapest(codes, insert), codes
    assert bool((edit == ord("I")).any()) == (insert == 1)


def damaged_plain(rows):
    """{conv_id: rows (turn, role, text)} after damage, in order."""
    out = {}
    one = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        own = out.setdefault(conv, [])
        role, text = one(role), one(text)
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            own += [row] * (2 if kind == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, x in out.items()}


def expected(rows):
    out = {}
    for conv, own in damaged_plain(rows).items():
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, codes, counts = set(), [], Counter()
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = 1 if not last else 2 if (role, text) in seen else 3 if last[0] not in ".!?" else 0
            seen.add((role, text))
            counts[fault] += 1
            codes.append(4 * {"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + fault)
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = cheapest(codes)
        lines, left, state = [], iter(own), 0
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit == "D":
                continue
            state = 1 if edit == "K" and row[1][:1] == "s" else {0: 2, 1: 2, 2: 3, 3: 2}[state]
            name = {2: "user", 3: "assistant"}.get(state)
            lines.append(f"{row[1] if edit == 'K' else name}:{row[2] if row else ''}")
        out[conv] = (gaps, counts[1], counts[2], counts[3], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_conversations(spark):
    r = random.Random(11)
    texts = ["Hello there.", "What is it?", "cut off in the", "", "  \t\n", "So!", "x. \x0b", "é…", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, t, r.choice(roles), r.choice(texts)) for c in range(400) for t in range(r.randrange(1, 12))]
    rows += [(500, None, "user", "A."), (500, None, "assistant", "B."), (501, None, "system", "S."), (501, 3, "user", "U."), (501, 9, "assistant", "V."), (502, 5, "user", "one."), (502, 5, "assistant", "two."), (502, 5, "user", "one.")]
    rows += [(None, t, roles[t % 2], f"text {t}.") for t in range(30)]
    rows += [(600, t, roles[t % 2], "same.") for t in range(700)]  # one conversation a fifth of all rows
    rows += [(601, 0, "user", "long " * 50_000 + ".")]
    rows += [(700 + k, 0, "user", "Hi.") for k in range(60)]  # some lose all they have
    df = spark.createDataFrame([(*x, "n") for x in rows], "conv_id long, turn long, role string, text string, seq string")
    got = {x.conv_id: tuple(x)[1:] for x in conversations.digest(df, *conversations.repair(conversations.damaged(df))).collect()}
    want = expected(rows)
    for c in want:
        assert got[c] == want[c], c
    assert set(got) == set(want) and any(not x[6] for x in want.values())
    empty = df.limit(0)
    assert conversations.digest(empty, *conversations.repair(empty)).count() == 0


def test_conversations_across_batches(spark):
    """A conversation of many rows goes on from one batch to the next."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in (1, 2, 3) for t in range(250)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 60)
        got = {x.conv_id: tuple(x)[1:] for x in conversations.digest(df, *conversations.repair(conversations.damaged(df))).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == expected(rows)


def test_texts_and_roles_of_the_result(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi there?"), (1, 3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    _, made, fixed = conversations.repair(df)
    assert (made.where("n = 1").first().audit, made.where("n = 1").first().cost) == ("KKRD", 3)
    assert [(x.role, x.text) for x in sorted(fixed.collect(), key=lambda x: x.place)] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "Hi there?")]
