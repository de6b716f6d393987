"""Packing, quality, extraction, near-dedup by similarity, and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from accretion.llm import hashing, html_extract, near_dedup, packing, quality, tokens
from accretion.llm.store import table, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)


ODD = ["<|ENDOFTEXT|> <|startoftext|>. <|endoftext|>Abc.", "", "  \n", "a", "0", "it's 100% O'Neil <|endoftext|> x<|y", "é.É! ça-va… ＡＢ １２", "x" * 5000, "word. Word, WORD;;; (word) 'word' a.b.c ...", "a b\x1cc\x85d", "é. 5́. ﬁ²", "0 00 0.0 a0a"]


def test_ids_are_the_tokenizers(spark, sf_small):
    texts = ODD + [r.text or "" for r in table(spark, sf_small, "documents").select("text").collect()]
    encoder = tokens.Encoder(tokens.default_path())
    for _ in range(2):  # also with what it remembers
        ids, at, *_ = encoder.texts(*hashing.text_buffers(pa.array(texts)))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("shard_bytes", "broadcast"), [(4 << 20, 1000), (3000, 0)])
def test_packing(spark, monkeypatch, shard_bytes, broadcast):
    monkeypatch.setattr(packing, "BROADCAST_BUCKETS", broadcast)
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(99)}" for _ in range(r.randrange(400)))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(900, None), (901, "big " * 9000), (902, "big " * 9000)]
    got = packing.digest(packing.packed(frame(spark, rows), shard_bytes=shard_bytes)).collect()
    encoder = tokens.Encoder(tokens.default_path())
    want = {d: np.array([*encoder.plain(t or ""), 2], "<u4") for d, t in rows}
    docs, sequences = defaultdict(list), defaultdict(list)
    for x in got:
        docs[x.doc_id].append((x.start, x.length))
        sequences[x.sequence_id].append((x.offset, x.length))
        assert x.doc_tokens == len(want[x.doc_id])
        assert x.ids_crc32 == zlib.crc32(want[x.doc_id][x.start : x.start + x.length].tobytes())
    for d, pieces in docs.items():
        assert [p[0] for p in sorted(pieces)] == np.r_[0, np.cumsum([p[1] for p in sorted(pieces)])][:-1].tolist() and sum(p[1] for p in pieces) == len(want[d])
    assert set(docs) == set(want)
    for pieces in sequences.values():
        total = sum(p[1] for p in pieces)
        assert [p[0] for p in sorted(pieces)] == np.r_[0, np.cumsum([p[1] for p in sorted(pieces)])][:-1].tolist()
        assert total <= 4096 and total & (total - 1) == 0
    assert packing.packed(frame(spark, rows).limit(0)).count() == 0


def test_rows_that_are_all_the_same_are_split(spark):
    """A bucket of rows of one id and text is dealt to several tasks, and no two sequences share a number."""
    rows = frame(spark, [(7, "some words that come again and again")] * 600)
    dealt = packing.sharded(rows.select("doc_id", "text"), 4096)
    assert dealt.select("shard").distinct().count() > 5
    got = packing.packed(rows, length=64, shard_bytes=4096).collect()
    assert sum(x.start == 0 for x in got) == 600
    filled = defaultdict(list)
    for x in got:
        filled[x.sequence_id].append((x.offset, x.length))
    for pieces in filled.values():
        ends = sorted(pieces)
        assert [a for a, _ in ends] == [0, *np.cumsum([n for _, n in ends])[:-1]] and sum(n for _, n in ends) <= 64


def test_packing_takes_neighbours():
    lengths = np.array([100] * 6)
    doc = np.array([0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5])
    term = np.array([0, 1, 2, 3, 4, 5, 2, 3, 0, 1, 4, 5])  # 0 with 4, 1 with 3, 2 with 5
    sequences = packing.fill(lengths, packing.Index(doc, term, np.ones(12, int), 6).neighbours, 200)
    assert [{d for d, *_ in s} for s in sequences[:3]] == [{0, 4}, {1, 3}, {2, 5}]


def plain_bm25(texts, seed):
    """{document: score} of all documents by BM25, term by term."""
    counts = [Counter(t) for t in texts]
    mean = max(1.0, sum(map(len, texts)) / len(texts))
    out = {}
    for d, c in enumerate(counts):
        score = 0.0
        for term in counts[seed]:
            df = sum(term in x for x in counts)
            if df > 1 and term in c:
                idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5))
                score += idf * c[term] * (packing.K1 + 1) / (c[term] + packing.K1 * (1 - packing.B + packing.B * len(texts[d]) / mean))
        out[d] = score
    return out


def plain_fill(lengths, texts, length):
    """Full sequences, one candidate at a time."""
    used, sequences, now, room, rest = set(), [], [], length, None

    def place(d, start):
        nonlocal room
        used.add(d)
        n = min(room, lengths[d] - start)
        now.append((d, start, n))
        room -= n
        return start + n

    while rest is not None or len(used) < len(lengths):
        seed, start = rest or (min(set(range(len(lengths))) - used), 0)
        end = place(seed, start)
        rest = (seed, end) if end < lengths[seed] else None
        if rest is None and room:
            misfit = None
            score = plain_bm25(texts, seed)
            for d in sorted(set(range(len(lengths))) - used, key=lambda d: (-np.float32(score[d]), d)):
                if score[d] <= 0 or not room:
                    break
                if lengths[d] <= room:
                    place(d, 0)
                elif misfit is None:
                    misfit = d
            if room and misfit is not None:
                rest = (misfit, place(misfit, 0))
        if not room:
            sequences.append(now)
            now, room = [], length
    return sequences


def test_retrieval_against_plain_scores(monkeypatch):
    r = random.Random(6)
    for most in (3, 64):
        monkeypatch.setattr(packing, "SORTED", most)
        for _ in range(15):
            texts = [[r.randrange(40) for _ in range(r.randrange(1, 12))] for _ in range(r.randrange(2, 40))]
            pairs = sorted((d, t, n) for d, x in enumerate(texts) for t, n in Counter(x).items())
            names = {t: i for i, t in enumerate(sorted({t for _, t, _ in pairs}))}
            index = packing.Index(np.array([p[0] for p in pairs]), np.array([names[p[1]] for p in pairs]), np.array([p[2] for p in pairs]), len(texts))
            for seed in range(len(texts)):
                want = plain_bm25(texts, seed)
                assert index.scores(seed) == pytest.approx([want[d] for d in range(len(texts))], rel=1e-5)
            lengths = np.array([len(x) + r.randrange(3) for x in texts])
            want = plain_fill(lengths.tolist(), texts, 20)
            assert packing.fill(lengths, index.neighbours, 20)[: len(want)] == want


def test_trees_against_plain_descent():
    r = np.random.RandomState(0)
    x = r.rand(4000, 5).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.grown(x[:3000], y[:3000], trees=20, depth=3)
    got = trees.score(x[3000:])
    assert ((got > 0.5) == y[3000:]).mean() > 0.95
    for row, score in zip(x[3000:3050], got, strict=False):
        margin = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            margin += v[node - len(f)]
        assert score == pytest.approx(1 / (1 + np.exp(-margin)))


def test_growing_against_plain_split_search():
    """Every split of the first trees is the best that trying all splits of a leaf finds, the first of equal ones."""
    r = np.random.RandomState(3)
    x = np.round(r.rand(400, 4), 1).astype(np.float32)  # many ties
    x[:, 3] = x[:, 0]
    y = ((x[:, 0] + x[:, 1] > 1) ^ (r.rand(400) < 0.1)).astype(float)
    rounds, depth = 3, 2
    trees = quality.grown(x, y, trees=rounds, depth=depth)
    margin = np.full(400, trees.base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS)[1:-1]).astype(np.float32)) for f in range(4)]
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        part = {0: np.arange(400)}
        for node in range(2**depth - 1):
            rows, best = part[node], (1e-6, None, None)
            for f in range(4):
                for e in edges[f]:
                    left = x[rows, f] <= e
                    a, b = rows[left], rows[~left]
                    if min(h[a].sum(), h[b].sum()) < quality.LEAST_HESSIAN:
                        continue
                    worth = lambda i: g[i].sum() ** 2 / (h[i].sum() + quality.RIDGE)  # noqa: E731, B023
                    if (gain := worth(a) + worth(b) - worth(rows)) > best[0] + 1e-9:
                        best = (gain, f, e)
            f = best[1]
            assert (trees.feature[t, node], trees.threshold[t, node]) == ((f, best[2]) if f is not None else (0, np.inf))
            right = x[rows, f] > best[2] if f is not None else np.zeros(len(rows), bool)
            part[2 * node + 1], part[2 * node + 2] = rows[~right], rows[right]
        for k, rows in enumerate(part[2**depth - 1 + j] for j in range(2**depth)):
            assert trees.value[t, k] == pytest.approx(-quality.RATE * g[rows].sum() / (h[rows].sum() + quality.RIDGE))
            margin[rows] += trees.value[t, k]


def test_statistics_of_a_text_alone():
    texts = ["", "a", "One two two.\n\nTWO!! ***\n", "é " * 50, "x" * 3000, " \n "]
    together = quality.featured(pa.array(texts))
    alone = np.concatenate([quality.featured(pa.array([t])) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()


def test_quality_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).select("doc_id", "held_out", "score", "predicted").collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.93


def test_quality_odd_rows(spark):
    docs = frame(spark, [(1, None), (None, "x"), (2, "")]).withColumnRenamed("lang", "score")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.score, r.predicted) for r in quality.quality_scores(docs, labels).collect()} == {(1, 0.5, 1), (None, 0.5, 1), (2, 0.5, 1)}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_extraction_on_the_generators_other_pages():
    chain = html_extract.default_chain()
    right = total = 0
    for page, labels in html_extract.labelled_pages(120, seed=99):
        found = html_extract.blocks(page)
        assert len(found) == len(labels)
        got = chain.decode(chain.emissions(html_extract.features(found)).tolist())
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.97


def test_features_read_whole_blocks():
    text = "plain words of a long notice, " * 40
    own = {w: html_extract.features([(text + w, [], None, 0)])[0] for w in ("x", "Copyright", "all Rights Reserved", "Cookie", "subscribe")}
    for w, name in (("Copyright", "copyright"), ("all Rights Reserved", "rights"), ("Cookie", "cookie"), ("subscribe", "click")):
        assert html_extract.PLACE[name] in own[w] and html_extract.PLACE[name] not in own["x"]


def test_learning_ends_where_the_likelihood_does():
    """Numeric gradients of the penalised likelihood, computed path sum by path sum, vanish at what is learned."""
    pages, ridge = html_extract.labelled_pages(6, 3), 0.05
    chain = html_extract.trained(pages, rounds=4000, rate=0.005, ridge=ridge)
    found = [(html_extract.features(html_extract.blocks(p)), labels) for p, labels in pages]
    found = [(f, labels) for f, labels in found if f and len(f) == len(labels)]
    blocks = sum(len(f) for f, _ in found)

    def likelihood():
        total = 0.0
        for rows, labels in found:
            e = [float(chain.weight[r].sum()) for r in rows]
            path = chain.begin[int(labels[0])] + chain.end[int(labels[-1])] + sum(x for x, label in zip(e, labels, strict=True) if label) + sum(chain.step[int(a), int(b)] for a, b in zip(labels, labels[1:], strict=False))
            sums = [chain.begin[0], chain.begin[1] + e[0]]
            for x in e[1:]:
                sums = [np.logaddexp(sums[0] + chain.step[0, k], sums[1] + chain.step[1, k]) + k * x for k in (0, 1)]
            total += path - np.logaddexp(sums[0] + chain.end[0], sums[1] + chain.end[1])
        return total / blocks - ridge / 2 * sum((v**2).sum() for v in (chain.weight, chain.step, chain.begin, chain.end))

    used = sorted({i for rows, _ in found for r in rows for i in r})[:12]
    places = [(chain.weight, i) for i in used] + [(chain.step.reshape(-1), i) for i in range(4)] + [(v, i) for v in (chain.begin, chain.end) for i in (0, 1)]
    for values, i in places:
        ends = []
        for d in (1e-4, -1e-4):
            values[i] += d
            ends.append(likelihood())
            values[i] -= d
        assert abs(ends[0] - ends[1]) / 2e-4 < 4e-3


def test_viterbi_is_the_best_path():
    r = np.random.RandomState(1)
    chain = html_extract.Chain()
    for _ in range(50):
        chain.step, chain.begin, chain.end = r.randn(2, 2), r.randn(2), r.randn(2)
        e = r.randn(r.randint(1, 7))
        total = lambda y, e=e: chain.begin[y[0]] + chain.end[y[-1]] + sum(x for x, s in zip(e, y, strict=True) if s) + sum(chain.step[a, b] for a, b in zip(y, y[1:], strict=False))
        paths = [[k >> i & 1 for i in range(len(e))] for k in range(2 ** len(e))]
        assert total([int(x) for x in chain.decode(e.tolist())]) == pytest.approx(max(map(total, paths)))


def test_extraction_odd_pages(spark):
    pages = [
        (1, None), (2, ""), (3, "<p>never closed <b>bold<br>next"), (4, "plain &lt;text&gt;"), (5, "<!-- open <p>x</p>"), (6, "</p></div><article><p>The first&nbsp;sentence\n of this page\t is here, and it ends.</p>" + "<p>Long text, with a sentence. </p>" * 3000 + "</article>"),
        (7, "<script>if (a<b) {'<p>no</p>'}</script><article><p>yes it is, a sentence here.</p></article>"), (8, "< p <3 & <"),
    ]
    df = spark.createDataFrame([(a, "u", b, "z") for a, b in pages], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extracted(df).collect()}
    assert got[1].text == got[2].text == "" and got[5].text == ""
    assert got[6].text.split("\n")[0] == "The first sentence of this page is here, and it ends." and len(got[6].text.split("\n")) == 3001
    assert got[7].text == "yes it is, a sentence here."
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extracted(df.limit(0)).count() == 0


def jaccard(a, b):
    def sets(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def near_components(rows, least=0.8):
    """{doc_id: smallest doc_id of its group} by all pairs."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, t) in enumerate(rows):
        for e, u in rows[:i]:
            if jaccard(t, u) >= least:
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in rows}


def test_near_groups(spark, monkeypatch):
    r = random.Random(8)
    rows = []
    for i in range(25):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 60, 300]))]
        for j in range(r.randrange(1, 5)):
            rows.append((100 * i + j, " ".join(words)))
            for _ in range(max(1, len(words) // 150)):
                words[r.randrange(len(words))] = "new"
    rows += [(5000, None), (5001, " "), (5002, "One two"), (5003, "oNE  two")]
    want = near_components(rows)
    odd = [*rows, (None, rows[0][1]), rows[0]]
    for members in (20_000, 2):
        monkeypatch.setattr(near_dedup, "MEMBERS", members)
        got = {x.doc_id: x.root for x in near_dedup.near_groups(frame(spark, odd)).collect()}
        assert {d: got.get(d, d) for d in want} == want and got[None] == want[0]
    assert near_dedup.near_groups(frame(spark, rows).limit(0)).count() == 0


def test_near_recall_on_whole_texts(spark, sf_small):
    """Each text whose id is divisible by 20 against all rows."""
    rows = [(r.doc_id, r.text) for r in table(spark, sf_small, "documents").collect()]
    got = {x.doc_id: x.root for x in near_dedup.near_groups(table(spark, sf_small, "documents")).collect()}
    pairs = [(d, e) for d, t in rows if d % 20 == 0 for e, u in rows if e != d and jaccard(t, u) >= 0.8]
    assert pairs and all(got[d] == got[e] for d, e in pairs)


def test_fingerprint_is_the_majority_of_bits():
    r = np.random.RandomState(4)
    for n in (1, 2, 7, 100):
        s = r.randint(0, 2**63, n).astype(np.uint64)
        want = sum(1 << i for i in range(64) if sum(int(x) >> i & 1 for x in s) * 2 > n)
        assert near_dedup.fingerprint(s) % 2**64 == want


def test_near_family_of_the_last(spark):
    r = random.Random(3)
    base = [f"b{r.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in r.sample(range(5, 195), 3):
            words[k] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows.append((60, " ".join(base)))
    assert sum(jaccard(rows[0][1], t) >= 0.8 for _, t in rows[1:-1]) < 20 and all(jaccard(t, rows[-1][1]) >= 0.8 for _, t in rows)
    assert {(x.doc_id, x.root) for x in near_dedup.near_groups(frame(spark, rows)).collect()} == {(i, 0) for i in range(61)}


def test_near_contiguous_edits(spark):
    r = random.Random(4)
    new = lambda n: [f"n{r.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(20):
        n = r.choice([40, 200, 800])
        words, at = new(n), r.randrange(n // 2)
        rows += [(10 * i + j, " ".join(w)) for j, w in enumerate((words, words + new(int((n - 4) * 0.249)), words[:at] + new((n - 4) // 9 - 4) + words[at + (n - 4) // 9 - 4 :], words + new(n // 2)))]
    got = {x.doc_id: x.root for x in near_dedup.near_groups(frame(spark, rows)).collect()}
    texts = dict(rows)
    assert all(jaccard(texts[10 * i], texts[10 * i + j]) >= 0.8 for i in range(20) for j in (1, 2))
    assert got == {10 * i + j: 10 * i for i in range(20) for j in (0, 1, 2)}


def test_near_blocks_of_a_value(spark, monkeypatch):
    """Pairs in different blocks of a value of which no hub is a near copy."""
    r = random.Random(5)
    new = lambda n: [f"n{r.randrange(10**6)}" for _ in range(n)]
    passage, rows = new(60), []
    for i in range(15):
        own = new(60)
        rows += [(i, " ".join(passage + own)), (100 + i, " ".join(passage + own[:-1] + new(1))), (200 + i, " ".join(passage + own + new(1)))]
    for hubs in ((), (1,), (1, 4)):
        monkeypatch.setattr(near_dedup, "MEMBERS", 4)
        monkeypatch.setattr(near_dedup, "HUBS", hubs)
        got = {x.doc_id: x.root for x in near_dedup.near_groups(frame(spark, rows)).collect()}
        assert got == {d: d % 100 for d, _ in rows}


@pytest.mark.parametrize("least_own", [0, 8, 12])
def test_near_texts_that_share_a_passage(spark, monkeypatch, least_own):
    """Texts with one passage and words of their own are a few nodes, with and without links between them."""
    passage = [f"p{k}" for k in range(60)]
    rows = [(i, " ".join(passage + [f"own{i}x{k}" for k in range(least_own + i % 8)])) for i in range(160)]
    rows += [(500 + i, f"alone{i} " * 9) for i in range(5)]
    sizes, keep = {}, near_dedup.written

    def noted(df, name):
        sizes[name] = keep(df, name)
        return sizes[name]

    monkeypatch.setattr(near_dedup, "written", noted)
    got = {x.doc_id: x.root for x in near_dedup.near_groups(frame(spark, rows)).collect()}
    want = near_components(rows)
    groups = Counter(want.values())
    assert got == {d: r for d, r in want.items() if groups[r] > 1}
    assert sizes["candidates"].count() > 100 if least_own < 12 else True
    assert sizes["node_rows"].count() <= 16


def test_near_stage_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (None, c), (None, c + " more"), (None, a + " again")]
    assert sorted(r.text for r in corpus_pipeline.apart(spark, frame(spark, rows), "").collect()) in (sorted([a, b, c]), sorted([a, b, c + " more"]))


def test_pipeline_stages(spark, sf_small):
    import corpus_pipeline

    docs = table(spark, sf_small, "documents")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, docs, sf_small), name)
        assert kept.columns == names and 0 < kept.count() <= docs.count()
        if name == "exact":
            assert kept.select("text").distinct().count() == kept.count() == docs.select("text").distinct().count()
        if name == "benchmark":
            items = [r.text for r in table(spark, sf_small, "benchmark").collect()]
            texts = [r.text for r in kept.select("text").collect()]
            assert not [i for i in items if any(i in (t or "") for t in texts)]
        docs = kept
    final = packing.digest(corpus_pipeline.STAGES[-1][1](spark, docs, sf_small))
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf_small).count() == final.count()


CLASHING = ("keep_id", "group_size", "kept", "text_sha256", "text_key", "near_key", "score", "predicted", "held_out", "fp", "key0", "raw", "h", "shard", "bucket", "id", "root", "a.b")


def test_pipeline_stages_odd_rows(spark, sf_small):
    """Nulls, empty and very long texts, repeated rows and ids, clashing names, empty tables."""
    import corpus_pipeline

    good = [r.text for r in table(spark, sf_small, "documents").where("length(text) > 500").orderBy("doc_id").limit(6).collect()]
    item = table(spark, sf_small, "benchmark").orderBy("item_id").first().text
    long = " ".join(f"{w}{i % 997}" for i, w in enumerate(("river", "stone", "water", "light") * 40_000))
    rows = [(1, good[0]), (1, good[0]), (1, good[1]), (2, good[0]), (None, good[2]), (None, good[2]), (None, None), (3, None), (4, ""), (5, long), (6, long + " end"), (7, "before it " + item + " and after"), (8, good[3])]
    docs = spark.createDataFrame([(d, t, *(f"{c}-{d}" for c in CLASHING)) for d, t in rows], ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in CLASHING)]))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_small)
        assert out.schema == docs.schema
        got = out.collect()
        assert all(r[c] == f"{c}-{r.doc_id}" for r in got for c in CLASHING)
        kept[name] = sorted((r.doc_id or 0, r.text or "") for r in got)
        assert stage(spark, docs.limit(0), sf_small).count() == 0
    every = sorted((d or 0, t or "") for d, t in rows)
    assert set(kept["quality"]) <= set(every)
    assert kept["exact"] == sorted([(1, good[1]), (2, good[0]), (0, good[2]), (4, ""), (5, long), (6, long + " end"), (7, rows[11][1]), (8, good[3])])
    groups = near_components([(i, t) for i, (_, t) in enumerate(rows)])
    texts = {i: t or "" for i, (_, t) in enumerate(rows)}
    assert {t for _, t in kept["near"]} <= set(texts.values()) and len({groups[next(i for i in texts if texts[i] == t)] for _, t in kept["near"]}) == len(set(groups.values())) == len(set(kept["near"]))
    assert kept["benchmark"] == sorted((d, t) for d, t in every if item not in t)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).collect()
    assert Counter(x.doc_id for x in pieces if x.start == 0) == Counter(d for d, _ in rows)


def test_quality_long_texts_and_repeated_ids(spark):
    docs = frame(spark, [(1, "word " * 300_000), (1, "word " * 300_000), (2, "A sentence here."), (2, "Another one, too.")] + [(i, f"Plain text number {i}.") for i in range(3, 60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels, sample=20).collect()
    assert len(got) == 61 and all(0 <= r.score <= 1 for r in got)
