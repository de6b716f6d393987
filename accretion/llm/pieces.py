"""SentencePiece encoding and decoding by a merge-type prefix table.

Merging pieces by score leaves every prefix of a text with one last piece: the only one that ends there and fits the last
piece of what is before it. Two pieces fit if merging their joined text gives just the two, which the merges on either side
of the border tell (Model.fits). So for each end, the automaton's matches are tried from the longest on, the one that fits
goes into the table, and the ids are read off backwards: linear in the text, however long a word is.

No merge crosses two characters that stand together in no piece, so a text falls into units there; units come again and
again, and each one's ids are remembered by the unit itself, in bounded number. Documents are rows of their own: nothing is
shuffled.

Pieces of one score have no order between them, so merging takes the leftmost; the table needs an order. Runs of the space
mark are the only such pieces that a model may have here (others raise ValueError); no piece holds such a run and anything
else, so what of a run is left beside a word is merged by itself, as the library does it.

Defined results: null and empty texts have no ids and decode to the empty text; the space mark U+2581 in a text decodes to
a space, as in the library; rows that repeat a doc_id, or have none, are rows of their own; a text may be of any length; columns
of other names are ignored, so none can clash; an empty table gives an empty one. Models: BPE with byte fallback, no text
normalisation, white space kept and a space put before each text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .tokens import gathered

DEFAULT = "piece_bpe_32k.model"
MARK, END = "▁", 1 << 60
#: Text worked through at a time, and characters of units that a worker remembers before it begins anew.
PIECE, REMEMBERED = 1 << 20, 4_000_000
RESULT = "doc_id long, ids array<int>, decoded string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class Model:
    """A model's pieces, how each is merged, and the automaton that finds them."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        texts = [library.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i)}
        self.ids = {texts[i]: i for i in range(size) if i not in special}
        self.bytes = {int(texts[i][3:-1], 16): i for i in special if library.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("a model with byte fallback is needed")
        self.is_byte = np.zeros(size, bool)
        self.is_byte[list(self.bytes.values())] = True
        # what a piece is when decoded
        plain = {i: t.replace(MARK, " ").encode() for t, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()} | {i: b" \xe2\x81\x87 " for i in special if library.is_unknown(i)}
        self.plain = [plain.get(i, b"") for i in range(size)]
        self.marked = np.array([i in plain and texts[i].startswith(MARK) for i in range(size)])
        self.flat, self.sizes = np.frombuffer(b"".join(self.plain), np.uint8), np.array([len(x) for x in self.plain])
        self.begin = np.cumsum(self.sizes) - self.sizes

        self.score = {i: library.get_score(i) for i in self.ids.values()}
        many = [t for t in self.ids if len(t) > 1]
        order = sorted(many, key=lambda t: (-self.score[self.ids[t]], len(t)))
        tied = {t for a, b in zip(order, order[1:], strict=False) if self.score[self.ids[a]] == self.score[self.ids[b]] for t in (a, b)}
        if any(set(t) != {MARK} for t in tied) or any(MARK in t[1:] and set(t) != {MARK} for t in many):
            raise ValueError("pieces other than runs of the space mark share a score, or hold it inside")
        #: When a piece is made: characters are there at first (-1).
        self.made = {i: -1 for t, i in self.ids.items() if len(t) == 1} | {self.ids[t]: k for k, t in enumerate(order)}
        #: For pieces that merging makes: the two that they are made of.
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.fitting: dict[int, bool] = {}
        runs = {t for t in many if set(t) == {MARK}}
        for t in order:
            if t not in runs:
                at = self.merged(t, but=self.ids[t])
                if len(at) == 2:  # else no merge makes it
                    self.halves[self.ids[t]] = (at[0], at[1])
                    if max(self.made[at[0]], self.made[at[1]]) > self.made[self.ids[t]]:
                        raise ValueError("a piece with a better score than what it is made of")
        for t, i in self.ids.items():  # any two pieces whose joined text is one merge, not only a piece's own halves
            for k in range(1, len(t)) if t not in runs else ():
                if t[:k] in self.ids and t[k:] in self.ids:
                    self.pairs[self.ids[t[:k]], self.ids[t[k:]]] = self.made[i]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            if i in self.halves or len(t) == 1:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        # characters by number, 0 for those of no piece, and which stand together in a piece
        letters = sorted({c for t in self.ids for c in t})
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.together = np.zeros((len(letters) + 1) ** 2, bool)
        self.letters = len(letters) + 1
        for t in many:
            n = self.number[[ord(c) for c in t]].astype(np.int64)
            self.together[n[:-1] * self.letters + n[1:]] = True

    def merged(self, text: str, but: int = -1) -> list[int]:
        """Ids of a text of known characters by merging the best pair, the leftmost of equals, again and again; without the piece but."""
        parts, ends, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))

        def pushed(a: int) -> None:
            b = ends[a]
            if b < len(text) and (i := self.ids.get(parts[a] + parts[b])) is not None and i != but:
                heapq.heappush(waiting, (-self.score[i], a, len(parts[a]), len(parts[b])))

        waiting: list[tuple] = []
        for a in range(len(text)):
            pushed(a)
        while waiting:
            _, a, n, m = heapq.heappop(waiting)
            b = ends[a]
            if len(parts[a]) != n or b >= len(text) or len(parts[b]) != m:
                continue  # one of the two has gone into another merge
            parts[a], parts[b], ends[a] = parts[a] + parts[b], "", ends[b]
            if ends[a] < len(text):
                before[ends[a]] = a
            pushed(a)
            if before[a] >= 0:
                pushed(before[a])
        return [self.ids[p] for p in parts if p]

    def fits(self, x: int, y: int) -> bool:
        """Whether merging the joined text of pieces x and y gives x and y.

        At any moment a piece of x's right edge and one of y's left edge stand at the border. Going back in time, the one made
        last is undone first; had the two that stand there a merge that comes before either is used up, it would have been taken.
        """
        key = x << 32 | y
        known = self.fitting.get(key)
        if known is not None:
            return known
        x_used = y_used = END
        ok = True
        while ok:
            at = self.pairs.get((x, y))
            if at is not None and at < x_used and at <= y_used:  # of equals the left one comes first
                ok = False
            elif self.made[x] < 0 and self.made[y] < 0:
                break
            elif self.made[x] > self.made[y]:
                x_used, x = self.made[x], self.halves[x][1]
            else:
                y_used, y = self.made[y], self.halves[y][0]
        if len(self.fitting) > 2_000_000:
            self.fitting.clear()
        self.fitting[key] = ok
        return ok

    def table(self, unit: str) -> list[int]:
        """Ids of a unit of known characters without a run of space marks: the last piece of every prefix, then backwards."""
        last, wide, done = [-1] * (len(unit) + 1), [0] * (len(unit) + 1), -1
        for end, (i, n) in self.automaton.iter(unit):  # for each end the longest first
            if end != done:
                before = last[end + 1 - n]
                if before < 0 or self.fits(before, i):
                    last[end + 1], wide[end + 1], done = i, n, end
        out, at = [], len(unit)
        while at:
            out.append(last[at])
            at -= wide[at]
        return out[::-1]

    def unit(self, unit: str) -> list[int]:
        """Ids of what no merge leaves."""
        if unit not in self.ids and len(unit) == 1:
            return [self.bytes[b] for b in unit.encode()]
        if not unit.startswith(MARK + MARK):
            return self.table(unit)
        rest = unit.lstrip(MARK)
        word = self.table(MARK + rest)
        loose = len(unit) - len(rest) - 1
        if word[0] == self.ids[MARK]:  # the word took none of the run
            loose, word = loose + 1, word[1:]
        return self.merged(MARK * loose) + word


class Encoder:
    def __init__(self, path: str):
        self.model = Model(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at, self.characters = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last one's end)."""
        if self.characters > REMEMBERED:
            self.forget()
        whole = "".join([MARK + t for t in texts if t]).replace(" ", MARK)
        edges = np.r_[0, np.cumsum([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)]
        number = self.model.number[np.frombuffer(whole.encode("utf-32-le"), np.uint32)].astype(np.int64)
        apart = np.r_[True, ~self.model.together[number[:-1] * self.model.letters + number[1:]]] if len(number) else np.zeros(0, bool)
        apart[edges[edges < len(number)]] = True
        starts = np.flatnonzero(apart)
        units = [whole[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(whole)], strict=True)] if len(starts) else []
        new: list[list[int]] = []
        numbers = list(map(self.known.get, units))
        if None in numbers:
            for u in dict.fromkeys(u for u, i in zip(units, numbers, strict=True) if i is None):
                self.known[u] = len(self.known)
                new.append(self.model.unit(u))
                self.characters += len(u) + 8
            numbers = list(map(self.known.__getitem__, units))
        numbers = np.array(numbers, np.int64)
        if new:
            self.ids = np.concatenate([self.ids, np.array([i for x in new for i in x], np.int32)])
            self.at = np.r_[self.at, self.at[-1] + np.cumsum([len(x) for x in new])]
        sizes = np.diff(self.at)[numbers]
        reach = np.r_[0, np.cumsum(sizes)]
        return gathered(self.ids, self.at[numbers], sizes), reach[np.searchsorted(starts, edges)]

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(UTF-8 of all texts, where each begins and the last one ends)."""
        m = self.model
        sizes = m.sizes[ids]
        data, ends = gathered(m.flat, m.begin[ids], sizes), np.r_[0, np.cumsum(sizes)]
        full = at[:-1] < at[1:]
        first = at[:-1][full]
        first = first[m.marked[ids[first]]]  # the space before the text
        keep = np.ones(len(data), bool)
        keep[ends[first]] = False
        at_bytes = ends[at] - np.searchsorted(ends[first], ends[at], side="left")
        raw = data[keep].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            parts = [self.mended(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            return b"".join(parts), np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]
        return raw, at_bytes

    def mended(self, ids: np.ndarray) -> bytes:
        """One text, some bytes of which are no UTF-8: each of them becomes U+FFFD, as in the library."""
        m, out, run = self.model, [], bytearray()

        def flushed() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode().encode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    n = 1
                at += n
            run.clear()

        for k, i in enumerate(ids.tolist()):
            if m.is_byte[i]:
                run += m.plain[i]
            else:
                flushed()
                out.append(m.plain[i][1:] if k == 0 and m.marked[i] else m.plain[i])
        flushed()
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _strings(raw: bytes, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def sentencepieces(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids (as the library's encode(text)) and decoded (as its decode(ids)) of every row.

    model_path: a file that every executor can open.
    """
    path = model_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            texts, doc_ids, i = batch.column("text"), batch.column("doc_id"), 0
            offsets = H.text_buffers(texts)[1]
            while i < len(texts):
                j = min(len(texts), max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1))
                ids, at = own.encoded(texts.slice(i, j - i).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield H.freed(pa.RecordBatch.from_arrays([doc_ids.slice(i, j - i), lists, _strings(*own.decoded(ids, at))], names=["doc_id", "ids", "decoded"]))
                i = j

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, RESULT)


def digest(result: DataFrame) -> DataFrame:
    comma = F.array_join(F.col("ids").cast("array<string>"), ",")
    return result.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(comma.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
