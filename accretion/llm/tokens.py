"""Token ids of many texts at once with a public tokenizer's file.

Most words of a corpus occur again and again, so distinct words are encoded once and their ids gathered. This gives the
ids of the whole text exactly where the tokenizer drops white space and never joins across it or between an ASCII letter
or digit and the punctuation that ends a word, as is the case for the word-level BPE files. Its normaliser lower-cases,
so words that differ in A-Z alone are one.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from . import hashing as H

DEFAULT = "word_bpe_49k.json"
#: Distinct words that a worker remembers at most, before it begins anew; it holds them in arrays, of about 25 bytes each.
REMEMBERED = 300_000
#: Words that are encoded in one go.
TOGETHER = 512
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[33:127] = True
PUNCTUATION &= ~ALNUM
PUNCTUATION[ord(">")] = False  # it may end a special token


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the punctuation at their ends cut off, as units of their own."""
    if not len(starts):
        return starts, ends
    place = np.where(PUNCTUATION[data], -1, np.arange(len(data)))
    core = np.maximum.accumulate(place)[ends - 1] + 1
    cut = (core > starts) & (core < ends)
    cut[cut] = ALNUM[data[core[cut] - 1]]
    inner = np.sort(core[cut])
    return np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))


class Known:
    """The ids of words by the words' hashes, in flat arrays. When it is full, words that came only once are forgotten."""

    def __init__(self):
        self.hashes, self.at, self.ids, self.again = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool)

    def _set(self, hashes: np.ndarray, ids: np.ndarray, begin: np.ndarray, sizes: np.ndarray, again: np.ndarray) -> None:
        self.hashes, self.at, self.ids, self.again = hashes, np.r_[0, np.cumsum(sizes)], gathered(ids, begin, sizes), again

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ascending hashes, none of them known, and the ids of all, one after another."""
        if not len(hashes):
            return
        if len(self.hashes) + len(hashes) > REMEMBERED:
            keep = np.flatnonzero(self.again)[: max(0, REMEMBERED - len(hashes))]
            self._set(self.hashes[keep], self.ids, self.at[keep], np.diff(self.at)[keep], np.zeros(len(keep), bool))
        all_sizes = np.concatenate([np.diff(self.at), sizes])
        begin = np.concatenate([self.at[:-1], len(self.ids) + np.cumsum(sizes) - sizes])
        all_hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(all_hashes, kind="stable")
        again = np.concatenate([self.again, np.zeros(len(hashes), bool)])[order]
        self._set(all_hashes[order], np.concatenate([self.ids, ids]), begin[order], all_sizes[order], again)


def gathered(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[begin:begin + size] of each, one after another."""
    return flat[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Spark's tasks are what runs in parallel
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known()
        # a digit is a word of its own: it parts the words that are encoded in one go
        self.zero = self.tokenizer.encode("0", add_special_tokens=False).ids

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, text: str) -> np.ndarray:
        return self._encoded([text])[0]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all words, one after another; how many each has)."""
        sizes, place, flat = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)]
        simple = [i for i, w in enumerate(words) if "0" not in w and "<|" not in w] if len(self.zero) == 1 else []
        alone, at = sorted(set(range(len(words))) - set(simple)), 0
        some = [simple[k : k + TOGETHER] for k in range(0, len(simple), TOGETHER)]
        for own, ids in zip(some, self._encoded([" 0 ".join([words[i] for i in x]) for x in some]), strict=True):
            parts = ids == self.zero[0]
            edges = np.r_[-1, np.flatnonzero(parts), len(ids)]
            if len(edges) != len(own) + 1:
                alone += own
                continue
            sizes[own] = np.diff(edges) - 1
            place[own] = at + np.cumsum(sizes[own]) - sizes[own]
            flat.append(ids[~parts])
            at += len(flat[-1])
        for i, ids in zip(alone, self._encoded([words[i] for i in alone]), strict=True):
            sizes[i], place[i] = len(ids), at
            flat.append(ids)
            at += len(ids)
        return gathered(np.concatenate(flat), place, sizes), sizes

    def texts(self, data: np.ndarray, offsets: np.ndarray):
        """(ids of all texts, where each text's begin and the last one's end, units' texts, hashes of the distinct units, ascending, and which of them each unit is)."""
        if b"<|" not in data.tobytes():  # special tokens, which are told by their case
            data = LOWER[data]
        starts, ends = units(data, *H.spans_of_words(data, offsets[1:-1]))
        doc = np.searchsorted(offsets, starts, side="right") - 1
        hashes = H.hashes_of_words(data, starts, ends)
        distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known.hashes, distinct), max(0, len(self.known.hashes) - 1))
        new = np.flatnonzero(self.known.hashes[place] != distinct) if len(self.known.hashes) else np.arange(len(distinct))
        old = np.delete(np.arange(len(distinct)), new)
        raw = data.tobytes()
        own, own_sizes = self.words([raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        flat = np.concatenate([self.known.ids, own])
        sizes, begin = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        sizes[old], begin[old] = self.known.at[place[old] + 1] - self.known.at[place[old]], self.known.at[place[old]]
        sizes[new] = own_sizes
        begin[new] = len(self.known.ids) + np.cumsum(sizes[new]) - sizes[new]
        out = gathered(flat, begin[number], sizes[number])
        self.known.again[place[old]] = True
        self.known.add(distinct[new], own, own_sizes)
        per_doc = np.bincount(doc, weights=sizes[number], minlength=len(offsets) - 1).astype(np.int64)
        return out, np.r_[0, np.cumsum(per_doc)], doc, distinct, number


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
