"""Byte-pair merges of many words at once, on flat arrays, for vocabularies of the tokenizers library with word ends.

A round finds each word's lowest-ranked pair and merges all its occurrences from
the left; words without a pair leave. Words that need the library's Unicode
normaliser, or hold a special token, are encoded by the library itself.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

#: Below this code point, lower-casing is one character to one and text is already composed; U+0130 is the exception.
PLAIN, DOTTED = "ɐ", "İ"
EMPTY = -1


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTable:
    """(left, right) to (rank, merged), by open addressing in arrays."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        size = 1 << (int(len(pairs) * 4).bit_length())
        self.mask = np.int64(size - 1)
        self.keys, self.ranks, self.merged = np.full(size, EMPTY, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        at, ranks, keys = self.slot(pairs), np.arange(len(pairs), dtype=np.int32), pairs
        while len(keys):
            free = self.keys[at] == EMPTY
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.ranks[at[put]], self.merged[at[put]] = keys[put], ranks[put], merged[ranks[put]]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys * np.int64(0x9E3779B97F4A7C1)
        return (x ^ (x >> 29)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place in the table; EMPTY if it isn't there."""
        out = np.full(len(keys), EMPTY, np.int64)
        todo, at = np.arange(len(keys)), self.slot(keys)
        while len(todo):
            there = self.keys[at]
            hit = there == keys[todo]
            out[todo[hit]] = at[hit]
            on = ~hit & (there != EMPTY)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out


class Merges:
    """Ids of words by the vocabulary of a tokenizers file; equal to the library's for every word."""

    def __init__(self, tokenizer):
        import regex

        self.tokenizer = tokenizer
        spec = json.loads(tokenizer.to_str())
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        # what this class reproduces; any other make-up is left to the library
        self.known = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in split] == ["Split", "ByteLevel"]
            and (split[0]["behavior"], split[0]["invert"], split[1]["use_regex"], split[1]["add_prefix_space"]) == ("Removed", True, False, False)
            and all(t["content"].startswith("<|") for t in spec["added_tokens"])
            and (model["type"], model["end_of_word_suffix"], model["dropout"], model["ignore_merges"]) == ("BPE", "</w>", None, False)
        )
        if not self.known:
            return
        pattern = split[0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.ascii_pattern = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        vocabulary, letters = model["vocab"], byte_letters()
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocabulary[letters[b] + "</w>"] for b in range(256)], np.int32)
        self.width = np.int64(len(vocabulary) + len(spec["added_tokens"]))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, both = (np.array([vocabulary[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.table = PairTable(left * self.width + right, both.astype(np.int32))

    def library(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def parts(self, word: str) -> list[str] | None:
        """The tokens that merges stay in; None if the library has to see the word. Unprintable covers controls and odd spaces."""
        if not word.isprintable() or "<|" in word:
            return None
        if word.isascii():
            return self.ascii_pattern.findall(word.lower())
        if max(word) >= PLAIN or DOTTED in word:
            return None
        return self.pattern.findall(word.lower())

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids in a row."""
        parts = [self.parts(w) for w in words] if self.known else [None] * len(words)
        slow = [i for i, ts in enumerate(parts) if ts is None]
        number = {t: i for i, t in enumerate(dict.fromkeys(chain.from_iterable(ts for ts in parts if ts)))}
        flat, sizes = self.merged([t.encode() for t in number])
        if slow:  # each is one more part
            others = self.library([words[i] for i in slow])
            for k, i in enumerate(slow):
                parts[i] = (k,)
                number[k] = len(sizes) + k
            sizes = np.concatenate([sizes, [len(x) for x in others]]).astype(np.int64)
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(others), np.int32)])
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        firsts, each = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        word_ends = ends[np.concatenate([[0], np.cumsum(counts)])]
        return np.diff(word_ends), flat[np.repeat(firsts[at] - ends[:-1], each) + np.arange(int(ends[-1]))]

    def merged(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens in a row, and how many each has."""
        sizes = np.array([len(t) for t in tokens], np.int64)
        if not len(sizes):
            return np.zeros(0, np.int32), sizes
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        ids = self.inner[raw]
        tail = np.cumsum(sizes) - 1
        ids[tail] = self.last[raw[tail]]
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_ids, done_words = [], []
        while len(ids):
            place = np.full(len(ids), EMPTY, np.int64)
            same = np.flatnonzero(word[:-1] == word[1:])
            place[same] = self.table.find(ids[same] * self.width + ids[same + 1])
            rank = np.where(place != EMPTY, self.table.ranks[place], np.iinfo(np.int32).max)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            runs = np.diff(np.concatenate([starts, [len(ids)]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), runs)
            over = best == np.iinfo(np.int32).max
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
            hit = (rank == best) & ~over
            # of occurrences that overlap, every other from the left
            at = np.flatnonzero(hit)
            chain = np.concatenate([[True], np.diff(at) != 1]) if len(at) else np.zeros(0, bool)
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0)) if len(at) else at
            at = at[since % 2 == 0]
            ids = ids.copy()
            ids[at] = self.table.merged[place[at]]
            keep = ~over
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        by = np.argsort(word, kind="stable")
        return ids[by], np.bincount(word, minlength=len(sizes))
