"""What a worker remembers of a tokeniser: words' ids, in flat arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


class Memo:
    """Ids of words, encoded once while the worker remembers them; past `most` words it starts afresh.

    encode gives how many ids each word has, and all ids in a row. A worker that goes on to another memo forgets the one before."""

    used: Memo | None = None

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 250_000):
        self.encode, self.most = encode, most
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.sizes, self.firsts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def places(self, words: list[str]) -> np.ndarray:
        if Memo.used not in (None, self):
            Memo.used.forget()
        Memo.used = self
        if len(self.place) > self.most:
            self.forget()
        new = list(dict.fromkeys(w for w in words if w not in self.place))
        if new:
            sizes, ids = self.encode(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.firsts = np.concatenate([self.firsts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, ids])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def of(self, words: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids in a row, and where each text's start; text i has words starts[i] to starts[i + 1]."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        coded = words.dictionary_encode()
        at = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        each, firsts = self.sizes[at], self.firsts[at]
        ends = np.concatenate([[0], np.cumsum(each)])
        return self.flat[np.repeat(firsts - ends[:-1], each) + np.arange(int(ends[-1]))], ends[starts]
