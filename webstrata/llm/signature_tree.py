"""Signature trees: sets as bitmaps under nodes with OR- and AND-combined bitmaps and size ranges; dual traversal with overlap bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

FAN = 8
#: Pairs that one step of a traversal, or of a comparison, holds at once.
STEP = 100_000
#: Narrowest and widest bitmap.
NARROW, WIDE = 256, 1 << 18
#: Sets of a group that are held against all others before its tree is built; sets that choose one of them.
PIVOTS, VOTERS = 16, 512


class Tree:
    """Levels of nodes over sets in order of size; level 0 is the sets. Node i of a level covers nodes FAN*i to FAN*i+FAN-1 below."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, groups: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        sizes, bits, groups = sizes[self.order], bits[self.order], groups[self.order]
        self.low, self.high, self.any, self.all = [sizes], [sizes], [bits], [bits]
        self.first_group, self.last_group = [groups], [groups]
        while len(self.low[-1]) > 1:
            cut = np.arange(0, len(self.low[-1]), FAN)
            self.low.append(np.minimum.reduceat(self.low[-1], cut))
            self.high.append(np.maximum.reduceat(self.high[-1], cut))
            self.any.append(np.bitwise_or.reduceat(self.any[-1], cut, axis=0))
            self.all.append(np.bitwise_and.reduceat(self.all[-1], cut, axis=0))
            self.first_group.append(np.minimum.reduceat(self.first_group[-1], cut))
            self.last_group.append(np.maximum.reduceat(self.last_group[-1], cut))

    @property
    def top(self) -> int:
        return len(self.low) - 1


def counted(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def possible(a: Tree, i: np.ndarray, la: int, b: Tree, j: np.ndarray, lb: int, percent: int) -> np.ndarray:
    """Whether some set under node i may link to some set under node j.

    A bit that all of i's sets have and none of j's has stands for a word of each
    of i's sets that no set of j holds, so it lowers the overlap by one at least.
    Linking takes 100 * overlap >= percent * union, and sets of different groups.
    """
    low_a, high_a, low_b, high_b = a.low[la][i], a.high[la][i], b.low[lb][j], b.high[lb][j]
    fits = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    fits &= ~((a.first_group[la][i] == a.last_group[la][i]) & (b.first_group[lb][j] == b.last_group[lb][j]) & (a.first_group[la][i] == b.first_group[lb][j]))
    at = np.flatnonzero(fits)
    if len(at):
        x, y = i[at], j[at]
        most = np.minimum(high_a[at] - counted(a.all[la][x] & ~b.any[lb][y]), high_b[at] - counted(b.all[lb][y] & ~a.any[la][x]))
        fits[at] = (100 + percent) * most >= percent * (low_a[at] + low_b[at])
    return fits


def traversed(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index in a, index in b) that no bound rules out, in steps; with a is b each unordered pair once, without pairs of one set with itself."""
    same = a is b
    most = max(1, min(STEP, (1 << 26) // max(1, a.any[0].shape[1] * 8)))
    todo = [(np.zeros(1, np.int64), np.zeros(1, np.int64), a.top, b.top)]
    while todo:
        i, j, la, lb = todo.pop()
        if same:
            ok = i <= j if la or lb else i < j
            i, j = i[ok], j[ok]
        fits = possible(a, i, la, b, j, lb, percent)
        i, j = i[fits], j[fits]
        if not len(i):
            continue
        if la == 0 and lb == 0:
            yield a.order[i], b.order[j]
            continue
        down_a, down_b = la >= lb and la > 0, lb >= la and lb > 0
        per = (FAN if down_a else 1) * (FAN if down_b else 1)
        i, j = np.repeat(i, per), np.repeat(j, per)
        k = np.tile(np.arange(per), len(i) // per)
        if down_a:
            i, la = i * FAN + k % FAN, la - 1
        if down_b:
            j, lb = j * FAN + (k // FAN if down_a else k), lb - 1
        ok = (i < len(a.low[la])) & (j < len(b.low[lb]))
        i, j = i[ok], j[ok]
        for s in range(0, len(i), most):  # bounded memory
            todo.append((i[s : s + most], j[s : s + most], la, lb))


def candidates(a: Tree, b: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a traversal."""
    found = list(traversed(a, b, percent)) or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def width_of(size: int, bits_each: int) -> int:
    """Bits of the bitmap of a set: a power of two, at least bits_each an element within the bounds."""
    return min(WIDE, max(NARROW, 1 << max(0, bits_each * size - 1).bit_length()))


def bitmap_of(elements: np.ndarray, bits_each: int) -> bytes:
    """A set's bitmap. A wider one, halves OR-ed together, is the narrower one."""
    width = width_of(len(elements), bits_each)
    bits = np.zeros(width, np.uint8)
    bits[(elements >> np.uint64(40)).astype(np.int64) % width] = 1
    return np.packbits(bits).tobytes()


class Forest:
    """Which sets are tied to each other."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def labels(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, x: np.ndarray, y: np.ndarray, exact: Callable[[int, int], bool] | None = None) -> int:
        """Ties those pairs that aren't yet and, with exact, that it confirms; returns how many."""
        tied = 0
        for s in range(0, len(x), STEP):
            labels = self.labels()
            a, b = x[s : s + STEP], y[s : s + STEP]
            apart = labels[a] != labels[b]
            for i, j in zip(a[apart].tolist(), b[apart].tolist()):
                p, q = self.root(i), self.root(j)
                if p != q and (exact is None or exact(i, j)):
                    self.parent[max(p, q)] = min(p, q)
                    tied += 1
        return tied


class Signatures:
    """Sizes and bitmaps of many sets, bitmaps of one width together."""

    def __init__(self, sizes: np.ndarray, bitmaps: Sequence[bytes], percent: int):
        self.sizes, self.percent = sizes.astype(np.int64), percent
        self.widths = np.fromiter((8 * len(b) for b in bitmaps), np.int64, len(bitmaps))
        self.place, self.bits = np.zeros(len(bitmaps), np.int64), {}
        for w in np.unique(self.widths):
            own = np.flatnonzero(self.widths == w)
            self.place[own] = np.arange(len(own))
            self.bits[int(w)] = np.frombuffer(b"".join(bitmaps[i] for i in own), np.uint64).reshape(len(own), -1)

    def folded(self, at: np.ndarray, width: int) -> np.ndarray:
        """Bitmaps of sets of one width, folded to a width that isn't larger."""
        own = self.bits[int(self.widths[at[0]])][self.place[at]]
        return own if own.shape[1] * 64 == width else np.bitwise_or.reduce(own.reshape(len(at), -1, width // 64), axis=1)

    def possible(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of sets that sizes and bitmaps don't rule out."""
        ok = 100 * np.minimum(self.sizes[x], self.sizes[y]) >= self.percent * np.maximum(self.sizes[x], self.sizes[y])
        x, y = x[ok], y[ok]
        kinds = self.widths[x] * (WIDE * 2) + self.widths[y]
        kept = np.zeros(len(x), bool)
        for kind in np.unique(kinds):
            v, w = divmod(int(kind), WIDE * 2)
            most = max(1, min(STEP, (1 << 26) // max(v, w)))
            at = np.flatnonzero(kinds == kind)
            for s in range(0, len(at), most):
                k = at[s : s + most]
                a, b = self.folded(x[k], min(v, w)), self.folded(y[k], min(v, w))
                overlap = np.minimum(self.sizes[x[k]] - counted(a & ~b), self.sizes[y[k]] - counted(b & ~a))
                kept[k] = (100 + self.percent) * overlap >= self.percent * (self.sizes[x[k]] + self.sizes[y[k]])
        return x[kept], y[kept]

    def pairs(self, left: np.ndarray, right: np.ndarray | None, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By dual traversal, pairs within left, or between left and right, of different labels that no bound rules out."""
        other = left if right is None else right
        for v in np.unique(self.widths[left]):
            for w in np.unique(self.widths[other]):
                if right is None and w < v:
                    continue
                at, to = left[self.widths[left] == v], other[self.widths[other] == w]
                if 100 * self.sizes[at].max() < self.percent * self.sizes[to].min() or 100 * self.sizes[to].max() < self.percent * self.sizes[at].min():
                    continue
                narrow = int(min(v, w))
                a = Tree(self.sizes[at], self.folded(at, narrow), labels[at])
                b = a if right is None and v == w else Tree(self.sizes[to], self.folded(to, narrow), labels[to])
                for x, y in traversed(a, b, self.percent):
                    yield at[x], to[y]

    def typical(self, at: np.ndarray) -> int:
        """A set with many of the bits that most sets have; any choice is right, this one ties most."""
        widths, n = np.unique(self.widths[at], return_counts=True)
        width = int(widths[n.argmax()])
        own = at[self.widths[at] == width]
        some = self.folded(own[:: max(1, len(own) // VOTERS)], width)
        votes = np.unpackbits(some.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        usual = np.packbits(votes * 2 > len(some)).view(np.uint64)
        return int(own[counted(self.folded(own, width) ^ usual).argmin()])


def all_pairs(firsts: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within each run."""
    i = np.repeat(firsts, runs * runs)
    k = np.arange(len(i)) - np.repeat(np.cumsum(runs * runs) - runs * runs, runs * runs)
    n = np.repeat(runs, runs * runs)
    a, b = k // n, k % n
    ok = a < b
    return i[ok] + a[ok], i[ok] + b[ok]


def tie(sets: Signatures, keys: np.ndarray, codes: np.ndarray, sides: np.ndarray, forest: Forest, exact: Callable[[int, int], bool] | None = None) -> None:
    """Ties in the forest sets (codes) that share a key and aren't ruled out, and that exact confirms.

    Rows of a key with sides 0 and 1 are compared across the sides only.
    """
    by = np.lexsort((codes, sides, keys))
    keys, codes, sides = keys[by], codes[by], sides[by]
    fresh = np.ones(len(by), bool)
    fresh[1:] = (np.diff(keys) != 0) | (np.diff(codes) != 0) | (np.diff(sides) != 0)
    keys, codes, sides = keys[fresh], codes[fresh], sides[fresh]
    firsts = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
    runs = np.diff(np.concatenate([firsts, [len(keys)]]))
    crossed = sides[firsts + runs - 1] > 0
    few = (runs <= 2 * FAN) & ~crossed  # all in two leaf nodes, so its pairs are the traversal
    x, y = all_pairs(firsts[few], runs[few])
    n = np.int64(len(sets.sizes))
    x, y = np.divmod(np.unique(np.minimum(codes[x], codes[y]) * n + np.maximum(codes[x], codes[y])), n)
    forest.join(*sets.possible(x, y), exact)
    for first, count, cross in zip(firsts[~few], runs[~few], crossed[~few]):
        own, side = codes[first : first + count], sides[first : first + count]
        if cross:
            left, right = own[side == 0], own[side == 1]
            if not len(left):
                continue
        else:
            left, right, left_over = own, None, own
            for _ in range(PIVOTS):
                pivot = sets.typical(left_over)
                others = own[own != pivot]
                more = forest.join(*sets.possible(np.full(len(others), pivot), others), exact)
                labels = forest.labels()
                left_over = own[labels[own] != labels[pivot]]
                if len(left_over) < 2 or not more:
                    break
        for x, y in sets.pairs(left, right, forest.labels()):
            forest.join(x, y, exact)
