"""Trees of signatures: all pairs of similar sets among those of one task.

A set's signature is a bitmap with the bits of its tokens. A node of the tree holds the bitmaps of its sets OR-combined, their
range of sizes, and the most tokens that any of them loses to shared bits. Two sets share at most as many tokens as
the bits that both nodes have, and those lost; of a pair of nodes that can't hold a similar pair by this bound or by their
sizes, nothing is looked at. The traversal goes down the tree in pairs of nodes, level by level, from the root with itself.

Only the classes that similar sets make are asked for. Sets of one class need no comparison, nor do nodes whose sets are
all of one class; so copies of a set cost one comparison each.

``hopeful_classes`` knows the signatures only, a few bits for each token, and joins all sets that the bounds don't keep apart;
``similar_classes`` compares the sets themselves.
"""

from __future__ import annotations

import numpy as np

FAN = 8
BITMAP_BYTES = 1 << 25
"""All signatures of a task take at most this; with more sets they have fewer bits and rule out less."""
CHUNK, CHUNK_WORDS = 1 << 13, 1 << 20
"""Pairs of nodes or sets that are looked at together, and words of their signatures."""


class Sets:
    """Sets as ranges of one array of tokens, which are numbers from 0 on."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        kinds, self.tokens = np.unique(tokens, return_inverse=True)
        self.marked = np.zeros(len(kinds), bool)

    def of(self, k: int) -> np.ndarray:
        return self.tokens[self.starts[k]:self.ends[k]]

    def shared(self, one: int, others: np.ndarray) -> np.ndarray:
        """How many tokens of ``others`` are in set ``one``."""
        self.marked[self.of(one)] = True
        sizes = self.sizes[others]
        firsts = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(firsts, sizes) + np.repeat(self.starts[others], sizes)
        out = np.add.reduceat(self.marked[self.tokens[at]].astype(np.int64), firsts)
        self.marked[self.of(one)] = False
        return out


class Classes:
    """Which sets are in one class so far; ``label`` is the least number of a set of the class."""

    def __init__(self, label: np.ndarray):
        _, first, which = np.unique(label, return_index=True, return_inverse=True)
        self.label = first[which]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            low, high = np.minimum(self.label[a], self.label[b]), np.maximum(self.label[a], self.label[b])
            apart = low < high
            a, b = a[apart], b[apart]
            np.minimum.at(self.label, high[apart], low[apart])
            while True:
                lower = self.label[self.label]
                if (lower == self.label).all():
                    break
                self.label = lower


def _bits(tokens: np.ndarray) -> np.ndarray:
    return (tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


def signatures(tokens: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """The bitmaps of sets, of so many 64-bit words (a power of two) each."""
    bits, of = _bits(tokens.astype(np.uint64)), np.repeat(np.arange(len(sizes)), sizes)
    maps = np.zeros((len(sizes), words), np.uint64)
    np.bitwise_or.at(maps, (of, (bits >> np.uint64(6)) & np.uint64(words - 1)), np.uint64(1) << (bits & np.uint64(63)))
    return maps


def own_words(size: int) -> int:
    """Words of a signature with one to two bits for each token."""
    return 1 << max(0, (size - 1) // 64).bit_length()


class Tree:
    """Levels of nodes, leaves (the sets, in order of size and a token) first."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, token: np.ndarray):
        bands = np.floor(np.log2(sizes) * 4)
        self.order = np.lexsort((sizes, token, bands))
        maps, sizes = maps[self.order], sizes[self.order]
        lost = sizes - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, lost)]
        while len(maps) > 1:
            firsts = np.arange(0, len(maps), FAN)
            maps = np.bitwise_or.reduceat(maps, firsts, axis=0)
            _, low, high, lost = self.levels[-1]
            self.levels.append((maps, np.minimum.reduceat(low, firsts), np.maximum.reduceat(high, firsts),
                                np.maximum.reduceat(lost, firsts)))

    def hopeful(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether pairs of nodes may hold sets of which 100 * shared >= percent * union."""
        maps, low, high, lost = self.levels[level]
        sizes = np.minimum(high[x], high[y]) * 100 >= percent * np.maximum(low[x], low[y])
        most = np.zeros(len(x), np.int64)
        at = np.flatnonzero(sizes)
        most[at] = np.bitwise_count(maps[x[at]] & maps[y[at]]).sum(1, dtype=np.int64) + np.minimum(lost[x[at]], lost[y[at]])
        most = np.minimum(most, np.minimum(high[x], high[y]))
        return sizes & (most * (100 + percent) >= percent * (low[x] + low[y]))


def _chunks(x: np.ndarray, y: np.ndarray, words: int):
    size = max(1, min(CHUNK, CHUNK_WORDS // words))
    for at in range(0, len(x), size):
        yield x[at:at + size], y[at:at + size]


def _verify(sets: Sets, classes: Classes, a: np.ndarray, b: np.ndarray, percent: int) -> None:
    """Joins the classes of the pairs that are similar."""
    if not len(a):
        return
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    bounds = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        one, others = a[first], b[first:last]
        others = others[classes.label[others] != classes.label[one]]
        if len(others):
            shared = sets.shared(one, others)
            union = sets.sizes[one] + sets.sizes[others] - shared
            others = others[100 * shared >= percent * union]
            classes.join(np.full(len(others), one), others)


def _traverse(tree: Tree, classes: Classes, percent: int, side: np.ndarray | None, compare) -> None:
    """Goes down the tree in pairs of nodes; ``compare`` gets the pairs of sets in different classes that are hopeful."""
    order, m = tree.order, len(tree.order)

    def down(level: int, x: np.ndarray, y: np.ndarray) -> None:
        for x, y in _chunks(x, y, tree.levels[0][0].shape[1]):
            if level:
                of, firsts = classes.label[order], np.arange(0, m, FAN ** level)
                low, high = np.minimum.reduceat(of, firsts), np.maximum.reduceat(of, firsts)
                apart = (low[x] != high[x]) | (low[y] != high[y]) | (low[x] != low[y])
            else:
                apart = classes.label[order[x]] != classes.label[order[y]]
                if side is not None:
                    apart &= side[order[x]] != side[order[y]]
            x, y = x[apart], y[apart]
            hopeful = tree.hopeful(level, x, y, percent)
            x, y = x[hopeful], y[hopeful]
            if not len(x):
                continue
            if not level:
                compare(order[x], order[y])
                continue
            below = len(tree.levels[level - 1][1])
            k = np.arange(FAN * FAN)
            i = (x[:, None] * FAN + k[None, :] // FAN).ravel()
            j = (y[:, None] * FAN + k[None, :] % FAN).ravel()
            inside = (i < below) & (j < below) & ((i < j) | (level > 1) & (i == j))
            down(level - 1, i[inside], j[inside])

    down(len(tree.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))


def similar_classes(tokens: np.ndarray, sizes: np.ndarray, percent: int, label: np.ndarray | None = None,
                    side: np.ndarray | None = None) -> np.ndarray:
    """Each set's class, as the number of a set in it.

    The tokens of a set are distinct. Classes known before are given as ``label``. With ``side``, sets of one side need
    not be compared.
    """
    m = len(sizes)
    classes = Classes(np.arange(m) if label is None else label)
    if m == 1:
        return classes.label
    sets = Sets(tokens, sizes)
    words = max(1, min(int(sets.sizes.max()) // 32 + 1, BITMAP_BYTES // (8 * m)))
    maps = signatures(tokens, sets.sizes, 1 << (words.bit_length() - 1))
    tree = Tree(maps, sets.sizes, np.minimum.reduceat(sets.tokens, sets.starts))
    order = tree.order
    _verify(sets, classes, order[:-1], order[1:], percent)  # neighbours first: copies find each other
    firsts = np.flatnonzero(classes.label[order] == order)  # one of each class, with the next few ones
    for ahead in (1, 2):
        _verify(sets, classes, order[firsts[:-ahead]], order[firsts[ahead:]], percent)
    _traverse(tree, classes, percent, side, lambda a, b: _verify(sets, classes, a, b, percent))
    return classes.label


def hopeful_classes(maps: list[np.ndarray], sizes: np.ndarray, token: np.ndarray, percent: int, label: np.ndarray | None = None,
                    side: np.ndarray | None = None) -> np.ndarray:
    """Classes, as ``similar_classes`` gives them, in which all similar sets are together, and few others.

    ``maps`` are signatures of ``own_words`` words. Longer ones are folded to the length of shorter ones.
    """
    classes = Classes(np.arange(len(sizes)) if label is None else label)
    words = np.array([len(x) for x in maps])
    for width in np.unique(words):
        own = np.flatnonzero(words == width)
        longer = np.flatnonzero((words > width) & (sizes * percent <= 100 * sizes[own].max()))
        some = np.concatenate([own, longer])
        if len(some) < 2:
            continue
        folded = np.stack([np.bitwise_or.reduce(maps[k].reshape(-1, width), axis=0) for k in some.tolist()])
        tree = Tree(folded, sizes[some], token[some])
        inner = Classes(classes.label[some])
        near = np.arange(len(some) - 1)
        near = near[tree.hopeful(0, near, near + 1, percent)]
        inner.join(tree.order[near], tree.order[near + 1])
        _traverse(tree, inner, percent, None if side is None else side[some], inner.join)
        classes.join(some, some[inner.label])
    return classes.label
