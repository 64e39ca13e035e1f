"""Sampled suffixes, front-coded sorted runs and their merge by a loser tree, in numpy and plain Python.

*Sampling.* Of every 200-byte window the leftmost gram of least hash is its anchor (a minimizer). Equal
windows have equal anchors at equal places, so it is enough to sort and compare the suffixes that start at anchors; an
anchor stands for a run of windows, ``lo`` to ``hi``.

*Runs.* A run is a list of suffixes in order. The first is stored whole, every other one as the length of the prefix
it has in common with the one before (its LCP) and the rest.

*Merging.* The runs meet in a tree of losers. A suffix that waits carries its LCP with the suffix that beat it. Of two
suffixes that both come after the last one put out, the one with the greater LCP to it comes first, without looking at
a byte; only with equal LCPs are bytes compared, and only behind them. So a known prefix is never compared
again, and the LCPs of neighbours in the merged order come with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LENGTH = 200
GRAM = 64
SPAN = LENGTH - GRAM + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE_BITS = 24
BATCH_BYTES = 1 << 19

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BATCH_BYTES, 1 << (max(n, 1) - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers[size] = tuple(out)
    return _powers[size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Hash of the ``width`` bytes from each place on: a polynomial by prefix sums."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    power, inverse = _powers_of(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * inverse[:len(data) - width + 1])


def gram_hashes_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What ``gram_hashes`` has at ``places``, in memory for these alone."""
    hashed = np.zeros(len(places), np.uint64)
    for o in reversed(range(GRAM)):
        hashed = hashed * np.uint64(_BASE) + data[places + o].astype(np.uint64) + np.uint64(1)
    return mixed(hashed)


def _sliding_least(keys: np.ndarray, span: int) -> np.ndarray:
    """Least of every ``span`` neighbours: prefix and suffix minima of blocks of ``span``."""
    n = len(keys) - span + 1
    blocks = -(-len(keys) // span) + 1
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    table = padded.reshape(blocks, span)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[span - 1:span - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray):
    """place, lo, hi and gram hash of the anchors of many texts, laid end to end in ``data``.

    Windows do not cross from one text to the next. Up to 2 ** 24 bytes at a time; longer single texts are
    done in overlapping parts, whose windows follow each other.
    """
    limit = (1 << _PLACE_BITS) - LENGTH
    if len(data) > limit:
        step = limit - LENGTH
        found = []
        for a in range(0, len(data), step):
            part_ends = np.unique(np.clip(ends - a, 0, min(limit, len(data) - a)))
            place, lo, hi, gram = anchors(data[a:a + limit], part_ends[part_ends > 0])
            own = lo < step
            found.append((place[own] + a, lo[own] + a, np.minimum(hi[own], step - 1) + a, gram[own]))
        return tuple(np.concatenate(x) for x in zip(*found))
    grams = gram_hashes(data)
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (grams[:0],)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_least(keys, SPAN) & low).astype(np.int64)
    start = np.arange(len(anchor))
    text_end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[:len(anchor)]
    inside = np.flatnonzero(start + LENGTH <= text_end)
    anchor = anchor[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    return anchor[first], inside[first], inside[last[:len(first)]], grams[anchor[first]]


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known already."""
    most = min(len(a), len(b))
    at = known
    while at < most:
        x, y = a[at:at + 32], b[at:at + 32]
        if x != y:
            n = min(len(x), len(y))
            differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return at + n - (differ.bit_length() + 7) // 8
        at += 32
    return most


def front_coded(suffixes: list[bytes]) -> tuple[list[int], bytes, list[int]]:
    """LCPs with the one before, the rests in a row, and lengths, of suffixes in order."""
    lcps, rests, before = [], [], b""
    for suffix in suffixes:
        lcp = common_prefix(before, suffix)
        lcps.append(lcp)
        rests.append(suffix[lcp:])
        before = suffix
    return lcps, b"".join(rests), [len(s) for s in suffixes]


def expanded(lcps, rests: bytes, lengths) -> Iterator[tuple[bytes, int]]:
    """The suffixes of a front-coded run with their LCPs."""
    before, at = b"", 0
    for lcp, length in zip(lcps, lengths):
        end = at + length - lcp
        before = before[:lcp] + rests[at:end]
        at = end
        yield before, lcp


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """Run number, suffix and LCP with the one before, of all runs in one order.

    ``tree[k]`` is the loser at inner node k, ``tree[0]`` the winner; leaf r is at ``width + r``.
    """
    width = 1
    while width < len(runs):
        width *= 2
    head: list[bytes | None] = [None] * width
    lcp = [0] * width  # with the last suffix put out
    for r, run in enumerate(runs):
        head[r], lcp[r] = next(run, (None, 0))

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's LCP becomes the one with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        known = common_prefix(x, y, lcp[a])
        if known == len(x) or (known < len(y) and x[known] < y[known]):
            lcp[b] = known
            return a, b
        lcp[a] = known
        return b, a

    tree = [0] * width
    winners = list(range(width))
    level = width
    while level > 1:
        level //= 2
        following = []
        for k in range(level):
            won, lost = play(winners[2 * k], winners[2 * k + 1])
            tree[level + k] = lost
            following.append(won)
        winners = following
    won = winners[0]
    while head[won] is not None:
        yield won, head[won], lcp[won]
        head[won], lcp[won] = next(runs[won], (None, 0))
        node = (width + won) // 2
        while node:
            won, tree[node] = play(won, tree[node])
            node //= 2


def repeated_windows(lcps: np.ndarray, left: np.ndarray, before_lo: np.ndarray, before_hi: np.ndarray) -> np.ndarray:
    """Which windows occur more than once: [i, o] is the window that starts o bytes before anchor i.

    The anchors are in the order of their suffixes with ``lcps``; ``left[i, o - 1]`` is the byte o places before
    anchor i; windows from ``before_lo`` to ``before_hi`` bytes before it are anchored there. Windows at offset o are equal where the suffixes
    agree in 200 - o bytes, which are stretches of the order, and the o bytes before do, by a 64-bit hash.
    """
    n = len(lcps)
    out = np.zeros((n, SPAN), bool)
    hashed = np.zeros(n, np.uint64)
    for o in range(SPAN):
        if o:
            hashed = (hashed + left[:, o - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
        of = np.flatnonzero((before_lo <= o) & (o <= before_hi))
        if len(of) < 2:
            continue
        stretch = np.cumsum(lcps < LENGTH - o).astype(np.uint64)
        keys = mixed(hashed[of] + mixed(stretch[of] + np.uint64(o + 1)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(of), bool)
        again[1:] |= same
        again[:-1] |= same
        out[of[order[again]], o] = True
    return out
