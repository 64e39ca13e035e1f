"""Token ids of texts from the ids of their words, looked up many at a time.

Byte-level BPE and piece models merge only inside the pieces that white space cuts off: no piece reaches across a single
space between two other characters except as its first character, and a single line feed between others is a piece of its
own. So the ids of a text are those of its words, each with the space before it or without, and line feeds. Words are told
apart by a 64-bit hash of their bytes; a table from hashes to ranges in one array of ids answers for all words of a batch
in a few passes, and only words it hasn't met yet are coded by the library. Texts with any other white space, or two marks of
white space in a row, at the start or the end, are coded as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

SPACE, FEED = 32, 10
ODD = -1
KNOWN = 1 << 20
"""The table is emptied when it holds as many words."""
FIRST_WORDS = 1 << 16
"""It starts with room for as many and doubles."""
BLOCK_BYTES = 1 << 18
_K = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(29).integers(0, 1 << 64, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range, in blocks, as there are several numbers for each byte."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(stops, starts[first] + BLOCK_BYTES, side="right")))
        sizes = stops[first:last] - starts[first:last]
        at = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) - np.repeat(at, sizes)
        powers = np.full(int(sizes.max()), _K)
        powers[0] = 1
        values = _BYTES[data[place + np.repeat(starts[first:last], sizes)]] * np.multiply.accumulate(powers)[place]
        out[first:last] = mixed(np.add.reduceat(values, at) + sizes.astype(np.uint64))
        first = last
    return out


_MARK, _LETTER, _LEAD = (np.zeros(256, bool) for _ in range(3))
_MARK[list(b".,;:!?")] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD[0xC3:0xCA] = True  # U+00C0 to U+027F, letters but for the signs of multiplication and division


class Cut:
    """The words of texts that white space cuts simply: where they stand, their hashes, and whether a line feed or space is before.

    ``spaced`` puts a space before each text. With ``ended``, a mark after a letter at the end of a word is a word of its own,
    as byte-level BPE cuts there too.
    """

    def __init__(self, texts: pa.Array, spaced: bool, ended: bool = False):
        self.texts = texts
        _, places, held = texts.buffers()
        places = np.frombuffer(places, np.int64 if pa.types.is_large_string(texts.type) else np.int32)
        places = places[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(held, np.uint8)[places[0]:places[-1]] if held and len(texts) else np.zeros(0, np.uint8)
        self.data, begins, ends = data, places[:-1] - places[0], places[1:] - places[0]
        white = (data == SPACE) | (data == FEED)
        edge = np.zeros(len(data) + 1, bool)
        edge[begins], edge[ends] = True, True
        at = np.flatnonzero(white)
        twice = at[(np.concatenate([white[1:], [False]])[at] if len(at) else at.astype(bool)) | edge[at] | edge[at + 1]]
        self.odd = begins == ends
        self.odd[np.searchsorted(ends, twice, side="right")] = True
        before = np.concatenate([[True], white[:-1]])[:len(data)]
        starts = np.flatnonzero(~white & (before | edge[:-1]))
        after = np.concatenate([white[1:], [True]])[:len(data)]
        stops = np.flatnonzero(~white & (after | edge[1:])) + 1
        text = np.searchsorted(ends, starts, side="right")
        simple = ~self.odd[text]
        self.starts, self.stops, self.text = starts[simple], stops[simple], text[simple]
        first = self.starts == begins[self.text]
        self.after_feed = ~first & (data[self.starts - 1] == FEED)
        self.after_space = ~self.after_feed if spaced else ~(self.after_feed | first)
        if ended:
            self._part_marks()
        self.keys = mixed(hashes(data, self.starts, self.stops) + self.after_space.astype(np.uint64)) | np.uint64(1)

    def _part_marks(self) -> None:
        data, last = self.data, self.stops - 1
        long = self.stops - self.starts >= 2
        two, three = data[last - 1], data[last - 2]
        latin = (self.stops - self.starts >= 3) & _LEAD[three] & (two >= 0x80) & ~((three == 0xC3) & ((two == 0x97) | (two == 0xB7)))
        marked = long & _MARK[data[last]] & (_LETTER[two] | latin)
        of = np.repeat(np.arange(len(marked)), 1 + marked)
        is_mark = np.zeros(len(of), bool)
        is_mark[1:] = of[1:] == of[:-1]
        self.stops = np.where(is_mark, self.stops[of], self.stops[of] - marked[of])
        self.starts = np.where(is_mark, self.stops - 1, self.starts[of])
        self.text, self.after_feed, self.after_space = self.text[of], self.after_feed[of] & ~is_mark, self.after_space[of] & ~is_mark


class WordIds:
    """A coder of texts by their words.

    ``whole`` gives the ids of a text, ``words`` the ids of many words, behind a space or not, as one array and their numbers.
    ``wrong`` tells of which words the ids don't give back the bytes; texts with such words are coded as a whole too.
    """

    def __init__(self, whole: Callable[[str], np.ndarray], words: Callable[[list[str], bool], tuple[np.ndarray, np.ndarray]],
                 line_feed: int, wrong: Callable | None = None):
        self.whole, self.words, self.line_feed, self.wrong = whole, words, line_feed, wrong
        self._empty()

    def _empty(self) -> None:
        self.table_keys = np.zeros(4 * FIRST_WORDS, np.uint64)
        self.table_entries = np.zeros(4 * FIRST_WORDS, np.int32)
        self.firsts, self.sizes, self.n_words = np.zeros(FIRST_WORDS, np.int64), np.zeros(FIRST_WORDS, np.int32), 0
        self.ids, self.n_ids = np.zeros(4 * FIRST_WORDS, np.uint32), 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        size = len(self.table_keys)
        slot = (keys % np.uint64(size)).astype(np.int64)
        held = self.table_keys[slot]
        out = np.where(held == keys, self.table_entries[slot], -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) % size
            held = self.table_keys[slot[left]]
            same = held == keys[left]
            out[left[same]] = self.table_entries[slot[left[same]]]
            left = left[~same & (held != 0)]
        return out

    def _enter(self, keys: np.ndarray) -> None:
        """Gives distinct new keys the next entries."""
        size = len(self.table_keys)
        entries = np.arange(self.n_words, self.n_words + len(keys))
        slot, left = (keys % np.uint64(size)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.table_keys[slot[left]] == 0
            self.table_keys[slot[left[free]]] = keys[left[free]]
            placed = self.table_keys[slot[left]] == keys[left]
            self.table_entries[slot[left[placed]]] = entries[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) % size

    def _learn(self, cut: Cut, new: np.ndarray) -> None:
        """Codes the words at the places ``new`` of the cut, which are distinct."""
        raw, starts, stops = cut.data.tobytes(), cut.starts[new], cut.stops[new]
        words = [raw[a:b].decode() for a, b in zip(starts.tolist(), stops.tolist())]
        simple = np.array([word.split() == [word] for word in words], bool)
        needed = self.n_words + len(new)
        if needed > len(self.firsts):
            more = max(needed - len(self.firsts), len(self.firsts))
            self.firsts, self.sizes = (np.concatenate([a, np.zeros(more, a.dtype)]) for a in (self.firsts, self.sizes))
        while needed * 3 > len(self.table_keys):
            held = np.flatnonzero(self.table_keys)
            keys = self.table_keys[held][np.argsort(self.table_entries[held])]
            self.table_keys, self.table_entries = np.zeros(2 * len(self.table_keys), np.uint64), np.zeros(2 * len(self.table_entries), np.int32)
            n, self.n_words = self.n_words, 0
            self._enter(keys)
            self.n_words = n
        self._enter(cut.keys[new])
        entry = np.arange(self.n_words, needed)
        self.n_words = needed
        self.sizes[entry[~simple]] = ODD
        for spaced in (False, True):
            some = np.flatnonzero(simple & (cut.after_space[new] == spaced))
            if not len(some):
                continue
            ids, sizes = self.words([words[k] for k in some.tolist()], spaced)
            if self.n_ids + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32)])
            firsts = self.n_ids + np.cumsum(sizes) - sizes
            self.ids[self.n_ids:self.n_ids + len(ids)] = ids
            self.n_ids += len(ids)
            if self.wrong is not None:
                sizes = np.where(self.wrong(ids, sizes, cut.data, starts[some], stops[some], spaced), ODD, sizes)
            self.firsts[entry[some]], self.sizes[entry[some]] = firsts, sizes

    def __call__(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of the cut, and each one's number of them; simple ones by their words."""
        if self.n_words > KNOWN:
            self._empty()
        entry = self._find(cut.keys)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            _, first = np.unique(cut.keys[missing], return_index=True)
            self._learn(cut, missing[first])
            entry[missing] = self._find(cut.keys[missing])
        sizes = self.sizes[entry].astype(np.int64)
        odd = cut.odd.copy()
        odd[cut.text[sizes == ODD]] = True
        sizes[sizes == ODD] = 0
        both = sizes + cut.after_feed
        ids = np.full(int(both.sum()), self.line_feed, np.uint32)
        begins = np.cumsum(both) - sizes
        ids[spread(begins, sizes)] = self.ids[spread(self.firsts[entry], sizes)]
        counts = np.bincount(cut.text, both, len(cut.odd)).astype(np.int64)
        if not odd.any():
            return ids, counts
        ends = np.cumsum(counts)
        parts, at = [], 0
        for k in np.flatnonzero(odd).tolist():
            parts += [ids[at:ends[k] - counts[k]], self.whole(cut.texts[k].as_py())]
            at, counts[k] = ends[k], len(parts[-1])
        return np.concatenate([*parts, ids[at:]]).astype(np.uint32, copy=False), counts
