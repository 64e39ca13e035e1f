"""Simple-8b coding of token ids in 64-bit words, in numpy.

A word holds a selector in its top four bits and, in the other sixty, ``COUNTS[s]``
ids of ``WIDTHS[s]`` bits, the first id lowest. Selectors 0 and 1 stand for runs of
zeros. An id of 15 bits or more (the value ``ESCAPE`` included) is written as ``ESCAPE``
and itself kept, in order, in a list of 32-bit escapes, so that one rare id does not
spread out its neighbours. Ids are coded in blocks of ``BLOCK``: a block starts a new
word, and offsets into words and escapes are kept per block, so any block can be
decoded on its own. The last word of a block is filled up with zeros.
"""

from __future__ import annotations

import numpy as np

# Ids per word and bits per id, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15)
ESCAPE = (1 << 15) - 1
BLOCK = 16_384

_COUNTS = np.array(COUNTS)
_LEVEL = np.searchsorted(np.array(WIDTHS[2:]), np.ceil(np.log2(np.arange(ESCAPE + 1) + 1))) + 2
_LEVEL[0] = 0
_LEVEL = _LEVEL.astype(np.uint8)  # least selector whose width holds a value


def _selectors(level: np.ndarray, n: int) -> np.ndarray:
    """For each of the first ``n`` places, the densest selector that fits the ids from there on."""
    best = np.full(n, len(COUNTS) - 1, dtype=np.uint8)
    span, most = 1, level
    spans = [(1, level)]
    while span * 2 <= COUNTS[0]:
        most = np.maximum(most[:-span], most[span:])
        span *= 2
        spans.append((span, most))
    for selector in range(len(COUNTS) - 2, -1, -1):
        count = COUNTS[selector]
        span, most = next(s for s in reversed(spans) if s[0] <= count)
        fits = np.maximum(most[:n], most[count - span:count - span + n]) <= selector
        best[fits] = selector
    return best


def _encode_block(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    large = ids >= ESCAPE
    escapes = ids[large].astype("<u4")
    values = np.zeros(len(ids) + COUNTS[0], dtype=np.uint64)
    values[:len(ids)] = np.where(large, ESCAPE, ids)
    best = _selectors(_LEVEL[values.astype(np.int64)], len(ids))
    end = len(ids)
    jump = np.append(np.minimum(np.arange(end) + _COUNTS[best], end), end)
    starts = np.zeros(1, dtype=np.int64)
    while starts[-1] < end:  # twice as many words of the chain each time
        starts = np.concatenate([starts, jump[starts]])
        jump = jump[jump]
    starts = starts[starts < end]
    chosen = best[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        if width := WIDTHS[selector]:
            of = np.flatnonzero(chosen == selector)
            for k in range(COUNTS[selector]):
                words[of] |= values[starts[of] + k] << np.uint64(k * width)
    return words.astype("<u8"), escapes


def _decode_block(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n + COUNTS[0], dtype=np.uint32)
    for selector in np.unique(chosen):
        if width := WIDTHS[selector]:
            of = np.flatnonzero(chosen == selector)
            mask = np.uint64((1 << width) - 1)
            for k in range(COUNTS[selector]):
                out[starts[of] + k] = (words[of] >> np.uint64(k * width)) & mask
    out = out[:n]
    out[out == ESCAPE] = escapes
    return out


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, and where each block starts in either (with the end as last)."""
    coded = [_encode_block(ids[a:a + BLOCK]) for a in range(0, len(ids), BLOCK)]
    words = np.concatenate([w for w, _ in coded]) if coded else np.zeros(0, "<u8")
    escapes = np.concatenate([e for _, e in coded]) if coded else np.zeros(0, "<u4")
    word_at = np.cumsum([0] + [len(w) for w, _ in coded]).astype(np.int32)
    escape_at = np.cumsum([0] + [len(e) for _, e in coded]).astype(np.int32)
    return words, escapes, word_at, escape_at


def decode(words: np.ndarray, escapes: np.ndarray, word_at, escape_at, n: int,
           first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks ``first`` up to ``last`` of ``n`` ids in all."""
    blocks = len(word_at) - 1
    parts = [_decode_block(words[word_at[b]:word_at[b + 1]], escapes[escape_at[b]:escape_at[b + 1]],
                           min(BLOCK, n - b * BLOCK))
             for b in range(first, blocks if last is None else last)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
