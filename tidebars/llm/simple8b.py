"""Simple-8b: 64-bit words of a selector and as many equally wide values as fit; wider values escape."""

from __future__ import annotations

import numpy as np

# fixed values of the format: values in a word and bits of each, by selector
COUNTS = [240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]

RUN = 256  # words between two entries of the offset table
_DOUBLINGS = 5  # places of words are found 32 words at a time
RARE = 64  # a width is enough for a block if at most one value in so many is wider
_COUNTS, _WIDTHS = np.array(COUNTS), np.array(WIDTHS)
_LIMITS = np.array([1 << w for w in WIDTHS], np.uint64)


def escape_width(values: np.ndarray) -> int:
    """The least selector width that all but one in ``RARE`` values fit in."""
    for width in WIDTHS[1:]:
        if np.count_nonzero(values >= np.uint64(1 << width)) * RARE <= len(values):
            return width
    return WIDTHS[-1]


def _selectors(values: np.ndarray) -> np.ndarray:
    """The selector that packs most values from each place on; what is left at the end may fill a word in part."""
    n = len(values)
    if n and values.max() < 1 << 32:
        values = values.astype(np.uint32)  # half the memory to go through
    best = np.full(n, len(COUNTS) - 1, np.int8)
    narrow = np.ones(n + COUNTS[0], bool)
    for selector in range(len(COUNTS) - 2, -1, -1):
        np.less(values, _LIMITS[selector].astype(values.dtype), out=narrow[:n])
        fits, held = narrow, 1
        while held < COUNTS[selector]:  # whether all of so many values from a place on are narrow
            step = min(held, COUNTS[selector] - held)
            fits, held = fits[:-step] & fits[step:], held + step
        fits = fits[:n]
        if not fits.any():
            break  # fewer bits and more values fit nowhere either
        best[fits] = selector
    return best


def _starts(counts: np.ndarray) -> np.ndarray:
    """The places from the first on that are reached by going on by the count of each."""
    n = len(counts)
    jumps = [np.append(np.minimum(np.arange(n) + counts, n), n)]
    for _ in range(_DOUBLINGS):
        jumps.append(jumps[-1][jumps[-1]])
    at, some, far = 0, [], memoryview(jumps[-1])
    while at < n:
        some.append(at)
        at = far[at]
    starts = np.array(some, np.int64)
    for jump in jumps[-2::-1]:
        starts = np.stack([starts, jump[starts]], axis=1).ravel()
    return starts[starts < n]


def pack(values: np.ndarray) -> np.ndarray:
    """Words of values below 2^60, each filled with as many values as it can take."""
    best = _selectors(values)
    starts = _starts(_COUNTS[best])
    chosen = best[starts]
    padded = np.concatenate([values, np.zeros(COUNTS[0], np.uint64)])
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.flatnonzero(np.bincount(chosen, minlength=len(COUNTS))):
        width = WIDTHS[selector]
        if width:
            mine = np.flatnonzero(chosen == selector)
            word, at = words[mine], starts[mine]
            for i in range(COUNTS[selector]):
                word |= padded[at + i] << np.uint64(i * width)
            words[mine] = word
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """All values of the words, those that fill up the last word too."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNTS[chosen]
    begins = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.flatnonzero(np.bincount(chosen, minlength=len(COUNTS))):
        width = WIDTHS[selector]
        if width:
            mine = np.flatnonzero(chosen == selector)
            word, at = words[mine], begins[mine]
            for i in range(COUNTS[selector]):
                out[at + i] = (word >> np.uint64(i * width)) & np.uint64((1 << width) - 1)
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, first value of every ``RUN``-th word, and places and values of escapes; any 64-bit values."""
    values = np.asarray(values, np.uint64)
    escaped = np.flatnonzero(values >= np.uint64(1 << escape_width(values)))
    small = values.copy()
    small[escaped] = 0
    words = pack(small)
    counts = _COUNTS[(words >> np.uint64(60)).astype(np.int64)]
    begins = np.cumsum(counts) - counts
    return words, begins[::RUN].astype(np.uint32), escaped.astype(np.uint32), values[escaped]


def decode(words: np.ndarray, offsets: np.ndarray, places: np.ndarray, escapes: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Values ``begin`` to ``end``, from the runs of words that hold them."""
    if begin >= end:
        return np.zeros(0, np.uint64)
    first = int(np.searchsorted(offsets, begin, "right")) - 1
    last = int(np.searchsorted(offsets, end, "left"))
    base = int(offsets[first])
    out = unpack(words[first * RUN:last * RUN])[begin - base:end - base]
    low, high = np.searchsorted(places, [begin, end])
    out[places[low:high].astype(np.int64) - begin] = escapes[low:high]
    return out
