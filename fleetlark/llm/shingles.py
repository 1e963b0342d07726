"""Sets of word shingles of whole texts, computed over UTF-8 bytes in numpy.

Words are runs of bytes other than space and 9 to 13, with A-Z lower-cased. A word's hash is a
polynomial over its bytes taken from prefix sums modulo 2**64, scrambled; a shingle's hash
combines those of its words. Sets are compared by these 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

from fleetlark.llm.common import mix, slices

_P = 0x9E3779B97F4A7C15
_STEPS = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F)


_CODE = np.arange(256, dtype=np.uint64) + np.uint64(1)
_CODE[65:91] += np.uint64(32)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _powers(size: int):
    """Powers of _P and of its inverse modulo 2**64."""
    out = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, powers: dict[int, list[np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of the given rows. ``powers`` keeps what one call works out for the next."""
    begin, end = int(offsets[0]), int(offsets[-1])
    if begin == end:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = data[begin:end]
    blank = _SPACE[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets - begin] = True
    first = ~blank & (np.concatenate(([True], blank[:-1])) | edge[:-1])
    last = ~blank & (np.concatenate((blank[1:], [True])) | edge[1:])
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = 1 << max(10, int(len(text)).bit_length())
    powers = {} if powers is None else powers
    if size not in powers:
        powers[size] = _powers(size)
    power, inverse = powers[size]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE[text] * power[:len(text)], dtype=np.uint64)))
    hashes = (total[stops] - total[starts]) * inverse[starts]
    return mix(hashes + (stops - starts).astype(np.uint64) * np.uint64(_STEPS[4])), np.searchsorted(offsets[1:] - begin, starts, "right")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 3):
    """Per row the sorted array of its distinct shingle hashes. A row of fewer words than the
    width has its whole sequence as its one shingle; a row without words has none."""
    steps = [np.uint64(_STEPS[k % 4] + 2 * (k // 4)) for k in range(width)]
    powers: dict[int, list[np.ndarray]] = {}
    for a, b in slices(offsets):
        words, row = word_hashes(data, offsets[a:b + 1], powers)
        count = np.bincount(row, minlength=b - a)
        at = np.concatenate(([0], np.cumsum(count)))
        if len(words) >= width:
            combined = np.zeros(len(words) - width + 1, np.uint64)
            for k in range(width):
                combined += words[k:k + len(combined)] * steps[k]
            combined = mix(combined)
        for i in range(b - a):
            n = count[i]
            if n >= width:
                yield np.unique(combined[at[i]:at[i] + n - width + 1])
            elif n:
                yield mix((words[at[i]:at[i] + n] * np.array(steps[:n])).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)
