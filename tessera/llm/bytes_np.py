"""Words, substring hashes and statistics of many texts at once, on their UTF-8 bytes in numpy."""

from __future__ import annotations

import functools

import numpy as np

U64 = np.uint64

# The white space that the word rule of the similarity operators names: blank, tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Word characters of the classifiers: ASCII letters and digits, and all bytes of other characters.
WORDY = np.zeros(256, bool)
WORDY[ord("0") : ord("9") + 1] = WORDY[ord("A") : ord("Z") + 1] = WORDY[ord("a") : ord("z") + 1] = True
WORDY[0x80:] = True

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# A polynomial hash modulo 2**64 with random values for bytes: any substring's hash comes from two prefix sums.
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out)


#: Longer data are hashed in blocks of so many bytes, so that the tables of powers stay this long.
BLOCK = 1 << 19


@functools.cache
def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, BLOCK + 1), _powers(_BASE_INVERSE, BLOCK + 1)


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_VALUE[LOWER[data]] * _power_tables()[0][: len(data)], out=out[1:])
    return out


class Substrings:
    """Hashes of substrings of one byte array, lower-cased by ``LOWER``."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.sums = _prefix_sums(data) if len(data) <= BLOCK else None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each [start, end); ``starts`` ascend where the data are longer than a block."""
        down = _power_tables()[1]
        if self.sums is not None:
            plain = (self.sums[ends] - self.sums[starts]) * down[starts]
        else:
            plain = np.zeros(len(starts), U64)
            for low in range(0, len(self.data), BLOCK):
                high = min(low + BLOCK, len(self.data))
                i, j = np.searchsorted(starts, (low, high))
                sums, first = _prefix_sums(self.data[low:high]), starts[i:j] - low
                plain[i:j] = (sums[np.minimum(ends[i:j], high) - low] - sums[first]) * down[first]
                for k in (i + np.flatnonzero(ends[i:j] > high)).tolist():
                    plain[k : k + 1] += self._rest(high, int(ends[k]), high - int(starts[k]))
        return mix(plain + (ends - starts).astype(U64) * U64(0x1234567))

    def _rest(self, start: int, end: int, before: int) -> np.uint64:
        """What [start, end) adds to the sum of a substring that began ``before`` bytes earlier."""
        total = 0
        for low in range(start, end, BLOCK):
            part = int(_prefix_sums(self.data[low : min(low + BLOCK, end)])[-1])
            total += part * pow(_BASE, before + low - start, 2**64)
        return U64(total % 2**64)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes that ``inside`` accepts; none crosses a text."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    ok = inside[data]
    first, last = ok.copy(), ok.copy()
    first[1:] &= ~ok[:-1]
    last[:-1] &= ~ok[1:]
    edges = offsets[1:-1]
    begins = edges[edges < n]
    first[begins] = ok[begins]
    stops = edges[edges > 0] - 1
    last[stops] = ok[stops]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def bounds(numbers: np.ndarray, n: int) -> np.ndarray:
    """Where each text's run begins in ascending ``numbers``: n + 1 positions."""
    return np.searchsorted(numbers, np.arange(n + 1))
