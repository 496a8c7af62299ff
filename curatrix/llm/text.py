"""Texts as arrays: code points, words and word hashes, without a loop over words."""

import sys
import unicodedata

import numpy as np

_U64 = np.uint64
#: An odd multiplier and its inverse modulo 2**64, so that spans of one prefix
#: array can be moved to the same power.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Characters whose prefix sums are held at once.
PIECE = 1 << 18

_powers = np.ones(1, dtype=_U64), np.ones(1, dtype=_U64)
_tables: dict[str, np.ndarray] = {}


def codes(text: str) -> np.ndarray:
    """The code points of a text, as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _table(kind: str) -> np.ndarray:
    """For every code point, whether it is a letter, or a letter or digit."""
    if kind not in _tables:
        wanted = ("L",) if kind == "letter" else ("L", "N")
        _tables[kind] = np.fromiter(
            (unicodedata.category(chr(c))[0] in wanted for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1
        )
    return _tables[kind]


def letters(points: np.ndarray) -> np.ndarray:
    return _table("letter")[points]


def alphanumeric(points: np.ndarray) -> np.ndarray:
    return _table("alphanumeric")[points]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    global _powers
    while len(_powers[0]) < n:
        k = len(_powers[0])
        up, down = _U64(pow(_BASE, k, 1 << 64)), _U64(pow(_INVERSE, k, 1 << 64))
        _powers = np.concatenate([_powers[0], _powers[0] * up]), np.concatenate([_powers[1], _powers[1] * down])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of uint64 that spreads every bit, one for each seed."""
    x = x + _U64((seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & (1 << 64) - 1)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's characters, wherever the span lies; spans stand in order and apart.

    The characters are looked at in pieces of about ``PIECE``, so that a long
    text's prefix sums do not stand in memory at once.
    """
    out = np.empty(len(starts), dtype=_U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        own = points[base : ends[j - 1]]
        up, down = powers(len(own) + 1)
        sums = np.zeros(len(own) + 1, dtype=_U64)
        np.cumsum((own.astype(_U64) + _U64(1)) * up[:-1], out=sums[1:])
        first = starts[i:j] - base
        out[i:j] = mix((sums[ends[i:j] - base] - sums[first]) * down[first])
        i = j
    return out


def words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the runs of letters and digits."""
    starts, ends = spans(alphanumeric(points))
    return starts, ends, span_hashes(points, starts, ends)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words; of all words, if there are fewer."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=_U64)
    for j in range(k):
        out = out * _U64(_BASE) + hashes[j : n - k + 1 + j]
    return mix(out, k)
