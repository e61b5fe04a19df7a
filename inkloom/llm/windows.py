"""Windows of a fixed number of symbols, found by content-defined anchors.

Every window of `width` symbols holds `width - gram + 1` grams. Its anchor is the gram with the
smallest hash, the leftmost on a tie. The choice depends on the window's content alone, so equal
windows have the same anchor at the same place. Grouping by anchor therefore loses no pair of equal
windows, while a text has only about one anchor for every `width / 2` symbols.

Consecutive windows that share an anchor form a run. A run that covers windows a to b spans the
symbols a to b + width, and two runs with equal spans have equal windows throughout.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Symbols handled at once; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
POSITION = np.uint64((1 << 24) - 1)
_M = 0x9E3779B97F4A7C15 | 1
_FULL = (1 << 64) - 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i modulo 2**64 for i up to n."""
    inverse = pow(_M, -1, 1 << 64)
    out = []
    for base in (_M, inverse):
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(PIECE + 4096, 1 << int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


#: A random-looking value for each byte.
BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols start to end, from the sums that prefix() gives."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def gram_hashes(sums: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram that begins at each place, from the sums that prefix() gives."""
    return mix((sums[gram:] - sums[:-gram]) * powers(len(sums) - 1)[1][: len(sums) - gram])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, _FULL, np.uint64)
    padded[:n] = x
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, gram: int):
    """Runs of windows in the texts [start, end) of values (one hash per symbol), as arrays.

    Returns (text, first window, number of windows, anchor hash, span hash, sums); windows are places in values.
    """
    n = len(values)
    sums = prefix(values)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), sums
    grams = gram_hashes(sums, gram)
    ranked = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_min(ranked, width - gram + 1) & POSITION).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    long = ends - starts >= width
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - width + 1, -1)
    valid = np.cumsum(edge[: len(least)]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    a, b = np.flatnonzero(new), np.flatnonzero(last)
    at = least[a]
    span = span_hash(sums, a, b + width) ^ mix((at - a).astype(np.uint64))
    return np.searchsorted(starts, a, "right") - 1, a, b - a + 1, grams[at], span, sums


def pieces(length: int, width: int, limit: int = PIECE) -> list[tuple[int, int]]:
    """Ranges of at most limit symbols that together hold every window of the text once."""
    if length <= limit:
        return [(0, length)]
    step = limit - width + 1
    return [(i, min(length, i + limit)) for i in range(0, length - width + 1, step)]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Union of half-open ranges as sorted maximal ranges."""
    out: list[list[int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return out


def flag_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Ranges [i, j) of consecutive true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
