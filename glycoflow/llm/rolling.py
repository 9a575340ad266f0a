"""Rolling hashes and winnowing over Arrow string batches, vectorised with numpy.

All functions work on one flat byte buffer that holds the texts of a batch back to back. Hashes are polynomials
modulo 2**64 with odd bases, so that the hash of any stretch follows from two prefix sums, followed by a mixing step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Positions share a 64-bit key with the upper bits of the hash; longer buffers are winnowed in stretches.
POSITION_BITS = 24


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts back to back and the n + 1 offsets of the texts; a null text is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[-1] == bounds[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted different values; faster than a hash table where most differ."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below n; kept between calls up to 4 million entries."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            out = np.full(size, b, dtype=U64)
            out[0] = 1
            both.append(np.multiply.accumulate(out))
        have = (both[0], both[1])
        if size <= 1 << 22:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def forget() -> None:
    """Keep no powers."""
    _powers.clear()


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of value[i] * base**i over the first j values, for j = 0 … n."""
    up, _ = powers(base, len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed hash of each stretch [start, end)."""
    _, down = powers(base, len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def windows(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Mixed hash of every k values in a row, by start; also of those that cross from one text to the next."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    sums = prefix_sums(values, base)
    _, down = powers(base, len(sums))
    return mixed((sums[k:] - sums[:-k]) * down[:n])


def words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the number of words before it (n + 1 values).

    A word is a run of bytes other than the separators: blank, tab, line feed, vertical tab, form feed and carriage
    return, unless a table says others. It does not cross from one text to the next.
    """
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = ~separators[data]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    starts = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    starts[inner] = solid[1:-1][inner]
    ends[inner - 1] = solid[1:-1][inner - 1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    return stretch_hashes(prefix_sums(data.astype(U64) + U64(1), base), starts, ends, base)


def sliding_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` keys in a row, by start."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    full = -(-len(keys) // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, dtype=U64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def winnowed(values: np.ndarray, bounds: np.ndarray, k: int, length: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchor of every window of ``length`` values inside one text.

    The anchor is the k-gram of the smallest hash in the window, the last one of equals. It follows from the window's
    content alone, so equal windows have equal anchors at the same place.

    Returns the window starts (ascending), the anchor's position of each, and the hash of all k-grams by position.
    """
    grams = windows(values, k, base)
    width = length - k + 1
    mask = U64((1 << POSITION_BITS) - 1)
    anchors = np.empty(max(0, len(grams) - width + 1), dtype=np.int64)
    step = (1 << POSITION_BITS) - width
    for start in range(0, len(anchors), step):
        some = grams[start : start + step + width - 1]
        keys = (some & ~mask) | (mask - np.arange(len(some), dtype=U64))
        anchors[start : start + step] = start + (mask - (sliding_minimum(keys, width) & mask)).astype(np.int64)
    sizes = np.diff(bounds)
    inside = np.zeros(len(values) + 1, dtype=np.int8)
    fits = sizes >= length
    inside[bounds[:-1][fits]] += 1
    inside[bounds[1:][fits] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside[: len(anchors)]) > 0)
    return at, anchors[at], grams


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a window [start, start + length)."""
    steps = np.zeros(size + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, size), -1)
    return np.cumsum(steps[:-1]) > 0


def batches(table: pa.RecordBatch, column: int, most: int = 8 << 20):
    """Cut a record batch into pieces of about ``most`` text bytes; one text alone may be larger."""
    texts = table.column(column)
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    at = 0
    while at < table.num_rows:
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield table.slice(at, stop - at)
        at = stop
