"""Suffix arrays with numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np

#: Never part of UTF-8: what stands between two texts starts with it, followed by the text's number.
MARK = 0xFF
GAP = 8


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, each followed by a gap of its own that equals nothing else, and their starts."""
    parts, starts, at = [], np.zeros(len(texts), dtype=np.int64), 0
    for number, text in enumerate(texts):
        starts[number] = at
        digits = [(number // 200**k) % 200 for k in range(5)]
        parts += [text, bytes([MARK, *digits, MARK, MARK])]
        at += len(text) + GAP
    return np.frombuffer(b"".join(parts), dtype=np.uint8), starts


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that sorts like them; zeros follow the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint64)
    padded[: len(data)] = data
    out = padded[:-8].copy()
    for k in range(1, 8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray, limit: int) -> np.ndarray:
    """Places of the buffer in the order of the ``limit`` bytes from there on.

    Larsson-Sadakane: suffixes are grouped by their first h bytes; a group is refined by the groups of the suffixes
    h bytes further on, which doubles h. Groups of one are in place and take part no more. A buffer is shorter than 2 GB.
    """
    n = len(data)
    keys = words8(data)
    order = np.argsort(keys, kind="stable").astype(np.int32)
    keys = keys[order]
    places = np.arange(n, dtype=np.int32)
    heads = np.maximum.accumulate(np.where(np.concatenate(([True], keys[1:] != keys[:-1])), places, 0))
    group = np.empty(n, dtype=np.int32)
    group[order] = heads
    h = 8
    while h < limit:
        first = heads == places
        open_ = np.flatnonzero(~(first & np.concatenate((first[1:], [True]))))
        if not len(open_):
            break
        step = min(h, limit - h)
        at = order[open_]
        further = at + step
        keys = (group[at].astype(np.int64) << 32) | np.where(further < n, group[np.minimum(further, n - 1)] + 1, 0)
        inner = np.argsort(keys, kind="stable")
        keys = keys[inner]
        order[open_] = at[inner]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        heads[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        group[order[open_]] = heads[open_]
        h += step
    return order


def _same_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit numbers."""
    out = np.zeros(len(x), dtype=np.int64)
    for k in range(8):
        out += x < (np.uint64(1) << np.uint64(56 - 8 * k)) if k else x < np.uint64(1 << 56)
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """By place: bytes in common with the suffix before it in the order, up to ``limit``; 0 for other places.

    Kasai: from one place to the next, the common prefix shrinks by one byte at most. That does not hold after a tie,
    which the order leaves open beyond the limit, unless the suffix before also moves on by one place. All texts take
    their steps side by side; ``starts`` and ``counts`` tell the places of each text that are asked for.
    """
    n = len(data)
    words = words8(data)
    words = np.concatenate((words, np.zeros(limit + 8, dtype=np.uint64)))
    before = np.empty(n, dtype=np.int32)
    before[order[1:]] = order[:-1]
    before[order[:1]] = -1
    out = np.zeros(n, dtype=np.int32)
    by_count = np.argsort(-counts, kind="stable")
    starts, counts = starts[by_count], counts[by_count]
    have = np.zeros(len(starts), dtype=np.int64)
    last = np.full(len(starts), -2, dtype=np.int64)
    for step in range(int(counts.max(initial=0))):
        lanes = int(np.searchsorted(-counts, -step, side="left"))
        at = starts[:lanes] + step
        other = before[at]
        now = np.maximum(have[:lanes] - 1, 0)
        now[(other < 0) | (have[:lanes] == limit) & (other != last[:lanes] + 1)] = 0
        go = np.flatnonzero((other >= 0) & (now < limit))
        while len(go):
            differ = words[at[go] + now[go]] ^ words[other[go] + now[go]]
            now[go] += np.where(differ == 0, 8, _same_bytes(differ))
            go = go[(differ == 0) & (now[go] < limit)]
        now = np.minimum(now, limit)
        have[:lanes] = now
        last[:lanes] = other
        out[at] = now
    return out
