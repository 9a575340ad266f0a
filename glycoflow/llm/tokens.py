"""Token ids by a file of the tokenizers library, with a cache of words."""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa

from glycoflow.llm import rolling

TOKENIZER = "byte_bpe_50k.json"
END = 2
#: Pieces of text kept by one Python worker, and their ids (about 160 MB in all).
CACHED, CACHED_IDS = 1_500_000, 10_000_000
#: Bytes of text that are encoded at once.
TEXT_BYTES = 2 << 20
#: New words that are encoded in one text.
TOGETHER = 8192
SPECIAL = b"<|endoftext|>"


def _table(*values: int) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


#: White space of one byte, and what a tokenizer may take for it.
SPACES = rolling.SPACES | _table(*range(0x1C, 0x20))
#: First bytes of white space beyond ASCII, and by first byte what follows.
LEADS = _table(0xC2, 0xE1, 0xE2, 0xE3)
WIDE = {0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE2: [*(bytes([0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"], 0xE3: [b"\x80\x80"]}
PLAIN = _table(*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B))
MARKS = _table(*range(0x21, 0x7F)) & ~PLAIN


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes are part of white space."""
    white = SPACES[data]
    leads = np.flatnonzero(LEADS[data])
    if len(leads):
        some = np.concatenate((data, np.zeros(2, dtype=np.uint8)))
        first, second, third = some[leads], some[leads + 1], some[leads + 2]
        for lead, rests in WIDE.items():
            for rest in rests:
                at = leads[(first == lead) & (second == rest[0]) & ((third == rest[1]) if len(rest) > 1 else True)]
                for k in range(len(rest) + 1):
                    white[at + k] = True
    return white


def _gathered(data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after the other."""
    stops = np.cumsum(counts)
    return data[np.repeat(starts - (stops - counts), counts) + np.arange(int(stops[-1]) if len(stops) else 0)]


class Known:
    """Ids of pieces by two 64-bit hashes: a table of row numbers with open addressing, looked up for whole arrays."""

    def __init__(self) -> None:
        self.size = self.n_ids = 0
        self.keys = np.zeros((2, 1 << 16), dtype=np.uint64)
        self.places = np.zeros((2, 1 << 16), dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype="<u4")
        self.table = np.full(1 << 18, -1, dtype=np.int32)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Rows of the pieces, -1 for those not known."""
        out = np.full(len(high), -1, dtype=np.int64)
        mask = np.uint64(len(self.table) - 1)
        slots = (high & mask).astype(np.int64)
        left = np.arange(len(high))
        while len(left):
            rows = self.table[slots]
            used = rows >= 0
            same = used & (self.keys[0][rows] == high[left]) & (self.keys[1][rows] == low[left])
            out[left[same]] = rows[same]
            go = np.flatnonzero(used & ~same)
            left, slots = left[go], (slots[go] + 1) & int(mask)
        return out

    def _enter(self, first: int) -> None:
        rows = np.arange(first, self.size, dtype=np.int32)
        mask = len(self.table) - 1
        slots = (self.keys[0][first : self.size] & np.uint64(mask)).astype(np.int64)
        while len(rows):
            free = self.table[slots] < 0
            self.table[slots[free]] = rows[free]
            go = np.flatnonzero(self.table[slots] != rows)
            rows, slots = rows[go], (slots[go] + 1) & mask

    def add(self, high: np.ndarray, low: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows of pieces that are different and new; their ids stand one after the other."""
        first, size, n_ids = self.size, self.size + len(high), self.n_ids + len(ids)
        while self.keys.shape[1] < size:
            self.keys, self.places = (np.concatenate((x, np.zeros_like(x)), axis=1) for x in (self.keys, self.places))
        while len(self.ids) < n_ids:
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.keys[:, first:size] = high, low
        self.places[:, first:size] = self.n_ids + np.cumsum(counts) - counts, counts
        self.ids[self.n_ids : n_ids] = ids
        self.size, self.n_ids = size, n_ids
        if 2 * size > len(self.table):
            self.table = np.full(1 << (4 * size - 1).bit_length(), -1, dtype=np.int32)
            first = 0
        self._enter(first)
        return np.arange(size - len(high), size)


class Encoder:
    """Encodes whole texts.

    Byte-level tokenizers cut a text into words before anything else, and a blank before a visible character always
    starts a word, whatever stands before it. So a batch of texts is cut there, around line ends and before punctuation,
    each different piece is encoded once, and its ids are put wherever it stands. Pieces are told apart by two 64-bit
    hashes and their length, new ones of a batch by one of them. New pieces are encoded as the lines of one text; a line end between
    visible characters, or before a blank, is a token of its own. Texts for other tokenizers, and those with a special token, are encoded in one go.
    """

    def __init__(self, path: str, end: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end], dtype="<u4").tobytes()
        self.known = Known()
        kind = json.loads(self.tokenizer.to_str())
        before = kind.get("pre_tokenizer") or {}
        model = kind["model"]
        self.by_word = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not kind.get("normalizer") and not kind.get("post_processor") and model.get("type") == "BPE" and not model.get("dropout")
        )
        if self.by_word:
            # The library's own cache of words only costs where every word is new.
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            options = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
            self.tokenizer.model = models.BPE(model["vocab"], merges, cache_capacity=0, **{k: model[k] for k in options if model.get(k)})
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_end = line_end[0] if len(line_end) == 1 else None

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces, encoded as the lines of one text, and their number by piece; none if it has other line ends."""
        lines = np.full(int(sizes.sum()) + len(sizes), 0x0A, dtype=np.uint8)
        inside = np.ones(len(lines), dtype=bool)
        inside[np.cumsum(sizes + 1) - 1] = False
        lines[inside] = _gathered(data, starts, sizes)
        ids = self._ids([lines[:-1].tobytes().decode()])[0]
        cuts = np.flatnonzero(ids == self.line_end)
        if len(cuts) != len(sizes) - 1:
            return None
        return np.delete(ids, cuts), np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1

    def _learned(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces in the order of their ids, the ids, and their number by piece."""
        ids, counts, order = [], [], []
        line_ends = np.concatenate(([0], np.cumsum(data == 0x0A)))
        apart = white[ends - 1] | (line_ends[ends] > line_ends[starts]) | (self.line_end is None)
        together, alone = np.flatnonzero(~apart), [np.flatnonzero(apart)]
        for at in range(0, len(together), TOGETHER):
            some = together[at : at + TOGETHER]
            found = self._lines(data, starts[some], ends[some] - starts[some])
            if found is None:
                alone.append(some)
                continue
            ids.append(found[0])
            counts.append(found[1])
            order.append(some)
        rest = np.concatenate(alone)
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            each = self._ids([data[a:b].tobytes().decode() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            ids += each
            counts.append(np.array([len(x) for x in each], dtype=np.int64))
            order.append(some)
        return np.concatenate(order), np.concatenate(ids), np.concatenate(counts)

    def _rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, white: np.ndarray) -> np.ndarray:
        """Row of each piece among the known ones."""
        if self.known.size > CACHED or self.known.n_ids > CACHED_IDS:
            self.known = Known()
        values, sizes = data.astype(np.uint64) + np.uint64(1), (ends - starts).astype(np.uint64)
        high, low = (rolling.stretch_hashes(rolling.prefix_sums(values, b), starts, ends, b) ^ sizes for b in rolling.BASES)
        rows = self.known.find(high, low)
        new = np.flatnonzero(rows < 0)
        if len(new):
            _, first, inverse = np.unique(high[new], return_index=True, return_inverse=True)
            first = new[first]
            order, ids, counts = self._learned(data, starts[first], ends[first], white)
            learned = np.empty(len(first), dtype=np.int64)
            learned[order] = self.known.add(high[first[order]], low[first[order]], ids, counts)
            rows[new] = learned[inverse]
        return rows

    def _whole(self, texts: pa.Array, data: np.ndarray) -> np.ndarray:
        """Numbers of the texts to encode in one go."""
        if not self.by_word:
            return np.arange(len(texts))
        if SPECIAL not in data.tobytes():
            return np.zeros(0, dtype=np.int64)
        return np.array([i for i, x in enumerate(texts.to_pylist()) if SPECIAL.decode() in (x or "")], dtype=np.int64)

    def _cuts(self, data: np.ndarray, bounds: np.ndarray, white: np.ndarray) -> np.ndarray:
        """Where pieces start: at texts, at a blank and around a line end before something visible, and at punctuation
        behind a letter or digit. All of these start a word for the tokenizer."""
        cut = np.zeros(len(data), dtype=bool)
        shown = np.zeros(len(data), dtype=bool)
        shown[:-1] = ~white[1:]
        shown[bounds[1:][np.diff(bounds) > 0] - 1] = False
        cut[shown & (data == 0x20)] = True
        lines = np.flatnonzero(shown & (data == 0x0A))
        cut[lines] = True
        cut[lines + 1] = True
        cut[1:] |= PLAIN[data[:-1]] & MARKS[data[1:]]
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text and the end id, as little-endian unsigned 32-bit numbers; a null text is empty."""
        data, bounds = rolling.flat(texts)
        whole = self._whole(texts, data) if len(data) else []
        if len(whole) == len(texts) or not len(data):
            return [x.tobytes() + self.end for x in self._ids([x or "" for x in texts.to_pylist()])]
        white = _white(data)
        starts = self._cuts(data, bounds, white)
        ends = np.concatenate((starts[1:], [len(data)]))
        rows = self._rows(data, starts, ends, white)
        begins, counts = self.known.places[:, rows]
        every = _gathered(self.known.ids, begins, counts)
        edges = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, bounds)].tolist()
        out = [every[a:b].tobytes() + self.end for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for i, x in zip(whole.tolist(), self._ids([texts[i].as_py() or "" for i in whole.tolist()]), strict=True):
            out[i] = x.tobytes() + self.end
        return out


@cache
def encoder(name: str = TOKENIZER, end: int = END) -> Encoder:
    """One encoder per worker. ``name``: a file of the public tokenizers, or a path."""
    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Encoder(name, end)


def encoded(part: pa.RecordBatch, name: str, end: int) -> list[bytes]:
    return encoder(name, end).encode(part.column("text"))
