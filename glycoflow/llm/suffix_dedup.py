"""Suffix-array dedup on bytes, or on words.

Only windows whose winnowed anchor occurs elsewhere can repeat (runs.py). Runs that are equal as a whole are settled by
that. The rest, one text per different content, is dealt to shards by anchor; each shard sorts its suffixes
(suffixes.py) and finds the windows that occur twice in it. An anchor with very many contents is dealt over several
shards: their sorted lists of different windows are merged by binary search, by 128-bit hash. A shard writes a word as the four bytes
of its number among the shard's words, so that one suffix array serves both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glycoflow.llm import base, rolling, runs, suffixes
from glycoflow.llm.substring import _lists, spread
from glycoflow.llm.workers import frugal

LENGTH, GRAM = 400, 200
#: Bytes of text in one suffix array.
SHARD_BYTES = 2 << 20
FOUND = "told boolean, high long, low long, shard long, doc_id long, first long, n long"
OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary"
FOUND_NAMES = ["told", "high", "low", "shard", "doc_id", "first", "n"]


def _rows(told: bool, **columns: np.ndarray) -> pa.RecordBatch:
    size = len(columns["doc_id"])
    arrays = [pa.array(np.full(size, told))]
    arrays += [pa.array(columns.get(name, np.zeros(size, dtype=np.int64)), pa.int64()) for name in FOUND_NAMES[1:]]
    return pa.RecordBatch.from_arrays(arrays, names=FOUND_NAMES)


def _ranges(body: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in a row as ranges. Each stays in one body, as the bits for its length are those of a run."""
    new = np.flatnonzero(np.concatenate(([True], (body[1:] != body[:-1]) | (first[1:] != first[:-1] + 1))))
    return doc[new], first[new], np.diff(np.concatenate((new, [len(doc)])))


def _coded(bodies: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Bodies of words with four bytes a word, all words' numbers, and the words before each body."""
    flat, bounds = rolling.flat(pa.array(bodies, pa.binary()))
    starts, ends, cuts = rolling.words(flat, bounds)
    hashes = rolling.word_hashes(flat, starts, ends, rolling.BASES[0])
    _, number = np.unique(hashes, return_inverse=True)
    # Digits stay below the mark between bodies.
    digits = np.stack([number // 200**k % 200 for k in range(4)], axis=1).astype(np.uint8)
    return [digits[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], hashes, cuts


def _in_shard(rows: dict[str, np.ndarray], bodies: list[bytes], length: int, unit: str) -> Iterator[pa.RecordBatch]:
    """Repeated windows of one shard, as ranges; and of wide anchors all different windows, by hash."""
    if unit == "word":
        coded, values, cuts = _coded(bodies)
        yield from _repeats(rows, coded, length, 4, lambda base, body, at: (rolling.prefix_sums(values, base), cuts[body] + at))
        return

    def bytewise(base: int, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, bounds = rolling.flat(pa.array(bodies, pa.binary()))
        return rolling.prefix_sums(flat.astype(np.uint64) + np.uint64(1), base), bounds[body] + at

    yield from _repeats(rows, bodies, length, 1, bytewise)


def _repeats(rows: dict[str, np.ndarray], bodies: list[bytes], length: int, size: int, sums_of: Callable) -> Iterator[pa.RecordBatch]:
    """Of bodies whose values take ``size`` bytes each. ``sums_of`` tells prefix sums and places of values by body."""
    data, starts = suffixes.joined(bodies)
    counts = rows["n"]
    order = suffixes.suffix_array(data, length * size)
    common = suffixes.common_prefixes(data, order, starts, counts * size, length * size)
    body = np.repeat(np.arange(len(starts)), counts)
    inner = spread(np.zeros(len(counts), dtype=np.int64), counts)
    at = starts[body] + size * inner
    doc, first = rows["doc_id"][body], rows["first"][body] + inner
    class_of = np.empty(len(data), dtype=np.int32)
    class_of[order] = np.cumsum(common[order] < length * size, dtype=np.int32)
    del order, common
    classes = class_of[at]
    told = np.bincount(classes)[classes] > 1
    if told.any():
        d, f, n = _ranges(body[told], doc[told], first[told])
        yield _rows(True, doc_id=d, first=f, n=n)
    ask = np.flatnonzero(rows["wide"][body])
    if len(ask):
        ask = ask[np.unique(classes[ask], return_index=True)[1]]
        hashes = []
        for b in rolling.BASES:
            sums, where = sums_of(b, body[ask], inner[ask])
            hashes.append(rolling.stretch_hashes(sums, where, where + length, b).view(np.int64))
        shard = np.full(len(ask), rows["shard"][0])
        yield _rows(False, high=hashes[0], low=hashes[1], shard=shard, doc_id=doc[ask], first=first[ask], n=np.ones(len(ask), dtype=np.int64))


@frugal
def _shards(batches: Iterator[pa.RecordBatch], length: int, most: int, unit: str) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket. A shard holds whole buckets, but for those that alone exceed its size: these become wide."""
    gathered: list[tuple] = []
    size = 0
    last = None
    cut = None

    def flushed(more: bool) -> Iterator[pa.RecordBatch]:
        names = ("bucket", "doc_id", "first", "n", "wide")
        rows = {k: np.array([g[i] for g in gathered]) for i, k in enumerate(names)}
        rows["wide"] = rows["wide"] | np.isin(rows["bucket"], [b for b in (cut, last if more else None) if b is not None])
        rows["shard"] = np.full(len(gathered), hash((int(rows["bucket"][0]), int(rows["doc_id"][0]), int(rows["first"][0]))))
        yield from _in_shard(rows, [g[5] for g in gathered], length, unit)

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("bucket", "doc_id", "first", "n", "wide", "body")]
        for row in zip(*columns, strict=True):
            if gathered and (size >= most and row[0] != last or size >= 2 * most):
                more = row[0] == last
                yield from flushed(more)
                cut = last if more else None
                gathered, size = [], 0
            gathered.append(row)
            last = row[0]
            size += len(row[5]) + suffixes.GAP
    if gathered:
        yield from flushed(False)


@frugal
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes on what shards have told; of the windows asked for, those that two shards have."""
    kept = []
    for batch in batches:
        told = batch.column("told").to_numpy(zero_copy_only=False)
        if told.any():
            yield batch.filter(pa.array(told))
        if not told.all():
            kept.append([batch.column(k).to_numpy()[~told] for k in ("high", "low", "shard", "doc_id", "first")])
    if not kept:
        return
    high, low, shard, doc, first = (np.concatenate(x) for x in zip(*kept, strict=True))
    keys = np.stack((high, low), axis=1).astype(">i8").tobytes()
    keys = np.frombuffer(keys, dtype="V16").view("S16")
    # One sorted list per shard; lists are merged two by two, each entry finding its place by binary search.
    lists = []
    by_shard = np.argsort(shard, kind="stable")
    for rows in np.split(by_shard, np.flatnonzero(np.diff(shard[by_shard])) + 1):
        rows = rows[np.argsort(keys[rows], kind="stable")]
        lists.append((keys[rows], rows))
    twice = np.zeros(len(keys), dtype=bool)
    while len(lists) > 1:
        merged = []
        for (a, a_rows), (b, b_rows) in zip(lists[::2], lists[1::2], strict=False):
            left, right = np.searchsorted(a, b, side="left"), np.searchsorted(a, b, side="right")
            hit = np.flatnonzero(right > left)
            twice[b_rows[hit]] = True
            twice[a_rows[spread(left[hit], (right - left)[hit])]] = True
            merged.append((np.insert(a, right, b), np.insert(a_rows, right, b_rows)))
        lists = merged + lists[len(lists) - len(lists) % 2 :]
    if twice.any():
        yield _rows(True, doc_id=doc[twice], first=first[twice], n=np.ones(int(twice.sum()), dtype=np.int64))


@frugal
def _bodies(batches: Iterator[pa.RecordBatch], length: int, unit: str) -> Iterator[pa.RecordBatch]:
    """The text of each run of a document."""
    for batch in batches:
        columns: dict[str, list] = {k: [] for k in ("bucket", "doc_id", "first", "n", "wide", "body")}
        for doc, text, members in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("members").to_pylist(), strict=True):
            data = text.as_py().encode()
            edges = _edges(data, unit)
            for m in members:
                last = m["first"] + m["n"] + length - 2
                columns["doc_id"].append(doc)
                columns["body"].append(data[edges[0][m["first"]] : edges[1][last]] if edges else data[m["first"] : last + 1])
                for k in ("bucket", "first", "n", "wide"):
                    columns[k].append(m[k])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)], names=list(columns))


def _edges(data: bytes, unit: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Starts and ends of words, where these are what windows are made of."""
    if unit != "word":
        return None
    return rolling.words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))[:2]


@frugal
def _cut(batches: Iterator[pa.RecordBatch], length: int, unit: str, whole_characters: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept", pa.binary())])
    for batch in batches:
        rows = []
        for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text"), _lists(batch.column("found"), batch), strict=True):
            text = text.as_py()
            data = text.encode() if text is not None else b""
            if not len(found):
                rows.append((doc, len(data), 0, [], data))
                continue
            edges = _edges(data, unit)
            at = spread(found >> 12, found & 4095)
            gone = rolling.covered(at, length, len(edges[0]) if edges else len(data))
            if edges:
                # A word goes with the white space behind it.
                widths = np.diff(np.concatenate((edges[0], [len(data)])))
                gone = np.concatenate((np.zeros(edges[0][0], dtype=bool), np.repeat(gone, widths)))
            elif whole_characters:
                character = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80) - 1
                gone = (np.bincount(character, gone) > 0)[character]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
            spans = [{"start": a, "length": b - a} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            rows.append((doc, len(data), int(gone.sum()), spans, np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = runs.HOT, shard_bytes: int = SHARD_BYTES, whole_characters: bool = False, unit: str = "byte"
) -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts elsewhere, in any document.

    With ``unit="word"``, remove every word, and the white space behind it, that ``length`` words in a row cover which also
    start elsewhere; words are runs of bytes other than ASCII white space.

    All occurrences go, the first one as well. Texts are UTF-8; a null text is empty. Rows without doc_id are left
    out; of rows with one doc_id the greatest text counts. Columns besides doc_id and text are ignored.

    Returns doc_id, n_bytes, n_removed, spans (maximal removed runs, in bytes) and kept (the remaining bytes). Characters
    may be cut, unless ``whole_characters`` asks that one whose bytes are not all kept goes as a whole.
    """
    texts = base.by_document(docs)
    seeds = runs.seeds(docs, texts, unit, gram, length, hot)
    member = F.struct("bucket", "first", "n", "wide")
    members = seeds.where("not earlier and not alone").groupBy("doc_id").agg(F.collect_list(member).alias("members"))
    bodies = texts.join(members, "doc_id").mapInArrow(lambda it: _bodies(it, length, unit), "bucket long, doc_id long, first long, n long, wide boolean, body binary")
    dealt = bodies.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "first")
    found = dealt.mapInArrow(lambda it: _shards(it, length, shard_bytes, unit), FOUND)
    key = F.when(F.col("told"), F.hash("doc_id", "first")).otherwise(F.hash("high"))
    merged = found.repartition(key).mapInArrow(_merged, FOUND)
    whole = seeds.where("copies > 1")
    repeated = whole.select("doc_id", "first", "n").union(merged.select("doc_id", "first", "n"))
    of_document = repeated.groupBy("doc_id").agg(F.collect_list(F.shiftleft("first", 12).bitwiseOR(F.col("n"))).alias("found"))
    marked = texts.join(of_document, "doc_id", "left").select("doc_id", "text", "found")
    return marked.mapInArrow(lambda it: _cut(it, length, unit, whole_characters), OUT)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(base.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same by comparing all windows of 400 bytes, as hexadecimal text.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM d, unnest(range(0, n - 399)) AS t(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
heads AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS head FROM again),
numbered AS (SELECT doc_id, i, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM heads),
spans AS (SELECT doc_id, s, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY doc_id, s),
pieces AS (
  SELECT doc_id, a AS place, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY s), 0) + 1,
         2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY s), 0))) AS piece FROM spans JOIN d USING (doc_id)
  UNION ALL
  SELECT d.doc_id, n, substr(h, 2 * coalesce(m.b, 0) + 1) FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM spans GROUP BY doc_id) m USING (doc_id)
),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY place) AS kept FROM pieces GROUP BY doc_id),
removed AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""
