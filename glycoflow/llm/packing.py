"""Best-two-fit packing of token ids into sequences.

How well documents fit depends on their lengths alone, of which there are as many as a sequence has places. So the
fitting runs over the histogram of lengths: it fills a sequence greedily, largest first, then replaces its smallest
document by the two unpacked ones that fill the expanded gap best, and repeats that filling while the histogram lasts.
The result is a list of fillings of bounded size. Each piece finds its place from its rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glycoflow.llm import base, rolling, tokens
from glycoflow.llm.workers import encoding, frugal

SIZE = 1024
#: Bytes of text that are encoded at once; the executor has to hold their arrays for every core.
TEXT_BYTES = 1 << 19
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long, ids binary"


def fill(counts: np.ndarray, size: int) -> list[int]:
    """One sequence: the lengths that fill it, by best two fit. ``counts`` by length, from 0 to ``size``."""
    left = counts.copy()
    gap, filling = size, []
    while gap:
        some = np.flatnonzero(left[1 : gap + 1])
        if not len(some):
            break
        length = int(some[-1]) + 1
        times = min(int(left[length]), gap // length)
        filling += [length] * times
        left[length] -= times
        gap -= length * times
    if gap and len(filling) > 1:
        smallest = filling[-1]
        room = gap + smallest
        have = np.flatnonzero(left[1:room]) + 1
        if len(have):
            # For each first document the largest second one that still fits; itself only where there are two.
            second = have[np.maximum(np.searchsorted(have, room - have, side="right") - 1, 0)]
            fits = (have + second <= room) & ((second != have) | (left[have] > 1))
            lower = np.searchsorted(have, have) - 1
            instead = ~fits & (second == have) & (lower >= 0)
            second = np.where(instead, have[np.maximum(lower, 0)], second)
            total = np.where(fits | instead, have + second, 0)
            best = int(np.argmax(total))
            if smallest < total[best] <= room:
                filling[-1:] = sorted((int(have[best]), int(second[best])), reverse=True)
    return filling


def fillings(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Fillings and how often each is used, until all lengths are packed."""
    counts = counts.astype(np.int64).copy()
    out = []
    while counts[1:].any():
        filling = fill(counts, size)
        used = np.bincount(filling, minlength=size + 1)
        times = int((counts[used > 0] // used[used > 0]).min())
        counts -= used * times
        out.append((filling, times))
    return out


def places(plan: list[tuple[list[int], int]], size: int) -> dict[str, np.ndarray]:
    """By length and rank: where a row of pieces goes. Rows are sorted by key, length * 2**44 + first rank."""
    used = np.zeros(size + 1, dtype=np.int64)
    rows, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for length in filling:
            rows.append(((length << 44) + int(used[length]), sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return {"key": table[:, 0], "sequence": table[:, 1], "offset": table[:, 2]}


@encoding
def _pieces(batches: Iterator[pa.RecordBatch], size: int, name: str, end: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    seen = [0] * (size + 1)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"]
    for batch in batches:
        for part in rolling.batches(batch, "text", TEXT_BYTES):
            rows = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), tokens.encoded(part, name, end), strict=True):
                total = len(ids) // 4
                stop = total - (total - 1) // size * size
                start = piece = 0
                while start < total:
                    length = stop - start
                    some = ids[4 * start : 4 * stop]
                    rows.append((doc, piece, start, length, zlib.crc32(some), task, seen[length], some if keep_ids else None))
                    seen[length] += 1
                    start, stop, piece = stop, stop + size, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def packed(docs: DataFrame, size: int = SIZE, name: str = tokens.TOKENIZER, end: int = tokens.END, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` ids.

    A document is its ids and the end id. A longer one is cut: its first piece takes what is left over, the others are
    full. Every row is a document, also one without or with a repeated doc_id; a null text is empty. Other columns are
    ignored.

    Returns per piece doc_id, piece, start (ids of its document before it), length, ids_crc32, sequence_id and offset;
    and the ids themselves with ``keep_ids``.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = base.kept_table(rows.mapInArrow(lambda it: _pieces(it, size, name, end, keep_ids), PIECES))
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # One row per length, at most ``size`` of them.
    histogram = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size + 1, dtype=np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    where = places(fillings(counts, size), size)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(ranks, ["length", "task"]).withColumn("nth", F.col("nth") + F.col("before"))

    @frugal
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            row = np.searchsorted(where["key"], (length << 44) + rank, side="right") - 1
            sequence = where["sequence"][row] + rank - (where["key"][row] & ((1 << 44) - 1))
            columns = [batch.column(k) for k in kept] + [pa.array(sequence), pa.array(where["offset"][row])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return ranked.select(*kept, "nth").mapInArrow(placed, schema)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(base.table(spark, sf_dir, "documents"))
