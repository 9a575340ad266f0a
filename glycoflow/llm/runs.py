"""Runs of windows that share a winnowed anchor: the seeds of both repeat removers.

Every window of ``length`` values in one text has an anchor that follows from its content. Windows in a row with the
same anchor make a run. Equal windows have equal anchors, so a window can only repeat where its run's anchor does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycoflow.llm import rolling
from glycoflow.llm.workers import frugal

RUNS = "bucket long, context long, doc_id long, place long"
#: An anchor is hot if it may have this number of runs, and this many times the mean of the counters.
HOT, UNEVEN = 256, 4
#: Counters of runs by anchor. What shares a counter with a hot anchor is dealt like it.
COUNTERS = 1 << 16
#: Windows of one run fit into ten bits.
MOST_WINDOWS = 1023
PLAIN, SPREAD = 0, 1
TEXT_BYTES = 1 << 17


def values_of(data: np.ndarray, bounds: np.ndarray, unit: str, base: int) -> tuple[np.ndarray, np.ndarray]:
    """What windows are made of, one value per byte or per word, and the bounds of the texts."""
    if unit == "byte":
        return data.astype(np.uint64) + np.uint64(1), bounds
    starts, ends, cuts = rolling.words(data, bounds)
    return rolling.word_hashes(data, starts, ends, base), cuts


def placed(first: np.ndarray, count: np.ndarray, mark: int | np.ndarray) -> np.ndarray:
    """First window, number of windows (below 1024) and mark in one number; sorts by first window."""
    return (first << 12) | (count << 2) | mark


def runs_of(values: np.ndarray, bounds: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, text number, first window in the text, number of windows; of every run."""
    at, anchors, grams = rolling.winnowed(values, bounds, gram, length, rolling.BASES[0])
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    new = np.flatnonzero(np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1))))
    first = at[new]
    count = np.diff(np.concatenate((new, [len(at)])))
    sums = rolling.prefix_sums(values, rolling.BASES[1])
    context = rolling.stretch_hashes(sums, first, first + count + length - 1, rolling.BASES[1])
    number = np.searchsorted(bounds, first, side="right") - 1
    return grams[anchors[new]].view(np.int64), context.view(np.int64), number, first - bounds[number], count


def counter_of(anchor: np.ndarray) -> np.ndarray:
    return (rolling.mixed(anchor.view(np.uint64)) & np.uint64(COUNTERS - 1)).astype(np.int64)


@frugal
def _counted(batches: Iterator[pa.RecordBatch], unit: str, gram: int, length: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for part in rolling.batches(batch, "text", TEXT_BYTES):
            values, bounds = values_of(*rolling.flat(part.column("text")), unit, rolling.BASES[0])
            counts += np.bincount(counter_of(runs_of(values, bounds, gram, length)[0]), minlength=COUNTERS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["counter", "n"])


def spread_bits(counts: np.ndarray, hot: int) -> np.ndarray:
    """By counter, the logarithm of the buckets that its anchors are dealt over: 0 for those that are not hot, else so
    many that a bucket gets a quarter of what makes an anchor hot."""
    least = max(hot, UNEVEN * int(counts.sum()) // COUNTERS)
    bits = np.ceil(np.log2(np.maximum(4 * counts / least, 1)))
    return np.where(counts >= least, np.maximum(bits, 1), 0).astype(np.uint8)


def loads(docs: DataFrame, unit: str, gram: int, length: int) -> np.ndarray:
    """Runs of all documents by counter; the driver gets at most as many rows as there are counters."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(lambda it: _counted(it, unit, gram, length), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    out = np.zeros(COUNTERS, dtype=np.int64)
    for row in counted.collect():
        out[row["counter"]] = row["n"]
    return out


def dealt(anchor: np.ndarray, context: np.ndarray, doc: np.ndarray, first: np.ndarray, count: np.ndarray, spread: np.ndarray) -> pa.RecordBatch:
    """Runs with the bucket they go to: that of their anchor, or, where the anchor is hot, one of many."""
    bits = spread[counter_of(anchor)].astype(np.uint64)
    many = bits > 0
    salt = rolling.mixed(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + first.astype(np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))
    apart = rolling.mixed(anchor.view(np.uint64) ^ rolling.mixed((bits << np.uint64(40)) + salt + np.uint64(1))).view(np.int64)
    columns = (np.where(many, apart, anchor), context, doc, placed(first, count, np.where(many, SPREAD, PLAIN)))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["bucket", "context", "doc_id", "place"])


@frugal
def found_runs(batches: Iterator[pa.RecordBatch], unit: str, gram: int, length: int, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rolling.batches(batch, "text", TEXT_BYTES):
            values, bounds = values_of(*rolling.flat(part.column("text")), unit, rolling.BASES[0])
            anchor, context, number, first, count = runs_of(values, bounds, gram, length)
            if len(anchor):
                yield dealt(anchor, context, part.column("doc_id").to_numpy()[number], first, count, spread)


def seeds(docs: DataFrame, texts: DataFrame, unit: str, gram: int, length: int, hot: int = HOT) -> DataFrame:
    """All runs of ``texts``, one row per document of ``docs``, that may repeat, met by anchor.

    Which anchors are hot is known before, from counts over all documents, so that every task deals alike.

    Returns bucket, context, doc_id, first, n, copies (runs with the same content in the bucket), earlier (one of them
    starts earlier), alone (no other content meets this anchor) and wide (runs of this anchor are in other buckets, too).
    """
    if length - gram + 1 > MOST_WINDOWS:
        raise ValueError(f"length may exceed gram by {MOST_WINDOWS - 1} at most")
    spread = spread_bits(loads(docs, unit, gram, length), hot)
    runs = texts.mapInArrow(lambda it: found_runs(it, unit, gram, length, spread), RUNS)
    bucket = Window.partitionBy("bucket")
    content = Window.partitionBy("bucket", "context").orderBy("doc_id", "place")
    every = content.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wide: Column = F.col("place").bitwiseAND(3) == SPREAD
    marked = runs.select(
        "*",
        F.min("context").over(bucket).alias("low"),
        F.max("context").over(bucket).alias("high"),
        F.row_number().over(content).alias("nth"),
        F.count("*").over(every).alias("copies"),
    )
    return marked.select(
        "bucket",
        "context",
        "doc_id",
        F.shiftright("place", 12).alias("first"),
        F.shiftright("place", 2).bitwiseAND(MOST_WINDOWS).alias("n"),
        "copies",
        (F.col("nth") > 1).alias("earlier"),
        ((F.col("low") == F.col("high")) & ~wide).alias("alone"),
        wide.alias("wide"),
    ).where("copies > 1 or not alone")
