"""Substring dedup on words: seed and extend.

Seeds are winnowed anchors (k-grams of words) that documents share; each seed carries the run of windows around it.
A run whose whole content starts earlier repeats as it stands. Elsewhere the seed is extended word by word to both
sides, as far as the length threshold: each window around it meets the earliest window with the same words. Repeated
windows in a row make a maximal repeat, whose words go.

No pairs are formed: windows meet their earliest equal in one aggregate with partial minima, so a passage shared by
thousands of documents costs one row per occurrence. Equality of windows is that of two independent 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glycoflow.llm import base, rolling, runs

LENGTH, GRAM = 20, 8
OUT = "doc_id long, n_words long, n_removed long, n_repeats long, repeats array<struct<start:long,length:long>>, kept string"
WINDOWS = "high long, low long, doc_id long, start long"


def _lists(column: pa.Array, part: pa.RecordBatch) -> list[np.ndarray]:
    """The long values of each row; a null list is empty."""
    return [np.asarray(x if x is not None else [], dtype=np.int64) for x in column.to_numpy(zero_copy_only=False)]


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, … of each run."""
    return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


def _extended(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows around the seeds of each document, by two hashes."""
    for batch in batches:
        for part in rolling.batches(batch, "text", runs.TEXT_BYTES):
            data, bounds = rolling.flat(part.column("text"))
            starts, ends, cuts = rolling.words(data, bounds)
            at = []
            for before, seeds in zip(cuts[:-1], _lists(part.column("open"), part), strict=True):
                if len(seeds):
                    at.append(spread(before + (seeds >> 10), seeds & 1023))
            if not at:
                continue
            at = rolling.distinct(np.concatenate(at))
            number = np.searchsorted(cuts, at, side="right") - 1
            columns = []
            for b in rolling.BASES:
                hashes = rolling.windows(rolling.word_hashes(data, starts, ends, b), length, b)
                columns.append(hashes[at].view(np.int64))
            columns += [part.column("doc_id").to_numpy()[number], at - cuts[number]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["high", "low", "doc_id", "start"])


def _removed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_repeats", pa.int64()),
                        ("repeats", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept", pa.string())])
    for batch in batches:
        rows = []
        columns = [_lists(batch.column(name), batch) for name in ("whole", "open", "firsts")]
        for doc, text, whole, opened, firsts in zip(batch.column("doc_id").to_pylist(), batch.column("text"), *columns, strict=True):
            text = text.as_py()
            words = text.encode().split() if text is not None else []
            if not len(whole) + len(opened):
                rows.append((doc, len(words), 0, 0, [], b" ".join(words).decode()))
                continue
            again = np.zeros(len(words), dtype=bool)
            again[spread(opened >> 10, opened & 1023)] = True
            again[firsts] = False
            again[spread(whole >> 10, whole & 1023)] = True
            gone = rolling.covered(np.flatnonzero(again), length, len(words))
            edges = np.flatnonzero(np.diff(np.concatenate(([False], again, [False])).astype(np.int8)))
            spans = [{"start": int(a), "length": int(b - a + length - 1)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode()
            rows.append((doc, len(words), int(gone.sum()), len(spans), spans, kept))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = runs.HOT) -> DataFrame:
    """Remove every word that a window of ``length`` words covers whose sequence also starts earlier.

    Earlier: in a document with a smaller doc_id, or before in the same one. Words are runs of bytes other than ASCII
    white space. Null and empty texts have no words. Rows without doc_id are left out; of rows with one doc_id the
    greatest text counts. Columns besides doc_id and text are ignored.

    Returns doc_id, n_words, n_removed, n_repeats, repeats (start and length of the maximal repeats, which may
    overlap) and kept (the remaining words joined by one blank).
    """
    texts = base.by_document(docs)
    seeds = runs.seeds(docs, texts, "word", gram, length, hot).where("earlier or not alone")
    run = F.shiftleft("first", 10).bitwiseOR(F.col("n"))
    of_document = seeds.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("earlier"), run)).alias("whole"),
        F.collect_list(F.when(~F.col("earlier"), run)).alias("open"),
    )
    seeded = texts.join(of_document, "doc_id")
    extended = seeded.select("doc_id", "text", "open").mapInArrow(lambda it: _extended(it, length), WINDOWS)
    earliest = extended.groupBy("high", "low").agg(F.min(F.struct("doc_id", "start")).alias("at"))
    firsts = earliest.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list("at.start").alias("firsts"))
    marked = texts.join(of_document, "doc_id", "left").join(firsts, "doc_id", "left")
    return marked.select("doc_id", "text", "whole", "open", "firsts").mapInArrow(lambda it: _removed(it, length), OUT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(base.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_repeats")


#: The same by comparing all windows; each window is the text of its words.
SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i + 1 : i + 20], ' ') AS seq
  FROM w, unnest(range(0, len(ws) - 19)) AS t(i)
),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1
),
repeats AS (
  SELECT doc_id, count(*) AS n_repeats FROM (
    SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again) WHERE before IS NULL OR before < i - 1 GROUP BY doc_id
),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM again, range(0, 20) AS r(k)),
removed AS (SELECT doc_id, count(*) AS n_removed, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(ws[p + 1], ' ' ORDER BY p) AS kept FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS p FROM w) x
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_repeats, 0)::BIGINT AS n_repeats
FROM w LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN repeats USING (doc_id)
"""
