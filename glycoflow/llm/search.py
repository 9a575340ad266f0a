"""Ranked lexical search by hashed max-sketches.

A document's sketch has one coordinate per bucket of a term hash, with the largest impact of the document's terms in
that bucket. A query looks its terms' buckets up in all sketches of a batch at once (one matrix product); the sums are
upper bounds of the scores. Each document has two sketches, by other bits of the hash, and the lower bound of both counts. Documents are then scored exactly in descending order of their bounds, until the bound
falls below the lowest of the best scores so far. Each task keeps its best documents per item, which are merged.

Documents are read twice, for the statistics and for the search, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glycoflow.llm import base, rolling

TOP = 50
#: Coordinates of a sketch, and sketches of one matrix product.
WIDTH, ROWS = 1024, 2048
#: Lowest bit of the hash that the buckets of each sketch go by.
SHIFTS = (0, 32)
#: Documents that are scored between two looks at the threshold.
STEP = 64
#: Bytes of query text that are searched in one pass over the documents; a longer item alone is one block.
BLOCK_BYTES = 2 << 20
#: Best lists of one item are merged in as many parts first.
PARTS = 64
STATS = "term long, n long"
FOUND = "item_id long, doc_id long, score long"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
SEPARATORS = np.zeros(256, dtype=bool)
for _first, _last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    SEPARATORS[_first : _last + 1] = True


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term, and per text the number of terms before it (n + 1 values)."""
    data, bounds = rolling.flat(texts)
    starts, ends, cuts = rolling.words(data, bounds, SEPARATORS)
    return rolling.word_hashes(LOWER[data], starts, ends, rolling.BASES[0]), cuts


@dataclass
class Queries:
    """A block of items: all different terms, ascending, and the places of each item's terms among them."""

    items: list[int]
    terms: np.ndarray
    places: list[np.ndarray]


@dataclass
class Statistics:
    """Number of documents with a term, all their terms, and the weight of every query term."""

    documents: int
    length: int
    weights: np.ndarray


def queries_of(rows: list) -> Queries:
    hashes, cuts = terms(pa.array([r["text"] for r in rows], pa.string()))
    different = rolling.distinct(hashes)
    places = [np.unique(np.searchsorted(different, hashes[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return Queries([r["item_id"] for r in rows], different, places)


def _places(different: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are among the different ones, and where."""
    if not len(different):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(different, hashes), len(different) - 1)
    hit = np.flatnonzero(different[at] == hashes)
    return hit, at[hit]


def _counted(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[pa.RecordBatch]:
    """Documents per query term; as terms -1 and -2 the documents with a term and all their terms."""
    size = len(queries.terms)
    found = np.zeros(size, dtype=np.int64)
    documents = length = 0
    for batch in batches:
        for part in rolling.batches(batch, "text"):
            hashes, cuts = terms(part.column("text"))
            n = np.diff(cuts)
            documents += int((n > 0).sum())
            length += int(n.sum())
            hit, at = _places(queries.terms, hashes)
            number = np.searchsorted(cuts, hit, side="right") - 1
            found += np.bincount(rolling.distinct(number * size + at) % max(size, 1), minlength=size)
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((at, [-1, -2])), pa.int64()), pa.array(np.concatenate((found[at], [documents, length])), pa.int64())], names=["term", "n"]
    )


def statistics(docs: DataFrame, queries: Queries) -> Statistics:
    """The driver receives one row per different term of the block, at most."""
    counts = docs.select("text").mapInArrow(lambda it: _counted(it, queries), STATS).groupBy("term").agg(F.sum("n").alias("n"))
    of = {r["term"]: r["n"] for r in counts.collect()}
    documents, length = of.pop(-1, 0), of.pop(-2, 0)
    df = np.zeros(len(queries.terms), dtype=np.int64)
    df[list(of)] = list(of.values())
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    return Statistics(documents, length, weights)


def impacts(tf: np.ndarray, n: np.ndarray, stats: Statistics) -> np.ndarray:
    m = 100 - 50 + 50 * n * stats.documents // stats.length
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def buckets(hashes: np.ndarray, width: int, shift: int) -> np.ndarray:
    return ((hashes >> np.uint64(shift)) % np.uint64(width)).astype(np.int64)


def lookups(queries: Queries, weights: np.ndarray, width: int, shift: int) -> np.ndarray:
    """The matrix that turns sketches into bounds: weights by coordinate and item."""
    out = np.zeros((width, len(queries.items)))
    for item, places in enumerate(queries.places):
        np.add.at(out[:, item], buckets(queries.terms[places], width, shift), weights[places])
    return out


class Best:
    """The highest scores of one item so far, equal ones by doc_id, those without doc_id last."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.scores = np.zeros(0, dtype=np.int64)
        self.docs = np.zeros(0, dtype=np.int64)
        self.known = np.zeros(0, dtype=bool)

    @property
    def threshold(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.top else 1

    def add(self, scores: np.ndarray, docs: np.ndarray, known: np.ndarray) -> None:
        scores, docs, known = (np.concatenate(x) for x in ((self.scores, scores), (self.docs, docs), (self.known, known)))
        order = np.lexsort((docs, ~known, -scores))
        order = order[scores[order] > 0][: self.top]
        self.scores, self.docs, self.known = scores[order], docs[order], known[order]


def _rescored(bounds: np.ndarray, places: np.ndarray, best: Best, keys: np.ndarray, gains: np.ndarray, size: int, docs: np.ndarray, known: np.ndarray) -> int:
    """Score documents exactly by descending bound until the threshold; returns how many were scored."""
    rows = np.flatnonzero(bounds >= best.threshold)
    rows = rows[np.argsort(-bounds[rows], kind="stable")]
    done = 0
    while done < len(rows) and bounds[rows[done]] >= best.threshold:
        some = rows[done : done + STEP]
        wanted = some[:, None] * size + places[None, :]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        scores = np.where(keys[at] == wanted, gains[at], 0).sum(axis=1)
        best.add(scores, docs[some], known[some])
        done += len(some)
    return done


def _searched(batches: Iterator[pa.RecordBatch], queries: Queries, stats: Statistics, top: int, width: int) -> Iterator[pa.RecordBatch]:
    matrices = [lookups(queries, stats.weights, width, shift) for shift in SHIFTS]
    best = [Best(top) for _ in queries.items]
    size = len(queries.terms)
    for batch in batches:
        for part in rolling.batches(batch, "text"):
            for start in range(0, part.num_rows, ROWS):
                rows = part.slice(start, ROWS)
                hashes, cuts = terms(rows.column("text"))
                if not len(hashes):
                    continue
                n = np.diff(cuts)
                number = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((hashes, number))
                new = np.flatnonzero(np.concatenate(([True], (np.diff(number) != 0) | (np.diff(hashes[order]) != 0))))
                tf = np.diff(np.concatenate((new, [len(order)])))
                number, hashes = number[new], hashes[order[new]]
                impact = impacts(tf, n[number], stats)
                bounds = np.full((len(n), len(queries.items)), np.inf)
                for shift, matrix in zip(SHIFTS, matrices, strict=True):
                    sketch = np.zeros(len(n) * width)
                    np.maximum.at(sketch, number * width + buckets(hashes, width, shift), impact)
                    np.minimum(bounds, sketch.reshape(len(n), width) @ matrix, out=bounds)
                hit, at = _places(queries.terms, hashes)
                if not len(hit):
                    continue
                keys, gains = number[hit] * size + at, stats.weights[at] * impact[hit]
                ids = rows.column("doc_id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                docs = ids.fill_null(0).to_numpy()
                for item, places in enumerate(queries.places):
                    if len(places):
                        _rescored(bounds[:, item], places, best[item], keys, gains, size, docs, known)
    for item, b in zip(queries.items, best, strict=True):
        if len(b.scores):
            columns = [pa.array(np.full(len(b.scores), item), pa.int64()), pa.array(b.docs, pa.int64(), mask=~b.known), pa.array(b.scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])


def searched(docs: DataFrame, items: DataFrame, top: int = TOP, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` documents of highest score above 0 for each item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased; equal terms are those of
    equal 64-bit hash. Every row of ``docs`` is a document; one without doc_id is ranked after others of equal score,
    and rows of one doc_id may all be listed. Null and empty texts have no terms. Items without item_id are left out;
    of items with one item_id the greatest text counts. An item that no document matches has no row. Other columns are
    ignored.

    Returns item_id, rank (from 1), doc_id and score.
    """
    base.ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = asked.groupBy("item_id").agg(F.max("text").alias("text")).where("text IS NOT NULL")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("items")).first()
    blocks = max(1, min(-(-size["bytes"] // block_bytes), size["items"]))
    parts = []
    for block in range(blocks):
        queries = queries_of(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect())
        stats = statistics(rows, queries)
        parts.append(rows.mapInArrow(lambda it, q=queries, s=stats: _searched(it, q, s, top, width), FOUND))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    by_score = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    part = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*by_score)
    merged = found.withColumn("place", F.row_number().over(part)).where(F.col("place") <= top)
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*by_score))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op13_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searched(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
#: The same by scoring every document that holds a term.
SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM d) GROUP BY doc_id, term),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s
),
m AS (SELECT doc_id, 50 + (50 * len(ts)::BIGINT * n_docs) // n_terms AS m FROM d, s WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id
),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
