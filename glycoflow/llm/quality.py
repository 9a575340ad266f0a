"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

A document becomes 22 statistics. Random Fourier features of them approximate a Gaussian kernel. Every task adds up its
part of the normal equations, whose size is fixed, and the parts are summed by rows; the driver solves them. Each half
of the labelled rows is scored by the model of the other half, and isotonic regression over a fixed grid of these
scores turns scores into chances. The final model is that of both halves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glycoflow.llm import base, rolling
from glycoflow.llm.workers import frugal

FEATURES, RIDGE, SEED = 384, 1.0, 7
#: Width of the kernel in standard deviations of all statistics together.
WIDTH = 6.0
#: Grid of the calibration.
STEPS, LOW, HIGH = 1000, -1.0, 2.0
STATISTICS = 22
#: A held-out third of the documents is never learned from.
FOLDS, HELD_OUT = 3, 1

CLASSES = np.zeros(256, dtype=np.int64)
for _number, _characters in enumerate(("#*$%&|<>@^~=+_\\/{}[]", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".!?", ",;:-\"'()", "\n", " \t\r\x0b\x0c"), start=1):
    CLASSES[[ord(c) for c in _characters]] = _number
CLASSES[128:] = 8


def statistics(part: pa.RecordBatch) -> np.ndarray:
    """One row of statistics per text; all zero where there is no text."""
    data, bounds = rolling.flat(part.column("text"))
    rows = len(bounds) - 1
    sizes = np.diff(bounds)
    starts, ends, cuts = rolling.words(data, bounds)
    n_words = np.diff(cuts)
    out = np.zeros((rows, STATISTICS))
    owner = np.repeat(np.arange(rows), sizes)
    size = np.maximum(sizes, 1)
    kinds = np.bincount(owner * 9 + CLASSES[data], minlength=rows * 9).reshape(rows, 9)
    out[:, 0] = np.log1p(sizes)
    out[:, 1] = np.log1p(n_words)
    out[:, 2:10] = np.sqrt(kinds[:, 1:] / size[:, None])
    lengths = (ends - starts).astype(np.float64)
    word_owner = np.repeat(np.arange(rows), n_words)
    words = np.maximum(n_words, 1)
    mean = np.bincount(word_owner, lengths, minlength=rows) / words
    out[:, 10] = np.log1p(mean)
    out[:, 11] = np.log1p(np.sqrt(np.maximum(np.bincount(word_owner, lengths**2, minlength=rows) / words - mean**2, 0)))
    histogram = np.bincount(owner * 256 + data, minlength=rows * 256).reshape(rows, 256) / size[:, None]
    out[:, 12] = -(histogram * np.log2(np.where(histogram > 0, histogram, 1))).sum(axis=1)
    out[:, 13] = histogram.max(axis=1)
    hashes = rolling.word_hashes(data, starts, ends, rolling.BASES[0])
    grams = {2: rolling.windows(hashes, 2, rolling.BASES[0]), 5: rolling.windows(hashes, 5, rolling.BASES[0])}
    line_ends = np.flatnonzero(data == 10)
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[bounds[:-1][sizes > 0]] = True
    begins[line_ends + 1] = True
    line_starts = np.flatnonzero(begins[:-1])
    line_stops = np.minimum(np.concatenate((line_starts[1:], [len(data)])), len(data))
    lines = rolling.stretch_hashes(rolling.prefix_sums(data.astype(np.uint64) + np.uint64(1), rolling.BASES[1]), line_starts, line_stops, rolling.BASES[1])
    line_cuts = np.searchsorted(line_starts, bounds)
    ends_last = data[ends - 1] if len(ends) else data[:0]
    odd = np.bincount(word_owner, CLASSES[ends_last] == 1, minlength=rows) / words
    for i in np.flatnonzero(n_words):
        a, b = cuts[i], cuts[i + 1]
        n = b - a
        _, counts = np.unique(hashes[a:b], return_counts=True)
        out[i, 14] = len(counts) / n
        out[i, 15] = counts.max() / n
        out[i, 16] = np.log(len(counts)) / np.log(n + 1)
        for k, gram in grams.items():
            if n > k:
                place = 17 if k == 2 else 18
                out[i, place] = 1 - len(rolling.distinct(gram[a : b - k + 1])) / (n - k + 1)
        first, last = line_cuts[i], line_cuts[i + 1]
        count = last - first
        out[i, 19] = 1 - len(rolling.distinct(lines[first:last])) / max(1, count)
        out[i, 20] = np.log1p(n / max(1, count))
    out[:, 21] = odd
    return out


@frugal
def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rolling.batches(batch, "text", 1 << 18):
            values = statistics(part)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), STATISTICS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "statistics"])


def described(docs: DataFrame) -> DataFrame:
    """doc_id, statistics and fold (crc32 of doc_id as text, modulo 3)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_described, "doc_id long, statistics array<double>")
    return out.withColumn("fold", (F.crc32(F.col("doc_id").cast("string")) % FOLDS).cast("int"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("statistics").flatten().to_numpy().reshape(-1, STATISTICS)


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    grid: np.ndarray
    chances: np.ndarray

    def raw(self, values: np.ndarray) -> np.ndarray:
        return fourier(values, self.center, self.scale) @ self.weights

    def score(self, values: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(values), self.grid, self.chances), 0.0, 1.0)


def fourier(values: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    random = np.random.default_rng(SEED)
    directions = random.normal(size=(STATISTICS, FEATURES)) / WIDTH
    shifts = random.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((values - center) / scale, -8, 8)
    waves = np.cos(x @ directions + shifts) * np.sqrt(2 / FEATURES)
    return np.concatenate((waves, np.ones((len(values), 1))), axis=1)


def _equations(rows: DataFrame, center: np.ndarray, scale: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Left and right side of the normal equations of each fold, summed over all tasks."""
    width = FEATURES + 1

    @frugal
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column("fold").to_numpy()
            z = fourier(_matrix(batch), center, scale)
            right = batch.column("quality").to_numpy().astype(np.float64)[:, None]
            for fold in np.unique(folds).tolist():
                some = z[folds == fold]
                both = some.T @ np.concatenate((some, right[folds == fold]), axis=1)
                sums[fold] = sums.get(fold, 0) + both
        yield from as_rows(sums)

    def as_rows(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for fold, matrix in sums.items():
            lists = pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), width + 1).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([fold] * width, pa.int32()), pa.array(np.arange(width, dtype=np.int32)), lists], names=["fold", "i", "part"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            values = batch.column("part").flatten().to_numpy().reshape(-1, width + 1)
            for key, value in zip(zip(batch.column("fold").to_pylist(), batch.column("i").to_pylist(), strict=True), values, strict=True):
                sums[key] = sums[key] + value if key in sums else value.copy()
        if sums:
            lists = pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), lists], names=["fold", "i", "part"])

    schema = "fold int, i int, part array<double>"
    # Two folds of 385 rows of fixed width, whatever the input.
    rows = rows.mapInArrow(parts, schema).repartition("fold", "i").mapInArrow(summed, schema).collect()
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for fold in {r["fold"] for r in rows}:
        matrix = np.zeros((width, width + 1))
        for r in rows:
            if r["fold"] == fold:
                matrix[r["i"]] = r["part"]
        out[fold] = (matrix[:, :-1], matrix[:, -1])
    return out


def _solved(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    penalty = np.full(len(right), RIDGE)
    penalty[-1] = 1e-6
    return np.linalg.solve(left + np.diag(penalty), right)


def isotonic(values: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: where the pools lie and their means, both ascending."""
    pools: list[list[float]] = []
    for x, s, n in zip(values.tolist(), sums.tolist(), counts.tolist(), strict=True):
        pools.append([x * n, s, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(features: DataFrame, labels: DataFrame) -> Model | None:
    """Learn from the labelled rows outside the held-out fold; None if there are none.

    Of several labels of a document the greatest counts; null labels do not.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    rows = base.kept_table(features.where(F.col("fold") != HELD_OUT).join(marks, "doc_id").select("statistics", "fold", F.col("quality").cast("int").alias("quality")))
    at = [F.col("statistics")[i] for i in range(STATISTICS)]
    moments = rows.agg(*(F.avg(c) for c in at), *(F.stddev_pop(c) for c in at)).first()
    if moments[0] is None:
        return None
    center = np.array(moments[:STATISTICS])
    scale = np.maximum(np.array(moments[STATISTICS:]), 1e-3)
    equations = _equations(rows, center, scale)
    weights = {fold: _solved(*e) for fold, e in equations.items()}
    final = _solved(sum(e[0] for e in equations.values()), sum(e[1] for e in equations.values()))
    # The other fold's model; with one fold alone, its own.
    other = {fold: next((w for f, w in weights.items() if f != fold), weights[fold]) for fold in weights}

    @frugal
    def gridded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = fourier(_matrix(batch), center, scale)
            folds = batch.column("fold").to_numpy()
            raw = np.zeros(len(folds))
            for fold, w in other.items():
                raw[folds == fold] = z[folds == fold] @ w
            cell = np.round((np.clip(raw, LOW, HIGH) - LOW) / (HIGH - LOW) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("quality")], names=["cell", "quality"])

    # At most STEPS + 1 rows.
    cells = rows.mapInArrow(gridded, "cell int, quality int").groupBy("cell").agg(F.sum("quality").alias("s"), F.count("*").alias("n")).orderBy("cell").collect()
    values = LOW + np.array([c["cell"] for c in cells]) * (HIGH - LOW) / STEPS
    grid, chances = isotonic(values, np.array([c["s"] for c in cells], dtype=float), np.array([c["n"] for c in cells], dtype=float))
    return Model(center, scale, final, grid, chances)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document: doc_id, held_out, score and predicted.

    Every row is a document, also one of a repeated doc_id or without one; a null text is empty, and empty texts are
    scored like others. Without a label to learn from, all scores are 0.5. Other columns are ignored.
    """
    features = base.kept_table(described(docs))
    model = fit(features, labels)

    @frugal
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_matrix(batch)) if model is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), pa.array(scores)], names=["doc_id", "fold", "score"])

    out = features.select("doc_id", "fold", "statistics").mapInArrow(apply, "doc_id long, fold int, score double")
    return out.select("doc_id", F.coalesce(F.col("fold") == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that score ``threshold`` or more, each judged by its own text, with all their columns.

    As in ``scored``, rows without doc_id and of a repeated one are documents of their own. Statistics are taken once to learn and
    once more to judge, rather than kept beside a copy of all texts: texts are neither shuffled nor written, and nothing is joined back.
    """
    base.ready(docs.sparkSession)
    model = fit(described(docs), labels)

    @frugal
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rolling.batches(batch, "text", 1 << 18):
                scores = model.score(statistics(part)) if model is not None else np.full(part.num_rows, 0.5)
                yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(judged, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "labels"))
