"""One very long text, ties of repeated rows and columns of clashing names through every operator on documents; scores by plain numpy."""

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pytest

from glycoflow.llm import base, decontam, frames, lines, minhash, packing, quality, search, substring, suffix_dedup

SF = "/root/testdata/sf0.001"
WORDS = 120_000
LONG = " ".join(f"{i * 7919 % 1_000_003:x}w" for i in range(WORDS))


@pytest.fixture(scope="module")
def rows(spark):
    base.ready(spark)
    data = [(1, LONG), (2, LONG), (2, LONG), (3, "a few words of a short text that stands alone"), (4, None), (None, LONG[:50_000]), (5, LONG + " end")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    names = "bucket context place first n copies earlier alone wide members found open whole firsts key row statistics fold score hash host hashes item item_id seed".split()
    return df.selectExpr("*", "'s' AS source", "'en' AS lang", *(f"'x' AS {n}" for n in names)).repartition(3)


def test_substring(rows):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.without_repeats(rows).collect()}
    assert got == {1: (WORDS, 0), 2: (WORDS, WORDS), 3: (10, 0), 4: (0, 0), 5: (WORDS + 1, WORDS)}


@pytest.mark.parametrize("unit", ["byte", "word"])
def test_suffix(rows, unit):
    length, gram = (400, 200) if unit == "byte" else (50, 20)
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.without_repeats(rows, length, gram, unit=unit).collect()}
    size = len(LONG)
    # A word goes with the white space behind it.
    left = b" end" if unit == "byte" else b"end"
    assert got[1] == got[2] == (size, size, b"") and got[5] == (size + 4, size + 4 - len(left), left)
    assert got[3][1] == got[4][1] == 0


def test_near_duplicates(rows):
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(rows).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}


def test_line_rules_and_decontamination(spark, rows):
    got = {(r.doc_id, r.n_words): r.n_repeat_words for r in lines.judged(rows).collect()}
    assert {k[0]: k[1] for k in got if k[0] in (1, 3, 4, 5)} == {1: WORDS, 3: 10, 4: 0, 5: WORDS + 1}
    item = " ".join(LONG.split()[70_000:70_020])
    bench = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string").selectExpr("*", "1 AS at", "2 AS pair", "3 AS hashes")
    assert {(r.doc_id, r.item_id, r.n_matched) for r in decontam.contaminated(rows, bench).collect()} == {(d, 1, 13) for d in (1, 2, 5)}


def test_tokens(spark, rows):
    pieces = packing.packed(rows).groupBy("doc_id").sum("length").collect()
    written = {r.doc_id: r.n_tokens for r in frames.read_ids(frames.write_ids(rows.where("doc_id <> 2"), base.shared_folder(spark))).collect()}
    assert written[4] == 1 and written[1] > WORDS and written.keys() == {1, 3, 4, 5}
    assert {r.doc_id: r[1] for r in pieces if r.doc_id in written} == written


def test_quality_and_search(spark, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    scores = quality.scored(rows, labels).collect()
    assert len(scores) == 7 and all(0 <= r.score <= 1 for r in scores)
    kept = quality.accepted(rows, labels)
    assert kept.columns == rows.columns
    assert {r.statistics for r in kept.collect()} <= {"x"} and kept.count() == sum(r.predicted for r in scores)
    items = spark.createDataFrame([(9, LONG.split()[5] + " alone")], "item_id long, text string")
    got = [(r.rank, r.doc_id) for r in search.searched(rows, items).orderBy("rank").collect()]
    assert got[0] == (1, 3) and sorted(str(d) for _, d in got[1:]) == ["1", "2", "2", "5", "None"]


def plain_scores(docs, labels):
    """The classifier over whole tables in one place."""
    ids = [d for d, _ in docs]
    x = quality.statistics(pa.RecordBatch.from_arrays([pa.array([t for _, t in docs], pa.string())], names=["text"]))
    fold = np.array([zlib.crc32(str(d).encode()) % 3 for d in ids])
    learned = np.array([d in labels for d in ids]) & (fold != 1)
    y = np.array([labels.get(d, 0) for d in ids], dtype=float)[learned]
    center, scale = x[learned].mean(axis=0), np.maximum(x[learned].std(axis=0), 1e-3)
    rng = np.random.default_rng(7)
    directions = rng.normal(size=(22, 384)) / 6.0
    shifts = rng.uniform(0, 2 * np.pi, 384)
    waves = np.cos(np.clip((x - center) / scale, -8, 8) @ directions + shifts) * np.sqrt(2 / 384)
    z = np.hstack((waves, np.ones((len(x), 1))))

    def ridge(rows, right):
        return np.linalg.solve(rows.T @ rows + np.diag([1.0] * 384 + [1e-6]), rows.T @ right)

    zl, fl = z[learned], fold[learned]
    models = {f: ridge(zl[fl == f], y[fl == f]) for f in (0, 2)}
    raw = np.where(fl == 0, zl @ models[2], zl @ models[0])
    cells = {}
    for r, label in zip(raw, y):
        cells.setdefault(int(np.round((np.clip(r, -1, 2) + 1) / 3 * 1000)), []).append(label)
    pools = []
    for cell in sorted(cells):
        pools.append([(-1 + cell * 3 / 1000) * len(cells[cell]), sum(cells[cell]), len(cells[cell])])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    grid, means = [p[0] / p[2] for p in pools], [p[1] / p[2] for p in pools]

    def between(v):
        at = bisect_right(grid, v)
        if at == 0 or at == len(grid):
            return means[0] if at == 0 else means[-1]
        share = (v - grid[at - 1]) / (grid[at] - grid[at - 1])
        return means[at - 1] + share * (means[at] - means[at - 1])

    return {d: min(1.0, max(0.0, between(v))) for d, v in zip(ids, z @ ridge(zl, y))}


def test_scores_as_by_plain_numpy(spark):
    docs, labels = (base.table(spark, SF, n) for n in ("documents", "labels"))
    want = plain_scores([(r.doc_id, r.text) for r in docs.collect()], {r.doc_id: r.quality for r in labels.collect()})
    got = {r.doc_id: r.score for r in quality.scored(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[d] - want[d]) for d in got) < 1e-6
