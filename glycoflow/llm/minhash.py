"""MinHash near-dedup with HyperMinHash registers.

A set of shingles is hashed into 160 registers. A register keeps of the smallest hash in its bucket the number of
leading zeros and the ten bits that follow. Large sets use one hash function over 160 buckets, smaller ones more
functions over fewer buckets, so that a bucket holds about three shingles or more; a set near the edge of two such
levels has registers of both. Documents meet where four registers in a row, a band, agree.

A pair of similarity 0.75 agrees in none of the 40 bands with a chance of 3e-7. Documents of equal sets are one
representative beforehand. Those that meet in a band do so by way of the smallest of the band; a document is first
compared with the one of these that it meets most often, so that a large group of copies costs one comparison each.
Pairs that this leaves in different components are found by what both have different from the smallest document of a
component (see ``_apart``), which loses none.
A comparison starts with the collision-corrected estimate from the registers (a pair of similarity 0.75 falls below
0.55 with a chance of 2e-9) and is settled on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glycoflow.llm import base, rolling
from glycoflow.llm.links import components
from glycoflow.llm.workers import frugal

SHINGLE, PERCENT = 5, 75
REGISTERS, ROWS = 160, 4
BANDS = REGISTERS // ROWS
#: Buckets of each level; a set belongs to the last level of which it has three times as many shingles.
LEVELS = np.array([1, 2, 5, 10, 20, 40, 80, 160])
MANTISSA = 10
EMPTY = 0xFFFF
LEAST_ESTIMATE = 0.55
#: Around a component where as many documents meet, all of their pairs are looked at.
FEW = 16
SKETCH = "doc_id long, n long, high long, low long, level int, registers binary"
SETS = "doc_id long, n long, high long, low long, items array<long>"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(part: pa.RecordBatch, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; all its words as one where there are fewer than ``size``."""
    data, bounds = rolling.flat(part.column("text"))
    data = LOWER[data]
    starts, ends, cuts = rolling.words(data, bounds)
    words = rolling.word_hashes(data, starts, ends, rolling.BASES[0])
    grams = rolling.windows(words, size, rolling.BASES[0])
    sums = rolling.prefix_sums(words, rolling.BASES[1])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= size:
            yield rolling.distinct(grams[a : b - size + 1])
        elif b > a:
            yield rolling.stretch_hashes(sums, np.array([a]), np.array([b]), rolling.BASES[1])
        else:
            yield np.zeros(0, dtype=np.uint64)


def fingerprint(items: np.ndarray) -> tuple[int, int]:
    high, low = (int(rolling.mixed(items ^ np.uint64(b)).sum(dtype=np.uint64).view(np.int64)) for b in rolling.BASES)
    return high, low


def levels_of(n: int) -> list[int]:
    """The level of a set of n shingles, and the one below it where a similar set may be there."""
    level = int(np.searchsorted(3 * LEVELS, n, side="right")) - 1
    if level <= 0:
        return [0]
    return [level - 1, level] if n * PERCENT < 300 * LEVELS[level] else [level]


def registers(items: np.ndarray, level: int) -> np.ndarray:
    """160 registers: leading zeros above, mantissa below; ``EMPTY`` where no shingle is in the bucket."""
    buckets = int(LEVELS[level])
    functions = np.arange(REGISTERS // buckets, dtype=np.uint64)
    hashes = rolling.mixed(items[None, :] ^ rolling.mixed(functions + np.uint64(1))[:, None])
    bucket = ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)
    place = bucket.astype(np.int64) + (np.arange(len(functions)) * buckets)[:, None]
    least = np.full(REGISTERS, 1 << 40, dtype=np.int64)
    np.minimum.at(least, place.ravel(), (hashes >> np.uint64(32)).astype(np.int64).ravel())
    bits = np.frexp(least.astype(np.float64))[1]
    zeros = 32 - bits
    left = np.maximum(bits - 1, 0)
    rest = least - (np.int64(1) << left) * (bits > 0)
    mantissa = np.where(left >= MANTISSA, rest >> np.maximum(left - MANTISSA, 0), rest << np.maximum(MANTISSA - left, 0))
    out = (zeros << MANTISSA) | mantissa
    return np.where(least < 1 << 32, out, EMPTY).astype(np.uint16)


@frugal
def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rolling.batches(batch, "text", 1 << 18):
            rows = []
            for doc, items in zip(part.column("doc_id").to_pylist(), shingle_sets(part), strict=True):
                high, low = fingerprint(items)
                for level in levels_of(len(items)) if len(items) else [None]:
                    rows.append((doc, len(items), high, low, level, registers(items, level).tobytes() if len(items) else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n", "high", "low", "level", "registers"]
            )


@frugal
def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rolling.batches(batch, "text", 1 << 18):
            sets = list(shingle_sets(part))
            prints = [fingerprint(x) for x in sets]
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            items = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(items.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), lists],
                names=["doc_id", "n", "high", "low", "items"],
            )


@cache
def chance_collision(load: int) -> float:
    """Chance that the smallest of 2**load hashes and of as many others fall into one register value."""
    cells = 1 << MANTISSA
    total = 0.0
    for zeros in range(33):
        edges = (1 + np.arange(cells + 1) / cells) * 2.0 ** -(zeros + 1)
        total += float((np.diff(np.exp(-(2.0**load) * edges)) ** 2).sum())
    return total


def estimate(a: np.ndarray, b: np.ndarray, n: float, level: int) -> float:
    """Collision-corrected similarity from two rows of registers."""
    used = (a != EMPTY) | (b != EMPTY)
    share = float((a == b)[used].mean()) if used.any() else 0.0
    by_chance = chance_collision(round(np.log2(max(1.0, n / LEVELS[level]))))
    return (share - by_chance) / (1 - by_chance)


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("ra", "rb", "na", "level")]
        keep = [estimate(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16), n, level) >= LEAST_ESTIMATE for a, b, n, level in zip(*columns, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough."""
    left = sketches.select(F.col("doc_id").alias("a"), "level", F.col("registers").alias("ra"), F.col("n").alias("na"))
    right = sketches.select(F.col("doc_id").alias("b"), "level", F.col("registers").alias("rb"))
    sized = pairs.join(left, "a").join(right, ["b", "level"])
    plausible = sized.select("a", "b", "level", "na", "ra", "rb").mapInArrow(_plausible, "a long, b long").distinct()
    one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    common = F.size(F.array_intersect("ia", "ib"))
    checked = plausible.join(one, "a").join(other, "b").select("a", "b", (F.col("na") + F.col("nb")).alias("both"), common.alias("common"))
    return checked.where(f"100 * common >= {PERCENT} * (both - common)").select("a", "b")


def _apart(led: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that may be similar.

    Documents that share a leader meet around the component that most of them are in, whose smallest document is the
    hub. Where few meet, all their pairs in different components are looked at.
    Otherwise, let D be the difference of a set from the hub's. Sets x and y of |x| + |y| = S are similar if their own
    difference is at most S / 7, that is, if Dx and Dy have at least (|Dx| + |Dy| - S / 7) / 2 elements in common. One of
    the two, x, is not in the hub's component, so |Dx| exceeds (|x| + |hub|) / 7, or x is similar to the hub itself.
    This leaves at least (|Dy| + (|hub| - |y| + 1) / 7) / 2 elements of Dy, and |Dx| - |x| / 3 and at least one of Dx.
    With the elements of each D in one order, rare ones first, similar pairs share one of the first |D| - least + 1
    elements. Copies with edits of their own do not, however many they are.
    """
    named = labels.select(F.col("node").alias("b"), F.col("component").alias("own"))
    leads = labels.select(F.col("node").alias("a"), F.col("component").alias("whole"))
    found = led.join(named, "b", "left").join(leads, "a", "left")
    found = found.select("a", F.coalesce("whole", "a").alias("whole"), "b", F.coalesce("own", "b").alias("own"))
    meeting = found.select("a", "b", "own").union(found.select("a", "a", "whole")).distinct()
    shares = meeting.groupBy("a", "own").agg(F.count("*").alias("share"))
    largest = shares.groupBy("a").agg(F.max(F.struct("share", (-F.col("own")).alias("own"))).alias("best"))
    around = meeting.join(largest.select("a", (-F.col("best.own")).alias("hub")), "a").select("hub", "b", "own").distinct()
    outside = F.count_if(F.col("own") != F.col("hub"))
    groups = around.groupBy("hub").agg(F.count("*").alias("members"), outside.alias("outside")).where("outside > 0")
    around = base.kept_table(around.join(groups.drop("outside"), "hub").withColumn("few", F.col("members") <= FEW))

    few = around.where("few").select("hub", "b", "own")
    each = few.select("hub", F.col("b").alias("x"), F.col("own").alias("own_x"))
    direct = each.join(few, "hub").where("x < b AND own_x <> own").select(F.col("x").alias("a"), "b")

    hubs = sets.select(F.col("doc_id").alias("hub"), F.col("n").alias("nh"), F.col("items").alias("ih"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    many = around.where("NOT few AND b <> hub").join(other, "b").join(hubs, "hub")
    delta = F.concat(F.array_except("ib", "ih"), F.array_except("ih", "ib"))
    members = base.kept_table(many.select("hub", "b", "own", "nh", "nb", delta.alias("delta")))
    is_outside = F.col("own") != F.col("hub")
    to_hub = members.where(is_outside & (7 * F.size("delta") <= F.col("nh") + F.col("nb")))
    to_hub = to_hub.select(F.least("hub", "b").alias("a"), F.greatest("hub", "b").alias("b"))

    elements = members.select("hub", "b", "own", is_outside.alias("outside"), "nh", "nb", F.size("delta").alias("size"), F.explode("delta").alias("element"))
    counts = elements.groupBy("hub", "element").agg(F.count("*").alias("times"))
    order = F.row_number().over(Window.partitionBy("hub", "b").orderBy("times", "element"))
    ranked = elements.join(counts, ["hub", "element"]).withColumn("nth", order).where("times > 1")
    least_x = F.greatest(F.lit(1), F.ceil((3 * F.col("size") - F.col("nb")) / 3))
    least_y = F.ceil((7 * F.col("size") + F.col("nh") - F.col("nb") + 1) / 14)

    def first(rows: DataFrame, least: Column, side: str) -> DataFrame:
        prefix = rows.where(F.col("nth") <= F.col("size") - least + 1)
        return prefix.select(
            "hub", "element", F.col("b").alias(side), F.col("own").alias(f"own_{side}"),
            F.col("size").alias(f"size_{side}"), F.col("nb").alias(f"n_{side}"),
        )

    x, y = first(ranked.where("outside"), least_x, "x"), first(ranked, least_y, "y")
    near = 7 * F.abs(F.col("size_x") - F.col("size_y")) <= F.col("n_x") + F.col("n_y")
    met = x.join(y, (x.hub == y.hub) & (x.element == y.element) & (F.col("own_x") != F.col("own_y")) & near)
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return direct.union(to_hub).union(met).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Link documents whose sets of five-word shingles have a similarity of at least 0.75.

    Words are runs of bytes other than ASCII white space, with A-Z in lower case. A document of fewer than five words
    has all of them as its one shingle; one without words, or of null text, has none and is linked with nothing. Rows
    without doc_id are left out; of rows with one doc_id the one with most shingles counts. Other columns are ignored.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (doc_id is that).
    """
    with base.scratch(docs.sparkSession):
        return base.kept_table(_near_duplicates(docs), lasting=True)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = base.kept_table(texts.mapInArrow(_sketched, SKETCH))
    # One row per document: repeated doc_ids are rare, so only they are compared.
    most = rows.groupBy("doc_id").agg(F.max(F.struct("n", "high", "low")).alias("most"))
    documents = most.select("doc_id", "most.*")
    representatives = documents.where("n > 0").groupBy("high", "low", "n").agg(F.min("doc_id").alias("doc_id"))
    sketches = base.kept_table(rows.where("n > 0").join(representatives, ["doc_id", "high", "low", "n"]).dropDuplicates(["doc_id", "level"]))

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    banded = sketches.select("doc_id", "level", "registers", band).select(
        "doc_id", "level", F.col("registers").substr(F.col("band") * 2 * ROWS + 1, F.lit(2 * ROWS)).alias("values"), "band"
    )
    banded = banded.where(F.col("values") != F.lit(b"\xff" * 2 * ROWS)).select("doc_id", F.xxhash64("values", "band", "level").alias("key"))
    # Whoever meets others in a band is compared with the smallest there.
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("other")).where("lead <> other")
    met = banded.join(shared.select("key", "lead"), "key").where("doc_id <> lead")
    led = base.kept_table(met.groupBy(F.col("lead").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("bands")))
    candidates = led.select(F.col("a").alias("doc_id")).union(led.select("b")).distinct()

    prints = sketches.select("doc_id", "n", "high", "low").distinct()
    # The candidates grow with the input: they are never broadcast, also where they happen to be few.
    sets = texts.join(candidates.hint("merge"), "doc_id", "left_semi").mapInArrow(_with_sets, SETS)
    sets = base.kept_table(sets.join(prints, ["doc_id", "n", "high", "low"]).dropDuplicates(["doc_id"]))

    # First with the one that a document meets in most bands; what that leaves apart, afterwards.
    nearest = led.groupBy("b").agg(F.max(F.struct("bands", -F.col("a"))).alias("best")).select((-F.col("best")["col2"]).alias("a"), "b")
    first = base.kept_table(_confirmed(nearest, sketches, sets))
    rest = _confirmed(_apart(led.select("a", "b"), components(first), sets), sketches, sets)

    linked = components(first.union(rest))
    named = documents.join(representatives.withColumnRenamed("doc_id", "representative"), ["high", "low", "n"], "left")
    named = named.join(linked, F.col("representative") == F.col("node"), "left")
    component = F.coalesce("component", "representative", "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(base.table(spark, sf_dir, "documents"))


SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS g
  FROM w, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(1, len(ws) - 4) END)) AS t(i)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 75 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))
),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs)
"""
SQL = SQL.replace("WITH w", "WITH RECURSIVE w") + """,
reach AS (
  SELECT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r
),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id)::BIGINT AS component_id,
       coalesce(component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
