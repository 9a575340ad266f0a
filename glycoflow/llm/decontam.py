"""Benchmark decontamination by spaced seeds.

A seed is the hash of some of eight tokens in a row; the masks ignore the others. The two masks are such that any
thirteen tokens in a row with at most two substitutions have a seed without one. Columns and SQL functions only: seeds
of benchmark items meet those of documents by hash, and the tokens around a hit are compared on its diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glycoflow.llm import base

#: Both look at the first two tokens, which `paired` builds on.
MASKS = ("11101011", "11001111")
SPAN = 8
#: Tokens in a row that are compared, and substitutions that they may hold.
STRETCH, SUBSTITUTIONS = 13, 2
#: The benchmark's seeds are broadcast up to this number of rows, about 100 MB; beyond it, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
NOT_TOKEN = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_TOKEN), "")


def _seed(hashes: str, place: Column, mask: str) -> Column:
    picked = [k for k, c in enumerate(mask) if c == "1"]
    return F.xxhash64(*(F.get(hashes, place + k) for k in picked), F.lit(mask))


def hashed(rows: DataFrame, key: str) -> DataFrame:
    """key and the hashes of its tokens, where there are enough for a seed."""
    split = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), tokens(F.col("text")).alias("tokens"))
    return split.select(key, F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes")).where(F.size("hashes") >= SPAN)


def paired(rows: DataFrame, key: str) -> DataFrame:
    """key, hashes, place and pair: the hash of the two tokens there, which both masks look at."""
    pairs = F.zip_with("hashes", F.slice("hashes", F.lit(2), F.size("hashes") - 1), lambda a, b: F.xxhash64(a, b))
    found = rows.select(key, "hashes", F.posexplode(pairs).alias("place", "pair"))
    return found.where(F.col("place") <= F.size("hashes") - SPAN)


def seeded(rows: DataFrame, key: str) -> DataFrame:
    """key, hashes, place, pair and seed; for each place and mask."""
    seeds = F.array(*(_seed("hashes", F.col("place"), mask) for mask in MASKS))
    return rows.select(key, "hashes", "place", "pair", F.explode(seeds).alias("seed"))


def _around(place: str) -> Column:
    """The tokens of all stretches with the seed at a place; null beyond the text."""
    reach = STRETCH - SPAN
    return F.transform(F.sequence(F.lit(-reach), F.lit(SPAN + reach - 1)), lambda k: F.get("hashes", F.col(place) + k))


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_tokens (of a stretch) and, side by side, the tokens found and wanted; of every hit.

    Broadcast rows have a fixed width: tokens are fetched for the hits.
    """
    texts = hashed(docs, "doc_id")
    items = hashed(benchmark, "item_id").distinct()
    seeds = seeded(paired(items, "item_id"), "item_id").select("item_id", F.col("place").alias("at"), "pair", "seed")
    n_tokens = F.least(F.lit(STRETCH), F.size("hashes")).alias("n_tokens")
    if seeds.count() <= BROADCAST_ROWS:
        # Places whose two tokens follow each other nowhere in the benchmark have no hit.
        possible = paired(texts, "doc_id").join(F.broadcast(seeds.select("pair").distinct()), "pair", "left_semi")
        met = seeded(possible, "doc_id").drop("pair").join(F.broadcast(seeds.drop("pair")), "seed")
        hits = met.select("doc_id", "item_id", "at", _around("place").alias("found"))
        places = items.select("item_id", "hashes", F.explode(F.sequence(F.lit(0), F.size("hashes") - SPAN)).alias("at"))
        return hits.join(places.select("item_id", "at", n_tokens, _around("at").alias("wanted")), ["item_id", "at"])
    # Seeds alone are shuffled, and tokens fetched for the hits.
    met = seeded(paired(texts, "doc_id"), "doc_id").select("doc_id", "place", "seed").join(seeds.select("item_id", "at", "seed"), "seed")
    hits = met.select("doc_id", "item_id", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    joined = hits.join(texts, "doc_id").join(items.select("item_id", n_tokens, F.col("hashes").alias("wanted")), "item_id")
    found = F.transform("wanted", lambda _, k: F.get("hashes", k + F.col("diagonal")))
    return joined.select("doc_id", "item_id", "n_tokens", found.alias("found"), "wanted")


def _compared(token: Column, wanted: Column) -> Column:
    return F.when(token.isNull() | wanted.isNull(), -STRETCH).when(token == wanted, 1).otherwise(0)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold thirteen tokens in a row of a benchmark item, up to two of them substituted.

    Tokens are runs of letters and digits in lower case. An item of eight to twelve tokens has to be there as it is; a
    shorter one is not searched. Rows without doc_id or item_id are left out, null texts have no tokens, repeated rows
    count once, and other columns are ignored.

    Returns per pair doc_id, item_id, n_matched (most equal tokens of a stretch) and n_tokens (length of the stretch).
    """
    hits = _hits(docs, benchmark)
    # No stretch reaches beyond the document or the item.
    compared = hits.select("doc_id", "item_id", F.zip_with("found", "wanted", _compared).alias("equal"), "n_tokens")
    starts = F.sequence(F.lit(1), F.size("equal") - F.col("n_tokens") + 1)
    sums = F.transform(starts, lambda i: F.aggregate(F.slice(F.col("equal"), i, F.col("n_tokens")), F.lit(0), lambda a, b: a + b))
    best = compared.select("doc_id", "item_id", "n_tokens", F.array_max(sums).alias("n_matched"))
    enough = F.col("n_matched") >= F.col("n_tokens") - F.when(F.col("n_tokens") == STRETCH, SUBSTITUTIONS).otherwise(0)
    pairs = best.where(enough).groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"), F.max("n_tokens").alias("n_tokens"))
    return pairs.select("doc_id", "item_id", F.col("n_matched").cast("bigint"), F.col("n_tokens").cast("bigint"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; rows without doc_id stay."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


def _sql_seeds(table: str, key: str) -> str:
    def picked(mask: str) -> str:
        return ", ".join(f"ws[i + {k + 1}]" for k, c in enumerate(mask) if c == "1")

    return " UNION ALL ".join(
        f"SELECT {key}, i, {no} AS mask, array_to_string([{picked(mask)}], ' ') AS seed FROM {table}, unnest(range(0, len(ws) - 7)) AS t(i)"
        for no, mask in enumerate(MASKS)
    )


_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS ws FROM documents),
b AS (SELECT item_id, {_TOKENS} AS ws FROM benchmark),
ds AS ({_sql_seeds("d", "doc_id")}),
bs AS ({_sql_seeds("b", "item_id")}),
hits AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS g FROM ds JOIN bs USING (mask, seed)),
eq AS (
  SELECT doc_id, item_id, g, k, len(b.ws) AS n,
         CASE WHEN k + g < 0 OR k + g >= len(d.ws) THEN -13 WHEN d.ws[k + g + 1] = b.ws[k + 1] THEN 1 ELSE 0 END AS e
  FROM hits JOIN d USING (doc_id) JOIN b USING (item_id), unnest(range(0, len(b.ws))) AS t(k)
),
st AS (
  SELECT doc_id, item_id, k, least(13, n) AS w, sum(e) OVER (PARTITION BY doc_id, item_id, g ORDER BY k ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS m FROM eq
)
SELECT doc_id, item_id, max(m)::BIGINT AS n_matched, max(w)::BIGINT AS n_tokens
FROM st WHERE k >= w - 1 AND m >= w - CASE WHEN w = 13 THEN 2 ELSE 0 END GROUP BY doc_id, item_id
"""
