"""Quality rules on lines that many documents of a host share.

Columns and SQL functions only. Lines are normalised and hashed; a line's documents are counted per host; lines above
the limit are taken out, and a document that loses most of its words is rejected. Counts are partial sums per
(host, line), so a line on every page of a large host costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glycoflow.llm import base

#: A line is above the limit in more documents of its host than the first number, and either than the percentage of them or
#: than the last number, which does not grow with the host.
LEAST_DOCUMENTS, PERCENT_OF_HOST, MOST_DOCUMENTS = 5, 10, 1000
#: A document is depleted if more than this percentage of its words goes.
MOST_REMOVED = 50
LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK_RUN), "")


def normalised(line: Column) -> Column:
    """Lower case, single blanks, none at the ends."""
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), BLANK_RUN, " "))


def with_signals(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, row (a hash of doc_id and text), host, lines (those with a word) and the counts of the base rules."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    split = rows.select(
        "doc_id",
        "host",
        F.xxhash64("doc_id", "text").alias("row"),
        words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0).alias("lines"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
    )
    hashed = split.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    first = F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1))
    windowed = hashed.select(
        "doc_id",
        "row",
        "host",
        "lines",
        "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("hashes") >= WINDOW, F.transform(first, lambda i: F.xxhash64(F.slice(F.col("hashes"), i, F.lit(WINDOW))))).alias("windows"),
    )
    # Only where a window repeats, windows are sorted with their places, and the places of equal neighbours taken.
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    listed = windowed.select("*", F.when(again, ordered).alias("sorted")).drop("windows")

    def equal(x: Column, k: Column) -> Column:
        near = [F.coalesce(F.get("sorted", k + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)]
        return F.when(near[0] | near[1], x["i"])

    places = F.sort_array(F.array_compact(F.transform("sorted", equal)))
    placed = listed.select("*", places.alias("places")).drop("sorted")
    steps = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    return placed.select(
        "doc_id", "row", "host", "lines", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )


def judged(docs: DataFrame, host: str = "source", least: int = LEAST_DOCUMENTS, percent: int = PERCENT_OF_HOST, most_removed: int = MOST_REMOVED, most: int = MOST_DOCUMENTS) -> DataFrame:
    """Judge every document by base rules, then by what is left without the lines that its host repeats.

    A null text is empty; a null host is one host; rows of equal doc_id and text are one document, and a doc_id with
    several texts, or none at all, has a row for each text. Other columns are ignored.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and n_line_words
    (words in lines above the limit).
    """
    signals = with_signals(docs, host)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    documents = signals.groupBy("doc_id", "row").agg(F.min("host").alias("host"), F.count("*").alias("rows"), *(F.max(c).alias(c) for c in counts))
    line = signals.select("doc_id", "row", "host", F.explode("lines").alias("line"))
    line = line.select("doc_id", "row", "host", F.xxhash64(normalised(F.col("line"))).alias("hash"), F.size(words(F.col("line"))).alias("n"))
    per_document = line.groupBy("host", "hash", "doc_id", "row").agg(F.sum("n").alias("n"))
    spread = per_document.groupBy("host", "hash").agg(F.count("*").alias("documents"))
    sizes = documents.groupBy("host").agg(F.count("*").alias("size"))
    many = (F.col("documents") * 100 > percent * F.col("size")) | (F.col("documents") > most)
    above = spread.where(F.col("documents") > least).join(sizes, "host").where(many).select("host", "hash")
    removed = per_document.join(above, ["host", "hash"]).groupBy("doc_id", "row").agg(F.sum("n").alias("n_line_words"))
    removed = removed.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "n_line_words")
    joined = documents.join(removed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    gone = F.coalesce(F.col("n_line_words") / F.col("rows"), F.lit(0)).cast("bigint")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > MOST_REPEATED * F.col("n_words"))
    depleted = (F.col("n_words") - gone < LEAST_WORDS) | (gone * 100 > most_removed * F.col("n_words"))
    return joined.select("doc_id", *counts, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), gone.alias("n_line_words"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(base.table(spark, sf_dir, "documents"))


_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, {_WORDS.format("text")} AS ws FROM d),
l AS (
  SELECT doc_id, host, line, len({_WORDS.format("line")}) AS n,
         lower(regexp_replace(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)
),
worded AS (SELECT * FROM l WHERE n > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
windows AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 8], ' ') AS seq FROM w, unnest(range(0, len(ws) - 7)) AS t(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, seq) AS c FROM windows) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(0, 8) AS r(k) GROUP BY doc_id),
sizes AS (SELECT host, count(*) AS size FROM d GROUP BY host),
above AS (
  SELECT host, norm FROM worded JOIN sizes USING (host) GROUP BY host, norm, size
  HAVING count(DISTINCT doc_id) > 5 AND (100 * count(DISTINCT doc_id) > 10 * size OR count(DISTINCT doc_id) > 1000)
),
gone AS (SELECT doc_id, sum(n)::BIGINT AS n_line_words FROM worded JOIN above USING (host, norm) GROUP BY doc_id),
s AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_line_words, 0)::BIGINT AS n_line_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_line_words >= 20 AND 100 * n_line_words <= 50 * n_words AS kept, n_line_words
FROM f
"""
