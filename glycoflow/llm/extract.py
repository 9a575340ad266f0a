"""Main text of web pages: a conditional random field over the leaf blocks of the page.

A page is cut into blocks (blocks.py); each block has features of its ancestors' tags and names and of its text; a
linear chain (crf.py), trained on labelled pages (labelled.py), marks the blocks of the main text by Viterbi. Pages are
independent: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glycoflow.llm import base, crf, labelled
from glycoflow.llm.blocks import Block, blocks

#: Labelled pages that the model is trained on, a fixed number.
TRAINING_PAGES, ROUNDS = 1000, 200
OUT = "page_id long, url string, text string, n_chars long, n_blocks long"
STOPS = ".!?:;\"'”»…"


def _bucket(n: int) -> int:
    return min(n.bit_length(), 12)


def features(page: list[Block]) -> list[list[str]]:
    """Sparse features of each block of a page."""
    out: list[list[str]] = []
    last = len(page) - 1
    for at, b in enumerate(page):
        size = len(b.text)
        words = b.text.count(" ") + 1
        linked = b.linked * 4 // size
        stops = sum(b.text.count(c) for c in ".!?,")
        ends = b.text[-1] in STOPS
        has = [f"above {t}" for t in b.above]
        has += [f"name {n}" for n in b.names]
        has += [f"nearest {n}" for n in b.nearest]
        has += [
            "any",
            f"tag {b.tag}",
            f"part {b.part}",
            f"size {_bucket(size)}",
            f"words {_bucket(words)}",
            f"linked {linked}",
            f"stops {_bucket(stops)}",
            f"end {ends}",
            f"size and link {min(_bucket(words), 6)} {linked > 1}",
            f"tag and link {b.tag} {linked > 1}",
            f"tag and size {b.tag} {_bucket(words) > 3}",
            f"place {at * 4 // (last + 1)}",
            f"capital {b.text[0].isupper()}",
        ]
        if b.bold:
            has.append("bold")
        if "©" in b.text or "(c)" in b.text.lower():
            has.append("copyright")
        if sum(map(str.isdigit, b.text)) * 3 > size:
            has.append("digits")
        if at and page[at - 1].above == b.above and page[at - 1].names == b.names:
            has.append("as before")
        if at < last and page[at + 1].above == b.above and page[at + 1].names == b.names:
            has.append("as next")
        out.append(has)
    return out


@lru_cache(maxsize=4)
def trained(pages: int = TRAINING_PAGES, rounds: int = ROUNDS) -> crf.Field:
    """The model of so many labelled pages; trained once in a driver process."""
    made = [labelled.labelled_page(seed) for seed in range(pages)]
    return crf.fitted([features(found) for _, found, _ in made], [labels for _, _, labels in made], rounds)


def main_text(page: str, model: crf.Field) -> tuple[str, int]:
    """Blocks of the main text, one a line, and the number of all blocks."""
    found = blocks(page)
    labels = model.decode(features(found))
    return "\n".join(b.text for b, y in zip(found, labels, strict=True) if y), len(found)


def _extracted(batches: Iterator[pa.RecordBatch], model: crf.Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for page in batch.column("html"):
            text, n = main_text(page.as_py() or "", model)
            texts.append(text)
            counts.append(n)
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_blocks"])


def extracted(pages: DataFrame, model: crf.Field | None = None) -> DataFrame:
    """The main text of every page.

    Character references are decoded, white space inside a block is one space, blocks are joined by a line feed in page
    order. A null or empty html has an empty text, as has a page of which no block is main text. Every row has its
    result, also without page_id or of a page_id that is there several times. Other columns are ignored.

    Returns page_id, url, text, n_chars (code points of the text) and n_blocks (of the whole page).
    """
    base.ready(pages.sparkSession)
    model = model or trained()
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lambda it: _extracted(it, model), OUT)


def op11_block_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(base.table(spark, sf_dir, "pages")).drop("n_blocks")


#: The given pages mark their main text by one element, which holds headings and paragraphs.
SQL = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
parts AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(?:h1|p)>'), lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g')) AS xs FROM a),
decoded AS (
  SELECT page_id, url, list_transform(xs, lambda x: trim(regexp_replace(
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'),
         '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')) AS xs FROM parts
),
texts AS (SELECT page_id, url, array_to_string(list_filter(xs, lambda x: x <> ''), chr(10)) AS text FROM decoded)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""
