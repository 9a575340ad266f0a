import random

import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (doc_id, text) pairs; with columns whose names the operators also use inside."""

    def make(items, partitions=3):
        pairs = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(items)]
        rows = [(d, t, "en", f"s{(d or 0) % 2}", len(t or "")) for d, t in pairs]
        df = spark.createDataFrame(rows, DOCS)
        df = df.selectExpr("*", "'x' AS place", "1 AS n", "'y' AS kept", "2 AS level", "3 AS first", "'z' AS words")
        return df.repartition(partitions)

    return make


@pytest.fixture(scope="session")
def word_texts():
    """Random texts over few words, with copies, near copies, shared passages, periods, nulls and empty ones."""

    def make(seed, count=40, vocabulary=30, longest=120):
        rng = random.Random(seed)
        words = [f"w{i}" if i % 5 else f"é{i}x" for i in range(vocabulary)]
        passage = [rng.choice(words) for _ in range(35)]
        out = []
        for i in range(count):
            text = [rng.choice(words) for _ in range(rng.randint(0, longest))]
            if i % 4 == 1:
                at = rng.randint(0, len(text))
                text[at:at] = passage[rng.randint(0, 5) :]
            if i % 7 == 3 and out and out[-1]:
                text = out[-1].split()
                if text and i % 2:
                    text[rng.randrange(len(text))] = "changed"
            out.append(rng.choice([" ", "  ", "\t"]).join(text) if i % 9 else "\n".join(text))
        out += [None, "", "   ", "one", "a b c d e", " ".join(["tick"] * 70), "\n".join(["tick"] * 64), "nobreak space " * 21, None]
        return out

    return make


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="session")
def rows_by_id():
    return by_id


__all__ = ["Row"]
