import re

import pytest

import corpus_pipeline
from glycoflow.llm import base, packing, quality

SF = "/root/testdata/sf0.001"


def brute_stages(spark, docs, sf_dir):
    """The same decisions by plain Python; the classifier's own scores are taken as they are."""
    from tests.llm import test_near_duplicates as near
    from tests.llm.test_repeats import brute_all_words

    rows = {r.doc_id: r for r in docs.collect()}
    bad = {r.doc_id for r in quality.scored(docs, base.table(spark, sf_dir, "labels")).where("predicted = 0").collect()}
    texts = {d: r.text for d, r in rows.items() if d not in bad}
    yield dict(texts)
    texts = keep_leaders(near.brute(texts.items()), texts)
    yield dict(texts)
    texts = brute_all_words(list(texts.items()), 50)
    yield dict(texts)
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in base.table(spark, sf_dir, "benchmark").collect()]
    texts = {d: t for d, t in texts.items() if not any(holds(re.findall(r"[^\W_]+", t.lower()), item) for item in items)}
    yield dict(texts)


def keep_leaders(found, texts):
    return {d: t for d, t in texts.items() if found[d][1] == d}


def holds(tokens, item):
    stretches = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}
    first = {s[0] for s in stretches} | {s[1] for s in stretches} | {s[2] for s in stretches}
    for i in range(len(tokens) - 12):
        if first.isdisjoint(tokens[i : i + 3]):
            continue
        window = tokens[i : i + 13]
        if any(sum(a == b for a, b in zip(window, s, strict=True)) >= 11 for s in stretches):
            return True
    return False


@pytest.fixture(scope="module")
def stages(spark):
    docs = base.table(spark, SF, "documents")
    out = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = base.kept_table(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_stages_as_by_brute_force(spark, stages):
    names = base.table(spark, SF, "documents").columns
    for df, want in zip(stages, brute_stages(spark, base.table(spark, SF, "documents"), SF), strict=True):
        assert df.columns == names
        rows = df.collect()
        got = {r.doc_id: r.text for r in rows}
        assert set(got) == set(want)
        assert [d for d in got if got[d] != want[d]] == []
        assert all(r.n_chars == len(r.text) for r in rows)


def test_run_packs_what_the_stages_keep(spark, stages):
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()}
    want = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.packed(stages[-1]).collect()}
    assert got == want and got


def test_stages_take_empty_tables(spark):
    docs = base.table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = base.kept_table(stage(spark, docs, SF))
    assert docs.count() == 0


def test_repeats_keep_rows_without_id_and_of_one_id(spark):
    base.ready(spark)
    passage = "".join(f"shared {i} " for i in range(60))
    copy = "".join(f"copied {i} " for i in range(60))
    rows = [
        (1, "first " + passage, "en", "a"), (1, "second", "de", "b"), (None, "nameless", "fr", "c"), (None, "another", "fr", "d"),
        (None, passage + "end", "fr", "e"), (2, copy, "en", "f"), (2, copy, "en", "g"), (None, None, "en", "h"), (3, None, "en", "i"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.cut_repeats(spark, docs, SF)
    assert out.columns == docs.columns
    left = {"a": "first", "e": "end", "h": "", "i": ""}
    want = {s: (d, left.get(s, (t or "").strip()), lang) for d, t, lang, s in rows}
    got = out.collect()
    assert len(got) == len(rows)
    assert {r.source: (r.doc_id, r.text.strip(), r.lang) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_short_passages_of_many_words_are_cut(spark):
    """51 words of 306 bytes, as planted passages are; columns named like the stage's own stay as they are."""
    base.ready(spark)
    passage = " ".join(f"w{i:04d}" for i in range(51))
    assert len(passage) < 400
    rows = [(d, f"head {d} {passage} {d} tail", "en", "a", 0) for d in range(3)] + [(3, passage.rpartition(" ")[0][6:], "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "5 AS _key", "6 AS key", "'x' AS row", "'y' AS kept", "struct(1 AS a) AS bucket")
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert {d: r.text for d, r in got.items()} == {**{d: f"head {d} {d} tail" for d in range(3)}, 3: rows[3][1]}
    assert all((r._key, r.key, r.row, r.kept, r.bucket.a) == (5, 6, "x", "y", 1) for r in got.values())


def test_quality_judges_each_row_of_a_doc_id(spark):
    docs = base.table(spark, SF, "documents")
    labels = base.table(spark, SF, "labels")
    scores = {r.doc_id: r.predicted for r in quality.scored(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good, bad = (next(t for d, t in sorted(texts.items()) if scores[d] == y and t) for y in (1, 0))
    more = [(10**6, good, "en", "a", 1), (10**6, bad, "en", "b", 1), (None, good, "en", "c", 1), (None, bad, "en", "d", 1)]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.accept(spark, docs.unionByName(extra), SF)
    assert out.columns == docs.columns
    assert sorted(r.source for r in out.where("doc_id IS NULL OR doc_id = 1000000").collect()) == ["a", "c"]
