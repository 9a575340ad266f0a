import zlib

import numpy as np
import pytest

from glycoflow.llm import base, quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = quality.op2_quality(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert (out.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in out.doc_id]).all()
    both = out[out.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() >= 0.97
    assert out.score.between(0, 1).all()
    assert (out.predicted == (out.score >= 0.5)).all()


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = (base.table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    a, b = ({r.doc_id: r.score for r in quality.scored(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_awkward_rows(spark, docs_of, word_texts):
    base.ready(spark)
    texts = word_texts(5) + ["\n\n\n", "\n", "é" * 4000]
    docs = docs_of([*enumerate(texts), (2, "again"), (None, "nameless")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == len(texts) + 2
    assert all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(docs.where("false"), labels).count() == 0
    assert {r.score for r in quality.scored(docs, labels.where("false")).collect()} == {0.5}
    one = {r.score for r in quality.scored(docs, labels.where("quality = 1")).collect()}
    assert one == {1.0}


def test_isotonic_pools_violators():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 0, 2, 6]), np.array([4.0, 2, 4, 6]))
    assert y.tolist() == pytest.approx([1 / 6, 0.5, 1.0])
    assert x.tolist() == pytest.approx([1 / 3, 2, 3])


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(40, quality.STATISTICS))
    z = quality.fourier(a, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))[:, :-1]
    kernel = np.exp(-((a[:, None] - a[None]) ** 2).sum(-1) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - kernel).mean() < 0.05
