import random
import re

import numpy as np
import pytest

from glycoflow.llm import base, links, minhash


def brute(pairs):
    sets, texts = {}, {}
    for d, t in pairs:
        if d is None:
            continue
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        if d not in sets or len(grams) > len(sets[d]):
            sets[d] = grams
        texts[d] = t
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_as_by_brute_force(spark, docs_of, seed):
    base.ready(spark)
    rng = random.Random(seed)
    words = [f"W{i}" if i % 3 else f"É{i}" for i in range(400)]
    texts = [None, "", " \t", "one", "ONE", "one two", "a b c d e", "A b c d e", "a b c d f", "a b c d e f g h", "a b c d e f g h i"]
    for _ in range(12):
        origin = [rng.choice(words) for _ in range(rng.choice([4, 8, 9, 20, 60, 200, 900]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(origin)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy).lower() if rng.random() < 0.3 else "  ".join(copy))
    pairs = list(enumerate(texts))
    pairs += [(5, None), (7, "a b c d e"), (None, texts[-1])]
    rng.shuffle(pairs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(pairs)).collect()}
    assert got == brute(pairs)


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(259, 300), (300, 5)]
    got = {r.node: r.component for r in links.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    assert {got[i] for i in (7, *range(200, 260), 300, 5)} == {5}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (4, 30, 130, 500, 5000):
        level = minhash.levels_of(n)[-1]
        errors = []
        for _ in range(30):
            common, own = rng.integers(0, 1 << 62, int(n * 0.8)).astype(np.uint64), rng.integers(0, 1 << 62, (2, n - int(n * 0.8))).astype(np.uint64)
            a, b = (minhash.registers(np.unique(np.concatenate((common, x))), level) for x in own)
            errors.append(minhash.estimate(a, b, n, level) - len(common) / (len(common) + own.size))
        assert abs(np.mean(errors)) < 0.05


def test_similar_sets_share_a_level():
    for a in range(1, 3000):
        for b in {int(np.ceil(a * 0.75)), a}:
            assert set(minhash.levels_of(a)) & set(minhash.levels_of(b))


def test_empty_table(spark, docs_of):
    base.ready(spark)
    assert minhash.near_duplicates(docs_of(["x"]).where("false")).count() == 0


@pytest.mark.parametrize("few", [0, 1000])
def test_links_of_what_the_leaders_leave_apart(spark, docs_of, monkeypatch, few):
    monkeypatch.setattr(minhash, "FEW", few)
    base.ready(spark)
    rng = random.Random(8)
    origin = [f"o{i}" for i in range(60)]
    texts = [" ".join(origin)]
    for branch in range(4):
        stem = list(origin)
        for at in range(3 + 12 * branch, 12 * branch + 12, 3):
            stem[at] = f"b{branch}x{at}"
        for _ in range(7):
            copy = list(stem)
            copy[rng.randrange(60)] = f"r{rng.random()}"
            texts.append(" ".join(copy if rng.random() < 0.7 else copy[: rng.randint(40, 60)]))
    pairs = list(enumerate(texts))
    want = brute(pairs)
    assert 1 < len({c for _, c in want.values()}) < len(pairs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(pairs)).collect()} == want
