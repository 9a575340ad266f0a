import hashlib
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from glycoflow.llm import base, packing, rolling, runs, substring, suffix_dedup, suffixes, tokens
from glycoflow.llm.substring import spread

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_words(pairs, length):
    best = {}
    for d, t in pairs:
        if d is not None and (d not in best or (t or "") > (best[d] or "") or best[d] is None):
            best[d] = t
    seen, out = set(), {}
    for d in sorted(best):
        words = WORD.findall((best[d] or "").encode())
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        out[d] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


def brute_bytes(pairs, length):
    best = {d: t for d, t in pairs if d is not None}
    count = {}
    data = {d: (t or "").encode() for d, t in best.items()}
    for x in data.values():
        for i in range(len(x) - length + 1):
            count[x[i : i + length]] = count.get(x[i : i + length], 0) + 1
    out = {}
    for d, x in data.items():
        gone = np.zeros(len(x), dtype=bool)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = True
        out[d] = (len(x), int(gone.sum()), np.frombuffer(x, dtype=np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 64), (2, 2), (3, 3)])
def test_words_as_by_brute_force(spark, docs_of, word_texts, rows_by_id, seed, hot):
    base.ready(spark)
    pairs = list(enumerate(word_texts(seed, vocabulary=6 if seed == 3 else 30)))
    got = rows_by_id(substring.without_repeats(docs_of(pairs), length=9, gram=4, hot=hot))
    want = brute_words(pairs, 9)
    assert {d: (r.n_words, r.n_removed, r.kept) for d, r in got.items()} == want
    assert all((r.n_removed > 0) == (r.n_repeats > 0) == bool(r.repeats) for r in got.values())


@pytest.mark.parametrize("n_cold", [1, 3])
def test_anchor_hot_in_one_task_and_cold_in_another(spark, docs_of, rows_by_id, n_cold):
    base.ready(spark)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        tasks = {}
        for r in spark.range(1, 400).selectExpr("id", f"pmod(hash(id), {spark.conf.get('spark.sql.shuffle.partitions')}) AS task").collect():
            tasks.setdefault(r.task, []).append(r.id)
        cold, hot = sorted(tasks.values())[:2]
        # As many as `hot` runs of one anchor make it hot; the smallest documents are in a task with fewer.
        ids = cold[:n_cold] + [d for d in hot if d > cold[n_cold - 1]][:8]
        pairs = [(d, " ".join(f"q{i}" for i in range(9))) for d in ids]
        got = rows_by_id(substring.without_repeats(docs_of(pairs), length=9, gram=4, hot=4))
    finally:
        spark.conf.set(coalesce, before)
    assert {d: (r.n_words, r.n_removed, r.kept) for d, r in got.items()} == brute_words(pairs, 9)


def test_maximal_repeat_is_told(spark, docs_of, rows_by_id):
    base.ready(spark)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join(["a", *passage, "b"]), " ".join(["c", "d", *passage, "e"])]
    got = rows_by_id(substring.without_repeats(docs_of(texts)))
    assert got[0].repeats == []
    assert [(x.start, x.length) for x in got[1].repeats] == [(2, 30)]
    assert got[1].kept == "c d e"


@pytest.mark.parametrize(("seed", "hot", "shard"), [(1, 64, 1 << 20), (2, 2, 400), (3, 2, 1 << 20), (4, 1000, 300)])
def test_bytes_as_by_brute_force(spark, docs_of, word_texts, rows_by_id, seed, hot, shard):
    base.ready(spark)
    pairs = list(enumerate(word_texts(seed, vocabulary=6 if seed == 3 else 30)))
    got = rows_by_id(suffix_dedup.without_repeats(docs_of(pairs), length=40, gram=12, hot=hot, shard_bytes=shard))
    want = brute_bytes(pairs, 40)
    assert {d: (r.n_bytes, r.n_removed, bytes(r.kept)) for d, r in got.items()} == want
    assert all(sum(s.length for s in r.spans) == r.n_removed for r in got.values())


def test_many_runs_of_one_anchor_in_a_row(spark, docs_of, rows_by_id):
    """A block comes back with another byte behind it each time; no run is found as a whole, only its halves are."""
    base.ready(spark)
    data = np.random.default_rng(1).integers(97, 123, 1 << 20).astype(np.uint8)
    at = int(rolling.windows(data.astype(np.uint64) + np.uint64(1), 200, rolling.BASES[0]).argmin())
    block = data[at : at + 200].tobytes().decode()
    whole = "".join(block + chr(0x30 + k) for k in range(40))
    pairs = [(0, whole)] + [(1000 * (k + 1) + j, whole[201 * k + j : 201 * k + j + 500]) for k in range(38) for j in (1, 101)]
    got = rows_by_id(suffix_dedup.without_repeats(docs_of(pairs)))
    assert {d: (r.n_bytes, r.n_removed, bytes(r.kept)) for d, r in got.items()} == brute_bytes(pairs, 400)


def test_characters_stay_whole(spark, docs_of, rows_by_id):
    base.ready(spark)
    rng = random.Random(5)
    passage = "".join(rng.choice("éüñabc ") for _ in range(60))
    texts = ["aé" + passage[1:] + "x", "bü" + passage[1:] + "ñ"]
    got = rows_by_id(suffix_dedup.without_repeats(docs_of(texts), length=40, gram=12, whole_characters=True))
    assert all("�" not in bytes(r.kept).decode() for r in got.values())


def test_repeated_and_nameless_rows(spark, docs_of, rows_by_id):
    base.ready(spark)
    text = " ".join(f"q{i}" for i in range(25))
    pairs = [(1, text), (1, text), (1, None), (2, text), (None, text), (3, None)]
    words = rows_by_id(substring.without_repeats(docs_of(pairs)))
    assert {d: r.n_removed for d, r in words.items()} == {1: 0, 2: 25, 3: 0}
    data = rows_by_id(suffix_dedup.without_repeats(docs_of(pairs), length=20, gram=8))
    assert {d: r.n_removed for d, r in data.items()} == {1: len(text), 2: len(text), 3: 0}


def test_empty_tables(spark, docs_of):
    base.ready(spark)
    empty = docs_of(["x"]).where("false")
    assert substring.without_repeats(empty).count() == 0
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_hot_runs_are_dealt_over_buckets():
    n = 1000
    anchor = np.zeros(n, dtype=np.int64)
    counts = np.zeros(runs.COUNTERS, dtype=np.int64)
    counts[runs.counter_of(anchor[:1])] = n
    batch = runs.dealt(anchor, np.arange(n), np.arange(n), np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64), runs.spread_bits(counts, 64))
    assert batch.num_rows == n
    _, sizes = np.unique(batch.column("bucket").to_numpy(), return_counts=True)
    assert sizes.max() < 50
    assert not runs.spread_bits(counts, n + 1).any()


def test_anchor_is_hot_over_all_tasks_together(spark, docs_of, rows_by_id):
    """A passage in a few documents of every task, in more of all than makes an anchor hot."""
    base.ready(spark)
    rng = random.Random(3)
    passage = " ".join(f"q{i}" for i in range(25))
    pairs = [(d, f"{' '.join(rng.choice('abcdefgh') + str(rng.randrange(10**6)) for _ in range(30))} {passage} x{d} y{d}") for d in range(1200)]
    docs = docs_of(pairs, 30)
    seeds = runs.seeds(docs, base.by_document(docs), "word", 8, 20, 100)
    assert max(r["count"] for r in seeds.groupBy("bucket").count().collect()) < 200
    got = rows_by_id(substring.without_repeats(docs, hot=100))
    assert {d: r.n_removed for d, r in got.items()} == {d: 25 if d else 0 for d in range(1200)}


def test_lengths_beyond_what_runs_hold_are_refused(spark, docs_of, rows_by_id):
    base.ready(spark)
    body = " ".join(f"{i:x}" for i in range(700))
    pairs = [(d, f"{d} {body} {d}") for d in range(3)]
    widest = 200 + runs.MOST_WINDOWS - 1
    got = rows_by_id(suffix_dedup.without_repeats(docs_of(pairs), length=widest, gram=200))
    assert {d: (r.n_bytes, r.n_removed, bytes(r.kept)) for d, r in got.items()} == brute_bytes(pairs, widest)
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.without_repeats(docs_of(pairs), length=widest + 1, gram=200)
    with pytest.raises(ValueError, match="length"):
        substring.without_repeats(docs_of(pairs), length=2000, gram=8)


def brute_all_words(pairs, length):
    """Remaining text without all occurrences of repeated windows of words, each word with the white space behind it."""
    split = {d: re.findall(r"[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", t or "") for d, t in pairs}
    bare = {d: [w.strip(" \t\n\v\f\r") for w in ws] for d, ws in split.items()}
    count = Counter(tuple(ws[i : i + length]) for ws in bare.values() for i in range(len(ws) - length + 1))
    out = {}
    for d, t in pairs:
        ws, gone = bare[d], set()
        for i in range(len(ws) - length + 1):
            if count[tuple(ws[i : i + length])] > 1:
                gone.update(range(i, i + length))
        head = re.match(r"[ \t\n\v\f\r]*", t or "")[0]
        out[d] = head + "".join(w for i, w in enumerate(split[d]) if i not in gone)
    return out


@pytest.mark.parametrize(("seed", "hot", "shard"), [(1, 64, 1 << 20), (2, 2, 400), (3, 2, 1 << 20), (4, 1000, 300)])
def test_all_occurrences_of_words_as_by_brute_force(spark, docs_of, word_texts, rows_by_id, seed, hot, shard):
    base.ready(spark)
    pairs = list(enumerate(word_texts(seed, vocabulary=6 if seed == 3 else 30)))
    got = rows_by_id(suffix_dedup.without_repeats(docs_of(pairs), length=9, gram=4, hot=hot, shard_bytes=shard, unit="word"))
    assert {d: bytes(r.kept).decode() for d, r in got.items()} == brute_all_words(pairs, 9)
    assert all(r.n_removed == r.n_bytes - len(r.kept) == sum(s.length for s in r.spans) for r in got.values())


def test_suffix_array_and_common_prefixes():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(30, 90))).encode() for _ in range(8)]
    texts += [texts[0], texts[1][5:]]
    data, starts = suffixes.joined(texts)
    limit = 21
    order = suffixes.suffix_array(data, limit)
    raw = data.tobytes()
    keys = [raw[i : i + limit] for i in order.tolist() if i < len(raw) - limit]
    assert keys == sorted(keys)
    counts = np.array([len(t) - limit + 1 for t in texts])
    common = suffixes.common_prefixes(data, order, starts, counts, limit)
    before = dict(zip(order[1:].tolist(), order[:-1].tolist(), strict=True))
    for i in spread(starts, counts).tolist():
        j = before.get(i)
        a, b = raw[i : i + limit], raw[j : j + limit] if j is not None else b""
        same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common[i] == same


def test_winnowing_in_stretches(monkeypatch):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 9, 5000).astype(np.uint64)
    bounds = np.array([0, 700, 700, 730, 4000, 5000])
    whole = rolling.winnowed(values, bounds, 5, 30, rolling.BASES[0])
    monkeypatch.setattr(rolling, "POSITION_BITS", 8)
    parts = rolling.winnowed(values, bounds, 5, 30, rolling.BASES[0])
    assert (whole[0] == parts[0]).all()
    at, anchors, grams = parts
    for w, a in zip(at.tolist(), anchors.tolist(), strict=True):
        assert w <= a <= w + 25
        high = grams[w : w + 26] >> np.uint64(8)
        assert a - w == 25 - int(np.argmin(high[::-1]))
    assert set(at.tolist()) == {i for b, e in zip(bounds[:-1], bounds[1:], strict=True) for i in range(b, e - 29)}


def test_query_has_the_contract(spark):
    out = substring.op1_substring_dedup(spark, "/root/testdata/sf0.001")
    assert out.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    row = out.where("n_removed = 0").first()
    assert re.fullmatch("[0-9a-f]{64}", row.kept_sha256)
    assert hashlib.sha256(b"").hexdigest() != row.kept_sha256


def test_workers_keep_nothing_of_other_stages(monkeypatch):
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a few words " * 30, None])], names=["doc_id", "text"])
    pieces = list(packing._pieces(iter([batch]), 16, tokens.TOKENIZER, tokens.END, False))
    assert sum(x.num_rows for x in pieces) > 2
    assert tokens.encoder.cache_info().currsize and not rolling._powers
    assert list(runs._counted(iter([batch]), "word", 4, 9))
    assert not tokens.encoder.cache_info().currsize and not rolling._powers


def test_suffix_arrays_take_few_bytes_a_place():
    rng = random.Random(3)
    passage = rng.randbytes(2000).hex()
    texts = [(rng.randbytes(1500).hex() + passage[: rng.randrange(4000)]).encode() for _ in range(100)]
    data, starts = suffixes.joined(texts)
    counts = np.array([len(t) - 399 for t in texts])
    tracemalloc.start()
    try:
        order = suffixes.suffix_array(data, 400)
        first = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        suffixes.common_prefixes(data, order, starts, counts, 400)
        second = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert first < 46 * len(data) and second < 26 * len(data)
