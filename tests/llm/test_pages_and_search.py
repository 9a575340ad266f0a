"""op11, op12 and op13 against plain Python and against labelled pages."""

import hashlib
import math
import random
import re
import zlib

import pytest

from glycoflow.llm import align, blocks, crf, extract, labelled, repair, search

PAGES = "page_id long, url string, html string"
TURNS = "conv_id long, turn long, role string, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# op11


@pytest.fixture(scope="module")
def model():
    return extract.trained()


def test_blocks_of_ill_formed_markup():
    page = """<p>a &amp; b &am <b>c<br>d<p class='x>y' title="1 > 2">e < f
      g<script>"</p>"</script><ul><li>h<li><a href=/>i</a></ul></div><h2>j</h3>k<!-- l"""
    found = blocks.blocks(page)
    assert [b.text for b in found] == ["a & b &am c d", "e < f g", "h", "i", "j", "k"]
    assert [b.tag for b in found] == ["p", "p", "li", "li", "h2", ""]
    assert found[3].linked == 1 and found[0].bold
    assert blocks.blocks("") == [] and blocks.blocks("<") != []


@pytest.mark.parametrize("page", ["<a href='x " * 5000, "<!-- " * 5000, "<div>" * 5000 + "x</p>" * 5000, "<" * 50_000, "<script>" * 5000])
def test_blocks_of_odd_pages_take_linear_time(page):
    assert len(blocks.blocks(page)) <= 5000


def brute_decode(field, sequence):
    best = None
    for number in range(1 << len(sequence)):
        labels = [number >> t & 1 for t in range(len(sequence))]
        score = field.first[labels[0]] + field.last[labels[-1]] + sum(field.steps[a, b] for a, b in zip(labels, labels[1:]))
        score += sum(field.weights.get(f, 0) for y, fs in zip(labels, sequence) for f in fs if y)
        if best is None or score > best[0]:
            best = (score, labels)
    return best[1]


def test_viterbi_finds_the_best_of_all_labellings(model):
    rng = random.Random(3)
    names = list(model.weights)
    for _ in range(40):
        sequence = [rng.sample(names, rng.randint(0, 4)) for _ in range(rng.randint(1, 9))]
        assert model.decode(sequence) == brute_decode(model, sequence)
    assert model.decode([]) == []


def test_training_learns_what_only_neighbours_tell():
    rng = random.Random(5)
    sequences, labels = [], []
    for _ in range(200):
        state, s, y = rng.randint(0, 1), [], []
        for _ in range(12):
            state = state if rng.random() < 0.95 else 1 - state
            y.append(state)
            s.append(["any", f"hint {state}"] if rng.random() < 0.4 else ["any"])
        sequences.append(s)
        labels.append(y)
    field = crf.fitted(sequences[:150], labels[:150], 120)
    right = sum(a == b for s, y in zip(sequences[150:], labels[150:]) for a, b in zip(field.decode(s), y))
    assert right > 0.9 * 50 * 12 and field.steps[0, 0] > field.steps[0, 1]


def test_main_text_of_labelled_pages_not_trained_on(model):
    wrong = total = 0
    for seed in range(50_000, 50_300):
        _, found, labels = labelled.labelled_page(seed)
        wrong += sum(a != b for a, b in zip(model.decode(extract.features(found)), labels))
        total += len(labels)
    assert wrong < 0.01 * total


def test_main_text_without_what_surrounds_it(model):
    page = """<html><head><title>Site</title></head><body><div class="menu"><a href=/a>Home</a> <a href=/b>News</a></div>
      <div class="cookie-notice"><p>We use cookies to make this site work. Please accept.</p></div>
      <div class="post-content"><h1>On rivers</h1><p>Rivers run &amp; run, from the hills   to the sea.</p>
      <div class="ad">Buy boats now, cheap and good.</div><p>Some of them are very long, and some are not.</p></div>
      <div class="sidebar"><h3>Popular</h3><ul><li><a href=/c>Lakes of the north</a></ul></div>
      <section id="comments"><p>I liked this text a lot, thank you for it!</p></section>
      <form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2024 Rivers</footer></body></html>"""
    text, _ = extract.main_text(page, model)
    assert text == "On rivers\nRivers run & run, from the hills to the sea.\nSome of them are very long, and some are not."


def test_extraction_of_awkward_rows(spark, model):
    long = "<article><h1>T</h1>" + "<p>Some words of a paragraph, and a stop.</p>" * 30_000 + "</article>"
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<article><p>Only this one, as it is.</p></article>"), (2, "v", long), (2, "v", long), (3, None, "<nav><a href=/>x</a></nav>")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS n_blocks", "'t' AS tag").repartition(3)
    out = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract.extracted(df, model).collect()))
    body = "T\n" + "\n".join(["Some words of a paragraph, and a stop."] * 30_000)
    assert out == sorted([(1, "u", "", 0), (1, "u", "", 0), (0, "", "Only this one, as it is.", 24), (2, "v", body, len(body)), (2, "v", body, len(body)), (3, "", "", 0)])
    assert extract.extracted(df.limit(0), model).count() == 0


# op12

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def brute_alignment(turns):
    """Cheapest edits by dynamic programming over states, whole audits compared."""
    at = {0: (0, "")}
    for t in turns:
        new = {}
        for state, (cost, audit) in at.items():
            for _ in range(4):
                ways = [(state, cost + 2, audit + "D")]
                if not t.gone:
                    ways.append((NEXT[state], cost + 1 + t.extra, audit + "R"))
                    if t.initial == "s" and state == 0:
                        ways.append((1, cost + t.extra, audit + "K"))
                    if t.initial == ("a" if state == 2 else "u"):
                        ways.append((NEXT[state], cost + t.extra, audit + "K"))
                for s, c, a in ways:
                    new[s] = min(new.get(s, (c, a)), (c, a))
                state, cost, audit = NEXT[state], cost + 5, audit + "I"
        at = new
    return min((c + 5 * len(align.TAILS[s]), a + align.TAILS[s]) for s, (c, a) in at.items())


def all_edits(turns):
    """Every edit script of up to three insertions."""
    best = (2 * len(turns), "D" * len(turns))

    def go(i, out, cost, audit):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(turns):
            if re.fullmatch(r"(s?(ua)+)?", out):
                best = min(best, (cost, audit))
        else:
            t = turns[i]
            go(i + 1, out, cost + 2, audit + "D")
            if not t.gone:
                go(i + 1, out + t.initial, cost + t.extra, audit + "K")
                for r in "ua":
                    go(i + 1, out + r, cost + 1 + t.extra, audit + "R")
        if audit.count("I") < 3:
            for r in "ua":
                go(i, out + r, cost + 5, audit + "I")

    go(0, "", 0, "")
    return best


def random_turns(rng, n, symbols="uausat"):
    return [align.Turn(rng.choice(symbols), rng.random() < 0.15, 5 * (rng.random() < 0.15)) for _ in range(n)]


def test_alignment_against_all_edits():
    rng = random.Random(1)
    for _ in range(200):
        turns = random_turns(rng, rng.randint(0, 4))
        assert align.whole(turns) == all_edits(turns)


def test_alignment_against_all_states():
    rng = random.Random(2)
    for _ in range(400):
        turns = random_turns(rng, rng.randint(1, 14), rng.choice(["uausat", "ua", "s", "t", "au"]))
        assert align.whole(turns) == brute_alignment(turns)
    turns = random_turns(rng, 300, "uuuuaaaa")
    assert align.whole(turns) == brute_alignment(turns)


def plain_repair(rows):
    """What the query returns, from (conv_id, turn, role, text), in plain Python."""
    convs = {}
    for conv, turn, role, text in rows:
        have = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        chance = zlib.crc32(key.encode()) % 20
        text = "" if chance == 1 else re.sub("[.!?]", "", text) if chance == 2 else text
        role = "user" if chance == 4 else role
        have += [(turn, role, text)] * {0: 0, 3: 2}.get(chance, 1)
    out = {}
    for conv, have in convs.items():
        have.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in have:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            turns.append(align.Turn(role[:1], fault in ("blank", "duplicate"), 5 * (fault == "truncated")))
        known = [t for t, _, _ in have if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = brute_alignment(turns)
        said, at, expected = [], 0, "u"
        for letter in audit:
            role = {"u": "user", "a": "assistant"}[expected]
            text = ""
            if letter != "I":
                _, own, text = have[at]
                at += 1
                if letter == "D":
                    continue
                role = own if letter == "K" else role
            said.append(f"{role}:{text}")
            expected = "u" if role[0] in "sa" else "a"
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def conversations(rng, count, longest):
    rows = []
    for conv in range(count):
        n = longest if conv == 0 else rng.randint(0, 9)
        texts = [f"Words number {i}{rng.choice(['.', '!', '?', '', ' ', '. '])}" for i in range(max(3, n * 2 // 3))] + ["", "  ", None]
        for turn in range(n):
            role = rng.choice(["user", "assistant"][turn % 2 :: 1] + [["user", "assistant"][turn % 2]] * 6 + ["system", "tool", "", None])
            at = rng.choice([turn] * 9 + [None, turn + 1])
            rows.append((conv if conv % 13 else None, at, role, rng.choice(texts)))
    rows += [r for r in rows if rng.random() < 0.05]
    return rows


@pytest.mark.parametrize("block, parts", [(256, 1), (7, 5), (1, 3)])
def test_repair_in_one_and_in_many_blocks(spark, block, parts):
    rows = conversations(random.Random(block), 60, 150)
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS block", "'x' AS audit", "2 AS hash", "3 AS copies", "4 AS row").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.conv_id: tuple(r)[1:] for r in repair.repaired(repair.damaged(df), block).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == plain_repair(rows)


def test_repair_of_awkward_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert repair.repaired(repair.damaged(empty)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    long = "word " * 400_000 + "."
    rows = [(dropped, 0, "user", "Hello."), (5000, None, None, None), (5001, 3, "user", long), (5001, 3, "assistant", long), (5001, 3, "user", long)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repaired(repair.damaged(spark.createDataFrame(rows, TURNS))).collect()}
    assert got == plain_repair(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    given = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Yes.")], TURNS)
    out = {r.conv_id: (r.cost, r.audit) for r in repair.repaired(repair.as_given(given)).collect()}
    assert out == {1: (0, "KK"), 2: (2, "D")}


# op13


def plain_search(docs, items, top):
    terms = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    held = [ts for _, ts in terms if ts]
    documents, length = len(held), sum(map(len, held))
    df = {}
    for ts in held:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, ts in terms:
            score = 0
            for t in set(TERM.findall((text or "").translate(LOWER))) & set(ts):
                tf, m = ts.count(t), 50 + 50 * len(ts) * documents // length
                score += math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], start=1)]
    return out


@pytest.mark.parametrize("width, block", [(1024, 2 << 20), (4, 4000), (1, 2000)])
def test_search_against_scores_of_all_documents(spark, word_texts, width, block):
    texts = word_texts(9, 80) + ["Ünï-Code ÜNÏ", "A.b,C 1a", "x" * 300_000, "straße w1 " * 50_000]
    docs = list(enumerate(texts)) + [(None, texts[3]), (None, None), (3, texts[3]), (4, "w1")]
    items = [(i, t) for i, t in enumerate(texts[:25] + ["nowhere", "ünï code", "", None, "w1 w1 W1 w2", "STRASSE straße a B"])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 AS score", "'q' AS item_id", "1 AS rank").repartition(4)
    asked = spark.createDataFrame(items + [(None, "w1"), (0, None)], "item_id long, text string").selectExpr("*", "3 AS doc_id")
    got = sorted(tuple(r) for r in search.searched(df, asked, 10, width, block).collect())
    assert got == sorted(plain_search(docs, items, 10))


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.searched(none, asked).count() == 0
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert search.searched(some, asked.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in search.searched(some, asked).collect()] == [(1, 1, 1)]


def test_bounds_are_never_below_scores_and_spare_most_documents(monkeypatch):
    rng = random.Random(4)
    words = [f"t{i}" for i in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(20, 200))) for _ in range(2000)]
    queries = search.queries_of([{"item_id": i, "text": " ".join(rng.choices(words, k=8))} for i in range(20)])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    counts = {r["term"]: r["n"] for r in next(search._counted(iter([batch]), queries)).to_pylist()}
    import numpy as np

    df = np.array([counts.get(i, 0) for i in range(len(queries.terms))])
    stats = search.Statistics(counts[-1], counts[-2], np.floor(1000 * np.log((2 * counts[-1] + 2) / (2 * df + 1))).astype(np.int64))
    scored = []
    inner = search._rescored
    monkeypatch.setattr(search, "_rescored", lambda *a: scored.append(inner(*a)))
    monkeypatch.setattr(search, "STEP", 8)
    out = next(search._searched(iter([batch]), queries, stats, 10, 1024))
    assert out.num_rows == 10
    assert sum(scored) < 0.1 * 2000 * 20
