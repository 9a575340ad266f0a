"""Queries against their SQL twins at the smallest scale, and on fixtures with the awkward cases."""

import duckdb
import pytest

from glycoflow.llm import base, catalog, decontam, lines, minhash, quotes, substring, warc

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "pages", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(rows, columns):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    result = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(result.fetchall(), columns)


def same_on(spark, df, tables, sql):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register("arrow_" + name, frame.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow_{name}")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    got = plain(df.select(*columns).collect(), columns)
    assert got == plain(result.fetchall(), columns)
    return got


@pytest.mark.parametrize("seed", [11, 12])
def test_words_against_sql_on_awkward_texts(spark, docs_of, word_texts, seed):
    base.ready(spark)
    docs = docs_of(word_texts(seed, vocabulary=8))
    out = substring.without_repeats(docs).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256", "n_repeats")
    same_on(spark, out, {"documents": docs}, substring.SQL)
    same_on(spark, minhash.near_duplicates(docs), {"documents": docs}, minhash.SQL)


def test_line_rules_on_awkward_texts(spark, docs_of, word_texts):
    base.ready(spark)
    boiler = "Subscribe  to OUR letter\nall rights reserved by the owners of this place and its many friends"
    texts = word_texts(21, count=60, longest=60)
    texts = [f"{t}\n{boiler if i % 2 else boiler.upper()}" if i % 3 == 0 and t is not None else t for i, t in enumerate(texts)]
    texts += ["## ** $$ <b>|</b> % & words " * 9, "same line here\nsame line here\n\nsame line here\n \n"]
    docs = docs_of(texts)
    got = same_on(spark, lines.judged(docs), {"documents": docs}, lines.SQL)
    assert any(r[sorted(["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words"]).index("n_line_words")] for r in got)


def test_line_rules_on_repeated_and_null_rows(spark, docs_of):
    text = "\n".join(f"line {i} of some words that stand here" for i in range(8))
    rows = lines.judged(docs_of([(1, text), (1, text), (2, None), (None, text), (3, text + " more")])).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_line_words, r.kept) for r in rows) == [(-1, 64, 0, True), (1, 64, 0, True), (2, 0, 0, False), (3, 65, 0, True)]
    assert lines.judged(docs_of(["x"]).where("false")).count() == 0


def test_depleted_documents_are_rejected(spark, docs_of):
    common = "\n".join(" ".join(f"{w}{i}" for w in "a common line with few more words in it now".split()) for i in range(4))
    own = [" ".join(f"own{i}x{k}" for k in range(25 if i % 2 else 60)) for i in range(40)]
    rows = lines.judged(docs_of([common + "\n" + x for x in own])).collect()
    assert all(r.n_line_words == 40 and not r.base_failed for r in rows)
    assert all(r.kept == (r.doc_id % 2 == 0) for r in rows)


def test_lines_of_many_documents_go_on_a_host_of_any_size(spark, docs_of):
    """A line on 4 % of a host's documents, which the share alone would keep."""
    shared = "one line that some pages of this host have in common with each other"
    own = [" ".join(f"own{i}x{k}" for k in range(30)) for i in range(500)]
    docs = docs_of([(i, f"{x}\n{shared}" if i % 25 == 0 else x) for i, x in enumerate(own)]).selectExpr("doc_id", "text", "'h' AS source")
    assert {r.n_line_words for r in lines.judged(docs).collect()} == {0}
    assert sum(r.n_line_words > 0 for r in lines.judged(docs, most=15).collect()) == 20


def benchmark_of(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def test_decontamination_tolerates_two_substitutions(spark, docs_of, rows_by_id):
    item = [f"tok{i}" for i in range(20)]
    rows = []
    for a in range(13):
        for b in range(a, 13):
            copy = list(item[3:16])
            copy[a] = copy[b] = "other"
            rows.append("before it, " + " ".join(copy).upper() + "! and after")
    rows += [" ".join(item[:12]), " ".join(["other" if i % 4 == 3 else w for i, w in enumerate(item)]), "", None, "tok1 " * 50]
    docs = docs_of(rows)
    bench = benchmark_of(spark, [(1, " ".join(item)), (2, "too short for it"), (3, None), (None, " ".join(item)), (4, "a b c d e f g h i")])
    out = decontam.contaminated(docs, bench)
    found = {(r.doc_id, r.item_id) for r in out.collect()}
    assert found == {(i, 1) for i in range(91)}
    same_on(spark, out, {"documents": docs, "benchmark": bench.where("item_id IS NOT NULL")}, decontam.SQL)
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == set(range(91, 96))


def test_decontamination_without_broadcast_and_on_empty_tables(spark, docs_of, monkeypatch):
    item = " ".join(f"tok{i}" for i in range(20))
    bench = benchmark_of(spark, [(1, item), (2, "a b c d e f g h i")])
    docs = docs_of([item, "x a b c d e f g h i y", "a b c d e f g other i", "other b c d e f g h other"])
    want = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert want == {(0, 1), (1, 2)}
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()} == want
    assert decontam.contaminated(docs.where("false"), bench).count() == 0
    assert decontam.contaminated(docs, bench.where("false")).count() == 0


def test_broadcast_seeds_have_a_fixed_width(spark, docs_of, monkeypatch):
    marked = []
    monkeypatch.setattr(decontam.F, "broadcast", lambda df: marked.append(df.dtypes) or df.hint("broadcast"))
    item = [f"tok{i}" for i in range(200)]
    late = item[180:]
    late[4] = late[9] = "other"
    docs = docs_of([" ".join(item), " ".join(["before", *late, "after"]), " ".join(item[150:162])])
    bench = benchmark_of(spark, [(1, " ".join(item)), (2, "a b c d e f g h i")])
    out = decontam.contaminated(docs, bench)
    assert {(r.doc_id, r.item_id, r.n_matched, r.n_tokens) for r in out.collect()} == {(0, 1, 13, 13), (1, 1, 12, 13)}
    assert marked and {kind for columns in marked for _, kind in columns} <= {"bigint", "int"}


@pytest.mark.parametrize("rows", [0, decontam.BROADCAST_ROWS])
def test_decontamination_equals_sql_with_and_without_broadcast(spark, docs_of, word_texts, monkeypatch, rows):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    texts = word_texts(31, count=40, vocabulary=12)
    docs = docs_of(texts)
    bench = benchmark_of(spark, [(i, t) for i, t in enumerate(word_texts(32, count=20, vocabulary=12, longest=30))] + [(100, texts[2]), (101, texts[3][:60])])
    same_on(spark, decontam.contaminated(docs, bench), {"documents": docs, "benchmark": bench}, decontam.SQL)


TALK = [
    (1, 0, "user", "Where shall we meet?\nI could come by train."),
    (1, 1, "assistant", "> Where shall we meet?\nAt the station."),
    (1, 2, "user", ">> Where  shall we MEET?\n> At the station.\n\nWhich one?"),
    (1, 3, "assistant", "Unrelated remark"),
    (1, 4, "user", "> I could come by train.\n> nobody wrote this\nDo."),
    (1, 5, "user", "> > > deep and unknown\n> Which one?\nThe large one"),
    (1, 6, "user", "> The large one\n>\n> Unrelated remark\nboth"),
    (2, 0, "user", "At the station."),
    (2, 1, "user", "> Unrelated remark\nnot of this talk"),
    (2, 2, None, None),
    (2, 3, "user", ""),
    (2, 3, "user", "> At the station.\n> \n"),
    (2, 4, "user", "> later words\nx"),
    (2, 5, "user", "later words"),
    (None, 1, "user", "nameless"),
    (3, None, "user", "> no turn"),
]


def test_quotes_are_linked_and_removed(spark):
    base.ready(spark)
    talk = spark.createDataFrame([(*r, 1, "p") for r in TALK], "conv_id long, turn long, role string, text string, level int, path string")
    rows = quotes.threaded(talk)
    out = {(r.conv_id, r.turn): r for r in rows.collect()}
    assert {k: r.parent_turn for k, r in out.items() if r.parent_turn is not None} == {(1, 1): 0, (1, 2): 1, (1, 4): 0, (1, 5): 2, (1, 6): 3, (2, 3): 0}
    assert out[1, 2].text == "Which one?"
    assert out[1, 5].path == "/".join(f"{t + 2**63:020}" for t in (0, 1, 2, 5))
    ordered = [k[1] for k in sorted((k for k in out if k[0] == 1), key=lambda k: out[k].path)]
    assert ordered == [0, 1, 2, 5, 4, 3, 6]
    digest = rows.selectExpr("*", "sha2(text, 256) AS text_sha256").drop("text")
    same_on(spark, digest, {"conversations": talk}, quotes.SQL)
    assert quotes.threaded(talk.where("false")).count() == 0


def test_long_reply_chain(spark):
    base.ready(spark)
    talk = spark.createDataFrame([(1, i, "user", f"> words {i - 1}\nwords {i}") for i in range(40)], "conv_id long, turn long, role string, text string")
    out = {r.turn: r.path for r in quotes.threaded(talk).collect()}
    assert out[39] == "/".join(f"{t + 2**63:020}" for t in range(40))


def test_turns_of_any_length_stay_apart(spark):
    base.ready(spark)
    turns = [-(2**63), -5, 3, 1_000_000_000_001, 1_000_000_000_004, 2**63 - 1]
    rows = [(1, t, "user", f"> words {k - 1}\nwords {k}" if k % 2 else f"words {k}") for k, t in enumerate(turns)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = quotes.threaded(talk)
    paths = {r.turn: r.path for r in out.collect()}
    assert len(set(paths.values())) == len(turns)
    assert sorted(turns, key=paths.get) == turns
    same_on(spark, out.selectExpr("*", "sha2(text, 256) AS text_sha256").drop("text"), {"conversations": talk}, quotes.SQL)


PAGES = [
    (5, "http://a/5", "x" * 150), (3, "http://a/3", "x" * 150), (9, None, "x" * 150), (4, "http://a/\r\nX-Evil: 1", "y" * 99), (6, "u", "y" * 99),
    (7, "u", None), (8, "u", ""), (10, "u", "é" * 50 + "\r\n\r\nWARC/1.1\r\n\r\n"), (11, "u", "é" * 50 + "\r\n\r\nWARC/1.1\r\n\r\n"), (12, "u", "line\n" * 30),
    (12, "u", "line\n" * 30), (None, "u", "x" * 150),
]


def test_archives_round_trip(spark):
    base.ready(spark)
    pages = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, bytes int").repartition(3)
    folder = base.shared_folder(spark)
    warc.write_archives(pages, folder)
    found = warc.resolved(warc.read_archives(spark, folder))
    rows = {r.page_id: r for r in found.collect()}
    assert {k: r.refers_to for k, r in rows.items()} == {3: None, 5: 3, 9: 3, 4: None, 6: None, 7: None, 8: None, 10: None, 11: 10, 12: None}
    html = {p: h or "" for p, _, h in PAGES if p is not None}
    assert {k: bytes(r.payload).decode() for k, r in rows.items()} == html
    assert all(r.header_digest == r.payload_digest for r in rows.values())
    assert rows[4].url == "http://a/%20%20X-Evil:%201"
    out = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    same_on(spark, out, {"pages": pages.where("page_id IS NOT NULL").distinct()}, warc.SQL)


def test_archives_are_read_in_pieces(spark, monkeypatch):
    """Payloads larger than a piece and a batch, ties between repeated rows, and members one after the other."""
    import gzip

    base.ready(spark)
    monkeypatch.setattr(warc, "PER_FILE", 2)
    large = "0123456789" * 400_000
    pages = [(i, f"u{i}", large + str(i % 3)) for i in range(7)] + [(3, "u3", large + "0"), (3, "u3", large + "0")]
    folder = base.shared_folder(spark)
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), folder)
    found = {r.page_id: r for r in warc.resolved(warc.read_archives(spark, folder)).collect()}
    assert {k: (bytes(r.payload).decode() == large + str(k % 3), r.refers_to) for k, r in found.items()} == {
        k: (True, None if k < 3 else k % 3) for k in range(7)
    }
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\na\r\n\r\n\r\n\r\n"
    for step in (1, 3, 1000):
        pieces = warc.unpacked(gzip.compress(record) + gzip.compress(record * 2), step)
        assert [b for _, b in warc.parse(pieces)] == [b"a\r\n\r\n"] * 3
    for broken in (record[:-1], record + b"X", record.replace(b"5", b"4")):
        with pytest.raises(ValueError, match="record"):
            list(warc.parse(iter([broken])))


def test_archives_of_no_pages(spark):
    base.ready(spark)
    folder = base.shared_folder(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.resolved(warc.read_archives(spark, folder)).count() == 0
