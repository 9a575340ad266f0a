import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from glycoflow.llm import base, frames, packing, tokens

TEXTS = [
    "Plain words, with 'quotes' and don't.", "two  blanks", "tab\tand\nline \n ends ", " leading", "trailing ", "", None,
    "nbsp here   x", "a <|endoftext|> b  <|endoftext|>", "zero\x00byte", "日本語 テキスト", "émoji 🎉🎉 x", "x" * 3000, "a b " * 3000,
]


def plain(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain.made = getattr(plain, "made", None) or Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    return plain.made.encode(text or "", add_special_tokens=False).ids + [2]


def test_words_give_the_ids_of_the_whole_text():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["a", "B ", " ", "'s", "\n", "é", "12", "!", "　", ". ", " the"]) for _ in range(80)) for _ in range(300)]
    for text, ids in zip(texts, tokens.encoder().encode(pa.array(texts, pa.string())), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain(text)


def test_white_space_beyond_ascii_gives_the_ids_of_the_whole_text():
    rng = random.Random(5)
    odd = [chr(x) for x in (0x09, 0x0A, 0x0D, 0x1C, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x180E, 0x2003, 0x200A, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000)]
    some = odd + [" ", "  ", " a", "B", "7", "é", "à", "É ", "中", "'s", "!!", "(x)", ".", ", ", "½", "é́", "<|", "|>"]
    texts = ["".join(rng.choices(some, k=rng.randint(1, 60))) for _ in range(2000)]
    for text, ids in zip(texts, tokens.encoder().encode(pa.array(texts, pa.string())), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain(text)


def test_texts_with_double_blanks_encode_each_piece_once(monkeypatch):
    import public_tokenizers

    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefg", k=6)) for _ in range(50)]
    texts = ["  ".join(w + rng.choice(["", "!", "??", ")"]) for w in rng.choices(words, k=40)) for _ in range(200)]
    encoder = tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER), tokens.END)
    sent = []
    inner = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda some: sent.append(sum(map(len, some))) or inner(some))
    for _ in range(2):
        out = encoder.encode(pa.array(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in out] == [plain(x) for x in texts]
    assert sum(sent) < 0.1 * sum(map(len, texts))


def test_known_pieces_of_one_slot_stay_apart():
    known = tokens.Known()
    n = 40_000
    for batch in range(6):
        number = np.arange(batch * n, (batch + 1) * n, dtype=np.uint64)
        # By twos equal in the first hash.
        high, low = number // np.uint64(2) << np.uint64(1), number
        assert (known.find(high, low) == -1).all()
        assert known.add(high, low, np.repeat(number, 2).astype("<u4"), np.full(n, 2)).tolist() == number.tolist()
    number = np.arange(6 * n, dtype=np.uint64)
    rows = known.find(number // np.uint64(2) << np.uint64(1), number)
    assert rows.tolist() == number.tolist()
    begins, counts = known.places[:, rows]
    assert (known.ids[begins] == number).all() and (counts == 2).all()


def test_frames_round_trip_and_random_access():
    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    sink = io.BytesIO()
    writer = frames.Writer(sink, frame_ids=50)
    docs = [(i, np.arange(i % 40 + 1, dtype="<u4").tobytes()) for i in range(60)] + [(None, b"\x02\0\0\0")]
    for doc, ids in docs:
        writer.add(doc, ids)
    writer.finish()
    reader = frames.Reader(Source(sink.getvalue()))
    assert [(d, x) for d, _, x in reader.documents()] == docs
    opened = []
    reader.frame = lambda n, f=reader.frame: opened.append(n) or f(n)
    assert [d for d, _, _ in reader.documents({17})] == [17]
    assert len(opened) == 1 < len(reader.table)
    data = bytearray(sink.getvalue())
    data[10] ^= 1
    with pytest.raises(Exception, match="checksum|decompress|corrupt|Data"):
        list(frames.Reader(Source(bytes(data))).documents())


def test_zstandard_reads_the_file_as_one_stream():
    import zstandard

    sink = io.BytesIO()
    writer = frames.Writer(sink, frame_ids=8)
    for i in range(20):
        writer.add(i, np.arange(i, dtype="<u4").tobytes())
    writer.finish()
    data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read()
    assert data == b"".join(np.arange(i, dtype="<u4").tobytes() for i in range(20))


def test_ids_from_files(spark, docs_of):
    base.ready(spark)
    pairs = list(enumerate(TEXTS)) + [(3, "again"), (None, "nameless")]
    manifest = frames.write_ids(docs_of(pairs), base.shared_folder(spark), frame_ids=64)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in frames.read_ids(manifest).collect()), key=lambda r: r[1])
    want, at = [], 0
    for doc, text in sorted(pairs, key=lambda p: (-1 if p[0] is None else p[0], p[1] or "")):
        ids = np.array(plain(text), dtype="<u4")
        want.append((-1 if doc is None else doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert [r.doc_id for r in frames.read_ids(manifest, {4}).collect()] == [4]


def test_no_documents(spark, docs_of):
    base.ready(spark)
    empty = docs_of(["x"]).where("false")
    assert frames.read_ids(frames.write_ids(empty, base.shared_folder(spark))).count() == 0
    assert packing.packed(empty).count() == 0


def test_packing_places_every_id_once(spark, docs_of):
    base.ready(spark)
    rng = random.Random(4)
    pairs = [(i, " ".join(rng.choice(["the", "of", "hello"]) for _ in range(rng.choice([0, 3, 20, 60, 200])))) for i in range(200)]
    pairs += [(900, None), (5, "again"), (None, "nameless"), (901, "x y " * 200)]
    size = 64
    rows = packing.packed(docs_of(pairs), size=size, keep_ids=True).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == len(r.ids) // 4
        assert r.ids_crc32 == zlib.crc32(r.ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.piece):
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc, text in pairs:
        if doc == 5:
            continue
        parts = by_doc[doc]
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == plain(text)
        assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        assert all(p.length == size for p in parts[1:])
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.05 * -(-total // size) + 1


def test_smallest_gives_way_to_two_that_fit_better():
    counts = np.zeros(101, dtype=np.int64)
    for x in (60, 30, 21, 18, 1):
        counts[x] = 1
    counts[1] = 0
    # 60 + 30 leaves 10; instead of 30, 21 + 18 fill 39 of 40.
    assert packing.fill(counts, 100) == [60, 21, 18]


def test_fillings_are_few_and_near_the_bound():
    rng = np.random.default_rng(5)
    lengths = np.minimum(rng.geometric(1 / 180, 200_000), 1024)
    counts = np.bincount(lengths, minlength=1025)
    plan = packing.fillings(counts, 1024)
    used = np.zeros(1025, dtype=np.int64)
    for filling, times in plan:
        assert sum(filling) <= 1024
        for x in filling:
            used[x] += times
    assert (used == counts).all()
    assert len(plan) < 5000
    assert sum(t for _, t in plan) <= 1.001 * lengths.sum() / 1024 + 1
