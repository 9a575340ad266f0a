"""Conversation structure repair: turns aligned to strings of alternating roles.

Rows are sorted by conversation and turn over all tasks, so that a long conversation spreads over many. A task reads
its rows in order and cuts conversations into blocks; a conversation that lies in one block inside a task is aligned at
once (align.py). The blocks of others are aligned from every state of the target string to every other; one small row
per block tells the costs, a scan over these rows picks the states between blocks, and blocks give their part of the
audit. Texts cross the network twice at most, in blocks.

The audit and the hash of a conversation are single values: the parts of a conversation go through one task in
their order, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glycoflow.llm import align, base

#: Turns and bytes of text in one block; a text alone may be longer.
BLOCK_TURNS, BLOCK_BYTES = 256, 4 << 20
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = [("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())]
BODY = [("block", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("hashes", pa.list_(pa.binary()))]
CUT = pa.schema([*RESULT, ("done", pa.bool_()), *BODY])
#: Of a block: costs and ranks by state before and after it, counts, and what its neighbours need to know.
SUMMARY = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())),
                     ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                     ("first", pa.string()), ("last", pa.string()), ("turns", pa.list_(pa.int64()))])
CHOSEN = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("before", pa.int64()), ("after", pa.int64()), ("final", pa.bool_()), *((c, pa.int64()) for c in COUNTS)])
PARTS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("audit", pa.string()), ("text", pa.string()), ("final", pa.bool_()), *((c, pa.int64()) for c in COUNTS)])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type] if f.type in names else f'array<{names[f.type.value_type]}>'}" for f in schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (how often the row is there; 0 if it is dropped)."""
    number = lambda name: F.coalesce(F.col(name).cast("bigint").cast("string"), F.lit(" "))
    chance = (F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn"))) % 20).alias("chance")
    filled = [F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name) for name in ("role", "text")]
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *filled, chance)
    text: Column = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("chance") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("chance") == 0, 0).when(F.col("chance") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def as_given(conversations: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of ``damaged``."""
    filled = [F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name) for name in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *filled, F.lit(1).alias("copies"))


def _hash(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def judged(rows: list[tuple[str, str]], earlier: set[bytes], hashes: list[bytes] | None = None) -> tuple[list[align.Turn], list[int]]:
    """Turns to align, and the numbers of blank, duplicate and truncated rows and of illegal neighbours."""
    turns, counts = [], [0, 0, 0, 0]
    seen: set = set(earlier)
    for k, (role, text) in enumerate(rows):
        key = hashes[k] if hashes is not None else (role, text)
        body = text.rstrip(SPACES)
        fault = 0 if not body else 1 if key in seen else 2 if body[-1] not in ".!?" else None
        seen.add(key)
        if fault is not None:
            counts[fault] += 1
        turns.append(align.Turn(role[:1], fault in (0, 1), align.TRUNCATED if fault == 2 else 0))
    counts[3] = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(turns[:-1], turns[1:], strict=True))
    return turns, counts


def gaps(turns: list[int | None]) -> int:
    known = [t for t in turns if t is not None]
    return known[-1] - known[0] + 1 - len(set(known)) if known else 0


def _cut(batches: Iterator[pa.RecordBatch], block_turns: int) -> Iterator[pa.RecordBatch]:
    """Rows come by conversation and turn. The first and the last conversation of a task may go on in others."""
    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 32
    out: list[tuple] = []
    conversation: int | None = None
    rows: list[tuple] = []
    size = 0
    begun, edge = False, True

    def finished(split: bool) -> None:
        """Take what was gathered as a block of a conversation that goes on, or as a whole one."""
        nonlocal rows, size, block
        turns = [r[0] for r in rows]
        said = [(r[1], r[2]) for r in rows]
        if split:
            hashes = [_hash(*r) for r in said]
            out.append((conversation, *[None] * 8, False, block, turns, [r[0] for r in said], [r[1] for r in said], hashes))
        else:
            to_align, (blank, duplicate, truncated, illegal) = judged(said, set())
            cost, audit = align.whole(to_align)
            text = "\n".join(align.repaired(said, audit, align.START))
            done = hashlib.sha256(text.encode()).hexdigest()
            out.append((conversation, gaps(turns), blank, duplicate, truncated, illegal, cost, audit, done, True, block, *[None] * 4))
        block += 1
        rows, size = [], 0

    for batch in batches:
        for conv, turn, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if begun and conv != conversation:
                finished(edge)
                edge = False
            begun, conversation = True, conv
            for _ in range(copies):
                if rows and (len(rows) >= block_turns or size >= BLOCK_BYTES):
                    finished(True)
                    edge = True
                rows.append((turn, role, text))
                size += len(text)
        if len(out) >= 1000:
            yield batch_of(out, CUT)
            out = []
    if begun:
        finished(True)
    if out:
        yield batch_of(out, CUT)


def _marked_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """conv_id, block, turns, rows (role, text), hashes and earlier hashes."""
    names = ("conv_id", "block", "turns", "roles", "texts", "hashes", "earlier")
    for conv, block, turns, roles, texts, hashes, earlier in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
        yield conv, block, turns, list(zip(roles, texts, strict=True)), hashes, set(earlier or [])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, block, turns, rows, hashes, earlier in _marked_rows(batch):
            to_align, counts = judged(rows, earlier, hashes)
            costs, ranks = [align.NEVER] * 16, [0] * 16
            for state in range(4):
                ways = align.exits(to_align, state) if rows else {state: (0, "")}
                for rank, (after, (cost, _)) in enumerate(sorted(ways.items(), key=lambda x: x[1][1])):
                    costs[4 * state + after], ranks[4 * state + after] = cost, rank
            known = [t for t in turns if t is not None]
            span = [known[0], known[-1], len(set(known))] if known else []
            out.append((conv, block, costs, ranks, *counts, to_align[0].initial if rows else None, to_align[-1].initial if rows else None, span))
        if out:
            yield batch_of(out, SUMMARY)


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one conversation after the other; they come sorted by it."""
    have: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if have and have[0]["conv_id"] != row["conv_id"]:
                yield have
                have = []
            have.append(row)
    if have:
        yield have


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States between the blocks of each conversation: cheapest, then of the least audit."""
    tails = [align.INSERT * len(align.TAILS[s]) for s in range(4)]
    for blocks in _by_conversation(batches):
        to_go = [tails]
        for b in reversed(blocks):
            to_go.append([min(b["costs"][4 * s + t] + to_go[-1][t] for t in range(4)) for s in range(4)])
        to_go.reverse()
        totals = [sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated", "illegal")]
        filled = [b for b in blocks if b["first"] is not None]
        totals[3] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(filled[:-1], filled[1:], strict=True))
        spans = [b["turns"] for b in blocks if b["turns"]]
        shared = sum(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
        gap = spans[-1][1] - spans[0][0] + 1 - sum(s[2] for s in spans) + shared if spans else 0
        state, out = align.START, []
        for k, b in enumerate(blocks):
            ways = [(b["costs"][4 * state + t] + to_go[k + 1][t], b["ranks"][4 * state + t], t) for t in range(4)]
            after = min(ways)[2]
            final = k == len(blocks) - 1
            counts = (gap, *totals, to_go[0][align.START]) if final else [None] * len(COUNTS)
            out.append((b["conv_id"], b["block"], state, after, final, *counts))
            state = after
        yield batch_of(out, CHOSEN)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chosen = batch.select(["before", "after", "final", *COUNTS]).to_pylist()
        out = []
        for (conv, block, _, rows, hashes, earlier), c in zip(_marked_rows(batch), chosen, strict=True):
            to_align, _ = judged(rows, earlier, hashes)
            audit = align.exits(to_align, c["before"])[c["after"]][1] if rows else ""
            audit += align.TAILS[c["after"]] if c["final"] else ""
            kept = align.repaired(rows, audit, c["before"])
            out.append((conv, block, audit, "\n".join(kept) if kept else None, c["final"], *(c[n] for n in COUNTS)))
        if out:
            yield batch_of(out, PARTS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts come by conversation and block; texts are hashed as they pass."""
    audit, digest, empty = [], hashlib.sha256(), True
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            audit.append(row["audit"])
            if row["text"] is not None:
                digest.update((row["text"] if empty else "\n" + row["text"]).encode())
                empty = False
            if row["final"]:
                out.append((row["conv_id"], *(row[c] for c in COUNTS), "".join(audit), digest.hexdigest()))
                audit, digest, empty = [], hashlib.sha256(), True
        if out:
            yield batch_of(out, pa.schema(RESULT))


def repaired(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Repair conversations given as conv_id, turn, role, text and copies (``damaged`` or ``as_given``).

    Rows of a conversation are taken by turn, nulls first, those of one turn by role and text. Each row's first fault
    counts: blank (no character but white space), duplicate (role and text seen earlier in the conversation), truncated (the
    last other character is none of ``.!?``). The cheapest edits that make the roles' initials ``(s?(ua)+)?`` are
    found; of equally cheap ones, the audit least in ASCII order. Rows without conv_id are one conversation. A
    conversation without rows, or of rows that copies are 0 of, has zeros, an empty audit and the hash of the empty
    string. Other columns are ignored.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.
    """
    base.ready(turns.sparkSession)
    rows = turns.select("conv_id", "turn", "role", "text", "copies").withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = base.kept_table(dealt.select("conv_id", "turn", "role", "text", "copies").mapInArrow(lambda it: _cut(it, block_turns), ddl(CUT)))
    whole = cut.where("done").select([name for name, _ in RESULT])
    blocks = cut.where("not done").select("conv_id", *(name for name, _ in BODY))
    # A row is a duplicate of one in an earlier block; which hashes those are is told per block.
    seen = blocks.select("conv_id", "block", F.explode(F.array_distinct("hashes")).alias("hash"))
    first = seen.groupBy(F.col("conv_id").alias("of"), F.col("hash").alias("equal")).agg(F.min("block").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = seen.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("equal"))).where("block > first")
    earlier = again.groupBy("conv_id", "block").agg(F.collect_list("hash").alias("earlier")).select(F.col("block").alias("of"), "earlier")
    # Block numbers differ between all conversations.
    marked = base.kept_table(blocks.join(earlier, F.col("block") == F.col("of"), "left").drop("of"))
    scan = marked.mapInArrow(_summaries, ddl(SUMMARY)).repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_scanned, ddl(CHOSEN))
    parts = marked.join(scan.drop("conv_id"), "block").mapInArrow(_parts, ddl(PARTS))
    split = parts.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_joined, ddl(pa.schema(RESULT)))
    return whole.union(split)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(base.table(spark, sf_dir, "conversations")))


_CRC = (
    "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: "
    "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"
)
_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
#: The same as the cheapest path through the states of the target string, row by row.
SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::BIGINT::VARCHAR, ' ') || ':' || coalesce(turn::BIGINT::VARCHAR, ' ') AS key FROM conversations
),
chance AS (SELECT *, {_CRC} % 20 AS chance FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN chance = 4 THEN 'user' ELSE role END AS role,
         CASE chance WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE chance WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM chance
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial,
         rtrim(text, {_BLANKS}) AS body FROM damaged
),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
r AS (
  SELECT conv_id, turn, i, role, text, initial,
         CASE WHEN body = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM seen
),
ins(state, ins, mid) AS (VALUES (0,'',0),(0,'I',2),(0,'II',3),(1,'',1),(1,'I',2),(1,'II',3),(2,'',2),(2,'I',3),(2,'II',2),(3,'',3),(3,'I',2),(3,'II',3)),
ops(mid, letter, wanted, price, nxt) AS (
  SELECT s, 'D', NULL::VARCHAR, 2, s FROM range(4) AS t(s)
  UNION ALL VALUES (0,'K','s',0,1),(0,'K','u',0,2),(1,'K','u',0,2),(2,'K','a',0,3),(3,'K','u',0,2),(0,'R',NULL,1,2),(1,'R',NULL,1,2),(2,'R',NULL,1,3),(3,'R',NULL,1,2)
),
moves AS (SELECT state, ins || letter AS edits, letter, wanted, price + 5 * length(ins) AS price, nxt FROM ins JOIN ops USING (mid)),
dp(conv_id, i, state, cost, audit) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, 0::BIGINT, '' FROM conversations
  UNION ALL
  SELECT conv_id, i, state, cost, audit FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, i, state ORDER BY cost, audit) AS place FROM (
      SELECT r.conv_id, r.i, nxt AS state, cost + price + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 5 ELSE 0 END AS cost, audit || edits AS audit
      FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN moves ON moves.state = dp.state
      WHERE (wanted IS NULL OR wanted = initial) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate'))))
  WHERE place = 1
),
counts AS (
  SELECT c.conv_id, count(r.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
),
ends AS (
  SELECT c.*, cost + CASE state WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS cost, audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit
  FROM counts c JOIN dp ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.i = c.n
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS place FROM ends) WHERE place = 1),
steps AS (
  SELECT conv_id, p, letter, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS q
  FROM (SELECT conv_id, p, substr(audit, p::INT, 1) AS letter FROM best, unnest(range(1, length(audit) + 1)) AS t(p)) WINDOW w AS (PARTITION BY conv_id ORDER BY p)
),
done AS (
  SELECT s.conv_id, p, q, letter, role, text, max((q = 1 AND letter = 'K' AND initial = 's')::INT) OVER (PARTITION BY s.conv_id) AS led
  FROM steps s LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i AND letter <> 'I' WHERE letter <> 'D'
),
said AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (q - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
         CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS text FROM done GROUP BY conv_id
)
SELECT b.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(said.text, '')) AS repaired_sha256
FROM best b LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM b.conv_id
"""
