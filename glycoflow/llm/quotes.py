"""Quotation linking: reply-ordered conversations without quotes.

Lines with quote marks are parsed by level; lines of one level in a row are a passage. Passages, and their lines, are
normalised, hashed and joined to the first message of the conversation that holds them as its own text. A message
replies to the one that its outermost quotes (level 1) match most of. Columns and SQL functions only; a passage that a
whole conversation quotes costs one row per quote, and no conversation is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glycoflow.llm import base

MARKS = r"^(?:[ \t]*>)+"
BLANK_RUN = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: A turn in a path: its distance from the least long, so that negative ones sort first, in as many digits as that takes.
OFFSET, DIGITS = 1 << 63, 20


def normalised(text: Column) -> Column:
    """Lower case, single blanks, none at the ends."""
    return F.lower(F.regexp_replace(F.btrim(text, F.lit(BLANKS)), BLANK_RUN, " "))


def _messages(conversations: DataFrame) -> DataFrame:
    """One row per conv_id and turn, with its lines by level and its own text."""
    named = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.struct(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("role").cast("string").alias("role")).alias("m"),
    )
    one = named.groupBy("conv_id", "turn").agg(F.max("m").alias("m")).select("conv_id", "turn", "m.role", "m.text")

    def parsed(line: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))
        return F.struct(level.alias("level"), F.regexp_replace(line, MARKS, "").alias("body"))

    lines = one.select("conv_id", "turn", "role", F.transform(F.split("text", "\n"), parsed).alias("lines"))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return lines.select("*", F.btrim(own, F.lit(BLANKS)).alias("own"))


def _units(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """Hashes and sizes of a normalised text as a whole, of its paragraphs and of its lines; none of blank ones."""
    parts = F.concat(F.array(F.col(text)), F.split(text, r"\n[\x20\x09-\x0D]*\n"), F.split(text, "\n"))
    units = rows.select(*keys, F.explode(F.array_distinct(F.transform(parts, normalised))).alias("unit")).where("unit <> ''")
    return units.select(*keys, F.xxhash64("unit").alias("hash"), F.length("unit").cast("bigint").alias("size"))


def _passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, passage, level and text of every quoted passage."""
    quoting = messages.where(F.exists("lines", lambda x: x["level"] > 0))
    lines = quoting.select("conv_id", "turn", F.posexplode("lines").alias("pos", "line")).select("conv_id", "turn", "pos", "line.level", "line.body")
    message = Window.partitionBy("conv_id", "turn").orderBy("pos")
    new = F.when(F.lag("level").over(message) == F.col("level"), 0).otherwise(1)
    numbered = lines.withColumn("new", new).withColumn("passage", F.sum("new").over(message)).where("level > 0")
    joined = F.array_sort(F.collect_list(F.struct("pos", "body")))
    passages = numbered.groupBy("conv_id", "turn", "passage", "level").agg(joined.alias("lines"))
    return passages.select("conv_id", "turn", "passage", "level", F.array_join(F.transform("lines", lambda x: x["body"]), "\n").alias("text"))


def _paths(links: DataFrame) -> DataFrame:
    """(conv_id, turn, path): the turns from the first message of the thread to each linked one.

    A row knows a stretch of its path and the message before that. Every round appends to it the stretch of that
    message, so stretches double; rows that have reached a message without a link are done.
    """
    rows = links.select("conv_id", "turn", F.col("parent").alias("upper"), F.array("turn").alias("path"))
    rows = base.kept_table(rows)
    while rows.where("upper IS NOT NULL").limit(1).count():
        above = rows.select(F.col("conv_id").alias("of"), F.col("turn").alias("at"), F.col("upper").alias("next"), F.col("path").alias("before"))
        met = rows.join(above, (F.col("conv_id") == F.col("of")) & (F.col("upper") == F.col("at")), "left")
        # A message that no row stands for is the first of its thread.
        stretch = F.when(F.col("upper").isNull(), F.col("path")).when(F.col("at").isNull(), F.concat(F.array("upper"), F.col("path"))).otherwise(F.concat("before", "path"))
        rows = base.kept_table(met.select("conv_id", "turn", F.when(F.col("at").isNotNull(), F.col("next")).alias("upper"), stretch.alias("path")))
    return rows.select("conv_id", "turn", "path")


def _step(turn: Column) -> Column:
    return F.lpad((turn.cast("decimal(20,0)") + F.lit(str(OFFSET)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), DIGITS, "0")


def threaded(conversations: DataFrame) -> DataFrame:
    """Messages in reply order, without quotes.

    A passage belongs to the first message of its conversation whose own text, a paragraph or a line of it equals the
    passage or one of its lines, in lower case and with single blanks, if that message is earlier. A message replies to
    the one with most characters so matched in its passages of level 1, the later of equals. Replies stand below that
    message by turn; others stay in line. Rows without conv_id or turn are left out; of rows of one turn the greatest
    text counts; a null text is empty; other columns are ignored.

    Returns conv_id, turn, role, parent_turn, path (the turns from the first message of the thread down, which sorts
    like the conversation), n_quotes, n_linked (passages that belong to a message) and text, ordered by conv_id and
    path.
    """
    messages = _messages(conversations)
    passages = base.kept_table(_passages(messages))
    own = _units(messages.select("conv_id", "turn", "own"), "own", "conv_id", "turn")
    firsts = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    quoted = _units(passages, "text", "conv_id", "turn", "passage", "level")
    found = quoted.join(firsts, ["conv_id", "hash"]).where("original < turn")
    linked = found.groupBy("conv_id", "turn").agg(F.count_distinct("passage").alias("n_linked"))
    matched = found.where("level = 1").groupBy("conv_id", "turn", "original").agg(F.sum("size").alias("size"))
    links = base.kept_table(matched.groupBy("conv_id", "turn").agg(F.max(F.struct("size", "original")).alias("best")).select("conv_id", "turn", F.col("best.original").alias("parent")))
    counted = passages.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"))
    keys = ["conv_id", "turn"]
    joined = messages.join(links, keys, "left").join(_paths(links), keys, "left").join(counted, keys, "left").join(linked, keys, "left")
    path = F.transform(F.coalesce("path", F.array("turn")), _step)
    rows = joined.select(
        "conv_id", "turn", "role", F.col("parent").alias("parent_turn"), F.array_join(path, "/").alias("path"),
        F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.col("own").alias("text"),
    )
    return rows.repartitionByRange("conv_id", "path").sortWithinPartitions("conv_id", "path")


def op6_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = threaded(base.table(spark, sf_dir, "conversations"))
    return out.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


_NORM = "lower(regexp_replace(trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
_PARTS = "unnest(list_concat(list_concat([{0}], regexp_split_to_array({0}, '\\n[\\x20\\x09-\\x0D]*\\n')), string_split({0}, chr(10))))"
_STEP = "lpad(({0}::HUGEINT + 9223372036854775808)::VARCHAR, 20, '0')"
SQL = f"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, max_by(role, (coalesce(text, ''), role)) AS role, max(coalesce(text, '')) AS text FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
),
sp AS (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM m),
raw AS (SELECT conv_id, turn, pos, ls[pos + 1] AS line FROM sp, unnest(range(0, len(ls))) AS t(pos)),
l AS (
  SELECT conv_id, turn, pos, len(regexp_replace(regexp_extract(line, '^(?:[ \\t]*>)+'), '[^>]', '', 'g')) AS level,
         regexp_replace(line, '^(?:[ \\t]*>)+', '') AS body FROM raw
),
own AS (
  SELECT conv_id, turn, trim(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (level = 0), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
  FROM l GROUP BY conv_id, turn
),
n AS (SELECT *, CASE WHEN lag(level) OVER w = level THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS passage FROM n),
p AS (SELECT conv_id, turn, passage, level, string_agg(body, chr(10) ORDER BY pos) AS text FROM r WHERE level > 0 GROUP BY conv_id, turn, passage, level),
ou AS (SELECT conv_id, turn, {_NORM.format("u")} AS unit FROM (SELECT conv_id, turn, {_PARTS.format("text")} AS u FROM own)),
firsts AS (SELECT conv_id, unit, min(turn) AS original FROM ou WHERE unit <> '' GROUP BY conv_id, unit),
qu AS (SELECT DISTINCT conv_id, turn, passage, level, {_NORM.format("u")} AS unit FROM (SELECT conv_id, turn, passage, level, {_PARTS.format("text")} AS u FROM p)),
f AS (SELECT qu.*, original FROM qu JOIN firsts USING (conv_id, unit) WHERE original < turn),
lk AS (SELECT conv_id, turn, count(DISTINCT passage) AS n_linked FROM f GROUP BY conv_id, turn),
mt AS (SELECT conv_id, turn, original, sum(length(unit)) AS size FROM f WHERE level = 1 GROUP BY conv_id, turn, original),
par AS (SELECT conv_id, turn, arg_max(original, (size, original)) AS parent FROM mt GROUP BY conv_id, turn),
path AS (
  SELECT m.conv_id, m.turn, {_STEP.format('m.turn')} AS path FROM m ANTI JOIN par USING (conv_id, turn)
  UNION ALL
  SELECT par.conv_id, par.turn, path.path || '/' || {_STEP.format('par.turn')} FROM par JOIN path ON par.conv_id = path.conv_id AND par.parent = path.turn
),
q AS (SELECT conv_id, turn, count(*) AS n_quotes FROM p GROUP BY conv_id, turn)
SELECT conv_id, turn, role, parent AS parent_turn, path, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked,
       sha256(own.text) AS text_sha256
FROM m JOIN own USING (conv_id, turn) JOIN path USING (conv_id, turn) LEFT JOIN par USING (conv_id, turn) LEFT JOIN q USING (conv_id, turn) LEFT JOIN lk USING (conv_id, turn)
"""
