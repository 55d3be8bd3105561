"""Reply order of conversations from quotations, with DataFrame operations only.

Lines that start with `>` are quotations, one level per mark. Hashes of normalised quoted passages, of
their lines and of their sentences are joined to the message of the conversation that wrote them first.
The longest unit of the outermost level tells the parent, so short ones count where nothing longer is
found. Only conversations in which somebody quotes are hashed at all. Threads, depths and the reply
order follow by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltrail.llm.ranks import with_rank
from calltrail.session import materialize

MARK = r"^(?:[ \t]*>)+"
SENTENCE_END = r"([.!?。！？]+[\"')\]”’»]*) *"  # a line end is put after it
MAX_ROUNDS = 60  # the depth doubles each round; more means an error


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")))


def _units(rows: DataFrame, whole: str, lines: str, *keep: str) -> DataFrame:
    """`keep`, kind, size, digest: the whole passage (kind 1), and each of its lines and sentences (kind 0); size in characters."""
    passage = _normal(F.col(whole))
    sentences = F.transform(F.split(F.regexp_replace(passage, SENTENCE_END, "$1\n"), "\n"), lambda s: F.trim(s))
    parts = F.concat(
        F.array(F.struct(F.lit(1).alias("kind"), passage.alias("unit"))),
        F.transform(F.array_union(F.transform(lines, _normal), sentences), lambda s: F.struct(F.lit(0).alias("kind"), s.alias("unit"))),
    )
    spread = rows.select(*keep, F.explode(parts).alias("part")).where("part.unit <> ''")
    return spread.select(*keep, "part.kind", F.length("part.unit").alias("size"), F.md5("part.unit").alias("digest")).distinct()


def own_text(text: Column) -> Column:
    """The text without quoted lines; null stays null."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: ~s.rlike(MARK)), "\n")


def quoted_passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage, lines: runs of quoted lines of one level."""
    quoting = messages.where(F.col("text").rlike(r"(?m)^[ \t]*>")).distinct().withColumn("message", F.monotonically_increasing_id())
    lines = materialize(quoting, "quoting").select("conv_id", "turn", "message", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    mark = F.regexp_extract("line", MARK, 0)
    level = F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))
    body = F.expr("substring(line, length(mark) + 1)")
    lines = lines.withColumn("mark", mark).withColumn("level", level).withColumn("body", body)
    order = Window.partitionBy("conv_id", "turn", "message").orderBy("at")
    new = F.when(F.col("level").eqNullSafe(F.lag("level").over(order)), 0).otherwise(1)
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(order)).where("level > 0")
    packed = runs.groupBy("conv_id", "turn", "message", "run", "level").agg(F.sort_array(F.collect_list(F.struct("at", "body"))).alias("of"))
    bodies = F.transform("of", lambda p: p["body"])
    return packed.select("conv_id", "turn", "level", F.array_join(bodies, "\n").alias("passage"), bodies.alias("lines"))


def parents(messages: DataFrame) -> DataFrame:
    """conv_id, turn, parent: the earlier message that a message quotes.

    The outermost level decides, then whole passages before lines and sentences, then the longest unit, then
    the latest original. The original of a unit is the first message of the conversation whose own text has it.
    """
    quoting = quoted_passages(messages)
    talked = messages.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    own = talked.select("conv_id", "turn", own_text(F.col("text")).alias("own")).where("own is not null")
    own = own.withColumn("lines", F.split("own", "\n"))
    first = _units(own, "own", "lines", "conv_id", "turn").groupBy("conv_id", "digest").agg(F.min("turn").alias("original"))
    quotes = _units(quoting, "passage", "lines", "conv_id", "turn", "level")
    linked = quotes.join(first, ["conv_id", "digest"]).where("original < turn")
    best = F.max(F.struct((-F.col("level")).alias("near"), "kind", "size", "original")).alias("best")
    return linked.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("best.original").alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, parent, thread (turn of the root), depth for every message in `links`; parents are earlier than replies."""
    state = materialize(links.select("conv_id", "turn", "parent", F.col("parent").alias("above"), F.lit(1).cast("bigint").alias("depth")), "replies")
    for _ in range(MAX_ROUNDS):
        up = state.select("conv_id", F.col("turn").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"))
        if state.join(up, ["conv_id", "above"], "left_semi").isEmpty():
            return state.select("conv_id", "turn", "parent", F.col("above").alias("thread"), "depth")
        joined = state.join(up, ["conv_id", "above"], "left")
        state = materialize(
            joined.select(
                "conv_id", "turn", "parent", F.coalesce("next", "above").alias("above"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            ),
            "replies",
        )
    raise RuntimeError(f"reply chains did not settle in {MAX_ROUNDS} rounds")


def reply_order(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotations), reply_to, thread, depth, position of every row.

    A message that quotes no earlier message starts a thread of depth 0. position counts from 0 in the
    conversation, by thread, depth and turn, so each message stands after the one it answers and
    conversations without quotations keep their order. A null text stays null and quotes nothing;
    rows with a null conv_id or turn link nothing and form the conversation null, or stand first.
    Rows with the same conv_id and turn are one message for links and a row each. An empty table gives
    no rows. Other columns are not read.

    A quotation that was wrapped anew links by its sentences. Only one that holds neither a line nor a
    sentence of the original as a whole (a few words out of a sentence) has no reply_to and starts a thread.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    whole = rows.where("conv_id is not null and turn is not null")
    tree = threads(parents(whole.select("conv_id", "turn", "text")))
    told = rows.join(tree, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", own_text(F.col("text")).alias("text"), F.col("parent").alias("reply_to"),
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"),
    )
    return with_rank(told, ["thread", "depth", "turn", "role", "text"], group="conv_id", rank="position", label="conversations")


ORACLE = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL)),
marked AS (
  SELECT *, regexp_extract(line, '^(?:[ \t]*>)+') AS mark, length(mark) - length(replace(mark, '>', '')) AS level,
         substr(line, length(mark) + 1) AS body FROM lines),
runs AS (
  SELECT *, sum(fresh_run) OVER (PARTITION BY conv_id, turn, text ORDER BY pos) AS run
  FROM (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv_id, turn, text ORDER BY pos) THEN 0 ELSE 1 END AS fresh_run FROM marked)),
passages AS (
  SELECT conv_id, turn, text, level, run, string_agg(body, chr(10) ORDER BY pos) AS passage FROM runs WHERE level > 0 GROUP BY ALL),
whole AS (SELECT conv_id, turn, string_agg(body, chr(10) ORDER BY pos) AS unit FROM marked WHERE level = 0 GROUP BY conv_id, turn, text),
units AS (
  SELECT conv_id, turn, level, 1 AS kind, passage AS unit FROM passages
  UNION ALL SELECT conv_id, turn, 0, 1, unit FROM whole
  UNION ALL SELECT conv_id, turn, level, 0, body FROM marked),
normal AS (
  SELECT conv_id, turn, level, kind, lower(trim(regexp_replace(unit, '[ \t\r\n]+', ' ', 'g'))) AS unit FROM units),
sentences AS (
  SELECT conv_id, turn, level, 0 AS kind,
         trim(unnest(string_split(regexp_replace(unit, '([.!?。！？]+["'')\]”’»]*) *', '\1' || chr(10), 'g'), chr(10)))) AS unit
  FROM normal WHERE kind = 1),
useful AS (SELECT * FROM normal WHERE unit <> '' UNION ALL SELECT * FROM sentences WHERE unit <> ''),
firsts AS (SELECT conv_id, unit, min(turn) AS original FROM useful WHERE level = 0 GROUP BY ALL),
linked AS (
  SELECT u.conv_id, u.turn, original,
         row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY level, kind DESC, length(u.unit) DESC, original DESC) AS pick
  FROM useful u JOIN firsts f ON f.conv_id = u.conv_id AND f.unit = u.unit WHERE level > 0 AND original < u.turn),
links AS (SELECT conv_id, turn, original AS parent FROM linked WHERE pick = 1),
walk AS (
  SELECT conv_id, turn, parent, parent AS thread, CAST(1 AS BIGINT) AS depth FROM links
  UNION ALL SELECT w.conv_id, w.turn, w.parent, l.parent, w.depth + 1 FROM walk w JOIN links l ON l.conv_id = w.conv_id AND l.turn = w.thread),
tree AS (SELECT conv_id, turn, parent, min(thread) AS thread, max(depth) AS depth FROM walk GROUP BY conv_id, turn, parent),
told AS (
  SELECT c.conv_id, c.turn, c.role,
         array_to_string(list_filter(string_split(c.text, chr(10)), lambda s: NOT regexp_matches(s, '^(?:[ \t]*>)+')), chr(10)) AS text,
         t.parent AS reply_to, coalesce(t.thread, c.turn) AS thread, coalesce(t.depth, 0) AS depth
  FROM conversations c LEFT JOIN tree t ON t.conv_id = c.conv_id AND t.turn = c.turn)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread NULLS FIRST, depth, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position FROM told
"""
