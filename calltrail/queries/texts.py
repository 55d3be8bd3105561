"""Text helpers over whole tables."""

from pyspark.sql import functions as F

from calltrail.functions import prompts, text
from calltrail.queries.base import query, table
from calltrail.queries.catalogs import NAMES_SQL, full_names
from calltrail.queries.samples import _text_sql


@query("local_times", """
SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') AS iso,
       strftime(ts + INTERVAL 9 HOUR, '%Y%m%d_%H%M') AS stamp, strftime(ts - INTERVAL 5 HOUR, '%m%d_%H%M') AS short
FROM events""")
def local_times(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", text.local_time(ts).alias("iso"), text.local_time(ts, "yyyyMMdd_HHmm").alias("stamp"),
        text.local_time(ts, "MMdd_HHmm", "-05:00").alias("short"),
    )


@query("padded_ids", """
SELECT o_orderkey, printf('%05d', o_orderkey) AS five, printf('%08d', o_orderkey * 1000) AS eight FROM orders""")
def padded_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.padded(F.col("o_orderkey"), 5).alias("five"), text.padded(F.col("o_orderkey") * 1000, 8).alias("eight")
    )


def _drawn_sql(salt: int) -> str:
    """Six characters from md5 of seed, key and salt."""
    letters = (
        f"substr('{text.ID_ALPHABET}', CAST(CAST('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR) || '|{salt}'), {1 + 4 * i}, 4) AS BIGINT) % {len(text.ID_ALPHABET)} AS INTEGER) + 1, 1)"
        for i in range(6)
    )
    return " || ".join(letters)


# the smallest key keeps an id that several drew; the others draw again
@query("unique_ids", f"""
WITH first AS (SELECT o_orderkey, {_drawn_sql(0)} AS id, {_drawn_sql(1)} AS next_id FROM (SELECT DISTINCT o_orderkey FROM orders))
SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY o_orderkey) = 1 THEN id ELSE next_id END AS id FROM first""")
def unique_ids(spark, sf_dir):
    return text.unique_ids(table(spark, sf_dir, "orders").select("o_orderkey").distinct(), "o_orderkey", seed=42)


@query("fenced_json", """
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '{}' ELSE '{"lang": "' || lang || '", "n": ' || CAST(n_chars AS VARCHAR) || '}' END AS json
FROM documents""")
def fenced_json(spark, sf_dir):
    raw = F.expr("""CASE doc_id % 3
      WHEN 0 THEN concat('```json\n{"lang": "', lang, '", "n": ', n_chars, '}\n```')
      WHEN 1 THEN concat('  {"lang": "', lang, '", "n": ', n_chars, '}\n')
      ELSE concat('```json\n', text, '\n```') END""")
    return table(spark, sf_dir, "documents").select("doc_id", text.fenced_json(raw).alias("json"))


@query("keyword_replace", f"""WITH {NAMES_SQL}
SELECT hash, '{{"tool":"' || name || '","k":{{"' || name || '":["x ' || name || ' y",1]}}}}' AS result FROM names""")
def keyword_replace(spark, sf_dir):
    h = F.col("hash")
    raw = F.concat(F.lit('{"tool":"'), h, F.lit('","k":{"'), h, F.lit('":["x '), h, F.lit(' y",1]}}'))
    return full_names(spark, sf_dir).select("hash", text.replace_keyword(raw, h, F.col("name")).alias("result"))


@query("instruction_names", f"""WITH {NAMES_SQL}, second AS (SELECT md5(name) AS h2, hash, name FROM names)
SELECT hash, 'First call ' || name || ', then ' || name || ' and other-' || substr(h2, 20, 6) AS instruction FROM second""")
def instruction_names(spark, sf_dir):
    other = F.substring(F.md5("name"), 20, 6)
    raw = F.concat(F.lit("First call "), "hash", F.lit(", then "), "hash", F.lit(" and "), other)
    pairs = F.array(
        F.struct("hash", "name"), F.struct(other.alias("hash"), F.concat(F.lit("other-"), other).alias("name"))
    )
    return full_names(spark, sf_dir).select("hash", text.replace_names(raw, pairs).alias("instruction"))


@query("content_texts", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'bad ' || lang ELSE '' END AS error,
       CASE WHEN doc_id % 4 = 0 THEN '' ELSE text || chr(10) || '{"type":"image","of":"' || source || '"}' END AS response
FROM documents""")
def content_texts(spark, sf_dir):
    blocks = F.array(
        F.struct(F.col("text").alias("text"), F.lit("").alias("raw")),
        F.struct(F.lit(None).cast("string").alias("text"), F.concat(F.lit('{"type":"image","of":"'), "source", F.lit('"}')).alias("raw")),
    )
    failure = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("bad "), "lang"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.envelope(text.content_text(blocks), failure).alias("e")
    ).select("doc_id", "e.error", "e.response")


@query("path_prefix", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/abs' || p ELSE '/data/base/' || substr(p, 2) END AS path,
       '/data/base/' || substr(p, 2) || ';' || p AS paths
FROM (SELECT page_id, '/' || replace(replace(url, 'http://', ''), 'https://', '') AS p FROM pages)""")
def path_prefix(spark, sf_dir):
    p = F.concat(F.lit("/"), F.replace(F.replace("url", F.lit("http://"), F.lit("")), F.lit("https://"), F.lit("")))
    relative = F.substring(p, F.lit(2), F.length(p))
    path, paths = text.path_arguments(
        "/data/base", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/abs"), p)).otherwise(relative), F.array(relative, p)
    )
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.array_join(paths, ";").alias("paths"))


def _judge_sql() -> str:
    out = prompts.JUDGE.replace("{query}", "\0q\0").replace("{tool_use_trace}", "\0t\0").replace("{pred}", "\0p\0").replace("{gt}", "\0g\0")
    columns = {"q": "text", "t": "'[]'", "p": "lang", "g": "source"}
    pieces = out.split("\0")
    return " || ".join(columns.get(p, None) or _text_sql(p) for p in pieces)


@query("judge_prompts", f"SELECT doc_id, {_judge_sql()} AS prompt FROM documents")
def judge_prompts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", prompts.judge_prompt(F.col("text"), F.lit("[]"), F.col("lang"), F.col("source")).alias("prompt")
    )
