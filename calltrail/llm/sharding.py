"""Shards by proportional stratified interleaving, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrail.llm.ranks import fresh, text_bytes, with_rank
from calltrail.session import materialize


def interleave(rows: DataFrame, stratum: str, key: list[str], shards: int, seed: int) -> DataFrame:
    """`rows` with `shard` and `slot`: counts at most one apart, each stratum spread in proportion.

    Rows are shuffled inside their stratum by a seeded hash of `key`; the row of rank r (from 0)
    among n gets the fraction (2r + 1) / 2n. The table sorted by fraction is cut into `shards`
    runs of equal count. A stratum of any size spreads over many tasks. Null strata are a stratum of
    their own; rows equal in all `key` columns are interchangeable.
    """
    draw, rank, size, frac, place, total = (fresh(rows, c) for c in ("_draw", "_rank", "_size", "_frac", "_place", "_total"))
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in key])
    drawn = rows.withColumn(draw, F.md5(text))
    ranked = with_rank(drawn, [draw, *key], group=stratum, rank=rank, total=size, label="strata")
    spread = ranked.withColumn(frac, (2 * F.col(rank) + 1).cast("double") / (2 * F.col(size)).cast("double"))
    placed = with_rank(spread.drop(rank, size), [frac, draw, *key], rank=place, total=total, label="interleaved")
    shard = F.expr(f"({place} * {shards}) div {total}")
    first = F.expr(f"(({place} * {shards}) div {total} * {total} + {shards} - 1) div {shards}")
    return placed.select(*rows.columns, shard.cast("int").alias("shard"), (F.col(place) - first).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is `rows`: shard counts are at most one apart. A null text has size 1 and the checksum of
    no bytes, 0. Rows that repeat are rows of their own; they may be swapped with each other. An empty
    table gives no rows. Copies of a text are dealt like other rows of their source.
    """
    rows = materialize(
        docs.select(
            "doc_id", "source", (text_bytes("text") + 1).alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("bigint")).alias("text_crc32"),
        ),
        "sizes",
    )
    dealt = interleave(rows, "source", ["doc_id", "text_crc32", "size"], shards, seed)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# The checksum is the CRC-32 of zlib: its table comes from the reversed polynomial 0xEDB88320.
ORACLE = r"""
WITH polynomial AS (
  SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)),
sized AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size,
         xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
             lambda c, b: xor(t[CAST((xor(c, b) & 255) + 1 AS BIGINT)], c >> 8), 4294967295)) AS text_crc32
  FROM documents, polynomial),
drawn AS (
  SELECT *, md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(text_crc32 AS VARCHAR) || '|' || CAST(size AS VARCHAR)) AS draw FROM sized),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, text_crc32, size) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM drawn),
placed AS (
  SELECT *, row_number() OVER (ORDER BY CAST(2 * r + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), draw, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS total
  FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 16 // total AS INTEGER) AS shard,
       place - (place * 16 // total * total + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed"""
