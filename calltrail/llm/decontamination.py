"""Benchmark decontamination by spaced seeds, with DataFrame operations only.

A mask selects some positions of a token window and ignores the others. Hashes of the selected tokens
of benchmark items and documents are joined, so a hit survives substitutions at ignored positions;
with two masks a substitution seldom breaks both. Around every hit the document is laid against the
item without gaps, and the best stretch of the overlap, in which a different token costs as much as an
equal one gains, must be long enough. Items shorter than the masks are hashed whole and must stand in the
document token by token.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrail.llm.ranks import fresh, small
from calltrail.session import materialize

MASKS = ("110110101", "101110011")  # 1: the token counts, 0: it may differ
MIN_SCORE = 8  # equal less different tokens of the best stretch; all tokens of a shorter item
SHORTEST = 4  # tokens of an item that is looked for; a shorter one ("yes") stands in clean texts too
#: Characters of scripts that put no blanks between words; each is a token.
_UNSPACED = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}])"


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, and characters of scripts without blanks, as 64-bit hashes; empty for null."""
    spaced = F.when(text.rlike(_UNSPACED), F.regexp_replace(text, _UNSPACED, " $1 ")).otherwise(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(hashes: str, mask: str, number: int) -> Column:
    """A hash for every window of `hashes`, in order; empty if there are fewer tokens than the mask is long."""
    chosen = [i for i, m in enumerate(mask) if m == "1"]
    array = F.col(hashes)
    windows = F.size(array) - len(mask)
    starts = F.when(windows >= 0, F.sequence(F.lit(1), windows + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(number), *[F.get(array, i - 1 + k) for k in chosen]))


def _masks(short: list[int]) -> list[tuple[int, str]]:
    """(number, mask) of the spaced masks, and of a full one for each length of short items."""
    return list(enumerate(MASKS)) + [(len(MASKS) + n, "1" * n) for n in short]


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id, shift): document position less item position of a common seed."""
    test = items.where("item_id is not null").select("item_id", tokens(F.col("text")).alias("hashes"))
    test = materialize(test, "benchmark-tokens")
    span, size = len(MASKS[0]), F.size("hashes")
    sizes = test.select(size.alias("n")).where(F.col("n").between(SHORTEST, span - 1)).distinct().collect()  # fewer than `span`
    short = sorted(r["n"] for r in sizes)
    sides = [
        test.where(size >= span if number < len(MASKS) else size == len(mask)).select("item_id", F.posexplode(seeds("hashes", mask, number)).alias("item_at", "seed"))
        for number, mask in _masks(short)
    ]
    probes = materialize(reduce(DataFrame.unionByName, sides).distinct(), "benchmark-seeds")
    # all masks are taken from one pass over the documents
    train = docs.where("doc_id is not null").select("doc_id", tokens(F.col("text")).alias("hashes"))
    both = F.array(*[seeds("hashes", mask, number) for number, mask in _masks(short)])
    spread = train.select("doc_id", F.explode(both).alias("row")).select("doc_id", F.posexplode("row").alias("at", "seed"))
    met = spread.join(small(probes), "seed")
    return met.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def best_stretch(doc: str, item: str, shift: str) -> Column:
    """Largest score of a stretch of the overlap: equal tokens count 1, different ones -1."""
    start, end = F.greatest(F.lit(0), -F.col(shift)), F.least(F.size(item), F.size(doc) - F.col(shift)) - 1
    places = F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, i: Column) -> Column:
        same = F.get(F.col(item), i) == F.get(F.col(doc), i + F.col(shift))
        now = F.greatest(acc["now"] + F.when(same, 1).otherwise(-1), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(acc["best"], now).alias("best"))

    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(places, zero, step, lambda acc: acc["best"])


def overlaps(docs: DataFrame, items: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score of the pairs with a verified overlap.

    An item shorter than the masks is found where all its tokens follow each other, and not looked for if
    it has fewer than SHORTEST. Rows that share a doc_id or item_id are
    compared one by one and reported under the id; rows with a null id are left out.
    """
    found = materialize(hits(docs, items), "seed-hits")
    wanted = small(found.select("doc_id").distinct())
    train = docs.join(wanted, "doc_id", "left_semi").select("doc_id", tokens(F.col("text")).alias("doc_hashes"))
    test = items.join(small(found.select("item_id").distinct()), "item_id", "left_semi")
    test = test.select("item_id", tokens(F.col("text")).alias("item_hashes"))
    pairs = found.join(train, "doc_id").join(test, "item_id")
    needed = F.when(F.size("item_hashes") < len(MASKS[0]), F.least(F.lit(min_score), F.size("item_hashes"))).otherwise(min_score)
    scored = pairs.select("doc_id", "item_id", best_stretch("doc_hashes", "item_hashes", "shift").alias("score"), needed.alias("needed"))
    return scored.where(F.col("score") >= F.col("needed")).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def judge_documents(docs: DataFrame, items: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (of the best overlap, the smallest id of equals), score of every row.

    Null and empty texts, short texts and null ids are clean. Rows that share a doc_id are judged
    together. An empty table gives no rows, an empty benchmark finds nothing. Other columns are not read.
    """
    plain = docs.select("doc_id", "text")
    best = F.max(F.struct("score", (-F.col("item_id")).alias("low"))).alias("best")
    by_doc = materialize(overlaps(plain, items.select("item_id", "text"), min_score), "overlaps").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), best)
    return plain.select("doc_id").join(by_doc, "doc_id", "left").select(
        "doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0)).alias("n_items"),
        (-F.col("best.low")).alias("item_id"), F.col("best.score").alias("score"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """The clean rows of `docs` with all their columns; rows with a null doc_id stay."""
    found = overlaps(docs.select("doc_id", "text"), items.select("item_id", "text"), min_score)
    gone = materialize(found.select("doc_id").distinct(), "contaminated")
    name = fresh(docs, "_gone")
    return docs.join(small(gone.select(F.col("doc_id").alias(name))), F.col("doc_id") == F.col(name), "left_anti").select(*docs.columns)
