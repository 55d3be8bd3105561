"""URL verdicts: rules first, then naive Bayes over segmented host names and path tokens.

Host labels are cut into words by unigram Viterbi; word counts come from the text of all pages. The
classifier learns from the pages that a rule decides.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrail.session import materialize

CLASSES = ("block", "allow")


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """page_id, host, path. Null urls and urls without :// have neither."""
    start = F.instr("url", "://")
    rest = F.when(start > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    cut = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
    cut = cut.withColumn("raw_host", F.regexp_extract("rest", r"^[^/?#]*", 0))
    tail = F.expr("substring(rest, length(raw_host) + 1)")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return cut.select(
        "page_id", F.translate("raw_host", upper, lower).alias("host"), F.regexp_extract(tail, r"^[^?#]*", 0).alias("path")
    )


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tried first
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n over the visible text of all pages."""
    text = F.regexp_replace(F.lower("html"), r"<[^>]*>", " ")
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(piece: str, edges: list[tuple[int, int, float]], total: float) -> list[str]:
    """The likeliest split of `piece`. An unknown run of k letters has the probability 10 / (total * 10^k).

    Ties go to the split whose last word is longest.
    """
    n = len(piece)
    known: dict[int, list[tuple[int, float]]] = {}
    for start, length, score in edges:
        known.setdefault(start + length, []).append((start, score))
    unknown = math.log(10) - math.log(max(total, 1.0))
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    # the best start of an unknown run that ends at i depends on best[j] + j * log 10 alone
    run_start, run_value = 0, 0.0
    for i in range(1, n + 1):
        best[i], back[i] = run_value + unknown - i * math.log(10), run_start
        for start, score in sorted(known.get(i, ())):
            value = best[start] + score
            if value > best[i] + 1e-12 or (abs(value - best[i]) <= 1e-12 and start < back[i]):
                best[i], back[i] = value, start
        if best[i] + i * math.log(10) > run_value + 1e-12:
            run_start, run_value = i, best[i] + i * math.log(10)
    words, i = [], n
    while i:
        words.append(piece[back[i] : i])
        i = back[i]
    return words[::-1]


def segment(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """`pieces`(piece) with `words`, the Viterbi split by unigram counts. Pieces must be distinct."""
    counts = materialize(counts, "words")
    total = counts.agg(F.sum("n")).head()[0] or 0
    # only substrings as long as some word are looked up; there are few different lengths, and none is left out
    lengths = [r[0] for r in counts.select(F.length("word").alias("k")).distinct().orderBy("k").collect()]
    fitting = F.filter(F.array(*[F.lit(k) for k in lengths]).cast("array<int>"), lambda k: k <= F.length("piece") - F.col("start"))
    parts = (
        pieces.select("piece", F.explode(F.expr("sequence(0, length(piece) - 1)")).alias("start"))
        .select("piece", "start", F.explode(fitting).alias("length"))
        .select("piece", "start", "length", F.expr("substring(piece, start + 1, length)").alias("word"))
    )
    scored = parts.join(counts, "word").select(
        "piece", F.struct("start", "length", F.log(F.col("n") / F.lit(float(max(total, 1)))).alias("score")).alias("edge")
    )
    edges = scored.groupBy("piece").agg(F.collect_list("edge").alias("edges"))

    @F.arrow_udf("array<string>")
    def split(piece: pa.Array, edges: pa.Array) -> pa.Array:
        rows = zip(piece.to_pylist(), edges.to_pylist())
        cut = [viterbi(p, [(e["start"], e["length"], e["score"]) for e in es or []], total) for p, es in rows]
        return pa.array(cut, pa.list_(pa.string()))

    return pieces.join(edges, "piece", "left").select("piece", split("piece", "edges").alias("words"))


def tokens_of(sites: DataFrame, counts: DataFrame) -> DataFrame:
    """`sites`(host, path_key) with one row per token and the times it stands there.

    Host labels are cut at what is no letter and then into words; path tokens are runs of letters,
    and runs of digits count as one token `#`.
    """
    hosts = sites.select("host").distinct()
    labels = hosts.select("host", F.explode(F.split("host", r"[^\p{L}]+")).alias("piece")).where("piece != ''")
    words = segment(labels.select("piece").distinct(), counts)
    of_host = labels.join(words, "piece").select("host", F.explode("words").alias("word"))
    of_host = of_host.groupBy("host", "word").agg(F.count(F.lit(1)).alias("times"))
    from_host = sites.join(of_host, "host").select("host", "path_key", F.concat(F.lit("host:"), "word").alias("token"), "times")
    from_path = (
        sites.select("host", "path_key", F.explode(F.split("path_key", " ")).alias("word")).where("word != ''")
        .groupBy("host", "path_key", "word").agg(F.count(F.lit(1)).alias("times"))
        .select("host", "path_key", F.concat(F.lit("path:"), "word").alias("token"), "times")
    )
    return from_host.unionByName(from_path)


def path_key(path: Column) -> Column:
    """Letters of the path in lower case as words, runs of digits as #."""
    spaced = F.regexp_replace(F.lower(path), r"[^\p{L}0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[0-9]+", " # "), r" +", " "))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], hidden: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page.

    Pages that no rule fits get the verdict of a multinomial naive Bayes classifier with Laplace
    smoothing, trained on all pages that a rule decides; score is its log odds of block, rounded to
    9 digits. Tokens never seen in training say nothing. A score of 0 or less allows, and so does a
    training set without one of the classes. Null urls have an empty host and path and are judged by
    the class sizes. Each row gives a row, also when it repeats; an empty table gives none. Where `hidden`, an
    expression on page_id, holds, the classifier does not see the rule's verdict and judges the page itself. Other
    columns than page_id, url and html are not read, whatever their names.
    """
    cut = with_host_and_path(pages)
    rule, said = rule_of(rules, F.col("host"), F.col("path"))
    if hidden is not None:
        said = F.when(~hidden, said)
    judged = cut.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), path_key(F.col("path")).alias("path_key"))
    judged = materialize(judged, "judged-urls")
    sites = judged.groupBy("host", "path_key").agg(
        *[F.count_if(F.col("said") == c).alias(c) for c in CLASSES], F.count_if(F.col("said").isNull()).alias("open")
    )
    sites = materialize(sites, "sites")
    tokens = materialize(tokens_of(sites, word_counts(pages)), "site-tokens")
    trained = tokens.join(sites.where("block + allow > 0"), ["host", "path_key"])
    by_token = trained.groupBy("token").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in CLASSES])
    by_token = materialize(by_token, "token-counts")
    sums = by_token.agg(F.count(F.lit(1)), *[F.sum(c) for c in CLASSES]).head()
    pages_of = sites.agg(*[F.sum(c) for c in CLASSES]).head()
    if all(pages_of):
        size, (block, allow) = sums[0], (sums[1] or 0, sums[2] or 0)
        prior = math.log(pages_of[0] / pages_of[1])
        weight = F.log((F.col("block") + 1) / F.lit(float(block + size))) - F.log((F.col("allow") + 1) / F.lit(float(allow + size)))
        weights = by_token.select("token", weight.alias("weight"))
        scores = (
            tokens.join(sites.where("open > 0").select("host", "path_key"), ["host", "path_key"])
            .join(weights, "token")
            .groupBy("host", "path_key").agg(F.sum(F.col("times") * F.col("weight")).alias("sum"))
        )
        found = judged.join(scores, ["host", "path_key"], "left")
        score = F.round(F.coalesce("sum", F.lit(0.0)) + F.lit(prior), 9)
    else:
        found, score = judged, F.lit(0.0)
    verdict = F.coalesce("said", F.when(score > 0, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("said").isNull(), score).alias("score"))


def held_out(pages: DataFrame, rules: list[tuple[str, str]], fold: int = 5) -> DataFrame:
    """truth, verdict, n: what the classifier says of the pages that a rule decides, each fold-th of them held out of its training."""
    hidden = F.pmod(F.xxhash64("page_id"), F.lit(fold)) == 0
    _, truth = rule_of(rules, F.col("host"), F.col("path"))
    judged = judge_urls(pages, rules, hidden).where(hidden).withColumn("truth", truth).where("truth is not null")
    return judged.groupBy("truth", "verdict").agg(F.count(F.lit(1)).alias("n"))
