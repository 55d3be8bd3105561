"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model is trained on trusted text, one per language. Its units are characters, as the distinct
n-grams of a block of documents then stay far fewer than its positions: each block asks for the
n-grams it has, the count tables answer in a join that is sharded by n-gram, and the answers meet the
block again. Requests and answers grow with the input; nothing of the model is broadcast.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrail.llm.ranks import small
from calltrail.session import materialize

ORDER = 4
BEGIN, END = "\x02", "\x03"  # no text has them once white space and control characters are one blank
CHUNK = 1 << 21  # characters handled at a time
HOLDOUT = 5  # one trusted document in so many is kept from training and sets the thresholds
QUANTILES = (0.95, 0.98, 0.99, 0.995, 0.999)  # a language takes the one that tells its labels apart best
LEAST = 30  # held-out texts that a threshold is taken from, if the language has as many
BANDS = 40  # powers of two of the length
_CONTROL = re.compile("[\x00-\x1f\x7f]+")
_FALLBACK = (0.5, 1.0, 1.5)  # discounts where counts of counts cannot give them


def normalised(text: str) -> str:
    """White space and control characters as single blanks, none at the ends."""
    return " ".join(_CONTROL.sub(" ", text).split())


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each between ORDER - 1 begins and an end; and where each text's predictions start."""
    padded = [BEGIN * (ORDER - 1) + t + END for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0] + [len(p) for p in padded[:-1]])
    return codes, starts


class _Alphabet:
    """Numbers for n-grams of ORDER characters, and the way back.

    Up to 65,536 different characters an n-gram is its characters' numbers, 16 bits each. Beyond, pairs of
    characters are numbered first, 32 bits each, so any text has keys of 64 bits.
    """

    def __init__(self, codes: np.ndarray):
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        self.characters = np.flatnonzero(seen)
        number = np.zeros(0x110000, np.uint32)
        number[self.characters] = np.arange(len(self.characters), dtype=np.uint32)
        ids = number[codes].astype(np.uint64)
        n = max(len(ids) - ORDER + 1, 0)
        self.wide = len(self.characters) > 1 << 16
        if self.wide:
            pairs = ids[:-1] << np.uint64(32) | ids[1:]
            numbers, self.pairs = pd.factorize(pairs)
            numbers = numbers.astype(np.uint64)
            self.keys = numbers[:n] << np.uint64(32) | numbers[2 : n + 2]
            return
        self.keys = ids[:n].copy()
        for k in range(1, ORDER):
            self.keys <<= np.uint64(16)
            self.keys |= ids[k : n + k]

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Code points of n-grams."""
        if self.wide:
            halves = [self.pairs[(keys >> np.uint64(32)).astype(np.int64)], self.pairs[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)]]
            numbers = [v for half in halves for v in (half >> np.uint64(32), half & np.uint64(0xFFFFFFFF))]
            numbers = np.stack(numbers, axis=1)
        else:
            shifts = np.arange(ORDER - 1, -1, -1, dtype=np.uint64) * np.uint64(16)
            numbers = (keys[:, None] >> shifts) & np.uint64(0xFFFF)
        return self.characters.astype(np.uint32)[numbers.astype(np.int64)]


def _keys(codes: np.ndarray, starts: np.ndarray) -> tuple[_Alphabet, np.ndarray]:
    """The keys of all windows, and which windows stay inside one text."""
    alphabet = _Alphabet(codes)
    # windows that reach from one text into the next are left out
    inside = np.ones(len(alphabet.keys), bool)
    for k in range(1, ORDER):
        inside[starts[1:] - k] = False
    return alphabet, inside


def grams(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams as rows of code points; for every predicted place its n-gram's number; and where each text begins among the places."""
    alphabet, inside = _keys(codes, starts)
    numbers, distinct = pd.factorize(alphabet.keys[inside])
    return alphabet.rows(distinct), numbers, starts - (ORDER - 1) * np.arange(len(starts))


def distinct_grams(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    alphabet, inside = _keys(codes, starts)
    return alphabet.rows(pd.unique(alphabet.keys[inside]))


def strings(rows: np.ndarray) -> list[str]:
    width = rows.shape[1]
    return np.ascontiguousarray(rows).view(f"<U{width}").ravel().tolist() if len(rows) else []


def chunks(texts: list[str]) -> Iterator[list[int]]:
    """Runs of positions in `texts` with about CHUNK characters; a longer text is a run of its own."""
    held: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(t) + ORDER
    if held:
        yield held


def by_language(langs: list[str], texts: list[str]) -> Iterator[tuple[str, list[int]]]:
    """Chunks of documents of one language with text left after normalising."""
    for lang in sorted(set(langs)):
        at = [i for i, x in enumerate(langs) if x == lang and texts[i]]
        for run in chunks([texts[i] for i in at]):
            yield lang, [at[k] for k in run]


def count_grams(trusted: DataFrame) -> DataFrame:
    """lang, gram, n: counts of the n-grams of the highest order in `trusted`(lang, text)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [normalised(t or "") for t in batch.column(1).to_pylist()]
            for lang, at in by_language(batch.column(0).to_pylist(), texts):
                found, numbers, _ = grams(*coded([texts[i] for i in at]))
                names = strings(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names)), pa.array(names), pa.array(np.bincount(numbers, minlength=len(names)), pa.int64())],
                    names=["lang", "gram", "n"],
                )

    return trusted.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _suffix(length: int) -> Column:
    return F.substring("gram", 2, length)


def discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 of modified Kneser-Ney from the counts of counts 1 to 4."""
    of = counts.groupBy("lang").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    fine = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    raw = [k - (k + 1) * y * F.try_divide(f"n{k + 1}", F.col(f"n{k}")) for k in (1, 2, 3)]
    for k, d in enumerate(raw, 1):
        fine = fine & (d > 0) & (d < k)
    return of.select("lang", *[F.when(fine, d).otherwise(_FALLBACK[k]).alias(f"d{k + 1}") for k, d in enumerate(raw)])


def _discount() -> Column:
    return F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))


def train(trusted: DataFrame) -> DataFrame:
    """lang, gram, p, back: the model's n-grams of all orders.

    p is the interpolated probability of the last character after the others; back the weight that
    an n-gram, as a context, leaves to the next lower order. A row may have one of them only. The empty
    gram has the weight of the uniform distribution over the characters seen and one unseen.
    """
    top = materialize(count_grams(trusted), "grams")
    orders = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):
        # how many different characters stand before; text starts count as often as they occur
        left = F.when(F.substring("gram", 2, 1) == BEGIN, F.col("n")).otherwise(1)
        orders[k] = materialize(orders[k + 1].groupBy("lang", _suffix(k).alias("gram")).agg(F.sum(left).alias("n")), f"grams-{k}")
    lower: DataFrame | None = None
    made: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        cut = orders[k].join(F.broadcast(discounts(orders[k])), "lang")  # one row per language
        cut = cut.withColumn("context", F.substring("gram", 1, k - 1))
        of = cut.groupBy("lang", "context").agg(
            F.sum("n").cast("double").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum(_discount()).alias("off")
        )
        rows = cut.select("lang", "gram", "context", (F.col("n") - _discount()).alias("rest")).join(of, ["lang", "context"])
        own, back = F.col("rest") / F.col("total"), F.col("off") / F.col("total")
        if k == 1:
            p = rows.select("lang", "gram", (own + back / (F.col("kinds") + 1)).alias("p"))
            uniform = of.select("lang", F.lit("").alias("gram"), F.lit(None).cast("double").alias("p"), (F.col("off") / F.col("total") / (F.col("kinds") + 1)).alias("back"))
            made.append(uniform)
        else:
            shorter = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower_p"))
            joined = rows.withColumn("suffix", _suffix(k - 1)).join(shorter, ["lang", "suffix"])
            p = joined.select("lang", "gram", (own + back * F.col("lower_p")).alias("p"))
            made.append(of.select("lang", F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), (F.col("off") / F.col("total")).alias("back")))
        lower = materialize(p, f"p-{k}")
        made.append(lower.withColumn("back", F.lit(None).cast("double")))
    everything = made[0]
    for part in made[1:]:
        everything = everything.unionByName(part)
    return materialize(everything.groupBy("lang", "gram").agg(F.max("p").alias("p"), F.max("back").alias("back")), "model")


def _blocks(docs: DataFrame) -> DataFrame:
    """block, payload: the documents of a scan task as compressed Arrow data."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
        for batch in rows:
            texts = [normalised(t or "") for t in batch.column(2).to_pylist()]
            packed = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.large_string())], names=["doc_id", "lang", "text"]
            )
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, packed.schema, options=options) as writer:
                writer.write_batch(packed)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue()], pa.binary())], names=["block", "payload"])

    return docs.mapInArrow(run, "block int, payload binary").repartition("block")


def _opened(payload: bytes) -> tuple[list, list[str], list[str]]:
    table = pa.ipc.open_stream(payload).read_all()
    return table["doc_id"].to_pylist(), table["lang"].to_pylist(), table["text"].to_pylist()


def _parts(row: np.ndarray) -> list[np.ndarray]:
    """All the shorter grams that scoring may look up: suffixes, and contexts of suffixes."""
    return [row[:, i:j] for i in range(ORDER) for j in (ORDER - 1, ORDER) if j > i]


def _requests(blocks: DataFrame) -> DataFrame:
    """block, lang, gram: what each block has to look up, each once for every payload."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, langs, texts = _opened(payload)
                asked: dict[str, set[str]] = {}
                for lang, at in by_language(langs, texts):
                    found = distinct_grams(*coded([texts[i] for i in at]))
                    for part in _parts(found):
                        asked.setdefault(lang, set()).update(strings(part))
                for lang, names in asked.items():
                    names.add("")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * len(names), pa.int32()), pa.array([lang] * len(names)), pa.array(list(names))],
                        names=["block", "lang", "gram"],
                    )

    return blocks.mapInArrow(run, "block int, lang string, gram string").distinct()


def log_probability(gram: str, p: dict[str, float], back: dict[str, float]) -> float:
    """Of the last character of `gram` after the others; unseen n-grams back off."""
    log = 0.0
    while gram:
        found = p.get(gram)
        if found is not None:
            return log + math.log(found)
        log += math.log(back.get(gram[:-1], 1.0)) if len(gram) > 1 else 0.0
        gram = gram[1:]
    return log + math.log(back.get("", 1e-9))


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, n_predicted, log_prob of `docs`(doc_id, lang, text); nothing predicted where no text is left."""
    blocks = _blocks(docs)
    answers = _requests(blocks).join(model, ["lang", "gram"]).select("block", "lang", "gram", "p", "back")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        p: dict[str, dict[str, float]] = {}
        back: dict[str, dict[str, float]] = {}
        columns = (right[c].to_pylist() for c in ("lang", "gram", "p", "back"))
        for lang, gram, value, weight in zip(*columns):
            if value is not None:
                p.setdefault(lang, {})[gram] = value
            if weight is not None:
                back.setdefault(lang, {})[gram] = weight
        out: list[list] = [[], [], [], []]
        for payload in left["payload"].to_pylist():
            ids, langs, texts = _opened(payload)
            total, count = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for lang, at in by_language(langs, texts):
                found, numbers, begins = grams(*coded([texts[i] for i in at]))
                own_p, own_back = p.get(lang, {}), back.get(lang, {})
                logs = np.array([log_probability(g, own_p, own_back) for g in strings(found)])
                total[at] = np.add.reduceat(logs[numbers], begins)
                count[at] = np.diff(begins, append=len(numbers))
            for column, values in zip(out, (ids, langs, count.tolist(), total.tolist())):
                column.extend(values)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "lang", "n_predicted", "log_prob"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, "doc_id bigint, lang string, n_predicted bigint, log_prob double"
    )


def _band(n: str) -> Column:
    return F.least(F.floor(F.log2(n)).cast("int"), F.lit(BANDS))


def thresholds(fair: DataFrame, quantiles: list[float]) -> DataFrame:
    """lang, band, cuts: for texts of 2^band to 2^(band+1) characters, the `quantiles` of log-perplexity of `fair`(lang, n_predicted, perplexity).

    Taken from texts of the same band, and of so many shorter bands as LEAST texts need; below that from
    the shortest LEAST texts or all. Perplexities of shorter texts spread more, so few texts give
    no stricter cut.
    """
    # rounded, so that the exact quantile keeps few values
    values = fair.select("lang", _band("n_predicted").alias("of"), F.round(F.log("perplexity"), 3).alias("log"))
    values = materialize(values.groupBy("lang", "of", "log").agg(F.count(F.lit(1)).alias("n")), "fair")
    sizes = values.groupBy("lang", "of").agg(F.sum("n").alias("n"))
    bands = sizes.select("lang").distinct().select("lang", F.explode(F.sequence(F.lit(0), F.lit(BANDS))).alias("band"))
    grid = bands.join(sizes.withColumnRenamed("of", "band"), ["lang", "band"], "left").groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("band", F.coalesce("n", F.lit(0)).alias("n")))), lambda x: x["n"]).alias("sizes")
    )

    def count(first: Column, last: Column) -> Column:
        return F.aggregate(F.slice("sizes", first + 1, last - first + 1), F.lit(0).cast("bigint"), lambda acc, n: acc + n)

    every = F.sequence(F.lit(0), F.lit(BANDS))
    at = grid.select("lang", "sizes", F.explode(every).alias("band"))
    low = F.array_max(F.filter(every, lambda k: (k <= F.col("band")) & (count(k, F.col("band")) >= LEAST)))
    high = F.array_min(F.filter(every, lambda k: count(F.lit(0), k) >= LEAST))
    ranges = at.select(
        "lang", "band", F.coalesce(low, F.lit(0)).alias("low"), F.when(low.isNotNull(), F.col("band")).otherwise(F.coalesce(high, F.lit(BANDS))).alias("high")
    )
    met = values.join(F.broadcast(ranges), "lang").where("of BETWEEN low AND high")  # BANDS + 1 rows per language
    return met.groupBy("lang", "band").agg(F.percentile("log", F.array(*map(F.lit, quantiles)), F.col("n")).alias("cuts"))


def judge_documents(docs: DataFrame, labels: DataFrame, quantile: float | None = None) -> DataFrame:
    """doc_id, lang, n_predicted, perplexity, threshold, kept of every row.

    Trusted are the documents labelled of good quality and not toxic. A fifth of them, chosen by a hash
    of the id, is not trained on; the threshold of a language and length is a quantile of the
    perplexities of those of comparable length: `quantile`, or the one of QUANTILES with the largest
    share of documents labelled bad or toxic rejected, less the share of held-out trusted ones; the
    highest on a tie. Only the fifth of the bad ones with the same hash decides, so the others can test it.
    A language without such documents has no threshold and keeps all its documents; without any
    trusted text, perplexities have no meaning and nothing is rejected. A null or empty text predicts
    nothing, has no perplexity and is not kept. A null lang is the language "". Rows with equal ids
    are scored one by one. An empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    poor = labels.where("(quality = 0 or toxic = 1) and doc_id is not null").select("doc_id").distinct()
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HOLDOUT)) == 0
    trusted = plain.join(small(good.where(~held)), "doc_id", "left_semi")
    scored = materialize(score(plain, train(trusted)), "scores")
    told = scored.withColumn("perplexity", F.when(F.col("n_predicted") > 0, F.exp(-F.col("log_prob") / F.col("n_predicted"))))
    told = told.withColumn("band", F.when(F.col("n_predicted") > 0, _band("n_predicted")))
    fair = told.join(small(good.where(held)), "doc_id", "left_semi").where("perplexity is not null")
    quantiles = list(QUANTILES) if quantile is None else [quantile]
    cuts = materialize(thresholds(fair, quantiles), "cuts")
    junk = told.join(small(poor.where(held)), "doc_id", "left_semi").where("perplexity is not null")

    def rejected(rows: DataFrame, name: str) -> DataFrame:
        over = [F.avg((F.log("perplexity") > F.col("cuts")[k]).cast("double")).alias(f"_{k}") for k in range(len(quantiles))]
        return rows.join(F.broadcast(cuts), ["lang", "band"]).groupBy("lang").agg(*over).select("lang", F.array(*[f"_{k}" for k in range(len(quantiles))]).alias(name))

    shares = rejected(fair, "lost").join(rejected(junk, "found"), "lang", "left")
    gain = F.coalesce(F.zip_with("found", "lost", lambda f, n: F.round(f - n, 9)), F.transform("lost", lambda n: -n))
    # the highest quantile comes last
    best = shares.select("lang", F.array_max(F.transform(gain, lambda g, k: F.struct(g.alias("gain"), k.alias("k"))))["k"].alias("best"))
    chosen = cuts.join(F.broadcast(best), "lang").select("lang", "band", F.exp(F.get("cuts", F.col("best"))).alias("threshold"))
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return told.join(F.broadcast(chosen), ["lang", "band"], "left").select("doc_id", "lang", "n_predicted", "perplexity", "threshold", kept.alias("kept"))
