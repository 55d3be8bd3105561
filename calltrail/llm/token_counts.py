"""Token counts by a map-side lookup in two tiers.

Tier one is a compact table of frequent pre-tokens with their token counts, learned from a bounded
sample and broadcast; it decides speed only. Tier two encodes what the table misses and keeps the
answer in a cache of the Python worker. Pre-tokens never leave their task.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrail.llm.ranks import batches

SAMPLE_ROWS = 4096  # rows the frequent table is learned from
TABLE_SIZE = 32768  # entries of the frequent table
TABLE_BYTES = 8 << 20  # the broadcast table never exceeds this
CACHE_ENTRIES = 400_000  # per worker; the cache starts anew beyond it

# White space of Unicode below U+0250 ends a pre-token, and so does str.split(); the information
# separators are split by Python only, so texts with them take the slow way.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_LATIN_END = "ɐ"

_WORKER: dict[str, object] = {}


def counts_by_words(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases and drops white space before it cuts, so that words count on their own."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if steps != [{"type": "NFC"}, blank, {"type": "Lowercase"}] or not cuts:
        return False
    first, *others = cuts
    pattern = first.get("pattern", {}).get("Regex", "")
    drops = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and pattern.endswith(r"[^\s\p{L}\p{N}]+")
    plain = all(o["type"] == "ByteLevel" and not o["add_prefix_space"] and not o["use_regex"] for o in others)
    return drops and plain and not any(a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec.get("added_tokens") or [])


class _Counter:
    """Token counts of whole texts with one tokenizer; lives in a Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.cache: dict[str, int] = {}
        self.specials, self.by_words, self.pieces = [], False, None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words = counts_by_words(json.loads(self.tokenizer.to_str()))

    def library(self, texts: list[str]) -> list[int]:
        if self.pieces is not None:
            return [len(ids) for ids in self.pieces.encode(texts)]
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def plain(self, text: str) -> bool:
        """Whether white space cuts the text into pieces that are counted on their own, in lower case."""
        low = text.lower()  # a piece must not become a special string by it
        return (
            self.by_words and not any(c in text for c in _ODD)
            and not any(s in text or s in low for s in self.specials)
            and (text.isascii() or (max(text) < _LATIN_END and unicodedata.is_normalized("NFC", text)))
        )

    def counts(self, texts: list[str], frequent: dict[str, int]) -> list[int]:
        out = [0] * len(texts)
        slow = [i for i, t in enumerate(texts) if not self.plain(t)]
        for i, n in zip(slow, self.library([texts[i] for i in slow])) if slow else ():
            out[i] = n
        rest = set(range(len(texts))).difference(slow)
        cache = self.cache
        for i in rest:
            pieces = texts[i].lower().split()
            found = list(map(frequent.get, pieces))
            if None in found:
                missed = [p for p, n in zip(pieces, found) if n is None]
                new = list({p for p in missed if p not in cache})
                if new:
                    if len(cache) + len(new) > CACHE_ENTRIES:
                        cache.clear()
                        new = list(set(missed))
                    cache.update(zip(new, self.library(new)))
                out[i] = sum(n for n in found if n is not None) + sum(map(cache.__getitem__, missed))
            else:
                out[i] = sum(found)
        return out


def _counter(path: str) -> _Counter:
    if _WORKER.get("path") != path:
        _WORKER["path"], _WORKER["counter"] = path, _Counter(path)
    return _WORKER["counter"]


def frequent_pieces(docs: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, size: int = TABLE_SIZE) -> dict[str, int]:
    """The most frequent pre-tokens of a bounded sample, with their token counts.

    The sample is ranked by one sketch of bounded size: only sketches are shuffled.
    """
    counter = _counter(path)
    if not counter.by_words:
        return {}
    rows = docs.count()
    sample = docs.select("text").sample(fraction=min(1.0, sample_rows / max(rows, 1)), seed=17)
    words = sample.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("piece")).where("piece != ''")
    top = words.select(F.expr(f"approx_top_k(piece, {size}, {8 * size})").alias("top")).head()
    pieces, room = [], TABLE_BYTES
    for row in top["top"] or []:
        room -= len(row["item"].encode()) + 2
        if room < 0:
            break
        pieces.append(row["item"])
    pieces = [p for p in pieces if counter.plain(p) and p.split() == [p]]
    return dict(zip(pieces, counter.library(pieces))) if pieces else {}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, sample_rows: int = SAMPLE_ROWS,
                 table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Counts are the library's own without added special tokens; special strings inside a text are
    special tokens, as by default. A null or empty text has 0 bytes and 0 tokens. Rows with equal or
    null doc_id each give a row. An empty table gives no rows. Other columns are not read, whatever
    their names. Texts outside Latin script, not in NFC or with special strings in any letter case are
    encoded whole by the library; the others by the sum over their pre-tokens, which is the same. So are all texts
    under a file of another form, which may keep blanks or letter case (.json), or of sentencepiece (.model).
    """
    table = frequent_pieces(docs, path, sample_rows, table_size)
    packed = zlib.compress("\n".join(table).encode()), bytes(min(n, 255) for n in table.values())
    packed = packed if max(table.values(), default=0) < 255 else (zlib.compress(b""), b"")
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    run = _counting(path, shared)
    counted = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _counting(path: str, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, counts = shared.value
        frequent = dict(zip(zlib.decompress(pieces).decode().split("\n"), counts))
        counter = _counter(path)
        for batch in rows:
            texts = batches(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counter.counts(texts, frequent), pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run
