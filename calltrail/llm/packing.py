"""Best-fit packing of token sequences in bulk-synchronous rounds.

Pieces are range-sorted by length and ranked inside their length. A round sweeps lengths and gaps
from large to small: a piece takes the smallest open gap that holds it, a gap takes one piece a
round, and rank inside a run of equal lengths or equal gaps settles conflicts. Then gaps are updated
and the round repeats. Equal lengths and equal gaps are interchangeable, so lengths and gaps are tables
of runs (value, first, count), of which there are no more than the capacity has values. One task sweeps
over these runs; pieces meet their place by length and rank wherever they are.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltrail.llm.ranks import each_text, small, with_rank
from calltrail.session import materialize

END_ID = 0  # closes every document
_WORKER: dict[str, object] = {}


def byte_level_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Token ids of a text under a byte-level BPE file of the tokenizers library.

    The same vocabulary runs in tiktoken, which is several times faster, if the file is of the plain
    form (merges in the order of their ids, standard splitting, no normalizer); else in tokenizers.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    ids = [model["vocab"].get("".join(m)) for m in merges]
    added = spec.get("added_tokens") or []
    plain = (
        model["type"] == "BPE" and not spec.get("normalizer") and split.get("type") == "ByteLevel"
        and split.get("use_regex", True) and not split.get("add_prefix_space") and None not in ids
        and ids == sorted(set(ids)) and not model.get("ignore_merges")
        and len(model["vocab"]) - len(ids) - sum(a["content"] in model["vocab"] for a in added) == 256
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
    )
    if not plain:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    # byte-level files write printable bytes as themselves and the others as U+0100 upwards
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    special = {a["content"]: a["id"] for a in added}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def _encoder(path: str) -> Callable[[str], np.ndarray]:
    if _WORKER.get("path") != path:
        _WORKER["path"], _WORKER["encode"] = path, byte_level_encoder(path)
    return _WORKER["encode"]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole if it fits, else only the first is shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces_of(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every whole text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in rows:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), each_text(batch.column(1))):
                ids = np.append(encode(text or ""), END_ID).astype("<u4")
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((doc_id, i, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def sweep_rounds(counts: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(value, start, n, sequence, gap) from the counts of every length: pieces from rank `start` on, into the
    sequences from `sequence` on, whose room is `gap`.

    On the line from large to small a gap goes onto a stack and a piece takes the one on top, the smallest that
    holds it. Pieces of more than half the capacity open a sequence each; where a round places nothing, the
    rest opens as many sequences as its tokens need.
    """
    left = dict(counts)
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    placed: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    while left:
        stack: list[tuple[int, int, int]] = []
        changed: list[tuple[int, int, int]] = []
        progress = False
        for value in sorted(set(gaps) | set(left), reverse=True):
            stack += [(value, first, n) for first, n in gaps.get(value, ())]
            need = left.get(value, 0)
            while need and stack:
                gap, first, n = stack.pop()
                take = min(need, n)
                placed.append((value, rank[value], take, first, gap))
                changed.append((gap - value, first, take))
                if take < n:
                    stack.append((gap, first + take, n - take))
                rank[value] += take
                need -= take
                progress = True
            if value in left:
                left[value] = need
        left = {v: n for v, n in left.items() if n}
        if progress:
            gaps = {}
            for gap, first, n in sorted(stack + changed, key=lambda r: (r[0], r[1])):
                if gap:
                    runs = gaps.setdefault(gap, [])
                    if runs and sum(runs[-1]) == first:
                        runs[-1] = (runs[-1][0], runs[-1][1] + n)
                    else:
                        runs.append((first, n))
        elif left:
            wide = sum(n for v, n in left.items() if 2 * v > capacity)
            opened = wide or -(-sum(v * n for v, n in left.items()) // capacity)
            gaps.setdefault(capacity, []).append((sequences, opened))
            sequences += opened
    return placed


def placed_runs(counts: DataFrame, capacity: int) -> DataFrame:
    """(value, start, n, sequence, gap) from counts(value, n): where runs of equal pieces go.

    The table of counts has no more rows than the capacity has values, however many pieces there are; it is
    one partition, and one task sweeps over it until all runs are placed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in (0, 1)))]
        columns = list(zip(*sweep_rounds(rows, capacity))) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["value", "start", "n", "sequence", "gap"])

    schema = "value bigint, start bigint, n bigint, sequence bigint, gap bigint"
    return counts.select("value", "n").coalesce(1).mapInArrow(run, schema)


def place(ranked: DataFrame, runs: DataFrame, capacity: int) -> DataFrame:
    """`ranked`(length, rank, ...) with sequence_id and offset from the run that holds its rank."""
    kept = [c for c in ranked.columns if c != "rank"]
    told = runs.select(
        F.col("value").alias("length"), F.col("start").alias("_first"), F.col("n").alias("_n"), F.col("sequence").alias("_sequence"),
        (capacity - F.col("gap")).alias("offset"),
    )
    met = ranked.join(small(told), "length").where("rank >= _first and rank < _first + _n")
    return met.select(*kept, (F.col("_sequence") + F.col("rank") - F.col("_first")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is its end id alone. Longer documents are cut into pieces of `capacity`
    tokens, the first of which may be shorter. Rows with equal or null doc_id are documents of their
    own; pieces equal in every column are interchangeable. An empty table gives no rows.
    """
    pieces = materialize(pieces_of(docs, path, capacity), "pieces")
    ranked = with_rank(pieces, ["doc_id", "piece", "ids_crc32"], group="length", label="by-length")
    counts = pieces.groupBy(F.col("length").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return place(ranked, materialize(placed_runs(counts, capacity), "placed-runs"), capacity)
