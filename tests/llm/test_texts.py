"""Token counts, packing and sharding against the libraries and plain Python."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from calltrail.llm import packing, sharding, token_counts
from tests.llm.rows import frame, odd_documents

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def strange_texts():
    draw = random.Random(11)
    pools = [range(32, 127), range(1, 0x250), range(0x250, 0x3000), range(0x3000, 0xD800), range(0x1F000, 0x1FAFF), list(map(ord, " \t\n\r'sdltm ÀİΣ"))]
    made = ["".join(chr(draw.choice(draw.choice(pools))) for _ in range(draw.randint(0, 60))) for _ in range(600)]
    return made + ["<|endoftext|> x <|STARTOFTEXT|>", "a" * 3000, " " * 3000, "it's we'll 'S x''s 12345", "À é"]


def test_counts_equal_the_library(spark):
    texts = strange_texts() + [r[1] for r in odd_documents()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, WORDS, limit=40).collect()}
    library = Tokenizer.from_file(WORDS)
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 40), repr(t)[:200]


def test_files_of_other_forms_are_counted_by_their_library(spark):
    import sentencepiece

    texts = strange_texts()[:150] + ["A  b", "Hello  World", "", None, "x\n\ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer.from_file(BYTES)
    ways = {BYTES: lambda t: len(library.encode(t, add_special_tokens=False).ids), public_tokenizers.path("piece_bpe_32k.model"): lambda t: len(pieces.encode(t))}
    for path, count in ways.items():
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path).collect()}
        assert got == {i: count(t or "") for i, t in enumerate(texts)}
    assert token_counts._Counter(WORDS).by_words and not token_counts._Counter(BYTES).by_words


def test_special_strings_in_other_letter_case(spark):
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|> x", "A TEXT <|ENDOFTEXT|> UPPER-CASED<|StartOfText|>", "a <|endoftext|>", "plain words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, WORDS).collect()}
    library = Tokenizer.from_file(WORDS)
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_counts_of_odd_tables(spark):
    rows = odd_documents()
    got = token_counts.count_tokens(frame(spark, rows), WORDS)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == len(rows)
    assert token_counts.count_tokens(frame(spark, []), WORDS).count() == 0


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 3)
    counter = token_counts._Counter(WORDS)
    texts = ["some words here", "other words there again", "some other"]
    assert [counter.counts([t], {}) for t in texts] == [[n] for n in counter.library(texts)]


def test_ids_equal_the_library():
    encode, library = packing.byte_level_encoder(BYTES), Tokenizer.from_file(BYTES)
    for t in strange_texts():
        assert encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)[:200]


def check_packing(rows, documents, capacity):
    library = Tokenizer.from_file(BYTES)
    want = sorted((d, library.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in documents if d is not None)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    crcs = []
    for _, ids in want:
        for start, length in packing.cut(len(ids), capacity):
            crcs.append(zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()))
    assert sorted(crcs) == sorted(r.ids_crc32 for r in rows if r.doc_id is not None)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in by_sequence.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_whole_and_gapless(spark, capacity):
    documents = [(r[0], r[1]) for r in odd_documents()] + [(1000 + i, t) for i, t in enumerate(strange_texts()[:200])]
    df = spark.createDataFrame(documents, "doc_id bigint, text string")
    rows = packing.pack_documents(df, BYTES, capacity).collect()
    used = check_packing(rows, documents, capacity)
    assert used <= 1.05 * sum(r.length for r in rows) / capacity + 2
    assert packing.pack_documents(frame(spark, []), BYTES).count() == 0


def test_cut_leaves_only_the_first_piece_short():
    assert packing.cut(5, 5) == [(0, 5)] and packing.cut(6, 5) == [(0, 1), (1, 5)] and packing.cut(10, 5) == [(0, 5), (5, 5)]


def test_rounds_are_as_tight_as_best_fit_decreasing(spark):
    draw = random.Random(2)
    for capacity in (50, 200):
        sizes = [min(capacity, 1 + int(draw.expovariate(3 / capacity))) for _ in range(2000)]
        counts = {v: sizes.count(v) for v in set(sizes)}
        runs = packing.placed_runs(spark.createDataFrame(list(counts.items()), "value bigint, n bigint"), capacity)
        placed = [(r.value, r.start, r.sequence, capacity - r.gap, r.n) for r in runs.collect()]
        for v in counts:  # every rank of a length is placed once
            assert sorted(k for r in placed if r[0] == v for k in range(r[1], r[1] + r[4])) == list(range(counts[v]))
        used, spots = {}, 0
        for value, _, first, offset, n in placed:
            for q in range(first, first + n):
                used.setdefault(q, []).append((offset, value))
                spots += 1
        assert spots == len(sizes)
        for at in used.values():
            at.sort()
            assert all(a[0] + a[1] == b[0] for a, b in zip(at, at[1:])) and at[0][0] == 0 and sum(at[-1]) <= capacity
        gaps = []
        for v in sorted(sizes, reverse=True):
            fit = min((g for g in gaps if g >= v), default=None)
            if fit is None:
                gaps.append(capacity - v)
            else:
                gaps[gaps.index(fit)] -= v
        assert len(used) <= len(gaps) * 1.01 + 1


def test_shards_are_level_and_mixed(spark):
    rows = odd_documents() + [(2000 + i, f"text {i}", "en", "big" if i % 3 else "small", 1, *"abcdefg") for i in range(600)]
    got = sharding.shard_documents(frame(spark, rows), 7).collect()
    assert len(got) == len(rows)
    counts = [sum(r.shard == s for r in got) for s in range(7)]
    assert max(counts) - min(counts) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    source = {r[0]: r[3] for r in rows}
    for name, n in (("big", 400), ("small", 200)):
        held = [sum(source[r.doc_id] == name for r in got if r.shard == s) for s in range(7)]
        assert max(held) - min(held) <= 3 and sum(held) == n
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            t = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
    assert sharding.shard_documents(frame(spark, [])).count() == 0
