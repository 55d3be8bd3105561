"""Similarity join, decontamination, perplexity, quotations and the pipeline against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from calltrail.llm import decontamination, jaccard, perplexity, quotations
from calltrail.llm.queries import ORACLES
from calltrail.session import materialize
from tests.check_oracle import compare
from tests.llm.rows import frame, odd_documents, prose

SF = "/root/testdata/sf0.001"


def word_sets(rows):
    """Shingle sets by doc_id; a doc_id with several texts is not taken here."""
    sets = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        sets[doc_id] = frozenset(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else [])
    return sets


def brute_components(rows):
    sets = word_sets(rows)
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        common = collections.Counter(e for x in s for e in holders[x] if e > d)
        for e, k in common.items():
            if 100 * k >= 75 * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def varied_copies(seed):
    """Near copies of all degrees around the threshold, in one large group and in small ones; shared passages."""
    draw = random.Random(seed)
    rows, passage = [], prose(77, 60)
    for group in range(25):
        base = prose(group * 31 + seed, draw.choice([4, 5, 6, 8, 20, 60, 200])).split()
        for _ in range(draw.choice([1, 2, 5]) if group else 60):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(words) // 20))):
                words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
            text = " ".join(words)
            rows.append(text + " " + passage if draw.random() < 0.3 else text)
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 2000)
    rows = varied_copies(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()}
    assert got == brute_components(rows)


def test_given_documents_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()}
    assert got == brute_components(rows)


def test_odd_documents_join(spark):
    rows = odd_documents()
    df = frame(spark, rows)
    got = jaccard.similar_documents(df).collect()
    assert len(got) == len(rows)
    want = brute_components([(r[0], r[1]) for r in rows if r[0] is not None])
    for r in got:
        assert (r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id is not None else (r.n_shingles, None))
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r[0] or -1 for r in rows if r[0] is None or want[r[0]][1] == r[0])
    assert jaccard.similar_documents(frame(spark, [])).count() == 0


def test_packed_places_come_back():
    for values in ([], [0], [0, 1, 2**24 - 1], [5, 70_000, 70_001], list(range(0, 2**24, 60_000))):
        assert jaccard.unpacked(jaccard.packed(np.array(values, np.int64))).tolist() == values


def plain_overlaps(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    found = {}
    for d, text in docs:
        a = words(text)
        for i, item in items:
            b = words(item)
            for shift in range(-len(b) + 1, len(a)):
                span = range(max(0, -shift), min(len(b), len(a) - shift))
                same = [b[k] == a[k + shift] for k in span]
                seeded = any(
                    all(same[s + k] for k, c in enumerate(m) if c == "1") for m in decontamination.MASKS for s in range(len(same) - len(m) + 1)
                )
                if not seeded:
                    continue
                now = best = 0
                for s in same:
                    now = max(0, now + (1 if s else -1))
                    best = max(best, now)
                if best >= decontamination.MIN_SCORE:
                    found[d, i] = max(best, found.get((d, i), 0))
    return found


def test_overlaps_equal_brute_force(spark):
    draw = random.Random(4)
    items = [(i, prose(500 + i, 18 + 3 * i)) for i in range(8)] + [(50, "too short"), (51, None), (52, "")]
    docs = []
    for d in range(40):
        own = prose(900 + d, 30).split()
        taken = (items[d % 8][1]).split()[draw.randint(0, 6) :][: draw.randint(6, 30)]
        for k in range(0, len(taken), draw.choice([4, 6, 9, 99])):
            taken[k] = f"x{k}"
        docs.append((d, " ".join(own[:10] + taken + own[10:])))
    docs += [(100, None), (101, ""), (102, "a b c"), (103, items[3][1].upper().replace(" ", ", "))]
    df = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id bigint, text string, _gone string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = plain_overlaps(docs, items)
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.overlaps(df, bench).collect()}
    assert got == want and len(want) > 10
    told = {r.doc_id: r for r in decontamination.judge_documents(df, bench).collect()}
    assert {d for d in told if told[d].contaminated} == {d for d, _ in want} and told[103].item_id == 3
    clean = decontamination.drop_contaminated(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_short_items_and_scripts_without_blanks(spark):
    items = [(1, "one two three four five six seven eight"), (2, "alpha beta gamma delta"), (3, "yes no"), (4, "今天天气很好我们去公园散步吧")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = [
        (1, f"{prose(1, 30)} One two, three four five six seven eight {prose(2, 30)}"), (2, "one two three four x six seven eight"),
        (3, "say alpha beta gamma delta twice: alpha beta gamma delta"), (4, "alpha beta gamma x delta"), (5, "yes no yes no yes no"),
        (6, "他说今天天气很好我们去公园走走吧。"), (7, "今天我们不去公园"),
    ]
    got = {r.doc_id: (r.item_id, r.score) for r in decontamination.judge_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect()}
    assert got == {1: (1, 8), 2: (None, None), 3: (2, 4), 4: (None, None), 5: (None, None), 6: (4, 11), 7: (None, None)}


def test_odd_documents_are_clean(spark):
    df, bench = frame(spark, odd_documents()), spark.createDataFrame([(1, prose(123456, 40))], "item_id bigint, text string")
    assert decontamination.judge_documents(df, bench).where("contaminated").count() == 0
    assert decontamination.drop_contaminated(df, bench).count() == len(odd_documents())
    assert decontamination.judge_documents(df, bench.limit(0)).count() == len(odd_documents())
    assert decontamination.judge_documents(frame(spark, []), bench).count() == 0


def test_grams_of_more_characters_than_sixteen_bits_hold():
    wide = "".join(map(chr, [*range(0x4E00, 0xA000), *range(0x20000, 0x2C000)]))
    assert len(set(wide)) > 1 << 16
    for texts in ([wide, "abcd" + wide[:50], "", "ab"], ["abcabc", "bca"]):
        codes, starts = perplexity.coded(texts)
        rows, numbers, at = perplexity.grams(codes, starts)
        want = [p[i : i + perplexity.ORDER] for t in texts for p in [perplexity.BEGIN * 3 + t + perplexity.END] for i in range(len(p) - 3)]
        found = perplexity.strings(rows)
        assert [found[n] for n in numbers] == want
        assert sorted(perplexity.strings(perplexity.distinct_grams(codes, starts))) == sorted(set(want))


def plain_model(texts, order=perplexity.ORDER):
    """Interpolated modified Kneser-Ney by dictionaries."""
    counts = {order: collections.Counter()}
    for t in texts:
        s = perplexity.BEGIN * (order - 1) + t + perplexity.END
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter()
        for g, n in counts[k + 1].items():
            counts[k][g[1:]] += n if g[1] == perplexity.BEGIN else 1
    off = {}
    for k, table in counts.items():
        n1, n2, n3, n4 = (sum(v == i for v in table.values()) for i in (1, 2, 3, 4))
        off[k] = perplexity._FALLBACK
        if min(n1, n2, n3, n4) > 0:
            y = n1 / (n1 + 2 * n2)
            d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            if all(0 < v < i for i, v in enumerate(d, 1)):
                off[k] = d

    followers = collections.defaultdict(list)
    for table in counts.values():
        for g, n in table.items():
            followers[g[:-1]].append(n)

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        d = off[len(g)]
        after = followers.get(g[:-1])
        if after is None:
            return p(g[1:])
        n = counts[len(g)].get(g, 0)
        own = n - d[min(n, 3) - 1] if n else 0
        return own / sum(after) + sum(d[min(m, 3) - 1] for m in after) / sum(after) * p(g[1:])

    return p


def test_perplexity_equals_plain_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "CHUNK", 500)
    rows = [(i, prose(i % 30, 20 + i, 60), "en" if i % 3 else "de") for i in range(60)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "ß∂ unseen Ω", "en"), (203, "no model", "xx"), (None, rows[3][1], None), (5, *rows[5][1:]), (204, rows[1][1] * 40, "en")]
    labels = [(i, 1, 0) for i in range(50)] + [(51, 0, 0), (52, 1, 1), (None, 1, 0), (3, 1, 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, gram string").repartition(3)
    got = perplexity.judge_documents(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), 0.5).collect()
    assert len(got) == len(rows)
    held = {r.doc_id for r in spark.range(60).selectExpr("id AS doc_id", f"pmod(xxhash64(id), {perplexity.HOLDOUT}) = 0 AS h").collect() if r.h}
    models = {lang: plain_model([perplexity.normalised(t) for i, t, x in rows if i is not None and i < 50 and i not in held and x == lang]) for lang in ("en", "de")}
    cuts = collections.defaultdict(list)
    for r in got:
        text = perplexity.normalised(dict((q[0], q[1]) for q in rows)[r.doc_id] or "")
        if not text:
            assert (r.n_predicted, r.perplexity, r.kept) == (0, None, False)
            continue
        if r.lang in models:
            s = perplexity.BEGIN * 3 + text + perplexity.END
            logs = [math.log(models[r.lang](s[i : i + 4])) for i in range(len(s) - 3)]
            assert r.n_predicted == len(logs) and r.perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-9)
            if r.doc_id in held and r.doc_id < 50:
                cuts[r.lang].append(round(math.log(r.perplexity), 3))
    for r in got:
        if r.perplexity is not None:
            cut = math.exp(np.percentile(cuts[r.lang], 50)) if cuts[r.lang] else None
            assert r.threshold == (pytest.approx(cut) if cut else None)
            assert r.kept == (r.threshold is None or r.perplexity <= r.threshold)


def test_thresholds_come_from_texts_of_comparable_length(spark, monkeypatch):
    # ids, lengths and log-perplexities: short trusted texts spread widely, long ones hardly
    short = [(i, 20, 1.5 + (i % 200) / 100) for i in range(400)]
    long = [(1000 + i, 1500, 1.5 + (i % 50) / 1000) for i in range(600)]
    junk = [(3000 + i, 1500, 1.9) for i in range(50)]
    rows = short + long + junk + [(4000, 1500, 1.9), (4001, 20, 1.9), (4002, 0, 0.0)]
    scored = spark.createDataFrame([(i, "en", n, -x * n) for i, n, x in rows], "doc_id bigint, lang string, n_predicted bigint, log_prob double")
    monkeypatch.setattr(perplexity, "train", lambda trusted: trusted)
    monkeypatch.setattr(perplexity, "score", lambda docs, model: scored)
    docs = scored.selectExpr("doc_id", "lang", "'' AS text")
    labels = spark.createDataFrame([(i, int(i < 3000), 0) for i, _, _ in rows if i < 4000], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in perplexity.judge_documents(docs, labels).collect()}
    assert len(got) == len(rows) and not any(got[i].kept for i, _, _ in junk)
    assert (got[4000].kept, got[4001].kept, got[4002].kept) == (False, True, False)
    assert sum(got[i].kept for i, _, _ in short) > 0.9 * len(short) and sum(got[i].kept for i, _, _ in long) > 0.9 * len(long)


def test_perplexity_of_odd_tables(spark):
    rows = odd_documents()
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert perplexity.judge_documents(frame(spark, rows), none).count() == len(rows)
    assert perplexity.judge_documents(frame(spark, []), none).count() == 0


MESSAGES = [
    (1, 0, "user", "Hello there my friends\nhow are you today ok"), (1, 1, "assistant", "I am fine"),
    (1, 2, "user", "> Hello there my friends\n> how are  you today ok\nme too"), (1, 3, "assistant", "> > Hello there my friends\n> me too\nindeed"),
    (1, 4, "user", ">> hello there MY friends\nline"), (1, 5, "user", None), (1, 6, "user", ""),
    (5, 0, "u", "Sounds good\nLet us meet at noon. Bring the long list of\nthings we wrote. See you there!"), (5, 1, "a", "Something else"),
    (5, 2, "u", "> Sounds good\nyes"), (5, 3, "a", "> Bring the long list\n> of things we wrote.\nok"), (5, 4, "u", "> ok\nreally"),
    (6, 0, "u", "你好。我们中午见面。\n带上清单"), (6, 1, "a", "x"), (6, 2, "u", "> 我们中午见面。\n好"), (6, 3, "u", "> 带上清单\n好"),
    (1, 7, "a", "> I am fine\n> indeed\n\n>> nothing here at all\nyes"), (1, 7, "a", "> I am fine\n> indeed\n\n>> nothing here at all\nyes"),
    (None, 1, "user", "> I am fine"), (2, None, "user", "> x\ny"), (2, 3, "u", "> I am fine"), (1, 8, None, "> how are you today ok\nreally"),
] + [(3, i, "u", f"> line {i - 1} of this chain\nline {i} of this chain") for i in range(1, 40)] + [(4, 0, "u", "> " * 50 + "deep\n" * 2000)]


def test_reply_order(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame([(*m, "clash") for m in MESSAGES], "conv_id bigint, turn bigint, role string, text string, thread string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations/*.parquet'")
    problem, n = compare(spark, con, "op3", lambda s, _: quotations.reply_order(df), ORACLES["op3_quotation_linking"], "")
    assert problem is None and n == len(MESSAGES)
    got = {(r.conv_id, r.turn): r for r in quotations.reply_order(df).collect()}
    assert [got[1, t].reply_to for t in range(9)] == [None, None, 0, 2, 0, None, None, 1, 0]
    assert [got[5, t].reply_to for t in range(5)] == [None, None, 0, 0, 3]  # one short line, a part wrapped anew, one word
    assert [got[6, t].reply_to for t in range(4)] == [None, None, 0, 0]
    assert (got[3, 39].depth, got[3, 39].thread) == (38, 1)
    assert not any("> " in (r.text or "") for r in got.values())
    assert quotations.reply_order(df.limit(0)).count() == 0


def test_pipeline_stages(spark):
    rows = odd_documents() + [(700, odd_documents()[0][1] + " mail me at a.b1@c.org", "en", "a", 1, *"abcdefg")]
    docs = frame(spark, rows)
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "benchmark_overlap", "pseudonyms", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns
        if name == "near_copies":
            want = brute_components([(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None])
            assert {r.doc_id for r in docs.collect()} == {None} | {d for d, (_, c) in want.items() if c == d}
        if name == "pseudonyms":
            assert docs.count() == before.count()
    assert set(docs.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and docs.count() > 0


def test_pipeline_of_an_empty_table(spark):
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
    assert docs.count() == 0


def test_pipeline_on_given_tables(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) > 50
