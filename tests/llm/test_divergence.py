"""Source divergence against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from calltrail.llm import divergence
from tests.llm.rows import frame, odd_documents

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, min_docs=10, top=10):
    counts, docs, groups = {}, {}, set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        found = Counter(TERM.findall(text.translate(LOWER)))
        for term, n in found.items():
            counts.setdefault((lang, source), Counter())[term] += n
            docs.setdefault(lang, Counter())[term] += 1
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs.get(lang, {}).items() if n >= min_docs]

        def shares(names):
            c = Counter()
            for s in names:
                c.update(counts.get((lang, s), {}))
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}, c

        all_sources = [s for x, s in groups if x == lang]
        p, own = shares([source])
        q, _ = shares(all_sources)
        value = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(sum(value(p[t], r[t]) for t in kept), s) for s in all_sources if s != source for r in [shares([s])[0]]]
        told = [(value(p[t], q[t]), t) for t in kept if own[t] > 0 and p[t] > q[t]]
        for part, items in (("pair", pairs), ("term", told)):
            ranked = sorted(items, key=lambda i: (-i[0], i[1].encode()))
            out += [(lang, source, part, item, v, k + 1) for k, (v, item) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def audited(df, **kw):
    return sorted(tuple(r) for r in divergence.audit_sources(df, **kw).collect())


def test_odd_documents(spark):
    rows = odd_documents()
    assert audited(frame(spark, rows), min_docs=3) == plain([r[1:4] for r in rows], min_docs=3)
    assert audited(frame(spark, rows)) == plain([r[1:4] for r in rows])
    assert audited(frame(spark, rows).limit(0)) == []


def test_more_groups_and_terms_than_a_block(spark):
    rng = random.Random(4)
    names = [f"w{''.join(rng.choices('abcdefghij', k=4))}" for _ in range(1500)]
    rows = []
    for i in range(70):  # one source holds a third of the documents
        for _ in range(1 + 30 * (i == 3)):
            rows.append((" ".join(rng.choice(names[: 40 + 20 * i]) for _ in range(60)), "en", f"s{i:02}"))
    rows += [("é É Ünï", "xx", f"t{i}") for i in range(3)]
    given = spark.createDataFrame(rows, "text string, lang string, source string")
    assert audited(given, min_docs=2) == plain(rows, min_docs=2)


@pytest.mark.parametrize("density", [0.0, 0.02, 0.5])
def test_joint_walk_equals_all_cells(density):
    rng = np.random.default_rng(1)
    sides = []
    for height in (4, 8):
        cells = rng.random((height, 64)) < density
        zero = rng.integers(1, 1000, height)
        shares = np.where(cells, rng.integers(1, 10**9, (height, 64)), zero[:, None])
        sides.append((divergence.Quadtree(cells), shares, zero))
    for (a, b), same in (((sides[0], sides[1]), False), ((sides[1], sides[1]), True)):
        got = divergence.joint_values(*a, *b, 50, same)
        p, q = a[1][:, None, :50], b[1][None, :, :50]
        want = ((p - q) ** 2 // (p + q)).sum(axis=2)
        upper = np.triu(np.ones_like(want), 1) if same else np.ones_like(want)
        assert (got * upper == want * upper).all()


def test_shares_of_huge_counts_are_exact(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(divergence.share(F.lit(7 * 10**17), F.lit(9 * 10**17), F.lit(10**6))).head()[0]
    assert got == 1 + 10**9 * (7 * 10**17 + 2) // (9 * 10**17 + 2 * 10**6)
