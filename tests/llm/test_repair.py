"""Conversation repair against a plain search over edits."""

import hashlib
import random
import re
import zlib

import pytest

from calltrail.llm import repair

COLUMNS = "conv_id bigint, turn bigint, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
THEN = {"": "u", "s": "u", "u": "a", "a": "u"}


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        out += [row, row] if kind == 3 else [row]
    return out


def cheapest(rows):
    """(cost, audit, lines) by a search from the end that keeps the whole audits."""
    best = {q: {"": (0, "", []), "a": (0, "", [])}.get(q) for q in THEN}

    def inserts(best):
        for _ in range(4):
            for q in THEN:
                if best[THEN[q]] is not None:
                    cost, audit, lines = best[THEN[q]]
                    name = {"u": "user:", "a": "assistant:"}[THEN[q]]
                    best[q] = min([b for b in (best[q], (cost + 5, "I" + audit, [name, *lines])) if b], key=lambda b: b[:2])
        return best

    best = inserts(best)
    for role, text, forced, cut in reversed(rows):
        new = {}
        for q in THEN:
            found = [(best[q][0] + 2, "D" + best[q][1], best[q][2])]
            if not forced:
                initial = role[:1]
                fits = initial and (initial == THEN[q] or (initial == "s" and q == ""))
                if fits:
                    cost, audit, lines = best[initial]
                    found.append((cost + 5 * cut, "K" + audit, [f"{role}:{text}", *lines]))
                cost, audit, lines = best[THEN[q]]
                name = {"u": "user", "a": "assistant"}[THEN[q]]
                found.append((cost + 1 + 5 * cut, "R" + audit, [f"{name}:{text}", *lines]))
            new[q] = min(found, key=lambda b: b[:2])
        best = inserts(new)
    return best[""]


def expected(rows, ids):
    out = {}
    for conv in ids:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            shown = text.rstrip(BLANK)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            if fault:
                counts[fault] += 1
            seen.add((role, text))
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, lines = cheapest(judged)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha)
    return out


def check(spark, rows, chunk_rows=repair.ROWS, harm=False):
    given = table(spark, rows, COLUMNS)
    got = repair.audit_damaged(given) if harm else repair.audit_conversations(given, chunk_rows=chunk_rows)
    plain = damaged(rows) if harm else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    found = got.collect()
    assert len(found) == len({r[0] for r in rows})
    assert {r[0]: tuple(r[1:]) for r in found} == expected(plain, {r[0] for r in rows})


def drawn(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t", "Ends. ", "öde?", "a\nb", None, "Other.", "More!"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randint(0, 99)}."))
    return rows


def test_audit_equals_a_plain_search(spark):
    check(spark, drawn(1, 120, 12))
    check(spark, drawn(2, 60, 10), harm=True)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_chunks_of_any_size_give_the_same_audit(spark, size):
    check(spark, drawn(size, 12, 40), chunk_rows=size)


def test_lanes_that_never_agree_are_settled_in_few_passes(spark):
    rows = [(1, t, "user", f"cut {t}") for t in range(150)] + [(2, t, "assistant", f"cut {t}") for t in range(70)]
    rows += [(3, t, "user", "Same.") for t in range(90)] + [(4, t, ("user", "assistant")[t % 2], f"cut {t}") for t in range(64)]
    check(spark, rows, chunk_rows=2)


def test_no_rows_nulls_and_clashing_columns(spark):
    assert table(spark, [], COLUMNS).transform(repair.audit_damaged).count() == 0
    check(spark, [(None, None, None, None), (None, None, "user", "Yes."), (5, None, "system", "Be kind.")])
    rows = table(spark, [(1, 1, "user", "Hi.", 3, "x"), (1, 2, "assistant", "Yes.", 4, "y")], COLUMNS + ", pos int, conv string")
    assert [tuple(r)[:7] for r in repair.audit_conversations(rows).collect()] == [(1, 0, 0, 0, 0, 0, 0)]


def test_a_conversation_without_rows_left(spark):
    ids = table(spark, [(9,)], "conv_id bigint")
    got = repair.audit_conversations(table(spark, [], COLUMNS), ids).collect()
    assert [tuple(r) for r in got] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_bigint_turns(spark):
    rows = [(1, -(2**63), "user", "Hi."), (1, 2**63 - 1, "assistant", "Yes.")]
    assert repair.audit_conversations(table(spark, rows, COLUMNS)).head()["gaps"] is None


def test_sql_finds_the_same_repair():
    import duckdb

    rows = drawn(4, 60, 9) + [(None, None, None, None), (None, 3, "user", "Yes.")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = {r[0]: r[1:] for r in con.execute(repair.ORACLE).fetchall()}
    assert got == expected(damaged(rows), {r[0] for r in rows})
