"""Least-cost repair of the turn structure of conversations.

Edits turn the roles of a conversation into an optional system turn and pairs of a user and an assistant
turn. The cheapest edits are a path through a small automaton, found backward: a vector holds, for each
state before a row, the least cost from there to the end. Only differences inside a vector matter, and
only a few vectors exist up to a constant; they are numbered.

A conversation may hold any share of all rows, so its rows are cut into chunks of a fixed size. A chunk
does not know the vector at its end and starts from every vector that may stand there; the lanes soon
differ only by constants, that is, have one number. Chunks whose lanes stay apart are run on with those
after them, twice as far in each pass, until one number is left. The stitched vectors then drive the
trace: forward, at every state, the ASCII-least edit that keeps the least cost. States at the starts of
chunks settle in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrail.session import materialize
from calltrail.llm.ranks import with_rank

ROWS = 1024  # rows in a chunk
MAX_PASSES = 60  # the reach of a chunk doubles; more means an error
BLANKS = " \t\n\x0b\x0c\r"

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)  # what was put out last
_THEN = (USER, USER, ASSISTANT, USER)  # state after the next user or assistant turn
_INITIALS = "sua"
_CUT, _FORCED = 4, 8  # a row's code: its initial (3 for others), plus these when truncated or to be deleted
CODES = 16
_FAR = 1 << 20


def _kept(state: int, code: int) -> int | None:
    """State after keeping a row, None where its role does not fit."""
    initial = code % 4
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return _THEN[state] if _THEN[state] == USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def _options(state: int, code: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of a row's own edits in ASCII order; u and a stand for a new role."""
    found = [("D", DELETE, state)]
    if code < _FORCED:
        extra = TRUNCATED if code & _CUT else 0
        after = _kept(state, code)
        if after is not None:
            found.append(("K", extra, after))
        found.append(("U" if _THEN[state] == USER else "A", REROLE + extra, _THEN[state]))
    return found


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in range(4):
        costs = [min(costs[q], INSERT + costs[_THEN[q]]) for q in range(4)]
    return costs


def _before(vector: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Costs before a row from those after it, less their minimum."""
    costs = _with_inserts([min(cost + vector[after] for _, cost, after in _options(q, code)) for q in range(4)])
    return tuple(c - min(costs) for c in costs)


def _tables():
    """All vectors that may stand between rows, by number; the number before a row by (code, number after it); and moves.

    A move is (edits, state, cost) by (code, number after the row, state): inserted turns, as u or a, and the row's edit.
    """
    end = tuple(_with_inserts([0, _FAR, _FAR, 0]))
    vectors = [end]
    for vector in vectors:
        for code in range(CODES):
            new = _before(vector, code)
            if new not in vectors:
                vectors.append(new)
    step = np.array([[vectors.index(_before(v, code)) for v in vectors] for code in range(CODES)], np.int64)
    moves = [[[_move(v, code, q) for q in range(4)] for v in vectors] for code in range(CODES)]
    endings = []
    for q in range(4):
        edits, cost = "", 0
        while end[q]:
            edits, cost, q = edits + ("u" if _THEN[q] == USER else "a"), cost + INSERT, _THEN[q]
        endings.append((edits, cost))
    return vectors, step, moves, endings


def _move(after: tuple[int, ...], code: int, state: int) -> tuple[str, int, int]:
    plain = [min(cost + after[q] for _, cost, q in _options(s, code)) for s in range(4)]
    best = _with_inserts(plain)
    edits, spent = "", 0
    while True:
        choices = {edit: (cost, q) for edit, cost, q in _options(state, code) if cost + after[q] == best[state]}
        if "D" not in choices and INSERT + best[_THEN[state]] == best[state]:  # D, I, K, R is the ASCII order
            edits, spent, state = edits + ("u" if _THEN[state] == USER else "a"), spent + INSERT, _THEN[state]
            continue
        edit = min(choices, key="DKUA".index)
        return edits + edit, choices[edit][1], spent + choices[edit][0]


VECTORS, STEP, MOVES, ENDINGS = _tables()
END = 0  # number of the vector after the last row
_AUDIT = str.maketrans("uaUA", "IIRR")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after faults that depend on crc32 of `conv_id:turn`, a null there as one blank.

    Of twenty kinds, 0 drops the row, 1 empties its text, 2 takes `.!?` from it, 3 repeats it and 4 makes it
    a user turn. Null roles and texts become one blank.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], kind.alias("_kind")
    ).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def _key(column: str = "conv_id") -> Column:
    """Text that tells ids apart, null as well."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def judged_rows(rows: DataFrame) -> DataFrame:
    """The rows in the order of their conversation, each with its first fault: conv, pos, n_rows, turn, role, text, fault, code.

    A row is a duplicate if an earlier one has its role and text; the first position of each is found by an
    aggregation, and joined by position, so that a text of many rows does not meet in one task.
    """
    clean = rows.select(
        _key().alias("conv"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    )
    placed = with_rank(clean, ["turn", "role", "text"], group="conv", total="n_rows", rank="pos", label="turns")
    first = placed.groupBy("conv", "role", F.sha2("text", 256).alias("_hash")).agg(F.min("pos").alias("pos"))
    known = placed.join(first.select("conv", "pos", F.lit(True).alias("_new")), ["conv", "pos"], "left")
    shown = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(shown == "", "blank").when(F.col("_new").isNull(), "duplicate")
        .when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    initial = F.coalesce(F.nullif(F.instr(F.lit(_INITIALS), F.left("role", F.lit(1))), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)  # an empty role fits nowhere
    code = initial + F.when(fault == "truncated", _CUT).when(fault.isNotNull(), _FORCED).otherwise(0)
    return known.select("conv", "pos", "n_rows", "turn", "role", "text", fault.alias("fault"), code.cast("int").alias("code"))


def _chunks(judged: DataFrame, size: int) -> DataFrame:
    """conv, chunk, n_chunks, codes, next and fault counts; next is the code of the row after the chunk."""
    at = F.floor(F.col("pos") / size)
    # the first row of a chunk is also told to the chunk before
    homes = F.when((F.col("pos") % size == 0) & (F.col("pos") > 0), F.array(at, at - 1)).otherwise(F.array(at))
    rows = judged.select("conv", "pos", "n_rows", "fault", "code", at.alias("_home"), F.explode(homes).alias("chunk"))
    own = F.col("chunk") == F.col("_home")
    counts = [F.count(F.when(own & (F.col("fault") == kind), 1)).alias(kind) for kind in ("blank", "duplicate", "truncated")]
    items = F.sort_array(F.collect_list(F.when(own, F.struct("pos", "code"))))
    return rows.groupBy("conv", "chunk").agg(
        F.ceil(F.max("n_rows") / size).alias("n_chunks"), F.transform(items, lambda i: i["code"]).alias("codes"),
        F.max(F.when(~own, F.col("code"))).alias("next"), *counts,
    )


def _map_chunks(chunks: DataFrame, columns: list[str], made: dict[str, pa.DataType], schema: str, fn) -> DataFrame:
    """conv, chunk and the values that `fn` makes of `columns` of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [fn(*(batch.column(2 + k)[i].as_py() for k in range(len(columns)))) for i in range(batch.num_rows)]
            arrays = [pa.array([r[k] for r in results], kind) for k, kind in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["conv", "chunk", *made])

    return chunks.select("conv", "chunk", *columns).mapInArrow(run, f"conv string, chunk bigint, {schema}")


def _speculate(codes: list[int], is_last: bool) -> tuple[list[int]]:
    """Numbers of the vectors before the chunk, for every vector that may follow it; a single one where they agree."""
    lanes = np.array([END]) if is_last else np.arange(len(VECTORS))
    for code in reversed(codes):
        lanes = STEP[code][lanes]
        if len(lanes) > 1 and (lanes == lanes[0]).all():
            lanes = lanes[:1]
    return (lanes.tolist(),)


def _after_rows(codes: list[int], after: int) -> list[int]:
    """Number of the vector after each row of a chunk."""
    found = [after]
    for code in reversed(codes[1:]):
        found.append(int(STEP[code][found[-1]]))
    return found[::-1]


def _exits(codes: list[int], after: int, is_first: bool) -> tuple[list[int]]:
    """State after the chunk by the state before it; a single one where they agree."""
    states = [START] if is_first else list(range(4))
    for code, vector in zip(codes, _after_rows(codes, after)):
        states = [MOVES[code][vector][q][1] for q in states]
        if len(states) > 1 and len(set(states)) == 1:
            states = states[:1]
    return (states,)


def _trace(codes: list[int], after: int, entry: int, is_last: bool, following: int | None) -> tuple[list[str], str, int, int]:
    """Edits by row, their audit, their cost, and the adjacent rows whose initials do not follow each other."""
    state, edits, cost = entry, [], 0
    for code, vector in zip(codes, _after_rows(codes, after)):
        edit, state, spent = MOVES[code][vector][state]
        edits.append(edit)
        cost += spent
    if is_last:
        edits[-1] += ENDINGS[state][0]
        cost += ENDINGS[state][1]
    initials = [code % 4 for code in codes] + ([] if following is None else [following % 4])
    illegal = sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(initials, initials[1:]))
    return edits, "".join(edits).translate(_AUDIT), cost, illegal


def settle(spans: DataFrame, direction: int) -> DataFrame:
    """conv, chunk, value from conv, chunk, span: what each chunk makes of every value handed to it.

    A span of one entry is settled. The others take what the chunk in `direction` makes of its values; the
    distance doubles in each pass. The outermost chunk of every conversation must be settled.
    """
    onward = F.when(F.size("span") > 1, F.col("chunk") + direction)
    state = materialize(spans.select("conv", "chunk", "span", onward.alias("to")), "spans")
    for _ in range(MAX_PASSES):
        if state.where("to is not null").isEmpty():
            return state.select("conv", "chunk", F.element_at("span", 1).alias("value"))
        other = state.select("conv", F.col("chunk").alias("to"), F.col("span").alias("_span"), F.col("to").alias("_to"))
        joined = state.join(other, ["conv", "to"], "left")
        open_ = F.size("span") > 1
        run_on = F.when(open_, F.transform("_span", lambda x: F.element_at("span", x + 1))).otherwise(F.col("span"))
        agreed = F.when(F.size(F.array_distinct("_new")) == 1, F.slice("_new", 1, 1)).otherwise(F.col("_new"))
        state = joined.select("conv", "chunk", run_on.alias("_new"), "_to").select(
            "conv", "chunk", agreed.alias("span"), F.when(F.size(agreed) > 1, F.col("_to")).alias("to")
        )
        state = materialize(state, "spans")
    raise RuntimeError(f"chunks did not settle in {MAX_PASSES} passes")


def _traced(chunks: DataFrame) -> DataFrame:
    """conv, chunk, edits, audit, cost, illegal of every chunk."""
    is_first, is_last = (F.col("chunk") == 0).alias("is_first"), (F.col("chunk") == F.col("n_chunks") - 1).alias("is_last")
    ints = pa.list_(pa.int32())
    long = chunks.where("n_chunks > 1").select("conv", "chunk", "codes", is_first, is_last)
    spans = _map_chunks(long, ["codes", "is_last"], {"span": ints}, "span array<int>", _speculate)
    before = settle(spans, 1)
    after = before.select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("value").alias("after"))
    known = long.join(after, ["conv", "chunk"], "left").fillna(END, ["after"])
    exits = settle(_map_chunks(known, ["codes", "after", "is_first"], {"span": ints}, "span array<int>", _exits), -1)
    entry = exits.select("conv", (F.col("chunk") + 1).alias("chunk"), F.col("value").alias("entry"))
    whole = chunks.select("conv", "chunk", "codes", is_last, "next").join(after, ["conv", "chunk"], "left").join(entry, ["conv", "chunk"], "left")
    whole = whole.fillna(END, ["after"]).fillna(START, ["entry"])
    kinds = {"edits": pa.list_(pa.string()), "audit": pa.string(), "cost": pa.int64(), "illegal": pa.int64()}
    return _map_chunks(
        whole, ["codes", "after", "entry", "is_last", "next"], kinds, "edits array<string>, audit string, cost bigint, illegal bigint", _trace
    )


class Repair:
    """The repair of `rows`(conv_id, turn, role, text): judged rows, audited chunks, and the repaired turns.

    `judged` has a row per given row (conv, pos, turn, role, text, fault), `chunks` a row per chunk (conv, chunk,
    fault counts, illegal, cost, audit), `turns` a row per turn of the repaired conversations (conv, pos, step,
    role, text): step counts the turns that stand at a given row. conv is '' for a null conv_id, else '=' and the id.
    """

    def __init__(self, rows: DataFrame, chunk_rows: int = ROWS):
        self.judged = materialize(judged_rows(rows), "judged-turns")
        chunks = materialize(_chunks(self.judged, chunk_rows), "chunks")
        traced = materialize(_traced(chunks), "traced")
        self.chunks = chunks.drop("codes", "next").join(traced.drop("edits"), ["conv", "chunk"])
        edits = traced.select("conv", "chunk", F.posexplode("edits").alias("_at", "edit"))
        edits = edits.select("conv", (F.col("chunk") * chunk_rows + F.col("_at")).alias("pos"), "edit")
        joined = self.judged.join(edits.where("edit <> 'D'"), ["conv", "pos"])
        each = joined.select("conv", "pos", "role", "text", F.posexplode(F.split("edit", "")).alias("step", "_edit")).where("_edit not in ('D', '')")
        user, keep = F.col("_edit").isin("u", "U"), F.col("_edit") == "K"
        self.turns = each.select(
            "conv", "pos", "step", F.when(keep, F.col("role")).when(user, "user").otherwise("assistant").alias("role"),
            F.when(F.col("_edit").isin("u", "a"), "").otherwise(F.col("text")).alias("text"),
        )

    def digests(self) -> DataFrame:
        """conv, sha256 of the repaired `role:text` lines of a conversation.

        A hash runs over its whole input in order, so a conversation streams through one task, a batch at a time.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def told(conv: str, digest) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names=["conv", "sha"])

            current, digest = None, None
            for batch in batches:
                for conv, line in zip(batch.column(0), batch.column(1)):
                    conv = conv.as_py()
                    if conv == current:
                        digest.update(b"\n")
                    else:
                        if current is not None:
                            yield told(current, digest)
                        current, digest = conv, sha256()
                    digest.update(line.as_py().encode())
            if current is not None:
                yield told(current, digest)

        lines = self.turns.select("conv", F.concat("role", F.lit(":"), "text").alias("line"), "pos", "step")
        ordered = lines.repartition("conv").sortWithinPartitions("conv", "pos", "step")
        return ordered.select("conv", "line").mapInArrow(run, "conv string, sha string")


def audit_conversations(rows: DataFrame, ids: DataFrame | None = None, chunk_rows: int = ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    rows(conv_id, turn, role, text) in any order; `ids`(conv_id) may name conversations that have lost all rows:
    zeros, an empty audit and the hash of nothing. Rows go by turn, nulls first, ties by role and text. A null role
    or text counts as one blank; an empty role, or one that begins with none of s, u and a, cannot be kept. A null
    conv_id is one conversation. gaps counts the turns missing between the least and the largest one, null where
    that passes a bigint. An empty table gives no rows. Other columns are not read.
    """
    repair = Repair(rows, chunk_rows)
    names = (rows if ids is None else ids).select("conv_id").distinct().select("conv_id", _key().alias("conv"))
    wide = [f(F.col("turn").cast("decimal(20,0)")) for f in (F.max, F.min)]
    turns = repair.judged.groupBy("conv").agg((wide[0] - wide[1] + 1 - F.count_distinct("turn")).try_cast("bigint").alias("gaps"),
                                              F.max("turn").isNotNull().alias("_any"))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda p: p["audit"])
    summed = repair.chunks.groupBy("conv").agg(*[F.sum(c).alias(c) for c in counts], F.array_join(pieces, "").alias("audit"))
    out = names.join(summed, "conv", "left").join(turns, "conv", "left").join(repair.digests(), "conv", "left")
    gaps = F.when(F.col("_any"), F.col("gaps")).otherwise(F.lit(0)).cast("bigint")
    return out.select(
        "conv_id", gaps.alias("gaps"), *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def audit_damaged(conversations: DataFrame) -> DataFrame:
    """The audit of `conversations` after `damage`, for each of its conversations."""
    return audit_conversations(damage(conversations), conversations)


_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda s: CAST(ascii(s) AS BIGINT))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) %% 20 AS kind
  FROM given),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM kinds JOIN (SELECT unnest([0, 1]) AS copy) ON copy = 0 OR kind = 3 WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM damaged),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM placed),
judged AS (
  SELECT *, CASE WHEN shown = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM ranked),
codes AS (
  SELECT conv_id, pos, role || ':' || text AS line, text, left(role, 1) AS k, coalesce(fault IN ('blank', 'duplicate'), FALSE) AS forced,
         CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM judged),
-- the cheapest rest from start (o), after a system (s), a user (u) and an assistant turn (a): cost, audit, lines
plan AS (
  SELECT conv_id, max(pos) + 1 AS pos, {'c': CAST(0 AS BIGINT), 'e': '', 't': ''} AS o, {'c': CAST(10 AS BIGINT), 'e': 'II', 't': 'user:' || chr(10) || 'assistant:'} AS s,
         {'c': CAST(5 AS BIGINT), 'e': 'I', 't': 'assistant:'} AS u, {'c': CAST(0 AS BIGINT), 'e': '', 't': ''} AS a FROM codes GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, %(o)s, %(s)s, %(u)s, %(a)s FROM (
    SELECT p.conv_id, r.pos,
           list_sort([%(od)s, %(ok)s, %(os)s, %(or)s])[1] AS o, list_sort([%(sd)s, %(sk)s, %(sr)s])[1] AS s,
           list_sort([%(ud)s, %(uk)s, %(ur)s])[1] AS u, list_sort([%(ad)s, %(ak)s, %(ar)s])[1] AS a
    FROM plan p JOIN codes r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos - 1)),
counts AS (
  SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(plan.o.c, 0) AS cost, coalesce(plan.o.e, '') AS audit, sha256(coalesce(plan.o.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN plan ON plan.conv_id IS NOT DISTINCT FROM ids.conv_id AND plan.pos = 0"""


def _oracle() -> str:
    """SQL that finds the cheapest edits backward, row by row, with whole audits and lines."""

    def option(after: str, edit: str, cost: str, line: str | None, when: str | None = None) -> str:
        rest = f"p.{after}.t" if line is None else f"{line} || CASE WHEN p.{after}.e SIMILAR TO 'D*' THEN '' ELSE chr(10) END || p.{after}.t"
        made = f"{{'c': p.{after}.c + {cost}, 'e': '{edit}' || p.{after}.e, 't': {rest}}}"
        never = f"{{'c': CAST({_FAR} AS BIGINT), 'e': '', 't': ''}}"
        return made if when is None else f"CASE WHEN {when} THEN {made} ELSE {never} END"

    def inserted(state: str, after: str, name: str) -> str:
        more = f"CASE WHEN {after}.e SIMILAR TO 'D*' THEN '' ELSE chr(10) END || {after}.t"
        return f"list_sort([{state}, {{'c': {after}.c + {INSERT}, 'e': 'I' || {after}.e, 't': '{name}:' || {more}}}])[1]"

    parts = {"os": option("s", "K", "r.extra", "r.line", "NOT r.forced AND r.k = 's'")}
    for state, after, name in (("o", "u", "user"), ("s", "u", "user"), ("u", "a", "assistant"), ("a", "u", "user")):
        parts[state + "d"] = option(state, "D", str(DELETE), None)
        parts[state + "k"] = option(after, "K", "r.extra", "r.line", f"NOT r.forced AND r.k = '{after}'")
        parts[state + "r"] = option(after, "R", f"{REROLE} + r.extra", f"'{name}:' || r.text", "NOT r.forced")
    user, assistant = inserted("u", "a", "assistant"), inserted("a", "u", "user")
    parts |= {"u": user, "a": assistant, "o": inserted("o", f"({user})", "user"), "s": inserted("s", f"({user})", "user")}
    return _SQL % parts


ORACLE = _oracle()
