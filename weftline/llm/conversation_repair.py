"""Conversation structure repair as a shortest path through composed finite-state machines.

Three machines are composed: the input acceptor, a chain of a conversation's rows; the edit
transducer, which keeps, reroles, deletes or inserts; and the grammar acceptor of role initials
`(s?(ua)+)?`. The composition is never built: its states are (row, grammar state), and a row's arcs
are made when the row is met. Weights are pairs of a cost and the string of edits, the lesser cost
first, then the lesser string in ASCII order.

A row is met from the last to the first, so that an arc's label stands before a string whose best
rest is known. Of the labels that leave one state at one row, none is a prefix of another (inserts,
then one edit of the row), so two arcs with different labels differ within them, and arcs of one
label are ranked as what follows them. A rank for each of four grammar states is all that is
carried, and no string is. The row takes along what to do in each state; a second pass, from the
first row to the last, follows it from the start. Rows shuffle once, by conversation, and stream
through both passes sorted, so a task holds a batch and no conversation.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.columns import strip

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits, and of a truncated row that stays.
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
ROLES = {"u": "user", "a": "assistant"}
#: The grammar `(s?(ua)+)?` over initials: a state's arcs, the states that accept, and all states from the start on.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ACCEPTS = (START, ASSISTANT)
_ENDS = "[.!?]"


def _initials(state: int) -> list[tuple[str, str, int]]:
    """(labels, roles, state) after no, one or two inserts; more of them would come back to a state."""
    out = [("", "", state)]
    for _ in range(2):
        labels, roles, at = out[-1]
        made = next(x for x in "ua" if x in GRAMMAR[at])
        out.append((labels + INSERT, roles + made, GRAMMAR[at][made]))
    return out


_INSERTS = [_initials(q) for q in range(4)]


def _edits(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[int, str, str, int]]]:
    """For each grammar state, the arcs of a row: (cost, labels, roles made and last the row's own, state after)."""
    out = []
    for q in range(4):
        arcs = []
        for labels, roles, at in _INSERTS[q]:
            spent = COST[INSERT] * len(labels)
            arcs.append((spent + COST[DELETE], labels + DELETE, roles + "-", at))
            if must_go:
                continue
            stays = spent + (TRUNCATED if truncated else 0)
            if initial in GRAMMAR[at]:
                arcs.append((stays + COST[KEEP], labels + KEEP, roles + initial, GRAMMAR[at][initial]))
            arcs += [(stays + COST[REROLE], labels + REROLE, roles + r, GRAMMAR[at][r]) for r in "ua" if r in GRAMMAR[at]]
        out.append(arcs)
    return out


_ARCS = {(i, d, t): _edits(i, d, t) for i in ("s", "u", "a", "") for d in (False, True) for t in (False, True)}


def _ranked(weights: list[tuple]) -> list[int]:
    order = {w: k for k, w in enumerate(sorted(set(weights)))}
    return [order[w] for w in weights]


def _last() -> tuple[list[int], list[int], list[str]]:
    """Costs, ranks and inserts behind the last row, for each grammar state."""
    best = [min((COST[INSERT] * len(labels), labels, roles) for labels, roles, at in _INSERTS[q] if at in ACCEPTS) for q in range(4)]
    return [b[0] for b in best], _ranked([b[1] for b in best]), [b[2] for b in best]


_AT_END = _last()


def step(arcs: list, costs: list[int], ranks: list[int]) -> tuple[list[int], list[int], list[tuple]]:
    """One row backwards: for each state the cost and rank of the best rest from this row on, and the arc that begins it."""
    best = [min((c + costs[to], labels, ranks[to], roles, to) for c, labels, roles, to in arcs[q]) for q in range(4)]
    return [b[0] for b in best], _ranked([(b[1], b[2]) for b in best]), best


def faults(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """`rows` with `fault` (blank, duplicate, truncated or null), dealt by conversation: the later of equal (role, text) are duplicates."""
    bare = strip(F.col(text_col))
    fault = F.when(bare == "", "blank").when(F.col("_nth") > 1, "duplicate").when(~F.right(bare, F.lit(1)).rlike(_ENDS), "truncated")
    seen = Window.partitionBy(conv_col, role_col, text_col).orderBy(F.col(turn_col).asc_nulls_first())
    return rows.repartition(F.col(conv_col)).withColumn("_nth", F.row_number().over(seen)).withColumn("fault", fault).drop("_nth")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, fault, edit, new_role, new_text, cost), a row for each edit, in order within a partition, whole conversations to a partition.

    `edit` is K (kept), R (given the role user or assistant), D (deleted) or I (inserted, with empty
    text; turn, role, text and fault are null then). new_role and new_text are null where deleted.
    The costs add up to the least for which the remaining roles' initials are `(s?(ua)+)?`; of the
    edits with that cost, the string of their letters is the least in ASCII order.

    Rows are taken by turn, null turns first, then by role and text. Null role and null text count
    as one space, so such a text is blank. The first letter of a role counts, in lower case only; an
    empty role, or one with another initial, can't be kept. Rows of null conversation are one
    conversation. Repeated rows are duplicates. Texts are whole, of any length. No rows give no
    rows. Other columns aren't read. A conversation's rows pass one task in a stream, which a digest of all of
    them in order needs as well; beside a batch it holds four costs.
    """
    conv_type, turn_type = rows.schema[conv_col].dataType, rows.schema[turn_col].dataType
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))])
    rows = faults(rows, "conv_id", "turn", "role", "text")
    # of equal rows the one that is no duplicate comes first
    later = F.coalesce(F.col("fault") == "duplicate", F.lit(False))
    down = [F.col("conv_id").desc_nulls_last(), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), later.desc()]
    base = [T.StructField("conv_id", conv_type), T.StructField("turn", turn_type), *[T.StructField(c, T.StringType()) for c in ("role", "text", "fault")]]
    planned = T.StructType([*base, T.StructField("nth", T.LongType()), *[T.StructField(f"in_{q}", T.StringType()) for q in range(4)]])
    made = T.StructType([*base, *[T.StructField(c, T.StringType()) for c in ("edit", "new_role", "new_text")], T.StructField("cost", T.IntegerType())])
    back = rows.select("conv_id", "turn", "role", "text", "fault").sortWithinPartitions(*down).mapInArrow(_plan, planned)
    return back.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("nth").desc()).mapInArrow(_follow, made)


def _new(now, conv) -> bool:
    return now is None or now[0] != conv


def _plan(batches):
    now, costs, ranks, nth = None, *_AT_END[:2], 0
    for batch in batches:
        plans, numbers = [[], [], [], []], []
        for conv, role, fault in zip(*(batch.column(i).to_pylist() for i in (0, 2, 4)), strict=True):
            if _new(now, conv):
                now, (costs, ranks, _), nth = (conv,), _AT_END, 0
            arcs = _ARCS[role[:1] if role[:1] in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated"]
            costs, ranks, best = step(arcs, costs, ranks)
            for q in range(4):
                plans[q].append(best[q][1] + best[q][3] + str(best[q][4]))
            nth += 1
            numbers.append(nth)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), *[pa.array(p, pa.string()) for p in plans]], names=[*batch.schema.names, "nth", *[f"in_{q}" for q in range(4)]])


def _follow(batches):
    """Makes the rows: follows each row's plan from the state that the row before led to."""
    now, state, kinds = None, START, None
    names = ["conv_id", "turn", "role", "text", "fault", "edit", "new_role", "new_text", "cost"]

    def ending():
        # `now` is the conversation that ends here
        for r in _AT_END[2][state] if now else "":
            yield now[0], None, None, None, None, INSERT, ROLES[r], "", COST[INSERT]

    def batch_of(out):
        cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
        types = [*kinds, pa.string(), pa.string(), pa.string(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    for batch in batches:
        kinds, out = [*batch.schema.types[:2], pa.string(), pa.string(), pa.string()], []
        for conv, turn, role, text, fault, _, *plans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if _new(now, conv):
                out.extend(ending())
                now, state = (conv,), START
            plan, n = plans[state], len(plans[state]) // 2
            for r in plan[n : 2 * n - 1]:
                out.append((conv, None, None, None, None, INSERT, ROLES[r], "", COST[INSERT]))
            edit, r = plan[n - 1], plan[2 * n - 1]
            gone, cost = edit == DELETE, COST[edit] + (TRUNCATED if fault == "truncated" and edit != DELETE else 0)
            out.append((conv, turn, role, text, fault, edit, None if gone else role if edit == KEEP else ROLES[r], None if gone else text, cost))
            state = int(plan[-1])
        yield batch_of(out)
    if kinds:
        yield batch_of(list(ending()))


def summary(repaired: DataFrame) -> DataFrame:
    """A row for each conversation of what repair() returns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    schema = T.StructType([repaired.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return repaired.select("conv_id", "turn", "role", "fault", "edit", "new_role", "new_text", "cost").mapInArrow(_fold, schema)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _fold(batches):
    kind, done, now = pa.int64(), [], None

    def close():
        first, last, distinct = now["turns"]
        now["gaps"] = 0 if first is None else last - first + 1 - distinct
        done.append((now["conv"], *[now[c] for c in COUNTS], "".join(now["audit"]), now["sha"].hexdigest()))

    def flush():
        cols = list(zip(*done, strict=True)) if done else [[]] * (3 + len(COUNTS))
        types = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.types[0]
        for conv, turn, role, fault, edit, new_role, new_text, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now["conv"] != conv:
                if now:
                    close()
                now = {"conv": conv, **dict.fromkeys(COUNTS, 0), "audit": [], "sha": hashlib.sha256(), "turns": (None, None, 0), "before": None, "any": False}
            now["cost"] += cost
            now["audit"].append(edit)
            if edit != INSERT:
                if fault:
                    now[fault] += 1
                if now["before"] is not None and now["before"] + role[:1] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["before"] = role[:1]
                first, last, distinct = now["turns"]
                if turn is not None and turn != last:
                    now["turns"] = (turn if first is None else first, turn, distinct + 1)
            if edit != DELETE:
                now["sha"].update(((("\n" if now["any"] else "") + new_role + ":" + new_text)).encode("utf-8", "replace"))
                now["any"] = True
        yield flush()
    if now:
        close()
        yield flush()


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations with faults put in by crc32 of `conv_id:turn`, modulo 20: 0 drops, 1 empties, 2 takes `[.!?]` out, 3 repeats, 4 makes the role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("hit")).where("hit <> 0")
    new = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", _ENDS, "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), times.alias("time")).drop("time")


def op12_conversation_structure_repair(spark, sf_dir: str) -> DataFrame:
    from weftline.tables import table

    rows = table(spark, sf_dir, "conversations")
    found = summary(repair(damaged(rows)))
    known = found.withColumnRenamed("conv_id", "found_id")
    out = rows.select("conv_id").distinct().join(known, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _arcs_sql(state: int) -> str:
    """SQL for the best rest of a row from a grammar state, without inserts before it: `n` has the rests behind the row."""
    out = [f"{{c: {COST[DELETE]} + n[{state + 1}].c, a: '{DELETE}' || n[{state + 1}].a, o: n[{state + 1}].o}}"]
    for i, q in GRAMMAR[state].items():
        out.append(f"{{c: late + CASE WHEN i = '{i}' AND NOT gone THEN 0 ELSE 1000000 END + n[{q + 1}].c, a: '{KEEP}' || n[{q + 1}].a, o: [role || ':' || text] || n[{q + 1}].o}}")
        if i in ROLES:
            out.append(f"{{c: late + {COST[REROLE]} + CASE WHEN gone THEN 1000000 ELSE 0 END + n[{q + 1}].c, a: '{REROLE}' || n[{q + 1}].a, o: ['{ROLES[i]}:' || text] || n[{q + 1}].o}}")
    return f"list_min([{', '.join(out)}])"


def _inserts_sql(state: int) -> str:
    """SQL for the best rest from a grammar state, with up to two inserts first: `b` has the rests without."""
    out = []
    for labels, roles, q in _INSERTS[state]:
        made = ", ".join(f"'{ROLES[r]}:'" for r in roles)
        out.append(f"{{c: {COST[INSERT] * len(labels)} + b[{q + 1}].c, a: '{labels}' || b[{q + 1}].a, o: [{made}]{'' if made else '::VARCHAR[]'} || b[{q + 1}].o}}")
    return f"list_min([{', '.join(out)}])"


SQL = rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i)) AS t),
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT r.*, xor(list_reduce(list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 20 AS hit FROM r, tab),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE hit <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, substr(role, 1, 1) AS i FROM d),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, lead(i) OVER (PARTITION BY conv_id ORDER BY pos) AS next_i,
  regexp_replace(text, '[ 	-]+$', '') AS bare FROM p),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(right(bare, 1), '[.!?]') THEN 'truncated' ELSE '' END AS fault FROM q),
g AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS late FROM f),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
  count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE next_i IS NOT NULL AND i || next_i NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
w AS (
  SELECT conv_id, n AS left_rows, [{{c: 0, a: '', o: CAST([] AS VARCHAR[])}}, {{c: 4, a: 'II', o: ['user:', 'assistant:']}}, {{c: 2, a: 'I', o: ['assistant:']}}, {{c: 0, a: '', o: CAST([] AS VARCHAR[])}}] AS n FROM s
  UNION ALL
  SELECT conv_id, left_rows - 1, [{", ".join(_inserts_sql(k) for k in range(4))}] FROM (
    SELECT w.conv_id, left_rows, [{", ".join(_arcs_sql(k) for k in range(4))}] AS b FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.pos = w.left_rows))
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.n[1].c, 0) AS BIGINT) AS cost, coalesce(w.n[1].a, '') AS audit,
  sha256(coalesce(array_to_string(w.n[1].o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.left_rows = 0
"""
