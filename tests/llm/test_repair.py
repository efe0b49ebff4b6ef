"""Conversation repair against every string of edits, and against its SQL on rows with nulls, ties and repeats."""

import hashlib
import random
import re

import duckdb
import pytest

from weftline.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, fault string, in_0 string, cost string"


def by_force(rows):
    """(cost, edits, repaired rows): the least of all strings of edits with at most two inserts before a row and at the end."""
    best = [(3 * len(rows), "D" * len(rows), [])]

    def go(at, cost, edits, out, inserts):
        if cost > best[0][0]:
            return
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
            best.append((cost, edits, out))
            best[:] = [min(best)]
        if inserts < 2:
            for r in ("user", "assistant"):
                go(at, cost + 2, edits + "I", [*out, (r, "")], inserts + 1)
        if at < len(rows):
            role, text, fault = rows[at]
            late = fault == "truncated"
            go(at + 1, cost + 3, edits + "D", out, 0)
            if fault not in ("blank", "duplicate"):
                go(at + 1, cost + late, edits + "K", [*out, (role, text)], 0)
                for r in ("user", "assistant"):
                    go(at + 1, cost + late + 2, edits + "R", [*out, (r, text)], 0)

    go(0, 0, "", [], 0)
    return best[0]


def fault_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def test_every_string_of_edits(spark):
    rng = random.Random(5)
    data = {}
    for conv in range(120):
        data[conv] = [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant", "", "System"]), rng.choice(["Yes.", "no", "", " \n", "What? ", "Go!"])) for _ in range(rng.randint(1, 4))]
    rows = [(c, k, r, t, None, None, None) for c, turns in data.items() for k, (r, t) in enumerate(turns)]
    got = {r["conv_id"]: r for r in cr.summary(cr.repair(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()}
    assert len(got) == len(data)
    for conv, turns in data.items():
        cost, edits, out = by_force(fault_of(turns))
        assert (got[conv]["cost"], got[conv]["audit"]) == (cost, edits), (turns, got[conv])
        assert got[conv]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


NASTY = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, 2, None, "x"), (1, None, "user", None), (1, 7, "user", "Hello."),
    (None, 3, "user", "No id."), (None, None, "assistant", "Both."), (None, None, "assistant", "Both."),
    (2, 5, "", "role is empty."), (2, 5, "", "role is empty."), (2, -4, "übrig", "é…"), (3, None, None, None),
    (4, 0, "system", "Be short."), (5, 1, "assistant", "First?"), (5, 2, "assistant", "Second?"), (5, 2, "user", "Second?"),
    *[(conv, turn, ("user", "assistant", "system", "tool")[(conv * turn) % 4 if conv % 3 else turn % 2], f"Text {turn % 4} of it." if turn % 5 else "cut of") for conv in range(10, 40) for turn in range(conv % 11)],
]


def against_sql(spark, tmp_path, rows):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    got = cr.op12_conversation_structure_repair(spark, str(tmp_path))
    names = sorted(got.columns)
    cur = con.execute(cr.SQL)
    at = [[d[0] for d in cur.description].index(c) for c in names]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want
    return {r[names.index("conv_id")]: dict(zip(names, r, strict=True)) for r in want}


def test_damage_and_nulls(spark, tmp_path):
    out = against_sql(spark, tmp_path, NASTY)
    assert len(out) == len({r[0] for r in NASTY}) and sum(r["duplicate"] for r in out.values()) > 3 and sum(r["blank"] for r in out.values()) > 1


def test_no_rows(spark, tmp_path):
    assert against_sql(spark, tmp_path, []) == {}


def test_all_rows_dropped(spark, tmp_path):
    import zlib

    turn = next(t for t in range(1000) if zlib.crc32(f"8:{t}".encode()) % 20 == 0)
    out = against_sql(spark, tmp_path, [(8, turn, "user", "Gone.")])
    assert out[8]["audit"] == "" and out[8]["cost"] == 0 and out[8]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_long_conversation_and_text(spark):
    n = 30_000
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.", None, None, None) for k in range(n)]
    rows += [(2, 0, "user", "a " * 500_000 + " " * 200_000 + "b.", None, None, None)]
    got = {r["conv_id"]: r for r in cr.summary(cr.repair(spark.createDataFrame(rows, SCHEMA).repartition(8))).collect()}
    assert got[1]["audit"] == "K" * n and got[1]["cost"] == 0 and got[1]["gaps"] == 0
    assert got[2]["audit"] == "KI" and got[2]["cost"] == 2 and got[2]["truncated"] == 0


def test_real_outputs(spark):
    rows = spark.createDataFrame([(1, 0, "system", "S.", None, None, None), (1, 1, "tool", "A.", None, None, None), (1, 2, "assistant", "B.", None, None, None), (1, 3, "user", "C.", None, None, None)], SCHEMA)
    got = [tuple(r) for r in cr.repair(rows).collect()]
    assert [(r[5], r[6], r[7], r[8]) for r in got] == [("K", "system", "S.", 0), ("R", "user", "A.", 2), ("K", "assistant", "B.", 0), ("K", "user", "C.", 0), ("I", "assistant", "", 2)]


@pytest.mark.parametrize("state", range(4))
def test_no_label_is_a_prefix_of_another(state):
    labels = {a[1] for a in cr._edits("u", False, False)[state]}
    assert not any(a != b and b.startswith(a) for a in labels for b in labels)
