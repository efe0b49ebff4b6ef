"""Filter audit: against a simulation of every order, and against its SQL on rows with nulls, repeats and clashing names."""

from itertools import permutations
from random import Random

import duckdb
import pyarrow.parquet as pq

from weftline.llm import filter_audit as fa

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\x0c\r"


def simulated(docs, labels):
    """{(part, order, step): counts} by applying each order, document by document."""
    quality, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    first, rows = {}, []
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    for i, text, part in docs:
        text, words = text or "", [w for w in (text or "").translate({ord(c): " " for c in SPACES}).split(" ") if w]
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else set()
        fails |= {"D"} if set(text) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and i > first[text] else set()
        rows.append((part or "", fails, i in quality, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, all_removed = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                all_removed[f] += len(gone)
                failing = [r for r in mine if f in r[1]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, o, k), v in out.items():
            if p == part:
                v.append(all_removed[o[k - 1]])
    return out


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def collected(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in df.collect()}


def test_every_order(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text", "lang"]).to_pylist()
    labels = pq.read_table(f"{SF}/labels.parquet").select(["doc_id", "quality", "toxic"]).to_pylist()
    want = simulated([tuple(r.values()) for r in docs], [tuple(r.values()) for r in labels])
    got = collected(fa.op13_filter_interaction_audit(spark, SF))
    assert got == want and len(got) % 600 == 0
    assert all(sum(v[k] for v in want.values()) > 0 for k in range(7))


def nasty():
    rng = Random(3)
    words = ["alpha", "Beta", "GAMMA", "x#", "50%", "delta", "é"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 199, 200, 201]))), rng.choice(["en", "de", None, ""])) for i in range(60)]
    out += [(100 + i, out[i % 20][1], rng.choice(["en", "fr"])) for i in range(40)]
    out += [(7, out[7][1], "en"), (7, None, "en"), (None, out[7][1], "en"), (None, None, None), (200, None, "en"), (201, "", "en"), (202, " \t\x0b\n", "en"), (203, "a b " * 50_000, "de"), (204, "$" * 300_000, None)]
    labels = [(i, i % 3 == 0 or None, int(i % 5 == 0)) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return out, [(i, None if q is None else int(q), t) for i, q, t in labels]


def test_nulls_repeats_and_sql(spark, tmp_path):
    docs, labels = nasty()
    spark.createDataFrame([(*d, "x", "x", "x") for d in docs], "doc_id long, text string, lang string, mask string, h1 string, part string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = collected(fa.op13_filter_interaction_audit(spark, str(tmp_path)))
    assert got == simulated(docs, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(fa.SQL)
    names = [d[0] for d in cur.description]
    assert {tuple(r[names.index(c)] for c in ("part", "filter_order", "step")): [r[names.index(c)] for c in COUNTS] for r in cur.fetchall()} == got


def test_hot_texts(spark, monkeypatch):
    docs = [(i, "the same words" if i % 3 else f"text {i % 40}", "en") for i in range(4000)]
    want = simulated(docs, [])
    assert collected(fa.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5))) == want


def test_no_rows(spark):
    assert fa.audit(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_inverse_is_exact(spark):
    rows = spark.createDataFrame([("p", m, m % 2, m % 3 == 0) for m in range(32) for _ in range(m * m + 1)], "part string, mask int, good int, toxic boolean")
    got = fa.cells(fa.parity_sums(rows.withColumn("toxic", rows.toxic.cast("int")))).first()
    assert list(got["n"]) == [m * m + 1 for m in range(32)] and list(got["good"]) == [(m * m + 1) * (m % 2) for m in range(32)]
