"""Personal data: base spans against Python's, and contexts that discover planted identifiers by default settings."""

import re
import time

import duckdb
import numpy as np

from weftline.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_of(text):
    out = []
    for kind, name in enumerate(pii.KINDS):
        for m in re.finditer(PATTERNS[name], text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if name == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_equals_python(spark):
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    odd = ["1" * 5000, "1 " * 3000 + "4111 1111 1111 1111", "4111111111111111" * 2, "a@b.c" * 300, "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.255 1.1.1", "+1 (017) 555-7713+1 (018) 555-7713", "é 10.0.0.1 日本 a@b.co 4111-1111-1111-1111", "+" * 4000 + "12345678901",
           "@" * 3000, "x@y..z a@b.c.", "0.0.0.0 4111 1111 1111 1112", "+1" + " " * 2000 + "2345678901"]
    docs += [(10**6 + i, t) for i, t in enumerate(odd)]
    got = {r["id"]: [tuple(x) for x in r["base"]] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    for i, text in docs:
        assert got[i] == base_of(text), (i, (text or "")[:60])


def planted(seed=1, n=60):
    """Documents with seeds in telling contexts, unseen identifiers in the same contexts, and numbers in others."""
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}" for a in "kar lon mis tep vor".split() for b in "an el in os ut".split()]
    filler = lambda: " ".join(rng.choice(words, 8))
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    docs, hidden = [], []

    def add(before, value, after, kind=None):
        text = f"{filler()} {before} {value} {after} {filler()}"
        if kind is not None:
            start = text.index(value)
            hidden.append((len(docs), start, kind, start + len(value)))
        docs.append((len(docs), text))

    for i in range(n):
        add("you can reach me at", f"+1 ({digits(3)}) 555-{digits(4)}", "any day")
        add("logged in from host", f"10.{i}.{rng.integers(0, 256)}.7", "last night")
        add("the order number is", f"A-{digits(6)}", "as agreed")
        add(rng.choice(words), f"{digits(5)}", rng.choice(words))
    for i in range(n // 4):
        add("you can reach me at", f"({digits(3)}) 555-{digits(4)}", "any day", pii.KINDS.index("phone"))
        add("logged in from host", f"fe80:0:0:{i}::{digits(2)}", "last night", pii.KINDS.index("ip"))
    return docs, hidden


def test_contexts_discover_unseen_identifiers(spark):
    docs, hidden = planted()
    rows = pii.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    added = {(r["id"], *x) for r in rows for x in r["spans"] if x not in r["base"]}
    right = added & set(hidden)
    assert len(right) / len(hidden) >= 0.95 and len(right) / len(added) >= 0.95
    assert all(set(r["base"]) <= set(r["spans"]) for r in rows)


def test_contexts_that_tell_nothing_add_nothing(spark):
    """The same words before seeds and before other numbers."""
    docs = [(i, f"some words and the +1 (0{i % 10}7) 555-{1000 + i} there") for i in range(20)]
    docs += [(100 + i, f"some words and the {5000 + i} there") for i in range(40)]
    assert all(r["spans"] == r["base"] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_rounds_go_on_until_nothing_is_added(spark):
    """A chain of contexts, each known only by what the one before discovers."""
    docs = []
    for i in range(30):
        docs.append(f"write to me +1 ({200 + i}) 555-{1000 + i} soon")
    links = 6
    for k in range(links):
        for i in range(6):
            left = "write to me" if k == 0 else f"list context{'abcdefgh'[k]}"
            docs += [f"{left} ({300 + 10 * k + i}) 555-{2000 + i} soon", f"list context{'abcdefgh'[k + 1]} ({300 + 10 * k + i}) 555-{2000 + i} maybe"]
    got = pii.find(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), least=0.45).collect()
    assert all(len(r["spans"]) == 1 for r in got)


def test_ties_repeats_and_long_texts(spark):
    """A run that two kinds' contexts vouch for alike gets one kind; repeated rows count once; a long text is read to its end."""
    docs = [(i, f"mail or call here 10.0.{i}.1 now") for i in range(5)] + [(10 + i, f"mail or call here +1 (0{i}7) 555-100{i} now") for i in range(5)]
    docs += [(20, "mail or call here 77-1234 now")] * 4 + [(30, "word " * 60_000 + "10.9.9.9 end " + "x" * 200_000 + " 10.8.8.8")]
    rows = pii.find(spark.createDataFrame(docs, "doc_id long, text string"), least=0.3).collect()
    assert len(rows) == len(docs) and all(len({(x["start"], x["end"]) for x in r["spans"]}) == len(r["spans"]) for r in rows)
    long = next(r for r in rows if r["id"] == 30)
    assert [x["start"] for x in long["base"]] == [300_000, 300_000 + 13 + 200_000 + 1]


def redacted(text, spans):
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{pii.KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_redact_equals_python(spark):
    """Spans that touch, overlap, open and end a text, texts of whole chunks, and characters beyond 16 bits."""
    texts = [None, "", "none", "a@b.co", "a@b.co c@d.co", "+1 (017) 555-7713+1 (018) 555-7713", "x" * 1018 + " a@b.c" + "y", "\U0001f600" * 1024, "\U0001f600" * 1023 + " a@b.co", "1.2.3.4\n\U0001f600 4111 1111 1111 1111, " * 700, "+4111111111111111 " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spans = {r["id"]: [tuple(x) for x in r["spans"]] for r in pii.find(docs).collect()}
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {i: None if t is None else redacted(t, spans[i]) for i, t in enumerate(texts)}
    assert len(spans[9]) == 1400


def test_many_spans_redact_in_proportion(spark):
    """A text of 3 million characters with 70,000 addresses."""
    text = "mail to somebody@example.org or 10 others " * 70_000
    spans = [(m.start(), 0, m.end()) for m in re.finditer("somebody@example.org", text)]
    typed = spark.createDataFrame([(text, spans)], "text string, spans array<struct<start:int,kind:int,end:int>>")
    started = time.monotonic()
    assert typed.select(pii._redacted(typed["text"], typed["spans"])).first()[0] == text.replace("somebody@example.org", "<EMAIL>")
    assert time.monotonic() - started < 60
