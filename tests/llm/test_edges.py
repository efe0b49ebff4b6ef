"""Nulls, empty and long texts, ties and repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import numpy as np
import pytest

from weftline.llm import exact_dedup, fingerprints, html_extract, language_id, line_dedup, near_dedup, packing, pii, piece_sampling, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, Kept string, row_hash string, digest string, lang_pred string, n_lines string, repeated string"
LONG = "the quick brown fox jumps over the lazy dog and runs away from it all day " * 1500
NEAR = " ".join(f"w{i}" for i in range(100))


def rows():
    texts = ["Hello world, this is the first line\nshort\nA shared line of text", None, "", "   \n\t", "a shared line of text  \nother words here", "Hello world, this is the first line\nshort\nA shared line of text",
             LONG, LONG, NEAR, NEAR.replace("w50", "x"), "12345 !!!", "mail a.b@mail.example.com or 10.0.0.1, +1 (017) 555-7713, card 4111 1111 1111 1111"]
    out = [(i, t, "en", None, None, *["x"] * 7) for i, t in enumerate(texts)]
    return [*out, out[0], (None, "no id at all", None, None, None, *[None] * 7), (None, None, None, None, None, *[None] * 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(docs, none):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs).collect() if r["doc_id"] is not None}
    assert got[5]["keep_id"] == 0 and got[0]["group_size"] == 3 and not got[5]["kept"]
    assert got[1]["keep_id"] == got[2]["keep_id"] == 3 and got[7]["keep_id"] == 6
    assert got[9]["group_size"] == 1 and got[9]["kept"]
    assert exact_dedup.exact_groups(docs).count() == len(rows())
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.exact_dedup(docs).columns == docs.columns


def test_lines(docs, none):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect() if r["doc_id"] is not None}
    assert got[0]["n_dropped"] == 0 and got[5]["n_dropped"] == 2 and got[5]["text"] == "short"
    assert got[4]["text"] == "other words here" and got[1]["n_lines"] == 1 and got[1]["text"] == ""
    assert got[7]["text"] == "" and got[6]["text"] == LONG
    assert line_dedup.dedup_lines(docs).count() == len(rows()) and line_dedup.dedup_lines(none).count() == 0


def test_many_lines(spark):
    many = [f"line number {i} of many" if i % 3 else f"own line {i}" for i in range(100_000)]
    other = [f"line number {i} of many" for i in range(100_000)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame([(1, "\n".join(other)), (2, "\n".join(many))], "doc_id long, text string")).collect()}
    assert got[2]["text"] == "\n".join(x for x in many if x.startswith("own")) and got[2]["n_dropped"] == 66_666 and got[1]["n_dropped"] == 0


def test_near(docs, none):
    got = [r for r in near_dedup.near_groups(docs).collect()]
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == len(rows()) and by[9]["component_id"] == 8 and not by[9]["kept"]
    assert by[5]["component_id"] == 0 and by[7]["component_id"] == 6 and by[1]["n_shingles"] == 0 and by[3]["kept"]
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert near_dedup.near_groups(none).count() == 0
    assert near_dedup.near_dedup(docs).columns == docs.columns


def test_language(docs, none):
    model = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.identify(docs, model).collect()} == {"und"}
    got = language_id.identify(docs, language_id.fit(docs)).collect()
    by = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] is not None}
    assert len(got) == len(rows()) and by[0] == "en" and by[10] == by[1] == by[3] == "und"
    assert language_id.identify(none, model).count() == 0


def test_pieces(docs, none):
    got = piece_sampling.digests(docs).collect()
    assert len(got) == len(rows()) and all(r["lossless"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, piece_sampling.digests(docs.repartition(1)).collect()))
    back = piece_sampling.decode(piece_sampling.encode(docs)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back) and piece_sampling.digests(none).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "▁x▁", "", "▁", "é▁▁ \n\t", "x" * 500, "日本語 テキスト😀", "a\0b", " lead", "trail "])
def test_lossless(text):
    model = piece_sampling.lattices(piece_sampling.model_path(), 1.0)
    ids, bounds = model.encode([text], np.array([5], np.uint64))
    assert model.decode(ids.tolist()) == text and bounds.tolist() == [0, len(ids)]


def test_sampled_shares():
    model = piece_sampling.lattices(piece_sampling.model_path(), 1.0)

    def cuts(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            p = model.pieces.get(s[:k])
            if p is not None:
                for rest, w in cuts(s[k:]):
                    yield (p, *rest), w * model.weight[p]

    exact = dict(cuts(" inner"))
    total, n = sum(exact.values()), 40_000
    ids, b = model.encode(["inner"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
    seen: dict = {}
    for x, y in zip(b[:-1], b[1:], strict=True):
        k = tuple(ids[x:y].tolist())
        seen[k] = seen.get(k, 0) + 1
    assert set(seen) <= set(exact) and all(abs(seen.get(k, 0) / n - w / total) < 0.01 for k, w in exact.items())


def test_substrings(docs, none, spark):
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs).collect() if r["doc_id"] is not None}
    assert got[7]["n_dropped_bytes"] > 0 and not got[3]["repeated"] and got[8]["repeated"] and got[8]["n_dropped_bytes"] == 0
    assert got[6]["text"] == LONG and substring_dedup.dedup_substrings(docs).count() == len(rows())
    assert substring_dedup.dedup_substrings(none).count() == 0
    a, b = "é" * 300 + NEAR, "prefix of another kind " + NEAR
    mine = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    two = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(mine).collect()}
    assert two[1]["text"] == a and two[2]["text"].startswith("prefix of another kind ") and len(two[2]["text"]) < len(b)


def test_chunks_do_not_shift():
    a = NEAR.encode() * 3
    ends = substring_dedup.cuts(a)
    later = substring_dedup.cuts(b"inserted " + a)
    assert set((ends[5:] + 9).tolist()) <= set(later.tolist()) and ends[-1] == len(a)


def test_fingerprints(docs, none):
    ids = docs.select("doc_id", "text")
    got = fingerprints.with_next(ids, "doc_id", {}).collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["next_text"] == "" and by[9]["next_text"] == "12345 !!!"
    assert fingerprints.with_next(none.select("doc_id", "text"), "doc_id", {}).count() == 0
    fp = {r["text"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()}
    assert fp[""] == "" and len(fp[LONG]) % 8 == 0


def test_private(docs, none):
    got = {r["id"]: r for r in pii.find(docs).collect() if r["id"] is not None}
    assert [x["kind"] for x in got[11]["base"]] == [0, 1, 3, 2] and got[1]["base"] == []
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect() if r["doc_id"] is not None}
    assert text[11] == "mail <EMAIL> or <IP>, <PHONE>, card <CARD>" and text[1] is None and text[6] == LONG
    assert pii.redact(docs).columns == docs.columns and pii.find(none).count() == 0


def test_known_in_another_form(spark):
    known = ["from 10.0.0.1 now", "to 1.23.4.5 only", "pay 4111 1111 1111 1111 soon", "write a.b@mail.example.com today"]
    loose = ["seen 10[.]0[.]0[.]1 there", "some 12[.]3[.]4[.]5 else", "use 4111.1111.1111.1111, 4111/1111/1111/1111", "ask A.B [at] mail [dot] example.com ok", "ask ab(at)mail.example.com ok"]
    docs = spark.createDataFrame(list(enumerate(known + loose)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert [got[i] for i in range(4)] == ["from <IP> now", "to <IP> only", "pay <CARD> soon", "write <EMAIL> today"]
    assert [got[i] for i in range(4, 9)] == ["seen <IP> there", loose[1], "use <CARD>, <CARD>", "ask <EMAIL> ok", loose[4]]


def test_packing(docs, none):
    got = packing.pack(docs).collect()
    assert len({r["doc_id"] for r in got}) == 13
    rooms: dict = {}
    for r in got:
        rooms.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in rooms.values():
        v.sort()
        assert v[0][0] == 0 and sum(n for _, n in v) <= 1024 and all(a[0] + a[1] == b[0] for a, b in zip(v, v[1:], strict=False))
    assert packing.pack(none).count() == 0
    one = sorted((r["piece"], r["length"]) for r in got if r["doc_id"] == 6)
    assert all(n == 1024 for _, n in one[1:]) and one[0][1] <= 1024


def test_same_ids_as_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    encode = packing.encoder(path)
    for s in ["", " a  b\n\n c\t \nd ", "<|endoftext|> it's 12345,,  ünïcödé 日本 ▁ x  y", NEAR, "\n", "  ", "a\r\n b"]:
        assert list(encode(s)) == t.encode(s, add_special_tokens=False).ids, s


def test_same_ids_as_default_tokenizers(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    end = "<|endoftext|>"
    long = [" " * 1_000_100 + "x", "a" + "\n" * 1_000_100, f"a\t {end}" + " \n" * 600_000 + f"b{end}"]
    texts = [end, f" a  {end}\n\n b{end}{end} <|endoftext| >  c", "a \x1c\x1d  b\x1c c\u3000\u3000d \xa0e\x85\x85", "a  b\r\n\r\n  'll  12  !!\t\tz  ", *long]
    encode = packing.encoder(path, added=True)
    for s in texts:
        assert list(encode(s)) == t.encode(s, add_special_tokens=False).ids, s[:50]
    docs = spark.createDataFrame(list(enumerate(texts[:2])), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in packing.pieces(docs, path, keep_ids=True).collect()}
    assert got == {i: [*t.encode(s, add_special_tokens=False).ids, packing.END] for i, s in enumerate(texts[:2])}
    monkeypatch.setattr(packing, "_LONG", 0)
    for s in [*texts[:4], NEAR, LONG, " ", "\n\n"]:
        assert list(encode(s)) == t.encode(s, add_special_tokens=False).ids, s[:50]


def test_pages(spark):
    page = '<html><head><title>t</title><script>var a="</p>"</script></head><body><nav><a href=x>menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; more</h1><p>One\n two<br>three<p>Four &lt;b&gt;</article><div id="comments"><p>nice</p></div><footer>&copy; x</footer>'
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, None), (None, "u", "", None), (1, "u", page, "x")], "page_id long, url string, html string, Text string")
    w = html_extract.fit(df)
    got = html_extract.extract(df, w).collect()
    assert len(got) == 4 and [r["text"] for r in got if r["page_id"] == 1] == ["Head & more\n\nOne two three\n\nFour <b>"] * 2
    assert sum(r["text"] == "" and r["n_chars"] == 0 for r in got) == 2
    assert html_extract.extract(df.limit(0), html_extract.fit(df.limit(0))).count() == 0


def test_min_cut_is_least():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        score = rng.normal(size=n).tolist()
        edges = [(i - 1, i, float(rng.random() * 1.5)) for i in range(1, n)] + [(0, n - 1, 0.4)] * (n > 2)

        def cost(label, score=score, edges=edges):
            return sum(max(0, s) if not k else max(0, -s) for s, k in zip(score, label, strict=True)) + sum(w for a, b, w in edges if label[a] != label[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert abs(cost(html_extract.min_cut(score, edges)) - best) < 1e-9


def test_digest_of_nothing(docs):
    got = exact_dedup.exact_groups(docs).where("doc_id = 1").first()
    assert got["text_sha256"] == hashlib.sha256(b"").hexdigest()
