"""Personal data: seeds by pattern, then bootstrapped contextual extraction, in DataFrame functions only.

Seed entities are the strict matches of each kind. The words around them become lexical patterns (the
word before, the two words before, the words on both sides), and a pattern extracts whatever run of
identifier-like tokens (with a digit or an at sign) stands in its place, of any form. Patterns and
runs form a graph that is scored in rounds: a pattern is worth the share of its distinct runs that
are known to be of a kind, and runs in the place of a pattern that is worth enough become known
themselves, until a round adds nothing. How much is enough is chosen on seeds that are held out.
Contexts, not forms, decide, so nothing is added where a context also surrounds other things. Runs
that are a seed written in another way (10[.]0[.]0[.]1) are known from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import free, let, whole
from weftline.shared import cut

KINDS = ("email", "ip", "card", "phone")
# The look-behinds and \G only say where the leftmost match can begin (a run's start, or where the match before ended), and
# possessive quantifiers only forbid retries that can't succeed: same matches, in linear time and without recursion.
_L = "[A-Za-z0-9._%+-]"
_D = "[A-Za-z0-9-]"
STRICT = {
    "email": rf"(?:(?<!{_L})|\G){_L}++@{_D}++(?:\.{_D}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_TOKEN = r"(?=\S{0,63}[0-9@])\S{1,64}+(?!\S)"
#: What contexts may extract: up to 8 tokens of up to 64 characters with a digit or an at sign, in a row unless one ends a clause, or words joined by a written-out at sign.
RUN = rf"(?<!\S)(?:\S{{1,64}} ?[\[(](?:at|AT)[\])] ?[^\s\[(]{{1,64}}+(?: ?[\[(](?:dot|DOT)[\])] ?[^\s\[(]{{1,64}}+){{0,7}}|{_TOKEN}(?:(?<![,;:.!?\"']) {_TOKEN}){{0,7}})"
_RUN_HINT = r"[0-9@]|[\[(](?:at|AT)[\])]"
#: The kind of a run, which has none yet.
ANY = -1
_HINT = {"ip": r"[0-9]\.[0-9]", "card": "[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_FIELDS = ("start", "end", "value", "left", "left2", "right")
_SPAN = "array<struct<start:int,end:int,value:string,left:string,left2:string,right:string>>"


def _context(words: Column) -> Column:
    """Words as a pattern has them: lower-cased, numbers alike, white space alike."""
    return F.regexp_replace(F.regexp_replace(F.lower(words), "[0-9]+", "0"), r"\s+", " ")


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code point positions and the words before and after, up to the match before or after."""
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    # words before a match are read from the end of the gap, so that a long gap isn't searched
    last = lambda g, n: F.reverse(F.regexp_extract(F.reverse(g), r"^\s?\S++" + r"(?:\s++\S++)?" * (n - 1), 0))
    after = F.slice(F.transform(gaps, lambda g: _context(F.regexp_extract(g, r"^\s?\S++", 0))), F.lit(2), F.size(gaps))
    shaped = F.arrays_zip(
        F.transform(gaps, lambda g: F.char_length(g)).alias("gap"),
        F.transform(gaps, lambda g: _context(last(g, 1))).alias("left"),
        F.transform(gaps, lambda g: _context(last(g, 2))).alias("left2"),
        values.alias("value"), after.alias("right"),
    )
    return let(F.filter(shaped, lambda x: x["value"].isNotNull()), _placed)


_CHUNK = 256


def _placed(shaped: Column) -> Column:
    """Matches with their positions: sums of what comes before, in chunks, so that a text with many matches takes time in proportion."""
    total = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + x)

    def with_sizes(sizes):
        chunks = F.sequence(F.lit(0), F.floor(F.size(sizes) / _CHUNK).cast("int"))
        sums = F.transform(chunks, lambda c: total(F.slice(sizes, c * _CHUNK + 1, _CHUNK)))
        return let(sums, lambda s: let(F.transform(s, lambda _, c: total(F.slice(s, F.lit(1), c))), lambda before: F.transform(shaped, lambda x, i: one(x, i, sizes, before))))

    def one(x, i, sizes, before):
        at = F.get(before, F.floor(i / _CHUNK).cast("int")) + total(F.slice(sizes, F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK))
        start = at + x["gap"]
        return F.struct(start.alias("start"), (start + F.char_length(x["value"])).alias("end"), *[x[c].alias(c) for c in _FIELDS[2:]])

    return let(F.transform(shaped, lambda x: x["gap"] + F.char_length(x["value"])), with_sizes)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(_digits(v))
    return n.between(14, 19) & F.call_function("luhn_check", _digits(v)) if kind == "card" else n.between(10, 15)


def _found(text: Column, kind: str) -> Column:
    hint = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike(_HINT[kind])
    got = F.filter(matches(text, STRICT[kind]), lambda x: _valid(kind, x["value"]))
    return F.when(hint, got).otherwise(F.array().cast(_SPAN))


def _runs(text: Column) -> Column:
    """The runs of `text`, without punctuation around them."""

    def trimmed(x):
        lead = F.char_length(F.regexp_extract(x["value"], r"^[^0-9\p{L}+(\[]*+", 0))
        trail = F.char_length(F.regexp_extract(F.reverse(x["value"]), r"^[^0-9\p{L})\]]*+", 0))
        value = F.substring(x["value"], lead + 1, F.greatest(F.char_length(x["value"]) - lead - trail, F.lit(0)))
        return F.struct((x["start"] + lead).alias("start"), (x["end"] - trail).alias("end"), value.alias("value"), *[x[c].alias(c) for c in _FIELDS[3:]])

    got = F.filter(F.transform(matches(text, RUN), trimmed), lambda x: x["start"] < x["end"])
    return F.when(text.rlike(_RUN_HINT), got).otherwise(F.array().cast(_SPAN))


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), *[x[c].alias(c) for c in _FIELDS[2:]]))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, base, runs): the strict spans of each row, and the runs that overlap none of them; one pass over the texts, written to the shared folder."""
    text = F.col("__text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("__text"))
    rows = rows.withColumn("row", F.xxhash64("id", "__text"))
    for kind in KINDS:
        rows = rows.withColumn(f"__{kind}", _found(text, kind))
    rows = rows.withColumn("__runs", _runs(text)).withColumn("base", F.concat(*[_tagged(F.col(f"__{k}"), i) for i, k in enumerate(KINDS)]))
    return cut(rows.select("id", "row", "base", _tagged(_apart(F.col("__runs"), F.col("base"), F.char_length(text)), ANY).alias("runs")), "spans")


_CELL = 1024


def _apart(runs: Column, base: Column, length: Column) -> Column:
    """The runs that overlap no base span, looked up in cells of the text, of which a run touches two at most."""
    touching = lambda c: F.filter(base, lambda b: (b["start"] < (c + 1) * _CELL) & (b["end"] > c * _CELL))
    cells = F.transform(F.sequence(F.lit(0), F.floor(length / _CELL).cast("int")), touching)

    def free_of(cell, x, at):
        return ~F.exists(F.get(cell, F.floor(at / _CELL).cast("int")), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    kept = let(cells, lambda cell: F.filter(runs, lambda x: free_of(cell, x, x["start"]) & free_of(cell, x, x["end"] - 1)))
    return F.when((F.size(runs) == 0) | (F.size(base) == 0), runs).otherwise(kept)


def normal(kind: Column, value: Column) -> Column:
    """What strict and loose forms of one identifier share: addresses with their dots, cards by their digits, phones by digits and plus sign."""
    written = F.regexp_replace(F.regexp_replace(value, r" ?[\[(](?:at|AT)[\])] ?", "@"), r" ?[\[(](?:dot|DOT)[\])] ?", ".")
    ways = {"email": F.lower(written), "ip": F.lower(F.replace(value, F.lit("[.]"), F.lit("."))), "card": _digits(value), "phone": F.regexp_replace(value, "[^0-9+]", "")}
    return F.coalesce(*[F.when(kind == KINDS.index(k), v) for k, v in ways.items()])


def graph(spans: DataFrame) -> DataFrame:
    """(pattern, node): which patterns distinct values are found in. spans: kind, value, left, left2, right."""
    one, two = F.concat(F.lit("l "), "left"), F.concat(F.lit("ll "), "left2")
    contexts = F.array(F.when(F.trim("left") != "", one), F.when(F.trim("left2").contains(" "), two), F.when((F.trim("left") != "") & (F.trim("right") != ""), F.concat(F.lit("lr "), "left", F.lit(" _ "), "right")))
    return spans.select(F.explode(F.array_compact(contexts)).alias("pattern"), F.lower("value").alias("node")).distinct()


def scored(edges: DataFrame, sizes: DataFrame, known: DataFrame, support: int) -> DataFrame:
    """(pattern, kind, conf): the smoothed share of a pattern's values that are known to be of a kind, where `support` are."""
    hits = edges.join(known, "node").groupBy("pattern", "kind").agg(F.count("*").alias("hits")).where(F.col("hits") >= support)
    return hits.join(sizes, "pattern").select("pattern", "kind", (F.col("hits") / (F.col("n") + 0.5)).alias("conf"))


def _best(edges: DataFrame, good: DataFrame) -> DataFrame:
    """(node, conf, kind): each value's best pattern; a tie goes to the first kind."""
    best = F.max(F.struct("conf", (-F.col("kind")).alias("k"))).alias("b")
    return edges.join(good, "pattern").groupBy("node").agg(best).select("node", F.col("b.conf").alias("conf"), (-F.col("b.k")).alias("kind"))


LEVELS = (0.5, 0.6, 0.7, 0.8, 0.9)


def threshold(edges: DataFrame, seeds: DataFrame, support: int, precision: float) -> float | None:
    """The lowest of LEVELS at which at least `precision` of the held-out seeds that contexts would add get their own kind; None where contexts add none of them.

    A fifth of the seeds, by a hash, is held out: neither known nor counted in the size of a pattern,
    but for the one that is judged. Where no seed falls into that fifth, 0.8.
    """
    hidden = seeds.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(5)) == 0)
    if not hidden.limit(1).count():
        return 0.8
    shown = edges.join(hidden, "node", "left_anti")
    sizes = shown.groupBy("pattern").agg((F.count("*") + 1).alias("n"))
    known = seeds.join(hidden.select("node").distinct(), "node", "left_anti")
    best = _best(edges.join(hidden.select("node").distinct(), "node", "left_semi"), scored(shown, sizes, known, support))
    right = F.max((F.col("kind") == F.col("true")).cast("int"))
    judged = best.join(hidden.select("node", F.col("kind").alias("true")), "node").groupBy("node").agg(F.max("conf").alias("conf"), right.alias("right"))
    got = judged.agg(*[F.avg(F.when(F.col("conf") >= v, F.col("right"))).alias(f"p{i}") for i, v in enumerate(LEVELS)]).first()
    return next((v for v, p in zip(LEVELS, got, strict=True) if p is not None and p >= precision), None)


def learn(spans: DataFrame, support: int = 3, least: float | None = None, precision: float = 0.95) -> DataFrame:
    """(kind, node): lower-cased runs that are seeds in another form, or that patterns worth `least` discover.

    spans: kind (ANY for runs), value, left, left2, right. A pattern needs `support` distinct known
    values. `least` is chosen by threshold() where it isn't given. A value that several kinds'
    patterns discover takes the surest one's. Values only ever become known, so the rounds end;
    counts are distinct over the whole corpus and summed on the map side.
    """
    seeds = spans.where(F.col("kind") != ANY).select("kind", F.lower("value").alias("node"), normal(F.col("kind"), F.col("value")).alias("form")).distinct()
    runs = spans.where(F.col("kind") == ANY).select(F.lower("value").alias("node"), "value").distinct()
    forms = runs.select("node", "value", F.explode(F.array(*[F.lit(i) for i in range(len(KINDS))])).alias("kind"))
    forms = forms.select("node", "kind", normal(F.col("kind"), F.col("value")).alias("form")).join(seeds.select("kind", "form").distinct(), ["kind", "form"], "left_semi")
    seeds = cut(seeds.select("kind", "node").distinct(), "seeds")
    found = cut(forms.select("kind", "node").distinct(), "known")
    edges = cut(graph(spans), "graph")
    least = threshold(edges, seeds, support, precision) if least is None else least
    if least is None:
        return found
    sizes = cut(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support), "sizes")
    while True:
        known = seeds.unionByName(found).distinct()
        good = scored(edges, sizes, known, support).where(F.col("conf") >= least)
        new = _best(edges.join(known.select("node").distinct(), "node", "left_anti"), good).select("kind", "node")
        new = cut(new, "known")
        if not new.limit(1).count():
            return found
        found = cut(found.unionByName(new), "known")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, row, base, spans) for each row of `docs`: arrays of (start, kind, end), ends exclusive, in code points.

    `base` are the strict matches, `spans` those and what contexts add, as well as other forms of what is
    a strict match anywhere; a span that overlaps a base span isn't added. `row` tells rows of one id
    apart. Null and empty texts have none. Repeated rows get equal spans and count once in the graph.
    An empty table gives an empty result. Texts of any length are read whole; tokens of more than 64
    characters are no identifiers.
    """
    got = scan(docs, id_col, text_col)
    each = got.select("id", "row", F.explode(F.concat("base", "runs")).alias("x")).select("id", "row", "x.*")
    new = learn(each, **how)
    added = each.where(F.col("kind") == ANY).drop("kind").withColumn("node", F.lower("value")).join(new, "node")
    added = added.groupBy(F.col("id").alias("aid"), F.col("row").alias("arow")).agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))
    base = F.array_sort(F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    got = got.select("id", "row", base.alias("base")).join(added, F.col("id").eqNullSafe(F.col("aid")) & (F.col("row") == F.col("arow")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return got.select("id", "row", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _redacted(text: Column, spans: Column) -> Column:
    """`text` with its spans, sorted by start, as <KIND>, in time proportional to its length and their number: pieces are read from chunks of the text, and where the spans before end is a maximum by chunks of spans."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ends, chunk = F.transform(spans, lambda x: x["end"]), lambda i, size: F.floor(i / size).cast("int")

    def piece(chunks, a, b):
        near = F.slice(chunks, chunk(a, _CELL) + 1, chunk(b, _CELL) - chunk(a, _CELL) + 1)
        return F.substring(F.array_join(near, ""), a % _CELL + 1, b - a)

    def written(chunks, ends, tops):
        def one(x, i):
            at = F.coalesce(F.greatest(F.get(tops, chunk(i, _CHUNK)), F.array_max(F.slice(ends, chunk(i, _CHUNK) * _CHUNK + 1, i % _CHUNK))), F.lit(0))
            return let(at, lambda at: F.when(x["start"] >= at, F.concat(piece(chunks, at, x["start"]), F.get(names, x["kind"]))))

        last = F.array_max(ends)
        return F.concat(F.array_join(F.transform(spans, one), ""), piece(chunks, last, F.char_length(text)))

    def with_tops(chunks, ends):
        firsts = F.sequence(F.lit(0), chunk(F.size(ends), _CHUNK))
        tops = F.transform(firsts, lambda c: F.array_max(F.slice(ends, c * _CHUNK + 1, _CHUNK)))
        before = let(tops, lambda t: F.transform(t, lambda _, c: F.array_max(F.slice(t, F.lit(1), c))))
        return let(before, lambda t: written(chunks, ends, t))

    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_CELL}}}"), 0)
    return let(chunks, lambda c: let(ends, lambda e: with_tops(c, e)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs` with every span of `text_col` replaced by <KIND>; overlapping spans become the first one's kind. Texts without spans stay as they are, null ones too."""
    (row,) = free(docs, "row_hash")
    spans = find(docs, id_col, text_col, **how).where("size(spans) > 0").select(F.col("id").alias(f"{row}_id"), F.col("row").alias(f"{row}_of"), F.col("spans").alias(f"{row}_spans")).distinct()
    rows = docs.withColumn(row, F.xxhash64(F.col(id_col).cast("long"), whole(F.col(text_col))))
    rows = rows.join(spans, F.col(id_col).eqNullSafe(F.col(f"{row}_id")) & (F.col(row) == F.col(f"{row}_of")), "left")
    new = F.when(F.col(f"{row}_spans").isNull(), F.col(text_col)).otherwise(_redacted(whole(F.col(text_col)), F.col(f"{row}_spans")))
    return rows.select(*[new.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op8_pii(spark, sf_dir: str) -> DataFrame:
    from weftline.tables import table

    got = find(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return got.select(F.col("id").alias("doc_id"), *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
