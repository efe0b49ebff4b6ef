"""Queries of registers, contracts, sources, sinks and scalar functions."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from weftline import sinks
from weftline.functions import scalars
from weftline.operators import contracts, panel, reconcile
from weftline.plans.catalogue import VERSIONS, query, rounded, versions
from weftline.shared import shared_dir
from weftline.sources import files, sqlite, xlsx
from weftline.tables import table

# joins ----------------------------------------------------------------------------------------


@query(f"WITH {VERSIONS} SELECT o.o_orderkey, v.o_orderkey AS version, v.o_orderpriority FROM orders o JOIN v ON v.o_custkey = o.o_custkey AND v.valid_from <= o.o_orderdate + INTERVAL 30 DAY AND (v.valid_to IS NULL OR v.valid_to > o.o_orderdate + INTERVAL 30 DAY)")
def interval_join(s, d):
    """The version of a customer's priority that holds 30 days after each of their orders."""
    facts = table(s, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("at"))
    held = versions(s, d).withColumnRenamed("o_orderkey", "version")
    return reconcile.interval_join(facts, held, ["o_custkey"], "at").select("o_orderkey", "version", "o_orderpriority")


@query(f"WITH {VERSIONS} SELECT o.o_orderkey, v.o_orderkey AS version FROM orders o JOIN v ON v.o_custkey = o.o_custkey AND v.valid_from <= o.o_orderdate AND (v.valid_to IS NULL OR v.valid_to >= o.o_orderdate)")
def interval_join_closed(s, d):
    """All versions that hold on the day of each order, both ends included."""
    facts = table(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("at"))
    held = versions(s, d).withColumnRenamed("o_orderkey", "version")
    return reconcile.interval_join(facts, held, ["o_custkey"], "at", closed=True).select("o_orderkey", "version")


@query("SELECT s.s_suppkey AS left_id, c.c_custkey AS right_id FROM supplier s JOIN customer c ON s.s_acctbal <= c.c_acctbal + 2.0 * (c.c_custkey % 50) AND c.c_acctbal <= s.s_acctbal + 60 AND s.s_nationkey - 1 <= c.c_nationkey AND c.c_nationkey <= s.s_nationkey + 1")
def box_join(s, d):
    """Suppliers and customers of nations next to one another whose ranges of balances meet."""
    v = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x0"), (F.col("s_acctbal") + 60).alias("x1"), (F.col("s_nationkey") - 1).alias("y0"), (F.col("s_nationkey") + 1).alias("y1"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x0"), (F.col("c_acctbal") + 2.0 * (F.col("c_custkey") % 50)).alias("x1"), F.col("c_nationkey").alias("y0"), F.col("c_nationkey").alias("y1"))
    return reconcile.box_join(v, c, 4.0)


_REGISTER = "reg AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '1 512 ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN '79-701-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-000' ELSE CAST(20000000 + c_custkey AS VARCHAR) END AS code, v.f AS year_from, v.t AS year_to FROM customer, (VALUES (1992, 1994), (1994, 1997)) v(f, t) WHERE c_custkey % 7 > 0 OR v.f = 1992)"


def register(s, d):
    """(id, code, year_from, year_to): two versions of a code a customer, every seventh's ended."""
    k = F.col("c_custkey")
    tail = F.lpad((k % 1000).cast("string"), 3, "0")
    code = F.when(k % 3 == 0, F.concat(F.lit("1 512 "), tail)).when(k % 3 == 1, F.concat(F.lit("79-701-"), tail, F.lit("-000"))).otherwise((20000000 + k).cast("string"))
    years = F.explode(F.array(*[F.struct(F.lit(a).alias("f"), F.lit(b).alias("t")) for a, b in ((1992, 1994), (1994, 1997))]))
    rows = table(s, d, "customer").select(k.alias("id"), code.alias("code"), years.alias("v"))
    return rows.select("id", "code", F.col("v.f").alias("year_from"), F.col("v.t").alias("year_to")).where("id % 7 > 0 or year_from = 1992")


_CODE8 = "CASE WHEN regexp_full_match(v, '[0-9]{7}') THEN '0' || v WHEN regexp_full_match(v, '[0-9]{8}') THEN v WHEN regexp_full_match(v, '[0-9]{11}') THEN substr(v, 1, 8) END"
_CROSSWALK = f"{_REGISTER}, cw AS (SELECT id, year, {_CODE8} AS code FROM (SELECT id, y.year, regexp_replace(code, '[\\s-]', '', 'g') AS v FROM reg, (VALUES (1993), (1995)) y(year) WHERE year_from <= y.year AND y.year < year_to))"


@query(f"WITH {_CROSSWALK} SELECT id, year, code FROM cw")
def code_crosswalk(s, d):
    """Each customer's code in two years, from the version that is valid then."""
    r = register(s, d)
    return reconcile.crosswalk(r, r, "id", "code", [1993, 1995])


_COVER = f"{_CROSSWALK}, n AS (SELECT id, count(*) FILTER (WHERE year = 1993) AS n1, count(*) FILTER (WHERE year = 1995) AS n2 FROM cw GROUP BY id)"
_STATUS = "CASE WHEN {0} = 1 THEN 'matched' WHEN {0} > 1 THEN 'ambiguous' ELSE 'missing' END"


@query(f"WITH {_COVER} SELECT id, {_STATUS.format('n1')} AS status_1993, {_STATUS.format('n2')} AS status_1995, n1 = 1 AND n2 = 1 AS complete FROM n")
def both_years_status(s, d):
    """Whether each customer has exactly one code in each of two years."""
    r = register(s, d)
    n = reconcile.crosswalk(r, r, "id", "code", [1993, 1995]).groupBy("id", "year").agg(F.count("*").alias("n"))
    return reconcile.both_years(n, "id", "year", "n", [1993, 1995])


_AUDIT = """k AS (SELECT o_custkey AS id, year(o_orderdate) AS year, list(CASE WHEN o_orderkey % 11 = 0 THEN -o_totalprice WHEN o_orderkey % 13 = 0 THEN CAST('inf' AS DOUBLE) ELSE round(o_totalprice / 100000) END) AS vs FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) IN (1995, 1996) GROUP BY ALL),
a AS (SELECT c_custkey AS id, y.year, c_nationkey AS region, c_acctbal AS population, coalesce(vs, []) AS vs FROM customer, (VALUES (1995), (1996)) y(year) LEFT JOIN k ON k.id = c_custkey AND k.year = y.year),
st AS (SELECT id, year, CASE WHEN len(vs) = 0 THEN 'missing' WHEN len(list_filter(vs, lambda v: v < 0 OR v = CAST('inf' AS DOUBLE))) > 0 THEN 'invalid' WHEN len(list_distinct(vs)) > 1 THEN 'conflict' WHEN id % 17 = 0 THEN 'boundary_review' WHEN region IN (1, 2) THEN 'geography_review' WHEN id = 188 AND year = 1996 THEN 'value_review' WHEN population IS NULL OR population <= 0 THEN 'no_population' ELSE 'ok' END AS status FROM a)"""


def audited(s, d):
    """(id, year, status): the cascade over the urgent orders' rounded prices of each customer and year, some made negative or infinite."""
    o = table(s, d, "orders").where("o_orderpriority = '1-URGENT' and year(o_orderdate) in (1995, 1996)")
    price = F.when(F.col("o_orderkey") % 11 == 0, -F.col("o_totalprice")).when(F.col("o_orderkey") % 13 == 0, F.lit(float("inf"))).otherwise(F.round(F.col("o_totalprice") / 100000))
    lists = reconcile.value_lists(o.select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year"), price.alias("v")), ["id", "year"], "v")
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.array(F.lit(1995), F.lit(1996))).alias("year"), F.col("c_nationkey").alias("region"), F.col("c_acctbal").alias("population"))
    rows = reconcile.with_lists(c, lists, ["id", "year"])
    status = reconcile.status_cascade(
        F.col("values"), ("boundary_review", F.col("id") % 17 == 0), ("geography_review", F.col("region").isin(1, 2)), ("value_review", (F.col("id") == 188) & (F.col("year") == 1996)),
        ("no_population", ~scalars.finite(F.col("population")) | (F.col("population") <= 0)),
    )
    return rows.select("id", "year", status.alias("status"))


@query(f"WITH {_AUDIT} SELECT id, year, status FROM st")
def status_cascade(s, d):
    return audited(s, d)


@query(f"WITH {_AUDIT} SELECT 'price' AS metric, year, status, CAST(count(*) AS BIGINT) AS n FROM st GROUP BY ALL")
def status_coverage(s, d):
    return reconcile.coverage_counts(audited(s, d).withColumn("metric", F.lit("price")))


@query(f"WITH {_AUDIT} SELECT 'price' AS metric, CAST(count(*) FILTER (WHERE n = 2) AS BIGINT) AS both FROM (SELECT id, count(*) FILTER (WHERE status = 'ok') AS n FROM st GROUP BY id)")
def covered_both_years(s, d):
    return reconcile.covered_in_all(audited(s, d).withColumn("metric", F.lit("price")), "id", 2)


_INDICATORS = "i AS (SELECT CAST(o_custkey AS VARCHAR) AS oktmo, year(o_orderdate) AS year, o_orderstatus AS indicator_code, 'roubles' AS indicator_unit, o_orderpriority AS indicator_period, 'upper' AS mun_level, o_totalprice AS indicator_value FROM orders)"


@query(f"WITH {_INDICATORS} SELECT oktmo AS code, CAST(year AS INT) AS year, indicator_value AS value FROM i WHERE indicator_code = 'F' AND indicator_period = '2-HIGH' AND mun_level = 'upper'")
def indicator_reader(s, d):
    o = table(s, d, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("oktmo"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("indicator_code"), F.lit("roubles").alias("indicator_unit"), F.col("o_orderpriority").alias("indicator_period"), F.lit("upper").alias("mun_level"), F.col("o_totalprice").alias("indicator_value"))
    return reconcile.read_indicator(rows, "F", "roubles", "2-HIGH", "upper")


@query("SELECT o_orderkey, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def many_to_one_join(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return contracts.many_to_one(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), c, ["o_custkey"], "inner").select("o_orderkey", "o_orderpriority", "c_mktsegment")


@query("WITH a AS (SELECT o_custkey, year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY ALL) SELECT o_orderkey, CAST(a.year AS INT) AS year, n, price FROM orders o JOIN a ON a.o_custkey = o.o_custkey AND a.year = year(o.o_orderdate)")
def composite_join(s, d):
    """Each order with its customer's number and sum of orders of the year, on two keys."""
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    a = o.groupBy("o_custkey", "year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    return o.select("o_custkey", "year", "o_orderkey").join(a, ["o_custkey", "year"]).select("o_orderkey", "year", "n", "price")


@query("SELECT n_nationkey, n_name, r_name, s.n AS suppliers FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def one_to_one_join(s, d):
    n = contracts.many_to_one(table(s, d, "nation"), table(s, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"])
    v = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return contracts.one_to_one(n, v, ["n_nationkey"]).select("n_nationkey", "n_name", "r_name", "suppliers")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 12 MONTH)")
def anti_join(s, d):
    """Customers without an order in the last twelve months of the table."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("timestamp").alias("at"))
    since = o.agg(F.max("at").alias("last")).select((F.col("last") - F.expr("INTERVAL 12 MONTH")).alias("since"))
    late = o.join(F.broadcast(since), F.col("at") >= F.col("since")).select("c_custkey")
    return table(s, d, "customer").select("c_custkey").join(late, "c_custkey", "left_anti")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM nation")
def key_equality(s, d):
    """The nations, each once, and the same as those that belong to a region, as the contract wants."""
    n = table(s, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    return contracts.same_keys(contracts.unique(n, ["n_nationkey"]), n.join(table(s, d, "region"), "r_regionkey"), ["n_nationkey"]).agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, CAST(count(*) AS BIGINT) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def group_contract(s, d):
    """Five regions, each complete with its five nations."""
    n = table(s, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return contracts.complete(n, ["r_regionkey"], rows=5, groups=5).groupBy("r_regionkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_custkey % 4 < 2 AS good FROM customer")
def arithmetic_consistency(s, d):
    """Totals given as text: right, right, wrong and no number."""
    k = F.col("c_custkey")
    total = F.when(k % 4 < 2, (k + 5).cast("string")).when(k % 4 == 2, k.cast("string")).otherwise("many")
    return table(s, d, "customer").select(k, reconcile.consistent(total, k.cast("string"), F.lit("5")).alias("good"))


@query("SELECT a.a AS neighbours, b.b AS bandwidth, c.c AS distance FROM (VALUES (4), (8), (16), (32)) a(a), (VALUES (0.5), (1.0), (2.0)) b(b), (VALUES ('cosine'), ('euclidean')) c(c)".replace("b.b AS", "CAST(b.b AS DOUBLE) AS"))
def parameter_grid(s, d):
    grid = s.createDataFrame([(4,), (8,), (16,), (32,)], "neighbours int")
    return grid.crossJoin(s.createDataFrame([(0.5,), (1.0,), (2.0,)], "bandwidth double")).crossJoin(s.createDataFrame([("cosine",), ("euclidean",)], "distance string"))


_BOTH = "x AS (SELECT o_custkey AS id, list(m ORDER BY y) AS vals FROM (SELECT o_custkey, year(o_orderdate) AS y, round(avg(o_totalprice), 6) AS m FROM orders WHERE year(o_orderdate) IN (1995, 1996) GROUP BY ALL) GROUP BY 1 HAVING count(*) = 2)"


@query(f"WITH {_BOTH} SELECT id, vals[1] AS first, vals[2] AS second FROM x WHERE vals[1] >= 100000 AND vals[2] >= 100000")
def both_years_panel(s, d):
    """Customers with valid means in both of two years, by the array of both."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("y"), "o_totalprice").where("y in (1995, 1996)")
    m = o.groupBy("id", "y").agg(F.round(F.avg("o_totalprice"), 6).alias("m"))
    got = m.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "m"))), lambda x: x["m"]).alias("vals"))
    return got.where((F.size("vals") == 2) & F.forall("vals", lambda v: scalars.finite(v) & (v >= 100000))).select("id", F.col("vals")[0].alias("first"), F.col("vals")[1].alias("second"))


# sources and sinks ----------------------------------------------------------------------------


def _folder(s, name: str) -> str:
    import uuid

    return f"{shared_dir(s)}/weftline-{name}-{uuid.uuid4().hex}"


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query(_NATION)
def csv_inferred(s, d):
    """The nations written as CSV and read again with inferred types."""
    path = _folder(s, "csv")
    sinks.write_csv(table(s, d, "nation"), path, ["n_nationkey"])
    files.required(s, [path])
    return files.read_csv(s, path, multi_line=False).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, printf('%.6f', s_acctbal) AS s_acctbal FROM supplier")
def csv_as_text(s, d):
    """Suppliers written with six places and read with every cell as text."""
    path = _folder(s, "csv")
    sinks.write_csv(table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, ["s_suppkey"], digits=6)
    return files.read_csv_text(s, path, multi_line=False)


@query("SELECT r_regionkey AS id, r_name AS name, CAST(count(*) AS BIGINT) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def json_documents(s, d):
    """A document a region with its nations, written and read again."""
    n = table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))).alias("nations"))
    r = table(s, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), "nations")
    path = _folder(s, "json")
    sinks.write_json(r, path, ["id"])
    return s.read.json(path).select(F.col("id").cast("int").alias("id"), "name", F.size("nations").cast("long").alias("nations"))


def workbook(rows: list[list], sheet: str) -> bytes:
    """A workbook with one sheet of text and numbers, as small as the format allows; None leaves a gap."""
    shared: dict[str, int] = {}
    lines = []
    for i, row in enumerate(rows, 1):
        cells = []
        for j, v in enumerate(row):
            at = f"{chr(65 + j)}{i}"
            if isinstance(v, str):
                cells.append(f'<c r="{at}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
        lines.append(f'<row r="{i}">{"".join(cells)}</row>')
    main, link = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="worksheet" Target="worksheets/one.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si><t>{escape(v)}</t></si>" for v in shared)}</sst>')
        book.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def _nations(s, d) -> list:
    """The 25 nations, a table of a fixed size."""
    return table(s, d, "nation").orderBy("n_nationkey").limit(25).collect()


def _books(s, content: bytes):
    return s.createDataFrame([("nations.xlsx", bytearray(content))], "path string, content binary")


@query("SELECT CAST(n_nationkey + 1 AS INT) AS row, CAST(n_nationkey AS VARCHAR) AS first, n_name AS second, CASE WHEN n_regionkey <> 2 THEN CAST(n_regionkey AS VARCHAR) END AS third FROM nation UNION ALL SELECT 0, 'id', 'name', 'region'")
def xlsx_sheet(s, d):
    """The rows of a sheet of nations, with gaps."""
    book = workbook([["id", "name", "region"], *[[r[0], r[1], r[2] if r[2] != 2 else None] for r in _nations(s, d)]], "nations")
    rows = xlsx.sheet_rows(_books(s, book), "nations")
    return rows.select("row", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(("first", "second", "third"))])


@query("SELECT n_name AS name, CASE WHEN n_regionkey <> 2 THEN CAST(n_regionkey AS VARCHAR) ELSE '' END AS region, '' AS absent FROM nation")
def xlsx_by_header(s, d):
    """Columns by the header's names; cells and columns that aren't there are empty."""
    book = workbook([["id", "name", "region"], *[[r[0], r[1], r[2] if r[2] != 2 else None] for r in _nations(s, d)]], "nations")
    return xlsx.with_header(xlsx.sheet_rows(_books(s, book)), ["name", "region", "absent"], "").select("name", "region", "absent")


@query("SELECT CAST(n_regionkey AS BIGINT) AS territory_id, arg_max(n_name, n_nationkey) AS name, CAST(1990 + max(n_nationkey) AS DOUBLE) AS year_from, CAST(2000 AS DOUBLE) AS year_to, (1990 + max(n_nationkey)) <= 2000 AS active FROM nation WHERE 1990 + n_nationkey <= 2012 GROUP BY n_regionkey")
def xlsx_dictionary(s, d):
    """The last version of each region that began by 2012, from a sheet of versions."""
    book = workbook([["territory_id", "name", "year_from", "year_to"], ["", "no id", 1990, 2000], *[[r[2], r[1], 1990 + r[0], 2000] for r in _nations(s, d)]], "Sheet1")
    rows = xlsx.with_header(xlsx.sheet_rows(_books(s, book), "Sheet1"), ["territory_id", "name", "year_from", "year_to"])
    got = xlsx.dictionary(rows, "territory_id", ["territory_id", "year_from", "year_to"], 2012)
    return got.withColumn("active", F.col("year_from") <= 2000).select("territory_id", "name", "year_from", "year_to", "active")


@query("SELECT lpad('79701' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0'), 8, '0') AS code, y.year, CAST(n_regionkey * 10 AS DOUBLE) AS value FROM nation, (VALUES (2023), (2024)) y(year) WHERE n_nationkey < 20")
def income_reader(s, d):
    """Two sheets of one year each: rows whose first cell is a number, by their codes."""
    lines = [[r[0], r[1], f"79-701-{r[0]:03d}-000" if r[0] < 20 else None, r[2] * 10] for r in _nations(s, d)]
    books = {y: _books(s, workbook([["table of", y], ["n", "name", "code", "value"], *lines], str(y))) for y in (2023, 2024)}
    return xlsx.income_rows({y: xlsx.sheet_rows(b, str(y)) for y, b in books.items()})


def _database(s, d) -> bytes:
    with sqlite3.connect(":memory:") as db:
        db.execute("CREATE TABLE districts (fid INTEGER PRIMARY KEY, territory_id INTEGER, name TEXT, year_from INTEGER, year_to INTEGER)")
        db.execute("CREATE VIRTUAL TABLE rtree_districts_geom USING rtree(id, minx, maxx, miny, maxy)")
        for r in _nations(s, d):
            db.execute("INSERT INTO districts VALUES (?, ?, ?, ?, ?)", (r[0] + 1, r[0], r[1] if r[2] != 2 else None, 2000 + r[2], 2020 + r[2]))
            db.execute("INSERT INTO rtree_districts_geom VALUES (?, ?, ?, ?, ?)", (r[0] + 1, r[0], r[0] + 2, 50, 54))
        db.commit()
        return db.serialize()


def _files(s, d):
    return s.createDataFrame([("districts.gpkg", bytearray(_database(s, d)))], "path string, content binary")


@query("SELECT CAST(n_nationkey AS BIGINT) AS territory_id, CASE WHEN n_regionkey <> 2 THEN n_name END AS name FROM nation WHERE 2020 + n_regionkey > 2021")
def sqlite_scan(s, d):
    """The nations of a database of versions that end after 2021."""
    return sqlite.database_rows(_files(s, d), "SELECT territory_id, name FROM districts WHERE year_to > 2021", "territory_id long, name string")


@query("SELECT CAST(n_nationkey AS BIGINT) AS territory_id, CAST(n_nationkey + 1 AS DOUBLE) AS lon, CAST(52 AS DOUBLE) AS lat FROM nation WHERE 2000 + n_regionkey <= 2002")
def sqlite_centres(s, d):
    """The middles of the boxes in the R-tree of versions valid in 2002."""
    return sqlite.database_rows(_files(s, d), sqlite.centres_query("districts", at=2002), "territory_id long, year_from int, lon double, lat double").drop("year_from")


@query("SELECT CAST(c_custkey // 500 AS BIGINT) AS part, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS length, sha256(string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS sha256 FROM customer GROUP BY 1")
def file_manifest(s, d):
    """Lengths and checksums of files of customers' names, 500 keys a file, read in pieces."""
    path = _folder(s, "names")
    rows = table(s, d, "customer").select(F.floor(F.col("c_custkey") / 500).alias("part"), "c_custkey", "c_name")
    # a file a part: the order by key within a task holds within each part
    rows.repartition("part").sortWithinPartitions("part", "c_custkey").select("part", F.col("c_name").alias("value")).write.partitionBy("part").text(path)
    got = sinks.manifest(s, [path + "/part=*/*.txt"], 4096)
    return got.select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part"), "length", "sha256")


@query("SELECT r_name AS name, CAST(count(*) AS VARCHAR) AS value FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT c_mktsegment, CAST(max(c_custkey) AS VARCHAR) FROM customer GROUP BY 1")
def audit_report(s, d):
    """A report of two tables, written as Markdown and read back: customers by region, the last customer of each segment."""
    c, n, r = table(s, d, "customer"), table(s, d, "nation"), table(s, d, "region")
    home = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    regions = home.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("customers")).orderBy("region")
    segments = c.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.max("c_custkey").alias("last")).orderBy("segment")
    path = _folder(s, "report")
    sinks.write_report(s, path, "Customers", {"Regions": regions, "Segments": segments})
    return sinks.report_rows(s, path, 2).select(F.col("c0").alias("name"), F.col("c1").alias("value"))


# scalars --------------------------------------------------------------------------------------


@query("SELECT c_custkey, round_even(c_custkey / 2.0, 0) AS even, printf('%.1f%%', c_custkey / 7.0) AS share, least(greatest((c_acctbal - 1000) / 4000, 0.0), 1.0) AS place, round(ln(1 + c_custkey), 9) AS log1p, CAST(pow(10, floor(log10(c_custkey + 1))) AS DOUBLE) AS low, CAST(pow(10, ceil(log10(c_custkey + 1))) AS DOUBLE) AS high FROM customer")
def number_functions(s, d):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    low, high = scalars.log10_bounds(k + 1, k + 1)
    return table(s, d, "customer").select(k, scalars.half_even(k / 2).alias("even"), scalars.percent(k / 700).alias("share"), scalars.clamp(b, 1000, 5000).alias("place"), F.round(F.log1p(k), 9).alias("log1p"), low.alias("low"), high.alias("high"))


_MONTH = "(year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1"


@query(f"SELECT o_orderkey, CAST({_MONTH} AS INT) AS place, strftime(o_orderdate, '%Y-%m') AS label FROM orders")
def month_functions(s, d):
    place = scalars.month_index(F.date_format("o_orderdate", "yyyy-MM"), 1992)
    return table(s, d, "orders").select("o_orderkey", place.alias("place"), scalars.month_label(place, 1992).alias("label"))


@query("SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, CASE WHEN c_custkey % 3 = 0 THEN substr(lpad(CAST(c_custkey AS VARCHAR), 10, '0'), 1, 8) END AS prefix, CASE WHEN length(c_name) > 12 THEN substr(c_name, 1, 11) || '…' ELSE c_name END AS short FROM customer")
def text_functions(s, d):
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, F.concat(F.substring(F.lpad(k.cast("string"), 10, "0"), 1, 5), F.lit("  "), F.substring(F.lpad(k.cast("string"), 10, "0"), 6, 5))).when(k % 3 == 1, k.cast("string"))
    return table(s, d, "customer").select(k, scalars.digits_only(F.col("c_name")).alias("digits"), scalars.prefix_key(code).alias("prefix"), scalars.shortened(F.col("c_name"), 12).alias("short"))


_LON = "CAST(s_suppkey % 360 - 180 AS DOUBLE)"
_LAT = "CASE WHEN s_suppkey % 5 > 0 THEN CAST(41 + s_suppkey % 41 AS DOUBLE) ELSE (50.0 + 52.0) / 2 END"


@query(f"SELECT s_suppkey, round(35 + ((CASE WHEN {_LON} < 0 THEN {_LON} + 360 ELSE {_LON} END) - 19) / 171 * 930, 6) AS x, round(28 + (82 - ({_LAT})) / 41 * 360, 6) AS y FROM supplier")
def map_projection(s, d):
    k = F.col("s_suppkey")
    lat = scalars.centre(F.when(k % 5 > 0, (41 + k % 41).cast("double")), F.lit(50.0), F.lit(52.0))
    x, y = scalars.projected((k % 360 - 180).cast("double"), lat)
    return rounded(table(s, d, "supplier").select("s_suppkey", x.alias("x"), y.alias("y")))


_LABELS = "x AS (SELECT c_custkey, c_mktsegment AS name, n_name AS region, c_name AS fullname FROM customer JOIN nation ON n_nationkey = c_nationkey), l AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY name, region) > 1 THEN name || ', ' || region || ', ' || fullname ELSE name || ', ' || region END AS search_label FROM x)"


def labelled_customers(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return scalars.labels(c.select("c_custkey", F.col("c_mktsegment").alias("name"), F.col("n_name").alias("region"), F.col("c_name").alias("fullname")), "name", "region", "fullname")


@query(f"WITH {_LABELS} SELECT c_custkey, search_label FROM l")
def search_labels(s, d):
    return labelled_customers(s, d).select("c_custkey", "search_label")


@query(f"WITH {_LABELS} SELECT c_custkey, search_label, lower(search_label) = 'mach' AS exact FROM l WHERE contains(lower(name), 'mach') OR contains(lower(region), 'mach')")
def text_search(s, d):
    return scalars.search(labelled_customers(s, d), " MACH ", "c_custkey", "name", "region").select("c_custkey", "search_label", "exact")


@query("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7) UNION SELECT c_custkey, round(c_acctbal, 2) FROM customer WHERE c_custkey = 5")
def top_and_selected(s, d):
    c = table(s, d, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))
    return panel.top_and_selected(c, "c_custkey", "c_acctbal", 7, 5)


@query("SELECT DISTINCT * FROM (SELECT o_orderstatus, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS p FROM orders GROUP BY 1)".replace("list(DISTINCT o_orderpriority ORDER BY o_orderpriority)", "array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',')"))
def alias_sets(s, d):
    """The distinct normalised names of each status, in order."""
    o = table(s, d, "orders").groupBy("o_orderstatus").agg(F.array_distinct(F.array_sort(F.collect_set("o_orderpriority"))).alias("p"))
    return o.select("o_orderstatus", F.array_join("p", ",").alias("p"))
