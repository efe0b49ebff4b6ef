"""Sources, sinks, scalars and contracts."""

import hashlib
import io
import json
import math
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline import sinks
from weftline.functions import scalars
from weftline.operators import contracts
from weftline.plans.registers import workbook
from weftline.sources import files, sqlite, xlsx


def books(spark, content):
    return spark.createDataFrame([("b.xlsx", bytearray(content))], "path string, content binary")


def test_workbook_from_a_file(spark, tmp_path):
    path = tmp_path / "one.xlsx"
    path.write_bytes(workbook([["id", "x & y"], [1, None, 2.5], [], ["<t>", 3]], "A & B"))
    rows = {r["row"]: r["cells"] for r in xlsx.read_sheet(spark, str(path), "A & B").collect()}
    assert rows == {0: ["id", "x & y"], 1: ["1", None, "2.5"], 2: [], 3: ["<t>", "3"]}
    assert {r["cells"][0] if r["cells"] else None for r in xlsx.read_sheet(spark, str(path)).collect()} == {"id", "1", None, "<t>"}
    with pytest.raises(Exception, match="no sheet"):
        xlsx.read_sheet(spark, str(path), "C").collect()


def test_inline_strings_and_absolute_targets(spark):
    main, link = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets><sheet name="s" sheetId="1" r:id="r9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r9" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="B1" t="inlineStr"><is><r><t>a</t></r><r><t> b</t></r></is></c><c r="AA1"><v>7</v></c></row></sheetData></worksheet>')
    cells = xlsx.sheet_rows(books(spark, out.getvalue())).first()["cells"]
    assert len(cells) == 27 and cells[1] == "a b" and cells[26] == "7" and cells[0] is None


def test_income_refuses_repeated_codes(spark):
    rows = xlsx.sheet_rows(books(spark, workbook([["n"], [1, "a", "79-701-001-000", 5], [2, "b", "79701001", 6]], "s")))
    with pytest.raises(Exception, match="repeated code"):
        xlsx.income_rows({2023: rows}).collect()


def test_database_from_a_file(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER, name TEXT, v REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(1, "a", 1.5), (2, None, None), (3, "c", 2.0)])
    got = sqlite.read_table(spark, path, "t", "id long, name string, v double", "id < 3").collect()
    assert sorted((r["id"], r["name"], r["v"]) for r in got) == [(1, "a", 1.5), (2, None, None)]
    assert sqlite.read_table(spark, path, "t", "id long", "id > 9").count() == 0


def test_csv_both_ways(spark, tmp_path):
    df = spark.createDataFrame([(2, 'q"t, x', 0.1234567, None), (1, "line\nbreak", None, "é")], "id int, s string, v double, n string")
    path = str(tmp_path / "c")
    sinks.write_csv(df, path, ["id"], digits=6, one_file=True)
    text = [tuple(r) for r in files.read_csv_text(spark, path).collect()]
    assert text == [("1", "line\nbreak", "", "é"), ("2", 'q"t, x', "0.123457", "")]
    typed = files.read_csv(spark, path)
    assert dict(typed.dtypes)["v"] == "double" and dict(typed.dtypes)["id"] == "int"
    assert files.read_csv(spark, path, "id long, s string, v double, n string").count() == 2
    with pytest.raises(FileNotFoundError, match="nowhere"):
        files.required(spark, [path, str(tmp_path / "nowhere")])


def test_json_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, [(1.5, None)], None), (2, [], "x")], "id int, a array<struct<v:double,w:string>>, s string")
    path = str(tmp_path / "j")
    sinks.write_json(df, path, ["id"])
    lines = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert sorted(lines, key=lambda x: x["id"]) == [{"id": 1, "a": [{"v": 1.5, "w": None}], "s": None}, {"id": 2, "a": [], "s": "x"}]
    assert files.read_json(spark, path, "id int, s string").count() >= 1
    for bad in (math.nan, math.inf):
        with pytest.raises(Exception, match="no NaN"):
            sinks.documents(spark.createDataFrame([([(bad,)],)], "a array<struct<v:double>>")).collect()


def test_markdown_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1, 2.5), (None, 10, None)], "name string, n int, v double")
    assert sinks.markdown_table(df).split("\n") == ["| name |   n |   v |", "| ---- | --: | --: |", "| a\\|b |   1 | 2.5 |", "|      |  10 |     |"]
    with pytest.raises(ValueError, match="at most"):
        sinks.markdown_table(spark.range(5), 3)
    (tmp_path / "f.bin").write_bytes(b"abc" * 1000)
    r = sinks.manifest(spark, [str(tmp_path / "f.bin")]).first()
    assert (r["file"], r["length"], r["sha256"]) == ("f.bin", 3000, hashlib.sha256(b"abc" * 1000).hexdigest())


def test_manifest_reads_in_pieces(spark, tmp_path):
    """Files of no piece, of whole ones and of a part of one, with odd names; what looks compressed is digested as it is; a file over Spark's limit on a cell isn't held."""
    sizes = {"empty": 0, "one": 64, "two.gz": 128, "a b%20c": 129, "é": 63}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(bytes(range(n)))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)
    try:
        got = {r["file"]: (r["length"], r["sha256"]) for r in sinks.manifest(spark, [str(tmp_path)], 64).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {name: (n, hashlib.sha256(bytes(range(n))).hexdigest()) for name, n in sizes.items()}


def test_contracts(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(1, 5), (1, 6)], "k long, w int")
    assert contracts.many_to_one(b, a, ["k"]).count() == 2 and contracts.same_keys(a, a.select("k"), ["k"]).count() == 2
    for broken in (lambda: contracts.many_to_one(a, b, ["k"]), lambda: contracts.one_to_one(b, a, ["k"]), lambda: contracts.same_keys(a, b, ["k"]), lambda: contracts.complete(b, ["k"], rows=1), lambda: contracts.complete(a, ["k"], groups=3), lambda: contracts.holds(a, F.col("k") > 1, "small")):
        with pytest.raises(ValueError, match=r"\w"):
            broken()


def test_scalars(spark):
    one = spark.range(1)
    f = lambda *c: tuple(one.select(*c).first())
    assert f(scalars.half_even(F.lit(2.5)), scalars.half_even(F.lit(3.5)), scalars.half_even(F.lit(0.125), 2)) == (2.0, 4.0, 0.12)
    assert f(scalars.month_index(F.lit("2024-03"), 2023), scalars.month_label(F.lit(14), 2023), scalars.month_label(F.lit(11), 2023)) == (14, "2024-03", "2023-12")
    assert f(scalars.percent(F.lit(0.1234)), scalars.shortened(F.lit("abcdef"), 4), scalars.prefix_key(F.lit("12 345 678 90"))) == ("12.3%", "abc…", "12345678")
    assert f(scalars.clamp(F.lit(5.0), 0, 4), scalars.finite(F.lit(math.nan)), scalars.finite(F.lit(None).cast("double")), scalars.finite(F.lit(1))) == (1.0, False, False, True)
    x, y = scalars.projected(F.lit(-170.0), F.lit(82.0))
    assert f(x, y) == (pytest.approx(35 + (190 - 19) / 171 * 930), 28.0)


def test_report(spark, tmp_path):
    a = spark.createDataFrame([("x|y", 1), ("z", 20)], "name string, n int")
    path = str(tmp_path / "report")
    sinks.write_report(spark, path, "All", {"One": a, "Two": a.limit(0)})
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    assert text.startswith("# All\n\n## One\n\n| name ") and "## Two" in text
    assert {tuple(r) for r in sinks.report_rows(spark, path, 2).collect()} == {("x\\|y", "1"), ("z", "20")}
