"""Object selection: sources, both modes, and the rules of the compatible one."""

from __future__ import annotations

import pytest

from quern.plans.select import CsvInput, JsonInput, Parser, ScanRange, SelectRequest, compat, select, write_csv, write_json

RIVERS = "river,km,mouth\nOder,840,Baltic\nEms,362,North Sea\nInn,518,Danube\nSpree,400,Havel\n"


@pytest.fixture()
def csv(tmp_path):
    p = tmp_path / "rivers.csv"
    p.write_text(RIVERS)
    return str(p)


@pytest.fixture()
def lines(tmp_path):
    p = tmp_path / "rivers.json"
    p.write_text('{"river":"Oder","km":840}\n\n{"river":"Ems","km":362}\n{"river":"Inn","km":518}\n')
    return str(p)


@pytest.mark.parametrize("mode", ["strict", "compat"])
def test_csv(spark, csv, mode):
    r = SelectRequest("SELECT mouth, river FROM s3object WHERE km < 500", CsvInput("USE"), mode)
    assert [tuple(x) for x in select(spark, csv, r).collect()] == [("North Sea", "Ems"), ("Havel", "Spree")]


def test_csv_headers(spark, csv):
    none = select(spark, csv, SelectRequest("SELECT _1 FROM s3object", CsvInput("NONE"), "compat")).collect()
    skip = select(spark, csv, SelectRequest("SELECT _1 FROM s3object WHERE _2 >= 518", CsvInput("IGNORE"), "compat")).collect()
    assert [x[0] for x in none] == ["river", "Oder", "Ems", "Inn", "Spree"]
    assert [x[0] for x in skip] == ["Oder", "Inn"]


@pytest.mark.parametrize("mode", ["strict", "compat"])
def test_json_lines(spark, lines, mode):
    r = SelectRequest("SELECT * FROM s3object WHERE km < 600", JsonInput(), mode)
    assert sorted(x["river"] for x in select(spark, lines, r).collect()) == ["Ems", "Inn"]


def test_json_document(spark, tmp_path):
    p = tmp_path / "doc.json"
    p.write_text('[{"a": 1}, {"a": 2}, 7]')
    got = select(spark, str(p), SelectRequest("SELECT * FROM s3object", JsonInput("DOCUMENT"), "compat")).collect()
    assert sorted((x["a"], x["_1"]) for x in got if x["a"]) == [(1, None), (2, None)] and [x["_1"] for x in got if x["a"] is None] == ["7"]


def test_limit_keeps_file_order(spark, csv):
    r = SelectRequest("SELECT river FROM s3object LIMIT 3", CsvInput("USE"), "compat")
    assert [x[0] for x in select(spark, csv, r).collect()] == ["Oder", "Ems", "Inn"]


def test_scan_range(spark, csv):
    r = SelectRequest("SELECT _1 FROM s3object", CsvInput("NONE"), "compat", ScanRange(15, 31))
    assert [x[0] for x in select(spark, csv, r).collect()] == ["Oder"]
    r.scan_range = ScanRange(9, 3)
    assert select(spark, csv, r).collect() == []


@pytest.mark.parametrize(
    ("where", "kept"),
    [
        ("x = NULL", [1]),  # null equals null
        ("x <> 1", [1, 3]),
        ("x = '2'", []),  # kinds differ
        ("x <> '2'", [1, 2, 3]),
        ("y < 1", []),  # text and number have no order
        ("missing = 1", []),
        ("missing <> 1", []),
        ("missing = 1 OR TRUE", []),
        ("x IS NULL", [1]),
        ("missing IS NULL", [1, 2, 3]),
        ("x IS NOT NULL", [2, 3]),
        ("x NOT IN (1, NULL)", [3]),
        ("x IN (NULL, 2)", [1, 3]),
        ("x NOT BETWEEN 2 AND 9", [1, 2]),
        ("x / 0 IS NULL", [1, 2, 3]),
        ("x + 1 = 3", [3]),
        ("x % 2 = 0", [3]),
        ("y LIKE 'a.b'", [1, 2]),  # a live dot
        ("y LIKE 'a_'", []),
        ("y LIKE 'a%b'", [1, 2]),
        ("y NOT LIKE 'a%'", [3]),
        ("x NOT LIKE 'a%'", []),  # no text
        ("y || 'z' = 'axbz'", [1]),
        ("(x = 1 AND y = 'a.b') OR y = 'c'", [2, 3]),
    ],
)
def test_rules(spark, where, kept):
    df = spark.createDataFrame([(1, None, "axb"), (2, 1, "a.b"), (3, 2, "c")], "id int, x int, y string")
    assert [r[0] for r in compat(df, f"SELECT id FROM s3object WHERE {where}").orderBy("id").collect()] == kept


def test_cells_are_typed_one_by_one(spark, tmp_path):
    p = tmp_path / "cells.csv"
    p.write_text("1,30\n2,\n3,1.5\n4,TRUE\n5,abc\n6,NaN\n7, 8\n")
    def ids(where):
        r = SelectRequest(f"SELECT _1 FROM s3object WHERE {where}", CsvInput("NONE"), "compat")
        return [x[0] for x in select(spark, str(p), r).collect()]

    assert ids("_2 > 1") == ["1", "3"]
    assert ids("_2 IS NULL") == ["2"]
    assert ids("_2 = TRUE") == ["4"]
    assert ids("_2 = 'NaN'") == ["6"]


@pytest.mark.parametrize("sql", ["DELETE FROM x", "SELECT a FROM s3object GROUP BY a", "SELECT a FROM s3object ORDER BY a", "SELECT a FROM s3object JOIN t", "SELECT # FROM s3object"])
def test_other_statements_are_errors(sql):
    with pytest.raises(ValueError):
        Parser(sql).statement()


def test_request_form():
    r = SelectRequest.parse({"Expression": "SELECT * FROM s3object", "ExpressionType": "SQL", "InputSerialization": {"CSV": {"FileHeaderInfo": "USE", "FieldDelimiter": ";x"}}, "ScanRange": {"Start": 1, "End": 5}})
    assert r.input == CsvInput("USE", ";") and r.scan_range == ScanRange(1, 5)
    with pytest.raises(ValueError):
        SelectRequest.parse({"Expression": "x", "ExpressionType": "XQuery", "InputSerialization": {"CSV": {}}})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", None), ('q"', 2)], "x string, y int").coalesce(1)
    write_csv(df, str(tmp_path / "csv"))
    write_json(df, str(tmp_path / "json"))
    assert spark.read.csv(str(tmp_path / "csv"), escape="\\").count() == 2
    assert sorted(r["x"] for r in spark.read.json(str(tmp_path / "json")).collect()) == ["a,b", 'q"']
