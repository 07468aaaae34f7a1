import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.snapshots import Versions
from tallyframe.sources import readers, sinks
from tallyframe.streaming.staged import keep_latest, staged_stream


def test_csv_rejects(spark, tmp_path):
    lines = ["a,b,c"] + [f"{k},x,\"q, {k}\"" for k in range(20)] + ["1,2", "1,2,3,4,5", "1"]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    raw = readers.read_csv(spark, str(tmp_path / "f.csv"), ["a", "b", "c"]).cache()
    assert readers.good_rows(raw).count() == 20 and readers.rejected_rows(raw).first().rejected == 3


def test_csv_after_preamble(spark, tmp_path):
    (tmp_path / "f.csv").write_text('one\ntwo\nthree\nfour\nid,name\n1,"two\nlines"\n,none\n2,b\n')
    rows = readers.read_csv_after(spark, str(tmp_path / "f.csv"), ["id", "name"], 4, "id").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "two\nlines"), ("2", "b")]


def test_one_month():
    assert readers.one_month(["x-2024-05-01-part1_2.csv", "x-2024-05-01-part2_2.csv"]) == "2024-05-01"
    with pytest.raises(ValueError):
        readers.one_month(["x-2024-05-01.csv", "x-2024-06-01.csv"])


def test_torn_tail(spark, tmp_path):
    good = '{"entity_type":"p","entity_id":"1","http_status":200,"raw_json":"{}"}'
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.json").write_text(good + "\n" + good + "\n" + good[:30])
    assert readers.repaired(spark, str(tmp_path / "a")).count() == 2
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.json").write_text(good + "\n" + good[:30] + "\n" + good + "\n")
    with pytest.raises(ValueError):
        readers.repaired(spark, str(tmp_path / "b"))


def test_sheets(spark, tmp_path):
    ods = "<office:document-content xmlns:office='urn:oasis:names:tc:opendocument:xmlns:office:1.0' xmlns:table='urn:oasis:names:tc:opendocument:xmlns:table:1.0' xmlns:text='urn:oasis:names:tc:opendocument:xmlns:text:1.0'><table:table table:name='S'>" + "".join(
        "<table:table-row>" + "".join(f"<table:table-cell><text:p>{v}</text:p></table:table-cell>" for v in row) + "</table:table-row>" for row in (("id", "v"), ("1", "NA"))
    ) + "</table:table></office:document-content>"
    with zipfile.ZipFile(tmp_path / "f.ods", "w") as z:
        z.writestr("content.xml", ods)
    assert [tuple(r) for r in readers.read_sheet(spark, str(tmp_path / "f.ods"), ["id", "v", "w"], "S").collect()] == [("1", "NA", None)]
    xlsx = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>id</t></is></c></row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "f.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", xlsx)
    assert [tuple(r) for r in readers.read_sheet(spark, str(tmp_path / "f.xlsx"), ["id"]).collect()] == [("7",)]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("other/a.html", "no")
        z.writestr("accounts/a.xhtml", "yes")
    row = readers.zip_members(spark.read.format("binaryFile").load(str(tmp_path / "f.zip"))).first()
    assert row.member == "accounts/a.xhtml" and bytes(row.content) == b"yes"


def test_bands(spark):
    head = "min_employees,max_employees,low_gbp,high_gbp,midpoint_gbp\n"
    assert readers.bands_frame(spark, head + "1,4,1,2,1.5\n5,,2,3,2.5\n").count() == 2
    for bad in ("", "x,4,1,2,1\n", "4,1,1,2,1\n", "1,4,-1,2,1\n", "1,4,1,2,1\n3,9,1,2,1\n", "1,4,3,2,1\n"):
        with pytest.raises(ValueError):
            readers.parse_bands(head + bad)
    with pytest.raises(ValueError):
        readers.parse_bands("a,b\n1,2\n")


def test_number_columns():
    valid = lambda v: str(v).isdigit()
    assert readers.number_column([["Name", "Company Number"], ["x", "1"]], valid) == (1, 1)
    assert readers.number_column([["x", "1"], ["y", "2"], ["z", "q"]], valid) == (1, 0)
    assert readers.number_column([["x", "y"]], valid) is None


def test_migration_and_catalog(spark):
    df = readers.with_columns(spark.range(1), "id long, extra string")
    assert df.columns == ["id", "extra"] and readers.table_or_empty(spark, "no_such_table", "a int").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b,\"q\""), (1, "a\nb")], "id int, v string")
    assert sinks.write_csv(df, str(tmp_path / "csv"), [F.col("id")]) == 2
    assert sinks.write_bundle({"t": df}, str(tmp_path / "bundle")) == {"t": 2}
    bundle = sinks.read_bundle(spark, str(tmp_path / "bundle"))
    current = {"t": spark.createDataFrame([(1, "old"), (9, "stay")], "id int, v string")}
    merged = sinks.import_bundle(current, bundle, {"t": ["id"]})["t"]
    assert {r.id: r.v for r in merged.collect()} == {1: "a\nb", 2: 'b,"q"', 9: "stay"}
    assert sinks.import_bundle(current, bundle, {"t": ["id"]}, replace=True)["t"].count() == 2
    assert sinks.write_sqlite(df, str(tmp_path / "f.db"), "t") == 2
    with sqlite3.connect(tmp_path / "f.db") as con:
        assert con.execute("SELECT v FROM t WHERE id = 1").fetchone() == ("a\nb",)


def test_staged_stream_keeps_latest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = '{"entity_type":"p","entity_id":"%s","fetched_at":"2024-01-0%d 00:00:00","http_status":200,"raw_json":"%s"}\n'
    table, where = Versions(str(tmp_path / "table")), str(tmp_path / "in")
    (tmp_path / "in/a.json").write_text(row % ("1", 1, "x") + row % ("2", 1, "y") + row % ("1", 1, "x"))
    keep_latest(staged_stream(spark, where), table, ["entity_type", "entity_id"], "fetched_at", "raw_json", str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/b.json").write_text(row % ("1", 2, "new"))
    keep_latest(staged_stream(spark, where), table, ["entity_type", "entity_id"], "fetched_at", "raw_json", str(tmp_path / "cp")).awaitTermination()
    assert {r.entity_id: r.raw_json for r in table.current(spark).collect()} == {"1": "new", "2": "y"}
