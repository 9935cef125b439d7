"""Workbooks made by hand, with shared texts, gaps, runs, errors and several sheets."""

from __future__ import annotations

import datetime as dt
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from gridlake.sources.tables import read_csv
from gridlake.sources.xlsx import read_xlsx, write_xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets: dict[str, str], shared: str = "", properties: str = ""):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        out.writestr("xl/workbook.xml", f"<workbook {MAIN} {REL}>{properties}<sheets>{listed}</sheets></workbook>")
        related = "".join(f'<Relationship Id="rId{i}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        out.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{related}</Relationships>")
        for i, body in enumerate(sheets.values(), 1):
            out.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
        if shared:
            out.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{shared}</sst>")
    return str(path)


SHARED = "<si><t>bus_id</t></si><si><r><t>name</t></r><r><t>_geo</t></r><rPh><t>x</t></rPh></si><si><t>lat</t></si><si><t>Ñandú, 1</t></si>"
FIRST = """<row/><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="s"><v>2</v></c><c r="AA2" t="inlineStr"><is><t>lon</t></is></c></row>
<row r="3"><c r="A3"><v>11</v></c><c r="B3" t="s"><v>3</v></c><c r="D3"><v>-34.25</v></c><c r="AA3"><v>-5.8E1</v></c></row>
<row r="4"><c r="A4" t="str"><v>12</v></c><c r="D4" t="e"><v>#N/A</v></c><c r="AA4" t="str"><v>west</v></c></row>
<row r="5"><c r="A5"><v>13.5</v></c><c r="B5"><v>7</v></c><c r="C5"><v>1</v></c></row>"""
SECOND = '<row><c t="str"><v>bus_id</v></c><c t="str"><v>day</v></c><c t="str"><v>on</v></c></row><row><c><v>21</v></c><c><v>45292.5</v></c><c t="b"><v>1</v></c></row>'


def test_cells(spark, tmp_path):
    path = workbook(tmp_path / "a.xlsx", {"Uno": FIRST, "Dos": SECOND}, SHARED)
    schema = "bus_id long, name_geo string, lat double, lon double, other string"
    rows = read_xlsx(spark, path, schema)
    assert [tuple(r) for r in rows.collect()] == [(11, "Ñandú, 1", -34.25, -58.0, None), (12, None, None, None, None), (None, "7", None, None, None)]
    text = read_xlsx(spark, path)
    assert text.columns == ["bus_id", "name_geo", "lat", "lon"] and [r.bus_id for r in text.collect()] == ["11", "12", "13.5"]
    both = read_xlsx(spark, path, "bus_id double, on boolean, day timestamp", "*")
    assert both.rdd.getNumPartitions() == 2
    last = [r for r in both.collect() if r.bus_id == 21]
    assert last[0].on is True and last[0].day == dt.datetime(2024, 1, 1, 12)
    late = workbook(tmp_path / "b.xlsx", {"S": SECOND}, "", '<workbookPr date1904="1"/>')
    assert read_xlsx(spark, late, "day date").first().day == dt.date(2028, 1, 2)


def test_same_as_csv(spark, tmp_path):
    rows = [(i, f"N {i}" if i % 3 else None, i / 8 if i % 4 else None, -i / 4) for i in range(500)]
    schema = "bus_id long, name string, lat double, lon double"
    df = spark.createDataFrame(rows, schema).repartition(3)
    df.write.csv(str(tmp_path / "csv"), header=True)
    write_xlsx(df, str(tmp_path / "xlsx"))
    assert sorted(os.listdir(tmp_path)) == ["csv", "xlsx"] and len(os.listdir(tmp_path / "xlsx")) == 3
    got = read_xlsx(spark, str(tmp_path / "xlsx"), schema)
    assert sorted(got.collect()) == sorted(read_csv(spark, str(tmp_path / "csv"), schema).collect())


def test_broken_files_are_named(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"PK nothing")
    for path, what in ((tmp_path / "bad.xlsx", "bad.xlsx is no workbook"), (tmp_path / "gone.xlsx", "gone.xlsx")):
        with pytest.raises(Exception, match=what):
            read_xlsx(spark, str(path), "bus_id long").collect()
    cut = workbook(tmp_path / "cut.xlsx", {"S": "<row><c><v>1</v></c></row><row><c>"})
    with pytest.raises(Exception, match="sheet S of .*cut.xlsx is broken"):
        read_xlsx(spark, cut, "`1` long").collect()
    with pytest.raises(Exception, match="has no sheet T"):
        read_xlsx(spark, cut, "`1` long", "T").collect()


def test_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(100).repartition(4).select(F.when(F.col("id") == 55, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        write_xlsx(df, str(tmp_path / "x"))
    assert os.listdir(tmp_path) == []
