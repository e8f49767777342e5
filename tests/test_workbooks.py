"""Excel workbooks: what other programs write, and round trips."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ticketloom.sources import tickets, workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
ODD = ["", " lead and trail ", "a<b>&\"c'", "_x0041_", "_x005F_x", "tab\tnew\nline\r\n", "\x00\x0b\x1f", "😀é中", "=1+1", "007", "1e5", "x" * 40_000, "]]>", "￾"]


def foreign(sheet: str, strings: str = "", styles: str = "", book: str = "", target: str = "worksheets/first.xml") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{book}<sheets><sheet name="S" sheetId="4" r:id="rId9"/><sheet name="T" sheetId="5" r:id="rId8"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="r"><Relationship Id="rId8" Target="worksheets/other.xml"/><Relationship Id="rId9" Target="{target}"/></Relationships>')
        z.writestr("xl/worksheets/first.xml", f"<worksheet {NS}><sheetData>{sheet}</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{strings}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
    return out.getvalue()


@pytest.mark.parametrize("target", ["worksheets/first.xml", "/xl/worksheets/first.xml"])
def test_cells_of_other_programs(target):
    strings = "<si><t>id</t></si><si><r><t>ri</t></r><r><rPr/><t>ch</t></r><rPh><t>no</t></rPh></si><si><t/></si>"
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    sheet = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="AB1" t="str"><f>A1</f><v>far</v></c></row>
<row><c><v>5</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c><v>0.10000000000000001</v></c><c s="1"><v>45351.5</v></c><c s="2"><v>45351</v></c><c s="3"><v>2.5</v></c><c t="d"><v>2024-01-01</v></c><c t="s"><v>2</v></c></row>"""
    rows = list(workbooks.sheet_rows(foreign(sheet, strings, styles, target=target)))
    assert rows[0] == ["id", None, "rich", *[None] * 24, "far"]
    assert rows[1] == ["5", "True", "#N/A", "0.1", "2024-02-29T12:00:00", "2024-02-29T00:00:00", "2.5", "2024-01-01", ""]
    assert next(workbooks.sheet_rows(foreign('<row><c s="1"><v>1</v></c></row>', styles=styles, book='<workbookPr date1904="1"/>')))[0] == "1904-01-02T00:00:00"


def test_round_trip(spark):
    """Texts with what XML can't hold, missing cells, blank rows, several workbooks of different columns."""
    rows = [(str(i), t, None if i % 3 else "z") for i, t in enumerate(ODD)]
    x = spark.createDataFrame(rows, "id string, `te``x.t` string, z string").repartition(3)
    books = workbooks.workbooks_of(x, rows=2)
    assert books.count() >= 5
    other = spark.createDataFrame([("o.xlsx", workbooks.workbook(["z", "new"], [["1", "2"], [None, None], [None, "3"]])), ("empty.xlsx", workbooks.workbook([], [])), ("none", None)], "name string, content binary")
    got = workbooks.rows_of(books.unionByName(other))
    assert set(got.columns) == {"id", "te`x.t", "z", "new"}
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.id, r["te`x.t"], r.z) for r in got.where("id is not null").collect()), key=key) == sorted(rows, key=key)
    assert sorted((r.z or "", r.new) for r in got.where("id is null").collect()) == [("", "3"), ("1", "2")]
    assert workbooks.rows_of(other.where("name = 'none'")).count() == 0
    with pytest.raises(ValueError):
        workbooks.workbooks_of(x, rows=2_000_000)


def test_ticket_file(spark, tmp_path):
    path = tmp_path / "t.xlsx"
    path.write_bytes(workbooks.workbook(["issue_id", "summary", "created_at", "extra"], [["A-1", " one ", "2024-01-01T00:00:00Z", "x"], ["A-2", "nan", None, None], ["A-3", "three", None, "y"]]))
    got = {r.issue_id: r for r in tickets.load_tickets(spark, str(path), F.expr("TIMESTAMP '2024-06-01'")).collect()}
    assert set(got) == {"A-1", "A-3"} and got["A-1"].summary == "one" and got["A-3"].created_at.year == 2024 and got["A-1"].description == ""
    (tmp_path / "t.xls").write_bytes(b"")
    with pytest.raises((ImportError, ValueError)):
        tickets.load_tickets(spark, str(tmp_path / "t.xls"))
