"""Excel workbooks (.xlsx) without any library: a zip archive of XML parts, read and made in the tasks.

A workbook is one row of a table with its bytes, be it from files (Spark's binary reader, by any path) or from a column of
attachments. Its first sheet is read row by row, so what a task holds is the file, its shared strings and a batch of rows; a
workbook has a million rows at most by its format. The first row names the columns; workbooks may differ in theirs, and cells are
text: numbers as short as they are exact, dates as ISO, errors and formulas by their values, missing cells null.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_ROWS = 1_048_576
#: Built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _unescaped(text: str) -> str:
    """Characters that XML can't hold are written as _xHHHH_."""
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _string(item) -> str:
    """The text of a string item: its runs, without phonetic hints."""
    return _unescaped("".join(t.text or "" for e in item for t in ([e] if _name(e.tag) == "t" else [x for x in e if _name(x.tag) == "t"] if _name(e.tag) == "r" else [])))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if _name(e.tag) == "si":
                out.append(_string(e))
                e.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of cell styles that show dates."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for e in root.iter():
        if _name(e.tag) == "numFmt" and re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")), re.I):
            dates.add(int(e.get("numFmtId")))
    styles = next((e for e in root if _name(e.tag) == "cellXfs"), [])
    return {i for i, x in enumerate(styles) if int(x.get("numFmtId", 0)) in dates}


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """(path of the first sheet, whether days count from 1904)."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheet = next(e for e in root.iter() if _name(e.tag) == "sheet")
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(e.get("Target") for e in rels if e.get("Id") == sheet.get(_R))
    since = any(_name(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
    return (target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")), since


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _number(text: str, date: bool, since_1904: bool) -> str:
    try:
        x = float(text)
    except ValueError:
        return text
    if date:
        day = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 30) if x >= 60 else datetime.datetime(1899, 12, 31)
        return (day + datetime.timedelta(milliseconds=round(x * 86_400_000))).isoformat()
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def sheet_rows(content: bytes):
    """The cells of each row of the first sheet, as text or None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, dates = _shared(book), _date_styles(book)
        path, since = _first_sheet(book)
        with book.open(path) as f:
            for _, e in ElementTree.iterparse(f):
                if _name(e.tag) != "row":
                    continue
                cells: list[str | None] = []
                for c in e:
                    at = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    kind, value = c.get("t", "n"), next((x.text for x in c if _name(x.tag) == "v"), None)
                    if kind == "inlineStr":
                        cells[at] = next((_string(x) for x in c if _name(x.tag) == "is"), None)
                    elif value is None:
                        continue
                    elif kind == "s":
                        cells[at] = strings[int(value)]
                    elif kind == "b":
                        cells[at] = "True" if value == "1" else "False"
                    else:
                        cells[at] = _number(value, int(c.get("s", 0)) in dates, since) if kind == "n" else _unescaped(value)
                e.clear()
                yield cells


def _headers(batches):
    for b in batches:
        for content in b.column(0).to_pylist():
            first = next(sheet_rows(content), []) if content else []
            yield pa.record_batch([pa.array([c or f"Unnamed: {i}" for i, c in enumerate(first)], pa.string()), pa.array(range(len(first)), pa.int32())], ["name", "at"])


def rows_of(books: DataFrame, content: str = "content") -> DataFrame:
    """The rows of all workbooks of a column of bytes; a column for each name in a first row, ordered by place."""
    x = books.select(F.col(content).cast("binary").alias("content"))
    found = x.mapInArrow(_headers, "name string, at int").groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()  # a row for each column
    names = [r.name for r in found]
    number = {n: i for i, n in enumerate(names)}
    if not names:
        return books.sparkSession.createDataFrame([], "issue_id string")

    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = sheet_rows(content) if content else iter([])
                head = next(rows, [])
                place = [number[c or f"Unnamed: {i}"] for i, c in enumerate(head)]
                held: list[list] = [[] for _ in names]
                size = 0
                for cells in rows:
                    if not any(c is not None for c in cells):
                        continue
                    for column in held:
                        column.append(None)
                    for at, c in zip(place, cells):
                        held[at][-1] = c
                        size += len(c or "")
                    if len(held[0]) >= 5000 or size > 1 << 24:
                        yield pa.record_batch([pa.array(c, pa.string()) for c in held], names)
                        held, size = [[] for _ in names], 0
                if held[0]:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in held], names)

    return x.mapInArrow(run, ", ".join(f"`{n.replace('`', '``')}` string" for n in names))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The first sheets of the workbook(s) at a path."""
    return rows_of(spark.read.format("binaryFile").load(path).select("content"))


def _escaped(text: str) -> str:
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    text = re.sub("[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


#: The parts that a workbook of one sheet needs.
_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def workbook(names: list[str], rows) -> bytes:
    """A workbook of text cells; None is a missing cell. Longer texts than Excel shows (32,767 characters) are kept whole."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _PARTS.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for cells in [names, *rows]:
                f.write(("<row>" + "".join("<c/>" if c is None else f'<c t="inlineStr"><is><t xml:space="preserve">{_escaped(c)}</t></is></c>' for c in cells) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def workbooks_of(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """(name, content): df as workbooks of at most so many rows, made where the rows are; columns as text."""
    names = df.columns
    if rows >= MAX_ROWS:
        raise ValueError(f"a workbook has fewer than {MAX_ROWS} rows")

    def run(batches):
        held, n = [], 0
        task = TaskContext.get().partitionId()

        def done():
            return pa.record_batch([pa.array([f"{task}-{n}.xlsx"]), pa.array([workbook(names, held)], pa.binary())], ["name", "content"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                held.append(r)
                if len(held) >= rows:
                    yield done()
                    held, n = [], n + 1
        if held:
            yield done()

    quoted = [f"`{c.replace('`', '``')}`" for c in names]
    return df.select(*[F.col(q).cast("string").alias(f"c{i}") for i, q in enumerate(quoted)]).mapInArrow(run, "name string, content binary")
