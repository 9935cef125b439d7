"""``format("xlsx")``: workbooks as tables, one partition a sheet, and a folder of workbooks as a sink.

The first row of a sheet that holds anything names its columns; a schema given by the user takes columns
by name and casts their cells, otherwise all columns are text.  Cells that are missing, hold an error or
cannot be cast are null.  A sheet is streamed; a workbook's shared texts are held by the task that reads
one of its sheets.  A file that is no workbook is named in the error.

As a sink, each task writes one workbook, with a further sheet for every 1,048,575 rows, in a folder of its
own; the commit moves the workbooks to their place, and a write that fails leaves none.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from gridlake.session import ship
from gridlake.sources.stores import begin, drop, files, opened

ROWS = 10_000
MOST_ROWS = 1_048_575  # of a sheet, under its header
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _tag(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


class Workbook:
    """An opened workbook: its sheets, and the cells of one."""

    def __init__(self, path: str):
        store, inside = opened(path)
        try:
            self.zip = zipfile.ZipFile(store.open_input_file(inside))
            book = ET.fromstring(self.zip.read("xl/workbook.xml"))
            related = ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        except (zipfile.BadZipFile, pa.ArrowInvalid, KeyError, ET.ParseError) as error:
            raise ValueError(f"{path} is no workbook: {error}") from error
        self.path = path
        targets = {r.get("Id"): r.get("Target") for r in related}
        named = [(s.get("name"), targets[s.get(_RELATION)]) for s in book.iter() if _tag(s) == "sheet"]
        self.sheets = {n: t.lstrip("/") if t.startswith("/") else f"xl/{t}" for n, t in named}
        properties = next((p for p in book.iter() if _tag(p) == "workbookPr"), None)
        late = properties is not None and properties.get("date1904") in ("1", "true")
        self.epoch = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)

    def _texts(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        out = []
        with self.zip.open("xl/sharedStrings.xml") as file:
            for _, element in ET.iterparse(file):
                if _tag(element) == "si":
                    out.append(_plain(element))
                    element.clear()
        return out

    def rows(self, sheet: str) -> Iterator[dict[int, object]]:
        """Cells by column number: numbers, flags and texts."""
        texts = self._texts()
        try:
            with self.zip.open(self.sheets[sheet]) as file:
                for _, element in ET.iterparse(file):
                    if _tag(element) == "row":
                        yield _cells(element, texts)
                        element.clear()
        except (zipfile.BadZipFile, KeyError, IndexError, ET.ParseError) as error:
            raise ValueError(f"sheet {sheet} of {self.path} is broken: {error}") from error


def _plain(element: ET.Element) -> str:
    """The text of a shared or inline string, without phonetic readings."""
    parts = []
    for child in element:
        if _tag(child) == "t":
            parts.append(child.text or "")
        elif _tag(child) == "r":
            parts += [t.text or "" for t in child if _tag(t) == "t"]
    return "".join(parts)


def _number(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _cells(row: ET.Element, texts: list[str]) -> dict[int, object]:
    out, at = {}, -1
    for cell in row:
        if _tag(cell) != "c":
            continue
        at = _number(cell.get("r")) if cell.get("r") else at + 1
        kind, value = cell.get("t", "n"), None
        for child in cell:
            if _tag(child) == "v" and child.text:
                value = child.text
            elif _tag(child) == "is":
                value = _plain(child)
        if value is None or kind == "e":
            continue
        out[at] = texts[int(value)] if kind == "s" else value == "1" if kind == "b" else float(value) if kind == "n" else value
    return out


def text_of(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(int(value)) if isinstance(value, float) and value.is_integer() and abs(value) < 1e15 else str(value)


def cast(value, kind: pa.DataType, epoch: dt.datetime):
    """The cell as a value of the column's type; None if it is none."""
    if value is None:
        return None
    try:
        if pa.types.is_string(kind):
            return text_of(value)
        if pa.types.is_boolean(kind):
            return value if isinstance(value, bool) else {"true": True, "false": False, "1": True, "0": False}.get(text_of(value).strip().lower())
        if pa.types.is_date(kind) or pa.types.is_timestamp(kind):
            when = epoch + dt.timedelta(days=value) if isinstance(value, float) else dt.datetime.fromisoformat(str(value).strip())
            if pa.types.is_date(kind):
                return when.date()
            return when.replace(tzinfo=dt.timezone.utc) if kind.tz and when.tzinfo is None else when
        number = float(value)
        return number if pa.types.is_floating(kind) else int(number) if number.is_integer() else None
    except (ValueError, OverflowError):
        return None


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, schema):
        self.path, self.sheet, self.schema = path, sheet, schema

    def partitions(self) -> list[Sheet]:
        out = []
        for path, _ in files(self.path):
            names = list(Workbook(path).sheets)
            if self.sheet not in (None, "*") and self.sheet not in names:
                raise ValueError(f"{path} has no sheet {self.sheet}")
            out += [Sheet(path, n) for n in (names if self.sheet == "*" else [self.sheet or names[0]])]
        return out

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        book, at, held = Workbook(partition.path), None, []
        kinds = to_arrow_schema(self.schema)
        for cells in book.rows(partition.sheet):
            if not cells:
                continue
            if at is None:
                named = {text_of(v).strip(): i for i, v in reversed(cells.items())}
                at = [named.get(f.name, -1) for f in kinds]
                continue
            held.append([cast(cells.get(i), f.type, book.epoch) for i, f in zip(at, kinds, strict=True)])
            if len(held) == ROWS:
                yield self._batch(held, kinds)
                held = []
        if held:
            yield self._batch(held, kinds)

    @staticmethod
    def _batch(rows: list[list], kinds: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


@dataclass
class Done(WriterCommitMessage):
    path: str
    task: int


_FILES = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" '
    'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
    'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
    'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{related}</Relationships>',
}
_SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _cell(value) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float):
        return f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROL.sub("", str(value)))}</t></is></c>'


class XlsxWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path, names, overwrite
        self.folder = f"{path.rstrip('/')}._writing-{uuid.uuid4().hex}"
        begin(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        context = TaskContext.get()
        store, folder = opened(self.folder)
        path = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}.xlsx"
        top = f"<row>{''.join(_cell(n) for n in self.names)}</row>"
        with store.open_output_stream(path) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as out:
            sheets, rows, sheet = 0, 0, None
            for batch in iterator:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if sheet is None or rows == MOST_ROWS:
                        if sheet is not None:
                            sheet.write(b"</sheetData></worksheet>")
                            sheet.close()
                        sheets, rows = sheets + 1, 0
                        sheet = out.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True)
                        sheet.write((_SHEET + top).encode())
                    sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                    rows += 1
            if sheet is None:
                sheets = 1
                sheet = out.open("xl/worksheets/sheet1.xml", "w")
                sheet.write((_SHEET + top).encode())
            sheet.write(b"</sheetData></worksheet>")
            sheet.close()
            each = range(1, sheets + 1)
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
            rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"
            fill = {
                "types": "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}"/>' for n in each),
                "sheets": "".join(f'<sheet name="Sheet{n}" sheetId="{n}" r:id="rId{n}"/>' for n in each),
                "related": "".join(f'<Relationship Id="rId{n}" Type="{rel}" Target="worksheets/sheet{n}.xml"/>' for n in each),
            }
            for name, text in _FILES.items():
                for key, value in fill.items():
                    text = text.replace(f"{{{key}}}", value)
                out.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
        return Done(path, context.partitionId())

    def commit(self, messages: list[Done | None]) -> None:
        store, target = opened(self.path)
        if store.get_file_info(target).type == pafs.FileType.Directory:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.path)
            store.delete_dir(target)
        store.create_dir(target)
        for m in messages:
            if m:
                store.move(m.path, f"{target}/part-{m.task:05d}.xlsx")
        self.abort(messages)

    def abort(self, messages) -> None:
        drop(self.folder)


class XlsxSource(DataSource):
    """Options: ``path``; ``sheet`` (a name, or ``*`` for all; the first sheet of each file by default)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        found = files(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        book = Workbook(found[0][0])
        sheet = self.options.get("sheet", "*")
        sheet = next(iter(book.sheets)) if sheet == "*" else sheet
        if sheet not in book.sheets:
            raise ValueError(f"{book.path} has no sheet {sheet}")
        top = next((c for c in book.rows(sheet) if c), {})
        names = list(dict.fromkeys(text_of(v).strip() for _, v in sorted(top.items())))
        return ", ".join(f"`{n.replace('`', '``')}` string" for n in names if n)

    def reader(self, schema) -> XlsxReader:
        return XlsxReader(self.options["path"], self.options.get("sheet"), schema)

    def writer(self, schema, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(self.options["path"], list(schema.names), overwrite)


def use(spark: SparkSession) -> None:
    """Makes ``xlsx`` known to the session and its workers."""
    ship(spark)
    spark.dataSource.register(XlsxSource)


def read_xlsx(spark: SparkSession, path: str, schema: str | None = None, sheet: str | None = None) -> DataFrame:
    from gridlake.sinks.netcdf import qualified
    from gridlake.sources.tables import require

    require(spark, path)
    use(spark)
    reader = spark.read.format("xlsx")
    reader = reader.option("sheet", sheet) if sheet else reader
    return (reader.schema(schema) if schema else reader).load(qualified(spark, path))


def write_xlsx(df: DataFrame, path: str) -> None:
    from gridlake.sinks.netcdf import qualified

    use(df.sparkSession)
    df.write.format("xlsx").mode("overwrite").save(qualified(df.sparkSession, path))
