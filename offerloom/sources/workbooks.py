"""Workbooks and landed search results as data sources of Spark: ``spark.read.format("workbook")``, ``df.write.format("workbook")``, ``spark.read.format("search_results")``.

Both read in partitions that tasks take one by one: a sheet, a file of result pages. Rows are streamed out of the sheet's XML, so a task holds a row, not a sheet. Python data
sources have no access to Spark's file systems: paths are folders that driver and executors share. For workbooks in other stores there is :func:`.readers.read_xlsx`.
"""

from __future__ import annotations

import glob
import json
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows that a sheet can hold, its head included
SHEET_ROWS = 1 << 20


def paths_of(path: str, pattern: str) -> list[str]:
    """The files of a path: itself, those of a folder that fit ``pattern``, or those of a glob; lock files (``~$``) and hidden ones are passed over."""
    local = path.removeprefix("file://")
    found = glob.glob(os.path.join(local, pattern)) if os.path.isdir(local) else glob.glob(local)
    return sorted(p for p in found if not os.path.basename(p).startswith(("~$", ".", "_")))


def column_of(reference: str) -> int:
    """The column of a cell's reference, from 0: ``C7`` is 2."""
    at = 0
    for letter in re.match(r"[A-Z]*", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def column_name(at: int) -> str:
    out = ""
    at += 1
    while at:
        at, rest = divmod(at - 1, 26)
        out = chr(65 + rest) + out
    return out


def sheets_of(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and parts of a workbook's sheets in their order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = targets[sheet.get(RELATION)]
        out.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    """The texts that cells refer to; one workbook's, not a table's."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{MAIN}si":
                out.append("".join(t.text or "" for t in e.iter(f"{MAIN}t")))
                e.clear()
    return out


def cells_of(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[list[str | None]]:
    """The rows of a sheet as text, one at a time."""
    with book.open(part) as f:
        holder = None
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                holder = e if e.tag == f"{MAIN}sheetData" else holder
                continue
            if e.tag != f"{MAIN}row":
                continue
            cells: list[str | None] = []
            for c in e:
                at = column_of(c.get("r", "")) if c.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                value, kind = c.find(f"{MAIN}v"), c.get("t")
                if kind == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{MAIN}t")))
                elif value is None or value.text is None:
                    cells.append(None)
                else:
                    cells.append(shared[int(value.text)] if kind == "s" else value.text)
            yield cells
            holder.clear()  # rows that were given out are dropped


@dataclass
class Sheet(InputPartition):
    path: str
    name: str
    part: str


@dataclass
class ResultFile(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]
    rows: int


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.only = schema.names, options["path"], options.get("sheet")

    def partitions(self) -> list[Sheet]:
        out = []
        for path in paths_of(self.path, "*.xlsx"):
            with zipfile.ZipFile(path) as book:
                sheets = sheets_of(book)
            out += [Sheet(path, name, part) for i, (name, part) in enumerate(sheets) if self.only in (None, "*", name) and (self.only or i == 0)]
        return out

    def read(self, sheet: Sheet) -> Iterator[tuple]:
        with zipfile.ZipFile(sheet.path) as book:
            rows = cells_of(book, sheet.part, shared_strings(book))
            head = [(c or "").replace(" ", " ").strip() for c in next(rows, [])]
            at = [head.index(n) if n in head else None for n in self.names]
            told = {"_file": os.path.basename(sheet.path), "_sheet": sheet.name}
            for i, cells in enumerate(rows):
                told["_row"] = str(i)
                yield tuple(told[n] if n in told else cells[k] if k is not None and k < len(cells) else None for n, k in zip(self.names, at))


class WorkbookWriter(DataSourceWriter):
    """Each task writes its own workbooks under names that no reader looks at; the commit renames them, an abort takes them away."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names, self.folder, self.overwrite = schema.names, options["path"].removeprefix("file://"), overwrite
        self.numeric = [f.dataType.typeName() in ("integer", "long", "short", "byte", "double", "float", "decimal") for f in schema.fields]
        self.sheet, self.run = options.get("sheet", "Sheet1"), uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        paths: list[str] = []
        total = 0
        try:
            row = next(iterator, None)
            while row is not None:
                paths.append(os.path.join(self.folder, f"_{self.run}-{uuid.uuid4().hex}.xlsx"))
                with zipfile.ZipFile(paths[-1], "w", zipfile.ZIP_DEFLATED) as book:
                    self.frame(book)
                    with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                        f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                        f.write(self.line(1, self.names, [False] * len(self.names)))
                        n = 1
                        while row is not None and n < SHEET_ROWS:
                            n += 1
                            f.write(self.line(n, row, self.numeric))
                            row = next(iterator, None)
                        f.write(b"</sheetData></worksheet>")
                total += n - 1
        except BaseException:
            self.remove(paths)
            raise
        return Written(paths, total)

    def frame(self, book: zipfile.ZipFile) -> None:
        kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006"
        types = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        head = '<?xml version="1.0" encoding="UTF-8"?>'
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{types}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{types}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{kind}"><sheets><sheet name="{escape(self.sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{kind}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')

    def line(self, n: int, cells, numeric: list[bool]) -> bytes:
        out = []
        for i, (value, number) in enumerate(zip(cells, numeric)):
            if value is None:
                continue
            if number and value == value and abs(value) != float("inf"):
                out.append(f'<c r="{column_name(i)}{n}"><v>{value}</v></c>')
            else:
                text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value)).replace("\r", "&#13;")
                text = escape(text).replace("&amp;#13;", "&#13;")
                out.append(f'<c r="{column_name(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
        return f'<row r="{n}">{"".join(out)}</row>'.encode()

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            self.remove(paths_of(self.folder, "*.xlsx"))
        paths = [p for m in messages if m for p in m.paths]
        for i, path in enumerate(paths):
            os.replace(path, os.path.join(self.folder, f"part-{i:05d}-{self.run}.xlsx"))

    def abort(self, messages: list[Written | None]) -> None:
        self.remove(p for m in messages if m for p in m.paths)
        self.remove(glob.glob(os.path.join(self.folder, f"_{self.run}-*.xlsx")))

    @staticmethod
    def remove(paths) -> None:
        for path in paths:
            if os.path.exists(path):
                os.remove(path)


class Workbook(DataSource):
    """``spark.read.format("workbook").load(path)``: text columns named by the head of the first sheet read, and ``_file, _sheet, _row``.

    Without ``option("sheet", name)`` each workbook's first sheet is read, with ``"*"`` all. A sheet is one partition. Where a schema is given, columns are found by name; those a
    sheet lacks are null. Written, each partition becomes a workbook of its own (more, past a million rows): ``coalesce(1)`` gives one.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        reader = WorkbookReader(StructType(), self.options)
        for sheet in reader.partitions():
            with zipfile.ZipFile(sheet.path) as book:
                head = next(cells_of(book, sheet.part, shared_strings(book)), [])
            names = [(c or f"column{i}").replace(" ", " ").strip().replace("`", "``") for i, c in enumerate(head)]
            return ", ".join(f"`{n}` string" for n in [*dict.fromkeys(names), "_file", "_sheet", "_row"])
        raise FileNotFoundError(f"no workbook at {self.options.get('path')}")

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, self.options, overwrite)


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size, self.most = options["path"], int(options.get("pageSize", 100)), int(options.get("maxItems", 80))

    def partitions(self) -> list[ResultFile]:
        return [ResultFile(p) for p in paths_of(self.path, "*.json*")]

    def read(self, file: ResultFile) -> Iterator[tuple]:
        """Items in order up to ``maxItems``, over pages up to the first that failed, is empty or short."""
        query, ended, taken = None, False, 0
        with open(file.path, encoding="utf-8") as f:
            for line in f:
                if not line.strip():
                    continue
                page = json.loads(line)
                if page["query"] != query:
                    query, ended, taken = page["query"], False, 0
                if ended:
                    continue
                items = page.get("items") or []
                for at, item in enumerate(items):
                    if taken < self.most:
                        yield query, page["page"], at, taken, page.get("total"), item.get("title"), item.get("link"), item.get("image"), str(item["lprice"]) if item.get("lprice") is not None else None, item.get("mallName")
                        taken += 1
                ended = bool(page.get("error")) or len(items) < self.size


class SearchResults(DataSource):
    """Landed pages of a search, one JSON object a line with ``query, page, total, items`` in the order of pages; a file is one partition and holds its queries whole."""

    @classmethod
    def name(cls) -> str:
        return "search_results"

    def schema(self) -> str:
        return "query string, page int, at int, ordinal int, total long, title string, link string, image string, price string, mall_name string"

    def reader(self, schema: StructType) -> SearchReader:
        return SearchReader(self.options)


def register(spark: SparkSession) -> None:
    """Both formats in this session."""
    spark.dataSource.register(Workbook)
    spark.dataSource.register(SearchResults)
