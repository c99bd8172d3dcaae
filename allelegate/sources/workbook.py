"""Gene-drug pair workbooks, as a data source that Spark splits inside the sheet.

`spark.read.format("pair_workbook")` makes one partition per file and range of `splitBytes` unpacked bytes of its
first sheet; a row belongs to the range where its tag begins.  A packed sheet cannot be entered in the middle, so a
task unpacks what stands before its range, but parses only the sheet's first row and its own rows, and keeps only the
shared texts that these name.  `df.write.format("pair_workbook")` lands (drug, genes) rows as workbooks; files show
once the job has committed.  Both use pyarrow's file systems; `candidates_from_workbooks` takes files as bytes, for
stores that only Spark reads.  Mapping, splitting and staging are columns.

Odd files: no file, no sheet or no row gives no rows; a cell that names a missing shared text is blank.
"""

from __future__ import annotations

import io
import itertools
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs as store
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from allelegate.operators.staging import candidates_from_pairs, medication_aliases
from allelegate.plans import domains as D
from allelegate.sources.delimited import header_key

# Namespaces of the file format, and its row limit with the header.
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
MAX_ROWS = 1_048_576

SPLIT_BYTES = 32 << 20
CHUNK = 1 << 20
BATCH = 2_000
PAIR_CELLS = "ord_file string, ord_row bigint, drug string, genes string"

ROOT_TAG = re.compile(rb"<((?:[\w.-]+:)?worksheet)(?=[\s>])[^>]*>")
ROW_TAG = re.compile(rb"<(?:[\w.-]+:)?row(?=[\s/>])")
ROW_END = re.compile(rb"</(?:[\w.-]+:)?row\s*>")


def column_number(ref: str) -> int | None:
    """0-based column of a cell reference such as `AB12`; None without letters."""
    number = 0
    for ch in ref:
        if not ch.isalpha():
            break
        number = number * 26 + ord(ch.upper()) - 64
    return number - 1 if number else None


def first_sheet(book: zipfile.ZipFile) -> str | None:
    """Member that holds the first sheet of the workbook's own list; without a list, the lowest sheet number."""
    members = set(book.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= members:
        listed = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{SHEET}sheets/{SHEET}sheet")
        links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        targets = {r.get("Id"): r.get("Target", "") for r in links.iter(f"{PACKAGE}Relationship")}
        target = targets.get(listed.get(f"{OFFICE}id"), "") if listed is not None else ""
        member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        if member in members:
            return member
    numbered = [(int(m[1]), m[0]) for m in (re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n) for n in members) if m]
    return min(numbered)[1] if numbered else None


def row_texts(stream: BinaryIO, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """(number, XML) of a sheet's first row and of the rows whose tags begin at bytes `low` to `high`.

    Number -1 carries the sheet's opening tag.
    """
    held, base, number = b"", 0, 0
    while True:
        chunk = stream.read(CHUNK)
        held += chunk
        at, whole = 0, True
        if base == 0 and number == 0 and (root := ROOT_TAG.search(held)):
            yield -1, root[0]
        while found := ROW_TAG.search(held, at):
            start = found.start()
            if number and base + start >= high:
                return
            close = held.find(b">", found.end())
            stop = close + 1
            if close >= 0 and held[close - 1 : close] != b"/":
                end = ROW_END.search(held, close)
                stop = end.end() if end else 0
            if not stop:
                at, whole = start, False
                break
            if not number or base + start >= low:
                yield number, held[start:stop]
            number, at = number + 1, stop
        if not chunk:
            return
        # the chunk's end may cut a tag
        cut = max(at, len(held) - 64) if whole else at
        base, held = base + cut, held[cut:]


def _cells(row: ElementTree.Element) -> list[str | int]:
    """Cells of a row, gaps filled with blanks; a number stands for a shared text."""
    cells: list[str | int] = []
    for c in row.findall(f"{SHEET}c"):
        at = column_number(c.get("r", ""))
        at = len(cells) if at is None else at
        cells.extend([""] * (at + 1 - len(cells)))
        inline, value = c.findtext(f"{SHEET}is/{SHEET}t"), c.findtext(f"{SHEET}v")
        if not inline and value and c.get("t") == "s":
            cells[at] = int(value)
        else:
            cells[at] = " ".join((inline or value or "").split())
    return cells


def shared_texts(book: zipfile.ZipFile, wanted: set[int]) -> dict[int, str]:
    """The wanted entries of the shared texts, read as a stream."""
    found: dict[int, str] = {}
    if not wanted or "xl/sharedStrings.xml" not in book.namelist():
        return found
    last, number = max(wanted), 0
    with book.open("xl/sharedStrings.xml") as stream:
        events = ElementTree.iterparse(stream, events=("start", "end"))
        _, root = next(events)
        for event, entry in events:
            if event == "end" and entry.tag == f"{SHEET}si":
                if number in wanted:
                    found[number] = " ".join("".join(t.text or "" for t in entry.iter(f"{SHEET}t")).split())
                number += 1
                root.clear()
                if number > last:
                    break
    return found


def pair_rows(book: zipfile.ZipFile, low: int = 0, high: int | None = None) -> Iterator[tuple[int, str, str]]:
    """(row number from 0 after the header, drug, genes) of the first sheet's rows that begin in a range of bytes."""
    sheet = first_sheet(book)
    if sheet is None:
        return
    head, headers, batch = b"", None, []
    held: list[tuple[int, str | int, str | int]] = []

    def take() -> None:
        name = ROOT_TAG.match(head)[1]
        rows = ElementTree.fromstring(head + b"".join(text for _, text in batch) + b"</" + name + b">")
        for (number, _), row in zip(batch, rows, strict=True):
            cells = _cells(row)
            held.append((number - 1, _first_inside(cells, headers, D.PAIR_DRUG_HEADERS), _first_inside(cells, headers, D.PAIR_GENE_HEADERS)))
        batch.clear()

    with book.open(sheet) as stream:
        for number, text in row_texts(stream, low, book.getinfo(sheet).file_size if high is None else high):
            if number < 0:
                head = text
            elif number == 0:
                cells = _cells(ElementTree.fromstring(head + text + b"</" + ROOT_TAG.match(head)[1] + b">")[0])
                names = shared_texts(book, {c for c in cells if isinstance(c, int)})
                headers = [header_key(names.get(c, "") if isinstance(c, int) else c) for c in cells]
            else:
                batch.append((number, text))
                if len(batch) == BATCH:
                    take()
    if batch:
        take()
    known = shared_texts(book, {c for row in held for c in row[1:] if isinstance(c, int)})
    for number, *pair in held:
        drug, genes = (known.get(c, "") if isinstance(c, int) else c for c in pair)
        yield number, drug, genes


def _first_inside(cells: list, headers: list[str], aliases: list[str]) -> str | int:
    """Cell of the first alias that is a header and lies inside the row, even when empty."""
    places = (headers.index(a) for a in aliases if a in headers)
    return next((cells[i] for i in places if i < len(cells)), "")


@dataclass
class SheetRange(InputPartition):
    path: str
    low: int
    high: int


def opened(path: str) -> tuple[store.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return store.FileSystem.from_uri(re.sub("^file:/+", "/", path))


class PairReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[SheetRange]:
        """Ranges of all files, from their directories of members alone."""
        ranges = []
        for path in self.paths:
            system, root = opened(path)
            files = [system.get_file_info(root)]
            if files[0].type == store.FileType.NotFound:
                raise FileNotFoundError(path)
            if files[0].type == store.FileType.Directory:
                files = sorted(system.get_file_info(store.FileSelector(root)), key=lambda f: f.path)
            for file in files:
                if file.is_file and not file.base_name.startswith(("_", ".")):
                    with system.open_input_file(file.path) as raw, zipfile.ZipFile(raw) as book:
                        sheet = first_sheet(book)
                        size = book.getinfo(sheet).file_size if sheet else 0
                    base = path if file.path == root else f"{path.rstrip('/')}/{file.base_name}"
                    ranges += [SheetRange(base, low, min(low + self.split, size)) for low in range(0, size, self.split)]
        return ranges

    def read(self, part: SheetRange) -> Iterator[tuple]:
        if part is None:  # no ranges at all
            return
        system, path = opened(part.path)
        with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as book:
            for number, drug, genes in pair_rows(book, part.low, part.high):
                yield part.path, number, drug, genes


@dataclass
class Landed(WriterCommitMessage):
    names: list[str]


class PairWriter(DataSourceWriter):
    """One workbook per task and MAX_ROWS; hidden names until the job commits, so a repeated task leaves no double."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, rows: Iterator) -> Landed:
        system, root = opened(self.path)
        system.create_dir(root)
        names = []
        rows = iter(rows)
        while (first := next(rows, None)) is not None:
            names.append(f"pairs-{uuid.uuid4().hex}.xlsx")
            part = itertools.chain([first], itertools.islice(rows, MAX_ROWS - 2))
            with system.open_output_stream(f"{root}/_{names[-1]}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
                with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'<worksheet xmlns="{SHEET[1:-1]}"><sheetData>{_row_xml("Drug(s)", "Genes")}'.encode())
                    for row in part:
                        sheet.write(_row_xml(row["drug"], row["genes"]).encode())
                    sheet.write(b"</sheetData></worksheet>")
        return Landed(names)

    def commit(self, messages: list[Landed | None]) -> None:
        system, root = opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{root}/_{name}", f"{root}/{name}")

    def abort(self, messages: list[Landed | None]) -> None:
        system, root = opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{root}/_{name}")


#: Characters that XML cannot hold.
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


def _row_xml(*cells: str | None) -> str:
    texts = (escape(NOT_XML.sub("", c or "")) for c in cells)
    return f"<row>{''.join(f'<c t="inlineStr"><is><t>{t}</t></is></c>' for t in texts)}</row>"


class PairWorkbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pair_workbook"

    def schema(self) -> str:
        return PAIR_CELLS

    def reader(self, schema) -> PairReader:
        return PairReader(self.options)

    def writer(self, schema, overwrite: bool) -> PairWriter:
        if overwrite:
            raise ValueError("pair_workbook only appends")
        return PairWriter(self.options)


def write_pair_workbooks(pairs: DataFrame, path: str) -> None:
    """Land (drug, genes) rows as workbooks in a folder."""
    pairs.sparkSession.dataSource.register(PairWorkbooks)
    pairs.select("drug", "genes").write.format("pair_workbook").mode("append").save(path)


def pair_cells(files: DataFrame) -> DataFrame:
    """(ord_file, ord_row, drug, genes) from files with columns `path` and `content`."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    rows = ((path, *row) for row in pair_rows(book))
                    while held := list(itertools.islice(rows, 10_000)):
                        yield pd.DataFrame(held, columns=["ord_file", "ord_row", "drug", "genes"])

    return files.select("path", "content").mapInPandas(parse, PAIR_CELLS)


def _staged(cells: DataFrame, source_url: str, aliases: DataFrame | None) -> DataFrame:
    aliases = aliases if aliases is not None else medication_aliases(cells.sparkSession)
    return candidates_from_pairs(cells, F.col("drug"), F.col("genes"), F.lit(source_url), aliases)


def candidates_from_workbooks(files: DataFrame, source_url: str, aliases: DataFrame | None = None) -> DataFrame:
    """Staged placeholders from workbook files given as a (path, content) table."""
    return _staged(pair_cells(files), source_url, aliases)


def read_pair_workbook(
    spark: SparkSession, path: str | list[str], source_url: str, aliases: DataFrame | None = None, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Staged placeholders from landed workbooks: files, or folders of them."""
    spark.dataSource.register(PairWorkbooks)
    reader = spark.read.format("pair_workbook").option("splitBytes", split_bytes)
    named = reader.option("path", path) if isinstance(path, str) else reader.option("paths", json.dumps(path))
    return _staged(named.load(), source_url, aliases)
