"""A Python data source for spreadsheets (OOXML), without a third-party reader.

`spark.read.format("sheet").option("sheet", "Data").load(path)`: the first row names the columns, repeated names get .1, .2
as suffix; all columns are strings, empty cells null.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _local(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def _place(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_rows(path: str, sheet: str) -> Iterator[list[str | None]]:
    """Rows of a sheet as text cells; a missing file or sheet is an error."""
    with zipfile.ZipFile(_local(path)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        ids = {s.get("name"): s.get(f"{_REL}id") for s in book.iter(f"{_MAIN}sheet")}
        if sheet not in ids:
            raise ValueError(f"no sheet {sheet!r}, there are {sorted(ids)}")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[ids[sheet]]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: dict[int, str | None] = {}
                for k, c in enumerate(row.iter(f"{_MAIN}c")):
                    at = _place(c.get("r")) if c.get("r") else k
                    v = c.find(f"{_MAIN}v")
                    if c.get("t") == "s" and v is not None:
                        cells[at] = shared[int(v.text)]
                    elif c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    else:
                        cells[at] = v.text if v is not None else None
                yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                row.clear()


def header_names(cells: list[str | None]) -> list[str]:
    """Column names of a header row; repeated ones get .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for i, c in enumerate(cells):
        name = c if c not in (None, "") else f"unnamed_{i}"
        k = seen.get(name, 0)
        seen[name] = k + 1
        out.append(f"{name}.{k}" if k else name)
    return out


class SheetSource(DataSource):
    """Registered with spark.dataSource.register(SheetSource)."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> StructType:
        rows = sheet_rows(self.options["path"], self.options.get("sheet", "Data"))
        return StructType([StructField(n, StringType()) for n in header_names(next(rows, []))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SheetReader(self.options["path"], self.options.get("sheet", "Data"), len(schema))


class _SheetReader(DataSourceReader):
    def __init__(self, path: str, sheet: str, width: int):
        self._path, self._sheet, self._width = path, sheet, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self._path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rows = sheet_rows(partition.value, self._sheet)
        next(rows, None)
        for r in rows:
            yield tuple((r + [None] * self._width)[: self._width])
