"""``spark.read.format("case")``: all sections of case files in one splittable scan.

Columns: ``path``, ``section``, ``rec_no`` (the byte at which the record begins), ``corrupt`` (the first line of a
record that cannot be parsed) and a struct for each section, null in other sections' rows.  A schema
given by the reader's user prunes sections: those without a column are not read.

A file of at most ``splitBytes`` is one partition.  The planner looks for the section markers of a larger
file, in blocks, and cuts each section into byte ranges of ``splitBytes``; a range parses the records that
begin in it and reads on to the end of the last.  Files are opened through Arrow's file systems.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridlake.session import ship
from gridlake.sources.case import HEAD, SCHEMAS, arrow_type, columns, kept_line, line_records
from gridlake.sources.stores import STORES, files, opened

SPLIT_BYTES = 16 << 20
BLOCK = 4 << 20
ROWS = 10_000
_MARK = re.compile(rb"(BEGIN|END OF) (%s) DATA" % "|".join(SCHEMAS).encode())


def struct_type(section: str) -> str:
    return f"struct<{', '.join(f'{c}: {t}' for c, t in columns(section)[1:])}>"


def table_schema(sections: list[str]) -> str:
    fixed = "path string, section string, rec_no long, corrupt string"
    return ", ".join([fixed, *(f"{s.lower()} {struct_type(s)}" for s in sections)])


def marks(file: pa.NativeFile) -> list[tuple[bytes, str, int, int]]:
    """(BEGIN or END OF, section, first byte of its line, first byte after its line), in blocks of a bounded size."""
    out, held, at = [], b"", 0
    while True:
        block = file.read(BLOCK)
        data = held + block
        end = len(data) if not block else data.rfind(b"\n") + 1
        for m in _MARK.finditer(data, 0, end):
            after = data.find(b"\n", m.end(), end)
            out.append((m[1], m[2].decode(), at + data.rfind(b"\n", 0, m.start()) + 1, at + (after + 1 if after >= 0 else end)))
        if not block:
            return out
        held, at = data[end:], at + end


def ranges(found: list, size: int) -> dict[str, tuple[int, int]]:
    """First byte and end of each section's lines: from its first beginning to its next end or the file's."""
    out = {}
    for kind, section, _, after in found:
        if kind == b"BEGIN" and section not in out:
            ends = [line for k, s, line, _ in found if k == b"END OF" and s == section and line >= after]
            out[section] = after, min(ends, default=size)
    return out


def lines(file: pa.NativeFile, first: int, start: int, stop: int, last: int, whole: bool) -> Iterator[tuple[int, str]]:
    """(byte, line) of the record lines that begin in [start, stop) of a section [first, last).

    With ``whole``, records of several lines: from the first head at or after ``start`` (or the section's begin) to the
    lines that follow the last head before ``stop``.
    """
    at = start - 1 if start > first else start
    file.seek(at)
    held, skip, seen = b"", start > first, start == first
    while at < last:
        block = file.read(min(BLOCK, last - at - len(held)))
        data = held + block
        end = data.rfind(b"\n") + 1 if block and at + len(data) < last else len(data)
        place = 0
        while place < end:
            after = data.find(b"\n", place, end) + 1 or end
            begin, raw = at + place, data[place:after]
            place = after
            if skip:  # the rest of a line that began before
                skip = False
                continue
            if begin >= stop and not whole:
                return
            line = raw.decode("latin-1").strip()
            if not kept_line(line):
                continue
            if whole:
                head = HEAD in line
                if begin >= stop and (head or not seen):
                    return
                seen = seen or head
                if not seen:
                    continue
            yield begin, line
        if not block:
            return
        held, at = data[end:], at + end


@dataclass
class Range(InputPartition):
    """Byte ranges of one file: (section, first, start, stop, last); None for a whole small file."""

    path: str
    parts: list | None


class CaseReader(DataSourceReader):
    def __init__(self, path: str, sections: list[str], names: list[str], split: int):
        self.path, self.sections, self.names, self.split = path, sections, names, split

    def partitions(self) -> list[Range]:
        out = []
        for path, size in files(self.path):
            if size <= self.split:
                out.append(Range(path, None))
                continue
            store, inside = opened(path)
            with store.open_input_file(inside) as file:
                found = ranges(marks(file), size)
            for section in self.sections:
                first, last = found.get(section, (0, 0))
                for start in range(first, last, self.split):
                    out.append(Range(path, [(section, first, start, min(start + self.split, last), last)]))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, inside = opened(partition.path)
        with store.open_input_file(inside) as file:
            parts = partition.parts
            if parts is None:
                found = ranges(marks(file), file.size())
                parts = [(s, *found[s][:1], *found[s], found[s][1]) for s in self.sections if s in found]
            for section, first, start, stop, last in parts:
                rows = []
                for row in line_records(lines(file, first, start, stop, last, section == "TRANSFORMER"), section):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield self._batch(partition.path, section, rows)
                        rows = []
                if rows:
                    yield self._batch(partition.path, section, rows)

    def _batch(self, path: str, section: str, rows: list) -> pa.RecordBatch:
        n = len(rows)
        good = [r is not None for _, _, r in rows]
        fixed = {
            "path": pa.array([path] * n, pa.string()),
            "section": pa.array([section] * n, pa.string()),
            "rec_no": pa.array([at for at, _, _ in rows], pa.int64()),
            "corrupt": pa.array([None if ok else line for ok, (_, line, _) in zip(good, rows, strict=True)], pa.string()),
        }
        out = []
        for name in self.names:
            if name in fixed:
                out.append(fixed[name])
                continue
            typed = columns(name.upper())[1:]
            fields = [pa.field(c, arrow_type(t)) for c, t in typed]
            if name.upper() != section:
                out.append(pa.nulls(n, pa.struct(fields)))
                continue
            empty = (None,) * len(typed)
            values = zip(*(empty if r is None else r for _, _, r in rows), strict=True)
            data = [pa.array(v, f.type) for v, f in zip(values, fields, strict=True)]
            out.append(pa.StructArray.from_arrays(data, fields=fields, mask=pa.array([not ok for ok in good])))
        return pa.RecordBatch.from_arrays(out, self.names)


class CaseSource(DataSource):
    """Options: ``path``; ``sections`` (names, all by default); ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "case"

    def _sections(self) -> list[str]:
        named = [s.strip().upper() for s in self.options.get("sections", "").split(",") if s.strip()] or list(SCHEMAS)
        if unknown := [s for s in named if s not in SCHEMAS]:
            raise ValueError(f"unknown sections {unknown}; there are {list(SCHEMAS)}")
        return named

    def schema(self) -> str:
        return table_schema(self._sections())

    def reader(self, schema) -> CaseReader:
        names = list(schema.names)
        asked = [s for s in self._sections() if s.lower() in names]
        return CaseReader(self.options["path"], asked or self._sections(), names, int(self.options.get("splitBytes", SPLIT_BYTES)))


def arrow_path(spark: SparkSession, path: str) -> str | None:
    """The files that ``path`` (a file, a folder or a glob of Spark's) matches, for the source ``case``; None if Arrow does not open their store."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(conf).globStatus(where)
    if not found:
        raise FileNotFoundError(path)
    named = [str(f.getPath().toString()) for f in found]
    if any(n.partition(":")[0] not in STORES or "," in n for n in named):
        return None
    return ",".join(named)


def scan(spark: SparkSession, path: str, sections: list[str], split: int = SPLIT_BYTES) -> DataFrame:
    """The source ``case`` over the named sections, registered and sent to the workers first."""
    ship(spark)
    spark.dataSource.register(CaseSource)
    return spark.read.format("case").option("sections", ",".join(sections)).option("splitBytes", split).load(path)
