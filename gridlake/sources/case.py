"""Records of sectioned power-flow case files.

A case is one text file with sections between ``BEGIN <X> DATA`` and ``END OF <X> DATA`` lines, in
ISO-8859-1, with comment lines, quoted names and positional fields; transformers take four or five
lines.  Files in a store that Arrow opens are read by the splittable source ``case``
(:mod:`gridlake.sources.case_source`), all sections that are asked for in one scan; from other stores
Spark reads the files whole, a file in a task.  Records that cannot be parsed are kept with their text
in ``corrupt_records`` and dropped from the section.  ``rec_no`` rises with a record's place in its file.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake import schemas


def kept_line(line: str) -> bool:
    """Whether a trimmed line is a record's: blank lines and comments are not."""
    return bool(line) and not line.startswith(("@", "/", "0 /"))


def section_lines(text: str, section: str) -> Iterator[tuple[int, str]]:
    """Numbered record lines of a section; lines after the end marker are left out."""
    inside = False
    for number, line in enumerate(text.split("\n")):
        line = line.strip()
        if not inside:
            inside = f"BEGIN {section} DATA" in line
        elif f"END OF {section} DATA" in line:
            return
        elif kept_line(line):
            yield number, line


def fields(line: str) -> list[str]:
    return [x.strip() for x in next(csv.reader([line], quotechar="'", skipinitialspace=True))]


def _number(kind: Callable, values: list[str], at: int):
    return kind(values[at]) if at < len(values) and values[at] else None


def _integer(text: str) -> int:
    return int(float(text))


def _bus(f: list[str]) -> tuple:
    ints = [_number(_integer, f, i) for i in (3, 4, 5, 6)]
    return (int(f[0]), f[1], float(f[2]), *ints, _number(float, f, 7), _number(float, f, 8))


def _branch(f: list[str]) -> tuple:
    rx = [float(f[i]) for i in (3, 4, 5)]
    return (int(f[0]), int(f[1]), f[2], *rx, f[6], _number(float, f, 7), _number(_integer, f, 23), _number(float, f, 25))


def _generator(f: list[str]) -> tuple:
    # after the quoted id: 0 active power, 12 status, 14 most power, 16 owner
    return (int(f[0]), f[1], float(f[2]), _number(_integer, f, 14), _number(float, f, 16), _number(_integer, f, 18))


def _load(f: list[str]) -> tuple:
    return (int(f[0]), f[1], _integer(f[2]), float(f[5]), _number(float, f, 7), _number(float, f, 9))


def _named(f: list[str]) -> tuple:
    return int(f[0]), f[-1]


ONE_LINE = {"BUS": _bus, "BRANCH": _branch, "GENERATOR": _generator, "LOAD": _load, "OWNER": _named, "AREA": _named}
SCHEMAS = {
    "BUS": schemas.BUS,
    "BRANCH": schemas.BRANCH,
    "TRANSFORMER": schemas.TRANSFORMER,
    "GENERATOR": schemas.GENERATOR,
    "LOAD": schemas.LOAD,
    "OWNER": schemas.OWNER,
    "AREA": schemas.AREA,
}


#: Quotes stand in the first line of a transformer and in no other, so a record is found from any place in the section.
HEAD = "'"


def _transformer(lines: list[str]) -> tuple[tuple, int]:
    """The record that the lines begin with, and how many of them it takes: four for two windings, five for three."""
    f = fields(lines[0])
    i, j, k = int(f[0]), int(f[1]), int(f[2])
    size = 5 if k else 4
    if len(lines) < size:
        raise ValueError("a line is missing")
    z = fields(lines[1])
    pairs = [_number(float, z, n) for n in range(9 if k else 3)]
    return (i, j, k or None, f[3], f[10], _integer(f[11]), *pairs, *[None] * (9 - len(pairs))), size


def _held(held: list[tuple[int, str]]) -> Iterator[tuple[int, str, tuple | None]]:
    number, first = held[0]
    try:
        record, size = _transformer([line for _, line in held])
    except (ValueError, IndexError):
        yield number, first, None
        return
    yield number, first, record
    for number, line in held[size : size + 1]:
        yield number, line, None


def transformer_records(lines: Iterator[tuple[int, str]]) -> Iterator[tuple[int, str, tuple | None]]:
    """(number, first line, record or None).

    Lines are held until the next first line, so a broken record, one with a missing line or one that is
    followed by stray lines costs no line of the next.
    """
    held: list[tuple[int, str]] = []
    for number, line in lines:
        if held and HEAD in line:
            yield from _held(held)
            held = []
        held.append((number, line))
    if held:
        yield from _held(held)


def line_records(lines: Iterator[tuple[int, str]], section: str) -> Iterator[tuple[int, str, tuple | None]]:
    """(number, line, record or None) of a section's numbered lines."""
    if section == "TRANSFORMER":
        yield from transformer_records(lines)
        return
    parse = ONE_LINE[section]
    for number, line in lines:
        try:
            yield number, line, parse(fields(line))
        except (ValueError, IndexError):
            yield number, line, None


def records(text: str, section: str) -> Iterator[tuple[int, str, tuple | None]]:
    return line_records(section_lines(text, section), section)


def arrow_type(kind: str) -> pa.DataType:
    return {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "long": pa.int64()}[kind]


def columns(section: str) -> list[tuple[str, str]]:
    """(name, type) of a section's columns, ``rec_no`` first."""
    return [tuple(x.split()) for x in SCHEMAS[section].split(", ")]


def parsed(texts: DataFrame, column: str, section: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed records of a section of every case text, with the columns named in ``keep``."""
    schema = SCHEMAS[section]
    kept = "".join(f"{c} {texts.schema[c].dataType.simpleString()}, " for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, source = [], []
            for n, text in enumerate(batch.column(len(keep)).to_pylist()):
                for number, _, record in records(text or "", section):
                    if record is not None:
                        rows.append((number, *record))
                        source.append(n)
            data = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            if data:
                carried = [batch.column(i).take(pa.array(source)) for i in range(len(keep))]
                names = [*keep, *(c for c, _ in columns(section))]
                typed = [a.cast(arrow_type(t)) for a, (_, t) in zip(data, columns(section), strict=True)]
                yield pa.RecordBatch.from_arrays([*carried, *typed], names)

    return texts.select(*keep, column).mapInArrow(work, kept + schema)


def case_texts(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "ISO-8859-1").alias("text"))


def read_case(spark: SparkSession, path: str, section: str) -> DataFrame:
    """Typed records of one section of the case file, folder or glob at ``path``."""
    from gridlake.sources.case_source import arrow_path, scan

    known = arrow_path(spark, path)
    if known is None:
        return parsed(case_texts(spark, path), "text", section)
    return section_of(scan(spark, known, [section]), section)


def section_of(scan: DataFrame, section: str) -> DataFrame:
    """The typed records of one section in a scan of the source ``case``."""
    name = section.lower()
    rows = scan.filter((F.col("section") == section) & F.col(name).isNotNull())
    return rows.select("rec_no", *(f"{name}.{c}" for c, _ in columns(section)[1:]))


def read_sections(spark: SparkSession, path: str, *sections: str) -> dict[str, DataFrame]:
    """Typed records of several sections by name.

    The files are parsed once into a table that has a folder for each section in the shared folder, so
    that a stage reads only the sections and columns it uses.
    """
    from gridlake.session import written
    from gridlake.sources.case_source import arrow_path, scan

    known = arrow_path(spark, path)
    if known is None:
        texts = case_texts(spark, path)
        return {s: parsed(texts, "text", s) for s in sections}
    stage = written(scan(spark, known, list(sections)), "case", "section")
    return {s: section_of(stage, s) for s in sections}


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """The title, the third line of each case."""
    return case_texts(spark, path).select("path", F.split("text", "\r?\n")[2].alias("title"))


def corrupt_records(spark: SparkSession, path: str, section: str) -> DataFrame:
    """(path, line): the first line of every record that cannot be parsed."""
    from gridlake.sources.case_source import arrow_path, scan

    known = arrow_path(spark, path)
    if known is not None:
        rows = scan(spark, known, [section]).filter((F.col("section") == section) & F.col("corrupt").isNotNull())
        return rows.select("path", F.col("corrupt").alias("line"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bad = [line for _, line, record in records(text or "", section) if record is None]
                yield pa.RecordBatch.from_arrays([pa.array([source] * len(bad), pa.string()), pa.array(bad, pa.string())], ["path", "line"])

    return case_texts(spark, path).select("path", "text").mapInArrow(work, "path string, line string")


def slice_section(text: Column, begin: str, end: str) -> Column:
    """Trimmed record lines between two markers as an array of (number, line), natively."""
    body = F.substring_index(F.substring_index(text, begin, -1), end, 1)
    lines = F.transform(F.split(body, "\n"), lambda x, i: F.struct(i.alias("n"), F.trim(x).alias("line")))
    return F.filter(lines, lambda x: (x["line"] != "") & ~x["line"].startswith("@") & ~x["line"].startswith("0 /"))


def from_record(line: Column, schema: str) -> Column:
    """A one-line record as a struct; quoted names may hold commas."""
    return F.from_csv(line, schema, {"quote": "'", "ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE"})
