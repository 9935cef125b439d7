"""``format("netcdf")``: tables as netCDF classic files (64-bit offsets), written by tasks and read in slices.

A file holds components (tables).  A component ``buses`` has the dimension ``buses_i``, its index as the
characters ``buses_i`` and each column as a variable ``buses_<column>``; text is characters of the
width of the longest value, numbers are doubles with NaN for missing ones, flags are bytes.

Writing: rows come range-partitioned and sorted by (component, name).  The number of rows and the widths
of text are counted first, so the header and all offsets are known; each task writes the bytes of its
rows column by column into files of its own, and the commit copies them behind the header in blocks
and moves the file to its place.  A write that fails removes its task files and leaves what was there.

Reading: the planner reads the header and cuts a component into ranges of rows; a task reads the asked
columns' bytes of its range.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridlake.sources.stores import begin, drop, opened

# Tags and type codes of the classic format.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
BYTE, CHAR, DOUBLE = 1, 2, 6
WIDTH = {BYTE: 1, CHAR: 1, DOUBLE: 8}

COPY = 4 << 20
ROWS = 100_000


def _pad(n: int) -> int:
    return -n % 4


def _name(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * _pad(len(raw))


def _list(tag: int, items: list[bytes]) -> bytes:
    return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)


def _attributes(values: dict[str, str]) -> bytes:
    return _list(ATTRIBUTES, [_name(k) + struct.pack(">i", CHAR) + _name(v) for k, v in values.items()])


@dataclass
class Variable:
    """A variable of the file; ``wide`` is the width of text, 0 for numbers."""

    component: str
    column: str
    kind: int
    wide: int
    rows: int
    attributes: dict[str, str]
    begin: int = 0

    @property
    def name(self) -> str:
        return f"{self.component}_i" if self.column == "name" else f"{self.component}_{self.column}" if self.column else self.component

    @property
    def each(self) -> int:
        return max(self.wide, 1) * WIDTH[self.kind]

    @property
    def size(self) -> int:
        return self.rows * self.each


def header(variables: list[Variable], attributes: dict[str, str]) -> bytes:
    """The header, and ``begin`` of each variable set to its place behind it."""
    dims: dict[str, int] = {}
    for v in variables:
        dims[f"{v.component}_i" if v.column else v.component] = v.rows
    for v in variables:
        if v.kind == CHAR:
            dims[f"width_{v.wide}"] = v.wide
    order = list(dims)

    def made() -> bytes:
        rows = []
        for v in variables:
            of = [order.index(f"{v.component}_i" if v.column else v.component)] + ([order.index(f"width_{v.wide}")] if v.kind == CHAR else [])
            size = min(v.size + _pad(v.size), (1 << 32) - 1)
            rows.append(_name(v.name) + struct.pack(f">i{len(of)}i", len(of), *of) + _attributes(v.attributes) + struct.pack(">iIq", v.kind, size, v.begin))
        sizes = [_name(d) + struct.pack(">i", n) for d, n in dims.items()]
        return b"CDF\x02" + struct.pack(">i", 0) + _list(DIMENSIONS, sizes) + _attributes(attributes) + _list(VARIABLES, rows)

    at = len(made())
    for v in variables:
        v.begin = at
        at += v.size + _pad(v.size)
    return made()


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its number, and the rows of each component."""

    task: int
    folder: str
    rows: dict[str, int]


def encoded(values: pa.Array, v: Variable) -> bytes:
    if v.kind == CHAR:
        raw = [(x or "").encode() for x in values.to_pylist()]
        if any(len(r) > v.wide for r in raw):
            raise ValueError(f"text of {v.name} is longer than {v.wide} bytes")
        return b"".join(r.ljust(v.wide, b"\0") for r in raw)
    if v.kind == BYTE:
        return values.cast(pa.int8()).fill_null(0).to_numpy(zero_copy_only=False).tobytes()
    return values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(">f8").tobytes()


class NetcdfWriter(DataSourceArrowWriter):
    """``layout``: per component its rows and [column, type, width of text]; rows have ``component``, ``name`` and a struct ``row_<component>``."""

    def __init__(self, path: str, layout: dict, attributes: dict, overwrite: bool):
        self.path, self.layout, self.attributes, self.overwrite = path, layout, attributes, overwrite
        self.folder = f"{path}._writing-{uuid.uuid4().hex}"
        begin(self.folder)

    def variables(self) -> list[Variable]:
        out = []
        for component, (rows, columns) in self.layout.items():
            for column, kind, wide in columns:
                out.append(Variable(component, column, kind, wide, rows, {}))
        out.append(Variable("snapshots", "", DOUBLE, 0, 1, {"units": "hours since 2024-01-01 00:00:00", "calendar": "proleptic_gregorian"}))
        return out

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        store, folder = opened(self.folder)
        folder = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(folder, recursive=False)
        held: dict[str, pa.NativeFile] = {}
        rows = dict.fromkeys(self.layout, 0)
        by = {}
        for v in self.variables():
            by.setdefault(v.component, []).append(v)
        for batch in iterator:
            component = batch.column("component").to_pylist()
            for c in dict.fromkeys(component):
                at = [i for i, x in enumerate(component) if x == c]
                part = batch.take(pa.array(at, pa.int64()))
                rows[c] += len(at)
                data = part.column(f"row_{c}")
                for v in by[c]:
                    if v.name not in held:
                        held[v.name] = store.open_output_stream(f"{folder}/{v.name}")
                    values = part.column("name") if v.column == "name" else data.field(v.column)
                    held[v.name].write(encoded(values, v))
        for file in held.values():
            file.close()
        return Written(context.partitionId(), folder, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, target = opened(self.path)
        _, folder = opened(self.folder)
        done = sorted((m for m in messages if m), key=lambda m: m.task)
        for component, (rows, _) in self.layout.items():
            if sum(m.rows[component] for m in done) != rows:
                self.abort(messages)
                raise ValueError(f"{component} has other rows than were counted")
        variables = self.variables()
        top = header(variables, self.attributes)
        whole = f"{folder}/whole"
        with store.open_output_stream(whole) as out:
            out.write(top)
            for v in variables:
                size = 0
                if not v.column:
                    size = out.write(struct.pack(">d", 0.0))
                for m in done if v.column else []:
                    if not m.rows[v.component]:
                        continue
                    with store.open_input_stream(f"{m.folder}/{v.name}") as file:
                        while block := file.read(COPY):
                            size += out.write(block)
                if size != v.size:
                    raise ValueError(f"{v.name} has {size} bytes instead of {v.size}")
                out.write(b"\0" * _pad(size))
        store.move(whole, target)
        drop(self.folder)

    def abort(self, messages) -> None:
        drop(self.folder)


# ---- reading


class Header:
    """Dimensions, attributes and variables of a classic file, read from its first bytes."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        magic = file.read(4)
        if magic not in (b"CDF\x01", b"CDF\x02"):
            raise ValueError("this is no netCDF classic file")
        self.offset = ">q" if magic == b"CDF\x02" else ">i"
        self._int()
        self.dimensions = self._items(DIMENSIONS, lambda: (self._text(), self._int()))
        self.attributes = dict(self._items(ATTRIBUTES, self._attribute))
        self.variables = {name: found for name, found in self._items(VARIABLES, self._variable)}

    def _int(self) -> int:
        return struct.unpack(">i", self.file.read(4))[0]

    def _text(self) -> str:
        n = self._int()
        return self.file.read(n + _pad(n))[:n].decode()

    def _items(self, tag: int, one) -> list:
        found, n = self._int(), self._int()
        if found not in (0, tag):
            raise ValueError("the header is broken")
        return [one() for _ in range(n)]

    def _attribute(self) -> tuple[str, str]:
        name, kind = self._text(), self._int()
        if kind == CHAR:
            return name, self._text()
        n = self._int() * WIDTH.get(kind, 4 if kind in (4, 5) else 2)
        self.file.read(n + _pad(n))
        return name, ""

    def _variable(self) -> tuple[str, tuple]:
        name = self._text()
        shape = [self.dimensions[self._int()][1] for _ in range(self._int())]
        self._items(ATTRIBUTES, self._attribute)
        kind, _ = self._int(), self._int()
        width = struct.calcsize(self.offset)
        return name, (kind, shape, struct.unpack(self.offset, self.file.read(width))[0])

    def columns(self, component: str) -> dict[str, tuple]:
        """(kind, shape, begin) of a component's variables by column; the index is ``name``."""
        index = f"{component}_i"
        if index not in self.variables:
            raise ValueError(f"there is no component {component}")
        own = {n.removeprefix(f"{component}_"): v for n, v in self.variables.items() if n.startswith(f"{component}_") and n != index}
        return {"name": self.variables[index]} | own


@dataclass
class Slice(InputPartition):
    first: int
    last: int


class NetcdfReader(DataSourceReader):
    def __init__(self, path: str, component: str, names: list[str]):
        self.path, self.component, self.names = path, component, names

    def _columns(self) -> dict[str, tuple]:
        store, inside = opened(self.path)
        with store.open_input_file(inside) as file:
            return Header(file).columns(self.component)

    def partitions(self) -> list[Slice]:
        n = self._columns()["name"][1][0]
        return [Slice(a, min(a + ROWS, n)) for a in range(0, n, ROWS)] or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        columns, n = self._columns(), partition.last - partition.first
        if not n:
            return
        store, inside = opened(self.path)
        out = []
        with store.open_input_file(inside) as file:
            for name in self.names:
                kind, shape, begin = columns[name]
                each = WIDTH[kind] * int(np.prod(shape[1:]))
                file.seek(begin + partition.first * each)
                raw = file.read(n * each)
                if kind == CHAR:
                    out.append(pa.array([raw[i * each : (i + 1) * each].rstrip(b"\0").decode() for i in range(n)], pa.string()))
                elif kind == BYTE:
                    out.append(pa.array(np.frombuffer(raw, np.int8) != 0))
                else:
                    values = np.frombuffer(raw, ">f8").astype(float)
                    out.append(pa.array(values, mask=np.isnan(values)))
        yield pa.RecordBatch.from_arrays(out, self.names)


class NetcdfSource(DataSource):
    """Options: ``path``; to read, ``component``; to write, ``layout`` and ``attributes`` as JSON (see ``sinks.netcdf``)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        store, inside = opened(self.options["path"])
        with store.open_input_file(inside) as file:
            columns = Header(file).columns(self.options["component"])
        return ", ".join(f"`{c}` {({CHAR: 'string', BYTE: 'boolean', DOUBLE: 'double'})[k]}" for c, (k, _, _) in columns.items())

    def reader(self, schema) -> NetcdfReader:
        return NetcdfReader(self.options["path"], self.options["component"], list(schema.names))

    def writer(self, schema, overwrite: bool) -> NetcdfWriter:
        return NetcdfWriter(self.options["path"], json.loads(self.options["layout"]), json.loads(self.options.get("attributes", "{}")), overwrite)
