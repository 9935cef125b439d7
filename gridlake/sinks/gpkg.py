"""``format("gpkg")``: map layers in a GeoPackage, with extents and a spatial index, written and read.

Tasks turn well-known text into binary geometries with their bounds and write them as small databases;
the commit takes these into the file by set statements, a database at a time, fills the layer's R-tree
and extent from their bounds, and moves the file to its place.  A layer that fails leaves the file as it was.

Reading gives a layer's columns with the geometry as text, in ranges of feature numbers; with a ``window`` only
features that the spatial index finds in it are read, and only those whose bounds meet it are kept.
"""

from __future__ import annotations

import re
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from gridlake.config import SRID
from gridlake.functions.geometry import NUMBER, from_gpkg, to_gpkg
from gridlake.session import ship
from gridlake.sources.stores import begin, drop, opened

_TABLES = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL,
  organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE,
  description TEXT DEFAULT '', last_change DATETIME NOT NULL DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')),
  min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL,
  srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
CREATE TABLE gpkg_extensions (table_name TEXT, column_name TEXT, extension_name TEXT NOT NULL, definition TEXT NOT NULL,
  scope TEXT NOT NULL, UNIQUE (table_name, column_name, extension_name));
"""
_SQL_TYPES = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "BOOLEAN", "double": "REAL", "float": "REAL"}
_BOUNDS = ("min_x", "max_x", "min_y", "max_y")
_RTREE = ("gpkg_rtree_index", "http://www.geopackage.org/spec120/#extension_rtree", "write-only")
COPY = 4 << 20
FIDS = 100_000  # features of one partition


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(path, isolation_level=None)
    if not db.execute("SELECT count(*) FROM sqlite_master WHERE name = 'gpkg_contents'").fetchone()[0]:
        db.execute(f"PRAGMA application_id = {0x47504B47}")
        db.execute("PRAGMA user_version = 10300")
        db.executescript(_TABLES)
        rows = [("Undefined", -1, "NONE", -1), ("Undefined", 0, "NONE", 0), ("WGS 84", SRID, "EPSG", SRID)]
        db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", rows)
    return db


def bounds(wkt: str) -> tuple[float, float, float, float]:
    values = [float(x) for x in re.findall(NUMBER, wkt)]
    return min(values[::2]), max(values[::2]), min(values[1::2]), max(values[1::2])


def _copy(source, target) -> None:
    while block := source.read(COPY):
        target.write(block)


@dataclass
class Part(WriterCommitMessage):
    path: str | None
    task: int
    kinds: tuple[str, ...]


class GpkgWriter(DataSourceArrowWriter):
    def __init__(self, path: str, layer: str, wkt: str, columns: list[tuple[str, str]], fresh: bool):
        self.path, self.layer, self.wkt, self.columns, self.fresh = path, layer, wkt, columns, fresh
        self.folder = f"{path}._writing-{uuid.uuid4().hex}"
        begin(self.folder)

    @property
    def names(self) -> str:
        return ", ".join(quoted(n) for n in ("geom", *(n for n, _ in self.columns)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context, kinds = TaskContext.get(), set()
        with tempfile.TemporaryDirectory() as own:
            db = sqlite3.connect(f"{own}/part", isolation_level=None)
            typed = ", ".join([f"{quoted(n)} {t}" for n, t in (("geom", "BLOB"), *self.columns, *((b, "REAL") for b in _BOUNDS))])
            db.execute(f"CREATE TABLE part ({typed})")
            db.execute("BEGIN")
            put = f"INSERT INTO part VALUES ({', '.join('?' * (len(self.columns) + 5))})"
            for batch in iterator:
                texts = batch.column(self.wkt).to_pylist()
                kinds |= {t.split("(")[0].strip().upper() for t in texts}
                data = [batch.column(n).to_pylist() for n, _ in self.columns]
                plain = [v if t != "TEXT" else [x if x is None else str(x) for x in v] for v, (_, t) in zip(data, self.columns, strict=True)]
                db.executemany(put, zip(map(to_gpkg, texts), *plain, *zip(*map(bounds, texts), strict=True), strict=True) if texts else ())
            db.execute("COMMIT")
            db.close()
            if not kinds:
                return Part(None, context.partitionId(), ())
            store, folder = opened(self.folder)
            path = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"
            with open(f"{own}/part", "rb") as source, store.open_output_stream(path) as target:
                _copy(source, target)
        return Part(path, context.partitionId(), tuple(kinds))

    def commit(self, messages: list[Part | None]) -> None:
        store, target = opened(self.path)
        _, folder = opened(self.folder)
        parts = sorted((m for m in messages if m and m.path), key=lambda m: m.task)
        with tempfile.TemporaryDirectory() as own:
            path = f"{own}/whole"
            if not self.fresh and store.get_file_info(target).type == pafs.FileType.File:
                with store.open_input_stream(target) as source, open(path, "wb") as out:
                    _copy(source, out)
            db = _open(path)
            self._take(db, store, own, parts)
            db.close()
            with open(path, "rb") as source, store.open_output_stream(f"{folder}/whole") as out:
                _copy(source, out)
        store.move(f"{folder}/whole", target)
        drop(self.folder)

    def _take(self, db: sqlite3.Connection, store: pafs.FileSystem, own: str, parts: list[Part]) -> None:
        table, tree = quoted(self.layer), quoted(f"rtree_{self.layer}_geom")
        typed = "".join(f", {quoted(n)} {t}" for n, t in self.columns)
        db.execute(f"CREATE TABLE {table} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{typed})")
        db.execute(f"CREATE VIRTUAL TABLE {tree} USING rtree(id, minx, maxx, miny, maxy)")
        n, ends = 0, []
        for m in parts:
            with store.open_input_stream(m.path) as source, open(f"{own}/part", "wb") as out:
                _copy(source, out)
            db.execute("ATTACH ? AS p", (f"{own}/part",))
            db.execute("BEGIN")
            db.execute(f"INSERT INTO {table} ({self.names}) SELECT {self.names} FROM p.part ORDER BY rowid")
            db.execute(f"INSERT INTO {tree} SELECT rowid + ?, {', '.join(_BOUNDS)} FROM p.part", (n,))
            rows, *end = db.execute("SELECT count(*), min(min_x), min(min_y), max(max_x), max(max_y) FROM p.part").fetchone()
            db.execute("COMMIT")
            db.execute("DETACH p")
            n += rows
            ends.append(end)
        extent = [f(e[i] for e in ends) if ends else None for i, f in enumerate((min, min, max, max))]
        kinds = {k for m in parts for k in m.kinds}
        kind = kinds.pop() if len(kinds) == 1 else "GEOMETRY"
        db.execute(
            "INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)",
            (self.layer, self.layer, *extent, SRID),
        )
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?, ?, 0, 0)", (self.layer, kind, SRID))
        db.execute("INSERT INTO gpkg_extensions VALUES (?, 'geom', ?, ?, ?)", (self.layer, *_RTREE))
        # the index follows what a map program edits; such programs bring the ST_ functions
        entry = f"INSERT OR REPLACE INTO {tree} VALUES (NEW.fid, ST_MinX(NEW.geom), ST_MaxX(NEW.geom), ST_MinY(NEW.geom), ST_MaxY(NEW.geom));"
        gone = f"DELETE FROM {tree} WHERE id = OLD.fid;"
        some = "NEW.geom NOT NULL AND NOT ST_IsEmpty(NEW.geom)"
        for name, when, what in (("insert", f"AFTER INSERT ON {table} WHEN {some}", entry), ("delete", f"AFTER DELETE ON {table} WHEN OLD.geom NOT NULL", gone)):
            db.execute(f"CREATE TRIGGER {quoted(f'rtree_{self.layer}_geom_{name}')} {when} BEGIN {what} END")
        for name, when, what in (("update1", some, gone + entry), ("update2", f"NOT ({some})", gone)):
            db.execute(f"CREATE TRIGGER {quoted(f'rtree_{self.layer}_geom_{name}')} AFTER UPDATE ON {table} WHEN {when} BEGIN {what} END")

    def abort(self, messages) -> None:
        drop(self.folder)


@dataclass
class Fids(InputPartition):
    first: int
    last: int


class GpkgReader(DataSourceReader):
    def __init__(self, path: str, layer: str, wkt: str, window: list[float] | None, schema):
        self.path, self.layer, self.wkt, self.window, self.schema = path, layer, wkt, window, schema

    def partitions(self) -> list[Fids]:
        with opened_file(self.path) as db:
            last = db.execute(f"SELECT coalesce(max(fid), 0) FROM {quoted(self.layer)}").fetchone()[0]
        return [Fids(a, min(a + FIDS, last + 1)) for a in range(1, last + 1, FIDS)] or [Fids(1, 1)]

    def read(self, partition: Fids) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        names = [f.name for f in kinds]
        asked = ", ".join("geom" if n == self.wkt else quoted(n) for n in ["geom", *names])
        where, values = "fid >= ? AND fid < ?", [partition.first, partition.last]
        if self.window:
            where += f" AND fid IN (SELECT id FROM {quoted(f'rtree_{self.layer}_geom')} WHERE id >= ? AND id < ? AND maxx >= ? AND minx <= ? AND maxy >= ? AND miny <= ?)"
            values += [partition.first, partition.last, *self.window]
        with opened_file(self.path) as db:
            found = db.execute(f"SELECT {asked} FROM {quoted(self.layer)} WHERE {where} ORDER BY fid", values)
            while rows := found.fetchmany(10_000):
                texts = [from_gpkg(r[0]) for r in rows]
                if self.window:
                    x0, x1, y0, y1 = self.window
                    ends = map(bounds, texts)
                    keep = [a <= x1 and b >= x0 and c <= y1 and d >= y0 for a, b, c, d in ends]
                    rows, texts = ([v for v, k in zip(held, keep, strict=True) if k] for held in (rows, texts))
                data = [texts if n == self.wkt else [bool(r[i]) if pa.types.is_boolean(f.type) and r[i] is not None else r[i] for r in rows] for i, (n, f) in enumerate(zip(names, kinds, strict=True), 1)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(data, kinds, strict=True)], schema=kinds)


@contextmanager
def opened_file(path: str) -> Iterator[sqlite3.Connection]:
    """The file as a database for reading; from a store that is not local, a copy of it."""
    store, inside = opened(path)
    with tempfile.TemporaryDirectory() as own:
        if not isinstance(store, pafs.LocalFileSystem):
            with store.open_input_stream(inside) as source, open(f"{own}/whole", "wb") as out:
                _copy(source, out)
            inside = f"{own}/whole"
        db = sqlite3.connect(f"file:{quote(inside)}?mode=ro", uri=True)
        try:
            yield db
        finally:
            db.close()


class GpkgSource(DataSource):
    """Options: ``path``, ``layer``, ``wkt`` (the geometry's column); to write, ``fresh`` (a new file); to read, ``window`` (x0,x1,y0,y1)."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        with opened_file(self.options["path"]) as db:
            found = db.execute(f"PRAGMA table_info({quoted(self.options['layer'])})").fetchall()
        if not found:
            raise ValueError(f"{self.options['path']} has no layer {self.options['layer']}")
        back = {"INTEGER": "bigint", "BOOLEAN": "boolean", "REAL": "double"}
        columns = [(self.options.get("wkt", "geometry"), "string") if n == "geom" else (n, back.get(t, "string")) for _, n, t, *_ in found]
        return ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in columns)

    def reader(self, schema) -> GpkgReader:
        window = self.options.get("window")
        return GpkgReader(self.options["path"], self.options["layer"], self.options.get("wkt", "geometry"), [float(x) for x in window.split(",")] if window else None, schema)

    def writer(self, schema, overwrite: bool) -> GpkgWriter:
        wkt = self.options.get("wkt", "geometry")
        columns = [(f.name, _SQL_TYPES.get(f.dataType.simpleString(), "TEXT")) for f in schema.fields if f.name != wkt]
        return GpkgWriter(self.options["path"], self.options["layer"], wkt, columns, self.options.get("fresh", "false") == "true")


def write_layer(df: DataFrame, path: str, layer: str, wkt: str = "geometry", fresh: bool = False) -> int:
    """Writes the rows with a geometry as a layer and returns their number, counted on the way."""
    from gridlake.sinks.netcdf import qualified

    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(GpkgSource)
    seen = Observation()
    rows = df.filter(f"`{wkt}` IS NOT NULL AND `{wkt}` != ''").observe(seen, F.count(F.lit(1)).alias("n"))
    options = {"layer": layer, "wkt": wkt, "fresh": str(fresh).lower()}
    rows.write.format("gpkg").mode("append").options(**options).save(qualified(spark, path))
    return seen.get["n"]


def read_layer(spark: SparkSession, path: str, layer: str, window: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A layer's features, of a window (x0, x1, y0, y1) where one is given."""
    from gridlake.sinks.netcdf import qualified

    ship(spark)
    spark.dataSource.register(GpkgSource)
    reader = spark.read.format("gpkg").option("layer", layer)
    reader = reader.option("window", ",".join(map(repr, map(float, window)))) if window else reader
    return reader.load(qualified(spark, path))
