"""Points and lines as well-known text, and their binary form for the GeoPackage sink."""

from __future__ import annotations

import re
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlake.config import SRID

NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
LINE = rf"^\s*LINESTRING\s*\(\s*{NUMBER}\s+{NUMBER}(?:\s*,\s*{NUMBER}\s+{NUMBER})+\s*\)\s*$"


def fixed(x: Column, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def point_wkt(lon: Column, lat: Column) -> Column:
    """POINT text, null if a coordinate is."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.lit("POINT ("), fixed(lon), F.lit(" "), fixed(lat), F.lit(")")))


def segment_wkt(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    known = lon0.isNotNull() & lat0.isNotNull() & lon1.isNotNull() & lat1.isNotNull()
    text = F.concat(
        F.lit("LINESTRING ("), fixed(lon0), F.lit(" "), fixed(lat0), F.lit(", "), fixed(lon1), F.lit(" "), fixed(lat1), F.lit(")")
    )
    return F.when(known, text)


def flat_parts(parts: Column) -> Column:
    """Coordinates of a multi-part line as one list."""
    return F.flatten(parts)


def line_wkt(coordinates: Column) -> Column:
    """LINESTRING text of an array of [x, y]; empty text for no coordinates."""
    pairs = F.transform(coordinates, lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string")))
    text = F.concat(F.lit("LINESTRING ("), F.array_join(pairs, ", "), F.lit(")"))
    return F.when(F.coalesce(F.size(coordinates), F.lit(0)) > 0, text).otherwise("")


def valid_line(wkt: Column) -> Column:
    """The text if it is a line, else null."""
    return F.when(wkt.rlike(LINE), wkt)


def to_wkb(wkt: str) -> bytes:
    """Little-endian WKB of POINT or LINESTRING text."""
    kind, _, body = wkt.strip().partition("(")
    values = [float(x) for x in re.findall(NUMBER, body)]
    points = list(zip(values[::2], values[1::2], strict=True))
    if kind.strip().upper() == "POINT":
        return struct.pack("<BIdd", 1, 1, *points[0])
    return struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<dd", *p) for p in points)


def to_gpkg(wkt: str, srid: int = SRID) -> bytes:
    """WKB behind a GeoPackage header without an envelope."""
    return b"GP" + struct.pack("<BBi", 0, 1, srid) + to_wkb(wkt)


def from_gpkg(blob: bytes) -> str:
    """POINT or LINESTRING text of a GeoPackage geometry, with or without an envelope."""
    at = 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    order = "<" if blob[at] else ">"
    kind = struct.unpack_from(f"{order}I", blob, at + 1)[0]
    n, at = (1, at + 5) if kind == 1 else (struct.unpack_from(f"{order}I", blob, at + 5)[0], at + 9)
    values = struct.unpack_from(f"{order}{2 * n}d", blob, at)
    pairs = ", ".join(f"{x!r} {y!r}" for x, y in zip(values[::2], values[1::2], strict=True))
    return f"{'POINT' if kind == 1 else 'LINESTRING'} ({pairs})"
