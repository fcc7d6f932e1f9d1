"""Fields in array files as a data source: ``.npy``, ``.npz`` and classic NetCDF, read by byte ranges.

``spark.read.format("array_fields").option("path", ..).load()`` gives (date,
values) rows, a row for each step of a file's first axis. Files are planned on
the driver from their headers alone; a partition is a run of at most
``block_days`` steps of one file, and a task reads its bytes and nothing else.
Comparisons of ``date`` reach the plan: blocks without a wanted date are no
partitions. Options: ``path`` (files or folders, separated by commas),
``variable`` (names to look for, whatever their case), ``block_days``,
``start_date`` (date of the first step of ``.npy`` and ``.npz`` files, whose
steps are days).

Values that are a variable's fill or missing value, NaN or infinite are null;
``scale_factor`` and ``add_offset`` are applied. Axes of one element, as of a
level, are dropped; a variable with other axes beside time, rows and columns is
an error. Paths are those that every machine can open.
"""

from __future__ import annotations

import ast
import datetime as dt
import os
import re
import struct
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..session import ship

FORMAT = "array_fields"
SCHEMA = "date date, values array<double>"
BLOCK_DAYS = 31
# Names that variables and axes go by.
VARIABLES = ("sst", "SST", "sea_surface_temperature", "analysed_sst")
TIMES = ("time", "date")
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_UNIX = dt.date(1970, 1, 1)


@dataclass(frozen=True)
class Layout:
    """Where a file's fields are: step k begins at ``begin + k * stride`` (in ``member``, if the file is an archive)."""

    path: str
    begin: int
    stride: int
    cells: int
    kind: str
    days: tuple[int, ...]  # of each step, since 1970-01-01
    scale: float = 1.0
    offset: float = 0.0
    missing: tuple[float, ...] = ()
    member: str | None = None


def _npy_header(f: BinaryIO) -> tuple[tuple[int, ...], str]:
    """(shape, type) of an array file; ``f`` then stands at its first value."""
    if f.read(6) != b"\x93NUMPY":
        raise ValueError("no array file")
    major = f.read(2)[0]
    size = struct.unpack("<H", f.read(2))[0] if major == 1 else struct.unpack("<I", f.read(4))[0]
    head = ast.literal_eval(f.read(size).decode("latin1" if major < 3 else "utf-8"))
    if head["fortran_order"]:
        raise ValueError("arrays must be stored row by row")
    if np.dtype(head["descr"]).hasobject:
        raise ValueError("arrays of objects are not read")
    return tuple(head["shape"]), head["descr"]


def _fields_of(shape: Sequence[int]) -> int:
    """Cells of a field with the axes (time, .., rows, columns), all others of one element."""
    if len([n for n in shape[1:-2] if n != 1]) or len(shape) < 3:
        raise ValueError(f"an array of the shape {tuple(shape)} has no fields by time, row and column")
    return int(shape[-2] * shape[-1])


def _days(start: str | None, n: int) -> tuple[int, ...]:
    if not start:
        raise ValueError("array files need the option start_date")
    first = (dt.date.fromisoformat(start) - _UNIX).days
    return tuple(range(first, first + n))


def npy_layout(path: str, start: str | None) -> Layout:
    with open(path, "rb") as f:
        shape, kind = _npy_header(f)
        cells = _fields_of(shape)
        return Layout(path, f.tell(), cells * np.dtype(kind).itemsize, cells, kind, _days(start, shape[0]))


def npz_layout(path: str, names: Sequence[str], start: str | None) -> Layout:
    with zipfile.ZipFile(path) as z:
        by_name = {n.removesuffix(".npy").lower(): n for n in z.namelist()}
        member = next((by_name[n.lower()] for n in names if n.lower() in by_name), None)
        if member is None:
            raise KeyError(f"{path} has none of {', '.join(names)}")
        with z.open(member) as f:
            shape, kind = _npy_header(f)
            begin = f.tell()
    cells = _fields_of(shape)
    return Layout(path, begin, cells * np.dtype(kind).itemsize, cells, kind, _days(start, shape[0]), member=member)


class Classic:
    """The header of a classic NetCDF file (versions 1, 2 and 5)."""

    def __init__(self, f: BinaryIO):
        self.f = f
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("no classic NetCDF file")
        self.version = magic[3]
        self.wide = ">q" if self.version == 5 else ">i"
        self.records = self._number()
        self.dims = self._list(0x0A, lambda: (self._name(), self._number()))
        self.attributes = dict(self._list(0x0C, self._attribute))
        self.variables = dict(self._list(0x0B, self._variable))
        growing = [v for v in self.variables.values() if self._grows(v)]
        self.record = growing[0]["exact"] if len(growing) == 1 else sum(v["size"] for v in growing)

    def _number(self, form: str | None = None) -> int:
        form = form or self.wide
        return struct.unpack(form, self.f.read(struct.calcsize(form)))[0]

    def _padded(self, n: int) -> bytes:
        raw = self.f.read(n)
        self.f.read(-n % 4)
        return raw

    def _name(self) -> str:
        return self._padded(self._number()).decode()

    def _list(self, tag: int, read) -> list:
        found, n = self._number(">i"), self._number()
        if found not in (0, tag) or (found == 0 and n):
            raise ValueError("the header is damaged")
        return [read() for _ in range(n)]

    def _attribute(self) -> tuple[str, object]:
        name, kind, n = self._name(), np.dtype(_TYPES[self._number(">i")]), self._number()
        raw = self._padded(n * kind.itemsize)
        return name, raw.rstrip(b"\0").decode("utf-8", "replace") if kind.kind == "S" else np.frombuffer(raw, kind)

    def _variable(self) -> tuple[str, dict]:
        name = self._name()
        ids = [self._number() for _ in range(self._number())]
        attributes = dict(self._list(0x0C, self._attribute))
        kind = _TYPES[self._number(">i")]
        self._number()  # the size as stored, which is no use for large variables
        begin = self._number(">i" if self.version == 1 else ">q")
        lengths = [self.dims[k][1] for k in ids]
        exact = int(np.prod([n for k, n in enumerate(lengths) if n or k], dtype=np.int64)) * np.dtype(kind).itemsize
        return name, {"dims": [self.dims[k][0] for k in ids], "lengths": lengths, "kind": kind, "begin": begin, "attributes": attributes, "exact": exact, "size": -(-exact // 4) * 4}

    def _grows(self, v: dict) -> bool:
        return bool(v["lengths"]) and v["lengths"][0] == 0

    def shape(self, v: dict) -> list[int]:
        return [self.records if n == 0 else n for n in v["lengths"]]

    def step(self, v: dict) -> int:
        """Bytes from one entry of the first axis to the next."""
        return self.record if self._grows(v) else v["exact"] // max(v["lengths"][0], 1)

    def values(self, v: dict) -> np.ndarray:
        """All values of a variable of one axis."""
        kind, n, step = np.dtype(v["kind"]), self.shape(v)[0], self.step(v)
        out = np.empty(n, kind)
        for k in range(n):
            self.f.seek(v["begin"] + k * step)
            out[k] = np.frombuffer(self.f.read(kind.itemsize), kind)[0]
        return out

    def find(self, names: Sequence[str]) -> dict | None:
        by_name = {n.lower(): v for n, v in self.variables.items()}
        return next((by_name[n.lower()] for n in names if n.lower() in by_name), None)


def _since(units: str, values: np.ndarray) -> tuple[int, ...]:
    found = re.match(r"\s*(days?|hours?|seconds?)\s+since\s+(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?", units, re.I)
    if not found:
        raise ValueError(f"times in {units!r} are not read")
    each = {"d": 1.0, "h": 24.0, "s": 86400.0}[found[1][0].lower()]
    first = (dt.date(*(int(x) for x in found.group(2, 3, 4))) - _UNIX).days
    hour, minute, second = (int(x or 0) for x in found.group(5, 6, 7))
    return tuple(int(x) for x in np.floor(first + (hour + minute / 60 + second / 3600) / 24 + values.astype(float) / each + 1e-9))


def netcdf_layout(path: str, names: Sequence[str]) -> Layout:
    with open(path, "rb") as f:
        head = Classic(f)
        v, t = head.find(names), head.find(TIMES)
        if v is None or t is None:
            raise KeyError(f"{path} has no {'variable of ' + ', '.join(names) if v is None else 'time axis'}")
        shape = head.shape(v)
        cells, days = _fields_of(shape), _since(str(t["attributes"].get("units", "")), head.values(t))
        if len(days) != shape[0]:
            raise ValueError(f"{path} has {shape[0]} fields and {len(days)} times")
        one = lambda name, other: float(v["attributes"][name][0]) if name in v["attributes"] else other
        missing = tuple(float(x) for n in ("_FillValue", "missing_value") for x in v["attributes"].get(n, ()))
        return Layout(path, v["begin"], head.step(v), cells, v["kind"], days, one("scale_factor", 1.0), one("add_offset", 0.0), missing)


def layout_of(path: str, names: Sequence[str] = VARIABLES, start: str | None = None) -> Layout:
    if path.endswith(".npy"):
        return npy_layout(path, start)
    return npz_layout(path, names, start) if path.endswith(".npz") else netcdf_layout(path, names)


def files_of(path: str) -> list[str]:
    """The array files of a list of files and folders, in order of name."""
    out = []
    for p in (x.strip().removeprefix("file://") for x in path.split(",")):
        found = sorted(os.path.join(p, n) for n in os.listdir(p) if n.endswith((".npy", ".npz", ".nc"))) if os.path.isdir(p) else [p]
        out += found
    if not out:
        raise FileNotFoundError(f"no array files in {path}")
    return out


@dataclass
class Block(InputPartition):
    layout: Layout
    first: int
    end: int


class FieldsReader(DataSourceReader):
    def __init__(self, options: dict):
        names = tuple(x.strip() for x in options["variable"].split(",")) if options.get("variable") else VARIABLES
        self.layouts = [layout_of(p, names, options.get("start_date")) for p in files_of(options["path"])]
        self.block = int(options.get("block_days", BLOCK_DAYS))
        self.low, self.high, self.only = -(1 << 40), 1 << 40, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        day = lambda v: (v - _UNIX).days
        for f in filters:
            if getattr(f, "attribute", None) == ("date",):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual) and f.value is not None:
                    self.low = max(self.low, day(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual) and f.value is not None:
                    self.high = min(self.high, day(f.value) - isinstance(f, LessThan))
                if isinstance(f, In):
                    own = {day(v) for v in f.value if v is not None}
                    self.only = own if self.only is None else self.only & own
            yield f  # Spark applies them to the rows as well

    def _wanted(self, days: Sequence[int]) -> bool:
        return any(self.low <= d <= self.high and (self.only is None or d in self.only) for d in days)

    def partitions(self) -> list[Block]:
        found = [Block(x, lo, min(lo + self.block, len(x.days))) for x in self.layouts for lo in range(0, len(x.days), self.block)]
        found = [b for b in found if self._wanted(b.layout.days[b.first : b.end])]
        return found or [Block(self.layouts[0], 0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        x = partition.layout
        kind = np.dtype(x.kind)
        source = zipfile.ZipFile(x.path).open(x.member) if x.member else open(x.path, "rb")
        with source as f:
            for k in range(partition.first, partition.end):
                if not self._wanted(x.days[k : k + 1]):
                    continue
                f.seek(x.begin + k * x.stride)
                raw = f.read(x.cells * kind.itemsize)
                if len(raw) != x.cells * kind.itemsize:
                    raise ValueError(f"{x.path} ends inside of field {k}")
                stored = np.frombuffer(raw, kind).astype(float)
                gone = np.isin(stored, [m for m in x.missing if m == m])
                v = stored * x.scale + x.offset
                values = pa.array(v, mask=gone | ~np.isfinite(v))
                yield pa.record_batch([pa.array([x.days[k]], pa.int32()).cast(pa.date32()), pa.ListArray.from_arrays(pa.array([0, x.cells], pa.int32()), values)], names=["date", "values"])


class ArrayFields(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FieldsReader:
        return FieldsReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make ``format("array_fields")`` known to a session and let comparisons reach it."""
    ship(spark).dataSource.register(ArrayFields)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
