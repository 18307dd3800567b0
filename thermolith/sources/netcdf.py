"""Classic netCDF files (CDF-1, CDF-2 and CDF-5) as a Spark data source.

    spark.dataSource.register(netcdf.NetCdf)
    spark.read.format("netcdf").load("out/*.nc")

Rows are long: `indicator` (the variable's name), a column for each dimension with its coordinate, and `value`, null where the file
holds its fill value.  A file is read in slabs of bounded size along the variables' first dimension, each of which is a task
that reads its own bytes only; filters on the indicator or the first dimension are pushed down and leave slabs out before any
data is read.  Files of one read must have the same dimensions.  Character coordinates are strings.

Writing makes a file for each indicator and level, as maps by level are kept: rows must arrive clustered by these (`write` sees to
it).  Tasks write beside the target and the driver moves the files in when all have ended, so that lost tasks leave nothing.
netCDF-4 files are HDF5 and are not read."""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# Fixed values of the format: tags of lists, and types with their codes and the values that stand for none.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
FILL = {">f4": 9.969209968386869e36, ">f8": 9.969209968386869e36, ">i2": -32767, ">i4": -2147483647, ">i8": -9223372036854775806}
CHAR, DOUBLE = 2, 6


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def expand(path: str) -> list[str]:
    """The .nc files of a folder, of a path with * in its last part, or the path itself."""
    system, name = located(path)
    head, _, last = name.rpartition("/")
    if "*" in last:
        import fnmatch

        found = [f.path for f in system.get_file_info(fs.FileSelector(head or "/")) if fnmatch.fnmatch(f.base_name, last)]
    elif system.get_file_info(name).type == fs.FileType.Directory:
        found = [f.path for f in system.get_file_info(fs.FileSelector(name, recursive=True)) if f.base_name.endswith(".nc")]
    else:
        found = [name]
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted(prefix + f for f in found)


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    type: str
    begin: int
    shape: list[int]
    stride: int  # bytes from one entry of the first dimension to the next


class Header:
    """Dimensions and variables of a file, from its first bytes."""

    def __init__(self, file):
        self.file = file
        magic = file.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("no classic netCDF file" + (": netCDF-4 is HDF5" if magic == b"\x89HDF" else ""))
        self.count = ">q" if magic[3] == 5 else ">i"
        self.offset = ">i" if magic[3] == 1 else ">q"
        self.records = self._number(self.count)
        self.dims = [(self._name(), self._number(self.count)) for _ in range(self._list(DIMENSIONS))]
        self.attributes = self._attributes()
        raw = []
        for _ in range(self._list(VARIABLES)):
            name = self._name()
            dims = [self._number(self.count) for _ in range(self._number(self.count))]
            raw.append((name, dims, self._attributes(), TYPES[self._number(">i")], self._number(self.count), self._number(self.offset)))
        of_records = [v for v in raw if v[1] and not self.dims[v[1][0]][1]]
        # records of all such variables stand side by side; of a single one they aren't padded
        sizes = [np.dtype(v[3]).itemsize * math.prod(self.dims[d][1] for d in v[1][1:]) for v in of_records]
        record = sum(-(-n // 4) * 4 for n in sizes) if len(sizes) > 1 else sum(sizes)
        self.variables = {}
        for name, dims, attributes, kind, _, begin in raw:
            shape = [self.dims[d][1] or self.records for d in dims]
            inner = np.dtype(kind).itemsize * math.prod(shape[1:])
            self.variables[name] = Variable(name, dims, attributes, kind, begin, shape, record if dims and not self.dims[dims[0]][1] else inner)

    def _number(self, kind: str) -> int:
        return struct.unpack(kind, self.file.read(struct.calcsize(kind)))[0]

    def _name(self) -> str:
        n = self._number(self.count)
        return self.file.read(-(-n // 4) * 4)[:n].decode()

    def _list(self, tag: int) -> int:
        found, n = self._number(">i"), self._number(self.count)
        if found not in (0, tag):
            raise ValueError("a damaged netCDF header")
        return n

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(ATTRIBUTES)):
            name, kind, n = self._name(), TYPES[self._number(">i")], self._number(self.count)
            data = self.file.read(-(-n * np.dtype(kind).itemsize // 4) * 4)
            out[name] = data[:n].decode() if kind == "S1" else np.frombuffer(data, kind, n)
        return out

    def data(self, v: Variable, first: int = 0, last: int | None = None) -> np.ndarray:
        """Entries first to last - 1 of a variable's first dimension, as stored."""
        if not v.dims:
            self.file.seek(v.begin)
            return np.frombuffer(self.file.read(np.dtype(v.type).itemsize), v.type)
        last = v.shape[0] if last is None else last
        inner = np.dtype(v.type).itemsize * math.prod(v.shape[1:])
        if v.stride == inner:
            self.file.seek(v.begin + first * inner)
            parts = [self.file.read(inner * (last - first))]
        else:
            parts = []
            for i in range(first, last):
                self.file.seek(v.begin + i * v.stride)
                parts.append(self.file.read(inner))
        return np.frombuffer(b"".join(parts), v.type).reshape(last - first, *v.shape[1:])

    def coordinate(self, d: int) -> np.ndarray:
        """A dimension's coordinates: its variable's values, or their numbers."""
        name, n = self.dims[d][0], self.dims[d][1] or self.records
        if name not in self.variables:
            return np.arange(n, dtype=float)
        got = self.data(self.variables[name])
        if got.dtype.kind == "S":
            return np.array([b"".join(x).rstrip(b"\0 ").decode() for x in got.reshape(n, -1)], object)
        return got.astype(float)

    def held(self) -> list[Variable]:
        """Variables that aren't coordinates."""
        names = {n for n, _ in self.dims}
        return [v for v in self.variables.values() if v.name not in names and v.dims and v.type != "S1"]


def values(v: Variable, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, scaled as the attributes say, and where there is none."""
    none = np.zeros(raw.shape, bool)
    for name in ("_FillValue", "missing_value"):
        if name in v.attributes:
            none |= raw == v.attributes[name][0]
    if "_FillValue" not in v.attributes and v.type in FILL:
        none |= raw == np.array(FILL[v.type]).astype(v.type)
    x = raw.astype(float)
    x = x * float(v.attributes.get("scale_factor", [1.0])[0]) + float(v.attributes.get("add_offset", [0.0])[0])
    return x, none | np.isnan(x)


@dataclass
class Slab(InputPartition):
    path: str
    variable: str
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], dims: list[str], slab: int):
        self.paths, self.dims, self.slab, self.filters = paths, dims, slab, []

    def pushFilters(self, filters: list[Filter]):
        """Filters leave slabs out; Spark still applies them to rows."""
        for f in filters:
            if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute in (("indicator",), (self.dims[0],)):
                self.filters.append(f)
            yield f

    def _may(self, name: str, x) -> bool:
        tests = {EqualTo: lambda f: x == f.value, In: lambda f: x in f.value, GreaterThan: lambda f: x > f.value, GreaterThanOrEqual: lambda f: x >= f.value, LessThan: lambda f: x < f.value, LessThanOrEqual: lambda f: x <= f.value}
        return all(tests[type(f)](f) for f in self.filters if f.attribute == (name,))

    def partitions(self) -> list[Slab]:
        out = []
        for path in self.paths:
            system, name = located(path)
            with system.open_input_file(name) as file:
                header = Header(file)
                for v in header.held():
                    if not self._may("indicator", v.name):
                        continue
                    wanted = [i for i, x in enumerate(header.coordinate(v.dims[0]).tolist()) if self._may(self.dims[0], x)]
                    most = max(1, self.slab // max(1, 8 * math.prod(v.shape[1:])))
                    while wanted:
                        n = next((k for k in range(1, min(most, len(wanted))) if wanted[k] != wanted[0] + k), min(most, len(wanted)))
                        out.append(Slab(path, v.name, wanted[0], wanted[0] + n))
                        wanted = wanted[n:]
        return out or [Slab("", "", 0, 0)]

    def read(self, part: Slab) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, name = located(part.path)
        with system.open_input_file(name) as file:
            header = Header(file)
            v = header.variables[part.variable]
            names = [header.dims[d][0].lower() for d in v.dims]
            if names != self.dims:
                raise ValueError(f"{part.path}: {v.name} has dimensions {names}, not {self.dims}")
            axes = [header.coordinate(d) for d in v.dims]
            for i in range(part.first, part.last):
                x, none = values(v, header.data(v, i, i + 1))
                at = np.unravel_index(np.arange(x.size), x.shape)
                columns = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(x.size, np.int32)), pa.array([v.name])).cast(pa.string())]
                columns += [pa.array((a[i : i + 1] if k == 0 else a)[at[k]], pa.string() if a.dtype == object else pa.float64()) for k, a in enumerate(axes)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(x.ravel(), mask=none.ravel())], names=["indicator", *names, "value"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def packed(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def one_level(indicator: str, gwl: float, lat: np.ndarray, lon: np.ndarray, value: np.ndarray) -> bytes:
    """A file of dimensions gwl (1), lat and lon; cells without a row or a value hold the fill value."""
    lats, lons = np.unique(lat), np.unique(lon)
    grid = np.full((len(lats), len(lons)), FILL[">f8"])
    grid[np.searchsorted(lats, lat), np.searchsorted(lons, lon)] = np.where(np.isnan(value), FILL[">f8"], value)
    data = [("gwl", [0], np.array([gwl])), ("lat", [1], lats), ("lon", [2], lons), (indicator, [0, 1, 2], grid)]
    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", DIMENSIONS, 3)
    for name, n in (("gwl", 1), ("lat", len(lats)), ("lon", len(lons))):
        head += packed(name) + struct.pack(">i", n)
    head += struct.pack(">ii", 0, 0) + struct.pack(">ii", VARIABLES, len(data))
    fill = struct.pack(">ii", ATTRIBUTES, 1) + packed("_FillValue") + struct.pack(">iid", DOUBLE, 1, FILL[">f8"])
    entry = lambda name, dims, x, begin: packed(name) + struct.pack(f">i{len(dims)}i", len(dims), *dims) + (fill if len(dims) == 3 else struct.pack(">ii", 0, 0)) + struct.pack(">iiq", DOUBLE, min(x.size * 8, 2**31 - 1), begin)
    begin = len(head) + sum(len(entry(*d, 0)) for d in data)
    for d in data:
        head += entry(*d, begin)
        begin += d[2].size * 8
    return head + b"".join(x.astype(">f8").tobytes() for _, _, x in data)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.work = path.rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, top = located(self.path)
        system.create_dir(f"{top}/{self.work}")
        files, now, parts = [], None, []

        def close():
            if parts:
                t = pa.Table.from_batches(parts)
                name = f"{self.work}/{uuid.uuid4().hex}.nc"
                column = lambda c: t[c].combine_chunks().to_numpy(zero_copy_only=False).astype(float)
                with system.open_output_stream(f"{top}/{name}") as out:
                    out.write(one_level(*now, column("lat"), column("lon"), column("value")))
                files.append((name, f"{now[0]}_{now[1]}.nc".replace("/", "_")))
                parts.clear()

        for batch in iterator:
            keys = list(zip(batch.column("indicator").to_pylist(), batch.column("gwl").to_pylist(), strict=True))
            begin = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[begin]:
                    if keys[begin] != now:
                        close()
                        now = keys[begin]
                    parts.append(batch.slice(begin, i - begin))
                    begin = i
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = located(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({to for _, to in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows must arrive clustered by indicator and level")
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(top)):
                if old.base_name.endswith(".nc"):
                    system.delete_file(old.path)
        for name, to in files:
            system.move(f"{top}/{name}", f"{top}/{to}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, top = located(self.path)
        if system.get_file_info(f"{top}/{self.work}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.work}")


class NetCdf(DataSource):
    """Options: `path` (a file, a folder, or * in the last part) and `slab`, the bytes of a task (64 MB)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        path = expand(self.options["path"])[0]
        system, name = located(path)
        with system.open_input_file(name) as file:
            header = Header(file)
            dims = header.held()[0].dims
            kinds = ", ".join(f"`{header.dims[d][0].lower()}` {'string' if header.coordinate(d).dtype == object else 'double'}" for d in dims)
        return f"indicator string, {kinds}, value double"

    def reader(self, schema) -> Reader:
        return Reader(expand(self.options["path"]), [f.name for f in schema.fields[1:-1]], int(self.options.get("slab", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def read(spark, path: str, slab: int = 64 << 20) -> DataFrame:
    """Long rows of classic netCDF files, a task for each slab; filters on indicator and first dimension leave slabs out."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetCdf)
    return spark.read.format("netcdf").option("slab", slab).load(path)


def write(raster: DataFrame, path: str) -> None:
    """A file for each indicator and level, in place of what files the folder has."""
    raster.sparkSession.dataSource.register(NetCdf)
    rows = raster.select("indicator", "gwl", "lat", "lon", "value").repartition("indicator", "gwl").sortWithinPartitions("indicator", "gwl")
    rows.write.format("netcdf").mode("overwrite").save(path)
