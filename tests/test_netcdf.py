"""Classic netCDF files, built here byte by byte."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermolith.operators import maps
from thermolith.sources import cubes, netcdf


def pad(b):
    return b + b"\0" * (-len(b) % 4)


def name(s):
    return struct.pack(">i", len(s)) + pad(s.encode())


def build(version, dims, variables, records=0):
    """dims: (name, size), 0 for records; variables: (name, dims, code, array, attributes as (name, code, array))."""
    off = ">i" if version == 1 else ">q"
    count = ">q" if version == 5 else ">i"
    n = lambda x: struct.pack(count, x)
    text = lambda s: n(len(s)) + pad(s.encode())
    head = b"CDF" + bytes([version]) + n(records) + struct.pack(">i", 10) + n(len(dims))
    for d, size in dims:
        head += text(d) + n(size)
    head += struct.pack(">i", 0) + n(0) + struct.pack(">i", 11) + n(len(variables))

    def entry(v, begin):
        vname, vd, code, data, attributes = v
        out = text(vname) + n(len(vd)) + b"".join(n(x) for x in vd)
        out += struct.pack(">i", 12 if attributes else 0) + n(len(attributes))
        for a, c, x in attributes:
            out += text(a) + struct.pack(">i", c) + n(x.size) + pad(x.tobytes())
        return out + struct.pack(">i", code) + n(0) + struct.pack(off, begin)

    size = len(head) + sum(len(entry(v, 0)) for v in variables)
    fixed = [v for v in variables if not (v[1] and not dims[v[1][0]][1])]
    moving = [v for v in variables if v not in fixed]
    body, begins = b"", {}
    for v in fixed:
        begins[v[0]] = size + len(body)
        body += pad(v[3].tobytes())
    start = size + len(body)
    several = pad if len(moving) > 1 else (lambda b: b)
    at = start
    for v in moving:
        begins[v[0]] = at
        at += len(several(v[3][:1].tobytes()))
    for r in range(records):
        for v in moving:
            body += several(v[3][r : r + 1].tobytes())
    return head + b"".join(entry(v, begins[v[0]]) for v in variables) + body


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("single", [True, False])
def test_records_scales_and_strings(spark, tmp_path, version, single):
    gwl = np.array([1.0, 1.5, 2.0], ">f8")
    packed = np.array([[1, 2], [-999, 4], [5, 6]], ">i2")
    plain = np.array([[0.5, 1.5], [2.5, np.nan], [4.5, 5.5]], ">f4")
    variables = [("region", [1, 2], 2, np.array([list("ab\0"), list("cde")], "S1"), []), ("hot", [0, 1], 3, packed, [("scale_factor", 6, np.array([0.5], ">f8")), ("add_offset", 6, np.array([10.0], ">f8")), ("_FillValue", 3, np.array([-999], ">i2"))])]
    dims = [("GWL", 0), ("region", 2), ("length", 3)]
    if not single:
        variables += [("GWL", [0], 6, gwl, []), ("wet", [0, 1], 5, plain, [])]
    (tmp_path / "a.nc").write_bytes(build(version, dims, variables, 3))
    got = {(r["indicator"], r["gwl"], r["region"]): r["value"] for r in netcdf.read(spark, str(tmp_path / "a.nc")).collect()}
    at = [0.0, 1.0, 2.0] if single else [1.0, 1.5, 2.0]
    want = {("hot", at[i], x): None if packed[i, k] == -999 else packed[i, k] * 0.5 + 10 for i in range(3) for k, x in enumerate(("ab", "cde"))}
    if not single:
        want |= {("wet", at[i], x): None if np.isnan(plain[i, k]) else float(plain[i, k]) for i in range(3) for k, x in enumerate(("ab", "cde"))}
    assert got == want


@pytest.fixture
def raster(spark):
    return spark.createDataFrame([(i, float(la), float(lo), g, None if (la, lo, g) == (1, 2, 1.5) else g * la + lo) for i in ("cdd", "tr/20") for la in range(3) for lo in range(4) for g in (1.0, 1.5, 2.0) if (la, lo) != (2, 3)], "indicator string, lat double, lon double, gwl double, value double")


def test_round_trip_and_tasks(spark, tmp_path, raster):
    to = str(tmp_path / "out")
    for _ in range(2):  # the second time in place of the first
        netcdf.write(raster, to)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"{i}_{g}.nc" for i in ("cdd", "tr_20") for g in (1.0, 1.5, 2.0)]
    back = netcdf.read(spark, f"file:{to}")
    cells = lambda df: sorted(tuple(r) for r in df.where("value is not null").select("indicator", "lat", "lon", "gwl", "value").collect())
    assert cells(back) == cells(raster) and back.count() == 6 * 12
    assert back.rdd.getNumPartitions() == 6 and netcdf.read(spark, f"{to}/cdd*.nc").rdd.getNumPartitions() == 3
    some = netcdf.read(spark, to).where("gwl > 1.0 and indicator = 'cdd'")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 24
    assert netcdf.read(spark, to).where("gwl = 9").count() == 0


def test_one_file_in_several_slabs(spark, tmp_path):
    data = np.arange(24.0).reshape(4, 6).astype(">f8")
    (tmp_path / "x.nc").write_bytes(build(2, [("gwl", 4), ("lat", 6)], [("i", [0, 1], 6, data, []), ("gwl", [0], 6, np.array([1.0, 2.0, 3.0, 4.0], ">f8"), [])]))
    df = netcdf.read(spark, str(tmp_path / "x.nc"), slab=50)
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.sum("value")).first()[0] == data.sum()
    for test, rows in (("gwl in (1.0, 4.0)", 12), ("gwl >= 3", 12), ("gwl < 2", 6), ("gwl <= 2 and lat = 5", 2)):
        few = netcdf.read(spark, str(tmp_path / "x.nc"), slab=50).where(test)
        assert few.count() == rows and few.rdd.getNumPartitions() < 4


def test_maps_from_netcdf(spark, tmp_path, raster):
    netcdf.write(raster, str(tmp_path / "maps"))
    p = spark.createDataFrame([("m", "s", "SSP1", 2020, 1.75)], "model string, scenario string, ssp string, year int, gwl double")
    got = maps.emulate(p, cubes.raster_cube(spark, str(tmp_path / "maps"), check=False, reader=netcdf.read)).where("indicator = 'cdd' and lat = 2 and lon = 1").collect()
    assert [r["value"] for r in got] == [pytest.approx(1.75 * 2 + 1)]


def test_what_is_no_classic_file(spark, tmp_path):
    (tmp_path / "h.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 50)
    with pytest.raises(Exception, match="HDF5"):
        netcdf.read(spark, str(tmp_path / "h.nc")).count()
