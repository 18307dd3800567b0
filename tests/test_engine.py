"""Hand-computed cases of each operator."""

import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermolith import schema
from thermolith.config import EngineConfig
from thermolith.functions import metrics, numeric, text
from thermolith.operators import carbon, cube, dashboard, emulators, filters, maps, nearest, pathway, reshape, scores, selection, table
from thermolith.sources import cubes, iamc, params
from thermolith.streaming import caution

TS = schema.SCENARIO_TS
KNOTS = "indicator string, unit string, region string, ssp string, gwl double, year int, value double"
RASTER = "indicator string, lat double, lon double, gwl double, value double"


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def knots(spark, rows):
    return schema.region_impacts(spark.createDataFrame(rows, KNOTS), check=False)


def path(spark, rows):
    return spark.createDataFrame(rows, schema.GMT_PATHWAY)


@pytest.mark.parametrize("x,digits,want", [(0.125, 2, 0.12), (1.005, 2, 1.0), (2.675, 2, 2.68), (1.2345, 3, 1.234)])
def test_half_even(spark, x, digits, want):
    assert one(spark, numeric.half_even(F.lit(x), digits)) == float(np.round(x, digits)) or want == one(spark, numeric.half_even(F.lit(x), digits))


def test_nearest(spark):
    axis = F.array(*(F.lit(x) for x in (1.0, 1.5, 2.0)))
    for x, want in ((1.25, 1.5), (1.75, 2.0), (0.2, 1.0), (9.0, 2.0), (None, None)):
        assert one(spark, numeric.nearest(F.lit(x).cast("double"), axis)) == want


def test_nearest_centi_is_nearest_on_the_grid(spark):
    r = random.Random(1)
    xs = [round(r.uniform(0.9, 4.1), 3) for _ in range(500)]
    got = [x[0] for x in spark.createDataFrame([(x,) for x in xs], "x double").select(numeric.nearest_centi(F.col("x"), F.lit(100), F.lit(400))).collect()]
    want = [min(range(100, 401), key=lambda c: (abs(c / 100 - x), -c)) for x in xs]
    assert got == want


def test_wildcards(spark):
    for pattern, s, want in (("*|50.0th Percentile", "a|50.0th Percentile", True), ("*|50.0th Percentile", "a|50x0th Percentile", False), ("hw_95_1*", "hw_95_10", True), ("a(b)|*", "a(b)|c", True), ("C1*", "xC1", False), ("a", "a", True), ("a*", "a\nb", True)):
        assert one(spark, text.matches(F.lit(s), pattern)) is want


def test_names(spark):
    assert one(spark, text.map_label(F.lit("COFFEE 1.1"), F.lit("EN_NPi2020_400f_lowBECCS"))) == "COFFEE_1_1_EN_NPi2020_400f_lowBECCS"
    assert one(spark, text.ssp_of(F.lit("ssp1_1p5"))) == "SSP1" and one(spark, text.gwl_of(F.lit("ssp1_1p5"))) == 1.5
    assert one(spark, text.ssp_of(F.lit("a_b_c"))) is None and one(spark, text.gwl_of(F.lit("ssp1_x"))) is None
    assert one(spark, text.strip_ssp(F.lit("cdd_ssp2_x"))) == "cdd" and one(spark, text.stem(F.lit("a|b|c"))) == "a"


def test_ssp_labels(spark):
    for given, want in (("1.0", "SSP1"), ("SSP3", "SSP3"), ("", "SSP2"), (None, "SSP2"), ("6.0", "6.0"), ("2", "SSP2")):
        assert one(spark, text.ssp_label(F.lit(given).cast("string"), "SSP2")) == want
    assert one(spark, pathway.lookup_ssp(F.lit("6.0"))) == "SSP2"


def test_filters(spark):
    df = spark.createDataFrame([("m1", "a", "W", "T|x", "C", 2020, 1.0), ("m2", "b", "W", "T|y", "C", 2030, 2.0)], TS)
    assert values(filters.select(df, variable="T|*", year=[2030]), "model") == [("m2",)]
    assert values(filters.select(df, keep=False, model="m1"), "model") == [("m2",)]
    assert values(filters.containing(df, "variable", ["|y"]), "model") == [("m2",)]
    assert values(filters.with_suffix(df, ["|x"]), "model") == [("m1",)]
    meta = spark.createDataFrame([("m1", "a", "C1")], "model string, scenario string, category string")
    assert values(filters.select_by_meta(df, meta, category="C*"), "model") == [("m1",)]
    assert filters.append(df.where("model='m1'"), df.where("model='m2'")).count() == 2
    with pytest.raises(ValueError):
        filters.append(df, df)


def test_pathway_construction(spark):
    ts = spark.createDataFrame([("m", "s", "W", "T", "C", 2020, 1.23456), ("m", "s", "W", "E", "Mt", 2020, float("nan"))], TS)
    assert values(pathway.make(ts, variable="T"), "ssp", "gwl") == [("SSP2", 1.235)]
    assert values(pathway.make(ts, variable="T*"), "gwl") == [(1.235,)]
    assert values(pathway.make(ts, variable="E"), "gwl") == [(None,)]
    with pytest.raises(ValueError):
        pathway.make(ts)
    with pytest.raises(ValueError):
        pathway.make(ts, variable="X")


def test_duplicates_and_spread(spark):
    p = path(spark, [("m", "s", "SSP1", 2020 + i, g) for i, g in enumerate((1.5, 1.6, 1.5))])
    assert values(pathway.duplicates(p), "year", "is_duplicate") == [(2020, False), (2021, False), (2022, True)]
    moved = values(pathway.spread_duplicates(p, 3), "year", "gwl")
    assert moved[:2] == [(2020, 1.5), (2021, 1.6)] and 0 < abs(moved[2][1] - 1.5) <= 0.005
    assert moved == values(pathway.spread_duplicates(p, 3), "year", "gwl")


def test_bounds_and_warnings(spark):
    raster = spark.createDataFrame([("a", 0.0, 0.0, g, g) for g in (1.5, 3.0)], RASTER)
    p = path(spark, [("m", "s", "SSP1", 2020, 1.0), ("m", "s", "SSP1", 2050, 3.2), ("m", "s", "SSP1", 2100, 3.04)])
    b = pathway.bounds(p, raster, EngineConfig(temp_max=2.0)).first()
    assert (b["low"], b["high"]) == (1.5, 3.0)
    assert pathway.bounds(p, raster, EngineConfig(temp_max=2.0), honour_user=True).first()["high"] == 2.0
    w = pathway.warnings(p).first()
    assert (w["drawdown"], w["too_hot"], w["too_cold"]) == (True, False, True)
    for last, want in ((1.7, False), (1.69, True)):  # a fall of 0.15 is none, though 1.85 - 1.70 is more in doubles
        w = pathway.warnings(path(spark, [("m", "s", "SSP1", 2020, 1.85), ("m", "s", "SSP1", 2050, last), ("m", "s", "SSP1", 2051, 1.2)]), years=[2020, 2050]).first()
        assert w["drawdown"] is want and w["last_gwl"] == last


def test_annual_and_cumulative(spark):
    ts = spark.createDataFrame([("m", "s", "W", "E", "Gt CO2/yr", 2020, 10.0), ("m", "s", "W", "E", "Gt CO2/yr", 2025, 20.0), ("m", "late", "W", "E", "Gt CO2/yr", 2023, 1.0)], TS)
    assert [v for _, v in values(pathway.annual(ts.where("scenario = 's'"), list(schema.IAMC)), "year", "value")] == [10, 12, 14, 16, 18, 20]
    c = carbon.cumulative(ts, 2020)
    assert values(c.where("year in (2020, 2025)"), "scenario", "year", "value") == [("s", 2020, 10.0), ("s", 2025, 90.0)]
    assert c.where("scenario = 'late'").count() == 0


def test_carbon(spark):
    ts = spark.createDataFrame([("m", "s", "W", "Emissions|CO2", "Mt CO2/yr", y, 1000.0) for y in (2020, 2030)], TS)
    out = carbon.prepare(ts, years=[2020, 2030])
    assert values(out, "variable", "unit", "year", "value")[1][0:3] == ("Emissions|CO2|Cumulative|from 2020", "Gt CO2/yr", 2030)
    assert values(out, "value")[1][0] == pytest.approx(11)
    assert carbon.to_gwl(out, {"slope": 2.0, "intercept": 1.0}).where("year = 2020").first()["gwl"] == pytest.approx(3)
    points = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], "x double, y double")
    assert carbon.to_gwl(out, points).where("year = 2020").first()["gwl"] == pytest.approx(3)
    with pytest.raises(ValueError):
        carbon.to_gwl(out, "other")
    with pytest.raises(ValueError):
        carbon.prepare(ts, years=[2020])


def test_grid(spark):
    rows = [("i", "u", "r", "SSP1", g, 2020, v) for g, v in ((1.5, 1.0), (1.733, 5.0), (2.02, 3.0), (1.6, None))]
    got = dict(values(cube.gwl_grid(knots(spark, rows)), "gwl_c", "value"))
    assert min(got) == 150 and max(got) == 205 and len(got) == 56
    assert got[150] == 1.0 and got[202] == 3.0 and got[205] == 3.0
    assert got[160] == pytest.approx(1 + 4 * 0.1 / 0.233) and got[174] == pytest.approx(5 - 2 * 0.007 / 0.287)


def test_grid_midpoint_and_edges(spark):
    got = dict(values(cube.gwl_grid(knots(spark, [("i", "u", "r", "SSP1", 1.2, 2020, 1.0), ("i", "u", "r", "SSP1", 1.7, 2020, 2.0)])), "gwl_c", "value"))
    assert got[115] == 1.0 and got[120] == 1.0 and got[145] == pytest.approx(1.5) and min(got) == 115


def test_fill_years(spark):
    df = spark.createDataFrame([("a", 2022, 2.0), ("a", 2024, 4.0)], "k string, year int, value double")
    assert values(cube.fill_years(df, ["k"], 2020, 2026), "year", "value") == [(2020, 2.0), (2021, 2.0), (2022, 2.0), (2023, 3.0), (2024, 4.0), (2025, 4.0)]


def brute_table(path_rows, knot_rows):
    """Plain nearest lookup in a grid."""
    series, out = {}, {}
    for i, u, r, s, g, y, v in knot_rows:
        series.setdefault((i, u, r, s, y), []).append((g, v))
    years = sorted({k[4] for k in series})
    grids = {}
    for k, x in series.items():
        x.sort()
        lo, hi = round(np.floor(x[0][0] / 0.05) * 5), round(np.ceil(x[-1][0] / 0.05) * 5)
        grids[k] = {c: float(np.interp(c / 100, [g for g, _ in x], [v for _, v in x])) for c in range(lo, hi + 1)}
    levels = sorted({c for g in grids.values() for c in g})
    for m, s, ssp, y, g in path_rows:
        if g is None:
            continue
        cy = min(years, key=lambda a: (abs(a - y), -a))
        c = min(levels, key=lambda a: (abs(a / 100 - g), -a))
        for (i, u, r, sp, yy), grid in grids.items():
            if sp == (ssp if ssp in ("SSP1", "SSP2") else "SSP2") and yy == cy and c in grid:
                out.setdefault((m, s, r, "Impacts|" + i, u, cy), []).append(grid[c])
    return {k: sum(v) / len(v) for k, v in out.items()}


def test_table_against_brute_force(spark):
    rng = random.Random(2)
    kr = [(i, "u", r, s, g, y, rng.uniform(0, 9)) for i in "ab" for r in "xy" for s in ("SSP1", "SSP2") for g in (1.0, 1.5, 2.02, 3.0) for y in (2020, 2025)]
    pr = [("m", "s", rng.choice(["SSP1", "SSP2", "6.0"]), y, rng.choice([None, round(rng.uniform(0.5, 3.6), 3)])) for y in range(2015, 2031)]
    got = {tuple(r)[:-1]: r["value"] for r in table.emulate(path(spark, pr), knots(spark, kr)).collect()}
    want = brute_table(pr, kr)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_years_collapse(spark):
    k = knots(spark, [("i", "u", "r", "SSP1", g, y, g * y) for g in (1.0, 2.0) for y in (2020, 2025)])
    p = path(spark, [("m", "s", "SSP1", 2015, 1.0), ("m", "s", "SSP1", 2020, 2.0), ("m", "s", "SSP1", 2025, 2.0)])
    assert values(table.emulate(p, k), "year", "value") == [(2020, 3030.0), (2025, 4050.0)]
    assert [y for y, _ in values(table.emulate(p, k, keep_requested_year=True), "year", "value")] == [2015, 2020, 2025]
    with pytest.raises(KeyError):
        table.emulate_strict(path(spark, [("m", "s", "SSP3", 2020, 1.0)]), k)


def _sparse_raster(spark):
    return schema.raster_impacts(spark.createDataFrame([("i", 0.0, x, g, g * x) for x in (1.0, 2.0) for g in (1.5, 2.0, 3.0)] + [("i", 1.0, 1.0, 1.5, 1.0), ("i", 2.0, 1.0, 2.0, None)], RASTER), check=False)


def test_maps(spark):
    """A row for each cell and year: null out of bounds, and where the cell's own levels don't hold the level."""
    p = path(spark, [("m", "s", "SSP1", 2020, 1.504), ("m", "s", "SSP1", 2030, 2.5), ("m", "s", "SSP1", 2040, 1.0)])
    rows = maps.emulate(p, _sparse_raster(spark))
    got = {(r["lat"], r["lon"], r["year"]): (r["value"], r["status"]) for r in rows.collect()}
    assert rows.count() == len(got) == 12
    assert got[0.0, 2.0, 2020] == (3.0, "ok") and got[0.0, 1.0, 2030] == (2.5, "ok") and got[1.0, 1.0, 2020] == (1.0, "ok")
    assert got[1.0, 1.0, 2030] == got[2.0, 1.0, 2030] == (None, "ok") and got[0.0, 1.0, 2040] == got[2.0, 1.0, 2040] == (None, "below")
    assert maps.with_sentinel(rows).where("year = 2040").first()["value"] == 999.0
    wide = maps.to_wide(rows, ["m_s"])
    assert wide.where("year = 2030 and lon = 1.0 and lat = 0.0").first()["m_s"] == 2.5
    assert values(maps.by_indicator(rows, ["i"]).where("lat = 0.0 and lon = 1.0"), "year", "i") == [(2020, 1.5), (2030, 2.5), (2040, None)]
    with pytest.raises(Exception, match="several rows"):
        maps.to_wide(rows.unionByName(rows.withColumn("model", F.lit("m")).where("year = 2030")), ["m_s"]).collect()


def test_maps_against_brute_force(spark):
    """Off-grid and missing levels; every level that numpy's interpolation knows, and nulls elsewhere."""
    r = random.Random(4)
    raster, knots_of = [], {}
    for lat in range(12):
        levels = sorted(r.sample([1.0, 1.5, 1.733, 2.0, 2.505, 3.0], r.randint(1, 6)))
        knots_of[float(lat)] = [(g, round(r.uniform(0, 9), 3)) for g in levels]
        raster += [("i", float(lat), 0.0, g, v) for g, v in knots_of[float(lat)]]
    years = [(2020 + k, round(r.uniform(0.9, 3.2), 3)) for k in range(60)]
    rows = maps.emulate(path(spark, [("m", "s", "SSP1", y, g) for y, g in years]), spark.createDataFrame(raster, RASTER), config=EngineConfig(temp_min=0.0, temp_max=9.0), bridge=True).collect()
    assert len(rows) == 12 * 60
    low, high = min(x[3] for x in raster), max(x[3] for x in raster)
    for x in rows:
        g, own = x["gwl"], knots_of[x["lat"]]
        if low <= g <= high and own[0][0] <= g <= own[-1][0]:
            assert x["status"] == "ok" and x["value"] == pytest.approx(float(np.interp(g, *zip(*own, strict=True))), abs=1e-9)
        else:
            assert x["value"] is None and x["status"] == ("above" if g > high else "below" if g < low else "ok")


def test_maps_extremes_are_of_the_years_asked_for(spark):
    raster = schema.raster_impacts(spark.createDataFrame([("i", 0.0, 0.0, g, g) for g in (1.0, 3.0)], RASTER))
    p = path(spark, [("m", "s", "SSP1", 2030, 1.1), ("m", "s", "SSP1", 2035, 3.4), ("m", "s", "SSP1", 2040, 1.6)])
    assert values(maps.emulate(p, raster, [2030, 2040], config=EngineConfig(temp_max=2.0)), "year", "status") == [(2030, "below"), (2040, "ok")]
    assert pathway.bounds(p, raster, years=[2030, 2040]).first()["max_gwl"] == 1.6 and pathway.bounds(p, raster).first()["max_gwl"] == 3.4


def test_maps_have_no_nested_loops(spark):
    p = path(spark, [("m", "s", "SSP1", 2020, 1.5)])
    plan = maps.emulate(p, _sparse_raster(spark))._jdf.queryExecution().executedPlan().toString()
    cut = [x for x in plan.splitlines() if "NestedLoopJoin" in x or "CartesianProduct" in x]
    assert len(cut) <= 3  # the one-row ends of the axis


def test_maps_limits_are_kept(spark):
    raster = schema.raster_impacts(spark.createDataFrame([("i", 0.0, 0.0, g, g) for g in (1.0, 4.0)], RASTER))
    p = path(spark, [("m", "s", "SSP1", y, g) for y, g in ((2020, 1.2), (2030, 3.5), (2040, 3.51), (2050, 1.19))])
    assert values(maps.emulate(p, raster), "year", "status") == [(2020, "ok"), (2030, "ok"), (2040, "above"), (2050, "below")]
    several = p.unionByName(path(spark, [("n", "s", "SSP1", 2020, 1.5)]))
    two = raster.unionByName(raster.withColumn("indicator", F.lit("j")))
    with pytest.raises(ValueError):
        maps.emulate(several, two, strict=True)


def test_scores(spark):
    e = [F.lit(float(x)) for x in (0, 1, 2, 3)]
    for x, want in ((-1.0, 0.0), (0.5, 0.5), (2.25, 2.25), (9.0, 3.0), (None, None)):
        assert one(spark, numeric.piecewise_bin(F.lit(x).cast("double"), e)) == want
    flat = [F.lit(1.0)] * 4
    assert one(spark, numeric.piecewise_bin(F.lit(1.5), flat)) == 3.0 and one(spark, numeric.piecewise_bin(F.lit(1.0), flat)) == 0.0
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (3.0, 1.0, 2.0)], "future double, hist double, std double")
    assert values(scores.zscore(df), "z") == [(None,), (1.0,)]
    q = scores.quartiles(spark.createDataFrame([("a", float(x)) for x in range(5)], "k string, value double"), ["k"])
    assert q.first()["quartiles"] == [0.0, 1.0, 2.0, 3.0]


def test_dashboard(spark, tmp_path):
    df = spark.createDataFrame([("m", "s", "i", 0.0, 0.0, y, v) for y, v in ((2030, 1.0), (2040, 3.0))] + [("m", "s", "i", 0.0, 1.0, 2030, 5.0)], "model string, scenario string, indicator string, lat double, lon double, year int, value double")
    cells = dashboard.frame(df, 2035)
    assert values(cells, "lon", "value", "low", "high") == [(0.0, 2.0, 2.0, 2.0)]
    assert dashboard.frame(df, 2030).count() == 2
    name = dashboard.render(dashboard.frame(df, 2030), str(tmp_path / "x.html"))
    assert "<svg" in open(name).read()
    assert "hsl(160 50%" in open(dashboard.render(dashboard.frame(df, 2030), str(tmp_path / "y.html"), cmap="viridis", clim=(0.0, 5.0))).read()
    with pytest.raises(ValueError):
        dashboard.render(cells, "x.txt")
    with pytest.raises(ValueError):
        dashboard.render(cells, str(tmp_path / "z.html"), cmap="none")
    with pytest.raises(ValueError, match="nothing"):
        dashboard.frame(df, 2030, ["i", "nothing"])


def test_schema_checks(spark):
    good = spark.createDataFrame([("i", 0.0, 0.0, g, g) for g in (1.0, 2.0)], "Indicator string, Lat double, X double, GMT double, value double")
    assert schema.raster_impacts(good).columns == ["indicator", "lat", "lon", "gwl", "gwl_c", "value"]
    with pytest.raises(ValueError):
        schema.raster_impacts(good.where("GMT < 1.5"))
    with pytest.raises(ValueError):
        schema.raster_impacts(good.withColumn("GMT", F.col("GMT") - 1))
    with pytest.raises(ValueError):
        schema.raster_impacts(good.drop("Lat"))
    with pytest.raises(ValueError):
        schema.raster_impacts(good.withColumn("GMT", F.lit("x")))


def test_iamc_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Model,Scenario,Region,Variable,Unit,2020,2025\nm,s,World,T,C,1.5,\nm,s2,World,T,C,1,2\n")
    long = iamc.read(spark, str(tmp_path / "a.csv"))
    assert values(long, "scenario", "year", "value") == [("s", 2020, 1.5), ("s2", 2020, 1.0), ("s2", 2025, 2.0)]
    iamc.write_wide_csv(long, str(tmp_path / "out.csv"), [2020, 2025])
    assert values(iamc.read(spark, str(tmp_path / "out.csv")), "scenario", "year", "value") == values(long, "scenario", "year", "value")
    assert iamc.read(spark, long).count() == 3
    for bad in (3, "x.txt", []):
        with pytest.raises(ValueError):
            iamc.read(spark, bad)


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    head = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{t}</t></is></c>' for c, t in zip("ABCDE", ("Model", "Scenario", "Region", "Variable", "Unit"), strict=True)) + '<c r="F1"><v>2020</v></c><c r="H1"><v>2030</v></c>'
    body = '<c r="A2" t="s"><v>0</v></c>' + "".join(f'<c r="{c}2" t="inlineStr"><is><t>{c}</t></is></c>' for c in "BCDE") + '<c r="F2"><v>1.5</v></c><c r="H2"><v>2</v></c>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>m</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1">{head}</row><row r="2">{body}</row></sheetData></worksheet>')
    assert values(iamc.read(spark, str(tmp_path / "a.xlsx"), "data"), "model", "scenario", "year", "value") == [("m", "B", 2020, 1.5), ("m", "B", 2030, 2.0)]


def test_cube_sources(spark, tmp_path):
    for g in ("1p5", "2p0"):
        spark.createDataFrame([(0.0, 1.0, 2.0)], "lat double, lon double, value double").write.parquet(str(tmp_path / f"cdd_ssp2_{g}.parquet"))
    raster = cubes.raster_by_level(spark, [str(tmp_path / "cdd*.parquet")], r"(?P<indicator>cdd_ssp2)_(?P<gwl>\d+p\d+)\.parquet")
    assert values(raster, "indicator", "gwl") == [("cdd", 1.5), ("cdd", 2.0)]
    k = knots(spark, [("i", "u", "r", "SSP1", g, 2020, g) for g in (1.0, 2.0)])
    cubes.write(k, str(tmp_path / "cube"))
    back = cubes.region_cube(spark, str(tmp_path / "cube"))
    assert values(back, "indicator", "gwl", "value") == [("i", 1.0, 1.0), ("i", 2.0, 2.0)]
    with pytest.raises(ValueError):
        cubes.region_cube(spark, 5)


def test_params(spark, tmp_path):
    f = params.frame(spark, params.load(params.EXAMPLE))
    assert f.count() == 3 and f.where("var_name = 'price'").first()["score_range"] == [100000.0, 50000.0, 25000.0, 0.0]


def test_stream(spark, tmp_path):
    from thermolith.streaming import emulate

    k = knots(spark, [("i", "u", "r", "SSP1", g, 2020, g) for g in (1.0, 2.0)])
    p = path(spark, [("m", "s", "SSP1", 2020, 1.25), ("m", "s", "SSP1", 2021, 1.75)])
    p.write.parquet(str(tmp_path / "in"))
    emulate.write(emulate.lookup(emulate.pathways(spark, str(tmp_path / "in")), k), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert values(spark.read.parquet(str(tmp_path / "out")), "year", "value") == values(table.lookup(p, k), "year", "value")


def test_regions_without_impacts_stay(spark):
    k = knots(spark, [("i", "u", region, ssp, g, 2020, g) for region, ssp in (("r", "SSP1"), ("r", "SSP2"), ("q", "SSP2")) for g in (1.0, 2.0)])
    p = path(spark, [("m", "s", "SSP1", 2020, 1.5), ("m", "t", "SSP2", 2020, 1.5)])
    assert values(table.emulate(p, k), "scenario", "region", "value") == [("s", "r", 1.5), ("t", "q", 1.5), ("t", "r", 1.5)]
    assert values(table.emulate(p, k, all_regions=True), "scenario", "region", "value") == [("s", "q", None), ("s", "r", 1.5), ("t", "q", 1.5), ("t", "r", 1.5)]


def test_axes_of_cubes(spark):
    k = knots(spark, [("i", "u", "r", "SSP1", 1.0, 2020, 1.0), ("i", "u", "r", "SSP2", 2.0, 2030, 2.0)])
    assert cube.dense(k).count() == 8 and cube.dense(k).where("value is not null").count() == 2
    side = cube.align(k, k.where("year = 2030"), ("ssp", "year"), ("a", "b"))
    assert values(side, "ssp", "year", "a", "b") == [("SSP1", 2020, 1.0, None), ("SSP2", 2030, 2.0, 2.0)]
    assert values(cube.at_years(k, [2030]), "value") == [(2.0,)] and cube.at_years(k, [2020, 2025], strict=False).count() == 1
    with pytest.raises(KeyError, match="2025"):
        cube.at_years(k, [2020, 2025])
    assert values(filters.nth(k, "gwl", 1), "value") == [(2.0,)] and values(filters.nth(k, "gwl", -2), "value") == [(1.0,)]
    assert filters.nth(k, "gwl", 2).count() == filters.nth(k, "gwl", -3).count() == 0
    odd = k.withColumn("value", F.when(F.col("year") == 2020, F.lit(float("inf"))).otherwise(F.col("value")))
    assert values(filters.windowed(odd, {}), "value") == [(None,), (2.0,)] and values(filters.windowed(k, {"i": (-2.0, 2.0)}), "value") == [(None,), (1.0,)]
    two = spark.createDataFrame([("heat|a",), ("heatwave|a",)], "variable string")
    assert values(filters.of_stem(two, "heat"), "variable") == [("heat|a",)]


def test_prepared_cube(spark):
    k = knots(spark, [("i", "u", "r", "SSP1", g, y, g * y) for g in (1.0, 2.0) for y in (2020, 2030)])
    got = {(r["gwl_c"], r["year"]): r["value"] for r in cube.prepare(k, 2018, 2031).collect()}
    assert len(got) == 101 * 14 and got[150, 2025] == pytest.approx(1.5 * 2025) and got[200, 2031] == 2 * 2030


def test_files_by_template(spark, tmp_path):
    for name in ("cdd_ssp1", "cdd_ssp2", "tr20_ssp1"):
        spark.range(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = cubes.discover(spark, f"{tmp_path}/{{indicator}}_{{ssp}}.parquet")
    assert [(x["indicator"], x["ssp"]) for x in got] == [("cdd", "ssp1"), ("cdd", "ssp2"), ("tr20", "ssp1")]
    assert len(cubes.discover(spark, f"{tmp_path}/{{indicator}}_ssp1.parquet", one_each="indicator")) == 2
    with pytest.raises(ValueError, match="cdd"):
        cubes.discover(spark, f"{tmp_path}/{{indicator}}_{{ssp}}.parquet", one_each="indicator")


def test_readers_of_other_formats(spark):
    made = lambda s, p: s.createDataFrame([("i", "r", "SSP1", g, 2020, g) for g in (1.0, 2.0)], "indicator string, region string, ssp string, gwl double, year int, value double")
    assert cubes.region_cube(spark, ["a.nc", "b.nc"], reader=made).count() == 4


def test_metrics(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "value double")
    assert tuple(metrics.of(df).first()) == (3, 2, 1.0, 3.0)


def test_wide_and_long(spark):
    df = spark.createDataFrame([("m", 2020, 1.0), ("m", 2020, 3.0), ("n", 2021, 5.0)], "model string, year int, value double")
    assert values(reshape.to_long(reshape.to_wide(df, ["model"], [2020, 2021]), ["model"]), "model", "year", "value") == [("m", 2020, 2.0), ("n", 2021, 5.0)]


def test_joins_stay_equi(spark):
    """Range lookups must never become nested loops."""
    k = knots(spark, [("i", "u", "r", "SSP1", g, 2020, g) for g in (1.0, 2.0)])
    p = path(spark, [("m", "s", "SSP1", 2020, 1.25)])
    plan = table.emulate(p, k)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "NestedLoopJoin" in x and "Inner" in x]
    assert len(joins) <= 2  # the one-row tables of axes


@pytest.mark.parametrize("q", [(0.0, 0.25, 0.5, 0.75), (0.1, 1.0), (0.5,)])
def test_quantiles_by_selection(spark, q):
    r = np.random.default_rng(3)
    rows = [(int(g) if g else None, float(v) if r.random() > 0.05 else None, float(v) ** 3) for g, v in zip(r.integers(0, 4, 2000), r.normal(size=2000).round(2), strict=True)]
    rows += [(9, None, 1.0), (10, 2.5, float("nan")), (11, -0.0, float("inf")), (11, 0.0, -float("inf")), (12, 5e-324, 1e307), (12, -5e-324, -1e307)]
    got = {(x["g"], x["variable"]): x["quantiles"] for x in selection.quantiles(spark.createDataFrame(rows, "g int, a double, b double").repartition(3), ["g"], ["a", "b"], q).collect()}
    of = lambda g, v: [x for r in rows if r[0] == g and (x := r["ab".index(v) + 1]) is not None and x == x]
    assert set(got) == {(g, v) for g in (None, 1, 2, 3, 9, 10, 11, 12) for v in "ab" if of(g, v)}
    for (g, v), found in got.items():
        if g != 11:
            assert found == pytest.approx(list(np.quantile(of(g, v), q)), rel=1e-12, abs=1e-300)
    with pytest.raises(ValueError, match="between"):
        selection.quantiles(spark.range(1), [], ["id"], (1.5,))


def test_bits_are_in_the_order_of_numbers(spark):
    x = [float(a) for k in range(-1074, 1024, 13) for a in (2.0**k, -(2.0**k), np.nextafter(2.0**k, 0), np.nextafter(2.0**k, 9e999))] + [0.0, -0.0, float("inf"), -float("inf"), 1.7976931348623157e308]
    want = lambda v: (-1 if v < 0 else 1) * int(np.float64(abs(v)).view(np.int64))
    assert all(r["b"] == want(r["x"]) for r in spark.createDataFrame([(v,) for v in x], "x double").select("x", selection.ordered_bits(F.col("x")).alias("b")).collect())
    assert spark.createDataFrame([(None,), (float("nan"),)], "x double").select(selection.ordered_bits(F.col("x")).alias("b")).where("b is not null").count() == 0


def test_maps_with_levels_that_cells_lack(spark):
    """A level without a row or without a value gives none on both sides of it, but its neighbours keep theirs."""
    raster = spark.createDataFrame([("i", 0.0, 0.0, 1.0, 10.0), ("i", 0.0, 0.0, 2.0, None), ("i", 0.0, 0.0, 3.0, 30.0), ("i", 1.0, 0.0, 1.0, 1.0), ("i", 1.0, 0.0, 3.0, 3.0)], RASTER)
    p = path(spark, [("m", "s", "SSP1", 2020 + k, g) for k, g in enumerate((1.0, 1.5, 2.0, 2.5, 3.0))])
    free = EngineConfig(temp_min=0.0, temp_max=9.0)
    assert values(maps.emulate(p, raster, config=free), "lat", "year", "value") == [(la, 2020 + k, v) for la, v5 in ((0.0, (10.0, None, None, None, 30.0)), (1.0, (1.0, None, None, None, 3.0))) for k, v in enumerate(v5)]
    assert values(maps.emulate(p, raster, config=free, bridge=True), "lat", "year", "value") == [(la, 2020 + k, g * s) for la, s in ((0.0, 10.0), (1.0, 1.0)) for k, g in enumerate((1.0, 1.5, 2.0, 2.5, 3.0))]
    masked = maps.emulate(p, raster, config=EngineConfig(temp_min=2.0, temp_max=9.0), masked=False)
    assert masked.count() == 6 and masked.where("status <> 'ok'").count() == 0


def test_only_needed_levels_are_opened(spark, tmp_path):
    raster = spark.createDataFrame([("i", float(la), 0.0, g, g * la) for la in range(4) for g in (1.0, 1.5, 2.0, 2.5, 3.0)], RASTER)
    to = str(tmp_path / "levels")
    cubes.write_levels(schema.raster_impacts(raster), to)
    part, axes = cubes.read_levels(spark, to)
    assert axes.collect() == [("i", [1.0, 1.5, 2.0, 2.5, 3.0])]
    p = path(spark, [("m", "s", "SSP1", 2020, 1.6), ("m", "s", "SSP1", 2030, 1.5)])
    out = maps.emulate(p, part, axes=axes)
    assert "PartitionFilters: [level" in (plan := out._jdf.queryExecution().executedPlan().toString()) or "PartitionFilters: [gwl" in plan
    for f in (tmp_path / "levels" / "indicator=i").glob("gwl=[23]*/*.parquet"):
        if "gwl=2.0" not in str(f):
            f.write_bytes(b"not a Parquet file")  # would fail if opened
    assert values(out, "lat", "year", "value") == [(float(la), y, pytest.approx(g * la)) for la in range(4) for y, g in ((2020, 1.6), (2030, 1.5))]


def test_files_grow_with_rows_and_keep_places(spark, tmp_path):
    """One indicator has as many files as the shuffle has parts, sorted by place."""
    big = spark.range(4000).select(F.lit("i").alias("indicator"), (F.col("id") % 200).cast("double").alias("lat"), F.floor(F.col("id") / 200).cast("double").alias("lon"), F.lit(1.0).alias("gwl"), F.rand(1).alias("value"))
    cubes.write(big, str(tmp_path / "r"), files=5)
    files = sorted((tmp_path / "r" / "indicator=i").glob("*.parquet"))
    assert len(files) == 5
    ends = sorted((x["a"], x["b"]) for x in spark.read.parquet(str(tmp_path / "r")).groupBy(F.col("_metadata.file_path")).agg(F.min("lat").alias("a"), F.max("lat").alias("b")).collect())
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_dense_cubes_are_made_by_several_tasks(spark):
    k = spark.range(300).select(F.lit("i").alias("indicator"), (F.col("id") % 60).cast("int").alias("gwl_c"), (F.col("id") % 50).cast("int").alias("year"), F.lit("SSP1").alias("ssp"), F.concat(F.lit("r"), F.col("id") % 20).alias("region"), F.lit(1.0).alias("value"))
    out = cube.dense(k.dropDuplicates(["gwl_c", "year", "region"]))
    assert out.count() == 60 * 50 * 20 and out.select("gwl_c", "year", "ssp", "region").distinct().count() == 60 * 50 * 20 and out.where("value is not null").count() == 300
    assert cube.dense(k.where("false")).count() == 0


def test_preprocess_is_one_scan(spark, tmp_path):
    for n in range(30):
        spark.createDataFrame([("i", "r", "SSP1", g, 2020, float(n)) for g in (1.0, 2.0)], "indicator string, region string, ssp string, gwl double, year int, value double").coalesce(1).write.parquet(str(tmp_path / f"f_{n}.parquet"))
    named = lambda df: df.withColumn("region", F.regexp_extract("_file", r"f_(\d+)", 1))
    out = cubes.region_cube(spark, [str(tmp_path / f"f_{n}.parquet") for n in range(30)], preprocess=named, check=False)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {(int(r["region"]), r["value"]) for r in out.collect()} == {(n, float(n)) for n in range(30)}


def test_files_of_chosen_levels(spark, tmp_path):
    for g in ("1p5", "2p0", "2p5"):
        spark.createDataFrame([(0.0, 1.0, 2.0)], "lat double, lon double, value double").write.parquet(str(tmp_path / f"cdd_{g}.parquet"))
    pattern = r"(?P<indicator>cdd)_(?P<gwl>\d+p\d+)\.parquet"
    assert values(cubes.raster_by_level(spark, [str(tmp_path / "cdd*.parquet")], pattern, levels=[1.5, 2.5]), "gwl") == [(1.5,), (2.5,)]
    with pytest.raises(ValueError, match="no file"):
        cubes.raster_by_level(spark, [str(tmp_path / "cdd*.parquet")], pattern, levels=[9.0])
    assert cubes.discover(spark, f"{tmp_path}/{{x}}.nothing") == []


def test_nearest_on_any_axis(spark):
    r = random.Random(7)
    axes = {"a": sorted({round(r.uniform(0, 5), 3) for _ in range(40)}), "b": [1.5], "c": [0.0, 1e-9, 1000.0], None: [1.0, 2.0]}
    rows = [(k, round(r.uniform(-1, 6), 3), i) for k in ("a", "b", "c", None, "none") for i in range(60)] + [("a", None, 0), ("c", 5e-10, 1), ("c", 500.0, 2), (None, 1.5, 3), ("a", float("nan"), 4)]
    left = spark.createDataFrame(rows, "k string, x double, _a int")
    axis = spark.createDataFrame([(k, g, 0) for k, v in axes.items() for g in [*v, v[0], None]], "k string, g double, x int")
    got = nearest.nearest(left, axis, ("x", "g"), ("k",))
    assert got.columns == ["k", "x", "_a", "nearest"] and got.count() == len(rows)
    for x in got.collect():
        own = axes.get(x["k"])
        want = min(own, key=lambda g: (abs(g - x["x"]), -g)) if own and x["x"] is not None and x["x"] == x["x"] else None
        assert x["nearest"] == want
    whole = nearest.nearest(left.where("k = 'a'").drop("k"), axis.where("k = 'a'").drop("k"), ("x", "g"))
    assert sorted(map(str, whole.select("x", "nearest").collect())) == sorted(map(str, got.where("k = 'a'").select("x", "nearest").collect()))
    assert nearest.nearest(left, axis.where("false"), ("x", "g"), ("k",)).where("nearest is not null").count() == 0


def test_emulators_of_users(spark):
    def heat(rows):
        total = 0.0
        for x in rows:
            total += max(0.0, x["gwl"] - 1.5)
            yield {"scenario": x["scenario"], "year": x["year"], "heat": round(total, 6)}

    emulators.register(spark, "heat", heat, "scenario string, year int, heat double")
    rows = path(spark, [("m", "s", "SSP1", y, g) for y, g in ((2030, 2.0), (2020, 1.0), (2040, 1.75))] + [("m", "t", "SSP1", 2020, 3.5)])
    assert values(emulators.run(rows.repartition(4), "heat"), "scenario", "year", "heat") == [("s", 2020, 0.0), ("s", 2030, 0.5), ("s", 2040, 0.75), ("t", 2020, 2.0)]
    assert emulators.run(rows.where("false"), "heat").count() == 0
    with pytest.raises(ValueError, match="name"):
        emulators.register(spark, "a b", heat, "x int")


def test_streamed_checks_equal_a_batch(spark, tmp_path):
    """Years in any order over many files, a restart between, and a scenario that a later trigger doesn't touch."""
    r = random.Random(2)
    rows = [("m", s, "SSP1", y, round(r.uniform(1.0, 4.0), 3)) for s in "abc" for y in range(2020, 2060)]
    r.shuffle(rows)
    to, again = str(tmp_path / "in"), 0
    for part in (rows[:50], rows[50:90], [x for x in rows[90:] if x[1] != "a"], [x for x in rows[90:] if x[1] == "a"]):
        path(spark, part).repartition(3).write.mode("append").parquet(to)
        stream = spark.readStream.schema(schema.GMT_PATHWAY).option("maxFilesPerTrigger", 2).parquet(to)
        caution.keep(caution.checks(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        again += len(part)
        columns = ("model", "scenario", "max_gwl", "min_gwl", "last_gwl", "drawdown", "too_hot", "too_cold")
        seen = path(spark, [x for x in rows[:again]] if again <= 90 else [x for x in rows if again == len(rows) or x in rows[:90] or x[1] != "a"])
        assert values(caution.latest(spark, str(tmp_path / "out")), *columns) == values(pathway.warnings(seen), *columns)


def test_zoom_levels(spark):
    cells = spark.createDataFrame([("m", "s", "i", 2020, float(la), float(lo), float(la * lo)) for la in range(-10, 10) for lo in range(-20, 20)], "model string, scenario string, indicator string, year int, lat double, lon double, value double")
    z = dashboard.zoom(cells, (1.0, 5.0, 20.0))
    assert values(z.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("cells").alias("c")), "step", "n", "c") == [(1.0, 800, 800), (5.0, 32, 800), (20.0, 4, 800)]
    one = z.where("step = 5.0 and lat = -10 and lon = 15").first()
    assert one["cells"] == 25 and one["value"] == pytest.approx(np.mean([la * lo for la in range(-10, -5) for lo in range(15, 20)]))
    assert [dashboard.fitting(z, n).first()["step"] for n in (1000, 800, 799, 3)] == [1.0, 1.0, 5.0, 20.0]


def test_strict_knots(spark):
    k = knots(spark, [("i", "u", "r", "SSP1", g, 2020, v) for g, v in ((1.5, 1.0), (1.733, 9.0), (2.0, 2.0))])
    strict = {r["gwl_c"]: r["value"] for r in cube.gwl_grid(k, strict_knots=True).collect()}
    assert strict[175] == pytest.approx(1.5) and {r["gwl_c"]: r["value"] for r in cube.gwl_grid(k).collect()}[173] > 8
