"""SQL for DuckDB that gives the rows of the queries, written apart from them."""

from __future__ import annotations

MEAN = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE) / COUNT({0})"


def mean(c: str) -> str:
    return MEAN.format(c)


def r(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.500123e0) / 1e{digits})"


_MELT = "(SELECT 'price' AS indicator, 'USD' AS unit UNION ALL SELECT 'quantity', 'items' UNION ALL SELECT 'discount', '%')"
_PICK = "CASE k.indicator WHEN 'price' THEN g.price WHEN 'quantity' THEN g.quantity ELSE g.discount END"

TABLES = {
    "scen": f"""SELECT c_mktsegment AS model, o_orderpriority AS scenario, 'World' AS region, 'Surface Temperature' AS variable, '°C' AS unit,
        CAST(2020 + (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS year,
        round_even((1.1e0 + {mean("o_totalprice")} / 500000e0 * 2.4e0) * 1e3, 0) / 1e3 AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "meta": """SELECT DISTINCT c_mktsegment AS model, o_orderpriority AS scenario,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '1.0' WHEN '2' THEN 'SSP2' WHEN '4' THEN '' WHEN '5' THEN '6.0' END AS ssp_family,
        'C' || (1 + length(c_mktsegment) % 8) AS category FROM orders JOIN customer ON o_custkey = c_custkey""",
    "resolved": """SELECT model, scenario, CASE ssp_family WHEN '1.0' THEN 'SSP1' WHEN '' THEN 'SSP2' ELSE coalesce(ssp_family, 'SSP2') END AS ssp_family, category FROM meta""",
    "path": "SELECT s.model, s.scenario, m.ssp_family AS ssp, s.year, s.value AS gwl FROM scen s JOIN resolved m USING (model, scenario)",
    "facts": f"""SELECT r_name AS region, 'SSP' || (1 + o_custkey % 5) AS ssp, 1e0 + 0.5e0 * (l_linenumber - 1) AS gwl, CAST(100 + 50 * (l_linenumber - 1) AS INTEGER) AS gwl_c,
        CAST(2020 + 10 * (year(o_orderdate) - 1995) AS INTEGER) AS year, {mean("l_extendedprice")} AS price, {mean("l_quantity")} AS quantity, {mean("l_discount")} AS discount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4, 5""",
    "everything": f"SELECT k.indicator, k.unit, g.region, g.ssp, g.gwl, g.gwl_c, g.year, {_PICK} AS value FROM facts g, {_MELT} k",
    "cube": "SELECT * FROM everything",
    "sparse": "SELECT * FROM everything",
    "cells": f"""SELECT -85e0 + 10 * (l_partkey % 18) AS lat, -175e0 + 10 * (l_suppkey % 36) AS lon, 1e0 + 0.5e0 * (l_linenumber - 1) AS gwl, CAST(100 + 50 * (l_linenumber - 1) AS INTEGER) AS gwl_c,
        {mean("l_extendedprice")} AS price, {mean("l_quantity")} AS quantity, {mean("l_tax")} AS discount FROM lineitem GROUP BY 1, 2, 3, 4""",
    "raster": f"SELECT k.indicator, g.lat, g.lon, g.gwl, g.gwl_c, {_PICK} AS value FROM cells g, {_MELT} k",
    "co2": f"""SELECT c_mktsegment AS model, o_orderpriority AS scenario, 'World' AS region, 'Emissions|CO2' AS variable, 'Mt CO2/yr' AS unit,
        CAST(2020 + 5 * ((year(o_orderdate) - 1995) * 2 + (month(o_orderdate) - 1) // 6) AS INTEGER) AS year, {mean("o_totalprice")} / 10 - 20000 AS value
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "impacts": """SELECT 'Climate Solutions' AS model, lower(ssp) || '_' || replace(format('{:.1f}', gwl), '.', 'p') AS scenario, region,
        indicator || CASE indicator WHEN 'price' THEN '|Exposure|50.0th Percentile' WHEN 'quantity' THEN '|Hazard|50.0th Percentile' ELSE '_ssp2|Hazard|95.0th Percentile' END AS variable, unit, year, value
        FROM cube""",
    # the grid of 0.01 degrees, and every pathway row's nearest level and year on it
    "seg": "SELECT *, lead(gwl) OVER w AS g1, lead(value) OVER w AS v1, lag(gwl) OVER w IS NULL AS head FROM cube WINDOW w AS (PARTITION BY indicator, unit, region, ssp, year ORDER BY gwl)",
    "grid": """SELECT indicator, unit, region, ssp, year, CAST(c AS INTEGER) AS gwl_c, CASE WHEN c < gwl * 100 OR g1 IS NULL OR c / 100e0 = gwl THEN value ELSE value + (v1 - value) * ((c / 100e0 - gwl) / (g1 - gwl)) END AS value
        FROM (SELECT *, unnest(range(CAST(CASE WHEN head THEN round(floor(gwl / 0.05e0) * 5) ELSE round(gwl * 100) END AS BIGINT), CAST(CASE WHEN g1 IS NULL THEN round(ceil(gwl / 0.05e0) * 5) + 1 ELSE round(g1 * 100) END AS BIGINT))) AS c FROM seg)""",
    "levels": "SELECT t.gwl, arg_min(a.gwl_c, row(abs(a.gwl_c / 100e0 - t.gwl), -a.gwl_c)) AS gwl_c FROM (SELECT DISTINCT gwl FROM path) t, (SELECT DISTINCT gwl_c FROM grid) a GROUP BY t.gwl",
    "years": "SELECT t.year, arg_min(a.year, row(abs(a.year - t.year), -a.year)) AS cube_year FROM (SELECT DISTINCT year FROM path) t, (SELECT DISTINCT year FROM cube) a GROUP BY t.year",
    "targets": "SELECT p.model, p.scenario, CASE WHEN p.ssp IN ('SSP1', 'SSP2', 'SSP3', 'SSP4', 'SSP5') THEN p.ssp ELSE 'SSP2' END AS ssp, p.year, y.cube_year, p.gwl, l.gwl_c FROM path p JOIN levels l USING (gwl) JOIN years y USING (year)",
    "looked": "SELECT t.*, g.indicator, g.unit, g.region, g.value FROM targets t JOIN grid g ON g.ssp = t.ssp AND g.year = t.cube_year AND g.gwl_c = t.gwl_c",
    "tab": "SELECT model, scenario, region, 'Impacts|' || indicator AS variable, unit, cube_year AS year, avg(value) AS value FROM looked GROUP BY ALL",
    # maps
    "two": "SELECT model, scenario, year, round_even(gwl * 100, 0) / 100 AS gwl FROM path",
    "asked": "SELECT * FROM two WHERE year BETWEEN 2015 AND 2100 AND year % 5 = 0",
    "own": "SELECT model, scenario, max(gwl) AS max_gwl, min(gwl) AS min_gwl, arg_max(gwl, year) AS last_gwl FROM asked GROUP BY ALL",
    "bound": "SELECT o.*, d.data_min, d.data_max, CASE WHEN max_gwl > data_max THEN data_max ELSE 3.5e0 END AS high, CASE WHEN min_gwl < data_min THEN data_min ELSE 1.2e0 END AS low FROM own o, (SELECT min(gwl) AS data_min, max(gwl) AS data_max FROM raster) d",
    "tmap": "SELECT t.*, CASE WHEN t.gwl > b.high THEN 'above' WHEN t.gwl < b.low THEN 'below' ELSE 'ok' END AS status FROM asked t JOIN bound b USING (model, scenario)",
    "steps": "SELECT indicator, gwl, lead(gwl) OVER (PARTITION BY indicator ORDER BY gwl) AS g1 FROM (SELECT DISTINCT indicator, gwl FROM raster)",
    "rseg": "SELECT r.*, s.g1, n.value AS v1 FROM raster r JOIN steps s USING (indicator, gwl) LEFT JOIN raster n ON n.indicator = r.indicator AND n.lat = r.lat AND n.lon = r.lon AND n.gwl = s.g1",
    "maps": """SELECT t.model, t.scenario, c.indicator, c.lat, c.lon, t.year, t.gwl, CASE WHEN t.status <> 'ok' THEN NULL WHEN t.gwl = s.gwl THEN s.value ELSE s.value + (s.v1 - s.value) * ((t.gwl - s.gwl) / (s.g1 - s.gwl)) END AS value, t.status
        FROM tmap t CROSS JOIN (SELECT DISTINCT indicator, lat, lon FROM raster) c LEFT JOIN rseg s ON s.indicator = c.indicator AND s.lat = c.lat AND s.lon = c.lon AND t.gwl >= s.gwl AND (t.gwl < s.g1 OR s.g1 IS NULL AND t.gwl = s.gwl)""",
    "next": "SELECT *, lead(year) OVER w AS y1, lead(value) OVER w AS v1 FROM maps WINDOW w AS (PARTITION BY model, scenario, indicator, lat, lon ORDER BY year)",
    # carbon
    "cseg": "SELECT *, lead(year) OVER w AS y1, lead(value) OVER w AS v1 FROM co2 WINDOW w AS (PARTITION BY model, scenario, region, variable, unit ORDER BY year)",
    "annual": """SELECT model, scenario, region, variable, unit, CAST(y AS INTEGER) AS year, CASE WHEN y = year THEN value ELSE value + (v1 - value) * ((y - year) / CAST(y1 - year AS DOUBLE)) END AS value
        FROM (SELECT *, unnest(range(year, coalesce(y1, year + 1))) AS y FROM cseg)""",
    "cum": """SELECT model, scenario, region, variable || '|Cumulative|from 2020' AS variable, 'Gt CO2/yr' AS unit, year, total AS value FROM (
        SELECT *, sum(value * 1e-3) OVER (PARTITION BY model, scenario ORDER BY year) AS total, min(year) OVER (PARTITION BY model, scenario) AS start FROM annual) WHERE start <= 2020 AND year BETWEEN 2020 AND 2100""",
    "points": "SELECT c.value AS cum, p.gwl FROM cum c JOIN path p USING (model, scenario, year)",
    "line": "SELECT regr_slope(gwl, cum) AS slope, regr_intercept(gwl, cum) AS intercept, corr(gwl, cum) AS r FROM points",
    # scores
    "sc": """SELECT indicator, lat, lon, max(CASE WHEN gwl_c = 100 THEN value END) AS hist, max(CASE WHEN gwl_c = 300 THEN value END) AS future,
        abs(max(CASE WHEN gwl_c = 200 THEN value END) - max(CASE WHEN gwl_c = 100 THEN value END)) AS std, CAST(1 + ((CAST(lat + lon AS INTEGER) // 10) % 5 + 5) % 5 AS INTEGER) AS class FROM raster GROUP BY indicator, lat, lon""",
    "z": "SELECT *, (future - hist) / nullif(std, 0e0) AS z FROM sc",
}
NEEDS = {
    "resolved": ["meta"], "path": ["scen", "resolved"], "everything": ["facts"], "cube": ["everything"], "sparse": ["everything"], "raster": ["cells"], "impacts": ["cube"], "seg": ["cube"], "grid": ["seg"], "levels": ["path", "grid"], "years": ["path", "cube"], "targets": ["path", "levels", "years"],
    "looked": ["targets", "grid"], "tab": ["looked"], "two": ["path"], "asked": ["two"], "own": ["asked"], "bound": ["own", "raster"], "tmap": ["asked", "bound"], "steps": ["raster"], "rseg": ["raster", "steps"], "maps": ["tmap", "rseg", "raster"], "next": ["maps"],
    "cseg": ["co2"], "annual": ["cseg"], "cum": ["annual"], "points": ["cum", "path"], "line": ["points"], "sc": ["raster"], "z": ["sc"],
}


#: Rasters with gaps: rows of a level on half the cells, values of another on a third.
_GAPS = f"SELECT k.indicator, g.lat, g.lon, g.gwl, g.gwl_c, CASE WHEN NOT (g.gwl = 1.5 AND g.lon % 3 = 0) THEN {_PICK} END AS value FROM cells g, {_MELT} k WHERE NOT (g.gwl = 2.5 AND g.lat > 0)"
GAPS = {"raster": (_GAPS, ["cells"])}
BRIDGED = GAPS | {"rseg": ("SELECT *, lead(gwl) OVER w AS g1, lead(value) OVER w AS v1 FROM raster WHERE value IS NOT NULL WINDOW w AS (PARTITION BY indicator, lat, lon ORDER BY gwl)", ["raster"])}

#: A path from cumulative CO2 in place of the temperatures.
CO2_PATH = {"path": ("SELECT c.model, c.scenario, m.ssp_family AS ssp, c.year, round_even((0.0005099869587542405e0 * c.value + 1.3024249460191835e0) * 1e3, 0) / 1e3 AS gwl FROM cum c JOIN resolved m USING (model, scenario) WHERE c.year % 10 = 0", ["cum", "resolved"])}


#: Maps of the decades: what is asked for decides the extremes too.
DECADES = {"asked": ("SELECT * FROM two WHERE year BETWEEN 2020 AND 2100 AND year % 10 = 0", ["two"])}


def at_year(y: int) -> str:
    """Each cell of the maps at a year: its own value, or between its neighbouring years."""
    return f"SELECT model, scenario, indicator, lat, lon, CAST({y} AS INTEGER) AS year, CASE WHEN year = {y} THEN value ELSE value + (v1 - value) * (({y} - year) / CAST(y1 - year AS DOUBLE)) END AS value FROM next WHERE year = {y} OR year < {y} AND y1 > {y}"


def with_tables(names: str, select: str, other: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """The select behind WITH clauses for the named tables and all they need; `other` replaces tables and their needs."""
    order: list[str] = []
    tables = TABLES | {n: sql for n, (sql, _) in (other or {}).items()}
    needs = NEEDS | {n: x for n, (_, x) in (other or {}).items()}

    def add(n: str) -> None:
        for x in needs.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({tables[n]})" for n in order) + "\n" + select


def _bin(x: str, e: list[str]) -> str:
    """Score 0 to 3 of x between edges."""
    part = lambda k: f"{k} + CASE WHEN {e[k + 1]} > {e[k]} THEN ({x} - {e[k]}) / ({e[k + 1]} - {e[k]}) ELSE 0 END"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= {e[0]} THEN 0e0 WHEN {x} < {e[1]} THEN {part(0)} WHEN {x} < {e[2]} THEN {part(1)} WHEN {x} < {e[3]} THEN {part(2)} ELSE 3e0 END"


_PARAMS = """(VALUES ('trade', 'price', '2b', 'price', 'Mean price', 'USD', 'magma_r', 'absolute', 'RdBu', 0e0, 100000e0, -100000e0, 100000e0, '100000.0 50000.0 25000.0 0.0'),
    ('trade', 'discount', '2b', 'discount', 'Mean discount', '%', 'magma_r', 'absolute', 'RdBu', 0e0, 1e0, -1e0, 1e0, '1.0 0.5 0.25 0.0'), ('volume', 'quantity', '3b', 'quantity', 'Mean quantity', 'items', 'magma_r', 'absolute', 'RdBu', 0e0, 50e0, -50e0, 50e0, '50.0 25.0 12.5 0.0'))
    t(group_name, var_name, protocol, short_name, long_name, unit, ind_cmap, diff, diff_cmap, ind_min, ind_max, diff_min, diff_max, score_range)"""


def _bivariate(keys: str, fixed: dict[str, tuple] | None = None) -> str:
    fixed = fixed or {"discount": (0.01, 0.02, 0.03, 0.04)}
    q = [f"q.zq[{k}]" for k in range(1, 5)]
    f = [f"q.fq[{k}]" for k in range(1, 5)]
    on = " AND ".join(f"z.{k} = q.{k}" for k in keys.split(", "))
    level = "CASE z.indicator " + " ".join(f"WHEN '{i}' THEN {_bin('z.future', [f'{x}e0' for x in e])}" for i, e in fixed.items()) + f" ELSE {_bin('z.future', f)} END"
    return f"""SELECT indicator, lat, lon, {r("zs", 4)} AS z_score, {r("ls", 4)} AS level_score, {r("zs + ls", 4)} AS score FROM (
        SELECT z.indicator, z.lat, z.lon, {_bin("z.z", q)} AS zs, {level} AS ls FROM z JOIN (
        SELECT {keys}, quantile_cont(z, [0, 0.25, 0.5, 0.75]) AS zq, quantile_cont(future, [0, 0.25, 0.5, 0.75]) AS fq FROM z GROUP BY {keys}) q ON {on})"""


IMPACT = f"model, scenario, region, variable, unit, year, {r('value')} AS value"
MAP = f"model, scenario, indicator, lat, lon, year, gwl, {r('value')} AS value, status"
_LABELS = {f"{m}_{p}": (m, p) for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}
_FILL = """SELECT *, last_value(CASE WHEN value IS NOT NULL THEN y END IGNORE NULLS) OVER before AS y0, last_value(value IGNORE NULLS) OVER before AS v0, first_value(CASE WHEN value IS NOT NULL THEN y END IGNORE NULLS) OVER after AS y1, first_value(value IGNORE NULLS) OVER after AS v1
    FROM (SELECT s.*, y, c.value FROM (SELECT DISTINCT indicator, unit, region, ssp, gwl_c FROM {cube}) s CROSS JOIN range({first}, {last} + 1) t(y) LEFT JOIN {cube} c ON c.indicator = s.indicator AND c.region = s.region AND c.ssp = s.ssp AND c.gwl_c = s.gwl_c AND c.year = y)
    WINDOW before AS (PARTITION BY indicator, region, ssp, gwl_c ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), after AS (PARTITION BY indicator, region, ssp, gwl_c ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
_FILLED = "CASE WHEN y0 = y1 THEN v0 ELSE coalesce(v0 + (v1 - v0) * ((y - y0) / CAST(y1 - y0 AS DOUBLE)), v0, v1) END"
_SUFFIXES = ", ".join(f"'|{kind}|{p}th Percentile'" for kind in ("Exposure", "Hazard") for p in ("5.0", "50.0", "95.0"))


def oracle_sql() -> dict[str, str]:
    w = with_tables
    wide = ", ".join(f'max(CASE WHEN year = {y} THEN value END) AS "{y}"' for y in range(2020, 2100))
    decades = ", ".join(f'max(CASE WHEN year = {y} THEN value END) AS "{y}"' for y in range(2020, 2081, 10))
    return {
        "iamc_long_to_wide": w("scen", f"SELECT model, scenario, region, variable, unit, {wide} FROM scen GROUP BY ALL"),
        "iamc_wide_to_long": w("scen", "SELECT * FROM scen"),
        "filter_wildcard_variable": w("impacts", f"SELECT {IMPACT} FROM impacts WHERE variable LIKE '%|50.0th Percentile'"),
        "filter_meta_category": w("scen meta", "SELECT s.* FROM scen s SEMI JOIN (SELECT * FROM meta WHERE category IN ('C1', 'C2')) m USING (model, scenario)"),
        "filter_years": w("scen", "SELECT * FROM scen WHERE year IN (2030, 2050)"),
        "filter_complement": w("scen", "SELECT * FROM scen WHERE scenario NOT LIKE '1-%'"),
        "filter_substring_any": w("impacts", f"SELECT {IMPACT} FROM impacts WHERE contains(variable, 'quant') OR contains(variable, 'disc')"),
        "filter_substring_none": w("impacts", f"SELECT {IMPACT} FROM impacts WHERE NOT contains(variable, '95.0th')"),
        "filter_suffix_whitelist": w("impacts", f"SELECT {IMPACT} FROM impacts WHERE substr(variable, length(split_part(variable, '|', 1)) + 1) IN ({_SUFFIXES})"),
        "first_n_indicators": w("cube", f"SELECT * REPLACE ({r('value')} AS value) FROM cube WHERE indicator IN (SELECT DISTINCT indicator FROM cube ORDER BY 1 LIMIT 2)"),
        "strip_ssp_suffix": w("impacts", "SELECT DISTINCT variable, split_part(variable, '_ssp', 1) AS stripped FROM impacts"),
        "stem_of_variable": w("impacts", "SELECT DISTINCT variable, split_part(variable, '|', 1) AS stem FROM impacts"),
        "parse_ssp_gwl": w("impacts", "SELECT DISTINCT scenario, upper(split_part(scenario, '_', 1)) AS ssp, CAST(replace(split_part(scenario, '_', 2), 'p', '.') AS DOUBLE) AS gwl FROM impacts"),
        "remove_percentile_suffix": w("impacts", "SELECT DISTINCT variable, replace(variable, '|50.0th Percentile', '') AS short FROM impacts"),
        "impact_cube_from_input": w("cube", f"""SELECT indicator || CASE indicator WHEN 'price' THEN '|Exposure' WHEN 'quantity' THEN '|Hazard' ELSE '_ssp2|Hazard|95.0th Percentile' END AS indicator, unit, region, ssp, gwl, gwl_c, year, {r("value")} AS value
            FROM cube"""),
        "stem_cube": w("cube", f"SELECT 'price|Exposure' AS indicator, unit, region, ssp, gwl, gwl_c, year, {r('value')} AS value FROM cube WHERE indicator = 'price'"),
        "drop_empty_rows": w("scen", f"SELECT model, scenario, region, variable, unit, {wide} FROM scen WHERE model <> 'BUILDING' OR year >= 2060 GROUP BY ALL HAVING count(CASE WHEN year < 2060 THEN value END) > 0"),
        "outlier_windows": w("cube", f"SELECT * REPLACE ({r("CASE indicator WHEN 'price' THEN CASE WHEN value > 30000 AND value < 40000 THEN value END WHEN 'discount' THEN CASE WHEN value > -0.05e0 AND value < 0.05e0 THEN value END ELSE value END")} AS value) FROM cube"),
        "select_by_position": w("cube", f"SELECT * REPLACE ({r('value')} AS value) FROM cube WHERE gwl_c = (SELECT DISTINCT gwl_c FROM cube ORDER BY 1 LIMIT 1 OFFSET 1) AND year = (SELECT DISTINCT year FROM cube WHERE gwl_c = (SELECT DISTINCT gwl_c FROM cube ORDER BY 1 LIMIT 1 OFFSET 1) ORDER BY 1 DESC LIMIT 1 OFFSET 1)"),
        "exact_year_select": w("cube", f"SELECT * REPLACE ({r('value')} AS value) FROM cube WHERE year IN (2030, 2050)"),
        "dense_cube": w("cube", f"""SELECT g.*, {r("c.value")} AS value FROM (SELECT * FROM (SELECT DISTINCT indicator FROM cube), (SELECT DISTINCT gwl_c FROM cube WHERE region <> 'ASIA' OR year < 2050), (SELECT DISTINCT year FROM cube WHERE region <> 'ASIA' OR year < 2050),
            (SELECT DISTINCT ssp FROM cube WHERE region <> 'ASIA' OR year < 2050), (SELECT DISTINCT region FROM cube WHERE region <> 'ASIA' OR year < 2050)) g LEFT JOIN (SELECT * FROM cube WHERE region <> 'ASIA' OR year < 2050) c USING (indicator, gwl_c, year, ssp, region)"""),
        "aligned_cubes": w("cube", f"""SELECT indicator, region, ssp, gwl_c, year, {r("p.value")} AS one, {r("q.value")} AS other FROM (SELECT * FROM cube WHERE region <> 'ASIA' OR year >= 2030) p
            FULL JOIN (SELECT * FROM cube WHERE ssp <> 'SSP3' OR year < 2060) q USING (indicator, region, ssp, gwl_c, year)"""),
        "pathway_ssp_resolved": w("resolved", "SELECT * FROM resolved"),
        "pathway_meta_join": w("path", "SELECT * FROM path"),
        "append_scenarios": w("scen", "SELECT * FROM scen"),
        "distinct_axes": w("cube", "SELECT count(DISTINCT indicator) AS n_indicator, count(DISTINCT region) AS n_region, count(DISTINCT ssp) AS n_ssp, count(DISTINCT gwl) AS n_gwl, count(DISTINCT year) AS n_year FROM cube"),
        "dedup_meta": w("meta", "SELECT * FROM meta"),
        "annual_interpolation": w("annual", f"SELECT {IMPACT} FROM annual"),
        "year_fill_both_edges": w("cube", f"SELECT indicator, unit, region, ssp, gwl_c, CAST(y AS INTEGER) AS year, {r(_FILLED)} AS value FROM ({_FILL.format(cube='(SELECT * FROM cube WHERE year BETWEEN 2030 AND 2060)', first=2020, last=2070)})"),
        "gwl_grid_interpolation": w("grid", f"SELECT indicator, unit, region, ssp, year, gwl_c / 100e0 AS gwl, gwl_c, {r('value')} AS value FROM grid"),
        "gwl_grid_strict_knots": w("grid", f"SELECT indicator, unit, region, ssp, year, gwl_c / 100e0 AS gwl, gwl_c, {r('value')} AS value FROM grid", {"cube": ("SELECT * FROM everything WHERE gwl <> 2.0", ["everything"])}),
        "nearest_irregular_level": w("path cube", """SELECT p.*, a.nearest FROM path p LEFT JOIN (SELECT t.ssp, t.gwl, arg_min(l.level, row(abs(l.level - t.gwl), -l.level)) AS nearest
            FROM (SELECT DISTINCT ssp, gwl FROM path) t JOIN (SELECT DISTINCT ssp, gwl * gwl / 2e0 AS level FROM cube WHERE ssp <> 'SSP1') l USING (ssp) GROUP BY t.ssp, t.gwl) a ON a.ssp = p.ssp AND a.gwl = p.gwl"""),
        "user_emulator": w("path", "SELECT *, row_number() OVER (PARTITION BY model, scenario, gwl ORDER BY year) > 1 AS is_duplicate FROM path"),
        "streamed_caution_checks": w("own", "SELECT *, round_even((max_gwl - last_gwl) * 100, 0) / 100 > 0.15e0 AS drawdown, max_gwl > 3.5e0 AS too_hot, min_gwl < 1.2e0 AS too_cold FROM own"),
        "dashboard_zoom": w("maps", " UNION ALL ".join(f"SELECT model, scenario, indicator, year, {s}e0 AS step, floor(lat / {s}e0) * {s}e0 AS lat, floor(lon / {s}e0) * {s}e0 AS lon, {r('avg(value)')} AS value, count(*) AS cells FROM maps GROUP BY ALL" for s in (10, 30, 90)), DECADES),
        "duplicate_temps_spread": w("path", """SELECT model, scenario, ssp, year, CASE WHEN row_number() OVER (PARTITION BY model, scenario, gwl ORDER BY year) > 1
            THEN gwl + 0.005e0 * (CAST('0x' || substr(md5('1|' || model || '|' || scenario || '|' || year), 1, 7) AS BIGINT) / 134217728e0 - 1e0) ELSE gwl END AS gwl FROM path"""),
        "prepared_cube": w("grid", f"SELECT indicator, unit, region, ssp, gwl_c, {r('avg(value)')} AS mean_value, count(*) AS n FROM grid GROUP BY ALL", {"cube": (f"SELECT indicator, unit, region, ssp, gwl_c / 100e0 AS gwl, gwl_c, CAST(y AS INTEGER) AS year, {_FILLED} AS value FROM ({_FILL.format(cube='sparse', first=2020, last=2080)})", ["sparse"])}),
        "cube_round_trip": w("cube", f"SELECT * REPLACE ({r('value')} AS value) FROM cube"),
        "netcdf_round_trip": w("raster", f"SELECT indicator, lat, lon, gwl, gwl_c, {r('value')} AS value FROM raster WHERE gwl >= 2.0"),
        "iamc_csv_round_trip": w("scen", "SELECT * FROM scen"),
        "nearest_gwl_lookup": w("targets", "SELECT * FROM targets"),
        "nearest_year_collapse_mean": w("tab", f"SELECT region, variable, year, {r('avg(value)')} AS mean_value, count(*) AS n FROM tab GROUP BY ALL"),
        "table_emulation": w("tab", f"SELECT {IMPACT} FROM tab"),
        "table_emulation_requested_years": w("looked", f"SELECT model, scenario, region, 'Impacts|' || indicator AS variable, unit, year, {r('value')} AS value FROM looked WHERE year % 10 = 0"),
        "table_emulation_wide": w("tab", f"SELECT model, scenario, region, variable, unit, {decades} FROM (SELECT * REPLACE ({r('value')} AS value) FROM tab) GROUP BY ALL"),
        "table_emulation_all_regions": w("tab", f"""SELECT e.model, e.scenario, e.region, 'Impacts|' || e.indicator AS variable, e.unit, e.cube_year AS year, {r("t.value")} AS value
            FROM (SELECT * FROM (SELECT DISTINCT model, scenario, cube_year FROM targets), (SELECT DISTINCT indicator, unit, region FROM cube)) e LEFT JOIN tab t ON t.model = e.model AND t.scenario = e.scenario AND t.region = e.region AND t.variable = 'Impacts|' || e.indicator AND t.year = e.cube_year""",
            {"cube": ("SELECT * FROM everything WHERE region <> 'ASIA' OR ssp <> 'SSP2'", ["everything"])}),
        "table_emulation_metrics": w("tab", "SELECT count(*) AS n_rows, count(value) AS n_values, " + f"{r('min(value)')} AS low, {r('max(value)')} AS high FROM tab"),
        "table_emulation_from_co2": w("looked", f"SELECT model, scenario, region, 'Climate impacts|' || indicator AS variable, unit, cube_year AS year, {r('avg(value)')} AS value FROM looked GROUP BY ALL", CO2_PATH),
        "missing_ssps": w("path", "SELECT DISTINCT ssp FROM path WHERE ssp = 'SSP1'"),
        "map_emulation_multi_scenario": w("maps", f"SELECT {MAP} FROM maps", DECADES),
        "map_emulation_null_levels": w("maps", f"SELECT {MAP} FROM maps", DECADES | GAPS),
        "map_emulation_bridged_levels": w("maps", f"SELECT {MAP} FROM maps", DECADES | BRIDGED),
        "map_emulation_by_level": w("maps steps", f"""SELECT {MAP} FROM maps m WHERE status = 'ok' AND EXISTS (SELECT 1 FROM raster r WHERE r.indicator = m.indicator AND r.lat = m.lat AND r.lon = m.lon AND r.gwl IN (
            SELECT unnest([s.gwl, CASE WHEN t.gwl > s.gwl THEN s.g1 ELSE s.gwl END]) FROM tmap t JOIN steps s ON t.gwl = s.gwl OR t.gwl > s.gwl AND t.gwl < s.g1 WHERE t.status = 'ok'))""", DECADES),
        "map_emulation_multi_indicator": w("maps", "SELECT model, scenario, lat, lon, year, " + ", ".join(f"{r(f"max(CASE WHEN indicator = '{i}' THEN value END)")} AS {i}" for i in ("discount", "price", "quantity")) + " FROM maps GROUP BY ALL", DECADES),
        "map_scenario_columns": w("maps", "SELECT indicator, lat, lon, year, " + ", ".join(f"""{r(f"max(CASE WHEN model = '{m}' AND scenario = '{p}' THEN value END)")} AS "{x}\"""" for x, (m, p) in _LABELS.items()) + " FROM maps GROUP BY ALL", DECADES),
        "map_range_mask_999": w("maps", f"SELECT model, scenario, indicator, year, status, count(*) AS cells, count(v) AS valued, {r('min(v)')} AS low, {r('max(v)')} AS high FROM (SELECT *, CASE WHEN status <> 'ok' THEN 999e0 ELSE value END AS v FROM maps) GROUP BY ALL", DECADES),
        "pathway_caution_checks": w("own", "SELECT *, round_even((max_gwl - last_gwl) * 100, 0) / 100 > 0.15e0 AS drawdown, max_gwl > 3.5e0 AS too_hot, min_gwl < 1.2e0 AS too_cold FROM own"),
        "effective_bounds": w("bound", "SELECT * FROM bound"),
        "pathway_extremes": w("path", "SELECT model, scenario, min(gwl) AS low, max(gwl) AS high, arg_max(gwl, year) AS last FROM path GROUP BY ALL"),
        "unit_conversion": w("co2", f"SELECT model, scenario, year, {r('value * 1e-3')} AS gt FROM co2"),
        "cumulative_co2": w("cum", f"SELECT {IMPACT} FROM cum WHERE year % 10 = 0"),
        "co2_to_gwl_default": w("cum", f"SELECT model, scenario, year, {r('value')} AS cumulative, {r('0.0005099869587542405e0 * value + 1.3024249460191835e0')} AS gwl FROM cum"),
        "co2_to_gwl_as_temperature": w("cum", f"SELECT model, scenario, region, 'Emulated|GSAT_tcre' AS variable, '°C' AS unit, year, {r('0.0005099869587542405e0 * value + 1.3024249460191835e0')} AS value FROM cum WHERE year % 10 = 0"),
        "tcre_regression": w("line", f"SELECT {r('slope', 9)} AS slope, {r('intercept', 9)} AS intercept, {r('r', 9)} AS r, {r('r * r', 9)} AS r2 FROM line"),
        "co2_to_gwl_regression": w("cum line", f"SELECT model, scenario, year, {r('slope * value + intercept')} AS gwl FROM cum, line WHERE year % 10 = 0"),
        "duplicate_temps_flag": w("path", "SELECT *, row_number() OVER (PARTITION BY model, scenario, gwl ORDER BY year) > 1 AS is_duplicate FROM path"),
        "map_year_interpolation": w("next", f"SELECT * REPLACE ({r('value')} AS value) FROM ({at_year(2035)})", DECADES),
        "colour_limits": w("maps", "SELECT indicator, round_even(min(value), 0) AS low, round_even(max(value), 0) AS high FROM maps GROUP BY indicator", DECADES),
        "dashboard_frame": w("next", f"SELECT * REPLACE ({r('value')} AS value), round_even(min(value) OVER w, 0) AS low, round_even(max(value) OVER w, 0) AS high FROM ({at_year(2040)}) WHERE indicator IN ('price', 'quantity') WINDOW w AS (PARTITION BY indicator)", DECADES),
        "zscore_change": w("z", f"SELECT indicator, lat, lon, {r('z')} AS z FROM z"),
        "score_bin": w("sc", f"SELECT indicator, lat, lon, {r('future')} AS future, {r(_bin('future', ['10e0', '20e0', '25e0', '30e0']))} AS score FROM sc"),
        "quartiles": w("sc", "SELECT indicator, class, " + ", ".join(f"{r(f'quantile_cont(future, {q})')} AS q{k}" for k, q in enumerate((0, 0.25, 0.5, 0.75))) + " FROM sc GROUP BY indicator, class"),
        "bivariate_score": w("z", _bivariate("indicator")),
        "class_bivariate_score": w("z", _bivariate("indicator, class")),
        "mask_join": w("raster sc", f"SELECT r.lat, r.lon, r.indicator, r.gwl, r.gwl_c, {r('r.value')} AS value, m.class FROM raster r JOIN (SELECT DISTINCT lat, lon, class FROM sc WHERE class <= 2) m ON r.lat = m.lat AND r.lon = m.lon"),
        "raster_union": w("raster", f"SELECT indicator, lat, lon, gwl, gwl_c, {r('value')} AS value FROM raster"),
        "envelope_by_category": w("scen meta", "SELECT category, year, min(value) AS low, max(value) AS high FROM scen JOIN meta USING (model, scenario) GROUP BY ALL"),
        "scenario_labels": w("meta", "SELECT model, scenario, translate(model || ' 1.1/x,y', ' /,.', '____') || '_' || scenario AS label FROM meta"),
        "axis_validation": w("cube", "SELECT indicator, count(DISTINCT gwl) AS n_gwl, min(gwl) AS min_gwl, max(gwl) AS max_gwl, count(DISTINCT gwl) > 1 AND min(gwl) > 0.5 AS valid FROM cube GROUP BY indicator"),
        "duplicate_key_check": w("cube", "SELECT indicator, region, ssp, gwl_c, year, CAST(2 AS BIGINT) AS n FROM cube WHERE year = 2030"),
        "indicator_params_table": w("cube", f"SELECT t.*, count(c.value) AS n_values, count(CASE WHEN c.value < t.ind_min OR c.value > t.ind_max THEN 1 END) AS n_outside FROM {_PARAMS} JOIN cube c ON c.indicator = t.var_name GROUP BY ALL"),
        "score_by_params": w("z", _bivariate("indicator, class", {"price": (0, 25000, 50000, 100000), "discount": (0, 0.25, 0.5, 1), "quantity": (0, 12.5, 25, 50)})),
        "cube_from_many_files": w("cube", f"SELECT * REPLACE ({r('value')} AS value) FROM cube"),
        "half_even_rounding": "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 1000 * 100, 0) / 100 AS rounded FROM lineitem",
    }
