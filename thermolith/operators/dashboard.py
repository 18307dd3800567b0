"""Frames behind dashboards, and a static page of them."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import maps


def at_year(df: DataFrame, year: int, keys: list[str]) -> DataFrame:
    """Each cell at a year: its own value, or linear between its neighbouring years; nulls are never crossed."""
    w = W.partitionBy(*keys).orderBy("year")
    k = df.select(*keys, F.col("year").alias("y0"), F.col("value").alias("v0"), F.lead("year").over(w).alias("y1"), F.lead("value").over(w).alias("v1"))
    k = k.where((F.col("y0") == year) | ((F.col("y0") < year) & (F.col("y1") > year)))
    line = F.col("v0") + (F.col("v1") - F.col("v0")) * ((F.lit(year) - F.col("y0")) / (F.col("y1") - F.col("y0")))
    return k.select(*keys, F.lit(year).alias("year"), F.when(F.col("y0") == year, F.col("v0")).otherwise(line).alias("value"))


def colour_limits(df: DataFrame, keys: list[str] | None = None, sentinel: float = maps.SENTINEL) -> DataFrame:
    """Rounded least and greatest value without sentinels."""
    v = F.when(F.col("value") != sentinel, F.col("value"))
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(F.rint(F.min(v)).alias("low"), F.rint(F.max(v)).alias("high"))


def frame(df: DataFrame, year: int, indicators: list[str] | None = None, keys: tuple[str, ...] = ("model", "scenario", "indicator", "lat", "lon")) -> DataFrame:
    """Cells of the chosen indicators at a year, with the colour limits of their indicator.  Indicators that the maps lack
    raise."""
    if indicators is not None:
        if not isinstance(indicators, list):
            raise ValueError("indicators must be a list")
        there = {r["indicator"] for r in df.where(F.col("indicator").isin(indicators)).select("indicator").distinct().collect()}  # no more than were asked for
        if absent := sorted(set(indicators) - there):
            raise ValueError(f"the maps have no {', '.join(absent)}")
        df = df.where(F.col("indicator").isin(indicators))
    cells = at_year(df, year, list(keys))
    return cells.join(colour_limits(cells, ["indicator"]), "indicator").select(*keys, "year", "value", "low", "high")


def envelope(df: DataFrame, group: str) -> DataFrame:
    """Least and greatest value by group and year."""
    return df.groupBy(group, "year").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def zoom(cells: DataFrame, steps: tuple[float, ...], keys: tuple[str, ...] = ("model", "scenario", "indicator", "year")) -> DataFrame:
    """keys, step, lat, lon, value, cells: means over squares of each of `steps` degrees, named by their south-western corners.

    All steps are made in one pass, as grouping sets with partial aggregation.  Squares without any value have none."""
    names = [(f"_lat{k}", f"_lon{k}", F.lit(float(s))) for k, s in enumerate(steps)]
    placed = cells
    for a, o, s in names:
        placed = placed.withColumns({a: F.floor(F.col("lat") / s) * s, o: F.floor(F.col("lon") / s) * s})
    sets = [[*(F.col(k) for k in keys), F.col(a), F.col(o)] for a, o, _ in names]
    sums = placed.groupingSets(sets, *keys, *(c for a, o, _ in names for c in (a, o))).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("cells"), F.grouping_id().alias("_set"))
    # the set of step k is the one in which its two columns alone, of these, count
    n = 2 * len(steps)
    ids = [(1 << n) - 1 - (0b11 << (n - 2 - 2 * k)) for k in range(len(steps))]
    pick = lambda i: F.coalesce(*(F.when(F.col("_set") == d, x) for d, x in zip(ids, i, strict=True)))
    return sums.select(*keys, pick([s for _, _, s in names]).alias("step"), pick([F.col(a) for a, _, _ in names]).alias("lat"), pick([F.col(o) for _, o, _ in names]).alias("lon"), "value", "cells")


def fitting(zoomed: DataFrame, most_cells: int = 200_000) -> DataFrame:
    """The squares of the finest step of which there are no more than `most_cells`, or of the coarsest."""
    counts = zoomed.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.coalesce(F.min(F.when(F.col("n") <= most_cells, F.col("step"))), F.max("step")).alias("_step"))  # one row
    return zoomed.join(F.broadcast(best), F.col("step") == F.col("_step"), "left_semi")


#: Hue and saturation of colour maps by name; `_r` makes high values dark.
COLOURS = {"magma": (320, 60), "viridis": (160, 50), "inferno": (20, 80), "blues": (210, 70), "greys": (0, 0)}


def _shade(v: float | None, low: float | None, high: float | None, cmap: str) -> str:
    if v is None or low is None or high is None:
        return "#ddd"
    hue, saturation = COLOURS[cmap.removesuffix("_r")]
    part = 0 if high == low else min(1, max(0, (v - low) / (high - low)))
    return f"hsl({hue} {saturation}% {95 - 65 * part if cmap.endswith('_r') else 30 + 65 * part}%)"


def render(cells: DataFrame, path: str, title: str = "Impacts", columns: int = 3, most_cells: int = 200_000, cmap: str = "magma_r", clim: tuple[float, float] | None = None) -> str:
    """Writes a static page with a grid for each indicator, coloured between the frame's limits or `clim`; more than
    `most_cells` cells raise."""
    if cmap.removesuffix("_r") not in COLOURS:
        raise ValueError(f"no colour map {cmap}; there are {', '.join(COLOURS)}, each also with _r")
    if not isinstance(path, str) or not path.endswith(".html"):
        raise ValueError("the file name must end with .html")
    rows = cells.limit(most_cells + 1).collect()
    if len(rows) > most_cells:
        raise ValueError(f"more than {most_cells} cells; choose fewer indicators or a coarser grid")
    by: dict[tuple, list] = {}
    for r in rows:
        by.setdefault((r["indicator"], r["model"], r["scenario"]), []).append(r)
    figures = []
    for (indicator, model, scenario), own in sorted(by.items()):
        lats, lons = sorted({r["lat"] for r in own}, reverse=True), sorted({r["lon"] for r in own})
        at = {(r["lat"], r["lon"]): r for r in own}
        low, high = clim or (own[0]["low"], own[0]["high"])
        cells_ = "".join(f'<rect x="{x}" y="{y}" width="1" height="1" fill="{_shade(at[la, lo]["value"] if (la, lo) in at else None, low, high, cmap)}"/>' for y, la in enumerate(lats) for x, lo in enumerate(lons))
        figures.append(f'<figure><figcaption>{html.escape(f"{indicator}, {model} {scenario}: {low} to {high}")}</figcaption><svg viewBox="0 0 {len(lons)} {len(lats)}">{cells_}</svg></figure>')
    page = f'<!DOCTYPE html><meta charset="utf-8"><title>{html.escape(title)}</title><style>main{{display:grid;grid-template-columns:repeat({columns},1fr)}}</style><h1>{html.escape(title)}</h1><main>{"".join(figures)}</main>'
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
    return path


