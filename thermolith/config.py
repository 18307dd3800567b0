"""Engine settings.  The defaults are fixed values of the emulation method."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    prefix: str = "Impacts|"
    climate_prefix: str = "Climate impacts|"
    year_start: int = 2020
    year_end: int = 2100
    years: tuple[int, ...] = tuple(range(2015, 2101, 5))
    temp_min: float = 1.2
    temp_max: float = 3.5
    drawdown_max: float = 0.15
    resolution: float = 0.01
    smooth_resolution: float = 0.05
    default_ssp: str = "SSP2"
    ssps: tuple[str, ...] = ("SSP1", "SSP2", "SSP3", "SSP4", "SSP5")
    #: cumulative CO2 in Gt since 2020 -> degrees
    tcre_slope: float = 0.0005099869587542405
    tcre_intercept: float = 1.3024249460191835
    percentile_suffix: str = "|50.0th Percentile"
    #: multiples of 0.01 degrees that share a bucket of range joins
    bucket: int = 50


DEFAULT = EngineConfig()
