"""Navigation integrity: share of reporting aircraft that report degraded position quality, and how many report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.fixed_values import NAVINT_MIN_KNOWN
from geoweave.functions.aircraft import is_degraded
from geoweave.functions.geo import round_to, with_cell
from geoweave.operators.baseline import BinWindow


def _fractions(points: DataFrame, keys: list[str], who: str = "hex") -> DataFrame:
    known = points.withColumn("_deg", is_degraded(F.col("nic"), F.col("nac_p"))).filter(F.col("_deg").isNotNull())
    once = known.groupBy(*keys, who).agg(F.max("_deg").alias("_deg"))
    return once.groupBy(*keys).agg(F.count(F.lit(1)).alias("known"), F.count_if("_deg").alias("degraded"))


def _labelled(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "frac": round_to(F.col("degraded") / F.col("known"), 3),
        "coverage": F.when(F.col("known") < NAVINT_MIN_KNOWN, "insufficient").otherwise("adequate")})


def integrity_series(points: DataFrame, window: BinWindow, cell_deg: float = 1.0) -> DataFrame:
    """Per cell and bin: known, degraded, fraction and whether that is enough evidence."""
    i = window.bin_of(F.col("t"))
    placed = with_cell(points.withColumn("bin", i).filter((i >= 0) & (i < window.n)), cell_deg=cell_deg)
    return _labelled(_fractions(placed, ["row", "col", "bin"])).withColumn("t", window.start_of(F.col("bin")))


def integrity_window(points: DataFrame, t_from: float, t_to: float, cell_deg: float = 1.0) -> DataFrame:
    """One window: per cell known, degraded and fraction."""
    placed = with_cell(points.filter(F.col("t").between(float(t_from), float(t_to))), cell_deg=cell_deg)
    return _labelled(_fractions(placed, ["row", "col"]))


def integrity_totals(points: DataFrame, window: BinWindow) -> DataFrame:
    """Per bin over all cells."""
    i = window.bin_of(F.col("t"))
    return _fractions(points.withColumn("bin", i).filter((i >= 0) & (i < window.n)), ["bin"])
