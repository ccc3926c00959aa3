"""Distances, cells, circles and boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.fixed_values import EARTH_KM, KM_PER_NM


def round_to(value: Column, digits: int) -> Column:
    """Round half up with plain double arithmetic, so that other engines reproduce every digit."""
    scale = float(10 ** digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / F.lit(2.0))
    half_lon = F.sin(F.radians(lon2 - lon1) / F.lit(2.0))
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def cell_index(degrees: Column, cell_deg: float = 1.0) -> Column:
    """Index of the square holding a coordinate; floors, so -0.5 falls in -1."""
    return F.floor(degrees if cell_deg == 1.0 else degrees / F.lit(cell_deg)).cast("bigint")


def with_cell(df, lat: str = "lat", lon: str = "lon", cell_deg: float = 1.0, row: str = "row", col: str = "col"):
    return df.withColumns({row: cell_index(F.col(lat), cell_deg), col: cell_index(F.col(lon), cell_deg)})


def ring(row: Column, col: Column, reach: int = 1) -> Column:
    """The cells within `reach` of a cell (itself included) as an array of structs."""
    steps = range(-reach, reach + 1)
    return F.array(*[F.struct((row + F.lit(dr)).alias("row"), (col + F.lit(dc)).alias("col")) for dr in steps for dc in steps])


def explode_ring(df, row: str = "row", col: str = "col", out_row: str = "nrow", out_col: str = "ncol"):
    return (df.withColumn("_ring", F.explode(ring(F.col(row), F.col(col))))
            .withColumns({out_row: F.col("_ring.row"), out_col: F.col("_ring.col")}).drop("_ring"))


def in_box(lat: Column, lon: Column, west: float, south: float, east: float, north: float) -> Column:
    """Inside a map view; west may exceed east, then the box crosses the date line."""
    across = (lon >= F.lit(west)) & (lon <= F.lit(east)) if west <= east else (lon >= F.lit(west)) | (lon <= F.lit(east))
    return F.coalesce((lat >= F.lit(south)) & (lat <= F.lit(north)) & across, F.lit(False))


def circle_boxes(lat: Column, lon: Column, radius_nm: Column) -> Column:
    """Bounding boxes of a circle on the sphere: split at the antimeridian, whole band at a pole."""
    angle = radius_nm * F.lit(KM_PER_NM) / F.lit(EARTH_KM)
    reach = F.degrees(angle)
    south, north = F.greatest(F.lit(-90.0), lat - reach), F.least(F.lit(90.0), lat + reach)
    spread = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(angle) / F.cos(F.radians(lat)))))
    west, east = lon - spread, lon + spread

    def box(w: Column, e: Column) -> Column:
        return F.struct(south.alias("south"), w.alias("west"), north.alias("north"), e.alias("east"))

    return (F.when((south == -90.0) | (north == 90.0), F.array(box(F.lit(-180.0), F.lit(180.0))))
            .when(west < -180.0, F.array(box(west + 360.0, F.lit(180.0)), box(F.lit(-180.0), east)))
            .when(east > 180.0, F.array(box(west, F.lit(180.0)), box(F.lit(-180.0), east - 360.0)))
            .otherwise(F.array(box(west, east))))


def finite_in_range(value: Column, low: float, high: float) -> Column:
    """The number when it is finite and within range, else null."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & number.between(F.lit(float(low)), F.lit(float(high))), number)
