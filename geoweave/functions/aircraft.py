"""Scalar rules for aircraft positions and alert wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.fixed_values import EMERGENCY_SQUAWKS, LOW_ALTITUDE_FT, NACP_DEGRADED_MAX, NIC_DEGRADED_MAX

NO_REASON = "spatial-temporal proximity"


def aircraft_weight(military: Column, alt_ft: Column, emergency: Column, squawk: Column) -> Column:
    urgent = F.coalesce(emergency.isNotNull() & (emergency != ""), F.lit(False)) | F.coalesce(squawk.isin(*EMERGENCY_SQUAWKS), F.lit(False))
    weight = (F.lit(0.4) + F.when(military, F.lit(0.4)).otherwise(F.lit(0.0))
              + F.when(alt_ft < LOW_ALTITUDE_FT, F.lit(0.1)).otherwise(F.lit(0.0))
              + F.when(urgent, F.lit(0.2)).otherwise(F.lit(0.0)))
    return F.least(weight, F.lit(1.0))


def is_degraded(nic: Column, nac_p: Column) -> Column:
    """Null when the aircraft reports neither field."""
    low = F.coalesce(nic <= NIC_DEGRADED_MAX, F.lit(False)) | F.coalesce(nac_p <= NACP_DEGRADED_MAX, F.lit(False))
    return F.when(nic.isNotNull() | nac_p.isNotNull(), low)


def signed_one_decimal(value: Column) -> Column:
    from geoweave.functions.geo import round_to
    shown = round_to(F.abs(value), 1).cast("string")
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("+")), shown)


def alert_reason(military: Column, alt_ft: Column, is_conflict: Column, root: Column, goldstein: Column) -> Column:
    parts = F.concat_ws(
        "; ",
        F.when(military, F.lit("military aircraft")),
        F.when(alt_ft < LOW_ALTITUDE_FT, F.concat(F.lit("low altitude "), alt_ft.cast("string"), F.lit(" ft"))),
        F.when(is_conflict, F.concat(F.lit("conflict-coded event ("), root, F.lit(")"))),
        F.when(goldstein <= -5, F.concat(F.lit("Goldstein "), signed_one_decimal(goldstein))),
    )
    return F.when(parts == "", F.lit(NO_REASON)).otherwise(parts)


def fleet_reasons(positions: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Per position (its columns) the number `n` of events with equal `keys` and the greatest alert reason among them, without a row per pair.

    A reason is what the position says followed by what the event says. Of one key only the greatest words of an event matter, since equal beginnings do not change their order. So the
    events become one row a key, and the positions meet that.
    """
    none = F.lit(None)
    said = alert_reason(none.cast("boolean"), none.cast("int"), F.col("is_conflict"), F.col("root_code"), F.col("goldstein"))
    silent = said == NO_REASON
    most = events.select(*keys, said.alias("_said"), silent.alias("_silent")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("_said").alias("_any"), F.max(F.when(~F.col("_silent"), F.col("_said"))).alias("_said"))
    own = alert_reason(F.col("military"), F.col("alt_ft"), F.lit(False), none.cast("string"), none.cast("double"))
    met = positions.join(most, keys).withColumn("_own", own)
    return met.withColumn("reason", F.when(F.col("_own") == NO_REASON, F.col("_any")).otherwise(F.concat_ws("; ", "_own", "_said"))).drop("_own", "_any", "_said")
