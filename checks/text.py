"""Small builders for the SQL side."""

from __future__ import annotations

EARTH = 6371.0088


def km(a: str, b: str, c: str, d: str) -> str:
    return (f"(2 * {EARTH}e0 * asin(sqrt(least(1e0, power(sin((radians({c}) - radians({a})) / 2), 2) + "
            f"cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2)))))")


def rnd(x: str, digits: int) -> str:
    scale = f"{10 ** digits}e0"
    return f"(floor(({x}) * {scale} + 5e-1) / {scale})"


def cell(x: str) -> str:
    return f"cast(floor({x}) as bigint)"


def values(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


SEVERITY = ("least(1e0, 0.15e0 + case when is_conflict then 0.35e0 else 0e0 end + greatest(0e0, -goldstein) / 10e0 * 0.3e0 "
            "+ greatest(0e0, -tone) / 15e0 * 0.1e0 + least(num_mentions, 50) / 50e0 * 0.1e0)")
WEIGHT = ("least(1e0, 0.4e0 + case when military then 0.4e0 else 0e0 end + case when alt_ft < 10000 then 0.1e0 else 0e0 end "
          "+ case when coalesce(emergency, '') <> '' or squawk in ('7500', '7600', '7700') then 0.2e0 else 0e0 end)")
DEGRADED = ("case when nic is null and nac_p is null then null else coalesce(nic <= 5, false) or coalesce(nac_p <= 5, false) end")
