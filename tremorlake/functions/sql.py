"""The library's functions for plain SQL: geodesics as SQL functions, which Catalyst inlines, and bulletin parsers as table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_POINTS = "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE"
_HALF = "pow(sin((radians(lat1) - radians(lat2)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon1) - radians(lon2)) / 2), 2)"
_COSINE = "try_divide(sin(radians(lat2)) * cos(radians(lat1)) - cos(radians(lat2)) * sin(radians(lat1)) * cos(radians(lon2) - radians(lon1)), sin(radians(dist_deg(lon1, lat1, lon2, lat2))))"

#: Name and arguments, type and body. Later ones may call earlier ones.
FUNCTIONS = [
    (f"dist_deg({_POINTS})", "DOUBLE", f"degrees(2 * asin(sqrt(least(1D, greatest(0D, {_HALF})))))"),
    (f"dist_km({_POINTS})", "DOUBLE", "radians(dist_deg(lon1, lat1, lon2, lat2)) * 6371D"),
    ("degdiff(a DOUBLE, b DOUBLE)", "DOUBLE", "CASE WHEN pmod(b - a, 360D) > 180 THEN pmod(b - a, 360D) - 360 ELSE pmod(b - a, 360D) END"),
    ("wrap_lon(lon DOUBLE)", "DOUBLE", "pmod(pmod(lon + 180, 360D) + 360, 360D) - 180"),
    (f"azimuth({_POINTS})", "DOUBLE", f"CASE WHEN sin(radians(lon2) - radians(lon1)) >= 0 THEN degrees(acos(greatest(-1D, least(1D, {_COSINE})))) ELSE 360 - degrees(acos(greatest(-1D, least(1D, {_COSINE})))) END"),
    ("julian_to_epoch(yyyyddd INT)", "DOUBLE", "CASE WHEN yyyyddd > 0 THEN CAST(unix_date(date_add(make_date(CAST(floor(yyyyddd / 1000) AS INT), 1, 1), yyyyddd % 1000 - 1)) AS DOUBLE) * 86400 END"),
]


@udtf(returnType="eventid bigint, time double, lat double, lon double, depth double, mb double")
class PhaseBulletin:
    """Events of a text of lines "# year month day hour minute second lat lon depth mag ... id"; other lines and those that can't be read are skipped."""

    def eval(self, text: str):
        from datetime import datetime, timezone

        for line in (text or "").split("\n"):
            t = line.split()
            if line.lstrip().startswith("#") and 15 <= len(t) <= 17:
                try:
                    day = datetime(*map(int, t[1:6]), tzinfo=timezone.utc).timestamp()
                    yield int(t[-1]), day + float(t[6]), *map(float, t[7:11])
                except ValueError:
                    continue


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    for signature, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    spark.udtf.register("phase_bulletin", PhaseBulletin)
