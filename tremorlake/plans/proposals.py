"""Proposals of events from the grid of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremorlake.operators import models, proposals
from tremorlake.operators.lineage import stored

from . import views as v
from .registry import query

_STEP, _TICK, _RATE, _LEAST = 30.0, 10.0, 0.01, 0.0


def _km(lon, lat):
    return f"2*asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({lat})-radians(slat))/2),2) + cos(radians({lat}))*cos(radians(slat))*pow(sin((radians({lon})-radians(slon))/2),2)))))*6371.0"


def _votes(t0, tick, bin_name):
    """Logarithm of a Laplace mass of a bin around t0, less the rate of false detections."""
    cdf = lambda z: f"(CASE WHEN {z} < 0 THEN 0.5*exp(({z})/5.0) ELSE 1-0.5*exp(-({z})/5.0) END)"
    return f"ln(greatest({cdf(f'({bin_name} + 1) * {tick} - {t0}')} - {cdf(f'{bin_name} * {tick} - {t0}')}, 1e-12)) - ln({tick}) + 8"


_GRID = f"""WITH a AS (SELECT user_id AS sta, event_type AS phase, epoch(ts) AS atime, (user_id * 37 % 360 - 180.0) AS slon, (user_id * 17 % 181 - 90.0) AS slat FROM events JOIN supplier ON user_id = s_suppkey),
p AS (SELECT *, cell % 12 * 30.0 - 165 AS clon, floor(cell / 12) * 30.0 - 75 AS clat FROM a, (SELECT unnest(generate_series(0, 71)) AS cell)),
o AS (SELECT *, atime - {_km('clon', 'clat')} / 8.0 AS t0 FROM p),
n AS (SELECT *, CAST(floor(t0 / 10) AS BIGINT) + unnest([-1, 0, 1]) AS tbin FROM o),
b AS (SELECT cell, tbin, sta, phase, max({_votes('t0', '10.0', 'tbin')}) AS s FROM n GROUP BY ALL HAVING s > 0),
g AS (SELECT CAST(cell AS BIGINT) AS cell, tbin, sum(s) AS score, count(*) AS n, 0.1 * (sin(radians(floor(cell / 12) * 30.0 - 60)) - sin(radians(floor(cell / 12) * 30.0 - 90))) / 24 AS prior FROM b GROUP BY 1, 2, cell),
l AS (SELECT *, score + ln(prior) AS lp, score + ln(prior) - ln(1 - prior) AS odds FROM g)
"""


def _probabilities(spark, sf):
    stations = v.site(spark, sf).select("sta", F.col("lon").alias("slon"), F.col("lat").alias("slat"))
    templates = v.arrival(spark, sf).select("sta", F.col("iphase").alias("phase"), F.col("time").alias("atime"))
    grid = models.event_grid(templates, stations, _STEP, _STEP, _TICK)
    return stations, templates, proposals.with_probabilities(grid, _STEP, _STEP, _TICK, _RATE)


@query("m20_probabilities", _GRID + ", w AS (SELECT max(lp) AS m, sum(prior) AS listed, max(tbin) - min(tbin) + 1 AS bins FROM l), t AS (SELECT m, sum(exp(lp - m)) + (bins * 0.1 - listed) * exp(-m) AS total FROM l, w GROUP BY m, bins, listed) SELECT cell, count(*) AS bins, CAST(sum(n) AS BIGINT) AS votes, round(max(odds), 4) AS odds, round(sum(1 / (1 + exp(-odds))), 5) AS events, round(sum(exp(lp - m) / total), 7) AS p_one FROM l, t GROUP BY cell")
def m20_probabilities(spark, sf):
    by_cell = _probabilities(spark, sf)[2].groupBy(F.col("cell").cast("bigint").alias("cell"))
    return by_cell.agg(F.count("*").alias("bins"), F.sum("n").alias("votes"), F.round(F.max("odds"), 4).alias("odds"), F.round(F.sum("p_bin"), 5).alias("events"), F.round(F.sum("p_one"), 7).alias("p_one"))


@query(
    "m20_proposals",
    _GRID
    + f""", k AS (SELECT *, round(odds, 6) AS r FROM l WHERE odds >= {_LEAST}),
y AS (SELECT cell // 12 + unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) AS line, (cell + 12 + unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1])) % 12 AS place, tbin AS bin, cell, tbin, r FROM k),
y3 AS (SELECT line * 12 + place AS spot, bin + unnest([-1, 0, 1]) AS bin, cell, tbin, r FROM y WHERE line BETWEEN 0 AND 5),
z AS (SELECT k.cell, k.tbin, odds FROM k JOIN (SELECT spot, bin, max(row(r, -cell, -tbin)) AS best FROM y3 GROUP BY 1, 2) ON spot = cell AND bin = tbin WHERE best = row(r, -cell, -tbin)),
c AS (SELECT z.cell, tbin, sta, phase, atime, slon, slat, child, cell % 12 * 30.0 - 180 + (child % 5 + 0.5) * 6 AS lon, cell // 12 * 30.0 - 90 + (child // 5 + 0.5) * 6 AS lat FROM z JOIN a ON atime BETWEEN (tbin + 0.5) * 10 - 4000 AND (tbin + 0.5) * 10 + 4000, (SELECT unnest(generate_series(0, 24)) AS child)),
u AS (SELECT *, atime - {_km('lon', 'lat')} / 8.0 AS ft FROM c),
d AS (SELECT *, CAST(floor(ft / 5) AS BIGINT) + unnest([-1, 0, 1]) AS fbin FROM u),
e AS (SELECT cell, tbin, child, fbin, lon, lat, sta, phase, max({_votes('ft', '5.0', 'fbin')}) AS s FROM d WHERE fbin BETWEEN tbin * 2 - 2 AND tbin * 2 + 3 GROUP BY ALL HAVING s > 0),
f AS (SELECT cell, tbin, child, fbin, lon, lat, sum(s) AS s FROM e GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY cell, tbin ORDER BY round(s, 6) DESC, child, fbin) AS k, sum(exp(s)) OVER (PARTITION BY cell, tbin) + 150 - count(*) OVER (PARTITION BY cell, tbin) AS total FROM f)
SELECT cell, tbin, round(odds, 4) AS odds, lon, lat, (fbin + 0.5) * 5 AS time, round(s, 4) AS fine_score, round(exp(s) / total, 6) AS p FROM h JOIN z USING (cell, tbin) WHERE k = 1""",
)
def m20_proposals(spark, sf):
    stations, templates, grid = _probabilities(spark, sf)
    top = stored(proposals.local_maxima(grid, _STEP, _STEP, _LEAST), "proposals")
    fine = proposals.refined(top, templates, stations, _STEP, _STEP, _TICK)
    both = top.select("cell", "tbin", "odds").join(fine, ["cell", "tbin"])
    return both.select(F.col("cell").cast("bigint").alias("cell"), "tbin", F.round("odds", 4).alias("odds"), "lon", "lat", "time", F.round("fine_score", 4).alias("fine_score"), F.round("p", 6).alias("p"))
