"""Source amplitudes, phase existence, and other closed forms of the signal models as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the amplitude models.
P_PHASES = ("P", "Pn", "pP", "PcP", "Pg")
S_PHASES = ("S", "Sn", "Lg", "ScP")
#: Radiation coefficient, square root of densities and velocities, source velocity (m/s), corner-frequency constant.
EARTHQUAKE = {"P": (0.44, 533901911953403.5, 6100.0, 0.41), "S": (0.60, 103111374869011.25, 3526.0, 0.49)}
STRESS_DROP_PA = 10.0 * 100000
EXPLOSION = {"v_p": 5500.0, "v_s": 3175.0, "g": 9.81, "rho": 2550.0, "cavity": 3500.0, "mu": 6780.0}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def log10_moment(mb) -> Column:
    """log10 of the seismic moment (N m) of a body-wave magnitude."""
    return 1.5 * (1.48 * _c(mb) - 2.42) + 9.1


def earthquake_logamp(mb, hz, phase) -> Column:
    """log10 source amplitude of an earthquake at a frequency; phases of neither kind count as P."""
    is_s = _c(phase).isin(*S_PHASES)
    pick = lambda i: F.when(is_s, EARTHQUAKE["S"][i]).otherwise(EARTHQUAKE["P"][i])
    log_moment = log10_moment(mb)
    corner = pick(3) * pick(2) * F.pow(STRESS_DROP_PA / F.pow(F.lit(10.0), log_moment), F.lit(1.0 / 3.0))
    return log_moment + F.log10(pick(0) / (4 * math.pi * pick(1))) - F.log10(1 + F.pow(_c(hz) / corner, F.lit(2.0)))


def explosion_logamp(mb, hz, phase) -> Column:
    """log10 source amplitude of an explosion in granite at a frequency."""
    k = EXPLOSION
    w = 2 * math.pi * _c(hz)
    kt = F.pow(F.lit(10.0), (_c(mb) - 4.45) / 0.75)
    depth = 122 * F.pow(kt, F.lit(1.0 / 3))
    pressure = k["rho"] * k["g"] * depth
    elastic = 162325 * F.pow(kt, F.lit(1.0 / 3)) * F.pow(pressure, F.lit(-0.417))
    w1 = 10914.0 / elastic
    w0 = F.when(_c(phase).isin(*P_PHASES), k["v_p"]).otherwise(k["v_s"]) / elastic
    cavity = k["cavity"] * F.pow(kt, F.lit(0.29)) * F.pow(depth, F.lit(-0.11))
    p0 = (4.0 * k["mu"] / 3.0) * F.pow(cavity / elastic, F.lit(3.0))
    peak = 1.5 * pressure
    gamma = (k["v_p"] / (2 * k["v_s"])) ** 2
    top = gamma * peak * elastic * F.sqrt(w * w + F.pow(w1 * p0 / peak, F.lit(2.0)))
    bottom = k["rho"] * k["v_p"] * F.sqrt(w * w + w1 * w1) * F.sqrt(F.pow(w0 * w0 - gamma * w * w, F.lit(2.0)) + w0 * w0 * w * w)
    return F.log10(top) - F.log10(bottom)


def amp_transfer(coda_height, mb, hz, phase) -> Column:
    return _c(coda_height) - earthquake_logamp(mb, hz, phase)


def _log_logistic(x: Column) -> Column:
    return -F.log1p(F.exp(-x))


def phase_exists_logp(distance, depth, box: tuple, half_lives=(40.0, 60.0, 5.0, 5.0), edge_prob: float = 0.01, split: tuple | None = None) -> Column:
    """Log-probability that a phase exists: soft edges of a box (min, max distance, min, max depth). split gives the
    distance at which the depth range changes and the second range."""
    d, z = _c(distance), _c(depth)
    k = math.log(1 / edge_prob - 1)
    low = lambda x, edge, half: _log_logistic((k / half) * (x - (edge + half))) if edge > 0 else F.lit(0.0)
    high = lambda x, edge, half: _log_logistic((k / half) * ((edge - half) - x))
    near = low(d, box[0], half_lives[0])
    far = high(d, box[1], half_lives[1])
    depths = low(z, box[2], half_lives[2]) + high(z, box[3], half_lives[3])
    if split is None:
        return near + far + depths
    deeper = low(z, split[1], half_lives[2]) + high(z, split[2], half_lives[3])
    return F.when(d < split[0], near + depths).otherwise(far + deeper)


def correct_azimuth_slowness(azimuth, slow, corr_azimuth, corr_slow) -> tuple[Column, Column]:
    """Azimuth and slowness less a bin's corrections; invalid readings stay, 360 stays 360."""
    a, s = _c(azimuth), _c(slow)
    moved = a - F.coalesce(_c(corr_azimuth), F.lit(0.0))
    wrapped = F.when(moved < 0, moved + 360).when(moved > 360, moved - 360).otherwise(moved)
    valid = (a >= 0) & (s > 0)
    return F.when(valid, wrapped).otherwise(a), F.when(valid, s - F.coalesce(_c(corr_slow), F.lit(0.0))).otherwise(s)


def count_logp(n, rate, seconds) -> Column:
    """Log-probability of n unordered Poisson arrivals at these times: n ln r - r T; at rate 0 only none is possible."""
    n, r = _c(n), _c(rate)
    return F.when(r > 0, n * F.ln(r) - r * _c(seconds)).when(n == 0, 0.0).otherwise(F.lit(float("-inf")))


def sample_index(t, start, srate) -> Column:
    """Index of the sample at a time; the small excess makes up for rounding."""
    return F.floor((_c(t) - _c(start)) * _c(srate) + 1e-4)


def safe_log(x, default: float | None = None) -> Column:
    return F.when(_c(x) > 0, F.ln(_c(x))).otherwise(F.lit(float("-inf") if default is None else default))
