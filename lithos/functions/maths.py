"""Scalar formulas on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST, LEAST = 1.7976931348623157e308, 5e-324


def log_base(x: Column, base: float) -> Column:
    """Logarithm to any base; null for x <= 0."""
    return F.ln(x) / math.log(base)


def squash(x: Column) -> Column:
    """Arc tangent scaled to (-1, 1)."""
    return F.atan(x) / (math.pi / 2)


def gaussian_log_pdf(x: Column, mean, sd) -> Column:
    z = (x - mean) / sd
    return -0.5 * z * z - F.ln(F.lit(sd) if not isinstance(sd, Column) else sd) - 0.5 * math.log(2 * math.pi)


def gaussian_pdf(x: Column, mean, sd) -> Column:
    return F.exp(gaussian_log_pdf(x, mean, sd))


def log_normal_pdf(x: Column, mean, sd) -> Column:
    return F.when(x > 0, gaussian_pdf(F.ln(x), mean, sd) / x).otherwise(0.0)


def gaussian_tail(z: Column) -> Column:
    """Upper tail of the standard normal by a rational approximation (error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def java_round(x: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(x + 0.5)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b; the largest double where b is 0."""
    return F.when(b == 0, F.lit(LARGEST)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b of doubles as processors and SQL engines divide: infinite by the signs of both where b is 0, NaN for 0 / 0."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def round_scaled(x: Column, digits: int) -> Column:
    """`x` times a power of ten, rounded half away from zero and divided again, as SQL engines round doubles. F.round() goes by
    the shortest decimal instead: 66.77 / 32 prints as 2.0865625 but is less, and rounds to 2.086562."""
    scale = float(10**digits)
    y = F.abs(x * scale)
    whole = F.floor(y).cast("double")
    away = F.when(y - whole >= 0.5, whole + 1).otherwise(whole)
    return F.when(y < 2.0**52, F.signum(x) * away / scale).when(y < float("inf"), x * scale / scale).otherwise(x)


def safe_log(x: Column) -> Column:
    """Logarithm of the absolute value; the least double where that is 0."""
    return F.when(x == 0, F.lit(LEAST)).otherwise(F.ln(F.abs(F.when(x == 0, F.lit(1.0)).otherwise(x))))


def whole_power(b: Column, e: Column) -> Column:
    """b to the nearest whole number of e."""
    return F.pow(b, java_round(e).cast("double"))


def spherical_variogram(d: Column, rng, sill) -> Column:
    """Spherical model without nugget."""
    q = d / rng
    return F.when(d <= rng, sill / 2 * (3 * q - q * q * q)).otherwise(sill)


def path_loss(d: Column, at_one: float, exponent: float) -> Column:
    """Signal strength (dBm) after a distance in metres, none lost below one."""
    return at_one - 10 * exponent * F.log10(F.greatest(d, F.lit(1.0)))


def detection(d: Column, reach: float, sight: Column, blocked: float = 0.5) -> Column:
    """Chance of detection: falls in a line to 0 at `reach`; times `blocked` without line of sight."""
    return F.greatest(F.lit(0.0), 1 - d / reach) * F.when(sight, 1.0).otherwise(blocked)


def log_factorial(n: Column) -> Column:
    """Stirling's series from 10 up, the exact value below."""
    exact = F.array(*(F.lit(math.lgamma(k + 1)) for k in range(10)))
    x = n.cast("double") + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 10, F.get(exact, n.cast("int"))).otherwise(series)


def binomial_log_pmf(k: Column, n: Column, p: Column) -> Column:
    """log P(k of n); a Poisson law with mean n * p from 1024 trials up."""
    whole = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.ln(p) + (n - k) * F.ln(1 - p)
    poisson = k * F.ln(n * p) - n * p - log_factorial(k)
    return F.when(n >= 1024, poisson).otherwise(whole)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def ordinal_shares(z: Column, cuts: list[float]) -> Column:
    """Probabilities of len(cuts) + 1 ordered classes: differences of logistic(cut - z)."""
    upto = [logistic(F.lit(float(c)) - z) for c in cuts] + [F.lit(1.0)]
    return F.array(upto[0], *(b - a for a, b in zip(upto, upto[1:])))


def grid_id(x: Column, y: Column, width: int) -> Column:
    return y * width + x


def grid_xy(i: Column, width: int) -> tuple[Column, Column]:
    return F.pmod(i, F.lit(width)), F.floor(i / width)


def gradient_colour(v: Column, lo: float, hi: float, colours: list[tuple[int, int, int]]) -> Column:
    """Struct (r, g, b) on a gradient of evenly spaced colours; ends beyond lo and hi."""
    at = F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)) * (len(colours) - 1)
    k = F.least(F.floor(at), F.lit(len(colours) - 2)).cast("int")
    share = at - k
    band = lambda n: F.array(*(F.lit(c[n]) for c in colours))
    mixed = lambda n: java_round(F.get(band(n), k) * (1 - share) + F.get(band(n), k + 1) * share).cast("int")
    return F.struct(*(mixed(n).alias(c) for n, c in enumerate("rgb")))


def speed_under_load(free: Column, volume: Column, capacity: Column, least: float = 1.0) -> Column:
    """Speed on a link: free / (1 + 0.2 * (volume / capacity)^10), not below `least`; `free` where there is no capacity."""
    q = volume / F.when(capacity > 0, capacity)
    return F.coalesce(F.greatest(F.lit(least), free / (1 + 0.2 * F.pow(q, F.lit(10.0)))), free)
