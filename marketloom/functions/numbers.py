"""Numbers: headcount bands, curves, roundings and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Segment

#: Headcount band codes of the company register, low and high.
BANDS = {
    "00": (0, 0), "01": (1, 2), "02": (3, 5), "03": (6, 9), "11": (10, 19), "12": (20, 49), "21": (50, 99), "22": (100, 199), "31": (200, 249),
    "32": (250, 499), "41": (500, 999), "42": (1000, 1999), "51": (2000, 4999), "52": (5000, 9999), "53": (10000, 10000),
}


def rounded(x: Column, places: int) -> Column:
    """Half to even on the scaled double."""
    return F.rint(x * F.lit(10.0**places)) / F.lit(10.0**places)


def band_low(band: Column) -> Column:
    return F.create_map(*(F.lit(x) for k, (lo, _) in BANDS.items() for x in (k, lo)))[band]


def band_high(band: Column) -> Column:
    return F.create_map(*(F.lit(x) for k, (_, hi) in BANDS.items() for x in (k, hi)))[band]


def band_mid(band: Column) -> Column:
    return (band_low(band) + band_high(band)) / F.lit(2.0)


def interpolated(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear through (place, value) in order of place, level beyond both ends; of knots at one place the greatest value counts."""
    best: dict[float, float] = {}
    for at, y in knots:
        best[float(at)] = max(y, best.get(float(at), y))
    points = sorted(best.items())
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, u), (b, w) in zip(points, points[1:]):
        out = out.when(x <= b, F.lit(u) + F.lit(w - u) * ((x - a) / F.lit(b - a)))
    return out.otherwise(F.lit(points[-1][1]))


def size_curve(headcount: Column, seg: Segment) -> Column:
    """1 in the sweet spot, linear to edge_value at the band's edges and beyond; null without headcount or sweet spot."""
    if not seg.sweet_spot:
        return F.lit(None).cast("double")
    low, high = seg.sweet_spot
    edge = float(seg.edge_value)
    knots = [(low, 1.0), (high, 1.0), *([(seg.headcount_min, edge)] if seg.headcount_min < low else []), *([(seg.headcount_max, edge)] if seg.headcount_max > high else [])]
    return F.when(headcount.isNotNull(), rounded(interpolated(headcount, knots), 4))


def months_before(day: Column, months: int) -> Column:
    """Same day of an earlier month, the 28th at most."""
    first = F.add_months(F.trunc(day, "MM"), -months)
    return F.make_date(F.year(first), F.month(first), F.least(F.day(day), F.lit(28)))


def log_share(n: Column, top: Column) -> Column:
    return F.when((n <= 1) | (top <= 1), 0.0).otherwise(F.log10(n) / F.log10(top))
