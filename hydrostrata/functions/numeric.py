"""Scalar columns: transforms, distributions, covariance models and plane geometry. All are built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forward transforms by name.
TRANSFORMS = {
    "none": lambda c: c,
    "log10": F.log10,
    "ln": F.ln,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "inverse": lambda c: F.lit(1.0) / c,
    "square": lambda c: c * c,
}


def transform(name: str, c: Column) -> Column:
    """A named transform; null where the value is negative, as the transforms need values from 0 on."""
    return F.when(c >= 0, TRANSFORMS[name](c))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null, unlike with least and greatest alone."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def rotate(x: Column, y: Column, x0: float, y0: float, degrees: float) -> tuple[Column, Column]:
    """Local to global coordinates of a grid turned by `degrees` about (x0, y0)."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return x * c - y * s + x0, x * s + y * c + y0


def unrotate(x: Column, y: Column, x0: float, y0: float, degrees: float) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return (x - x0) * c + (y - y0) * s, (y - y0) * c - (x - x0) * s


def turn(dx: Column, dy: Column, angle: float, ratio: float) -> tuple[Column, Column]:
    """Offsets along the major axis, whose azimuth is angle degrees, and along the minor one, stretched by 1 / ratio."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return dx * s + dy * c, (dx * c - dy * s) / ratio


def anisotropic_distance(dx: Column, dy: Column, angle: float, ratio: float) -> Column:
    """Distance with the minor axis stretched by 1 / ratio; angle is the major axis' azimuth in degrees."""
    major, minor = turn(dx, dy, angle, ratio)
    return F.sqrt(major * major + minor * minor)


def rectangle(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Ring of the rectangle with centre (x, y), counter-clockwise from the lower left."""
    corner = lambda a, b: F.struct((x + a * width / 2).alias("x"), (y + b * height / 2).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def transform_shares(name: str, values: Column) -> Column:
    """A transform of an array of values, left as they are in a row with a negative one."""
    return F.when(F.array_min(values) >= 0, F.transform(values, lambda v: transform(name, v))).otherwise(values)


def covariance(kind: str, d: Column, nugget: float, sill: float, reach: float) -> Column:
    """Covariance at distance d; sill is the partial sill, and the nugget counts at distance 0 only."""
    h = d / reach
    body = {
        "spherical": lambda: F.when(h < 1, sill * (1 - 1.5 * h + 0.5 * h * h * h)).otherwise(0.0),
        "exponential": lambda: sill * F.exp(-3 * h),
        "gaussian": lambda: sill * F.exp(-49.0 / 16.0 * h * h),
        "hole": lambda: sill * F.cos(math.pi * h),
        "circular": lambda: F.when(h < 1, sill * (1 - 2 / math.pi * (h * F.sqrt(1 - h * h) + F.asin(h)))).otherwise(0.0),
        "power": lambda: F.pow(d, F.lit(reach)) * sill,
        "linear": lambda: F.lit(sill) - h,
    }[kind]()
    return body + F.when(d < 1e-10, nugget).otherwise(0.0)


#: Fixed values of the rational approximation of the normal tail (Adams 1969, algorithm 39).
_A = (0.398942280444, 0.399903438504, 5.75885480458, 29.8213557808, 2.62433121679, 48.6959930692, 5.92885724438)
_B = (0.398942280385, 3.8052e-08, 1.00000615302, 3.98064794e-04, 1.98615381364, 0.151679116635, 5.29330324926, 4.8385912808, 15.1508972451, 0.742380924027, 30.789933034, 3.99019417011)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, by algorithm 39."""
    a, y = F.abs(x), 0.5 * x * x
    near = 0.5 - a * (_A[0] - _A[1] * y / (y + _A[2] - _A[3] / (y + _A[4] + _A[5] / (y + _A[6]))))
    far = F.exp(-y) * _B[0] / (a - _B[1] + _B[2] / (a + _B[3] + _B[4] / (a - _B[5] + _B[6] / (a + _B[7] - _B[8] / (a + _B[9] + _B[10] / (a + _B[11]))))))
    tail = F.when(a <= 1.28, near).when(a <= 12.7, far).otherwise(0.0)
    return F.when(x < 0, tail).otherwise(1 - tail)


def standard_log(x: Column, mu: Column, sigma: Column) -> Column:
    """The standard normal variate of a lognormal one; null where x is not positive."""
    return F.when(x > 0, (F.ln(x) - mu) / sigma)


#: Cubic feet a second in cubic metres a day.
CFS_TO_M3_DAY = 0.3048**3 * 86400


def lognormal_cdf(x: Column, mu: Column, sigma: Column) -> Column:
    return F.when(x <= 0, 0.0).otherwise(normal_cdf((F.ln(F.greatest(x, F.lit(1e-300))) - mu) / sigma))
