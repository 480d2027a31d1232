"""Lambert azimuthal equal-area projection on an ellipsoid, as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the European equal-area grid (public registry): GRS 1980 ellipsoid, origin
#: 52 N 10 E, false easting 4 321 000 m, false northing 3 210 000 m.
SEMI_MAJOR, INVERSE_FLATTENING = 6378137.0, 298.257222101
ORIGIN_LAT, ORIGIN_LON = 52.0, 10.0
FALSE_EAST, FALSE_NORTH = 4321000.0, 3210000.0


def _authalic(e: float, sine):
    """The q of the authalic latitude; works on numbers and on columns."""
    log = F.log if isinstance(sine, Column) else math.log
    return (1 - e * e) * (sine / (1 - e * e * sine * sine) - log((1 - e * sine) / (1 + e * sine)) / (2 * e))


def to_equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres of a longitude and latitude in degrees."""
    f = 1 / INVERSE_FLATTENING
    e = math.sqrt(2 * f - f * f)
    lat0 = math.radians(ORIGIN_LAT)
    qp, q0 = _authalic(e, 1.0), _authalic(e, math.sin(lat0))
    beta0, rq = math.asin(q0 / qp), SEMI_MAJOR * math.sqrt(qp / 2)
    d = SEMI_MAJOR * math.cos(lat0) / math.sqrt(1 - (e * math.sin(lat0)) ** 2) / (rq * math.cos(beta0))
    beta = F.asin(_authalic(e, F.sin(F.radians(lat))) / qp)
    turn = F.radians(lon - ORIGIN_LON)
    b = rq * F.sqrt(2.0 / (1.0 + math.sin(beta0) * F.sin(beta) + math.cos(beta0) * F.cos(beta) * F.cos(turn)))
    x = FALSE_EAST + b * d * F.cos(beta) * F.sin(turn)
    y = FALSE_NORTH + b / d * (math.cos(beta0) * F.sin(beta) - math.sin(beta0) * F.cos(beta) * F.cos(turn))
    return x, y
