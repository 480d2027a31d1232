"""Scalar expressions: rounding, clipping, null handling, labels, nested flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def around(x: Column, digits: int) -> Column:
    """Round half to even, negative digits included."""
    return F.bround(x, digits)


def rounded(x: Column, digits: int) -> Column:
    """Round half away from zero as SQL engines do it with doubles: the scaled value to a whole number, without decimals."""
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def nan_to_zero(x: Column) -> Column:
    """Null and NaN become 0, infinities the largest finite doubles."""
    most = 1.7976931348623157e308
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    tens, ones = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    suffix = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def hit_count(document: Column) -> Column:
    """The number of features a feature service says it has."""
    found = F.regexp_extract(document, 'numberMatched="([0-9]+)"', 1)
    return F.when(found != "", found.cast("bigint"))


def is_noise(label: Column) -> Column:
    return F.endswith(label, F.lit("-1"))


def morph_label(*parts: Column) -> Column:
    """region_component_cluster labels."""
    return F.concat_ws("_", *(p.cast("string") for p in parts))


def last_token(label: Column) -> Column:
    return F.element_at(F.split(label, "_"), -1)


def tunnel_share(flags: Column) -> Column:
    """-1 without a tunnel flag, else the summed extent (0 to 1) of the flags that have one."""
    extent = lambda g: F.coalesce(F.try_element_at(g["between"], F.lit(2)) - F.try_element_at(g["between"], F.lit(1)), F.lit(0.0))
    step = lambda p, g: F.when(F.array_contains(g["values"], "is_tunnel"), F.greatest(p, F.lit(0.0)) + extent(g)).otherwise(p)
    return F.aggregate(flags, F.lit(-1.0), step)


def is_long_tunnel(flags: Column, length: Column, limit: float = 50.0) -> Column:
    """True if tunnels cover more than ``limit``, or a tunnel is flagged without extent."""
    share = tunnel_share(flags)
    return F.coalesce((share * length > limit) | (share == 0), F.lit(False))


def width_class(x: Column, edges: Column) -> Column:
    """Number of ascending edges below x: class k holds edge[k-1] < x <= edge[k]."""
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e < x)))


def hex_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial coordinates of the pointy-top hexagon (side ``size``) that holds a point."""
    q = (F.sqrt(F.lit(3.0)) / 3 * x - y / 3) / size
    r = 2.0 / 3 * y / size
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q_off = (dq > dr) & (dq > ds)
    r_off = ~q_off & (dr > ds)
    return F.when(q_off, -rr - rs).otherwise(rq).cast("int"), F.when(r_off, -rq - rs).otherwise(rr).cast("int")


def morton(x: Column, y: Column, bits: int = 16) -> Column:
    """Z-order key of two non-negative integers."""
    key = F.lit(0).cast("bigint")
    for b in range(bits):
        for shift, v in ((2 * b, x), (2 * b + 1, y)):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(v.cast("bigint"), b).bitwiseAND(F.lit(1).cast("bigint")), shift))
    return key
