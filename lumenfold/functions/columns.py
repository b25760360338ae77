"""Scalar column functions: tolerant casts, angles, stretches, formatting."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become NULL: missing values everywhere."""
    d = c.cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")), d)


def safe_div(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def safe_float(text: Column, default: float) -> Column:
    return F.coalesce(finite(F.trim(text).try_cast("double")), F.lit(default))


def safe_int(text: Column, default: int) -> Column:
    return F.coalesce(finite(F.trim(text).try_cast("double")).try_cast("bigint"), F.lit(default)).cast("long")


def boolish(text: Column, default: bool) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes", "on"), True).when(t.isin("0", "false", "no", "off"), False).otherwise(F.lit(default))


def winsor_limits(low: Column, high: Column) -> tuple[Column, Column]:
    one = lambda c: F.coalesce(clamp(finite(c), 0.0, 0.49), F.lit(0.05))
    return one(low), one(high)


# Spellings of the two mount kinds.
EQUATORIAL = ("EQ", "EQUATORIAL", "GEM", "GERMAN")
ALTAZ = ("ALTZ", "ALT-AZ", "ALT/AZ", "ALT-AZM", "ALTAZ", "ALTITUDE-AZIMUTH")


def mount(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.when(t.isin(*EQUATORIAL), "EQ").when(t.isin(*ALTAZ), "ALTZ")


def mount_mode(eqmode: Column) -> Column:
    n = F.trim(eqmode).try_cast("int")
    return F.when(n == 1, "EQ").when(n == 0, "ALT_AZ").when(n.isNotNull(), F.concat(F.lit("EQMODE_"), n.cast("string"))).otherwise("UNKNOWN")


def instrument(creator: Column, instrume: Column) -> Column:
    """The instrument's label: known creators first, then the instrument's own name, then the creator's."""
    kept = lambda c: F.nullif(F.trim(c), F.lit(""))
    made, own = F.upper(F.coalesce(creator, F.lit(""))), F.upper(F.coalesce(instrume, F.lit("")))
    # creators' marks and labels, in the order in which they apply.
    return (
        F.when(made.contains("SEESTAR S50"), "Seestar S50")
        .when(made.contains("SEESTAR S30"), "Seestar S30")
        .when(made.contains("ASIAIR"), F.coalesce(kept(instrume), F.lit("ASIAIR")))
        .when(own.contains("ASI"), F.coalesce(kept(instrume), F.lit("ASI (Unknown)")))
        .otherwise(F.coalesce(kept(instrume), kept(creator)))
    )


def sexagesimal(text: Column, is_ra: bool) -> Column:
    """h/m/s or degree marks to degrees, NULL if a part is no number; a leading minus holds for all parts of a declination."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "s", ""), "[hm°']", ":")
    parts = F.transform(F.filter(F.split(plain, ":"), lambda p: p != ""), lambda p: F.trim(p).try_cast("double"))
    get = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(0.0))
    first = F.try_element_at(parts, F.lit(1))
    if is_ra:
        value = (first + get(2) / 60 + get(3) / 3600) * 15
    else:
        value = F.when(plain.startswith("-"), -1.0).otherwise(1.0) * (F.abs(first) + get(2) / 60 + get(3) / 3600)
    return F.when(~F.exists(parts, lambda p: p.isNull()), value)


def circular_delta(a: Column, b: Column) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def planar_distance(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    d = circular_delta(ra1, ra2)
    return F.sqrt(d * d + (dec1 - dec2) * (dec1 - dec2))


def great_circle(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    r = math.pi / 180
    c = F.sin(dec1 * r) * F.sin(dec2 * r) + F.cos(dec1 * r) * F.cos(dec2 * r) * F.cos((ra1 - ra2) * r)
    return F.acos(clamp(c, -1.0, 1.0)) / r


def eta_hms(seconds: Column) -> Column:
    """Half-up seconds as hh:mm:ss, with a plus when the estimate is overrun."""
    s = F.floor(F.abs(seconds) + 0.5).cast("long")
    body = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)
    return F.when(seconds < 0, F.concat(F.lit("+"), body)).otherwise(body)


def asinh_stretch(v: Column, low: Column, high: Column, a: float) -> Column:
    x = clamp(safe_div(v - low, high - low), 0.0, 1.0)
    return F.asinh(x / a) / F.asinh(F.lit(1 / a))


def rescale_u16(v: Column, low: Column, high: Column) -> Column:
    return F.floor(clamp(safe_div(v - low, high - low), 0.0, 1.0) * 65535).cast("int")


def epoch_days(text: Column) -> Column:
    """ISO text, or one of the other usual patterns, to days since 1970; naive times are UTC."""
    # The accepted patterns, in order.
    patterns = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")
    stamp = F.coalesce(F.trim(text).try_cast("timestamp"), *[F.try_to_timestamp(F.trim(text), F.lit(p)) for p in patterns])
    return F.unix_micros(stamp) / F.lit(86400e6)


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of (x, y); fewer than three points have none."""
    n = F.size(points)
    term = lambda i: points[i]["x"] * points[(i + 1) % n]["y"] - points[(i + 1) % n]["x"] * points[i]["y"]
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when(n >= 3, F.abs(total) / 2).otherwise(0.0)
