"""Small formulas for display: colours, labels, sphere and tile coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Position, red, green, blue.
COLOUR_STOPS = (
    (0.00, 40, 60, 100),
    (0.15, 60, 100, 160),
    (0.30, 100, 160, 220),
    (0.45, 200, 80, 120),
    (0.60, 255, 90, 90),
    (0.75, 255, 160, 60),
    (0.90, 255, 220, 80),
    (1.00, 255, 255, 200),
)


def colour(z: Column) -> Column:
    """Red, green and blue, 0 to 255, on the ramp between the stops."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), z))
    out = None
    for (p, *low), (q, *high) in zip(COLOUR_STOPS, COLOUR_STOPS[1:], strict=False):
        part = (t - F.lit(p)) / F.lit(q - p)
        rgb = F.struct(*[F.floor(F.lit(float(a)) + F.lit(float(b - a)) * part + F.lit(0.5)).cast("int").alias(c) for c, a, b in zip(("red", "green", "blue"), low, high, strict=True)])
        out = F.when(t <= q, rgb) if out is None else out.when(t <= q, rgb)
    return out


def sphere(lon: Column, lat: Column, radius: Column | float = 1.0) -> dict[str, Column]:
    """x, y, z on a sphere, with y to the north and longitudes running clockwise seen from there."""
    r = F.lit(radius) if isinstance(radius, float) else radius
    a, b = F.radians(lat), F.radians(-lon)
    return {"px": r * F.cos(a) * F.cos(b), "py": r * F.sin(a), "pz": r * F.cos(a) * F.sin(b)}


def human_count(n: Column, decimals: int = 1) -> Column:
    """1234567 as 1.2M, 1234 as 1.2k (or without decimals), 123 as it is."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / F.lit(1e6))).when(n >= 1_000, F.format_string(f"%.{decimals}fk", n / F.lit(1e3))).otherwise(n.cast("string"))


def first_label(abbrev: Column, code: Column, name: Column) -> Column:
    full = [F.nullif(c, F.lit("")) for c in (abbrev, code, F.substring(name, 1, 3))]
    return F.coalesce(*full, F.lit("?"))


def cell_label(resolution: Column) -> Column:
    """The width of a cell in degrees."""
    return F.concat(F.round(F.lit(360.0) / resolution, 4).cast("string"), F.lit(" degrees"))


def zoom_for(span: Column) -> Column:
    """The map zoom, 12 to 18, at which a span of degrees takes about two tiles."""
    return F.greatest(F.lit(12), F.least(F.lit(18), F.floor(F.log2(F.lit(360.0) / span)).cast("int") + 1))


def tile_x(lon: Column, zoom: Column) -> Column:
    return F.floor((lon + F.lit(180.0)) / F.lit(360.0) * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_y(lat: Column, zoom: Column) -> Column:
    a = F.radians(lat)
    return F.floor((F.lit(1.0) - F.log(F.tan(a) + F.lit(1.0) / F.cos(a)) / F.pi()) / F.lit(2.0) * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_lon(x: Column, zoom: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * F.lit(360.0) - F.lit(180.0)


def tile_lat(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (F.lit(1.0) - F.lit(2.0) * y / F.pow(F.lit(2.0), zoom)))))
