"""Row predicates and lenient casts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# The contiguous United States' box, and the FIPS codes outside it.
US_BOX = (-125.0, 24.0, -66.0, 50.0)
SKIPPED_FIPS = ("02", "15", "60", "66", "69", "72", "78")


def lenient_double(text: Column) -> Column:
    """A number that stands alone in a text, or null.

    Most texts end with a digit, and then the cast knows a number as well as the pattern does, but
    for hexadecimal ones; only the others are held against it.
    """
    text = text.cast("string")
    plain = reduce(or_, [text.endswith(digit) for digit in "0123456789"]) & ~text.contains("x") & ~text.contains("X")
    return F.when(plain | text.rlike(NUMBER), text.try_cast("double"))


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with these columns, worked out once a row.

    A filter on a plain computed column would be moved before it, with a copy of all that the column
    is made of. Nothing is moved through the unfolding of a list, here of one element.
    """
    kept = [c for c in rows.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")
    return rows.select(*[F.col(f"`{c}`") for c in kept], made).select(*[F.col(f"`{c}`") for c in kept], "_made.*")


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive; box is lon_min, lat_min, lon_max, lat_max."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def in_world(lon: Column, lat: Column) -> Column:
    return in_box(lon, lat, (-180.0, -90.0, 180.0, 90.0))


def passes_accuracy(accuracy: Column, limit: float) -> Column:
    """Strictly between 0 and the limit; a negative limit lets everything pass."""
    return ((accuracy > 0) & (accuracy < limit)) | F.lit(limit < 0)


def valid_activity(activity: Column, require: bool = True, remove_unknown: bool = True) -> Column:
    """A named activity; ``Unknown``, in that spelling, isn't one."""
    return F.lit(not require) | ((activity != "") & (F.lit(not remove_unknown) | (activity != "Unknown")))


def passes_name(name: Column, names: list[str]) -> Column:
    """On the list; an empty list lets everything pass."""
    return name.isin(*names) if names else F.lit(True)


def pad_fips(code: Column) -> Column:
    return F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code)
