"""Dates, percentages, geometry and array functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT_DATE, LOOSE_DATE = r"(\d{4}/\d{2}/\d{2})", r"(\d{4}[/-]\d{1,2}[/-]\d{1,2})"


def month_text(date: Column) -> Column:
    """Second part of a date with slashes, as text; else null."""
    return F.when(F.contains(date, F.lit("/")), F.get(F.split(date, "/"), F.lit(1)))


def month_of(date: Column) -> Column:
    """Month of a date text; null when it is no date."""
    return F.month(F.coalesce(F.try_to_timestamp(date, F.lit("yyyy/MM/dd")), F.try_to_timestamp(date, F.lit("yyyy-MM-dd")), F.try_to_timestamp(date, F.lit("yyyy/M/d"))))


def cyclic_month(month: Column) -> Column:
    """[sin, cos] of the month's angle; [0, 0] when missing or out of range."""
    angle = month * (2 * math.pi / 12)
    return F.when(month.between(1, 12), F.array(F.sin(angle), F.cos(angle))).otherwise(F.array(F.lit(0.0), F.lit(0.0)))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Rounded half-even; 0 when the whole is 0 or missing."""
    return F.bround(F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0)), digits)


def is_recent(ts: Column, now: Column, seconds: int = 600) -> Column:
    """Whether less than so many seconds, parts of them counted, have passed since."""
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp")) < seconds * 1_000_000


def corner_box(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Normalised centre box to struct(x, y, w, h, area) in pixels; sides rounded to one decimal, the area not."""
    side = {"x": (cx - w / 2) * width, "y": (cy - h / 2) * height, "w": w * width, "h": h * height}
    return F.struct(*(F.bround(v, 1).alias(k) for k, v in side.items()), (w * width * h * height).alias("area"))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two centre boxes (keys cx, cy, w, h)."""
    def overlap(c: str, s: str) -> Column:
        return F.greatest(F.least(a[c] + a[s] / 2, b[c] + b[s] / 2) - F.greatest(a[c] - a[s] / 2, b[c] - b[s] / 2), F.lit(0.0))

    inter = overlap("cx", "w") * overlap("cy", "h")
    return F.coalesce(F.try_divide(inter, a["w"] * a["h"] + b["w"] * b["h"] - inter), F.lit(0.0))


def crop_rows(height: Column, top: float = 0.12, bottom: float = 0.90) -> Column:
    """struct(top, bottom, ok): pixel rows that stay when overlay bands are cut; ok is false if none do."""
    a, b = (height * F.lit(top)).cast("int"), (height * F.lit(bottom)).cast("int")
    return F.struct(a.alias("top"), b.alias("bottom"), (b > a).alias("ok"))


def arg_max(a: Column) -> Column:
    """Index from 0 of the largest value; the first of equals."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top_indices(a: Column, k: int) -> Column:
    """Indices from 0 of the k largest values, largest first; the lower index of equals."""
    pairs = F.transform(a, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda z: z["i"])
