"""Box algebra as column expressions. A box is a struct<x1, y1, x2, y2: double> in pixels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BOX_TYPE = "struct<x1:double,y1:double,x2:double,y2:double>"


def _d(value) -> Column:
    column = value if isinstance(value, Column) else F.lit(value)
    return column.cast("double")


def make_box(x1, y1, x2, y2) -> Column:
    return F.struct(_d(x1).alias("x1"), _d(y1).alias("y1"), _d(x2).alias("x2"), _d(y2).alias("y2"))


def box_of(prefix: str = "") -> Column:
    """The box held in four flat columns."""
    return make_box(*(F.col(f"{prefix}{name}") for name in ("x1", "y1", "x2", "y2")))


def box_width(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["x2"] - box["x1"])


def box_height(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["y2"] - box["y1"])


def box_area(box: Column) -> Column:
    return box_width(box) * box_height(box)


def box_centre(box: Column) -> Column:
    return F.struct(((box["x1"] + box["x2"]) / 2).alias("x"), ((box["y1"] + box["y2"]) / 2).alias("y"))


def intersection(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when the union is empty."""
    inter = intersection(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def from_centre_size(cx, cy, w, h) -> Column:
    cx, cy, w, h = map(_d, (cx, cy, w, h))
    return make_box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def from_corner_size(x, y, w, h) -> Column:
    x, y, w, h = map(_d, (x, y, w, h))
    return make_box(x, y, x + w, y + h)


def normalise(box: Column, width, height) -> Column:
    return make_box(box["x1"] / width, box["y1"] / height, box["x2"] / width, box["y2"] / height)


def denormalise(box: Column, width, height) -> Column:
    return make_box(box["x1"] * width, box["y1"] * height, box["x2"] * width, box["y2"] * height)


def offset(box: Column, dx, dy) -> Column:
    return make_box(box["x1"] + dx, box["y1"] + dy, box["x2"] + dx, box["y2"] + dy)


def undo_padding(box: Column, scale, pad_left, pad_top) -> Column:
    """Map a box from a padded, scaled model input back to the source frame."""
    scale = F.greatest(_d(scale), F.lit(1e-9))
    return make_box(
        (box["x1"] - pad_left) / scale,
        (box["y1"] - pad_top) / scale,
        (box["x2"] - pad_left) / scale,
        (box["y2"] - pad_top) / scale,
    )


def clip(box: Column, width, height) -> Column:
    def inside(value: Column, limit) -> Column:
        return F.least(F.greatest(value, F.lit(0.0)), _d(limit))

    return make_box(
        inside(box["x1"], width), inside(box["y1"], height), inside(box["x2"], width), inside(box["y2"], height)
    )
