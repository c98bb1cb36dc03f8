"""Ground truth: normalised label text and nested annotation documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from watchgrid.functions.geometry import from_centre_size, from_corner_size

COCO_SCHEMA = (
    "images array<struct<id: long, file_name: string>>, "
    "annotations array<struct<image_id: long, category_id: long, bbox: array<double>>>, "
    "categories array<struct<id: long, name: string>>"
)


def yolo_boxes(lines: DataFrame, images: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """Label lines ``class cx cy w h`` (image_id, line_no, line) to pixel boxes. Lines with fewer than five fields are
    skipped; ``images`` (image_id, width, height) gives the frame size."""
    parts = lines.select("image_id", "line_no", F.split(F.trim("line"), r"\s+").alias("p")).filter(F.size("p") >= 5)
    if classes is not None:
        parts = parts.filter(F.col("p")[0].isin(list(classes)))
    boxed = parts.join(images.select("image_id", "width", "height"), "image_id")
    cx, cy, w, h = (F.col("p")[i].cast("double") for i in (1, 2, 3, 4))
    box = from_centre_size(cx * F.col("width"), cy * F.col("height"), w * F.col("width"), h * F.col("height"))
    return boxed.select("image_id", F.col("line_no").alias("truth_seq"), F.col("p")[0].alias("class"), box.alias("box"))


def coco_truth(document: DataFrame, merge: DataFrame) -> DataFrame:
    """Annotations reduced to merged classes. Classes outside the map and boxes at most one pixel wide or high are
    dropped, and with them images left without a label."""
    images = document.select(F.inline("images")).select(F.col("id").alias("image_id"), "file_name")
    names = document.select(F.inline("categories")).select(F.col("id").alias("category_id"), F.col("name"))
    found = document.select(F.posexplode("annotations").alias("truth_seq", "a")).select("truth_seq", "a.*")
    return coco_rows(found, images, names, merge)


def coco_rows(annotations: DataFrame, images: DataFrame, categories: DataFrame, merge: DataFrame) -> DataFrame:
    """The same over already flattened tables."""
    wide, high = F.col("bbox")[2], F.col("bbox")[3]
    kept = annotations.filter((wide > 1) & (high > 1))
    wanted = categories.join(merge, categories["name"] == merge["model_class"]).select(
        "category_id", "merged_class"
    )
    box = from_corner_size(F.col("bbox")[0], F.col("bbox")[1], wide, high)
    return (
        kept.join(wanted, "category_id")
        .join(images, "image_id")
        .select("image_id", "file_name", "truth_seq", F.col("merged_class").alias("class"), box.alias("box"))
    )
