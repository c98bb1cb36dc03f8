"""The library's scalar and table functions, callable from SQL text.

Each is a SQL function whose body Catalyst inlines, so a call costs what the written-out expression costs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_BOX = "STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"

_SCALARS = {
    "box_width": (f"b {_BOX}", "DOUBLE", "greatest(0D, b.x2 - b.x1)"),
    "box_height": (f"b {_BOX}", "DOUBLE", "greatest(0D, b.y2 - b.y1)"),
    "box_area": (f"b {_BOX}", "DOUBLE", "greatest(0D, b.x2 - b.x1) * greatest(0D, b.y2 - b.y1)"),
    "box_overlap": (
        f"a {_BOX}, b {_BOX}",
        "DOUBLE",
        "greatest(0D, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0D, least(a.y2, b.y2) - greatest(a.y1, b.y1))",
    ),
    "box_iou": (
        f"a {_BOX}, b {_BOX}",
        "DOUBLE",
        "CASE WHEN box_area(a) + box_area(b) - box_overlap(a, b) > 0 "
        "THEN box_overlap(a, b) / (box_area(a) + box_area(b) - box_overlap(a, b)) ELSE 0D END",
    ),
    "f_beta": (
        "p DOUBLE, r DOUBLE, beta DOUBLE",
        "DOUBLE",
        "CASE WHEN beta * beta * p + r > 0 THEN (1 + beta * beta) * p * r / (beta * beta * p + r) ELSE 0D END",
    ),
    "wilson_low": (
        "k DOUBLE, n DOUBLE, z DOUBLE",
        "DOUBLE",
        "CASE WHEN n > 0 THEN greatest(0D, (k / n + z * z / (2 * n) "
        "- z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)) ELSE 0D END",
    ),
    "wilson_high": (
        "k DOUBLE, n DOUBLE, z DOUBLE",
        "DOUBLE",
        "CASE WHEN n > 0 THEN least(1D, (k / n + z * z / (2 * n) "
        "+ z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)) ELSE 1D END",
    ),
    "upper_median": (
        "v ARRAY<DOUBLE>",
        "DOUBLE",
        "get(array_sort(v), CAST(floor(size(v) / 2) AS INT))",
    ),
    # Table-shaped helpers return arrays, for use with LATERAL VIEW explode / inline.
    "even_picks": (
        "total BIGINT, k INT",
        "ARRAY<BIGINT>",
        "transform(sequence(0, k - 1), i -> CAST(floor(total * (i + 0.5D) / k) AS BIGINT))",
    ),
    "tile_origins": (
        "extent INT, tile INT, stride INT",
        "ARRAY<INT>",
        "array_union(sequence(0, greatest(extent - tile, 0), stride), array(greatest(extent - tile, 0)))",
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the functions as temporary SQL functions of this session; returns their names."""
    for name, (arguments, result, body) in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(_SCALARS)
