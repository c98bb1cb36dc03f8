"""Small dimension tables. Results must agree on them, so they are stated as plain data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HAZARDS = ["fire", "flood", "traffic", "drowning", "building_access"]
VIEWPOINTS = ["ground", "oblique", "nadir_aerial"]

#: context -> (hazards that can occur there, default viewpoint)
CONTEXTS = {
    "forest": (["fire"], "oblique"),
    "wildland_interface": (["fire", "traffic"], "oblique"),
    "street": (["flood", "traffic", "building_access"], "oblique"),
    "urban_block": (["flood", "building_access"], "oblique"),
    "river": (["flood", "drowning"], "oblique"),
    "coast": (["drowning"], "oblique"),
    "motorway": (["traffic"], "oblique"),
    "earthquake_zone": (["building_access"], "nadir_aerial"),
    "uav_search": (["building_access", "drowning"], "nadir_aerial"),
}

#: hazard -> {viewpoint served: model}
ENVELOPE = {
    "fire": {"ground": "fire", "oblique": "fire"},
    "flood": {"ground": "flood", "oblique": "flood", "nadir_aerial": "flood_aerial"},
    "traffic": {"ground": "traffic", "oblique": "traffic"},
    "drowning": {"oblique": "person_in_water", "nadir_aerial": "person_in_water"},
    "building_access": {"oblique": "building_access", "nadir_aerial": "building_access"},
}

#: Labels that depict a person and are therefore blurred in evidence.
PERSON_LABELS = ["civilian", "rescue_team", "swimmer", "person", "people"]

#: Building classes: merged class -> classes a model emits.
CLASS_MERGE = {
    "civilian": ["civilian_visible", "group_of_civilians"],
    "rescue_team": ["rescue_team"],
    "entry_accessible": [
        "entry_door_accessible",
        "entry_window_accessible",
        "entry_gap_accessible",
        "entry_gap_block_accessible",
    ],
    "entry_blocked": ["entry_door_blocked", "entry_window_blocked"],
    "building_collapsed": ["building_collapsed"],
}

#: The building model's own classes, in training order.
BUILDING_MODEL_CLASSES = [
    "backhoe_loader", "bridge", "building_collapsed", "building_damaged", "building_undamaged", "bus", "car_damaged",
    "car_undamaged", "civilian_visible", "common_dump_truck", "crawler_crane", "crawler_loader", "debris_heavy",
    "debris_light", "debris_moderate", "drone_landing_zone_safe", "entry_door_accessible", "entry_door_blocked",
    "entry_gap_accessible", "entry_gap_block_accessible", "entry_window_accessible", "entry_window_blocked",
    "excavator", "group_of_civilians", "rescue_team", "road", "rubble", "truck",
]

WATER_MODEL_CLASSES = ["swimmer", "boat", "jetski", "life_saving_appliances", "buoy"]

#: Classes each detector may raise an alarm on; everything else it sees is context.
ALARM_LABELS = {
    "fire": ["smoke"],
    "flood": ["water"],
    "traffic": ["accident"],
    "drowning": ["swimmer"],
    "building_access": ["civilian"],
}

HAZARD_LABELS = {
    "fire": "wildfire smoke",
    "flood": "flooding",
    "drowning": "people in open water",
    "building_access": "people in damaged buildings",
    "traffic": "road incidents",
}

#: Aerial mask values and their names, and those that count as water.
MASK_LABELS = {
    0: "background",
    1: "building-flooded",
    2: "building-non-flooded",
    3: "road-flooded",
    4: "road-non-flooded",
    5: "water",
    6: "tree",
    7: "vehicle",
    8: "pool",
    9: "grass",
}
WATER_MASK_VALUES = [3, 5, 8]


def context_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(name, hazards, view) for name, (hazards, view) in CONTEXTS.items()],
        "context string, context_hazards array<string>, default_viewpoint string",
    )


def envelope_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(h, v, m) for h, served in ENVELOPE.items() for v, m in served.items()],
        "hazard string, viewpoint string, model string",
    )


def merge_dim(spark: SparkSession, merge: dict[str, list[str]] | None = None) -> DataFrame:
    pairs = [(source, target) for target, sources in (merge or CLASS_MERGE).items() for source in sources]
    return spark.createDataFrame(pairs, "model_class string, merged_class string")


def mask_label_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(v, n, v in WATER_MASK_VALUES) for v, n in MASK_LABELS.items()], "value int, name string, is_water boolean"
    )
