"""Package quantities from product texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Canonical count units, factors of volumes and weights.
COUNT_UNITS = {"tab": "tablet", "tablet": "tablet", "caplet": "caplet", "cap": "capsule", "capsule": "capsule", "pill": "pill", "sachet": "sachet", "strip": "strip", "vial": "vial", "bottle": "bottle", "pack": "pack", "packet": "pack", "piece": "piece", "pc": "piece", "unit": "unit"}
VOLUMES = {"ml": 1.0, "milliliter": 1.0, "cl": 10.0, "l": 1000.0, "liter": 1000.0, "litre": 1000.0}
WEIGHTS = {"g": 1.0, "gram": 1.0, "kg": 1000.0, "kilogram": 1000.0, "oz": 28.3495, "ounce": 28.3495, "lb": 453.592, "pound": 453.592}
STRENGTH = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(mg|g|mcg|µg|ug|iu)\b"
COUNT = r"(?i)([0-9]{1,6}(?:,[0-9]{3})*)\s*[x×]?\s*(tablets?|tabs?|caplets?|capsules?|caps?|pills?|sachets?|strips?|vials?|bottles?|pack(?:ets?|s)?|pieces?|pcs?|units?)\b"
PACK_OF = r"(?i)\b(?:pack|box|bottle|jar)\s+of\s+([0-9]{1,6})"
VOLUME = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(ml|milliliters?|cl|liters?|litres?|l)\b"
WEIGHT = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(kg|kilograms?|grams?|g|oz|ounces?|lb|pounds?)\b"
TIMES = r"(?i)[x×]\s*([0-9]{1,6})"


def _map(values: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]


def with_quantity(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds a struct(count, unit, strength) or null: counted units, then `pack of`, volume, weight, and a multiplier beside a strength.

    Every pattern is matched once, in a first projection; the second picks the first that found a number.
    """
    found = {}
    for kind, pattern in (("count", COUNT), ("pack", PACK_OF), ("volume", VOLUME), ("weight", WEIGHT), ("times", TIMES)):
        found[f"_{kind}"] = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    for kind, pattern in (("count", COUNT), ("volume", VOLUME), ("weight", WEIGHT)):
        found[f"_{kind}_unit"] = F.regexp_replace(F.lower(F.regexp_extract(text, pattern, 2)), "s$", "")
    strength = F.concat(F.regexp_extract(text, STRENGTH, 1), F.lower(F.regexp_extract(text, STRENGTH, 2)))
    found["_strength"] = F.when(strength != "", strength)
    made = lambda n, u: F.struct(n.alias("count"), u.alias("unit"), F.col("_strength").alias("strength"))
    picked = (F.when(F.col("_count") > 0, made(F.col("_count"), _map(COUNT_UNITS, F.col("_count_unit")))).when(F.col("_pack") > 0, made(F.col("_pack"), F.lit("unit")))
              .when(F.col("_volume") > 0, made(F.col("_volume") * _map(VOLUMES, F.col("_volume_unit")), F.lit("ml"))).when(F.col("_weight") > 0, made(F.col("_weight") * _map(WEIGHTS, F.col("_weight_unit")), F.lit("g")))
              .when(F.col("_strength").isNotNull() & (F.col("_times") > 0), made(F.col("_times"), F.lit("unit"))))
    return df.withColumns(found).withColumn(name, picked).drop(*found)
