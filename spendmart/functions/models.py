"""Model names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: a trailing context variant `[...]`, then a trailing release date
VARIANT_SUFFIX = r"\[.*\]\z"
RELEASE_SUFFIX = r"-[0-9]{8}\z"


def normalize_model(model: Column) -> Column:
    """The name prices are keyed by; NULL stays NULL. The cheap guards keep most rows away from the regular expressions."""
    plain = F.when(model.endswith("]"), F.regexp_replace(model, VARIANT_SUFFIX, "")).otherwise(model)
    return F.when(F.substring(plain, -9, 1) == "-", F.regexp_replace(plain, RELEASE_SUFFIX, "")).otherwise(plain)
