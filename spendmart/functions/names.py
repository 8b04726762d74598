"""Display names of machines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendmart.functions.paths import WHITE_SPACE, trim_white
from spendmart.schemas import UNATTRIBUTED

MAX_NAME_LENGTH = 40
# fixed values: soft hyphen, zero-width space, LRM, RLM, word joiner, byte-order mark
INVISIBLE = "\u00ad\u200b\u200e\u200f\u2060\ufeff"
# fixed values: C0, DEL, C1 controls; bidi embeddings, overrides and isolates
FORBIDDEN = "[\\x00-\\x1F\\x7F-\\x9F\\u202A-\\u202E\\u2066-\\u2069]"


def clean_name(raw: Column) -> Column:
    """The visible text with outer white space gone and inner runs collapsed; '' clears the name."""
    visible = F.translate(raw, INVISIBLE, "")
    return F.regexp_replace(trim_white(visible), f"[{WHITE_SPACE}]+", " ")


def name_allowed(cleaned: Column) -> Column:
    return (cleaned == "") | ((F.length(cleaned) <= MAX_NAME_LENGTH) & ~cleaned.rlike(FORBIDDEN))


def short_id(identifier: Column) -> Column:
    return F.substring(identifier, 1, 8)


def display_name(nickname: Column, machine_id: Column) -> Column:
    return (
        F.when(machine_id == UNATTRIBUTED, UNATTRIBUTED)
        .when(nickname.isNull() | (trim_white(nickname) == ""), short_id(machine_id))
        .otherwise(nickname)
    )
