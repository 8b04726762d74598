"""Table shapes and the closed lists of dimensions and sort orders.

Instants are ``TIMESTAMP_NTZ`` holding UTC, so no result depends on the session time zone.
Absent means NULL. Money is micro-dollars in ``DECIMAL(18,6)`` until the last projection.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

DASHBOARD_ZONE = "Asia/Ho_Chi_Minh"
UNATTRIBUTED = "(unattributed)"
MONEY = "decimal(18,6)"


class Dimension(Enum):
    """What a cost split groups by; the value is the stored column."""

    MACHINE = "machine_id"
    MODEL = "model"
    PROJECT = "project_slug"
    REPO = "repo_key"

    @classmethod
    def parse(cls, name: str) -> "Dimension":
        try:
            return cls[name.upper()]
        except KeyError:
            raise ValueError(f"unknown dimension {name!r}; one of {[d.name.lower() for d in cls]}") from None


class SessionSort(Enum):
    """How a session list is ordered, always descending; the value is the sort column."""

    COST = "cost_micro"
    RECENT = "ended_at"
    EVENTS = "event_count"

    @classmethod
    def parse(cls, name: str) -> "SessionSort":
        try:
            return cls[name.upper()]
        except KeyError:
            raise ValueError(f"unknown sort {name!r}; one of {[s.name.lower() for s in cls]}") from None


_STR, _LONG, _BOOL, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampNTZType()

USAGE = T.StructType(
    [
        T.StructField("input_tokens", _LONG),
        T.StructField("cache_read_input_tokens", _LONG),
        T.StructField("cache_creation_input_tokens", _LONG),
        T.StructField("output_tokens", _LONG),
        T.StructField(
            "cache_creation",
            T.StructType(
                [
                    T.StructField("ephemeral_5m_input_tokens", _LONG),
                    T.StructField("ephemeral_1h_input_tokens", _LONG),
                ]
            ),
        ),
    ]
)

# One transcript line. `content` stays raw JSON text: it is a string on a plain reply, an array otherwise.
TRANSCRIPT = T.StructType(
    [
        T.StructField("type", _STR),
        T.StructField("requestId", _STR),
        T.StructField("sessionId", _STR),
        T.StructField("isSidechain", _BOOL),
        T.StructField("cwd", _STR),
        T.StructField("timestamp", _STR),
        T.StructField("aiTitle", _STR),
        T.StructField("customTitle", _STR),
        T.StructField(
            "message",
            T.StructType(
                [
                    T.StructField("id", _STR),
                    T.StructField("model", _STR),
                    T.StructField("usage", USAGE),
                    T.StructField("content", _STR),
                ]
            ),
        ),
        T.StructField("_corrupt", _STR),
    ]
)

COUNTERS = ["input_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "output_tokens"]
OPTIONAL_TEXT = ["repo_key", "repo_name", "account_uuid", "org_uuid", "session_title"]

# The stored fact. This projection is also the privacy allow-list: nothing else leaves a transcript.
USAGE_EVENTS = T.StructType(
    [
        T.StructField("request_id", _STR),
        T.StructField("message_id", _STR),
        T.StructField("session_id", _STR),
        T.StructField("machine_id", _STR),
        T.StructField("project_slug", _STR),
        T.StructField("repo_key", _STR),
        T.StructField("repo_name", _STR),
        T.StructField("account_uuid", _STR),
        T.StructField("org_uuid", _STR),
        T.StructField("session_title", _STR),
        T.StructField("model", _STR),
        T.StructField("ts", _TS),
        T.StructField("input_tokens", _LONG),
        T.StructField("cache_read_tokens", _LONG),
        T.StructField("cache_write_5m_tokens", _LONG),
        T.StructField("cache_write_1h_tokens", _LONG),
        T.StructField("output_tokens", _LONG),
        T.StructField("cost_micro", T.DecimalType(18, 6)),
        T.StructField("priced", _BOOL),
        T.StructField("is_subagent", _BOOL),
    ]
)
EVENT_COLUMNS = USAGE_EVENTS.fieldNames()
