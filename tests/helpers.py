"""Small frames for rule tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from spendmart.schemas import USAGE_EVENTS


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def event(n: int, **over):
    row = dict(
        request_id=f"r{n}", message_id=f"m{n}", session_id="s1", machine_id="box", project_slug="team/app", repo_key=None, repo_name=None,
        account_uuid=None, org_uuid=None, session_title=None, model="claude-opus-5", ts=at("2026-08-01T10:00:00"), input_tokens=0,
        cache_read_tokens=0, cache_write_5m_tokens=0, cache_write_1h_tokens=0, output_tokens=0, cost_micro=Decimal("250000"), priced=True, is_subagent=False,
    )
    row.update(over)
    return tuple(row[name] for name in USAGE_EVENTS.fieldNames())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), USAGE_EVENTS)


def dicts(df, *order):
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[c]) for c in order)) if order else rows
