"""Wire events and tag reports: every field is type-checked, bad entries are set aside with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendmart.functions import clock
from spendmart.schemas import MONEY

# fixed values: the wire names of an event and their stored columns
REQUIRED_TEXT = {
    "requestId": "request_id",
    "messageId": "message_id",
    "sessionId": "session_id",
    "projectSlug": "project_slug",
    "model": "model",
}
OPTIONAL_TEXT = {
    "repoKey": "repo_key",
    "repoName": "repo_name",
    "accountUuid": "account_uuid",
    "orgUuid": "org_uuid",
    "sessionTitle": "session_title",
}
COUNTERS = {
    "inputTokens": "input_tokens",
    "cacheReadTokens": "cache_read_tokens",
    "cacheWrite5mTokens": "cache_write_5m_tokens",
    "cacheWrite1hTokens": "cache_write_1h_tokens",
    "outputTokens": "output_tokens",
}
FLAGS = {"priced": "priced", "isSubagent": "is_subagent"}
TAG_KEY = r"^[0-9a-f]{64}\z"
IDENTITY = ["requestId", "messageId"]
# What a stored counter (priced as DECIMAL(15,0)) and a stored cost (MONEY, in micro-dollars) can hold
COUNTER_LIMIT = 10**15
COST_LIMIT = 10**6


def _once(value: Column, name: str) -> Column:
    """A computed column that later filters and projections read instead of computing it again.

    A one-row `inline` is a boundary the optimiser does not push expressions through.
    """
    return F.inline(F.array(F.struct(value.alias(name))))


def _get(field: str, kind: str) -> Column:
    return F.try_variant_get("_entry", f"$.{field}", kind)


def _kinds() -> Column:
    """The JSON type of every field that is looked at, NULL where it is absent."""
    fields = [*REQUIRED_TEXT, *OPTIONAL_TEXT, *COUNTERS, "costUsd", *FLAGS, "timestamp"]
    return F.struct(*[F.schema_of_variant(_get(f, "variant")).alias(f) for f in fields], F.schema_of_variant("_entry").alias("entry"))


def _is(field: str, *kinds: str) -> Column:
    column = F.col(f"_kind.{field}")
    met = F.lit(False)
    for kind in kinds:
        met = met | column.startswith(kind)
    return F.coalesce(met, F.lit(False))


_COST = "decimal(24,12)"  # as accepted_events reads it, so that rounding cannot pass the limit


def _within(field: str, limit: int, kind: str = "double") -> Column:
    return F.coalesce(F.abs(_get(field, kind)) < limit, F.lit(False))


def reasons() -> Column:
    """Everything wrong with an entry, empty when it can be stored."""
    number = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
    checks = []
    for field in REQUIRED_TEXT:
        checks.append(F.when(~_is(field, "STRING"), f"{field}: text required"))
    for field in IDENTITY:
        checks.append(F.when(_is(field, "STRING") & (_get(field, "string") == ""), f"{field}: empty"))
    for field in OPTIONAL_TEXT:
        checks.append(F.when(F.col(f"_kind.{field}").isNotNull() & ~_is(field, "STRING"), f"{field}: not text"))
    for field in COUNTERS:
        whole = _get(field, "decimal(38,6)")
        fine = _is(field, "BIGINT") | (_is(field, *number) & F.coalesce(whole == F.floor(whole), F.lit(False)))
        checks.append(F.when(~fine, f"{field}: whole number required"))
        # a number too long for the decimal reads as NULL there, and is out of range as well
        checks.append(F.when(_is(field, *number) & ~_within(field, COUNTER_LIMIT), f"{field}: out of range"))
    checks.append(F.when(~_is("costUsd", *number), "costUsd: number required"))
    checks.append(F.when(_is("costUsd", *number) & ~_within("costUsd", COST_LIMIT, _COST), "costUsd: out of range"))
    for field in FLAGS:
        checks.append(F.when(~_is(field, "BOOLEAN"), f"{field}: true or false required"))
    checks.append(F.when(F.col("_ts").isNull(), "timestamp: instant required"))
    return F.when(~_is("entry", "OBJECT"), F.array(F.lit("not an object"))).otherwise(
        # drops the nulls; a lambda over the array would have every check interpreted instead of compiled
        F.array_except(F.array(*checks), F.array(F.lit(None).cast("string")))
    )


def check_events(entries: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds `_entry` (parsed), `_ts` and `reasons` to one raw JSON entry per row; the batch goes on past a bad one.

    Each entry is parsed once and each field's type is looked up once.
    """
    parsed = entries.select("*", _once(F.try_parse_json(raw), "_entry"))
    typed = parsed.select("*", _once(_kinds(), "_kind"))
    dated = typed.select("*", _once(clock.parse_instant(F.when(_is("timestamp", "STRING"), _get("timestamp", "string"))), "_ts"))
    return dated.select("*", _once(reasons(), "reasons")).drop("_kind")


def accepted_events(checked: DataFrame, *keep: str) -> DataFrame:
    """The valid entries as stored columns and nothing else; this list is the privacy boundary."""
    valid = checked.filter(F.size("reasons") == 0)
    return valid.select(
        *keep,
        *[_get(f, "string").alias(c) for f, c in REQUIRED_TEXT.items()],
        *[_get(f, "string").alias(c) for f, c in OPTIONAL_TEXT.items()],
        F.col("_ts").alias("ts"),
        *[_get(f, "bigint").alias(c) for f, c in COUNTERS.items()],
        (_get("costUsd", _COST) * 1000000).try_cast(MONEY).alias("cost_micro"),
        *[_get(f, "boolean").alias(c) for f, c in FLAGS.items()],
    )


def rejected_events(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0).drop("_entry", "_ts")


def batch_counts(checked: DataFrame, *keys: str) -> DataFrame:
    """Accepted and rejected entries per batch."""
    good = F.size("reasons") == 0
    return checked.groupBy(*keys).agg(F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"))


def valid_tags(entries: DataFrame) -> DataFrame:
    """(…, session_id, repo_key, name) of the tag reports whose every tag is well formed; one bad tag drops its report."""
    fine = F.forall(
        "tags", lambda t: F.coalesce(t["key"].rlike(TAG_KEY), F.lit(False)) & F.coalesce(t["name"] != "", F.lit(False))
    )
    kept = entries.filter((F.col("session_id") != "") & F.coalesce(fine, F.lit(False)))
    others = [c for c in entries.columns if c != "tags"]
    return kept.select(*others, F.explode("tags").alias("_tag")).select(*others, F.col("_tag.key").alias("repo_key"), F.col("_tag.name").alias("name"))
