"""Transcript records to turns: streaming copies collapsed, touched files, titles, evidence folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendmart.functions.paths import parent_folder, resolve

# the parts of a message's content that name a touched file
CONTENT = "array<struct<type:string,input:struct<file_path:string,notebook_path:string>>>"


def tool_calls(content: Column) -> Column:
    """The tool calls of a message. Plain-text content has none."""
    blocks = F.when(F.ltrim(content).startswith("["), F.from_json(content, CONTENT))
    return F.filter(F.coalesce(blocks, F.array().cast(CONTENT)), lambda b: b["type"] == "tool_use")


def touched_files(content: Column) -> Column:
    """Paths the tool calls name, in the order issued."""
    named = F.transform(tool_calls(content), lambda b: F.array(b["input"]["file_path"], b["input"]["notebook_path"]))
    return F.filter(F.flatten(named), lambda path: path.isNotNull())


def evidence_files(content: Column) -> Column:
    """One path per tool call, the first of its two fields."""
    return F.filter(
        F.transform(tool_calls(content), lambda b: F.coalesce(b["input"]["file_path"], b["input"]["notebook_path"])),
        lambda path: path.isNotNull(),
    )


def keep_fullest(copies: DataFrame, keys: list[str], tokens: str, order: str, payload: list[str]) -> DataFrame:
    """One row per key: the copy with most output tokens, the earliest among equals; plus when the key was first seen.

    A copy without a token count ranks lowest. Aggregates only: copies combine before the shuffle,
    so a message copied millions of times is no heavier than any other.
    """
    best = F.struct((-F.coalesce(F.col(tokens), F.lit(-1))).alias("fewest"), F.col(order).alias("at"))
    kept = copies.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), best).alias("_kept"), F.min(order).alias("first_seen")
    )
    return kept.select(*keys, *[F.col(f"_kept.{c}").alias(c) for c in payload], "first_seen")


def digest(records: DataFrame) -> DataFrame:
    """Records without their text: message content is read once, here, for the files it names.

    Everything after this works on narrow rows, so the raw JSON is parsed in a single pass.
    """
    files = F.transform(evidence_files(F.col("message.content")), lambda path: parent_folder(resolve(F.col("cwd"), path)))
    folders = F.array_distinct(F.concat(F.coalesce(files, F.array().cast("array<string>")), F.array("cwd")))
    return records.select(
        "stream",
        "machine_id",
        "project_dir",
        "session_file",
        "is_subagent_file",
        "is_nested_file",
        "ord",
        "type",
        F.col("requestId").alias("request_id"),
        F.col("message.id").alias("message_id"),
        F.col("sessionId").alias("session_id"),
        F.col("isSidechain").alias("is_subagent"),
        F.col("message.model").alias("model"),
        F.col("timestamp").alias("ts_text"),
        F.col("message.usage").alias("usage"),
        "cwd",
        touched_files(F.col("message.content")).alias("file_paths"),
        F.filter(folders, lambda folder: folder.isNotNull()).alias("folders"),
        F.col("aiTitle").alias("generated_title"),
        F.col("customTitle").alias("custom_title"),
        "_corrupt",
    )


def dedupe_turns(digested: DataFrame) -> DataFrame:
    """Assistant records with usage, one row per stream, request and message."""
    usage = F.col("usage")
    copies = digested.filter((F.col("type") == "assistant") & usage.isNotNull()).select(
        "stream", "machine_id", "project_dir", "session_file", "is_subagent_file", "ord", "request_id", "message_id", "session_id",
        "is_subagent", "model", "ts_text",
        usage["input_tokens"].alias("input_tokens"),
        usage["cache_read_input_tokens"].alias("cache_read_tokens"),
        usage["cache_creation_input_tokens"].alias("cache_creation_tokens"),
        F.coalesce(usage["cache_creation"]["ephemeral_5m_input_tokens"], F.lit(0).cast("bigint")).alias("cache_write_5m_tokens"),
        F.coalesce(usage["cache_creation"]["ephemeral_1h_input_tokens"], F.lit(0).cast("bigint")).alias("cache_write_1h_tokens"),
        usage["output_tokens"].alias("output_tokens"),
        "cwd",
        "file_paths",
    )
    keys = ["stream", "request_id", "message_id"]
    payload = [c for c in copies.columns if c not in (*keys, "ord")]
    return keep_fullest(copies, keys, "output_tokens", "ord", payload).withColumnRenamed("first_seen", "ord")


def session_titles(digested: DataFrame) -> DataFrame:
    """(machine_id, session_file, session_title): the last non-empty custom title, else the last non-empty generated one.

    Only the session's own transcript names it; titles inside subagent files do not count.
    """
    place = F.struct("stream", "ord")
    custom = (F.col("type") == "custom-title") & (F.col("custom_title") != "")
    generated = (F.col("type") == "ai-title") & (F.col("generated_title") != "")
    return (
        digested.filter(~F.col("is_nested_file") & (custom | generated))
        .groupBy("machine_id", "session_file")
        .agg(F.max_by("custom_title", F.when(custom, place)).alias("_c"), F.max_by("generated_title", F.when(generated, place)).alias("_g"))
        .select("machine_id", "session_file", F.coalesce("_c", "_g").alias("session_title"))
    )


def evidence_folders(digested: DataFrame) -> DataFrame:
    """Distinct (machine_id, stream, folder) a stream shows work in: every recorded folder and every touched file's folder."""
    return digested.select("machine_id", "stream", F.explode("folders").alias("folder")).distinct()
