"""Line-delimited JSON transcripts: a project folder holds `<session>.jsonl` files and, at any depth, `agent-*.jsonl`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendmart.schemas import TRANSCRIPT


def _derive(lines: DataFrame, root: str, machine_id: Column, *extra: str) -> DataFrame:
    """Keeps the files that are transcripts and derives stream, project and session file from their path."""
    below = F.regexp_extract(F.col("_path"), "^.*?" + _quoted(root) + "/(.*)\\z", 1)
    placed = lines.withColumn("_below", below)
    top = F.col("_below").rlike(r"^[^/]+/[^/]+[.]jsonl\z")
    nested_agent = F.col("_below").rlike(r"^[^/]+/.+/agent-[^/]*[.]jsonl\z")
    kept = placed.filter(top | nested_agent)
    project = F.substring_index("_below", "/", 1)
    return kept.select(
        *[c for c in TRANSCRIPT.fieldNames()],
        F.col("_path").alias("stream"),
        project.alias("project_dir"),
        F.concat(project, F.lit("/"), F.regexp_replace(F.substring_index(F.substring_index("_below", "/", 2), "/", -1), "[.]jsonl\\z", "")).alias("session_file"),
        F.col("_below").rlike(r"(^|/)agent-[^/]*[.]jsonl\z").alias("is_subagent_file"),
        (~top).alias("is_nested_file"),
        machine_id.alias("machine_id"),
        F.col("_block").alias("block"),
        *extra,
    )


def _quoted(text: str) -> str:
    return "\\Q" + text.rstrip("/").removeprefix("file:") + "\\E"


def read_transcripts(spark: SparkSession, root: str, machine_id: str) -> DataFrame:
    """Every record of every transcript below `root`; torn lines stay in, marked by `_corrupt`. Blank lines are dropped.

    `ord` restores file order: the start of the file split, then the position inside it.
    """
    lines = (
        spark.read.schema(TRANSCRIPT)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jsonl")
        .json(root)
    )
    tagged = lines.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    return with_order(_derive(tagged, root, F.lit(machine_id)))


def with_order(records: DataFrame) -> DataFrame:
    return records.withColumn("ord", F.struct(F.col("block"), F.monotonically_increasing_id().alias("line")))


def records_of_lines(lines: DataFrame, root: str, machine_id: str) -> DataFrame:
    """The same records from lines kept in a table: path, block, line (position inside the block) and value."""
    parsed = F.from_json("value", TRANSCRIPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = lines.filter(F.trim("value") != "").select(parsed.alias("_r"), F.col("path").alias("_path"), F.col("block").alias("_block"), F.col("line").alias("_line"))
    placed = _derive(read.select("_r.*", "_path", "_block", "_line"), root, F.lit(machine_id), "_line")
    return placed.withColumn("ord", F.struct(F.col("block"), F.col("_line").alias("line"))).drop("_line")


def stream_transcripts(spark: SparkSession, root: str, machine_id: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same records as a stream of landed files. Files must be immutable once landed; call `with_order` per batch."""
    lines = (
        spark.readStream.schema(TRANSCRIPT)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jsonl")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(root)
    )
    tagged = lines.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    return _derive(tagged, root, F.lit(machine_id))


def split_torn(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable records, torn lines): torn lines are kept for inspection, not silently lost.

    `type` is read along with the torn text because Spark refuses to parse for the corrupt column alone.
    """
    torn = F.col("_corrupt").isNotNull()
    return records.filter(~torn), records.filter(torn).select("stream", "type", "_corrupt")
