"""Transcripts to usage events: dedupe, attribute, date the account, price, project."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendmart.functions import clock
from spendmart.operators.accounts import account_asof
from spendmart.operators.attribution import attribute_turns, first_folders, project_fallback
from spendmart.operators.pricing import is_priced, price_asof, turn_cost
from spendmart.operators.report import SYNTHETIC
from spendmart.operators.repos import session_repo_tags
from spendmart.operators.turns import dedupe_turns, digest, evidence_folders, session_titles
from spendmart.operators.validation import COUNTER_LIMIT
from spendmart.schemas import COUNTERS, EVENT_COLUMNS
from spendmart.session import materialize
from spendmart.sources.transcripts import split_torn


class Ingested(NamedTuple):
    events: DataFrame
    tags: DataFrame
    torn: DataFrame
    folders: DataFrame
    rejected: DataFrame

    @property
    def skipped(self) -> DataFrame:
        """Folders without a fallback, of which nothing is stored."""
        return self.folders.filter("skipped").select("machine_id", "project_dir")


def unfit() -> Column:
    """Why a transcript's turn cannot be stored, by the rules of uploaded entries; empty when it can."""
    checks = [F.when(F.coalesce(F.col(c) == "", F.lit(True)), f"{c}: empty") for c in ("message_id", "session_id")]
    checks += [F.when(F.coalesce(F.abs(c) >= COUNTER_LIMIT, F.lit(False)), f"{c}: out of range") for c in COUNTERS]
    checks.append(F.when(F.col("ts").isNull(), "ts: instant required"))
    return F.filter(F.array(*checks), lambda reason: reason.isNotNull())


def map_events(turns: DataFrame, prices: DataFrame) -> DataFrame:
    """Attributed turns to stored events. Error placeholders and turns without a request are dropped;
    the final select is the allow-list. A cost is trusted only with a known model and an instant."""
    real = turns.filter((F.col("model") != SYNTHETIC) & F.col("request_id").isNotNull() & (F.col("request_id") != ""))
    priced = price_asof(real, prices)
    return (
        priced.withColumn("cost_micro", turn_cost())
        .withColumn("priced", is_priced() & F.col("ts").isNotNull())
        .select(*EVENT_COLUMNS, "ord")
    )


def ingest(records: DataFrame, repos: DataFrame, ledger: DataFrame, prices: DataFrame, firsts: DataFrame | None = None) -> Ingested:
    """All of a batch of transcript records. `records` come from `read_transcripts` and hold their session files whole.

    `firsts`: what `first_folders` says of whole projects, where `records` hold only some of their session files.
    """
    readable, torn = split_torn(materialize(digest(records), "records"))
    fallback = materialize(project_fallback(first_folders(readable) if firsts is None else firsts, repos), "fallback")
    titles = session_titles(readable)
    turns = dedupe_turns(readable).withColumn("block", F.col("ord.block"))
    attributed = attribute_turns(turns, repos, fallback)
    dated = attributed.withColumn("ts", clock.parse_instant(F.col("ts_text")))
    # events, rejects and the hours to date are all read from it
    titled = materialize(dated.join(titles, ["machine_id", "session_file"], "left"), "titled")
    checked = account_asof(titled, ledger).withColumn("reasons", unfit())
    events = map_events(checked.filter(F.size("reasons") == 0), prices)
    rejected = checked.filter(F.size("reasons") > 0).select("stream", "ord", "request_id", "message_id", "session_id", "reasons")
    sessions = turns.groupBy("stream").agg(F.min_by("session_id", "ord").alias("session_id"))
    folders = evidence_folders(readable).join(sessions, "stream").select("session_id", "machine_id", "folder").distinct()
    files = readable.groupBy("machine_id", "project_dir").agg(F.count_distinct("stream").alias("files"))
    known = fallback.select("machine_id", "project_dir", F.lit(True).alias("_known"))
    folders_seen = files.join(known, ["machine_id", "project_dir"], "left").withColumn("skipped", F.col("_known").isNull()).drop("_known")
    return Ingested(events, session_repo_tags(folders, repos), torn, folders_seen, rejected)
