"""Ingest: copies, re-sent rows, wire checks, ledgers, folders, attribution, machines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fixtures import adapter as A
from fixtures.sql import RAW_CTE
from spendmart.functions import clock, money, names, paths
from spendmart.operators import accounts, attribution, fold, machines, repos, turns, validation
from spendmart.operators.splits import UNATTRIBUTED
from spendmart.schemas import COUNTERS, Dimension
from spendmart.session import checkpoint_folder
from spendmart.sources import marts
from spendmart.sources.event_table import EventTable

ARRIVAL = ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")


def _lines(spark, sf):
    return A.table(spark, sf, "lineitem")


def dedupe_turns(spark, sf):
    """Repeated (order, line) pairs as streaming copies; the fullest copy wins, the earliest of equals."""
    copies = _lines(spark, sf).withColumn("ord", F.struct(*ARRIVAL)).withColumn("output_tokens", F.col("l_quantity").cast("bigint"))
    kept = turns.keep_fullest(copies, ["l_orderkey", "l_linenumber"], "output_tokens", "ord", ["output_tokens", *ARRIVAL])
    return kept.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "output_tokens", "l_partkey", "l_suppkey",
        clock.day_key(F.col("l_shipdate")).alias("shipped"), clock.day_key(F.col("first_seen.l_shipdate")).alias("first_shipped"),
    )


def upsert_fold(spark, sf):
    """The same pairs as re-sent rows: first owner, highest counter, last setting, last value present."""
    rows = _lines(spark, sf).withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    shape = dict(owner=["l_suppkey"], raised=["l_quantity"], latest=["l_linestatus"], optional=["flag"], key=["l_orderkey", "l_linenumber"])
    states = fold.to_state(rows, F.struct(*ARRIVAL), **shape)
    folded = fold.fold(states, raised=["l_quantity"], optional=["flag"], key=shape["key"])
    return fold.from_state(folded, **shape).withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))


def _stored(spark, sf):
    """The pairs as events, merged into a table by two jobs whose batches interleave; batches are retried in between. A month's rows share a date."""
    number = lambda c: F.col(c).cast("bigint")
    day = F.col("l_shipdate").cast("date")
    rows = _lines(spark, sf).select(
        F.col("l_orderkey").cast("string").alias("request_id"), F.col("l_linenumber").cast("string").alias("message_id"), F.col("l_suppkey").cast("string").alias("session_id"),
        F.lit("box").alias("machine_id"), F.col("l_linestatus").alias("project_slug"), F.nullif("l_returnflag", F.lit("N")).alias("repo_key"), F.lit("m").alias("model"),
        F.trunc(day, "month").cast("timestamp_ntz").alias("ts"), number("l_quantity").alias("output_tokens"), F.col("l_extendedprice").cast("decimal(18,6)").alias("cost_micro"),
        (F.col("l_linestatus") == "F").alias("priced"), F.lit(False).alias("is_subagent"),
        *[F.lit(None).cast("string").alias(c) for c in ("repo_name", "account_uuid", "org_uuid", "session_title")],
        *[F.lit(0).cast("bigint").alias(c) for c in COUNTERS if c != "output_tokens"],
        F.struct((F.unix_date(day).cast("bigint") * 1_000_000_000 + number("l_partkey")).alias("a"), (number("l_suppkey") * 100_000_000 + (F.col("l_extendedprice") * 100).cast("bigint")).alias("b")).alias("at"),
    )
    table = EventTable(spark, f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}", changes=True)
    early, middle, late = (rows.filter(x) for x in ("year(ts) < 1997", "year(ts) IN (1997, 1998)", "year(ts) > 1998"))
    for job, batch, part in (("a", 0, early), ("b", 0, middle), ("a", 0, early), ("a", 1, late), ("b", 0, middle)):
        table.merge(part, F.col("at"), job, batch, costly=False)
    return table


def ledger_fold(spark, sf):
    kept = _stored(spark, sf).events()
    return kept.select("request_id", "message_id", "session_id", "project_slug", "repo_key", "output_tokens", "cost_micro", clock.day_key(F.col("ts")).alias("day"))


def mart_session_totals(spark, sf):
    mart = marts.session_totals(_stored(spark, sf))
    mart.refresh()
    return mart.totals()


def mart_daily_cost(spark, sf):
    cube = marts.daily_cube(_stored(spark, sf), "UTC")
    cube.refresh()
    return marts.cost_per_whole_day(cube.totals(), Dimension.MACHINE, "1996-01-01", "2000-12-31")


def _tag_reports(spark, sf):
    """Each event as a report that its session worked in two repositories, sometimes malformed."""
    raw = A.raw_events(spark, sf)
    digest = lambda n: F.sha2(n.cast("string"), 256)
    eid = F.col("event_id")
    first = F.struct(digest(eid % 5).alias("key"), F.concat(F.lit("team/repo"), (eid % 3).cast("string")).alias("name"))
    second = F.struct(
        F.when(eid % 19 == 0, "not.a.key").otherwise(digest(eid % 7)).alias("key"), F.when(eid % 23 == 0, "").otherwise("team/other").alias("name")
    )
    return raw.select("session_id", F.struct("ts", "event_id").alias("seq"), F.array(first, second).alias("tags"))


def tag_fold(spark, sf):
    folded = fold.fold_tags(validation.valid_tags(_tag_reports(spark, sf)).withColumn("seq", F.struct("seq", "name")))
    return folded.select("session_id", "repo_key", "name")


def _wire(spark, sf):
    """Every event as raw JSON; each defect sits in its own residue class of the id."""
    raw = A.raw_events(spark, sf)
    eid = F.col("event_id")
    kind = eid % 17
    q = lambda column: F.concat(F.lit('"'), column, F.lit('"'))
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    parts = [
        field("requestId", F.when(kind == 6, F.lit('{"$gt":""}')).when(kind == 9, F.lit('""')).otherwise(q(F.col("request_id")))),
        F.when(kind != 1, field("messageId", q(F.col("message_id")))),
        field("sessionId", q(F.col("session_id"))),
        field("projectSlug", q(F.coalesce("project_slug", F.lit(UNATTRIBUTED)))),
        field("model", q(F.col("model"))),
        F.when(kind == 5, field("repoName", F.lit("7"))).when(kind == 10, field("repoName", F.lit("null"))).when(
            F.col("repo_name").isNotNull(), field("repoName", q(F.col("repo_name")))
        ),
        F.when(F.col("repo_key").isNotNull(), field("repoKey", q(F.col("repo_key")))),
        field("timestamp", F.when(kind == 3, F.lit('"yesterday"')).otherwise(F.concat(F.lit('"'), F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.lit('Z"')))),
        field("inputTokens", F.when(kind == 2, F.lit('"5"')).when(kind == 11, F.lit("1.5")).otherwise(F.col("input_tokens").cast("string"))),
        field("cacheReadTokens", F.col("cache_read_tokens").cast("string")),
        field("cacheWrite5mTokens", F.col("cache_write_5m_tokens").cast("string")),
        field("cacheWrite1hTokens", F.col("cache_write_1h_tokens").cast("string")),
        field("outputTokens", F.col("output_tokens").cast("string")),
        field("costUsd", F.lit("0.25")),
        field("priced", F.when(kind == 4, F.lit("null")).otherwise(F.col("priced").cast("string"))),
        field("isSubagent", F.col("is_subagent").cast("string")),
        field("lastPrompt", F.lit('"must never be stored"')),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    text = F.when(kind == 7, F.lit("null")).when(kind == 8, F.lit('"oops"')).when(kind == 12, F.lit('{"torn":')).otherwise(body)
    return raw.select("event_id", "machine_id", text.alias("raw"))


def validate_events(spark, sf):
    return validation.check_events(_wire(spark, sf)).select("event_id", F.array_join("reasons", "; ").alias("reasons"))


def accepted_events(spark, sf):
    kept = validation.accepted_events(validation.check_events(_wire(spark, sf)), "machine_id")
    return kept.select(
        "request_id", "message_id", "session_id", "machine_id", "project_slug", "model", "repo_key", "repo_name", "account_uuid", "org_uuid", "session_title",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "input_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens",
        "output_tokens", money.dollars(F.col("cost_micro")).alias("cost_usd"), "priced", "is_subagent",
    )


def batch_counts(spark, sf):
    return validation.batch_counts(validation.check_events(_wire(spark, sf)), "machine_id")


def _batches(spark, sf):
    """One upload per machine and UTC hour; every sixth hour is a backfill; one machine never delivers anything good."""
    raw = A.raw_events(spark, sf)
    hour = F.substring(F.col("ts").cast("string"), 1, 13)
    real = raw.filter(F.col("machine_id") != "machine-6").groupBy("machine_id", hour.alias("hour")).agg(
        F.max("ts").alias("received_at"), F.count(F.lit(1)).alias("events"), F.count_if("priced").alias("accepted")
    )
    bad = raw.filter(F.col("machine_id") == "machine-6").groupBy(F.lit("machine-8").alias("machine_id"), hour.alias("hour")).agg(
        F.max("ts").alias("received_at"), F.count(F.lit(1)).alias("events"), F.lit(0).cast("bigint").alias("accepted")
    )
    return real.unionByName(bad).withColumn("is_backfill", F.substring("hour", 12, 2).cast("int") % 6 == 0)


def _stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


def sync_state(spark, sf):
    return machines.sync_state(_batches(spark, sf)).select("machine_id", _stamp("last_contact_at"), _stamp("last_accepted_at"))


def _name_feed(spark, sf):
    """Customer names as display names for machines, with stray white space and characters that render as nothing."""
    key = F.col("c_custkey")
    name = (
        F.when(key % 5 == 0, F.concat(F.lit("  "), F.col("c_name"), F.lit(" \t ")))
        .when(key % 5 == 1, F.concat(F.lit("Box​﻿  "), key.cast("string")))
        .when(key % 5 == 2, F.concat(F.lit("bad‮"), F.col("c_name")))
        .when(key % 5 == 3, F.concat(F.col("c_name"), F.lit(" is far too long to be the name of a machine")))
        .otherwise(F.lit("  ⁠ "))
    )
    return A.table(spark, sf, "customer").select(
        key.alias("seq"), F.concat(F.lit("machine-"), (key % 9).cast("string")).alias("machine_id"), name.alias("name")
    )


def clean_names(spark, sf):
    return machines.check_names(_name_feed(spark, sf)).select("seq", "cleaned", "allowed")


def _roster(spark, sf):
    return machines.machine_roster(A.raw_events(spark, sf), machines.sync_state(_batches(spark, sf)))


def machine_status(spark, sf):
    roster = _roster(spark, sf)
    named = machines.latest_names(_name_feed(spark, sf), roster)
    return machines.machine_status(roster, named, A.NOW)


def distinct_machines(spark, sf):
    return A.raw_events(spark, sf).select("machine_id").distinct()


def ingest_metrics(spark, sf):
    runs = _batches(spark, sf).select(
        F.substring("hour", 1, 10).alias("run_id"), F.col("machine_id").alias("file"), "events", "accepted",
        F.lit(None).cast("string").alias("folder"), F.lit(False).alias("skipped"),
    )
    none = F.lit(0).cast("bigint")
    bare = A.raw_events(spark, sf).filter("project_slug IS NULL").select(
        F.substring(F.col("ts").cast("string"), 1, 10).alias("run_id"), F.lit(None).cast("string").alias("file"), none.alias("events"), none.alias("accepted"),
        F.col("session_id").alias("folder"), F.lit(True).alias("skipped"),
    )
    return fold.ingest_metrics(runs.unionByName(bare))


def _ledger(spark, sf):
    """Per session one or two entries; the second may begin before the first, which list order must survive."""
    spans = A.raw_events(spark, sf).groupBy("session_id", "user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    first = F.struct(F.lit(0).alias("pos"), (F.col("lo") + F.make_dt_interval(F.lit(0), ((F.col("user_id") % 3) * 12).cast("int"))).alias("from_ts"), F.lit("acct-a").alias("account_uuid"))
    second = F.struct(F.lit(1).alias("pos"), (F.col("lo") + (F.col("hi") - F.col("lo")) / 2).alias("from_ts"), F.lit("acct-b").alias("account_uuid"))
    entries = F.when(F.col("user_id") % 2 == 0, F.array(first, second)).otherwise(F.array(first))
    return spans.select("session_id", F.inline(entries)).withColumn("org_uuid", F.concat(F.lit("org-"), F.col("account_uuid")))


def account_asof(spark, sf):
    return accounts.account_asof(A.raw_events(spark, sf), _ledger(spark, sf)).select("request_id", "account_uuid", "org_uuid")


def ledger_changes(spark, sf):
    """Each event also observes an account; only the observations that change a session's account are kept."""
    raw = A.raw_events(spark, sf)
    seen = raw.select(
        "session_id", "event_id", F.col("ts").alias("at"), F.concat(F.lit("acct-"), (F.floor(F.col("event_id") / 300) % 2).cast("string")).alias("account_uuid"),
        F.when(F.col("event_id") % 600 < 450, "org-1").alias("org_uuid"),
    )
    changed = accounts.ledger_changes(seen, ["event_id"], F.floor(F.col("event_id") / 256))
    return changed.select("session_id", "event_id", "account_uuid", "org_uuid")


REPOS = [
    ("/w", "key-w", "/w"),
    ("/w/r0", "key-r0", "/w/r0"),
    ("/w/r1", "key-r1", "/w/r0"),
    ("/w/r2", "key-r2", "/w/r2"),
    ("/w/r3", "key-r3", None),
    ("/w/r0/d1", "key-d1", "/w/r0/d1"),
    ("/w/r4", None, "/w/r4"),
]


def _repos(spark):
    return spark.createDataFrame([(m, *r) for m in ("m", "n") for r in REPOS], "machine_id string, root string, repo_key string, main_root string")


def _folder_of(number, other):
    return F.concat(F.lit("/w/r"), (number % 5).cast("string"), F.lit("/d"), (other % 7).cast("string"))


def repo_prefix_join(spark, sf):
    folders = _lines(spark, sf).select(F.lit("m").alias("machine_id"), _folder_of(F.col("l_partkey"), F.col("l_suppkey")).alias("folder"))
    outside = _lines(spark, sf).select(F.lit("m").alias("machine_id"), F.concat(F.lit("/x/w/r"), F.col("l_suppkey").cast("string")).alias("folder"))
    return repos.resolve_folders(folders.unionByName(outside), _repos(spark)).select("folder", "root", "repo_key")


def git_remote_normalize(spark, sf):
    """Page addresses spelled as remotes in several ways."""
    kind = F.col("page_id") % 4
    host = F.regexp_extract("url", "://([^/]+)", 1)
    path = F.regexp_extract("url", "://[^/]+/(.*)", 1)
    remote = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.concat(F.lit("git@"), host, F.lit(":"), path, F.lit(".git")))
        .when(kind == 2, F.concat(F.lit(" ssh://git@"), F.upper(host), F.lit("/"), path, F.lit(".GIT//")))
        .otherwise(F.concat(host, F.lit(":"), path, F.lit("/")))
    )
    return A.table(spark, sf, "pages").select("page_id", paths.normalize_git_remote(remote).alias("remote"), paths.repo_key(remote).alias("repo_key"))


def _turns(spark, sf):
    """Deduplicated lines as turns: one stream per supplier, one block per shipping year; two machines with a folder of one name."""
    kept = turns.keep_fullest(
        _lines(spark, sf).withColumn("tokens", F.col("l_quantity")).withColumn("at", F.struct(*ARRIVAL)),
        ["l_orderkey", "l_linenumber"], "tokens", "at", ["l_partkey", "l_suppkey", "l_shipdate"],
    )
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    cwd = F.when(order % 4 == 1, "/w").when(order % 4 == 2, F.concat(F.lit("/w/r"), (part % 5).cast("string"))).when(order % 4 == 3, _folder_of(part, part))
    one, two = F.concat(_folder_of(part, order), F.lit("/f1")), F.concat(_folder_of(order, F.lit(1)), F.lit("/f2"))
    none = F.array().cast("array<string>")
    files = F.when(F.col("l_linenumber") % 3 == 1, F.array(one)).when(F.col("l_linenumber") % 3 == 2, F.array(one, two)).otherwise(none)
    return kept.select(
        F.col("l_suppkey").cast("string").alias("stream"),
        F.year("l_shipdate").cast("bigint").alias("block"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("ord"),
        F.when(F.col("l_suppkey") % 3 == 0, "n").otherwise("m").alias("machine_id"),
        F.lit("p").alias("project_dir"),
        cwd.alias("cwd"),
        files.alias("file_paths"),
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
    )


def attribute_turns(spark, sf):
    fallback = spark.createDataFrame([("m", "p", "home/base", None, None), ("n", "p", "other/base", None, None)], "machine_id string, project_dir string, project_slug string, repo_key string, repo_name string")
    placed = attribution.attribute_turns(_turns(spark, sf), _repos(spark), fallback, evidence=False)
    return placed.select("l_orderkey", "l_linenumber", "project_slug", "repo_key", "repo_name")


def session_repo_tags(spark, sf):
    every = _turns(spark, sf)
    folders = every.select(
        F.col("stream").alias("session_id"), "machine_id",
        F.explode(F.filter(F.concat(F.array("cwd"), F.transform("file_paths", paths.parent_folder)), lambda f: f.isNotNull())).alias("folder"),
    ).distinct()
    return repos.session_repo_tags(folders, _repos(spark))


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_turns, upsert_fold, ledger_fold, mart_session_totals, mart_daily_cost, tag_fold, validate_events, accepted_events, batch_counts, sync_state, clean_names, machine_status,
        distinct_machines, ingest_metrics, account_asof, ledger_changes, repo_prefix_join, git_remote_normalize, attribute_turns, session_repo_tags,
    )
}

RAW = "WITH " + RAW_CTE
KIND = "event_id % 17"
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
BATCH_CTE = """
real AS (SELECT machine_id, strftime(ts, '%Y-%m-%d %H') AS hour, max(ts) AS received_at, count(*) AS events, count(*) FILTER (priced) AS accepted
  FROM raw WHERE machine_id <> 'machine-6' GROUP BY ALL),
bad AS (SELECT 'machine-8' AS machine_id, strftime(ts, '%Y-%m-%d %H') AS hour, max(ts) AS received_at, count(*) AS events, 0 AS accepted
  FROM raw WHERE machine_id = 'machine-6' GROUP BY ALL),
batches AS (SELECT *, cast(hour[12:13] AS INTEGER) % 6 = 0 AS is_backfill FROM (SELECT * FROM real UNION ALL SELECT * FROM bad)),
state AS (SELECT machine_id, max(received_at) AS contact, max(received_at) FILTER (accepted > 0) AS delivered FROM batches WHERE events > 0 AND NOT is_backfill GROUP BY machine_id)
"""
NAME_CTE = """
feed AS (SELECT c_custkey AS seq, concat('machine-', c_custkey % 9) AS machine_id,
    CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN concat('Box ', c_custkey) WHEN 2 THEN concat('bad', chr(8238), c_name)
      WHEN 3 THEN concat(c_name, ' is far too long to be the name of a machine') ELSE '' END AS cleaned, c_custkey % 5 IN (0, 1, 4) AS allowed FROM customer)
"""
ARR = "l_shipdate, l_partkey, l_suppkey, l_extendedprice"
FOLDER = "concat('/w/r', {0} % 5, '/d', {1} % 7)"
ROOT = """CASE WHEN {0} IS NULL OR starts_with({0}, '/w/r4') THEN NULL WHEN {0} = '/w/r0/d1' THEN {0} WHEN starts_with({0}, '/w/r') THEN left({0}, 5) WHEN {0} = '/w' THEN '/w' END"""
STORED = f"""WITH stored AS (SELECT cast(l_orderkey AS VARCHAR) AS request_id, cast(l_linenumber AS VARCHAR) AS message_id, cast(first(l_suppkey ORDER BY {ARR}) AS VARCHAR) AS session_id,
    last(l_linestatus ORDER BY {ARR}, l_linestatus) AS project_slug, last(nullif(l_returnflag, 'N') ORDER BY {ARR}, l_returnflag) FILTER (l_returnflag <> 'N') AS repo_key,
    cast(max(l_quantity) AS BIGINT) AS output_tokens, cast(max(l_extendedprice) AS DECIMAL(18,6)) AS cost_micro,
    strftime(date_trunc('month', first(l_shipdate ORDER BY {ARR})), '%Y-%m-%d') AS day, last(l_linestatus = 'F' ORDER BY {ARR}, l_linestatus) AS priced, if(priced, 0, 1) AS unpriced
    FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""
TURNS_CTE = f"""
kept AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, {ARR}) = 1),
t0 AS (SELECT l_orderkey, l_linenumber, cast(l_suppkey AS VARCHAR) AS stream, l_shipdate,
    CASE l_orderkey % 4 WHEN 1 THEN '/w' WHEN 2 THEN concat('/w/r', l_partkey % 5) WHEN 3 THEN {FOLDER.format('l_partkey', 'l_partkey')} END AS cwd,
    CASE WHEN l_linenumber % 3 IN (1, 2) THEN {FOLDER.format('l_partkey', 'l_orderkey')} END AS f1,
    CASE WHEN l_linenumber % 3 = 2 THEN {FOLDER.format('l_orderkey', '1')} END AS f2 FROM kept),
t1 AS (SELECT *, {ROOT.format('cwd')} AS w, {ROOT.format('f1')} AS ra, {ROOT.format('f2')} AS rb FROM t0),
t AS MATERIALIZED (SELECT *, coalesce(ra, rb) AS tie1, CASE WHEN ra IS NOT NULL THEN rb END AS tie2,
    row_number() OVER (PARTITION BY stream ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n FROM t1)
"""
STEP_FILES = "CASE WHEN f.root = tie1 OR f.root = tie2 THEN f.root ELSE tie1 END"
STEP = f"""CASE WHEN w IS NOT NULL AND NOT coalesce(starts_with(f.root, w || '/'), false) AND NOT coalesce(starts_with({STEP_FILES}, w || '/'), false)
  THEN w ELSE coalesce({STEP_FILES}, f.root) END"""
REPO_VALUES = "repos(root, repo_key, main_root) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in REPOS
) + ")"
LAST_TWO = "regexp_extract({0}, '([^/]+/)?[^/]+$')"
LEDGER_CTE = """
spans AS (SELECT session_id, user_id, min(ts) AS lo, max(ts) AS hi FROM raw GROUP BY ALL),
ledger AS (SELECT session_id, 0 AS pos, lo + to_hours(cast(user_id % 3 * 12 AS INTEGER)) AS from_ts, 'acct-a' AS acct FROM spans
  UNION ALL SELECT session_id, 1, lo + to_microseconds(cast(round((epoch_us(hi) - epoch_us(lo)) / 2.0) AS BIGINT)), 'acct-b' FROM spans WHERE user_id % 2 = 0),
found AS (SELECT r.request_id, arg_max(l.acct, l.pos) FILTER (l.from_ts <= r.ts) AS begun,
    max(l.acct) FILTER (l.pos = 0 AND l.from_ts >= r.ts AND l.from_ts <= r.ts + INTERVAL 24 HOURS) AS guess
  FROM raw r LEFT JOIN ledger l ON r.session_id = l.session_id GROUP BY r.request_id)
"""

ORACLES = {
    "dedupe_turns": f"""
        SELECT l_orderkey, cast(l_linenumber AS BIGINT) AS l_linenumber, cast(l_quantity AS BIGINT) AS output_tokens, l_partkey, l_suppkey,
          strftime(l_shipdate, '%Y-%m-%d') AS shipped, strftime(first_shipped, '%Y-%m-%d') AS first_shipped
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, {ARR}) AS rn,
          min(l_shipdate) OVER (PARTITION BY l_orderkey, l_linenumber) AS first_shipped FROM lineitem) WHERE rn = 1""",
    "upsert_fold": f"""
        SELECT l_orderkey, cast(l_linenumber AS BIGINT) AS l_linenumber, first(l_suppkey ORDER BY {ARR}) AS l_suppkey, max(l_quantity) AS l_quantity,
          last(l_linestatus ORDER BY {ARR}, l_linestatus) AS l_linestatus,
          last(nullif(l_returnflag, 'N') ORDER BY {ARR}, l_returnflag) FILTER (l_returnflag <> 'N') AS flag
        FROM lineitem GROUP BY ALL""",
    "ledger_fold": STORED + " SELECT * EXCLUDE (unpriced, priced) FROM stored",
    "mart_session_totals": STORED + """ SELECT session_id, sum(if(priced, cost_micro, 0))::DECIMAL(38,6) AS cost_micro, sum(unpriced)::BIGINT AS unpriced_events, count(*) AS event_count
        FROM stored GROUP BY ALL""",
    "mart_daily_cost": STORED + """ SELECT day, 'box' AS label, sum(if(priced, cost_micro, 0))::DECIMAL(38,6) AS cost_micro, sum(unpriced)::BIGINT AS unpriced_events, count(*) AS event_count
        FROM stored WHERE day BETWEEN '1996-01-01' AND '2000-12-31' GROUP BY ALL""",
    "tag_fold": RAW + """, reports AS (SELECT session_id, ts, event_id, sha256(cast(event_id % 5 AS VARCHAR)) AS k1, concat('team/repo', event_id % 3) AS n1, sha256(cast(event_id % 7 AS VARCHAR)) AS k2
          FROM raw WHERE event_id % 19 <> 0 AND event_id % 23 <> 0),
        long AS (SELECT session_id, ts, event_id, k1 AS repo_key, n1 AS name FROM reports UNION ALL SELECT session_id, ts, event_id, k2, 'team/other' FROM reports)
        SELECT session_id, repo_key, last(name ORDER BY ts, event_id, name) AS name FROM long GROUP BY ALL""",
    "validate_events": RAW + f""" SELECT event_id, CASE {KIND} WHEN 1 THEN 'messageId: text required' WHEN 2 THEN 'inputTokens: whole number required'
          WHEN 3 THEN 'timestamp: instant required' WHEN 4 THEN 'priced: true or false required' WHEN 5 THEN 'repoName: not text'
          WHEN 6 THEN 'requestId: text required' WHEN 7 THEN 'not an object' WHEN 8 THEN 'not an object' WHEN 9 THEN 'requestId: empty'
          WHEN 10 THEN 'repoName: not text' WHEN 11 THEN 'inputTokens: whole number required' WHEN 12 THEN 'not an object' ELSE '' END AS reasons FROM raw""",
    "accepted_events": RAW + f""" SELECT request_id, message_id, session_id, machine_id, coalesce(project_slug, '(unattributed)') AS project_slug, model, repo_key, repo_name,
          NULL::VARCHAR AS account_uuid, NULL::VARCHAR AS org_uuid, NULL::VARCHAR AS session_title, {STAMP.format('ts')} AS ts, input_tokens, cache_read_tokens,
          cast(cache_write_5m_tokens AS BIGINT) AS cache_write_5m_tokens, cast(cache_write_1h_tokens AS BIGINT) AS cache_write_1h_tokens,
          output_tokens, 0.25::DOUBLE AS cost_usd, priced, is_subagent FROM raw WHERE {KIND} IN (0, 13, 14, 15, 16)""",
    "batch_counts": RAW + f" SELECT machine_id, count(*) FILTER ({KIND} IN (0, 13, 14, 15, 16)) AS accepted, count(*) FILTER ({KIND} NOT IN (0, 13, 14, 15, 16)) AS rejected FROM raw GROUP BY machine_id",
    "sync_state": RAW + "," + BATCH_CTE + f" SELECT machine_id, {STAMP.format('contact')} AS last_contact_at, {STAMP.format('delivered')} AS last_accepted_at FROM state",
    "clean_names": "WITH " + NAME_CTE + " SELECT seq, cleaned, allowed FROM feed",
    "machine_status": RAW + "," + BATCH_CTE + "," + NAME_CTE + """,
        roster AS (SELECT DISTINCT machine_id FROM raw UNION SELECT machine_id FROM state),
        named AS (SELECT machine_id, nullif(arg_max(cleaned, seq), '') AS name FROM feed WHERE allowed AND machine_id IN (SELECT machine_id FROM roster) GROUP BY machine_id)
        SELECT r.machine_id, name, coalesce(name, left(r.machine_id, 8)) AS display_name,
          coalesce(strftime(contact + INTERVAL 7 HOURS, '%Y-%m-%d %H:%M:%S'), 'never') AS last_contact,
          coalesce(strftime(delivered + INTERVAL 7 HOURS, '%Y-%m-%d %H:%M:%S'), 'never') AS last_accepted,
          coalesce(contact > TIMESTAMP '2024-01-30 12:05:00' OR contact <= TIMESTAMP '2024-01-30 00:00:00', false) AS stale
        FROM roster r LEFT JOIN state s ON r.machine_id = s.machine_id LEFT JOIN named n ON r.machine_id = n.machine_id""",
    "distinct_machines": RAW + " SELECT DISTINCT machine_id FROM raw",
    "ingest_metrics": RAW + "," + BATCH_CTE + """, sent AS (SELECT hour[1:10] AS run_id, count(DISTINCT machine_id) AS files, count(*) AS requests, cast(sum(accepted) AS BIGINT) AS events_sent,
          cast(sum(events - accepted) AS BIGINT) AS events_rejected, count(*) FILTER (accepted = 0) AS failures FROM batches GROUP BY 1),
        bare AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(DISTINCT session_id) AS folders_skipped FROM raw WHERE project_slug IS NULL GROUP BY 1)
        SELECT coalesce(s.run_id, b.run_id) AS run_id, coalesce(files, 0) AS files, coalesce(requests, 0) AS requests, coalesce(events_sent, 0) AS events_sent,
          coalesce(events_rejected, 0) AS events_rejected, coalesce(failures, 0) AS failures, coalesce(folders_skipped, 0) AS folders_skipped
        FROM sent s FULL JOIN bare b ON s.run_id = b.run_id""",
    "account_asof": RAW + "," + LEDGER_CTE + " SELECT request_id, coalesce(begun, guess) AS account_uuid, 'org-' || coalesce(begun, guess) AS org_uuid FROM found",
    "ledger_changes": RAW + """, seen AS (SELECT session_id, event_id, concat('acct-', event_id // 300 % 2) AS account_uuid, CASE WHEN event_id % 600 < 450 THEN 'org-1' END AS org_uuid FROM raw),
        before AS (SELECT *, lag(account_uuid) OVER w AS pa, lag(org_uuid) OVER w AS po, row_number() OVER w AS n FROM seen WINDOW w AS (PARTITION BY session_id ORDER BY event_id))
        SELECT session_id, event_id, account_uuid, org_uuid FROM before WHERE n = 1 OR pa IS DISTINCT FROM account_uuid OR po IS DISTINCT FROM org_uuid""",
    "repo_prefix_join": f"""WITH d AS (SELECT DISTINCT {FOLDER.format('l_partkey', 'l_suppkey')} AS folder FROM lineitem), {REPO_VALUES}
        SELECT folder, r.root, repo_key FROM (SELECT folder, {ROOT.format('folder')} AS root FROM d) x JOIN repos r ON x.root = r.root""",
    "git_remote_normalize": """WITH u AS (SELECT page_id, lower(substr(url, strpos(url, '://') + 3)) AS rest FROM pages),
        p AS (SELECT page_id, CASE WHEN page_id % 4 IN (1, 2) THEN rest ELSE regexp_replace(regexp_replace(rest, '/+$', ''), '[.]git$', '') END AS remote FROM u)
        SELECT page_id, remote, sha256(remote) AS repo_key FROM p""",
    "attribute_turns": f"""WITH RECURSIVE {TURNS_CTE}, {REPO_VALUES},
        f(stream, n, root) AS (SELECT DISTINCT stream, cast(0 AS BIGINT), cast(NULL AS VARCHAR) FROM t
          UNION ALL SELECT t.stream, t.n, {STEP} FROM f JOIN t ON t.stream = f.stream AND t.n = f.n + 1)
        SELECT l_orderkey, cast(l_linenumber AS BIGINT) AS l_linenumber, coalesce({LAST_TWO.format('f.root')}, if(cast(t.stream AS BIGINT) % 3 = 0, 'other/base', 'home/base')) AS project_slug,
          repo_key, {LAST_TWO.format('main_root')} AS repo_name
        FROM f JOIN t ON t.stream = f.stream AND t.n = f.n LEFT JOIN repos r ON r.root = f.root""",
    "session_repo_tags": f"""WITH {TURNS_CTE}, {REPO_VALUES},
        d AS (SELECT stream, w AS root FROM t UNION SELECT stream, ra FROM t UNION SELECT stream, rb FROM t)
        SELECT stream AS session_id, repo_key, min({LAST_TWO.format('coalesce(main_root, d.root)')}) AS name FROM d JOIN repos r ON d.root = r.root WHERE repo_key IS NOT NULL GROUP BY ALL""",
}
