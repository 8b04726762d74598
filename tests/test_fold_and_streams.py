import itertools
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import at, dicts, event, frame
from spendmart.operators.fold import compact, fold, fold_tags, from_state, tags_as_map, to_state, upsert, whole
from spendmart.operators.pricing import price_book
from spendmart.schemas import EVENT_COLUMNS, USAGE_EVENTS
from spendmart.sources.event_table import EventTable, duplicate_keys, write_events
from spendmart.sources.transcripts import read_transcripts
from spendmart.streaming.jobs import run_transcripts, run_wire, stored_sync_state, transcript_metrics
from spendmart.plans.ingest import ingest
from test_ingest import assistant, corpus, dimensions, write


def writes(count, seed=1):
    rng = random.Random(seed)
    pick = lambda *options: rng.choice(options)
    return [
        event(
            rng.randint(0, 12), session_id=pick("s1", "s2"), ts=at(f"2026-08-0{rng.randint(1, 5)}T10:00:00"), output_tokens=rng.randint(0, 99),
            cost_micro=Decimal(rng.randint(0, 99)), project_slug=pick("a/b", "c/d"), priced=pick(True, False), repo_key=pick(None, "k1", "k2"), session_title=pick(None, "t1", "t2"),
        )
        for _ in range(count)
    ]


def model(rows):
    """The rule, one write at a time."""
    names, table = USAGE_EVENTS.fieldNames(), {}
    for row in rows:
        new = dict(zip(names, row))
        old = table.setdefault((new["request_id"], new["message_id"]), dict(new))
        for c in ("input_tokens", "cache_read_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "output_tokens", "cost_micro"):
            old[c] = max(old[c], new[c])
        for c in ("project_slug", "priced"):
            old[c] = new[c]
        for c in ("repo_key", "repo_name", "account_uuid", "org_uuid", "session_title"):
            old[c] = new[c] if new[c] is not None else old[c]
    return sorted(table.values(), key=lambda r: r["request_id"])


def numbered(spark, rows):
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in USAGE_EVENTS.fields) + ", n bigint")


def test_upsert_follows_the_rule(spark):
    rows = writes(200)
    got = upsert(numbered(spark, rows), F.col("n")).select(*EVENT_COLUMNS)
    assert dicts(got, "request_id") == model(rows)


def test_fold_is_mergeable_in_any_order_and_replayable(spark):
    rows = writes(90, 2)
    states = to_state(numbered(spark, rows), F.col("n")).withColumn("part", F.col("first.seq") % 3)
    parts = [fold(states.filter(F.col("part") == p).drop("part")) for p in range(3)]
    for order in itertools.islice(itertools.permutations(range(3)), 0, 6, 2):
        merged = parts[order[0]]
        for p in (*order[1:], order[1]):
            merged = fold(merged.unionByName(parts[p]))
        assert dicts(from_state(merged).select(*EVENT_COLUMNS), "request_id") == model(rows)


def test_stored_table_equals_the_rule_batch_by_batch(spark, tmp_path):
    rows, table = writes(120, 3), EventTable(spark, str(tmp_path / "events"), buckets=3)
    for batch in range(3):
        part = numbered(spark, rows[batch * 40 : batch * 40 + 40])
        table.merge(part, F.col("n"))
        if batch == 1:
            table.merge(part, F.col("n"))  # a retried batch
    assert dicts(table.events().select(*EVENT_COLUMNS), "request_id") == model(rows)
    assert duplicate_keys(table.events()).count() == 0


def test_a_merge_cut_off_anywhere_leaves_the_old_state(spark, tmp_path, monkeypatch):
    rows, path = writes(40, 4), str(tmp_path / "events")
    table = EventTable(spark, path)
    table.merge(numbered(spark, rows[:20]), F.col("n"))
    lost, later = EventTable(spark, path, changes=True), numbered(spark, rows[20:])

    def cut_off(*args, **more):
        raise RuntimeError("driver lost")

    for step in ("_known", "_written", "_record", "_publish"):
        with monkeypatch.context() as patched:
            patched.setattr(lost, step, cut_off)
            with pytest.raises(RuntimeError):
                lost.merge(later, F.col("n"))
        assert table.snapshot().version == 1, step
        # data files were written before a late cut; no manifest names them
        assert (table.unreferenced().count() > 0) == (step in ("_record", "_publish"))
    assert dicts(table.events().select(*EVENT_COLUMNS), "request_id") == model(rows[:20])
    lost.merge(later, F.col("n"))
    assert dicts(table.events().select(*EVENT_COLUMNS), "request_id") == model(rows)


def test_readers_keep_the_version_they_opened(spark, tmp_path):
    rows, table = writes(60, 6), EventTable(spark, str(tmp_path / "events"), buckets=2)
    table.merge(numbered(spark, rows[:30]), F.col("n"))
    opened = table.events()
    files = {f: (tmp_path / f.removeprefix("file://")).stat().st_mtime_ns for f in opened.inputFiles()}
    table.merge(numbered(spark, rows[30:]), F.col("n"))
    assert dicts(opened.select(*EVENT_COLUMNS), "request_id") == model(rows[:30])
    assert dicts(table.events(version=1).select(*EVENT_COLUMNS), "request_id") == model(rows[:30])
    assert dicts(table.events().select(*EVENT_COLUMNS), "request_id") == model(rows)
    assert files == {f: (tmp_path / f.removeprefix("file://")).stat().st_mtime_ns for f in files}  # written once
    with pytest.raises(ValueError):
        table.events(version=9)


def test_a_retried_batch_changes_nothing_whatever_came_between(spark, tmp_path):
    table = EventTable(spark, str(tmp_path / "events"))
    batch = lambda slug: frame(spark, event(1, project_slug=slug)).withColumn("n", F.lit(0))
    slug = lambda: table.events().first().project_slug
    assert table.merge(batch("from/a"), F.col("n"), job="a", batch=0) and slug() == "from/a"
    assert table.merge(batch("from/b"), F.col("n"), job="b", batch=0) and slug() == "from/b"
    assert not table.merge(batch("from/a"), F.col("n"), job="a", batch=0) and slug() == "from/b"
    assert table.merge(batch("again/a"), F.col("n"), job="a", batch=1) and slug() == "again/a"
    assert not table.merge(batch("from/b"), F.col("n"), job="b", batch=0) and slug() == "again/a"


def test_two_writers_of_one_version(spark, tmp_path):
    table, rival = (EventTable(spark, str(tmp_path / "events")) for _ in range(2))
    table.merge(frame(spark, event(1)).withColumn("n", F.lit(0)), F.col("n"))
    first = table.snapshot()
    look = rival.snapshot
    rival.snapshot = lambda version=None: look(version) if version else first  # looked before the other published
    table.merge(frame(spark, event(2)).withColumn("n", F.lit(0)), F.col("n"))
    before = {r.request_id for r in table.events().collect()}
    try:
        rival.merge(frame(spark, event(3)).withColumn("n", F.lit(0)), F.col("n"))
        won = {"r1", "r3"}
    except RuntimeError:
        won = before
    assert {r.request_id for r in table.events().collect()} == won


def test_units_and_index_runs_follow_the_size(spark, tmp_path):
    """Files are split as the table grows, and a small batch reads few of them."""
    table = EventTable(spark, str(tmp_path / "events"), unit_rows=40, run_rows=60)
    rows = [event(n, ts=at(f"2026-08-0{1 + n % 2}T10:00:00")) for n in range(1200)]
    for first, last in ((0, 700), (700, 1150), (1150, 1200)):
        table.merge(numbered(spark, rows[first:last]), F.col("n"))
    state = table.snapshot()
    units = state.of("data")
    assert sum(u.rows for u in units) == 1200 and max(u.rows for u in units) <= 80 and len(units) >= 30
    runs = state.of("index")
    assert sum(r.rows for r in runs) == 1200 and {r.depth for r in runs} & {3, 6}
    incoming = numbered(spark, [rows[7]]).select("request_id", "message_id")
    opened = table._known(state, incoming)
    levels = len({r.depth for r in runs})
    loose = sum(1 for r in runs if r.depth == 0)
    assert opened.count() < 1200 / 2 and len(opened.inputFiles()) <= levels + loose < len(runs)
    # one re-sent row rewrites one unit
    before = set(table.events().inputFiles())
    table.merge(numbered(spark, [event(7, ts=at("2026-09-09T10:00:00"), output_tokens=77)]), F.col("n"))
    after = set(table.events().inputFiles())
    assert len(before - after) == 1 and len(after - before) == 1
    got = table.events().filter("request_id = 'r7'").collect()
    assert [(r.output_tokens, r.ts) for r in got] == [(77, at("2026-08-02T10:00:00"))]
    assert table.events().count() == 1200 and duplicate_keys(table.events()).count() == 0


def test_layout_prunes_dates(spark, tmp_path):
    from spendmart.operators.filters import in_range

    path = str(tmp_path / "layout")
    write_events(frame(spark, *[event(n, ts=at(f"2026-08-0{n + 1}T10:00:00")) for n in range(5)]), path)
    kept = in_range(spark.read.parquet(path), "2026-08-02 00:00:00", "2026-08-03 23:00:00")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 2 and "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_tags_only_grow_and_take_the_latest_name(spark):
    reports = spark.createDataFrame([("s", "k1", "old", 1), ("s", "k2", "b", 1), ("s", "k1", "new", 2)], "session_id string, repo_key string, name string, seq int")
    folded = fold_tags(reports)
    again = fold_tags(folded.unionByName(reports.filter("seq = 1")))
    assert dicts(tags_as_map(again)) == [{"session_id": "s", "repos": {"k1": "new", "k2": "b"}}]


def test_streamed_transcripts_equal_one_batch(spark, tmp_path):
    root = tmp_path / "in"
    corpus(root)
    repo, ledger = dimensions(spark)
    table = EventTable(spark, str(tmp_path / "events"), buckets=2)
    run = lambda: run_transcripts(spark, str(root), "box", table, repo, ledger, price_book(spark), str(tmp_path / "cp")).awaitTermination()
    run()
    # a later landing re-sends one message with a fuller count and brings a new one
    write(root, "-w/s1b.jsonl", {"type": "user", "cwd": "/w/app"}, assistant("q1", "m1", 2000, "2026-08-03T10:00:01.000Z", "/w/app"), assistant("q7", "m7", 5, "2026-08-03T10:00:01.000Z", "/w/app"))
    run()
    run()
    got = {r["request_id"]: r for r in dicts(table.events())}
    assert set(got) == {"q1", "q2", "q5", "q7"} and got["q1"]["output_tokens"] == 2000
    assert got["q1"]["ts"] == at("2026-08-01T10:00:01") and got["q1"]["session_title"] == "mine"
    first = ingest(read_transcripts(spark, str(root), "box"), repo, ledger, price_book(spark)).events
    assert {r["request_id"]: r["cost_micro"] for r in dicts(first) if r["request_id"] in ("q2", "q5", "q7")} == {k: got[k]["cost_micro"] for k in ("q2", "q5", "q7")}


def test_streamed_uploads(spark, tmp_path):
    entry = dict(requestId="r", messageId="m", sessionId="s", projectSlug="p", model="x", timestamp="2026-08-01T00:00:00Z", inputTokens=1, cacheReadTokens=0, cacheWrite5mTokens=0, cacheWrite1hTokens=0, outputTokens=2, costUsd=0.5, priced=True, isSubagent=False)
    rows = [("box", 1, json.dumps(entry)), ("box", 2, json.dumps(entry | {"outputTokens": 9})), ("box", 3, "{}")]
    landed = str(tmp_path / "landed")
    spark.createDataFrame(rows, "machine_id string, position bigint, raw string").write.parquet(landed)
    rejected = []
    table = EventTable(spark, str(tmp_path / "events"), buckets=2)
    stream = spark.readStream.schema("machine_id string, position bigint, raw string").parquet(landed)
    run_wire(stream, table, str(tmp_path / "cp"), lambda bad, batch: rejected.extend(bad.collect())).awaitTermination()
    assert [(r["output_tokens"], r["machine_id"]) for r in table.events().collect()] == [(9, "box")] and len(rejected) == 1
    assert [r["raw"] for r in spark.read.parquet(f"{table.path}.refused").collect()] == ["{}"]
    (state,) = stored_sync_state(spark, table).collect()
    assert state.machine_id == "box" and state.last_contact_at == state.last_accepted_at
    older = spark.createDataFrame([("box", at("2000-01-01T00:00:00"), None), ("attic", at("2000-01-01T00:00:00"), None)], "machine_id string, last_contact_at timestamp_ntz, last_accepted_at timestamp_ntz")
    merged = {r.machine_id: r for r in stored_sync_state(spark, table, older).collect()}
    assert merged["box"] == state and merged["attic"].last_accepted_at is None
    # a fresh checkpoint is a new job; the same one merges nothing twice
    version = table.snapshot().version
    run_wire(stream, table, str(tmp_path / "cp")).awaitTermination()
    assert table.snapshot().version == version


def test_streaming_gives_the_same_table_for_any_batching(spark, tmp_path):
    root = tmp_path / "in"
    corpus(root)
    # an agent file lands before the transcript that says where its project ran
    write(root, "-z/a1/agent-x.jsonl", assistant("qa", "ma", 3, "2026-08-02T10:00:00.000Z", None))
    write(root, "-z/z9.jsonl", {"type": "user", "cwd": "/w/app"}, assistant("qz", "mz", 4, "2026-08-02T11:00:00.000Z", "/w/app"))
    repo, ledger = dimensions(spark)
    want = dicts(ingest(read_transcripts(spark, str(root), "box"), repo, ledger, price_book(spark)).events.select(*EVENT_COLUMNS), "request_id")
    assert {"qa", "qz"} <= {r["request_id"] for r in want}
    for files in (1, 1000):
        table = EventTable(spark, str(tmp_path / f"events{files}"), buckets=2)
        run_transcripts(spark, str(root), "box", table, repo, ledger, price_book(spark), str(tmp_path / f"cp{files}"), files).awaitTermination()
        assert dicts(table.events().select(*EVENT_COLUMNS), "request_id") == want, files
        assert duplicate_keys(table.events()).count() == 0


def test_files_that_grow_between_runs_give_the_table_of_the_finished_files(spark, tmp_path):
    root, whole = tmp_path / "in", tmp_path / "whole"
    corpus(whole)
    repo, ledger = dimensions(spark)
    want = dicts(ingest(read_transcripts(spark, str(whole), "box"), repo, ledger, price_book(spark)).events.select(*EVENT_COLUMNS), "request_id")
    files = {p.relative_to(whole): p.read_bytes() for p in whole.rglob("*.jsonl")}
    table = EventTable(spark, str(tmp_path / "events"), buckets=2)
    for share in (0.3, 0.31, 0.8, 1):  # cut inside lines
        for name, text in files.items():
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_bytes(text[: int(len(text) * share)])
        run_transcripts(spark, str(root), "box", table, repo, ledger, price_book(spark), str(tmp_path / "cp"), growing=True).awaitTermination()
    got = dicts(table.events().select(*EVENT_COLUMNS), "request_id")
    assert [r | {"ts": None} for r in got] == [r | {"ts": None} for r in want]
    # the instant belongs to the copy of a message that was stored first, as for any re-sent event
    assert (got[0]["ts"], want[0]["ts"]) == (at("2026-08-01T10:00:00"), at("2026-08-01T10:00:01"))
    landed = spark.read.parquet(f"{table.path}.landed")
    assert landed.count() == landed.select("stream", "ord").distinct().count() == read_transcripts(spark, str(whole), "box").count()
    last = dicts(transcript_metrics(spark, table), "batch")[-1]
    assert (last["folders"], last["folders_skipped"], last["events_sent"], last["lines_torn"]) == (2, 1, 3, 1)


def test_a_batch_works_out_its_own_session_files(spark, tmp_path):
    """History is worked out again only where a batch can change it: a shared message, or a project that turns out to have run elsewhere."""
    root, repo, ledger = tmp_path / "in", *dimensions(spark)
    table = EventTable(spark, str(tmp_path / "events"), buckets=2)
    turn = lambda n, **more: assistant(f"q{n}", f"m{n}", n, f"2026-08-01T10:{n:02}:00.000Z", more.pop("cwd", None), **more)
    landings = [
        ("-w/s5.jsonl", [{"type": "user", "cwd": "/w/lib"}, turn(1, cwd="/w/lib"), turn(2)], 1, 2),
        ("-w/s6.jsonl", [turn(3), turn(4), {"type": "custom-title", "customTitle": "six"}], 1, 2),
        # a copy of one of s6's messages: both files are worked out, and only the messages of the new one are sent
        ("-w/s8.jsonl", [turn(3, cwd="/w/app"), turn(5)], 2, 3),
        # sorts first: the project ran in another folder, so turns without evidence move
        ("-w/s1.jsonl", [{"type": "user", "cwd": "/w/app"}, turn(7)], 4, 7),
    ]
    for name, lines, *_ in landings:
        write(root, name, *lines)
        run_transcripts(spark, str(root), "box", table, repo, ledger, price_book(spark), str(tmp_path / "cp")).awaitTermination()
    want = ingest(read_transcripts(spark, str(root), "box"), repo, ledger, price_book(spark)).events
    one = EventTable(spark, str(tmp_path / "one"), buckets=2)
    one.merge(want, F.col("ord"))
    rows = lambda t: dicts(t.events().select(*EVENT_COLUMNS), "request_id")
    assert rows(table) == rows(one)
    counted = dicts(transcript_metrics(spark, table), "batch")
    assert [(r["files"], r["events_sent"]) for r in counted] == [(files, sent) for *_, files, sent in landings]


def test_a_second_job_or_fresh_checkpoint_comes_later(spark, tmp_path):
    table = EventTable(spark, str(tmp_path / "events"), buckets=2)
    table.merge(frame(spark, event(1, ts=at("2026-08-02T10:00:00"), project_slug="old")).withColumn("n", F.lit(5)), F.col("n"))
    later = frame(spark, event(1, ts=at("2026-08-01T10:00:00"), project_slug="new"))
    table.merge(later.withColumn("n", F.struct(F.lit(0).alias("block"), F.lit(0).alias("line"))), F.col("n"))
    table.merge(later.withColumn("request_id", F.lit(None).cast("string")).withColumn("n", F.lit(0)), F.col("n"))
    (row,) = table.events().collect()
    assert (row.ts, row.project_slug) == (at("2026-08-02T10:00:00"), "new")


def test_a_stored_key_keeps_one_seq_and_a_large_batch_leaves_the_index_alone(spark, tmp_path):
    """What a merge shuffles and writes: no seq twice, no index run again, changes from the files alone."""
    table = EventTable(spark, str(tmp_path / "events"), run_rows=10, changes=True)
    for first in (0, 30):
        table.merge(numbered(spark, [event(n, repo_key="k", output_tokens=n) for n in range(first, first + 40)]), F.col("n"))
    stored = spark.read.parquet(*table.events().inputFiles())
    once = stored.filter("output_tokens < 30 OR output_tokens >= 40")
    assert once.count() == 60 and once.filter("first.seq IS NULL AND repo_key.seq IS NULL AND last.seq IS NOT NULL AND was IS NULL").count() == 60
    again = stored.filter("output_tokens BETWEEN 30 AND 39")
    assert again.filter("first.seq.arrival = 0 AND last.seq.arrival = 1 AND was.output_tokens = output_tokens").count() == 10
    states = to_state(numbered(spark, writes(30, 5)), F.struct(F.lit(0).alias("arrival"), F.col("n").alias("position")))
    folded = fold(states)
    assert sorted(map(str, whole(compact(folded)).collect())) == sorted(map(str, folded.collect()))
    runs = {e.commit for e in table.snapshot().of("index")}
    assert len(runs) == 2 and {c for _, c in table.commits()} == runs
    signed = spark.read.parquet(f"{table.path}/changes/commit={table.commits()[1][1]}")
    assert signed.groupBy("sign").count().orderBy("sign").collect() == [(-1, 10), (1, 40)]
