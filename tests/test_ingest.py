import datetime as dt
import json
import random

from pyspark.sql import functions as F

from helpers import at, dicts
from spendmart.operators import accounts, attribution, machines, repos, turns, validation
from spendmart.operators.ordered import blocked_previous, blocked_rank
from spendmart.operators.pricing import price_book
from spendmart.plans.ingest import ingest
from spendmart.schemas import EVENT_COLUMNS
from spendmart.sources.transcripts import read_transcripts


def assistant(request, message, out, when, cwd=None, files=(), model="claude-opus-5", session="s1", side=False):
    content = [{"type": "text", "text": "hello"}] + [{"type": "tool_use", "name": "Read", "input": {"file_path": f}} for f in files]
    usage = {"input_tokens": 1, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 3, "output_tokens": out, "cache_creation": {"ephemeral_5m_input_tokens": 3}}
    record = {"type": "assistant", "requestId": request, "sessionId": session, "isSidechain": side, "timestamp": when, "message": {"id": message, "model": model, "usage": usage, "content": content}}
    return record | ({"cwd": cwd} if cwd else {})


def write(folder, name, *lines):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines) + "\n")


def corpus(root):
    write(
        root, "-w/s1.jsonl",
        {"type": "user", "cwd": "/w", "sessionId": "s1", "message": {"content": "plain words"}},
        {"type": "ai-title", "aiTitle": "guess"}, {"type": "ai-title", "aiTitle": ""},
        assistant("q1", "m1", 7, "2026-08-01T10:00:00.000Z", "/w"),
        assistant("q1", "m1", 1505, "2026-08-01T10:00:01.000Z", "/w", ["/w/app/src/a.ts", "/w/app/b.ts", "/w/lib/c.ts"]),
        assistant("q1", "m1", 289, "2026-08-01T10:00:02.000Z", "/w"),
        "", '{"type": "assistant", "torn',
        assistant("q2", "m2", 5, "2026-08-01T10:05:00.000Z", "/w"),
        assistant(None, "m3", 5, "2026-08-01T10:06:00.000Z", "/w"),
        assistant("q4", "m4", 0, "2026-08-01T10:07:00.000Z", "/w", model="<synthetic>"),
        {"type": "custom-title", "customTitle": "mine"},
    )
    write(root, "-w/s1/subagents/workflows/wf/agent-1.jsonl", assistant("q5", "m5", 9, "2026-08-01T10:08:00.000Z", "/w/lib", ["../bare/x.ts"], side=True))
    write(root, "-w/s1/subagents/journal.jsonl", assistant("q6", "m6", 9, "2026-08-01T10:08:00.000Z", "/w/lib"))
    write(root, "-nowhere/s9.jsonl", assistant("q9", "m9", 9, "2026-08-01T10:08:00.000Z", session="s9"))


def dimensions(spark):
    repo = spark.createDataFrame(
        [("box", "/w/app", "ka", "/w/app"), ("box", "/w/lib", "kl", "/w/lib-main"), ("box", "/w/bare", None, "/w/bare")],
        "machine_id string, root string, repo_key string, main_root string",
    )
    ledger = spark.createDataFrame([("s1", 0, at("2026-08-01T10:06:00"), "acct", "org")], "session_id string, pos int, from_ts timestamp_ntz, account_uuid string, org_uuid string")
    return repo, ledger


def test_transcripts_to_events(spark, tmp_path):
    corpus(tmp_path)
    records = read_transcripts(spark, str(tmp_path), "box")
    done = ingest(records, *dimensions(spark), price_book(spark))
    assert [r["_corrupt"] for r in done.torn.collect()] == ['{"type": "assistant", "torn']
    assert done.events.columns == EVENT_COLUMNS + ["ord"]
    got = {r["request_id"]: r for r in dicts(done.events, "request_id")}
    assert set(got) == {"q1", "q2", "q5"}
    first, second, sub = got["q1"], got["q2"], got["q5"]
    assert (first["output_tokens"], first["cache_write_5m_tokens"], first["ts"]) == (1505, 3, at("2026-08-01T10:00:01"))
    # most files decide, then the answer is carried into a turn with no evidence
    assert (first["repo_key"], first["project_slug"], first["repo_name"]) == ("ka", "w/app", "w/app")
    assert second["repo_key"] == "ka" and second["session_title"] == "mine" and second["account_uuid"] == "acct"
    assert (sub["repo_key"], sub["repo_name"], sub["is_subagent"], sub["session_title"]) == ("kl", "w/lib-main", True, "mine")
    assert dicts(done.tags, "repo_key") == [
        {"session_id": "s1", "repo_key": "ka", "name": "w/app"}, {"session_id": "s1", "repo_key": "kl", "name": "w/lib-main"},
    ]
    assert [r["project_dir"] for r in done.skipped.collect()] == ["-nowhere"]


def test_touched_files_and_evidence(spark):
    content = json.dumps([{"type": "tool_use", "input": {"file_path": "/a/b"}}, {"type": "text"}, {"type": "tool_use", "input": {"notebook_path": "n/c.ipynb"}}, {"type": "tool_use", "input": {"path": "/no"}}])
    rows = spark.createDataFrame([(content,), ("just text",), (None,)], "c string")
    assert [r[0] for r in rows.select(turns.touched_files(F.col("c"))).collect()] == [["/a/b", "n/c.ipynb"], [], []]


def test_a_copy_without_tokens_ranks_lowest(spark):
    rows = spark.createDataFrame([("k", 1, None, "a"), ("k", 2, 0, "b"), ("k", 3, 0, "c")], "key string, at int, tokens bigint, v string")
    assert [tuple(r) for r in turns.keep_fullest(rows, ["key"], "tokens", "at", ["v"]).collect()] == [("k", "b", 1)]


ROOTS = ["/w", "/w/r0", "/w/r0/d1", "/w/r1", "/w/r1/x", "/z", "/z/q"]


def random_turn(rng):
    tied = rng.sample(ROOTS, rng.choice([0, 0, 1, 2]))
    return rng.choice([None, None, *ROOTS]), tied, tied[0] if tied else None


def next_root(carried, here, tied, first):
    """The rule, one turn at a time."""
    inside = lambda root: root is not None and root.startswith(f"{here}/")
    by_files = carried if carried in tied else first
    if here is not None and not inside(carried) and not inside(by_files):
        return here
    return carried if by_files is None else by_files


def test_blocked_fold_equals_one_pass(spark):
    rng = random.Random(11)
    rows, expected = [], {}
    for stream in ("hot", "warm", "tiny"):
        carried = None
        for n in range({"hot": 1400, "warm": 260, "tiny": 3}[stream]):
            # long stretches without a turn that decides by itself, so that whole cells and blocks are tables
            here, tied, first = random_turn(rng) if rng.random() < (0.02 if stream == "hot" else 0.4) else (rng.choice([None, "/w"]), [], None)
            carried = next_root(carried, here, tied, first)
            expected[stream, n] = carried
            rows.append((stream, n // 150, n, here, tied, first))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "stream string, block bigint, ord bigint, here_root string, tied_roots array<string>, first_root string")
    folded = attribution.carry_roots(frame)
    assert {(r["stream"], r["ord"]): r["root"] for r in folded.collect()} == expected and folded.count() == len(rows)
    assert "Python" not in folded._jdf.queryExecution().toString() and "Arrow" not in folded._jdf.queryExecution().toString()


def test_two_machines_with_one_folder_name(spark):
    """Each machine's turns take that machine's fallback, once."""
    turns = spark.createDataFrame(
        [(f"{m}/p/s", 0, n, m, "p", None, [], n) for m in ("a", "b") for n in range(2)],
        "stream string, block bigint, ord bigint, machine_id string, project_dir string, cwd string, file_paths array<string>, n int",
    )
    repo = spark.createDataFrame([], "machine_id string, root string, repo_key string, main_root string")
    fallback = spark.createDataFrame([("a", "p", "x/a", "ka", "a"), ("b", "p", "x/b", "kb", "b")], "machine_id string, project_dir string, project_slug string, repo_key string, repo_name string")
    got = sorted((r.machine_id, r.n, r.project_slug, r.repo_key) for r in attribution.attribute_turns(turns, repo, fallback).collect())
    assert got == [(m, n, f"x/{m}", f"k{m}") for m in ("a", "b") for n in range(2)]


def test_fold_rules():
    step = next_root
    assert step(None, None, [], None) is None
    assert step("/r/a", None, [], None) == "/r/a"
    assert step("/r/a", "/r/b", ["/r/c"], "/r/c") == "/r/b"  # the folder beats the files
    assert step("/r/a", "/r", [], None) == "/r/a"  # stepping out to the container changes nothing
    assert step("/x", "/r", [], None) == "/r"  # unless the work was elsewhere
    assert step(None, "/r", ["/r/b"], "/r/b") == "/r/b"  # on the first turn the files are narrower
    assert step("/r/b", None, ["/r/a", "/r/b"], "/r/a") == "/r/b"  # a tie stays where it is


def test_deepest_checkout_wins_even_without_a_remote(spark):
    repo, _ = dimensions(spark)
    folders = spark.createDataFrame([("box", "/w/app/deep/er"), ("box", "/w/bare/x"), ("box", "/w"), ("other", "/w/app"), ("box", "/w/application")], "machine_id string, folder string")
    assert [(r["folder"], r["repo_key"]) for r in repos.resolve_folders(folders, repo).collect()] == [("/w/app/deep/er", "ka")]


def test_facts_become_keys(spark):
    rows = spark.createDataFrame(
        [("b", "/w/a", "git@Host.com:Org/Repo.git", "/w/a/.git"), ("b", "/w/t", "https://host.com/org/repo/", "/w/a/.git"), ("b", "/w/z", "ssh://me@host.com/org/repo.git", "/srv/repo.git"), ("b", "/w/n", None, "/w/n/.git")],
        "machine_id string, root string, remote string, common_dir string",
    )
    got = repos.repos_from_facts(rows).orderBy("root").collect()
    assert len({r["repo_key"] for r in got if r["repo_key"]}) == 1 and [r["main_root"] for r in got] == ["/w/a", "/w/n", "/w/a", None]
    assert [r["repo_key"] is None for r in got] == [False, True, False, False]


def account_of(entries, ts):
    """The rule, one event at a time."""
    begun = [e for e in entries if e[0] <= ts]
    if begun:
        return begun[-1][1]
    gap = (entries[0][0] - ts).total_seconds() if entries else -1
    return entries[0][1] if 0 <= gap <= 86400 else None


def test_accounts_against_the_rule(spark):
    rng, ledger, events, expected = random.Random(3), [], [], {}
    for s in range(25):
        entries = [(at(f"2026-08-{rng.randint(1, 9):02d}T{rng.randint(0, 23):02d}:00:00"), f"a{n}") for n in range(rng.randint(0, 4))]
        ledger += [(f"s{s}", n, start, name, "o") for n, (start, name) in enumerate(entries)]
        for n in range(20):
            ts = at(f"2026-08-{rng.randint(1, 9):02d}T{rng.randint(0, 23):02d}:{rng.choice([0, 30]):02d}:00")
            events.append((f"s{s}", f"{s}-{n}", ts))
            expected[f"{s}-{n}"] = account_of(entries, ts)
    book = spark.createDataFrame(ledger, "session_id string, pos int, from_ts timestamp_ntz, account_uuid string, org_uuid string")
    rows = spark.createDataFrame(events, "session_id string, id string, ts timestamp_ntz")
    assert {r["id"]: r["account_uuid"] for r in accounts.account_asof(rows, book).collect()} == expected


def test_blocked_operators_against_plain_ones(spark):
    rng = random.Random(5)
    data = sorted((g, rng.randint(0, 40), n) for g in "ab" for n in range(80))
    rows = spark.createDataFrame([(g, t, n, n if n % 4 == 0 else None) for g, t, n in data], "g string, t bigint, n bigint, v bigint")
    ranked = blocked_rank(rows, ["g"], [F.col("t"), F.col("n")], F.floor(F.col("t") / 5), "pos", "size").collect()
    before = blocked_previous(rows, ["g"], ["t", "n"], F.col("v"), F.floor(F.col("t") / 5), "prev").collect()
    for g in "ab":
        mine = [(t, n) for h, t, n in data if h == g]
        assert {(r["t"], r["n"]): (r["pos"], r["size"]) for r in ranked if r["g"] == g} == {k: (i, 80) for i, k in enumerate(mine)}
        last, want = None, {}
        for t, n in mine:
            want[t, n] = last
            last = n if n % 4 == 0 else last
        assert {(r["t"], r["n"]): r["prev"] for r in before if r["g"] == g} == want


def test_ledger_keeps_changes_only(spark):
    rows = spark.createDataFrame([("s", 1, "a", "o"), ("s", 2, "a", "o"), ("s", 3, "b", "o"), ("s", 4, "b", None), ("s", 5, "a", "o"), ("t", 1, "a", "o")], "session_id string, at bigint, account_uuid string, org_uuid string")
    got = accounts.ledger_changes(rows, ["at"], F.floor(F.col("at") / 2))
    assert sorted((r["session_id"], r["at"]) for r in got.collect()) == [("s", 1), ("s", 3), ("s", 4), ("s", 5), ("t", 1)]


def test_wire_checks(spark):
    good = dict(requestId="r", messageId="m", sessionId="s", projectSlug="p", model="x", timestamp="2026-08-01T00:00:00Z", inputTokens=1, cacheReadTokens=0, cacheWrite5mTokens=0, cacheWrite1hTokens=0, outputTokens=2, costUsd=0.5, priced=True, isSubagent=False, secret="no")
    bad = [good | {"requestId": {"$gt": ""}}, good | {"model": 5}, good | {"repoKey": None}, good | {"costUsd": "1"}, good | {"outputTokens": 1.5}, good | {"priced": 1}, good | {"timestamp": 5}, [1], "x", None, good | {"messageId": ""}]
    rows = spark.createDataFrame([(json.dumps(r),) for r in [good, good | {"costUsd": 3, "repoName": "a/b", "inputTokens": 1.0}, *bad]], "raw string")
    checked = validation.check_events(rows)
    kept = validation.accepted_events(checked)
    assert "secret" not in kept.columns and [(float(r["cost_micro"]), r["repo_name"], r["input_tokens"]) for r in kept.orderBy("cost_micro").collect()] == [(500000.0, None, 1), (3000000.0, "a/b", 1)]
    assert validation.rejected_events(checked).count() == len(bad) and tuple(validation.batch_counts(checked).first()) == (2, len(bad))


def test_numbers_beyond_what_is_stored_are_set_aside(spark):
    entry = dict(requestId="r", messageId="m", sessionId="s", projectSlug="p", model="x", timestamp="2026-08-01T00:00:00Z", inputTokens=1, cacheReadTokens=0, cacheWrite5mTokens=0, cacheWrite1hTokens=0, outputTokens=2, costUsd=0.5, priced=True, isSubagent=False)
    cases = [{}, {"inputTokens": 1e30}, {"cacheReadTokens": 10**16}, {"outputTokens": 99999999999999999999}, {"costUsd": 2e6}, {"costUsd": 1e13}, {"costUsd": -2e6}, {"inputTokens": 10**15 - 1, "costUsd": 999999.5}]
    checked = validation.check_events(spark.createDataFrame([(n, json.dumps(entry | case)) for n, case in enumerate(cases)], "n int, raw string"))
    wrong = {r.n: r.reasons for r in checked.collect()}
    assert [len(wrong[n]) for n in range(8)] == [0, 1, 1, 1, 1, 1, 1, 0] and all("out of range" in wrong[n][0] for n in range(1, 7))
    stored = {r.n: r for r in validation.accepted_events(checked, "n").collect()}
    assert set(stored) == {0, 7} and stored[7].input_tokens == 10**15 - 1 and stored[7].cost_micro == 999999500000


def test_tag_reports(spark):
    key = "a" * 64
    rows = spark.createDataFrame(
        [("s", [(key, "x/y")]), ("s", [(key, "x/y"), ("short", "z")]), ("s", [(key, "")]), ("", [(key, "x")]), ("t", None), ("u", [(key + "\n", "x")])],
        "session_id string, tags array<struct<key:string,name:string>>",
    )
    assert [tuple(r) for r in validation.valid_tags(rows).collect()] == [("s", key, "x/y")]


def test_machines(spark):
    batches = spark.createDataFrame(
        [("a", at("2026-08-01T10:00:00"), 5, 5, False), ("a", at("2026-08-01T09:00:00"), 5, 5, False), ("a", at("2026-08-01T12:00:00"), 5, 0, False),
         ("a", at("2026-08-01T20:00:00"), 5, 5, True), ("b", at("2026-08-01T20:00:00"), 0, 0, False), ("f", at("2026-08-02T00:06:00"), 1, 1, False)],
        "machine_id string, received_at timestamp_ntz, events bigint, accepted bigint, is_backfill boolean",
    )
    state = machines.sync_state(batches)
    events = spark.createDataFrame([("a",), ("c" * 12,), (None,)], "machine_id string")
    roster = machines.machine_roster(events, state)
    feed = spark.createDataFrame(
        [("a", " Stu​dio   box ", 1), ("a", "bad‮name", 2), ("c" * 12, "Mine", 1), ("c" * 12, " ⁠", 2), ("nobody", "x", 1), ("f", "n" * 41, 1)], "machine_id string, name string, seq int"
    )
    got = {r["machine_id"]: r for r in machines.machine_status(roster, machines.latest_names(feed, roster), "2026-08-02 00:00:00").collect()}
    assert set(got) == {"a", "c" * 12, "f"}
    assert (got["a"]["display_name"], got["a"]["last_contact"], got["a"]["last_accepted"], got["a"]["stale"]) == ("Studio box", "2026-08-01 19:00:00", "2026-08-01 17:00:00", True)
    assert (got["c" * 12]["display_name"], got["c" * 12]["last_contact"], got["c" * 12]["stale"]) == ("c" * 8, "never", False)
    assert got["f"]["stale"] and got["f"]["name"] is None


def test_one_long_session_is_dated_in_many_tasks(spark):
    """A session of many entries: the brute-force answer, and a join with the hour among its keys."""
    rng = random.Random(8)
    start = at("2026-08-01T00:00:00")
    moment = lambda: start + dt.timedelta(minutes=rng.randint(0, 60 * 24 * 20))
    entries = [(s, n, moment(), f"acct{n}", "org") for s in ("s1", "s2") for n in range(120)]
    seen = [(n, rng.choice(("s1", "s2", "s3", None)), moment() if n % 40 else None) for n in range(1500)]
    book = spark.createDataFrame(entries, "session_id string, pos int, from_ts timestamp_ntz, account_uuid string, org_uuid string")
    rows = spark.createDataFrame(seen, "id int, session_id string, ts timestamp_ntz")

    def expected(session, ts):
        mine = [e for e in entries if e[0] == session]
        if not mine or ts is None:
            return None
        begun = [e for e in mine if e[2] <= ts]
        if begun:
            return max(begun, key=lambda e: e[1])[3]
        return mine[0][3] if mine[0][2] - dt.timedelta(hours=24) <= ts else None

    dated = accounts.account_asof(rows, book)
    assert {r["id"]: r["account_uuid"] for r in dated.collect()} == {n: expected(s, ts) for n, s, ts in seen}
    assert dated.count() == len(seen)
    cells = rows.filter("session_id IS NOT NULL AND ts IS NOT NULL").select("session_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("_hour")).distinct()
    held = accounts.account_cells(cells, book).groupBy("session_id", "_hour").count().collect()
    assert len(held) > 300 and max(r["count"] for r in held) < 20


def test_a_turn_meets_its_fallback_and_its_folders_without_a_shuffle(spark):
    """Two machines and one project are two groups: dealt by them, all turns would be the work of two tasks."""
    turns = spark.createDataFrame(
        [(f"{m}/p/s", 0, n, m, "p", "/w/a" if n == 1 else None, [f"/w/{x}//f" for x in files], n) for m in ("a", "b") for n, files in enumerate(["", "b", "aab", "ba", "c"])],
        "stream string, block bigint, ord bigint, machine_id string, project_dir string, cwd string, file_paths array<string>, n int",
    )
    repo = spark.createDataFrame([("a", f"/w/{x}", f"k{x}", None) for x in "ab"], "machine_id string, root string, repo_key string, main_root string")
    fallback = spark.createDataFrame([(m, "p", "x/y", None, None) for m in ("a", "b")], "machine_id string, project_dir string, project_slug string, repo_key string, repo_name string")
    placed = attribution.attribute_turns(turns, repo, fallback, evidence=False)
    assert "hashpartitioning(machine_id" not in placed._jdf.queryExecution().executedPlan().toString() and not {"cwd", "file_paths"} & set(placed.columns)
    # the first of the turn's equally used repositories, unless the carried one is among them
    want = [("a", n, slug) for n, slug in enumerate(["x/y", "w/a", "w/a", "w/a", "w/a"])] + [("b", n, "x/y") for n in range(5)]
    assert sorted((r.machine_id, r.n, r.project_slug) for r in placed.collect()) == want
    assert sorted((r.machine_id, r.n, r.project_slug) for r in attribution.attribute_turns(turns, repo, fallback).collect()) == want
