"""Transcripts: the conversations as lines of transcript files, read, collapsed, titled and placed."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures import adapter as A
from fixtures.ingest_queries import LAST_TWO, REPO_VALUES, ROOT, _repos
from spendmart.operators import attribution, turns
from spendmart.sources.transcripts import records_of_lines, split_torn

ROOT_FOLDER = "/logs"


def _lines(spark, sf):
    """Every turn of a conversation as three lines: a message, a title, sometimes a torn one.

    Two turns in a row are copies of one message. Every third conversation is an agent's file below a session's folder;
    every seventh lies at a place where no transcript belongs.
    """
    said = A.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size")
    )
    conv, turn = F.col("conv_id"), F.col("turn")
    project = F.concat(F.lit(f"{ROOT_FOLDER}/p"), (conv % 5).cast("string"))
    path = (
        F.when(conv % 7 == 0, F.concat(project, F.lit("/notes/c"), conv.cast("string"), F.lit(".jsonl")))
        .when(conv % 3 == 0, F.concat(project, F.lit("/c"), (conv - 1).cast("string"), F.lit("/sub/agent-c"), conv.cast("string"), F.lit(".jsonl")))
        .otherwise(F.concat(project, F.lit("/c"), conv.cast("string"), F.lit(".jsonl")))
    )
    cwd = F.when(turn % 4 != 3, F.concat(F.lit("/w/r"), (conv % 5).cast("string"), F.lit("/d"), (turn % 3).cast("string")))
    pair = F.floor(turn / 2).cast("bigint")
    tool = lambda field, file: F.struct(F.lit("tool_use").alias("type"), F.struct(file.alias(field)).alias("input"))
    files = F.concat(
        F.lit("["),
        F.concat_ws(
            ",",
            F.to_json(tool("file_path", F.concat(F.lit("/w/r"), (turn % 5).cast("string"), F.lit("/d"), (conv % 4).cast("string"), F.lit("/f.txt")))),
            F.lit('{"type":"text","text":"no file"}'),
            F.when(turn % 2 == 1, F.to_json(tool("notebook_path", F.concat(F.lit("../n"), turn.cast("string"), F.lit("/book"))))),
        ),
        F.lit("]"),
    )
    message = F.to_json(
        F.struct(
            F.lit("assistant").alias("type"),
            F.concat(F.lit("r"), conv.cast("string"), F.lit("-"), pair.cast("string")).alias("requestId"),
            F.concat(F.lit("s"), conv.cast("string")).alias("sessionId"),
            (conv % 3 == 0).alias("isSidechain"),
            cwd.alias("cwd"),
            F.struct(
                F.concat(F.lit("m"), pair.cast("string")).alias("id"),
                F.struct(F.col("size").alias("output_tokens"), turn.alias("input_tokens")).alias("usage"),
                F.parse_json(files).alias("content"),
            ).alias("message"),
        )
    )
    title = F.when(turn % 3 == 0, F.concat(F.lit('{"type":"ai-title","aiTitle":"about '), turn.cast("string"), F.lit('"}'))).when(
        (turn % 3 == 1) & (conv % 4 == 0), F.concat(F.lit('{"type":"custom-title","customTitle":"'), F.when(turn < 4, turn.cast("string")).otherwise(""), F.lit('"}'))
    )
    torn = F.when(turn % 5 == 4, F.lit('{"type":"assistant","mess'))
    each = F.posexplode(F.array(message, title, torn)).alias("_k", "value")
    return said.select("conv_id", "turn", path.alias("path"), F.lit(0).cast("bigint").alias("block"), each).select(
        "path", "block", (turn * 3 + F.col("_k")).cast("bigint").alias("line"), "value"
    ).filter("value IS NOT NULL")


def _records(spark, sf):
    return records_of_lines(_lines(spark, sf), ROOT_FOLDER, "m")


def _digested(spark, sf):
    return turns.digest(split_torn(_records(spark, sf))[0])


def transcript_turns(spark, sf):
    kept = turns.dedupe_turns(_digested(spark, sf))
    return kept.select(
        "stream", "project_dir", "session_file", "is_subagent_file", "request_id", "message_id", "session_id", "is_subagent", "input_tokens",
        "output_tokens", "cwd", F.array_join("file_paths", ",").alias("files"), F.col("ord.line").alias("first_line"),
    )


def transcript_titles(spark, sf):
    return turns.session_titles(_digested(spark, sf)).select("session_file", "session_title")


def transcript_folders(spark, sf):
    return turns.evidence_folders(_digested(spark, sf)).select("stream", "folder")


def transcript_torn(spark, sf):
    return split_torn(_records(spark, sf))[1].groupBy("stream").agg(F.count(F.lit(1)).alias("torn"))


def transcript_fallback(spark, sf):
    return attribution.project_fallback(attribution.first_folders(_digested(spark, sf)), _repos(spark)).select("project_dir", "project_slug", "repo_key", "repo_name")


QUERIES = {f.__name__: f for f in (transcript_turns, transcript_titles, transcript_folders, transcript_torn, transcript_fallback)}

SAID = """
said AS (
  SELECT conv_id AS c, turn AS t, coalesce(length(text), 0) AS size, turn // 2 AS pair, concat('p', conv_id % 5) AS project_dir,
    conv_id % 3 = 0 AS nested,
    CASE WHEN conv_id % 3 = 0 THEN concat('c', conv_id - 1) ELSE concat('c', conv_id) END AS file,
    CASE WHEN conv_id % 3 = 0 THEN concat('/logs/p', conv_id % 5, '/c', conv_id - 1, '/sub/agent-c', conv_id, '.jsonl')
      ELSE concat('/logs/p', conv_id % 5, '/c', conv_id, '.jsonl') END AS stream,
    CASE WHEN turn % 4 <> 3 THEN concat('/w/r', conv_id % 5, '/d', turn % 3) END AS cwd,
    concat('/w/r', turn % 5, '/d', conv_id % 4) AS touched
  FROM conversations WHERE conv_id % 7 <> 0)
"""

ORACLES = {
    "transcript_turns": f"""WITH {SAID}
        SELECT stream, project_dir, concat(project_dir, '/', file) AS session_file, nested AS is_subagent_file, concat('r', c, '-', pair) AS request_id,
          concat('m', pair) AS message_id, concat('s', c) AS session_id, nested AS is_subagent, cast(t AS BIGINT) AS input_tokens, cast(size AS BIGINT) AS output_tokens, cwd,
          concat(touched, '/f.txt', CASE WHEN t % 2 = 1 THEN concat(',../n', t, '/book') ELSE '' END) AS files, cast(3 * first_t AS BIGINT) AS first_line
        FROM (SELECT *, min(t) OVER (PARTITION BY c, pair) AS first_t FROM said)
        QUALIFY row_number() OVER (PARTITION BY c, pair ORDER BY size DESC, t) = 1""",
    "transcript_titles": f"""WITH {SAID}
        SELECT concat(project_dir, '/', file) AS session_file,
          coalesce(cast(max(CASE WHEN c % 4 = 0 AND t % 3 = 1 AND t < 4 THEN t END) AS VARCHAR), concat('about ', max(CASE WHEN t % 3 = 0 THEN t END))) AS session_title
        FROM said WHERE NOT nested AND (t % 3 = 0 OR (c % 4 = 0 AND t % 3 = 1 AND t < 4)) GROUP BY ALL""",
    "transcript_folders": f"""WITH {SAID}
        SELECT stream, cwd AS folder FROM said WHERE cwd IS NOT NULL UNION SELECT stream, touched FROM said
        UNION SELECT stream, CASE WHEN cwd IS NULL THEN concat('/n', t) ELSE concat('/w/r', c % 5, '/n', t) END FROM said WHERE t % 2 = 1""",
    "transcript_torn": f"WITH {SAID} SELECT stream, count(*) AS torn FROM said WHERE t % 5 = 4 GROUP BY stream",
    "transcript_fallback": f"""WITH {SAID}, {REPO_VALUES},
        firsts AS (SELECT project_dir, first(cwd ORDER BY stream, t) AS folder FROM said WHERE NOT nested AND cwd IS NOT NULL GROUP BY project_dir),
        placed AS (SELECT *, {ROOT.format('folder')} AS root FROM firsts)
        SELECT project_dir, {LAST_TWO.format('coalesce(p.root, folder)')} AS project_slug, repo_key, {LAST_TWO.format('main_root')} AS repo_name
        FROM placed p LEFT JOIN repos r ON r.root = p.root""",
}
