"""Which repository each turn belongs to, carried forward along its stream.

The carried repository makes this an ordered fold, and a stream may hold a large share of all turns. So every piece of
a stream is treated as a function of the repository carried into it, and functions compose:

1. turns are dealt to cells of CELL turns; most cells hold a turn whose outcome does not depend on what is carried, so
   they end in one sure repository; the few others are tables from start to end over the repositories of the stream;
2. the functions of cells compose to those of blocks (for transcripts: the file splits, which are bounded in size), and
   those of blocks along the stream; that gives each block, then each cell, its start;
3. every cell is folded from its start.

All of it is column expressions over arrays no longer than a cell, a block's cells or a stream's blocks. "" stands for
no repository yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spendmart.functions.paths import last_two_segments, parent_folder
from spendmart.operators.repos import resolve_folders
from spendmart.session import materialize

CELL = 64


def _step(carried: str, turn: str) -> str:
    """SQL of the repository after a turn: `here_root` is the folder's own, `tied_roots` those holding most touched files.

    The folder decides, unless the work it would step out of lies inside it: then what the files say, or what was carried.
    """
    files = f"IF(array_contains({turn}.tied_roots, {carried}), {carried}, {turn}.first_root)"
    inside = lambda root: f"coalesce(startswith({root}, concat({turn}.here_root, '/')), false)"
    return (
        f"CASE WHEN {turn}.here_root IS NOT NULL AND NOT {inside(carried)} AND NOT {inside(files)} THEN {turn}.here_root "
        f"ELSE coalesce({files}, {carried}) END"
    )


def _sure(turn: str) -> str:
    """SQL of the outcome of a turn that does not depend on what is carried, else NULL. `outer`: roots with others inside."""
    return (
        f"CASE WHEN {turn}.here_root IS NOT NULL AND NOT array_contains(outer, {turn}.here_root) THEN {turn}.here_root "
        f"WHEN size({turn}.tied_roots) = 1 AND ({turn}.here_root IS NULL OR startswith({turn}.first_root, concat({turn}.here_root, '/'))) "
        f"THEN {turn}.first_root END"
    )


def _moved(carried: str, part: str) -> str:
    """SQL of the repository after a part with a `sure` end, or else a table of the starts it `moves`."""
    return f"coalesce({part}.sure, {part}.moves[{carried}], {carried})"


def _as_function(parts: str, step: str, sure: str, starts: str) -> list[Column]:
    """Columns `sure` and `moves` of parts `x` in order, folded by `step` from a state `c`."""
    none = "CAST(NULL AS STRING)"
    end = F.expr(f"aggregate({parts}, {none}, (c, x) -> coalesce({sure}, IF(c IS NULL, NULL, {step})))")
    table = f"transform({starts}, s -> named_struct('key', s, 'value', aggregate({parts}, s, (c, x) -> {step})))"
    moves = F.expr(f"map_from_entries(filter({table}, e -> e.key <> e.value))")
    return [end.alias("sure"), F.when(end.isNull(), moves).alias("moves")]


def _running(parts: str, step: str) -> Column:
    """The states before the first part and after each part."""
    return F.expr(f"aggregate({parts}, array(start), (a, x) -> array_append(a, {step.replace('c@', 'element_at(a, -1)')}))")


def carry_roots(turns: DataFrame) -> DataFrame:
    """Adds `root` to turns with stream, block (bigint), ord, here_root, tied_roots, first_root; drops the three inputs."""
    place = F.row_number().over(W.partitionBy("stream", "block").orderBy("ord")) - 1
    payload = [c for c in turns.columns if c not in ("stream", "block")]
    dealt = turns.withColumn("_n", place).withColumn("_cell", F.floor(F.col("_n") / CELL))
    cells = dealt.groupBy("stream", "block", "_cell").agg(F.array_sort(F.collect_list(F.struct("_n", *payload))).alias("turns"))
    cells = materialize(cells, "cells")

    # What a stream can carry, and which of it contains other repositories
    named = F.flatten(F.transform("turns", lambda t: F.array_append(t["tied_roots"], t["here_root"])))
    sets = cells.select("stream", F.explode(F.array_distinct(named)).alias("root")).filter("root IS NOT NULL")
    sets = sets.groupBy("stream").agg(F.collect_set("root").alias("roots"))
    sets = sets.withColumn("outer", F.expr("filter(roots, o -> exists(roots, r -> startswith(r, concat(o, '/'))))"))
    known = cells.join(sets, "stream", "left")
    for column in ("roots", "outer"):
        known = known.withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    functions = known.select(
        "stream", "block", "_cell", *_as_function("turns", _step("c", "x"), _sure("x"), "array_append(roots, '')")
    )
    functions = materialize(functions, "cell-functions")

    inside = functions.groupBy("stream", "block").agg(F.array_sort(F.collect_list(F.struct("_cell", "sure", F.map_entries("moves").alias("_moves")))).alias("parts"))
    inside = inside.withColumn("parts", F.expr("transform(parts, p -> named_struct('_cell', p._cell, 'sure', p.sure, 'moves', map_from_entries(p._moves)))"))
    starts = "array_distinct(flatten(transform(parts, p -> coalesce(map_keys(p.moves), array()))))"
    blocks = inside.select("stream", "block", "parts", *_as_function("parts", _moved("c", "x"), "x.sure", starts))
    along = blocks.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("block", "sure", F.map_entries("moves").alias("_moves")))).alias("parts"))
    along = along.withColumn("parts", F.expr("transform(parts, p -> named_struct('block', p.block, 'sure', p.sure, 'moves', map_from_entries(p._moves)))"))
    moved = _moved("c@", "x")
    begun = along.withColumn("start", F.lit("")).select("stream", F.posexplode("parts.block").alias("_i", "block"), _running("parts", moved).alias("_at"))
    begun = begun.select("stream", "block", F.col("_at")[F.col("_i")].alias("start"))
    opened = blocks.join(begun, ["stream", "block"]).select("stream", "block", F.posexplode("parts._cell").alias("_i", "_cell"), _running("parts", moved).alias("_at"))
    opened = opened.select("stream", "block", "_cell", F.col("_at")[F.col("_i")].alias("start"))

    folded = cells.join(opened, ["stream", "block", "_cell"])
    roots = _running("turns", _step("c@", "x"))
    each = folded.select("stream", "block", F.explode(F.arrays_zip("turns", F.slice(roots, 2, CELL).alias("root"))).alias("_t"))
    kept = [c for c in turns.columns if c not in ("here_root", "tied_roots", "first_root")]
    return each.select(*[F.col(c) if c in ("stream", "block") else F.col(f"_t.turns.{c}").alias(c) for c in kept], F.nullif(F.col("_t.root"), F.lit("")).alias("root"))


def turn_candidates(turns: DataFrame, resolved: DataFrame) -> DataFrame:
    """Adds here_root, tied_roots and first_root: the folder's repository, and those holding most of the turn's files.

    `turns` has `file_folders`, which is dropped. Sessions touch the same few lists of folders again and again, so a list is
    worked out once per machine. A turn without stream or place is given no files' roots.
    """
    found = resolved.select(F.col("machine_id").alias("_m"), F.col("folder").alias("_f"), F.col("root").alias("_root"))
    here = turns.join(found, (F.col("machine_id") == F.col("_m")) & (F.col("cwd") == F.col("_f")), "left")
    here = here.withColumnRenamed("_root", "here_root").drop("_m", "_f")
    lists = turns.filter(F.size("file_folders") > 0).select("machine_id", "file_folders").distinct()
    touched = lists.select("*", F.posexplode("file_folders").alias("_at", "_folder"))
    roots = touched.join(found, (F.col("machine_id") == F.col("_m")) & (F.col("_folder") == F.col("_f")))
    # one row per list; its length is bounded by the files one message names
    held = roots.groupBy("machine_id", "file_folders").agg(F.collect_list(F.struct("_at", F.col("_root").alias("root"))).alias("_h"))
    names = F.array_distinct(F.transform("_h", lambda h: h["root"]))
    of = lambda root: F.filter("_h", lambda h: h["root"] == root)
    ranked = F.transform(names, lambda root: F.struct((-F.size(of(root))).alias("fewest"), F.array_min(F.transform(of(root), lambda h: h["_at"])).alias("at"), root.alias("root")))
    ranked = held.select(F.col("machine_id").alias("_lm"), F.col("file_folders").alias("_l"), F.array_sort(ranked).alias("_c"))
    best = ranked.select(
        "_lm",
        "_l",
        F.transform(F.filter("_c", lambda c: c["fewest"] == F.col("_c")[0]["fewest"]), lambda c: c["root"]).alias("tied_roots"),
        F.col("_c")[0]["root"].alias("first_root"),
    )
    best = materialize(best, "folder-lists")
    placed = F.col("stream").isNotNull() & F.col("ord").isNotNull()
    joined = here.join(best, (F.col("machine_id") == F.col("_lm")) & (F.col("file_folders") == F.col("_l")) & placed, "left").drop("_lm", "_l", "file_folders")
    return joined.withColumn("tied_roots", F.coalesce("tied_roots", F.array().cast("array<string>")))


def turn_folders(turns: DataFrame) -> DataFrame:
    """Distinct (machine_id, folder) that turns ran in or touched (`file_folders`)."""
    folders = F.array_distinct(F.concat("file_folders", F.array("cwd")))
    return turns.select("machine_id", F.explode(F.filter(folders, lambda f: f.isNotNull())).alias("folder")).distinct()


def attribute_turns(turns: DataFrame, repos: DataFrame, fallback: DataFrame, evidence: bool = True) -> DataFrame:
    """Adds project_slug, repo_key, repo_name to turns.

    `turns`: stream, block, ord, machine_id, project_dir, cwd, file_paths, ...; `fallback`: one row per
    machine_id and project_dir with project_slug, repo_key, repo_name, used until a stream has any evidence of
    its own: folders of one name on two machines are two projects. Turns of projects without a fallback are left
    out. The turns are read several times, so they are written out once instead of being computed again. Without
    `evidence`, cwd and file_paths end where they have been used, and are not moved along the streams.
    """
    turns = materialize(turns.withColumn("file_folders", F.transform("file_paths", parent_folder)), "turns")
    # both are written out so that their size is known: joined by machine and folder, all turns would meet in a few tasks
    repos, fallback = materialize(repos, "repos"), materialize(fallback, "fallback")
    resolved = materialize(resolve_folders(turn_folders(turns), repos), "folders")
    candidates = turn_candidates(turns, resolved)
    folded = carry_roots(candidates if evidence else candidates.drop("cwd", "file_paths"))
    roots = repos.filter(F.col("repo_key").isNotNull()).select(
        F.col("machine_id").alias("_m"), F.col("root").alias("_r"), F.col("repo_key").alias("_key"),
        last_two_segments(F.col("root")).alias("_place"), last_two_segments(F.col("main_root")).alias("_main"),
    )
    joined = folded.join(roots, (F.col("machine_id") == F.col("_m")) & (F.col("root") == F.col("_r")), "left")
    kept = fallback.select(
        F.col("machine_id").alias("_fm"), F.col("project_dir").alias("_p"), F.col("project_slug").alias("_slug"), F.col("repo_key").alias("_fkey"), F.col("repo_name").alias("_fname")
    )
    placed = joined.join(kept, (F.col("machine_id") == F.col("_fm")) & (F.col("project_dir") == F.col("_p")))
    own = F.col("root").isNotNull()
    return placed.select(
        *[folded[c] for c in folded.columns],
        F.when(own, F.coalesce("_place", last_two_segments(F.col("root")))).otherwise(F.col("_slug")).alias("project_slug"),
        F.when(own, F.col("_key")).otherwise(F.col("_fkey")).alias("repo_key"),
        F.when(own, F.col("_main")).otherwise(F.col("_fname")).alias("repo_name"),
    )


def first_folders(records: DataFrame) -> DataFrame:
    """(machine_id, project_dir, first): where a project's own top-level transcripts first record a folder, NULL where none does.

    Results for parts of the records combine by the smaller `first`.
    """
    own = ~F.col("is_nested_file") & F.col("cwd").isNotNull() & (F.col("cwd") != "")
    return records.groupBy("machine_id", "project_dir").agg(F.min(F.when(own, F.struct("stream", "ord", "cwd"))).alias("first"))


def project_fallback(firsts: DataFrame, repos: DataFrame) -> DataFrame:
    """(machine_id, project_dir, project_slug, repo_key, repo_name) from the first folder of each project that has one."""
    first = firsts.filter(F.col("first").isNotNull()).select("machine_id", "project_dir", F.col("first.cwd").alias("folder"))
    resolved = resolve_folders(first, repos).select(
        F.col("machine_id").alias("_m"), F.col("folder").alias("_f"), "root", "repo_key", "main_root"
    )
    joined = first.join(resolved, (F.col("machine_id") == F.col("_m")) & (F.col("folder") == F.col("_f")), "left")
    return joined.select(
        "machine_id",
        "project_dir",
        last_two_segments(F.coalesce("root", "folder")).alias("project_slug"),
        "repo_key",
        last_two_segments(F.col("main_root")).alias("repo_name"),
    )
