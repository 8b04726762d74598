"""Which repository a folder lies in: a longest-prefix join over the repository dimension.

`repos`: machine_id, root, repo_key, main_root. A checkout without a remote is listed with a NULL
key: it must win the prefix match and then answer "nothing", it does not fall through to a
repository around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendmart.functions.paths import ancestors, last_two_segments, main_checkout, repo_key, segments


def repos_from_facts(facts: DataFrame) -> DataFrame:
    """The dimension from what git reports per checkout: machine_id, root, remote, common_dir."""
    return facts.select("machine_id", "root", repo_key(F.col("remote")).alias("repo_key"), main_checkout(F.col("common_dir")).alias("main_root"))


def resolve_folders(folders: DataFrame, repos: DataFrame) -> DataFrame:
    """(machine_id, folder, root, repo_key, main_root) for each distinct folder that lies in a usable repository.

    Distinct folders only, each exploded into its few ancestors and equi-joined on the root; the join
    strategy is left to the optimiser, which knows the size of the dimension.
    """
    distinct = folders.select("machine_id", "folder").distinct()
    steps = distinct.withColumn("_root", F.explode(ancestors(F.col("folder"))))
    known = repos.select(F.col("machine_id").alias("_machine"), "root", "repo_key", "main_root")
    matches = steps.join(known, (F.col("machine_id") == F.col("_machine")) & (F.col("_root") == F.col("root")))
    deepest = matches.groupBy("machine_id", "folder").agg(
        F.max(F.struct(F.size(segments(F.col("root"))).alias("depth"), "root", "repo_key", "main_root")).alias("_best")
    )
    return deepest.select("machine_id", "folder", "_best.root", "_best.repo_key", "_best.main_root").filter(F.col("repo_key").isNotNull())


def session_repo_tags(folders: DataFrame, repos: DataFrame) -> DataFrame:
    """(session_id, repo_key, name) from (session_id, machine_id, folder): the repositories a session worked in."""
    resolved = resolve_folders(folders, repos).select(F.col("machine_id").alias("_m"), F.col("folder").alias("_f"), "root", "repo_key", "main_root")
    joined = folders.join(resolved, (F.col("machine_id") == F.col("_m")) & (F.col("folder") == F.col("_f")))
    return joined.groupBy("session_id", "repo_key").agg(
        F.min(last_two_segments(F.coalesce("main_root", "root"))).alias("name")
    )
