"""Folder paths and git remotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ECMAScript white space, spelled out because Java's \s is ASCII only
WHITE_SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def trim_white(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^[{WHITE_SPACE}]+", ""), f"[{WHITE_SPACE}]+\\z", "")


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda part: part != "")


def last_two_segments(path: Column) -> Column:
    """`parent/name` of a folder; shorter paths give what there is."""
    parts = segments(path)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")


def parent_folder(path: Column) -> Column:
    """The folder holding a path."""
    trimmed = F.rtrim(path, F.lit("/"))
    head = F.left(trimmed, F.length(trimmed) - F.length(F.substring_index(trimmed, "/", -1)) - 1)
    return (
        F.when(~trimmed.contains("/"), F.when(path.startswith("/"), "/").otherwise("."))
        .when(head == "", "/")
        .otherwise(head)
    )


def resolve(folder: Column, path: Column) -> Column:
    """`path` made absolute against `folder`, with `.` and `..` worked out."""
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.coalesce(folder, F.lit("/")), F.lit("/"), path))
    parts = F.aggregate(
        segments(joined),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def ancestors(path: Column) -> Column:
    """The folder and every folder above it, deepest last, without the file-system root."""
    parts = segments(path)
    return F.when(
        F.size(parts) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
        ),
    ).otherwise(F.array().cast("array<string>"))


def strictly_contains(outer: Column, inner: Column) -> Column:
    return F.coalesce(F.startswith(inner, F.concat(outer, F.lit("/"))), F.lit(False))


# fixed values: the remote forms that must compare equal
SCP_FORM = r"^([^@/]+@)?([^:/]+):(?!//)"
URL_SCHEME = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^@/]+@)?"
TRAILING_SLASHES = r"/+\z"
GIT_SUFFIX = r"(?i)[.]git\z"


def normalize_git_remote(remote: Column) -> Column:
    """`host/path` of a remote, the same for its scp, https, ssh and `.git` spellings."""
    bare = F.regexp_replace(trim_white(remote), SCP_FORM, "$2/")
    bare = F.regexp_replace(bare, URL_SCHEME, "")
    bare = F.regexp_replace(bare, TRAILING_SLASHES, "")
    return F.lower(F.regexp_replace(bare, GIT_SUFFIX, ""))


def repo_key(remote: Column) -> Column:
    """Opaque repository identity; the remote itself never leaves the machine."""
    return F.sha2(normalize_git_remote(remote), 256)


def main_checkout(git_common_dir: Column) -> Column:
    """Folder of the main checkout, NULL for a bare repository."""
    return F.when(git_common_dir.endswith("/.git"), F.regexp_replace(git_common_dir, "/[.]git\\z", ""))
