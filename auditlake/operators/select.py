"""Which files of a corpus are scanned."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as tx
from auditlake.functions.dialect import glob_to_jvm, tail_glob
from auditlake.operators.joins import join_bounded

# File types a scan reads, besides names that start with .env
SCANNABLE_EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".vue", ".svelte", ".java", ".kt", ".go", ".rs", ".rb", ".php", ".html",
    ".htm", ".json", ".yaml", ".yml", ".toml", ".env", ".config", ".conf",
)

# Directories never entered, at any depth
SKIP_DIRS = (
    "node_modules", ".git", "__pycache__", ".next", ".nuxt", "dist", "build", ".venv", "venv", "env", ".env",
    "vendor", "target", ".idea", ".vscode",
)


def filter_scannable(files: DataFrame) -> DataFrame:
    """Files of a scanned type or named ``.env*``. Stored ``ext`` and ``name`` columns reach the scan's filter."""
    path = F.col("path")
    ext = F.col("ext") if "ext" in files.columns else tx.file_ext(path)
    name = F.col("name") if "name" in files.columns else tx.file_name(path)
    return files.filter(ext.isin(*SCANNABLE_EXTENSIONS) | F.startswith(name, F.lit(".env")))


def under_dirs(path: Column, names: Iterable[str]) -> Column:
    """Whether a path lies under a directory of one of the names, at any depth."""
    return path.rlike("(?:^|/)(?:" + "|".join(glob_to_jvm(n) for n in names) + ")/")


def prune_dirs(files: DataFrame, names: Iterable[str] = SKIP_DIRS) -> DataFrame:
    return files.filter(~under_dirs(F.col("path"), names))


def exclude_paths(files: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Drop files by path prefix or by a glob matched from the right.

    A prefix ends anywhere in a name (``tests`` also drops ``tests_util.py``) and the empty prefix
    drops everything, as ``""`` and ``/`` say.
    """
    path = F.col("path")
    for pattern in patterns:
        prefix = pattern.rstrip("/")
        drop = F.startswith(path, F.lit(prefix))
        if prefix and not pattern.startswith("/"):
            drop = drop | path.rlike(tail_glob(pattern))
        files = files.filter(~drop)
    return files


def restrict_to_changed(files: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Only files named in ``changed`` (project, path); an empty table keeps none, ``None`` keeps all."""
    if changed is None:
        return files
    return join_bounded(files, changed.select("project", "path"), ["project", "path"], "left_semi")


def select_files(
    files: DataFrame, exclude: Iterable[str] = (), changed: DataFrame | None = None
) -> DataFrame:
    """All selection steps; the cheap path filters come first, before any join."""
    kept = exclude_paths(prune_dirs(filter_scannable(files)), exclude)
    return restrict_to_changed(kept, changed)


def exclude_paths_by_project(files: DataFrame, settings: DataFrame) -> DataFrame:
    """Per-project ``exclude_paths`` arrays: drop a file if any entry of its project covers it."""
    from auditlake.sources.settings import path_excludes

    rules = settings.select("project", path_excludes()(F.col("exclude_paths")).alias("excludes"))
    covered = F.exists(
        F.col("excludes"),
        lambda e: F.startswith(F.col("path"), e["prefix"]) | F.coalesce(F.rlike(F.col("path"), e["tail"]), F.lit(False)),
    )
    joined = join_bounded(files, rules, ["project"], "left")
    return joined.filter(~F.coalesce(covered, F.lit(False))).drop("excludes")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project, path, change) of files added or modified between two snapshots.

    Contents are reduced to a digest before the join, so only paths and digests are shuffled.
    """
    old = before.select("project", "path", F.sha2(F.col("content"), 256).alias("old_digest"))
    new = after.select("project", "path", F.sha2(F.col("content"), 256).alias("new_digest"))
    change = F.when(F.col("old_digest").isNull(), "added").when(F.col("old_digest") != F.col("new_digest"), "modified")
    joined = new.join(old, ["project", "path"], "left").select("project", "path", change.alias("change"))
    return joined.filter(F.col("change").isNotNull())
