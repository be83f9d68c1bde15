"""Environment files that no ignore pattern covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.catalog.rules import UNTRACKED_ENV_RULE
from auditlake.functions import text as tx
from auditlake.operators.findings import finding_row, rule_catalog
from auditlake.operators.joins import skewed_join
from auditlake.sources.settings import read_ignore_rules

# Words that mark an environment file as a template
TEMPLATE_WORDS = ("example", "sample", "template", "test")


def env_files(files: DataFrame) -> DataFrame:
    """Distinct (project, path, name) of environment files that are not templates, at any depth."""
    name = tx.file_name(F.col("path"))
    named = files.select("project", "path", name.alias("name")).filter(
        (F.col("name") == ".env") | F.startswith(F.col("name"), F.lit(".env."))
    )
    for word in TEMPLATE_WORDS:
        named = named.filter(~F.contains(F.col("name"), F.lit(word)))
    return named.distinct()


def detect_untracked_env(files: DataFrame) -> DataFrame:
    """One finding per environment file that its project's root ignore file does not cover.

    A project's patterns travel as one array on one row, so an environment file is joined once and
    no file-pattern pairs are formed.
    """
    covered = F.exists(
        F.col("patterns"),
        lambda p: F.rlike(F.col("path"), p["regex"]) | F.rlike(F.col("name"), p["regex"])
        | (F.col("path") == p["plain"]) | (F.col("name") == p["plain"]),
    )
    open_files = (
        skewed_join(env_files(files), read_ignore_rules(files), ["project"], "left")
        .filter(~F.coalesce(covered, F.lit(False)))
        .select("project", "path", F.lit(UNTRACKED_ENV_RULE.rule_ord).alias("rule_ord"))
    )
    catalog = F.broadcast(rule_catalog(files.sparkSession, (UNTRACKED_ENV_RULE,)).drop("pattern"))
    raw = F.concat(F.col("path"), F.lit(" (not in the ignore file)"))
    return open_files.join(catalog, "rule_ord").select(
        *finding_row(line=F.lit(1), raw=raw, count=F.lit(1), description=F.col("description"))
    )
