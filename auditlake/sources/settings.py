"""Per-project settings, baselines and ignore files, read from the corpus itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.dialect import tail_glob, whole_glob
from auditlake.operators.joins import join_bounded
from auditlake.schema import BASELINE, CONFIG, CUSTOM_PATTERNS

CONFIG_NAME = ".audit.json"
BASELINE_NAME = ".audit-baseline.json"
IGNORE_NAME = ".gitignore"


def read_config(files: DataFrame, name: str = CONFIG_NAME) -> DataFrame:
    """Settings row per project that has a settings file; broken files give the defaults.

    Projects without the file have no row: join left and use the defaults of ``ScanConfig``.
    """
    parsed = files.filter(F.col("path") == name).select(
        "project", F.from_json(F.col("content"), CONFIG, {"mode": "PERMISSIVE"}).alias("c")
    )
    rules = F.col("c.exclude_rules")
    listed = F.coalesce(
        F.when(F.startswith(F.ltrim(rules), F.lit("[")), F.from_json(rules, "array<string>")),
        F.when(rules.isNotNull(), F.array(rules)),
        F.array().cast("array<string>"),
    )
    return parsed.select(
        "project",
        F.col("c.checks").alias("checks"),
        F.coalesce(F.col("c.severity_threshold"), F.lit("low")).alias("severity_threshold"),
        F.col("c.baseline").alias("baseline"),
        F.coalesce(F.col("c.exclude_paths"), F.array().cast("array<string>")).alias("exclude_paths"),
        listed.alias("exclude_rules"),
        F.coalesce(F.col("c.fail_on"), F.lit("critical")).alias("fail_on"),
        F.coalesce(
            F.col("c.custom_patterns"), F.array().cast(CUSTOM_PATTERNS)
        ).alias("custom_patterns"),
    )


def path_excludes():
    """exclude_paths entries as (prefix, tail): a path prefix and a pattern for the path's end."""

    @F.pandas_udf("array<struct<prefix:string,tail:string>>")
    def compile_all(entries: pd.Series) -> pd.Series:
        def one(values):
            out = []
            for v in values if values is not None else []:
                if not isinstance(v, str):  # a settings file may hold anything
                    continue
                prefix = v.rstrip("/")
                out.append({"prefix": prefix, "tail": tail_glob(v) if prefix and not v.startswith("/") else None})
            return out

        return entries.map(one)

    return compile_all


def read_baseline(files: DataFrame, name: str = BASELINE_NAME) -> DataFrame:
    """Distinct (project, fingerprint) of the baseline files in a corpus; broken files give none."""
    parsed = files.filter(F.col("path") == name).select(
        "project", F.from_json(F.col("content"), BASELINE, {"mode": "PERMISSIVE"}).alias("b")
    )
    return parsed.select("project", F.explode("b.fingerprints").alias("fingerprint")).distinct()


def read_project_baselines(files: DataFrame, settings: DataFrame) -> DataFrame:
    """Distinct (project, fingerprint) of the baseline file that each project's settings name."""
    named = settings.filter(F.col("baseline").isNotNull()).select("project", F.col("baseline").alias("path")).distinct()
    chosen = join_bounded(files.select("project", "path", "content"), named, ["project", "path"], "left_semi")
    parsed = chosen.select("project", F.from_json(F.col("content"), BASELINE, {"mode": "PERMISSIVE"}).alias("b"))
    return parsed.select("project", F.explode("b.fingerprints").alias("fingerprint")).distinct()


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (project, fingerprint) of a baseline written by ``write_baseline``."""
    return spark.read.parquet(path).select("project", "fingerprint").distinct()


def _ignore_lines():
    @F.pandas_udf("array<struct<pattern:string,regex:string,plain:string>>")
    def parse(content: pd.Series) -> pd.Series:
        def one(text):
            lines = (line.strip() for line in (text or "").splitlines())
            return [
                {"pattern": line, "regex": whole_glob(line), "plain": line.lstrip("/")}
                for line in lines
                if line and not line.startswith("#")
            ]

        return content.map(one)

    return parse


def read_ignore_rules(files: DataFrame) -> DataFrame:
    """(project, patterns) from each project's root ignore file: pattern, whole-text regex, plain name."""
    return files.filter(F.col("path") == IGNORE_NAME).select(
        "project", _ignore_lines()(F.col("content")).alias("patterns")
    )


def read_gitignore(files: DataFrame) -> DataFrame:
    """(project, pattern), one row per ignore pattern."""
    return read_ignore_rules(files).select("project", F.explode("patterns.pattern").alias("pattern"))
