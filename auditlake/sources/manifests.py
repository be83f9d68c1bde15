"""Dependency manifests as rows of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import text as tx
from auditlake.functions.dialect import LINE_ENDS, to_jvm
from auditlake.operators.durable import durable

# Requirement line, dependency list and list entry formats.
REQUIREMENT = r"^([a-zA-Z0-9_-]+)(?:\[.*\])?(?:([=<>!~]+)(.+))?"
PROJECT_LIST = r"(?s)dependencies\s*=\s*\[(.*?)\]"
PROJECT_ENTRY = r"""["']([a-zA-Z0-9_-]+)(?:[=<>!~]+([^"']+))?["']"""

PACKAGE_COLUMNS = ["project", "path", "ecosystem", "name", "original", "version", "pos"]


def _jvm(pattern: str) -> str:
    return to_jvm(pattern, flags="(?d)")


def select_manifests(files: DataFrame) -> DataFrame:
    """Manifest files with their ``kind``; vendored directories are skipped."""
    path, name = F.col("path"), tx.file_name(F.col("path"))
    kind = (
        F.when(name.rlike(r"(?s)\Arequirements.*\.txt\z"), "requirements")
        .when(name == "pyproject.toml", "pyproject")
        .when(name == "package.json", "package_json")
    )
    vendored = F.contains(path, F.lit("node_modules")) | (
        F.contains(path, F.lit(".venv")) & (name != "package.json")
    )
    return files.withColumn("kind", kind).filter(F.col("kind").isNotNull() & ~vendored)


def _last_per_package(rows: DataFrame) -> DataFrame:
    """One row per package of a manifest: first position, last spelling and version."""
    return (
        rows.groupBy("project", "path", "ecosystem", "name")
        .agg(F.max_by(F.struct("original", "version"), F.col("pos")).alias("last"), F.min("pos").alias("pos"))
        .select("project", "path", "ecosystem", "name", "last.original", "last.version", "pos")
    )


def parse_requirements(manifests: DataFrame) -> DataFrame:
    """Packages of requirements files; blank, comment and option lines are skipped."""
    lines = manifests.filter(F.col("kind") == "requirements").select(
        "project", "path", F.posexplode(F.split("content", LINE_ENDS, -1)).alias("pos", "raw")
    )
    line = lines.select("project", "path", "pos", tx.strip(F.col("raw")).alias("line")).filter(
        (F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("#")) & ~F.startswith(F.col("line"), F.lit("-"))
    )
    pattern = _jvm(REQUIREMENT)
    name = F.regexp_extract("line", pattern, 1)
    version = F.regexp_extract("line", pattern, 3)
    rows = line.select(
        "project", "path", F.lit("python").alias("ecosystem"), F.lower(name).alias("name"),
        F.lower(name).alias("original"), F.when(version != "", tx.strip(version)).alias("version"), "pos",
    ).filter(F.col("name") != "")
    return _last_per_package(rows)


def parse_pyproject(manifests: DataFrame) -> DataFrame:
    """Packages of the first dependency list of a project file."""
    listed = manifests.filter(F.col("kind") == "pyproject").select(
        "project", "path", F.regexp_extract("content", _jvm(PROJECT_LIST), 1).alias("body")
    )
    entry = F.lit(_jvm(PROJECT_ENTRY))
    zipped = F.arrays_zip(
        F.regexp_extract_all("body", entry, F.lit(1)).alias("name"),
        F.regexp_extract_all("body", entry, F.lit(2)).alias("version"),
    )
    rows = listed.select("project", "path", F.posexplode(zipped).alias("pos", "e")).select(
        "project", "path", F.lit("python").alias("ecosystem"), F.lower("e.name").alias("name"),
        F.lower("e.name").alias("original"), F.when(F.col("e.version") != "", F.col("e.version")).alias("version"),
        "pos",
    )
    return _last_per_package(rows)


def parse_package_json(manifests: DataFrame) -> DataFrame:
    """Packages of a package file; development entries override and come after the others."""
    parsed = manifests.filter(F.col("kind") == "package_json").select(
        "project", "path",
        F.from_json(
            F.col("content"), "dependencies map<string,string>, devDependencies map<string,string>"
        ).alias("j"),
    )

    def entries(column: str) -> Column:
        return F.coalesce(F.map_entries(F.col(column)), F.array().cast("array<struct<key:string,value:string>>"))

    every = F.concat(entries("j.dependencies"), entries("j.devDependencies"))
    rows = parsed.select("project", "path", F.posexplode(every).alias("pos", "e")).select(
        "project", "path", F.lit("npm").alias("ecosystem"), F.lower("e.key").alias("name"),
        F.col("e.key").alias("original"), F.col("e.value").alias("version"), "pos",
    )
    return _last_per_package(rows)


def read_packages(files: DataFrame) -> DataFrame:
    """(project, path, ecosystem, name, original, version, pos) of every manifest in a corpus.

    The manifests, a small part of a corpus, are written once, so that three parsers and their
    consumers do not read the corpus again.
    """
    manifests = durable(select_manifests(files).select("project", "path", "content", "kind"))
    return durable(
        parse_requirements(manifests)
        .unionByName(parse_pyproject(manifests))
        .unionByName(parse_package_json(manifests))
    )
