"""Reports as documents: JSON, SARIF, problem lines, baselines, report sections.

A document is a table of text lines (project, part, key, text). Written in that order, the lines of a
project make up its document. A project may hold any number of findings, so no document is ever
built as one value: rows are range partitioned, and a large project is spread over many tasks and
files. A document reads its findings more than once: pass a written table or ``durable(findings)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scoring as sc
from auditlake.functions import text as tx
from auditlake.operators.durable import durable
from auditlake.operators.joins import join_bounded

TOOL_NAME = "auditlake"
TOOL_VERSION = "1.0.0"

# SARIF format.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"

BASELINE_VERSION = 1


def emission_key() -> Column:
    """Sortable key of a finding within its project."""
    return F.struct("file_path", "check_ord", "rule_ord", "line_number", "fingerprint")


def _key(*values: Column) -> Column:
    """Row key of one type for every part of a document."""
    names = ("k1", "k2", "k3", "k4", "k5")
    types = ("string", "int", "int", "int", "string")
    given = list(values) + [F.lit(None)] * (len(names) - len(values))
    return F.struct(*[v.cast(t).alias(n) for v, t, n in zip(given, types, names)])


def _finding_key() -> Column:
    return _key(*[F.col(c) for c in ("file_path", "check_ord", "rule_ord", "line_number", "fingerprint")])


def _with_commas(items: DataFrame) -> DataFrame:
    """(project, part, key, text) rows as JSON array items: a comma before every item but the first.

    Items are ordered by key and a hash of the text, so no text is shuffled: the first place of each
    project is a merged minimum over keys and hashes, a row per project, measured and sent to the
    items. Only the rows at that place move; of equal ones, which are counted, one is first.
    """
    hashed = items.withColumn("place", F.struct("key", F.xxhash64("text").alias("h")))
    counted = hashed.groupBy("project", "place").agg(F.count("*").alias("copies"))
    first = counted.groupBy("project").agg(F.min(F.struct("place", "copies")).alias("first"))
    rows = join_bounded(hashed, first, ["project"], "inner")
    columns = ("project", "part", "key")
    later = rows.where("place <> first.place").select(*columns, F.concat(F.lit(","), "text").alias("text"))
    one = rows.where("place = first.place").dropDuplicates(["project"])
    comma = F.when(F.col("copy") > 1, ",").otherwise("")
    copies = one.select("*", F.explode(F.sequence(F.lit(1), F.col("first.copies").cast("int"))).alias("copy"))
    return later.unionByName(copies.select(*columns, F.concat(comma, "text").alias("text")))


def _line(projects: DataFrame, part: int, text: Column) -> DataFrame:
    return projects.select("project", F.lit(part).alias("part"), _key().alias("key"), text.alias("text"))


def _items(rows: DataFrame, part: int, key: Column, value: Column) -> DataFrame:
    return rows.select("project", F.lit(part).alias("part"), key.alias("key"), value.alias("text"))


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def finding_json() -> Column:
    """One finding as JSON, secrets masked."""
    return _json(F.struct(
        "rule_id", "severity", "category", "description", F.col("file_path").alias("file"),
        F.col("line_number").alias("line"),
        tx.display_snippet(F.col("category"), F.col("code_snippet")).alias("snippet"), "remediation", "cwe_id",
        "cwe_name", "owasp", "fix_hint", "confidence",
    ))


def _open_object(json: Column) -> Column:
    """JSON object text left open after its last field."""
    return F.regexp_replace(json, r"\}\z", "")


def findings_json(findings: DataFrame, summary: DataFrame) -> DataFrame:
    """Document per project: counts and grade, then the findings in emission order."""
    head = _json(F.struct(
        "files_scanned", F.col("total").alias("total_findings"), F.col("suppressed").alias("suppressed_by_baseline"),
        "grade", "critical", "high", "medium", "low",
    ))
    items = _items(findings, 1, _finding_key(), finding_json())
    return (
        _line(summary, 0, F.concat(_open_object(head), F.lit(',"findings":[')))
        .unionByName(_with_commas(items))
        .unionByName(_line(summary, 2, F.lit("]}")))
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules of a project, each as its first finding in emission order describes it."""
    first = findings.groupBy("project", "rule_id").agg(
        F.min_by(
            F.struct("description", "severity", "cwe_id", "cwe_name", "owasp", "check_ord", "rule_ord"), emission_key()
        ).alias("f"),
        F.min(emission_key()).alias("k"),
    )
    return first.select(
        "project", "rule_id", tx.strip_count_suffix(F.col("f.description")).alias("name"),
        sc.problem_level(F.col("f.severity")).alias("level"), sc.help_uri(F.col("f.cwe_id")).alias("help_uri"),
        sc.full_description(F.col("f.cwe_id"), F.col("f.cwe_name"), F.col("f.owasp")).alias("full_description"),
        sc.sarif_tags(F.col("f.cwe_id"), F.col("f.owasp")).alias("tags"), "k",
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """Result rows: rule, level, message with fix hint, location."""
    hint = F.when(F.col("fix_hint") != "", F.concat(F.lit("\n\nFix hint:\n"), F.col("fix_hint"))).otherwise(F.lit(""))
    return findings.select(
        "project", "rule_id", sc.problem_level(F.col("severity")).alias("level"),
        F.concat(F.col("description"), hint).alias("message"), tx.normalize_path(F.col("file_path")).alias("uri"),
        F.greatest(F.lit(1), F.col("line_number")).alias("start_line"),
        "file_path", "check_ord", "rule_ord", "line_number", "fingerprint",
    )


def sarif(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """SARIF document per project."""
    # null fields are left out here, as the format has no nulls
    rule = F.to_json(F.struct(
        F.col("rule_id").alias("id"), "name", F.struct(F.col("name").alias("text")).alias("shortDescription"),
        F.struct("level").alias("defaultConfiguration"), F.col("help_uri").alias("helpUri"),
        F.when(F.col("full_description").isNotNull(), F.struct(F.col("full_description").alias("text"))).alias("fullDescription"),
        F.when(F.size("tags") > 0, F.struct("tags")).alias("properties"),
    ))
    result = F.to_json(F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(
            F.struct("uri").alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")
        ).alias("physicalLocation"))).alias("locations"),
    ))
    head = (
        f'{{"$schema":"{SARIF_SCHEMA}","version":"{SARIF_VERSION}","runs":[{{"tool":{{"driver":'
        f'{{"name":"{TOOL_NAME}","version":"{TOOL_VERSION}","rules":['
    )
    rule_key = _key(*[F.col(f"k.{c}") for c in ("file_path", "check_ord", "rule_ord", "line_number", "fingerprint")])
    return (
        _line(projects, 0, F.lit(head))
        .unionByName(_with_commas(_items(sarif_rules(findings), 1, rule_key, rule)))
        .unionByName(_line(projects, 2, F.lit(']}},"results":[')))
        .unionByName(_with_commas(_items(sarif_results(findings), 3, _finding_key(), result)))
        .unionByName(_line(projects, 4, F.lit("]}]}")))
    )


def problem_lines(findings: DataFrame) -> DataFrame:
    """``file:line: level: [rule] text`` lines for editors and build logs."""
    text = F.concat(
        F.col("file_path"), F.lit(":"), F.col("line_number").cast("string"), F.lit(": "),
        sc.problem_level(F.col("severity")), F.lit(": ["), F.col("rule_id"), F.lit("] "), F.col("description"),
    )
    return _items(findings, 0, _finding_key(), text)


def baseline_json(findings: DataFrame, files_scanned: DataFrame) -> DataFrame:
    """Baseline document per project: fingerprints and findings of a run."""
    created = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    head = _json(F.struct(F.lit(BASELINE_VERSION).alias("version"), created.alias("created"), "files_scanned"))
    item = _json(F.struct(
        "rule_id", "severity", F.col("file_path").alias("file"), F.col("line_number").alias("line"),
        F.col("code_snippet").alias("snippet"), "fingerprint",
    ))
    prints = F.concat(F.lit('"'), F.col("fingerprint"), F.lit('"'))
    return (
        _line(files_scanned, 0, F.concat(_open_object(head), F.lit(',"fingerprints":[')))
        .unionByName(_with_commas(_items(findings, 1, _finding_key(), prints)))
        .unionByName(_line(files_scanned, 2, F.lit('],"findings":[')))
        .unionByName(_with_commas(_items(findings, 3, _finding_key(), item)))
        .unionByName(_line(files_scanned, 4, F.lit("]}")))
    )


def dependencies_json(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """Dependency document per project."""
    counts = findings.groupBy("project").agg(F.count("*").alias("n"))
    totals = projects.join(counts, "project", "left").select("project", F.coalesce("n", F.lit(0)).alias("n"))
    item = _json(F.struct(
        "package", "version", F.col("issue_type").alias("type"), "severity", "description",
        F.col("file_path").alias("file"), "remediation", "cve_id", "cvss_score",
    ))
    identity = F.sha1(F.concat_ws("|", "issue_type", "package", "version", "description", "file_path"))
    key = _key(F.col("file_path"), F.lit(0), F.lit(0), F.lit(0), identity)
    return (
        _line(totals, 0, F.concat(F.lit('{"total_findings":'), F.col("n").cast("string"), F.lit(',"findings":[')))
        .unionByName(_with_commas(_items(findings, 1, key, item)))
        .unionByName(_line(totals, 2, F.lit("]}")))
    )


def history_json(findings: DataFrame, counts: DataFrame) -> DataFrame:
    """History document per repository, snippets masked. ``findings`` has been marked still present."""
    totals = counts.select(F.col("repo").alias("project"), "total", "still_present")
    item = _json(F.struct(
        "rule_id", "description", F.col("commit_hash").alias("commit"), F.col("commit_date").alias("date"),
        F.col("commit_author").alias("author"), F.col("commit_message").alias("message"),
        F.col("file_path").alias("file"), tx.mask_secret(F.col("line_snippet")).alias("snippet"), "still_present",
    ))
    # log position, split in two so that it fits the row key
    key = _key(F.lit(""), F.floor(F.col("seq") / 2**30), F.col("seq") % 2**30, F.col("hit_ord"), F.col("fingerprint"))
    rows = findings.withColumnRenamed("repo", "project")
    head = F.concat(
        F.lit('{"total_findings":'), F.col("total").cast("string"), F.lit(',"still_present":'),
        F.col("still_present").cast("string"), F.lit(',"findings":['),
    )
    return (
        _line(totals, 0, head)
        .unionByName(_with_commas(_items(rows, 1, key, item)))
        .unionByName(_line(totals, 2, F.lit("]}")))
    )


def profile_json(profiles: DataFrame) -> DataFrame:
    """(project, text): profile document per project."""
    return profiles.select("project", _json(F.struct(*[c for c in profiles.columns if c != "project"])).alias("text"))


def write_documents(lines: DataFrame, path: str) -> None:
    """Write each project's lines under ``project=...``; its files in name order are its document.

    The lines are written before they are dealt to ranges, which reads them twice.
    """
    ordered = durable(lines).repartitionByRange("project", "part", "key").sortWithinPartitions("project", "part", "key")
    ordered.select("project", "text").write.mode("overwrite").partitionBy("project").text(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines, secrets masked, by project."""
    findings.select("project", finding_json().alias("text")).write.mode("overwrite").partitionBy("project").text(path)


def write_baseline(findings: DataFrame, path: str) -> None:
    """Baseline table, read back by ``load_baseline``."""
    from auditlake.operators.baseline import baseline_snapshot

    baseline_snapshot(findings).write.mode("overwrite").partitionBy("project").parquet(path)
