"""Registered queries over sinks, per-project settings and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.config import ScanConfig
from auditlake.operators import baseline as bl
from auditlake.operators import history as hi
from auditlake.operators import rollup as ro
from auditlake.operators.detect import detect, detect_project_patterns
from auditlake.operators.durable import checkpoint_folder, durable
from auditlake.plans.audit import audit_dependencies, audit_history, gate_by_project, report_findings, scan_by_project
from auditlake.sinks import documents as doc
from auditlake.sinks import report as rp
from auditlake.sources import advisories as adv
from auditlake.sources import settings as st
from auditlake.sources.commit_log import read_logs
from auditlake.sources.tree import read_corpus, read_tree, stream_tree
from auditlake.streaming.life import finding_life
from auditlake.streaming.scan import stream_new_findings, stream_scan, stream_severity_windows
from workload import corpus as co
from workload.oracle import findings_ctes
from workload.queries import (
    _ADVISORY_SQL,
    _ALL_FOUND,
    _COUNTS_SQL,
    _GRADED_SQL,
    _HISTORY_SQL,
    _KNOWN_SQL,
    _NEXT_FOUND,
    _PROFILE_SQL,
    _graded,
    _profiles,
    CORE,
    CORE_SQL,
    all_findings,
    query,
)

_LEVEL_SQL = "CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' ELSE 'warning' END"
_ORDER_SQL = "file_path, check_ord, rule_ord, line_number, fingerprint"


@query("sarif_rules", f"""WITH {_ALL_FOUND}, firsts AS (
  SELECT *, row_number() OVER (PARTITION BY project, rule_id ORDER BY {_ORDER_SQL}) AS nth FROM found)
SELECT project, rule_id, split_part(description, ' (and ', 1) AS name, {_LEVEL_SQL} AS level,
  'https://cwe.mitre.org/data/definitions/' || replace(cwe_id, 'CWE-', '') || '.html' AS help_uri,
  cwe_id || ': ' || cwe_name || '. ' || owasp AS full_description, cwe_id || ',' || split_part(owasp, ' – ', 1) AS tags
FROM firsts WHERE nth = 1""")
def sarif_rules(spark, sf_dir):
    return doc.sarif_rules(all_findings(spark, sf_dir)).select(
        "project", "rule_id", "name", "level", "help_uri", "full_description", F.array_join("tags", ",").alias("tags")
    )


@query("sarif_results", f"""WITH {_ALL_FOUND}
SELECT project, rule_id, {_LEVEL_SQL} AS level, description || CASE WHEN fix_hint = '' THEN '' ELSE chr(10) || chr(10) || 'Fix hint:' || chr(10) || fix_hint END AS message,
  replace(file_path, '\\', '/') AS uri, greatest(1, line_number) AS start_line FROM found""")
def sarif_results(spark, sf_dir):
    return doc.sarif_results(all_findings(spark, sf_dir)).select("project", "rule_id", "level", "message", "uri", "start_line")


@query("sarif_document", f"""WITH {_ALL_FOUND}, firsts AS (
  SELECT *, row_number() OVER (PARTITION BY project, rule_id ORDER BY {_ORDER_SQL}) AS nth FROM found),
rules AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {_ORDER_SQL}) AS place FROM firsts WHERE nth = 1),
results AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {_ORDER_SQL}) AS place FROM found),
projects AS (SELECT DISTINCT project FROM corpus_files)
SELECT project, 0 AS part, '{{"$schema":"{doc.SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{doc.TOOL_NAME}","version":"{doc.TOOL_VERSION}","rules":[' AS text FROM projects
UNION ALL SELECT project, 1, CASE WHEN place > 1 THEN ',' ELSE '' END || CAST(to_json({{'id': rule_id, 'name': split_part(description, ' (and ', 1),
  'shortDescription': {{'text': split_part(description, ' (and ', 1)}}, 'defaultConfiguration': {{'level': {_LEVEL_SQL}}},
  'helpUri': 'https://cwe.mitre.org/data/definitions/' || replace(cwe_id, 'CWE-', '') || '.html', 'fullDescription': {{'text': cwe_id || ': ' || cwe_name || '. ' || owasp}},
  'properties': {{'tags': [cwe_id, split_part(owasp, ' – ', 1)]}}}}) AS VARCHAR) FROM rules
UNION ALL SELECT project, 2, ']}}}},"results":[' FROM projects
UNION ALL SELECT project, 3, CASE WHEN place > 1 THEN ',' ELSE '' END || CAST(to_json({{'ruleId': rule_id, 'level': {_LEVEL_SQL},
  'message': {{'text': description || CASE WHEN fix_hint = '' THEN '' ELSE chr(10) || chr(10) || 'Fix hint:' || chr(10) || fix_hint END}},
  'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': file_path}}, 'region': {{'startLine': line_number}}}}}}]}}) AS VARCHAR) FROM results
UNION ALL SELECT project, 4, ']}}]}}' FROM projects""")
def sarif_document(spark, sf_dir):
    found = durable(all_findings(spark, sf_dir))
    projects = ro.files_scanned(co.corpus_files(spark, sf_dir)).select("project")
    return doc.sarif(found, projects).select("project", "part", "text")


@query("problem_lines", f"""WITH {_ALL_FOUND}
SELECT project, file_path || ':' || CAST(line_number AS VARCHAR) || ': ' || {_LEVEL_SQL} || ': [' || rule_id || '] ' || description AS text FROM found""")
def problem_lines(spark, sf_dir):
    return doc.problem_lines(all_findings(spark, sf_dir)).select("project", "text")


_MASKED_SQL = """CASE WHEN category = 'Secrets' THEN regexp_replace(regexp_replace(code_snippet, '"[A-Za-z0-9+/=_\\-\\.@]{8,}"', '"****"', 'g'),
  '''[A-Za-z0-9+/=_\\-\\.@]{8,}''', '''****''', 'g') ELSE code_snippet END"""


@query("findings_json", f"""WITH {_ALL_FOUND},
counts AS (SELECT project, count(*) AS files_scanned FROM corpus_files GROUP BY project),
totals AS (SELECT project, count(*) AS total, {_COUNTS_SQL} FROM found GROUP BY project),
items AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY {_ORDER_SQL}) AS nth,
  CAST(to_json({{'rule_id': rule_id, 'severity': severity, 'category': category, 'description': description, 'file': file_path, 'line': line_number,
    'snippet': {_MASKED_SQL}, 'remediation': remediation, 'cwe_id': cwe_id, 'cwe_name': cwe_name, 'owasp': owasp, 'fix_hint': fix_hint, 'confidence': confidence}}) AS VARCHAR) AS j FROM found)
SELECT project, 0 AS part, '{{"files_scanned":' || files_scanned || ',"total_findings":' || total || ',"suppressed_by_baseline":0,"grade":"' ||
  CASE WHEN critical > 0 THEN 'F' WHEN high > 0 THEN 'D' WHEN medium > 0 THEN 'C' ELSE 'A' END || '","critical":' || critical || ',"high":' || high || ',"medium":' || medium || ',"low":' || low || ',"findings":[' AS text
FROM counts JOIN totals USING (project)
UNION ALL SELECT project, 1, CASE WHEN nth > 1 THEN ',' ELSE '' END || j FROM items
UNION ALL SELECT project, 2, ']}}' FROM counts""")
def findings_json(spark, sf_dir):
    files = co.corpus_files(spark, sf_dir)
    found = durable(detect(files))
    return doc.findings_json(found, ro.project_summary(found, files)).select("project", "part", "text")


@query("baseline_document", f"""WITH {_ALL_FOUND},
placed AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY {_ORDER_SQL}) AS place FROM found),
counts AS (SELECT project, count(*) AS files_scanned FROM corpus_files GROUP BY project)
SELECT project, 0 AS part, '{{"version":1,"created":"","files_scanned":' || files_scanned || ',"fingerprints":[' AS text FROM counts
UNION ALL SELECT project, 1, CASE WHEN place > 1 THEN ',' ELSE '' END || '"' || fingerprint || '"' FROM placed
UNION ALL SELECT project, 2, '],"findings":[' FROM counts
UNION ALL SELECT project, 3, CASE WHEN place > 1 THEN ',' ELSE '' END || CAST(to_json({{'rule_id': rule_id, 'severity': severity, 'file': file_path, 'line': line_number,
  'snippet': code_snippet, 'fingerprint': fingerprint}}) AS VARCHAR) FROM placed
UNION ALL SELECT project, 4, ']}}' FROM counts""")
def baseline_document(spark, sf_dir):
    """Baseline documents, with the time of the run left out."""
    files = co.corpus_files(spark, sf_dir)
    return doc.baseline_json(durable(detect(files)), ro.files_scanned(files)).select(
        "project", "part", F.regexp_replace("text", '"created":"[^"]*"', '"created":""').alias("text")
    )


def _dependency_sql() -> str:
    """Every dependency finding of the manifests, then its document."""
    return f"""WITH {co.MANIFEST_SQL}, {_KNOWN_SQL}, {_ADVISORY_SQL},
every AS (
  SELECT project, original AS package, CAST(NULL AS VARCHAR) AS version, issue_type, 'CRITICAL' AS severity,
    '"' || original || CASE WHEN issue_type = 'hallucinated' THEN '" is a name assistants invent; it may not exist'
      WHEN meant IS NULL THEN '" is abandoned or malicious' ELSE '" looks like a stand-in for "' || meant || '"' END AS description, path AS file_path,
    CASE WHEN issue_type = 'hallucinated' THEN 'Look the package up on ' || CASE ecosystem WHEN 'npm' THEN 'npmjs.com' ELSE 'pypi.org' END || ' before installing it'
      WHEN meant IS NULL THEN 'Remove "' || original || '" and pick a maintained package' ELSE 'Check the name; "' || meant || '" may be meant' END AS remediation, CAST(NULL AS VARCHAR) AS cve_id
  FROM packages JOIN known_names USING (ecosystem, name)
  UNION ALL SELECT project, original, version, 'suspicious', 'MEDIUM', '"' || original || '" has no fixed version: "' || version || '"', path,
    'npm install ' || original || '@<version> --save-exact', NULL FROM packages WHERE ecosystem = 'npm' AND version IN ('*', 'latest', '')
  UNION ALL SELECT project, original, version, 'vulnerable', severity, cve_id || ': ' || summary, path,
    CASE ecosystem WHEN 'npm' THEN 'npm update ' ELSE 'pip install --upgrade ' END || original, cve_id
  FROM packages JOIN advisory USING (ecosystem, name) WHERE coalesce(version, '') = '' OR list_contains(versions, version)),
placed AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file_path, sha1(concat_ws('|', issue_type, package, version, description, file_path))) AS place FROM every),
totals AS (SELECT project, count(e.package) AS n FROM (SELECT DISTINCT project FROM manifests) LEFT JOIN every e USING (project) GROUP BY project)
SELECT project, 0 AS part, '{{"total_findings":' || n || ',"findings":[' AS text FROM totals
UNION ALL SELECT project, 1, CASE WHEN place > 1 THEN ',' ELSE '' END || CAST(to_json({{'package': package, 'version': version, 'type': issue_type, 'severity': severity,
  'description': description, 'file': file_path, 'remediation': remediation, 'cve_id': cve_id, 'cvss_score': NULL}}) AS VARCHAR) FROM placed
UNION ALL SELECT project, 2, ']}}' FROM totals"""


@query("dependencies_document", _dependency_sql())
def dependencies_document(spark, sf_dir):
    manifests = co.manifests(spark, sf_dir)
    found = durable(audit_dependencies(manifests, co.advisory_rows(spark)))
    return doc.dependencies_json(found, manifests.select("project").distinct()).select("project", "part", "text")


@query("history_document", f"""WITH {_HISTORY_SQL},
items AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY seq, hit_ord) AS nth, CAST(to_json({{'rule_id': rule_id, 'description': description,
  'commit': sha1(CAST(doc_id AS VARCHAR)), 'date': CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS VARCHAR), 'author': lang, 'message': 'change ' || CAST(doc_id AS VARCHAR), 'file': path,
  'snippet': regexp_replace(regexp_replace(line_snippet, '"[A-Za-z0-9+/=_\\-\\.@]{{8,}}"', '"****"', 'g'), '''[A-Za-z0-9+/=_\\-\\.@]{{8,}}''', '''****''', 'g'), 'still_present': still_present}}) AS VARCHAR) AS j FROM marked)
SELECT repo AS project, 0 AS part, '{{"total_findings":' || count(*) || ',"still_present":' || count_if(still_present) || ',"findings":[' AS text FROM marked GROUP BY repo
UNION ALL SELECT repo, 1, CASE WHEN nth > 1 THEN ',' ELSE '' END || j FROM items
UNION ALL SELECT DISTINCT repo, 2, ']}}' FROM marked""")
def history_document(spark, sf_dir):
    found = hi.mark_still_present(hi.history_findings(co.commit_log(spark, sf_dir)), co.head_files(spark, sf_dir))
    found = durable(found)
    return doc.history_json(found, hi.history_counts(found)).select("project", "part", "text")


@query("profile_document", f"""WITH {_PROFILE_SQL}, parts AS (
  SELECT *, list_concat(
    CASE WHEN list_contains(tools, 'lovable') THEN ['cloud'] ELSE [] END, ['secrets'], CASE WHEN len(databases) > 0 THEN ['injection'] ELSE [] END,
    CASE WHEN list_has_any(frameworks, ['flask', 'django', 'fastapi', 'express', 'next.js', 'react', 'vue']) THEN ['xss', 'auth', 'cors'] ELSE [] END,
    CASE WHEN len(clouds) > 0 OR list_has_any(databases, ['supabase', 'firebase']) THEN ['cloud'] ELSE [] END,
    CASE WHEN list_contains(frameworks, 'django') THEN ['crypto'] ELSE [] END, CASE WHEN len(tools) > 0 THEN ['data'] ELSE [] END) AS c FROM profile)
SELECT project, CAST(to_json({{'project_type': project_type, 'frameworks': frameworks, 'languages': languages, 'databases': databases, 'cloud_services': clouds,
  'ai_tool_indicators': tools, 'recommended_checks': list_filter(c, lambda x, i: list_position(c, x) = i)}}) AS VARCHAR) AS text FROM parts""")
def profile_document(spark, sf_dir):
    return doc.profile_json(_profiles(spark, sf_dir))


_REPORT_SQL = f"""WITH {_ALL_FOUND},
counts AS (SELECT project, count(*) AS total, {_COUNTS_SQL} FROM found GROUP BY project),
{_PROFILE_SQL.replace('files AS (', 'pfiles AS (', 1).replace('FROM files', 'FROM pfiles')}
SELECT project, 1 AS section, 0 AS ord, CASE WHEN critical > 0 THEN 'Deployment blocked, critical findings: ' || critical WHEN high > 0 THEN 'Action required, high findings: ' || high
  WHEN medium > 0 THEN 'Review needed, medium findings: ' || medium ELSE 'Passed, no critical or high findings' END AS text FROM counts
UNION ALL SELECT project, 2, 0, 'Grade: ' || CASE WHEN critical > 0 THEN 'F' WHEN high > 0 THEN 'D' WHEN medium > 0 THEN 'C' ELSE 'A' END FROM counts
UNION ALL SELECT project, 2, 1, 'Critical: ' || critical FROM counts UNION ALL SELECT project, 2, 2, 'High: ' || high FROM counts
UNION ALL SELECT project, 2, 3, 'Medium: ' || medium FROM counts UNION ALL SELECT project, 2, 4, 'Low: ' || low FROM counts
UNION ALL SELECT project, 2, 5, 'Dependencies: 0' FROM counts
UNION ALL SELECT project, 3, 0, 'Type: ' || project_type FROM profile
UNION ALL SELECT project, 3, 1, 'Languages: ' || CASE WHEN len(languages) = 0 THEN 'Unknown' ELSE array_to_string(languages, ', ') END FROM profile
UNION ALL SELECT project, 3, 2, 'Frameworks: ' || CASE WHEN len(frameworks) = 0 THEN 'None' ELSE array_to_string(frameworks, ', ') END FROM profile
UNION ALL SELECT project, 3, 3, 'Databases: ' || CASE WHEN len(databases) = 0 THEN 'None' ELSE array_to_string(databases, ', ') END FROM profile
UNION ALL SELECT project, 3, 4, 'Cloud: ' || CASE WHEN len(clouds) = 0 THEN 'None' ELSE array_to_string(clouds, ', ') END FROM profile
UNION ALL SELECT project, 3, 5, 'Assistants: ' || array_to_string(tools, ', ') FROM profile WHERE len(tools) > 0
UNION ALL SELECT project, 4, CAST(4 - severity_rank AS INT), '[' || rule_id || '] ' || severity || ' ' || description || ' | ' || file_path || ':' || line_number || ' | ' || cwe_id || ' ' || owasp
  || ' | ' || {_MASKED_SQL} || ' | ' || remediation FROM found
UNION ALL SELECT project, 7, 0, '1: fix every critical finding before deployment' FROM counts WHERE critical > 0
UNION ALL SELECT project, 7, 1, '2: schedule the high findings next' FROM counts WHERE high > 0"""


@query("report_sections", _REPORT_SQL)
def report_sections(spark, sf_dir):
    files = co.corpus_files(spark, sf_dir)
    found = durable(detect(files))
    none = audit_dependencies(files)
    sections = rp.report_sections(found, ro.project_summary(found, files), none, _profiles(spark, sf_dir))
    return sections.select("project", "section", "ord", "text")


# Manifests and another scanner's reports of the same projects, by their numbers.
_DEPENDENCY_CTES = _dependency_sql().removeprefix("WITH ").split(",\nplaced AS")[0]
_COMPLETE_SQL = _REPORT_SQL.replace("WITH ", f"WITH {_DEPENDENCY_CTES},\n", 1).replace(
    "UNION ALL SELECT project, 2, 5, 'Dependencies: 0' FROM counts",
    f"""UNION ALL SELECT c.project, 2, 5, 'Dependencies: ' || count(e.project) FROM counts c LEFT JOIN (SELECT 'p' || (CAST(substr(project, 2) AS INT) % {co.PROJECTS}) AS project FROM every) e USING (project) GROUP BY 1
UNION ALL SELECT 'p' || (CAST(substr(project, 2) AS INT) % {co.PROJECTS}), 5, 0, '[' || severity || '] ' || package || ' (' || issue_type || ') ' || coalesce(version, 'Unknown') || ' | ' || description || ' | ' || file_path || ' | ' || remediation FROM every
UNION ALL SELECT 'p' || (s_suppkey % {co.PROJECTS}), 6, 0, '[ERROR] r.' || s_suppkey || ' | CWE-1, CWE-2 A1 | f' || s_suppkey || '.py:' || s_suppkey || ' | m' FROM supplier
UNION ALL SELECT 'p' || (s_suppkey % {co.PROJECTS}), 6, 0, '[WARNING]  |   | :0 | ' FROM supplier""")


@query("report_complete", _COMPLETE_SQL)
def report_complete(spark, sf_dir):
    """All seven sections: code, profile, dependencies and another scanner's findings of the same projects."""
    files = co.corpus_files(spark, sf_dir)
    found = durable(detect(files))
    named = lambda key: F.concat(F.lit("p"), (key % co.PROJECTS).cast("string"))
    manifests = co.manifests(spark, sf_dir).withColumn("project", named(F.substring("project", 2, 9).cast("int")))
    dependencies = durable(audit_dependencies(manifests, co.advisory_rows(spark)))
    k = F.col("s_suppkey").cast("string")
    payload = F.concat(
        F.lit('{"results":[{"check_id":"r.'), k, F.lit('","path":"f'), k, F.lit('.py","start":{"line":'), k,
        F.lit('},"extra":{"severity":"error","message":"m","metadata":{"cwe":["CWE-1","CWE-2"],"owasp":"A1"}}},{}]}'),
    )
    external = adv.ingest_semgrep(co.read(spark, sf_dir, "supplier").select(named(F.col("s_suppkey")).alias("project"), payload.alias("payload")))
    sections = rp.report_sections(found, ro.project_summary(found, files), dependencies, _profiles(spark, sf_dir), external)
    return sections.select("project", "section", "ord", "text")


@query("report_findings", f"""WITH {_NEXT_FOUND}
SELECT {CORE_SQL} FROM found f WHERE severity_rank >= 3 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.project = f.project AND k.fingerprint = f.fingerprint)""")
def reported(spark, sf_dir):
    known = bl.baseline_snapshot(detect(co.corpus_next(spark, sf_dir)))
    kept, _ = report_findings(all_findings(spark, sf_dir), "high", known)
    return kept.select(*CORE)


# --- settings that differ by project ------------------------------------------------------------

# p0 selects checks, p1 drops a rule and paths, p2 raises the threshold and adds a pattern; the others' files are empty.
_SETTINGS = {
    0: '{"checks":["xss","crypto"]}',
    1: '{"exclude_rules":"SEC-012","exclude_paths":["de/","*.yaml"]}',
    2: '{"severity_threshold":"critical","custom_patterns":[{"pattern":"plain\\\\s+line","rule_id":"PLAIN-1","severity":"critical"}]}',
}


@query("scan_by_project", f"""WITH {_ALL_FOUND}, plain AS (
  SELECT project, path, unnest(string_split(content, chr(10))) AS raw, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM corpus_files WHERE project = 'p2')
SELECT project, file_path, rule_id, line_number, match_count FROM found
WHERE CASE project WHEN 'p0' THEN category IN ('Injection (xss)', 'Cryptography') WHEN 'p1' THEN rule_id <> 'SEC-012' AND NOT starts_with(file_path, 'de/') AND NOT file_path LIKE '%.yaml'
  WHEN 'p2' THEN severity = 'CRITICAL' ELSE true END
UNION ALL SELECT project, path, 'PLAIN-1', CAST(min(line) AS INT), CAST(count(*) AS BIGINT) FROM plain WHERE raw = 'plain line' GROUP BY project, path""")
def by_project(spark, sf_dir):
    files = co.corpus_files(spark, sf_dir).select("project", "path", "content")
    content = F.lit("{}")
    for number, text in _SETTINGS.items():
        content = F.when(F.col("project") == f"p{number}", text).otherwise(content)
    rows = files.select("project").distinct().select("project", F.lit(st.CONFIG_NAME).alias("path"), content.alias("content"))
    found = scan_by_project(files, st.read_config(files.unionByName(rows)))
    return found.select("project", "file_path", "rule_id", "line_number", "match_count")


@query("gate_by_project", f"""WITH {_GRADED_SQL}, named AS (
  SELECT project, severity_rank FROM found WHERE project <> 'g5'),
counts AS (SELECT project, count(*) AS findings, max(severity_rank) AS worst FROM named GROUP BY project)
SELECT project, coalesce(findings, 0) AS findings, coalesce(CASE CAST(substr(project, 2) AS INT) % 4 WHEN 0 THEN false WHEN 1 THEN worst >= 1 WHEN 2 THEN worst >= 3 ELSE worst >= 4 END, false) AS failed
FROM (SELECT DISTINCT project FROM graded) LEFT JOIN counts USING (project)""")
def gates(spark, sf_dir):
    """Each project by its own settings; one names a baseline file that holds all its findings."""
    files = _graded(spark, sf_dir)
    i = F.substring("project", 2, 9).cast("int")
    fail_on = F.when(i % 4 == 0, "none").when(i % 4 == 1, "low").when(i % 4 == 2, "High")
    settings = F.to_json(F.struct(fail_on.alias("fail_on"), F.when(i == 5, "ci/known.json").alias("baseline")))
    rows = files.select("project").distinct().select("project", F.lit(st.CONFIG_NAME).alias("path"), settings.alias("content"))
    known = detect(files.filter("project = 'g5'")).groupBy("project").agg(F.collect_set("fingerprint").alias("fingerprints"))
    baseline = known.select("project", F.lit("ci/known.json").alias("path"), F.to_json(F.struct("fingerprints")).alias("content"))
    return gate_by_project(files.unionByName(baseline), st.read_config(rows))


# --- streams ------------------------------------------------------------------------------------


# The time of documents without an event.
_NO_EVENT = "2024-01-01 00:00:00"


def _versions(spark: SparkSession, sf_dir: str, d: DataFrame) -> DataFrame:
    """Documents, of a table or a stream, as file versions at the time of the event of the same number."""
    times = co.read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    i = F.col("doc_id")
    files = d.select(
        "doc_id", F.concat(F.lit("p"), (i % co.PROJECTS).cast("string")).alias("project"), co.log_path().alias("path"),
        F.concat(F.col("text"), F.lit("\n"), co._pick(co.BLOCKS, i)).alias("content"),
    )
    return files.join(times, "doc_id", "left").withColumn("ts", F.coalesce("ts", F.lit(_NO_EVENT).cast("timestamp")))


def _file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # a stream takes no path of a single file; a pattern finds the table as a file and as a folder
    return _versions(spark, sf_dir, spark.readStream.schema(layout).parquet(f"{sf_dir}/documents.parque[t]"))


# Versions arrive in three parts, by time; every fiftieth comes with the last part, however old it is.
_ARRIVALS = 3
_LATE = "doc_id % 50 = 7"


def _arriving(spark: SparkSession, sf_dir: str, late: bool, build) -> DataFrame:
    """What a stream gives that starts anew, from its checkpoint, after each part has arrived."""
    import uuid

    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    versions = durable(_versions(spark, sf_dir, co.read(spark, sf_dir, "documents")))
    ends = versions.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    part = F.least(F.floor((F.unix_micros("ts") - ends["a"]) * _ARRIVALS / F.greatest(F.lit(ends["b"] - ends["a"]), F.lit(1))), F.lit(_ARRIVALS - 1))
    if late:
        part = F.when(F.expr(_LATE), _ARRIVALS - 1).otherwise(part)
    for number in range(_ARRIVALS):
        versions.where(part == number).write.mode("append").parquet(f"{folder}/in/part{number}")
        stream = build(spark.readStream.schema(versions.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in"))
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        writer.format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what has arrived, into a table in the checkpoint folder, and read it."""
    import uuid

    spark = stream.sparkSession
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        running = writer.format("parquet").start(out)
    else:
        running = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_STREAM_FOUND = f"""{co.CORPUS_SQL},
versions AS (SELECT doc_id, project, 'src/f' || CAST(doc_id % {co.LOG_FILES} AS VARCHAR) || raw_ext AS path, raw_ext, content,
  coalesce(CAST(e.ts AS TIMESTAMP), TIMESTAMP '{_NO_EVENT}') AS ts FROM corpus_files c LEFT JOIN events e ON e.event_id = c.doc_id),
batch AS (SELECT * REPLACE (path || '@' || epoch_us(ts) AS path) FROM versions),
{findings_ctes(entropy=True, files='batch')},
arrived AS (SELECT f.* EXCLUDE (file_path, fingerprint), split_part(file_path, '@', 1) AS file_path,
  left(sha1(rule_id || ':' || split_part(file_path, '@', 1) || ':' || trim(code_snippet)), 16) AS fingerprint,
  make_timestamp(CAST(split_part(file_path, '@', 2) AS BIGINT)) AS ts FROM found f)"""


@query("stream_scan", f"WITH {_STREAM_FOUND}\nSELECT project, file_path, rule_id, line_number, fingerprint, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS arrived_at FROM arrived")
def streamed(spark, sf_dir):
    found = stream_scan(_file_stream(spark, sf_dir))
    return _run(found, "append").select(
        "project", "file_path", "rule_id", "line_number", "fingerprint", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("arrived_at")
    )


@query("stream_new_findings", f"""WITH {_STREAM_FOUND}
SELECT DISTINCT project, fingerprint, rule_id, file_path FROM arrived
WHERE (project, fingerprint) NOT IN (SELECT (project, fingerprint) FROM arrived WHERE rule_id = 'SEC-001')""")
def streamed_new(spark, sf_dir):
    batch = co.file_versions(spark, sf_dir).select("project", "path", "content")
    known = bl.baseline_snapshot(detect(batch)).filter(F.col("rule_id") == "SEC-001")
    found = stream_new_findings(stream_scan(_file_stream(spark, sf_dir)), known)
    return _run(found, "append").select("project", "fingerprint", "rule_id", "file_path")


@query("stream_severity_windows", f"""WITH {_STREAM_FOUND}
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, severity, count(*) AS findings FROM arrived GROUP BY ALL""")
def streamed_windows(spark, sf_dir):
    counted = stream_severity_windows(stream_scan(_file_stream(spark, sf_dir)))
    return _run(counted, "complete").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "severity", "findings")


# Windows over late rows: a part's rows are dropped whose window was over, an hour before the newest time seen, when the part came.
@query("stream_closed_windows", f"""WITH {_STREAM_FOUND},
ends AS (SELECT min(ts) AS a, max(ts) AS b FROM versions),
parts AS (SELECT project, path, ts, bool_or({_LATE}) AS late FROM versions GROUP BY ALL),
placed AS (SELECT f.severity, f.ts, time_bucket(INTERVAL 1 HOUR, f.ts) AS window_start,
  CASE WHEN late THEN {_ARRIVALS - 1} ELSE least((epoch_us(f.ts) - epoch_us(a)) * {_ARRIVALS} // greatest(epoch_us(b) - epoch_us(a), 1), {_ARRIVALS - 1}) END AS part
  FROM arrived f JOIN parts p ON p.project = f.project AND p.path = f.file_path AND p.ts = f.ts, ends),
marks AS (SELECT part, date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS mark FROM placed GROUP BY part),
kept AS (SELECT *, window_start + INTERVAL 1 HOUR AS window_end FROM placed p
  WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.part < p.part AND p.window_start + INTERVAL 1 HOUR <= m.mark))
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, severity, count(*) AS findings FROM kept
WHERE window_end <= (SELECT max(mark) FROM marks) GROUP BY ALL""")
def streamed_closed_windows(spark, sf_dir):
    """In append mode: late rows are left out, and windows come out when they are over."""
    counted = _arriving(spark, sf_dir, True, lambda files: stream_severity_windows(stream_scan(files)))
    return counted.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "severity", "findings")


@query("finding_life", f"""WITH {_STREAM_FOUND},
v AS (SELECT project, path, ts, row_number() OVER (PARTITION BY project, path ORDER BY ts) AS seq FROM (SELECT DISTINCT project, path, ts FROM versions)),
f AS (SELECT DISTINCT a.project, a.file_path, a.fingerprint, a.rule_id, v.ts, v.seq FROM arrived a JOIN v ON v.project = a.project AND v.path = a.file_path AND v.ts = a.ts),
n AS (SELECT *, lag(seq) OVER w AS before, lead(seq) OVER w AS after FROM f WINDOW w AS (PARTITION BY project, file_path, fingerprint ORDER BY seq)),
lives AS (SELECT project, file_path, ts, fingerprint, rule_id, CASE WHEN before IS NULL THEN 'new' WHEN before = seq - 1 THEN 'open' ELSE 'reopened' END AS life FROM n
  UNION ALL SELECT n.project, file_path, v.ts, fingerprint, rule_id, 'fixed' FROM n JOIN v ON v.project = n.project AND v.path = n.file_path AND v.seq = n.seq + 1
  WHERE after IS NULL OR after > n.seq + 1)
SELECT project, file_path, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, fingerprint, rule_id, life FROM lives""")
def streamed_life(spark, sf_dir):
    lives = _arriving(spark, sf_dir, False, lambda files: finding_life(files, forget="36500 days"))
    return lives.select("project", "file_path", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "fingerprint", "rule_id", "life")


# --- source trees ---------------------------------------------------------------------------------


def _written(files: DataFrame, root: str) -> int:
    """Write (project, path, content) as files below a mounted folder; each appears whole."""

    def work(batches):
        import os

        import pandas as pd

        for batch in batches:
            for project, path, content in batch.itertuples(index=False):
                target = os.path.join(root, project, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                hidden = os.path.join(root, f".{project}-{abs(hash(path))}.tmp")
                with open(hidden, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
                os.rename(hidden, target)
            yield pd.DataFrame({"files": [len(batch)]})

    return files.select("project", "path", "content").mapInPandas(work, "files long").agg(F.sum("files")).first()[0]


def _mounted(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}".removeprefix("file:")


@query("read_tree", f"""WITH {co.TREE_SQL}
SELECT project, path, sha1(content) AS digest FROM corpus_tree
WHERE project IN ('p0', 'p1', 'p2', 'p5') AND starts_with(path, 'src/') AND regexp_matches(name, '^.+\\.(py|yml|jsx)$', 'i') AND NOT starts_with(dir, 'vendor')""")
def tree_read(spark, sf_dir):
    root = _mounted(spark, "tree")
    _written(co.corpus_tree(spark, sf_dir), root)
    files = read_tree(spark, root, skip=("vendor",), where="project in ('p0', 'p1', 'p2', 'p5') and path like 'src/%' and ext in ('.py', '.yml', '.jsx')")
    return files.select("project", "path", F.sha1("content").alias("digest"))


@query("stream_tree", f"""WITH {co.TREE_SQL},
waves AS (SELECT project, path, content FROM corpus_tree WHERE NOT starts_with(path, 'docs/')
  UNION ALL SELECT project, path, content || chr(10) || 'changed' FROM corpus_tree WHERE starts_with(path, 'src/') OR starts_with(path, 'docs/'))
SELECT project, path, sha1(content) AS digest, count(*) AS times FROM waves GROUP BY ALL""")
def tree_streamed(spark, sf_dir):
    """Files arrive in two waves, the second with changed files; the stream starts anew for it, and once more for nothing."""
    root, own = _mounted(spark, "tree"), _mounted(spark, "tree-stream")
    tree = co.corpus_tree(spark, sf_dir)
    changed = F.concat("content", F.lit("\nchanged"))
    for files in (tree.where("not startswith(path, 'docs/')"), tree.where("startswith(path, 'src/') or startswith(path, 'docs/')").withColumn("content", changed), tree.limit(0)):
        _written(files, root)
        stream = stream_tree(spark, root, f"{own}/marks").select("project", "path", F.sha1("content").alias("digest"))
        stream.writeStream.option("checkpointLocation", f"{own}/state").trigger(availableNow=True).format("parquet").start(f"{own}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{own}/out").groupBy("project", "path", "digest").agg(F.count("*").alias("times"))


# --- thousands of patterns ------------------------------------------------------------------------

# Each document ends in two lines with marks of parts; each project has a pattern for each of its parts.
_MARK_SQL = """marked_files AS (
  SELECT doc_id, project, path, content || chr(10) || 'use(tok-' || k1 || '-x1)' || chr(10) || 'TOK-' || k2 || '-y2 tok-' || k2 || '-z3' AS content
  FROM (SELECT *, doc_id * 7 % (SELECT count(*) FROM part) + 1 AS k1, doc_id * 13 % (SELECT count(*) FROM part) + 1 AS k2 FROM corpus_files)),
mark_lines AS (SELECT doc_id, project, path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS nth FROM marked_files)"""


def _marked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = co.read(spark, sf_dir, "part").count()
    i = F.col("doc_id")
    k1, k2 = ((i * n % parts + 1).cast("string") for n in (7, 13))
    lines = F.concat(F.lit("\nuse(tok-"), k1, F.lit("-x1)\nTOK-"), k2, F.lit("-y2 tok-"), k2, F.lit("-z3"))
    return co.corpus_files(spark, sf_dir).withColumn("content", F.concat("content", lines))


@query("many_patterns", f"""WITH {co.CORPUS_SQL}, {_MARK_SQL},
hits AS (SELECT project, path, nth, unnest(regexp_extract_all(line, '(?i)tok-([0-9]+)-[a-z][0-9]', 1)) AS k FROM mark_lines)
SELECT project, path AS file_path, 'TOK-' || k AS rule_id, CAST(min(nth) AS INT) AS line_number, count(*) AS match_count
FROM hits JOIN part ON p_partkey = CAST(k AS BIGINT) AND 'p' || (p_partkey % {co.PROJECTS}) = project GROUP BY ALL""")
def many_patterns(spark, sf_dir):
    """A pattern for every part, in three forms, each for one project."""
    k = F.col("p_partkey")
    key = k.cast("string")
    pattern = F.when(k % 3 == 0, F.concat(F.lit("tok-"), key, F.lit("-[a-z]\\d"))).when(
        k % 3 == 1, F.concat(F.lit("(?:tok|key)-"), key, F.lit("-[a-z]\\d"))).otherwise(F.concat(F.lit("\\btok-"), key, F.lit("-(?P<x>[a-z])\\d")))
    fields = {"pattern": pattern, "rule_id": F.concat(F.lit("TOK-"), key)} | {c: F.lit(None).cast("string") for c in ("severity", "description", "remediation")}
    one = F.struct(*[v.alias(c) for c, v in fields.items()])
    patterns = co.read(spark, sf_dir, "part").groupBy(F.concat(F.lit("p"), (k % co.PROJECTS).cast("string")).alias("project")).agg(F.collect_list(one).alias("custom_patterns"))
    found = detect_project_patterns(_marked_files(spark, sf_dir), patterns)
    return found.select("project", "file_path", "rule_id", "line_number", "match_count")


@query("python_patterns", f"""WITH {co.CORPUS_SQL}, {_MARK_SQL},
hits AS (SELECT project, path, nth, 'ODD-1' AS rule_id, len(regexp_extract_all(line, '(?i)tok-[0-9]+-y[0-9]|none[0-9]')) AS n FROM mark_lines
  UNION ALL SELECT project, path, nth, 'ODD-2', len(regexp_extract_all(line, '(?i)use\\(tok-[0-9]*7-')) FROM mark_lines)
SELECT project, path AS file_path, rule_id, CAST(min(nth) AS INT) AS line_number, CAST(sum(n) AS BIGINT) AS match_count FROM hits WHERE n > 0 GROUP BY ALL""")
def python_patterns(spark, sf_dir):
    """Patterns that the JVM refuses: a condition on a group, and a place that is left and taken again."""
    odd = ({"pattern": r"(?P<t>tok-)?(?(t)\d+-y|none)\d", "rule_id": "ODD-1"}, {"pattern": r"(?P<u>use)?(?(u)\(tok-\d*7-|\Z\Bx)", "rule_id": "ODD-2"})
    found = detect(_marked_files(spark, sf_dir), ScanConfig(checks=("secrets",), custom_patterns=odd))
    return found.where(F.col("rule_id").startswith("ODD")).select("project", "file_path", "rule_id", "line_number", "match_count")


# --- files read and read back ---------------------------------------------------------------------


def _log_files(log: DataFrame, folder: str) -> int:
    """Write (repo, seq, line) as a log file for each repository, a batch of lines at a time; each appears whole."""

    def write(batches):
        import os
        import uuid
        from contextlib import ExitStack

        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        written = {}
        with ExitStack() as files:
            for batch in batches:
                for repo, lines in batch.groupby("repo", sort=False, dropna=False)["line"]:
                    if repo not in written:  # the rows of a repository follow one another
                        files.close()
                        hidden = os.path.join(folder, f".{repo}-{uuid.uuid4().hex}.tmp")
                        written[repo] = hidden, files.enter_context(open(hidden, "w", encoding="utf-8", newline=""))
                    written[repo][1].writelines(f"{x}\n" for x in lines)
        for repo, (hidden, _) in written.items():
            os.rename(hidden, os.path.join(folder, f"{repo}.log"))
        if written:
            yield pd.DataFrame({"repo": [str(r) for r in written]})

    ordered = log.select("repo", "seq", "line").repartition("repo").sortWithinPartitions("repo", "seq").select("repo", "line")
    return ordered.mapInPandas(write, "repo string").count()


@query("audit_history", f"""WITH {_HISTORY_SQL}
SELECT repo, fingerprint, rule_id, path AS file_path, sha1(CAST(doc_id AS VARCHAR)) AS commit_hash, lang AS commit_author,
  CASE WHEN still_present THEN 'still present' ELSE 'removed' END AS status FROM marked""")
def history_audit(spark, sf_dir):
    """Log files, read in parallel, to findings that must be fixed or rotated."""
    folder = _mounted(spark, "logs")
    _log_files(co.commit_log(spark, sf_dir), folder)
    found = hi.classify_changes(audit_history(read_logs(spark, f"file://{folder}"), co.head_files(spark, sf_dir)))
    return found.select("repo", "fingerprint", "rule_id", "file_path", "commit_hash", "commit_author", "status")


@query("baseline_read_back", f"""WITH {_NEXT_FOUND}
SELECT {CORE_SQL} FROM found f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.project = f.project AND k.fingerprint = f.fingerprint)""")
def baseline_read_back(spark, sf_dir):
    """A corpus of bytes and a baseline, both written as tables and read by the library."""
    folder = _mounted(spark, "tables")
    raw = co.corpus_files(spark, sf_dir).withColumn("content", F.encode("content", "utf-8"))
    raw.write.parquet(f"file://{folder}/corpus")
    doc.write_baseline(detect(co.corpus_next(spark, sf_dir)), f"file://{folder}/baseline")
    found = detect(read_corpus(spark, f"file://{folder}/corpus"))
    return bl.apply_baseline(found, st.load_baseline(spark, f"file://{folder}/baseline")).select(*CORE)


@query("problem_lines_read_back", f"""WITH {_ALL_FOUND}
SELECT project, file_path || ':' || CAST(line_number AS VARCHAR) || ': ' || {_LEVEL_SQL} || ': [' || rule_id || '] ' || description AS text FROM found""")
def problem_lines_read_back(spark, sf_dir):
    folder = _mounted(spark, "documents")
    doc.write_documents(doc.problem_lines(all_findings(spark, sf_dir)), f"file://{folder}")
    return spark.read.text(f"file://{folder}").select("project", F.col("value").alias("text"))
