"""Registered queries: each a Spark job over the given tables, most with SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.catalog.packages import HALLUCINATED, TYPOSQUATS
from auditlake.catalog.rules import ENTROPY_RULE, FAMILIES, RULES, select_rules
from auditlake.config import ScanConfig
from auditlake.functions import scoring as sc
from auditlake.functions import text as tx
from auditlake.operators import baseline as bl
from auditlake.operators import dependencies as dep
from auditlake.operators import history as hi
from auditlake.operators import profile as pf
from auditlake.operators import rollup as ro
from auditlake.operators.advisory_ranges import match_advisory_intervals
from auditlake.operators.detect import applies, detect, detect_entropy, detect_family, detect_rules, with_ext
from auditlake.operators.findings import (
    enrich_confidence,
    enrich_cwe,
    enrich_fix_hint,
    min_severity,
    order_by_emission,
    order_by_severity,
    rule_catalog,
    with_place,
)
from auditlake.operators.renames import traced_changes
from auditlake.operators.select import (
    SCANNABLE_EXTENSIONS,
    SKIP_DIRS,
    changed_files,
    exclude_paths,
    filter_scannable,
    prune_dirs,
    restrict_to_changed,
)
from auditlake.operators.untracked import detect_untracked_env
from auditlake.plans.audit import audit_dependencies, scan, summarize
from auditlake.sources import advisories as adv
from auditlake.sources import commit_log as cl
from auditlake.sources import manifests as mf
from auditlake.sources import settings as st
from workload import corpus as co
from workload.corpus import quote, sql_list
from workload.oracle import findings_ctes, suppressed

Build = Callable[[SparkSession, str], DataFrame]
BUILDS: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Build) -> Build:
        BUILDS[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


# --- files ------------------------------------------------------------------------------------

_SKIP_SQL = "(^|/)(" + "|".join(d.replace(".", "\\.") for d in SKIP_DIRS) + ")/"


@query("corpus_scannable", f"""WITH {co.TREE_SQL}
SELECT project, path, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext FROM corpus_tree
WHERE NOT regexp_matches(path, {quote(_SKIP_SQL)})
  AND (list_contains({sql_list(SCANNABLE_EXTENSIONS)}, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1))) OR starts_with(name, '.env'))""")
def corpus_scannable(spark, sf_dir):
    kept = filter_scannable(prune_dirs(co.corpus_tree(spark, sf_dir)))
    return kept.select("project", "path", tx.file_ext(F.col("path")).alias("ext"))


@query("exclude_paths", f"""WITH {co.TREE_SQL}
SELECT project, path FROM corpus_tree
WHERE NOT starts_with(path, 'src') AND NOT regexp_matches(path, '(^|/)[^/]*\\.md$')
  AND NOT regexp_matches(path, '(^|/)d[0-4][^/]*/conf\\.y[^/]l$') AND NOT starts_with(path, 'tests/d1')""")
def excluded(spark, sf_dir):
    return exclude_paths(
        co.corpus_tree(spark, sf_dir), ["src/", "*.md", "d[0-4]*/conf.y?l", "tests/d1"]
    ).select("project", "path")


@query("normalize_text", """SELECT doc_id, sha1(replace(text, chr(10), chr(10) || chr(10) || 'x' || chr(10))) AS digest,
  CAST(length(replace(text, chr(10), chr(10) || chr(10) || 'x' || chr(10))) AS INT) AS chars FROM documents""")
def normalize_text(spark, sf_dir):
    """Bytes with mixed line ends and bad bytes, decoded and normalised."""
    d = co.read(spark, sf_dir, "documents")
    # each line end becomes CRLF, a bad byte, a lone CR, an x and LF
    noisy = F.replace("text", F.lit("\n"), F.lit("\r\n\u0007\rx\n")).cast("binary")
    raw = F.unhex(F.replace(F.hex(noisy), F.lit("0D0A070D780A"), F.lit("0D0AFF0D780A")))
    text = tx.decode_text(raw)
    return d.select("doc_id", F.sha1(text.cast("binary")).alias("digest"), F.char_length(text).alias("chars"))


@query("changed_files", f"""WITH {co.CORPUS_SQL},
{co.NEXT_SQL}
SELECT n.project, n.path, CASE WHEN c.path IS NULL THEN 'added' ELSE 'modified' END AS change
FROM corpus_files c RIGHT JOIN corpus_next n USING (project, path)
WHERE c.content IS NULL OR c.content <> n.content""")
def changed(spark, sf_dir):
    return changed_files(co.corpus_files(spark, sf_dir), co.corpus_next(spark, sf_dir))


@query("traced_changes", f"""WITH {co.CORPUS_SQL},
{co.MOVED_SQL},
states AS (SELECT project, path, c.content AS old, n.content AS new, c.content IS NOT NULL AS in_old, n.content IS NOT NULL AS in_new
  FROM (SELECT project, path, content FROM corpus_files) c
  FULL JOIN (SELECT project, path, content FROM corpus_moved) n USING (project, path)),
sources AS (SELECT project, path AS old_path, old AS content, NOT in_new AS gone FROM states WHERE in_old AND old <> ''),
news AS (SELECT project, path, new AS content FROM states WHERE in_new AND NOT in_old),
turns AS (SELECT *, row_number() OVER (PARTITION BY project, content ORDER BY path) AS turn FROM news WHERE content <> ''),
lost AS (SELECT *, row_number() OVER (PARTITION BY project, content ORDER BY old_path) AS turn FROM sources WHERE gone),
told AS (SELECT t.project, t.path, t.content, l.old_path, a.any_path FROM turns t LEFT JOIN lost l USING (project, content, turn)
  LEFT JOIN (SELECT project, content, min(old_path) AS any_path FROM sources GROUP BY ALL) a USING (project, content)),
free AS (SELECT l.project, l.old_path FROM lost l ANTI JOIN turns t USING (project, content, turn)),
olds AS (SELECT s.project, s.content, min(s.old_path) AS path, min(f.old_path) AS free_path FROM sources s LEFT JOIN free f USING (project, old_path) GROUP BY ALL),
left_over AS (SELECT project, path, content FROM told WHERE any_path IS NULL),
sides AS (SELECT 'new' AS side, project, content, sha1(content) AS id FROM (SELECT DISTINCT project, content FROM left_over)
  UNION ALL SELECT 'old', project, content, sha1(content) FROM olds),
lines AS (SELECT side, project, id, line, count(*) AS c FROM (SELECT side, project, id, unnest(string_split(content, chr(10))) AS line FROM sides) GROUP BY ALL),
sizes AS (SELECT side, project, id, sum(c) AS n FROM lines GROUP BY ALL),
shared AS (SELECT a.project, a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS shared FROM lines a JOIN lines b ON a.side = 'new' AND b.side = 'old' AND a.project = b.project AND a.line = b.line GROUP BY ALL),
alike AS (SELECT s.project, a, b, shared / greatest(x.n, y.n) AS likeness FROM shared s JOIN sizes x ON x.side = 'new' AND x.project = s.project AND x.id = a
  JOIN sizes y ON y.side = 'old' AND y.project = s.project AND y.id = b WHERE 100 * shared >= 50 * greatest(x.n, y.n)),
best AS (SELECT l.project, l.path, k.likeness, o.free_path IS NOT NULL AS from_gone, coalesce(o.free_path, o.path) AS old_path
  FROM left_over l LEFT JOIN alike k ON k.project = l.project AND k.a = sha1(l.content) LEFT JOIN olds o ON o.project = k.project AND sha1(o.content) = k.b
  QUALIFY row_number() OVER (PARTITION BY l.project, l.path ORDER BY k.likeness DESC NULLS LAST, o.free_path IS NULL, coalesce(o.free_path, o.path)) = 1)
SELECT project, path, 'modified' AS change, NULL AS old_path, NULL AS likeness FROM states WHERE in_old AND in_new AND old <> new
UNION ALL SELECT project, path, 'added', NULL, NULL FROM news WHERE content = ''
UNION ALL SELECT project, path, CASE WHEN old_path IS NOT NULL THEN 'renamed' ELSE 'copied' END, coalesce(old_path, any_path), 1.0 FROM told WHERE any_path IS NOT NULL
UNION ALL SELECT project, path, CASE WHEN old_path IS NULL THEN 'added'
  WHEN from_gone AND row_number() OVER (PARTITION BY project, old_path, from_gone ORDER BY likeness DESC, path) = 1 THEN 'renamed' ELSE 'copied' END, old_path, likeness FROM best""")
def traced(spark, sf_dir):
    return traced_changes(co.corpus_files(spark, sf_dir), co.corpus_moved(spark, sf_dir))


@query("scan_changed", f"""WITH {co.CORPUS_SQL},
{co.NEXT_SQL},
changed AS (SELECT n.* FROM corpus_next n JOIN corpus_files c USING (project, path) WHERE c.content <> n.content),
{findings_ctes(entropy=True, files='changed')}
SELECT project, file_path, rule_id, line_number, match_count, fingerprint FROM found""")
def scan_changed(spark, sf_dir):
    later = co.corpus_next(spark, sf_dir)
    chosen = restrict_to_changed(later, changed_files(co.corpus_files(spark, sf_dir), later))
    return detect(chosen).select("project", "file_path", "rule_id", "line_number", "match_count", "fingerprint")


_APPLY_SQL = " + ".join(
    f"CAST(list_contains({sql_list(r.extensions)}, raw_ext) AS INT)" if r.extensions else "1" for r in RULES
)


@query("ext_gate", f"WITH {co.CORPUS_SQL} SELECT project, path, {_APPLY_SQL} AS rules FROM corpus_files")
def ext_gate(spark, sf_dir):
    """Number of rules that apply to each file by its type."""
    files = with_ext(co.corpus_files(spark, sf_dir))
    return files.select("project", "path", F.expr(" + ".join(f"int({applies(r)})" for r in RULES)).alias("rules"))


# --- detection --------------------------------------------------------------------------------

CORE = ["project", "file_path", "rule_id", "severity", "category", "description", "line_number", "match_count",
        "code_snippet", "fingerprint"]
CORE_SQL = ", ".join(CORE)


def _family_query(name: str) -> None:
    rules = tuple(r for r in RULES if r.family == name)

    @query(f"detect_{name}", f"WITH {co.CORPUS_SQL},\n{findings_ctes(rules)}\nSELECT {CORE_SQL} FROM found")
    def build(spark, sf_dir):
        return detect_family(co.corpus_files(spark, sf_dir), name).select(*CORE)


for _family in FAMILIES:
    _family_query(_family.name)


@query("select_checks_xss", f"WITH {co.CORPUS_SQL},\n{findings_ctes(select_rules(('xss',)))}\nSELECT {CORE_SQL} FROM found")
def select_checks_xss(spark, sf_dir):
    return detect(co.corpus_files(spark, sf_dir), ScanConfig(checks=("xss",))).select(*CORE)


@query("exclude_rules", f"""WITH {co.CORPUS_SQL},
{findings_ctes(select_rules(('auth', 'jwt'), ('AUTH-001', 'JWT-004')))}
SELECT {CORE_SQL} FROM found""")
def excluded_rules(spark, sf_dir):
    config = ScanConfig(checks=("auth", "jwt"), exclude_rules={"AUTH-001", "JWT-004"})
    return detect(co.corpus_files(spark, sf_dir), config).select(*CORE)


_ALL_FOUND = f"{co.CORPUS_SQL},\n{findings_ctes(entropy=True)}"
_NEXT_FOUND = f"{_ALL_FOUND},\n{co.NEXT_SQL},\n{findings_ctes(entropy=True, files='corpus_next', name='known')}"


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(co.corpus_files(spark, sf_dir))


@query("detect_all", f"WITH {_ALL_FOUND}\nSELECT {CORE_SQL} FROM found")
def detect_all(spark, sf_dir):
    return all_findings(spark, sf_dir).select(*CORE)


@query("first_match_count", f"""WITH {_ALL_FOUND}
SELECT rule_id, count(*) AS files, CAST(sum(match_count) AS BIGINT) AS matches, CAST(min(line_number) AS INT) AS first_line,
       CAST(max(line_number) AS INT) AS last_line FROM found GROUP BY rule_id""")
def first_match_count(spark, sf_dir):
    return all_findings(spark, sf_dir).groupBy("rule_id").agg(
        F.count("*").alias("files"), F.sum("match_count").alias("matches"), F.min("line_number").alias("first_line"),
        F.max("line_number").alias("last_line"),
    )


@query("auth_multiline", f"""WITH {co.CORPUS_SQL},
{findings_ctes(tuple(r for r in RULES if r.rule_id in ('AUTH-020', 'INJ-011')))}
SELECT {CORE_SQL} FROM found""")
def auth_multiline(spark, sf_dir):
    """Rules whose matches span lines."""
    rules = tuple(r for r in RULES if r.rule_id in ("AUTH-020", "INJ-011"))
    return detect_rules(co.corpus_files(spark, sf_dir), rules).select(*CORE)


@query("suppress_inline", f"""WITH {co.CORPUS_SQL}, lines AS (
  SELECT project, path, unnest(string_split(content, chr(10))) AS raw, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM corpus_files)
SELECT project, path, CAST(line AS INT) AS line, {suppressed('raw', "'SEC-001'")} AS sec_001, {suppressed('raw', "'JWT-005'")} AS jwt_005
FROM lines WHERE contains(raw, '{tx.DEFAULT_MARKER}')""")
def suppress_inline(spark, sf_dir):
    lines = co.corpus_files(spark, sf_dir).select(
        "project", "path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "raw")
    )
    return lines.filter(F.contains("raw", F.lit(tx.DEFAULT_MARKER))).select(
        "project", "path", (F.col("pos") + 1).alias("line"),
        tx.is_suppressed("raw", "'SEC-001'").alias("sec_001"),
        tx.is_suppressed("raw", "'JWT-005'").alias("jwt_005"),
    )


_ENT_FOUND = findings_ctes(tuple(r for r in RULES if r.rule_id == "SEC-013"), entropy=True)


@query("detect_entropy", f"WITH {co.CORPUS_SQL},\n{_ENT_FOUND}\nSELECT {CORE_SQL} FROM found WHERE rule_id = '{ENTROPY_RULE.rule_id}'")
def entropy(spark, sf_dir):
    return detect_entropy(co.corpus_files(spark, sf_dir)).select(*CORE)


@query("shannon_entropy", "SELECT doc_id, round(list_entropy(string_split(text, '')), 6) AS bits FROM documents")
def shannon(spark, sf_dir):
    return co.read(spark, sf_dir, "documents").select("doc_id", F.round(tx.shannon_entropy("text"), 6).alias("bits"))


def _env_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of seven files, most of them environment files; five projects in nine have an ignore file."""
    d = co.read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    number = F.floor(i / len(ENV_NAMES))
    project = F.concat(F.lit("p"), number.cast("string")).alias("project")
    path = F.concat(co._pick(ENV_DIRS, i + number), F.lit("f"), (i % 10).cast("string"), F.lit("/"), co._pick(ENV_NAMES, i))
    envs = d.select(project, path.alias("path"), F.col("text").alias("content"))
    ignores = d.filter((i % len(ENV_NAMES) == 0) & (number % co.PROJECTS < len(IGNORES))).select(
        project, F.lit(st.IGNORE_NAME).alias("path"), F.get(F.array(*[F.lit(x) for x in IGNORES]), (number % co.PROJECTS).cast("int")).alias("content")
    )
    return envs.unionByName(ignores)


ENV_NAMES = (".env", ".env.local", ".env.example", "main.py", ".env.prod", ".envrc", ".env.test")
ENV_DIRS = ("", "api/", "web/app/", "env/")
IGNORES = (".env\n", "# none\n*.local\n/.env\n", "web/*\n.env.[pl]*\n", "\n  api/f?/.env  \n!x\n", "f*/.env.pro?\n")
_ENV_COUNT = len(ENV_NAMES)


@query("detect_untracked_env", f"""WITH envs AS (
  SELECT doc_id // {_ENV_COUNT} AS number, ({sql_list(ENV_NAMES)})[CAST(doc_id % {_ENV_COUNT} AS INT) + 1] AS name,
         ({sql_list(ENV_DIRS)})[CAST((doc_id + doc_id // {_ENV_COUNT}) % {len(ENV_DIRS)} AS INT) + 1] || 'f' || CAST(doc_id % 10 AS VARCHAR) || '/' || name AS path FROM documents),
kept AS (SELECT *, number % {co.PROJECTS} AS p FROM envs WHERE (name = '.env' OR starts_with(name, '.env.')) AND name NOT IN ('.env.example', '.env.test'))
SELECT 'p' || CAST(number AS VARCHAR) AS project, path AS file_path, path || ' (not in the ignore file)' AS code_snippet FROM kept
WHERE NOT (CASE p WHEN 0 THEN name = '.env' WHEN 1 THEN path LIKE '%.local' OR name = '.env'
  WHEN 2 THEN path LIKE 'web/%' OR regexp_matches(name, '^\\.env\\.[pl]')
  WHEN 3 THEN regexp_matches(path, '^api/f./\\.env$') WHEN 4 THEN regexp_matches(path, '^f.*/\\.env\\.pro.$') ELSE false END)""")
def untracked_env(spark, sf_dir):
    return detect_untracked_env(_env_tree(spark, sf_dir)).select("project", "file_path", "code_snippet")


@query("read_gitignore", f"""WITH ignores AS (
  SELECT doc_id // {_ENV_COUNT} AS number, ({sql_list(IGNORES)})[CAST(number % {co.PROJECTS} AS INT) + 1] AS content FROM documents
  WHERE doc_id % {_ENV_COUNT} = 0 AND number % {co.PROJECTS} < {len(IGNORES)})
SELECT * FROM (SELECT 'p' || CAST(number AS VARCHAR) AS project, trim(unnest(string_split(content, chr(10)))) AS pattern FROM ignores)
WHERE pattern <> '' AND NOT starts_with(pattern, '#')""")
def read_gitignore(spark, sf_dir):
    return st.read_gitignore(_env_tree(spark, sf_dir))


_TOKEN = {"pattern": 'token = "[0-9a-f]{40}"', "rule_id": "TOKEN-1", "description": "Hex token", "severity": "high"}


@query("detect_custom_token", """WITH hits AS (
  SELECT doc_id, source, regexp_replace(text, '(?im)token = "[0-9a-f]{40}"', chr(1) || '\\0', 'g') AS m FROM documents
  WHERE regexp_matches(text, '(?i)token = "[0-9a-f]{40}"')),
lines AS (SELECT doc_id, source, unnest(string_split(m, chr(10))) AS x, unnest(range(1, len(string_split(m, chr(10))) + 1)) AS line, m FROM hits)
SELECT source AS project, 'd' || CAST(doc_id AS VARCHAR) || '.txt' AS file_path, 'TOKEN-1' AS rule_id, 'HIGH' AS severity,
       CAST(min(line) AS INT) AS line_number, CAST(sum(length(x) - length(replace(x, chr(1), ''))) AS BIGINT) AS match_count,
       left(trim(replace(min_by(x, line), chr(1), '')), 100) AS code_snippet
FROM lines WHERE contains(x, chr(1)) GROUP BY source, doc_id""")
def custom_token(spark, sf_dir):
    """A user's pattern over the raw documents."""
    d = co.read(spark, sf_dir, "documents")
    files = d.select(
        F.col("source").alias("project"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )
    rules = ScanConfig(custom_patterns=(_TOKEN,)).custom_rules()
    return detect_rules(files, rules).select(
        "project", "file_path", "rule_id", "severity", "line_number", "match_count", "code_snippet"
    )


_PAGES_SQL = "page_files AS (SELECT 'web' AS project, 'page' || CAST(page_id AS VARCHAR) || '.html' AS path, '.html' AS raw_ext, html AS content FROM pages)"


_INLINE = {"pattern": r"<script>.*?</script>", "rule_id": "PAGE-1", "description": "Inline script", "severity": "medium"}
_INLINE_RULES = ScanConfig(custom_patterns=(_INLINE,)).custom_rules()


@query("scan_pages", f"WITH {_PAGES_SQL},\n{findings_ctes(RULES + _INLINE_RULES, files='page_files', entropy=True)}\nSELECT {CORE_SQL} FROM found")
def scan_pages(spark, sf_dir):
    """The whole catalog and one added pattern over the raw web pages."""
    pages = co.read(spark, sf_dir, "pages").select(
        F.lit("web").alias("project"), F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("content"),
    )
    return detect(pages, ScanConfig(custom_patterns=(_INLINE,))).select(*CORE)


# --- text functions -----------------------------------------------------------------------------


@query("mask_secret", """WITH marked AS (
  SELECT conv_id, turn, '"' || split_part(text, ' ', 1) || '" ''' || role || 'password' || CAST(turn AS VARCHAR) || ''' ' || text AS code FROM conversations)
SELECT conv_id, turn, sha1(regexp_replace(regexp_replace(code, '"[A-Za-z0-9+/=_\\-\\.@]{8,}"', '"****"', 'g'), '''[A-Za-z0-9+/=_\\-\\.@]{8,}''', '''****''', 'g')) AS digest FROM marked""")
def masked(spark, sf_dir):
    c = co.read(spark, sf_dir, "conversations")
    code = F.concat(
        F.lit('"'), F.split_part("text", F.lit(" "), F.lit(1)), F.lit("\" '"), F.col("role"), F.lit("password"),
        F.col("turn").cast("string"), F.lit("' "), F.col("text"),
    )
    return c.select("conv_id", "turn", F.sha1(tx.mask_secret(code).cast("binary")).alias("digest"))


@query("fingerprint", """SELECT doc_id, left(sha1('R-1:' || replace(lang || '\\f' || CAST(doc_id AS VARCHAR), '\\', '/') || ':' ||
  regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 16) AS fingerprint FROM documents""")
def fingerprints(spark, sf_dir):
    d = co.read(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("\\f"), F.col("doc_id").cast("string"))
    return d.select("doc_id", tx.fingerprint(F.lit("R-1"), path, F.col("text")).alias("fingerprint"))


@query("html_escape", """SELECT page_id, sha1(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS digest FROM pages""")
def escaped(spark, sf_dir):
    p = co.read(spark, sf_dir, "pages")
    return p.select("page_id", F.sha1(tx.html_escape(F.col("html")).cast("binary")).alias("digest"))


@query("cvss_bucket", """SELECT event_id, CASE WHEN s >= 9 THEN 'CRITICAL' WHEN s >= 7 THEN 'HIGH' WHEN s >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM (SELECT event_id, CAST(event_id % 101 AS DOUBLE) / 10 AS s FROM events)""")
def cvss(spark, sf_dir):
    e = co.read(spark, sf_dir, "events")
    return e.select("event_id", sc.cvss_bucket((F.col("event_id") % 101).cast("double") / 10).alias("level"))


# --- enrichment, baseline, rollups --------------------------------------------------------------


@query("rule_catalog", f"""WITH {_ALL_FOUND}
SELECT rule_id, category, severity, severity_rank, remediation, cwe_id, cwe_name, owasp, confidence, fix_hint, check_ord, rule_ord, count(*) AS files
FROM found GROUP BY ALL""")
def catalog(spark, sf_dir):
    """The catalog joined to how many files each rule found."""
    counts = all_findings(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("files"))
    return rule_catalog(spark).join(counts, "rule_id").select(
        "rule_id", "category", "severity", "severity_rank", "remediation", "cwe_id", "cwe_name", "owasp", "confidence",
        "fix_hint", "check_ord", "rule_ord", "files",
    )


@query("enrich_findings", f"""WITH {_ALL_FOUND}
SELECT project, file_path, rule_id, line_number, cwe_id, cwe_name, owasp, confidence, fix_hint FROM found""")
def enriched(spark, sf_dir):
    bare = all_findings(spark, sf_dir).select("project", "file_path", "rule_id", "line_number")
    return enrich_fix_hint(enrich_confidence(enrich_cwe(bare)))


@query("apply_baseline", f"""WITH {_NEXT_FOUND}
SELECT {CORE_SQL} FROM found f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.project = f.project AND k.fingerprint = f.fingerprint)""")
def new_findings(spark, sf_dir):
    known = bl.baseline_snapshot(detect(co.corpus_next(spark, sf_dir)))
    return bl.apply_baseline(all_findings(spark, sf_dir), known).select(*CORE)


@query("baseline_counts", f"""WITH {_NEXT_FOUND}
SELECT f.project, count_if(k.fingerprint IS NULL) AS new, count_if(k.fingerprint IS NOT NULL) AS suppressed
FROM found f LEFT JOIN (SELECT DISTINCT project, fingerprint FROM known) k USING (project, fingerprint) GROUP BY f.project""")
def baseline_counts(spark, sf_dir):
    known = bl.baseline_snapshot(detect(co.corpus_next(spark, sf_dir)))
    split = bl.split_by_baseline(all_findings(spark, sf_dir), known)
    return split.groupBy("project").agg(
        F.count_if("is_new").alias("new"), F.count_if(~F.col("is_new")).alias("suppressed")
    )


@query("baseline_snapshot", f"""WITH {_ALL_FOUND}
SELECT project, fingerprint, rule_id, severity, file_path AS file, line_number AS line, code_snippet AS snippet FROM found""")
def snapshot(spark, sf_dir):
    return bl.baseline_snapshot(all_findings(spark, sf_dir))


@query("read_baseline", f"""SELECT 'p' || CAST(doc_id % 9 AS VARCHAR) AS project, left(sha1(text), 16) AS fingerprint FROM documents
UNION SELECT 'p' || CAST(doc_id % 9 AS VARCHAR), left(sha1(lang), 16) FROM documents""")
def read_baseline(spark, sf_dir):
    """Baseline files, one per document, one in seven of them also broken by a second broken file."""
    d = co.read(spark, sf_dir, "documents")
    project = F.concat(F.lit("p"), (F.col("doc_id") % 9).cast("string")).alias("project")
    prints = F.array(*[F.left(F.sha1(F.col(c).cast("binary")), F.lit(16)) for c in ("text", "lang")])
    good = d.select(project, F.lit(st.BASELINE_NAME).alias("path"), F.to_json(F.struct(
        F.lit(1).alias("version"), prints.alias("fingerprints")
    )).alias("content"))
    broken = d.filter(F.col("doc_id") % 7 == 0).select(project, F.lit(st.BASELINE_NAME).alias("path"), F.lit('{"fingerprints": [').alias("content"))
    return st.read_baseline(good.unionByName(broken))


@query("read_config", """WITH c AS (SELECT doc_id, doc_id % 4 AS k FROM documents)
SELECT 's' || CAST(doc_id AS VARCHAR) AS project,
  CASE k WHEN 0 THEN 'secrets,jwt' ELSE NULL END AS checks,
  CASE k WHEN 0 THEN 'high' ELSE 'low' END AS severity_threshold,
  CASE k WHEN 1 THEN 'none' ELSE 'critical' END AS fail_on,
  CASE k WHEN 0 THEN 'SEC-001' WHEN 1 THEN 'A' || CAST(doc_id AS VARCHAR) || ',B' ELSE '' END AS exclude_rules,
  CASE k WHEN 1 THEN 1 ELSE 0 END AS custom FROM c""")
def read_config(spark, sf_dir):
    """Settings files of four kinds: rules as one string, rules as a list, empty, broken."""
    d = co.read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    one = F.lit('{"checks":["secrets","jwt"],"severity_threshold":"high","exclude_rules":"SEC-001"}')
    two = F.concat(F.lit('{"exclude_rules":["A'), i.cast("string"), F.lit('","B"],"fail_on":"none","custom_patterns":[{"pattern":"x+"}]}'))
    content = F.when(i % 4 == 0, one).when(i % 4 == 1, two).when(i % 4 == 2, "{}").otherwise('{"checks":')
    files = d.select(F.concat(F.lit("s"), i.cast("string")).alias("project"), F.lit(st.CONFIG_NAME).alias("path"), content.alias("content"))
    c = st.read_config(files)
    return c.select(
        "project", F.array_join("checks", ",").alias("checks"), "severity_threshold", "fail_on",
        F.array_join("exclude_rules", ",").alias("exclude_rules"), F.size("custom_patterns").alias("custom"),
    )


@query("min_severity", f"WITH {_ALL_FOUND}\nSELECT {CORE_SQL} FROM found WHERE severity IN ('CRITICAL', 'HIGH')")
def high_findings(spark, sf_dir):
    return min_severity(all_findings(spark, sf_dir), "high").select(*CORE)


_COUNTS_SQL = ", ".join(f"count_if(severity = '{s.upper()}') AS {s}" for s in ro.LEVELS)


@query("severity_counts", f"WITH {_ALL_FOUND}\nSELECT project, count(*) AS total, {_COUNTS_SQL} FROM found GROUP BY project")
def severity_counts(spark, sf_dir):
    return ro.severity_counts(all_findings(spark, sf_dir))


# A corpus in which some projects have no finding, or only lesser ones.
_GRADED_SQL = f"""{co.CORPUS_SQL},
graded AS (SELECT 'g' || CAST(doc_id % 23 AS VARCHAR) AS project, path, raw_ext,
  CASE doc_id % 23 WHEN 1 THEN 'x = 1' WHEN 2 THEN 'httpOnly: false' WHEN 3 THEN 'c = DES(k)' ELSE content END AS content FROM corpus_files),
{findings_ctes(files='graded', entropy=True)}"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 23
    content = F.when(i == 1, "x = 1").when(i == 2, "httpOnly: false").when(i == 3, "c = DES(k)").otherwise(F.col("content"))
    return co.corpus_files(spark, sf_dir).select(
        F.concat(F.lit("g"), i.cast("string")).alias("project"), "path", content.alias("content")
    )


@query("project_summary", f"""WITH {_GRADED_SQL},
files AS (SELECT project, count(*) AS files_scanned FROM graded GROUP BY project),
counts AS (SELECT project, count(*) AS total, {_COUNTS_SQL} FROM found GROUP BY project)
SELECT project, files_scanned, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high,
  coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, CAST(0 AS BIGINT) AS suppressed,
  CASE WHEN critical > 0 THEN 'F' WHEN high > 0 THEN 'D' WHEN medium > 0 THEN 'C' WHEN low > 0 THEN 'B' ELSE 'A' END AS grade,
  CASE WHEN critical > 0 THEN 'BLOCKED' WHEN high > 0 THEN 'ACTION' WHEN medium > 0 THEN 'REVIEW' ELSE 'PASSED' END AS status
FROM files LEFT JOIN counts USING (project)""")
def summary(spark, sf_dir):
    files = _graded(spark, sf_dir)
    return summarize(files, detect(files))


@query("grade", f"""WITH {_GRADED_SQL}
SELECT g.project, CASE max(f.severity_rank) WHEN 4 THEN 'F' WHEN 3 THEN 'D' WHEN 2 THEN 'C' WHEN 1 THEN 'B' ELSE 'A' END AS grade
FROM (SELECT DISTINCT project FROM graded) g LEFT JOIN found f USING (project) GROUP BY g.project""")
def grade(spark, sf_dir):
    files = _graded(spark, sf_dir)
    return ro.grades(detect(files), files)


@query("quality_gate", f"""WITH {_GRADED_SQL}
SELECT g.project, coalesce(bool_or(f.severity IN ('CRITICAL', 'HIGH')), false) AS failed
FROM (SELECT DISTINCT project FROM graded) g LEFT JOIN found f USING (project) GROUP BY g.project""")
def gate(spark, sf_dir):
    files = _graded(spark, sf_dir)
    return ro.quality_gate(ro.project_summary(detect(files), files), "high")


@query("severity_rollup", f"WITH {_ALL_FOUND}\nSELECT project, category, severity, count(*) AS findings FROM found GROUP BY ROLLUP (project, category, severity)")
def rollup(spark, sf_dir):
    return ro.severity_rollup(all_findings(spark, sf_dir))


@query("order_by_severity", f"""WITH {_ALL_FOUND}
SELECT {CORE_SQL}, row_number() OVER (ORDER BY severity_rank DESC, project, file_path, check_ord, rule_ord, line_number) AS place FROM found""")
def ordered(spark, sf_dir):
    """Findings in report order, with the place that the sort gave them."""
    return with_place(order_by_severity(all_findings(spark, sf_dir))).select(*CORE, "place")


@query("order_by_emission", f"""WITH {_ALL_FOUND}
SELECT {CORE_SQL}, row_number() OVER (ORDER BY project, file_path, check_ord, rule_ord, line_number) AS place FROM found""")
def emitted(spark, sf_dir):
    """Findings file by file, with the place that the sort gave them."""
    return with_place(order_by_emission(all_findings(spark, sf_dir))).select(*CORE, "place")


@query("scan_config", f"""WITH {co.CORPUS_SQL},
chosen AS (SELECT * FROM corpus_files WHERE NOT starts_with(path, 'de/f1') AND NOT path LIKE '%.yaml'),
{findings_ctes(tuple(r for r in select_rules(('secrets', 'crypto')) if r.rule_id != 'SEC-012'), files='chosen', entropy=True)}
SELECT {CORE_SQL} FROM found""")
def configured(spark, sf_dir):
    """A whole scan under one set of settings."""
    config = ScanConfig(checks=("secrets", "crypto"), exclude_paths=("de/f1", "*.yaml"), exclude_rules={"SEC-012", "GIT-001"})
    return scan(co.corpus_files(spark, sf_dir), config).select(*CORE)


# --- dependencies -------------------------------------------------------------------------------

_PACKAGES = "project, path, ecosystem, name, original, version"


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.read_packages(co.manifests(spark, sf_dir))


def _manifest_query(name: str, ending: str, parse) -> None:
    @query(name, f"WITH {co.MANIFEST_SQL}\nSELECT {_PACKAGES} FROM packages WHERE path LIKE '%{ending}'")
    def build(spark, sf_dir):
        return parse(mf.select_manifests(co.manifests(spark, sf_dir))).select(*_PACKAGES.split(", "))


_manifest_query("parse_requirements", ".txt", mf.parse_requirements)
_manifest_query("parse_pyproject", ".toml", mf.parse_pyproject)
_manifest_query("parse_package_json", ".json", mf.parse_package_json)

_KNOWN_SQL = "known_names(ecosystem, name, issue_type, meant) AS (VALUES " + ", ".join(
    [f"('{e}', {quote(n)}, 'hallucinated', NULL)" for e, names in HALLUCINATED.items() for n in names]
    + [f"('{e}', {quote(n)}, 'typosquat', {quote(m) if m else 'NULL'})" for e, names in TYPOSQUATS.items() for n, m in names.items()]
) + ")"


def _known_query(name: str, issue: str, description: str, flag) -> None:
    @query(name, f"""WITH {co.MANIFEST_SQL}, {_KNOWN_SQL}
SELECT project, original AS package, 'CRITICAL' AS severity, path AS file_path, {description} AS description
FROM packages JOIN known_names USING (ecosystem, name) WHERE issue_type = '{issue}'""")
    def build(spark, sf_dir):
        return flag(_packages(spark, sf_dir)).select("project", "package", "severity", "file_path", "description")


_known_query("flag_hallucinated", "hallucinated",
             "'\"' || original || '\" is a name assistants invent; it may not exist'", dep.flag_hallucinated)
_known_query("flag_typosquat", "typosquat",
             "'\"' || original || CASE WHEN meant IS NULL THEN '\" is abandoned or malicious' ELSE '\" looks like a stand-in for \"' || meant || '\"' END",
             dep.flag_typosquat)


@query("is_unpinned", f"""WITH {co.MANIFEST_SQL}
SELECT project, original AS package, version, path AS file_path, 'npm install ' || original || '@<version> --save-exact' AS remediation
FROM packages WHERE ecosystem = 'npm' AND version IN ('*', 'latest', '')""")
def unpinned(spark, sf_dir):
    return dep.flag_unpinned(_packages(spark, sf_dir)).select("project", "package", "version", "file_path", "remediation")


# ADVISORIES of the corpus, written out: name, ecosystem, versions, cve, severity, summary
_ADVISORY_SQL = """advisory(ecosystem, name, versions, cve_id, severity, summary) AS (VALUES
  ('python', 'requests', ['2.19.0', '2.19.1'], 'CVE-2018-0001', 'MEDIUM', 'credential leak on redirect'),
  ('python', 'pyyaml', ['5.1'], 'ADV-2', 'CRITICAL', 'code run on load'),
  ('npm', 'lodash', ['4.17.15'], 'CVE-2019-0003', 'HIGH', 'prototype change'),
  ('npm', 'minimist', ['1.2.0'], 'ADV-4', 'HIGH', 'Security vulnerability'),
  ('python', 'django', ['2.2'], 'ADV-5', 'LOW', 'path escape'),
  ('npm', 'express', ['~4.17.0'], 'ADV-5', 'LOW', 'path escape'))"""


def _advisory_sql(extra: str = "false") -> str:
    return f"""WITH {co.MANIFEST_SQL}, {_ADVISORY_SQL}
SELECT project, original AS package, version, a.severity, a.cve_id || ': ' || a.summary AS description, path AS file_path,
  CASE ecosystem WHEN 'npm' THEN 'npm update ' ELSE 'pip install --upgrade ' END || original AS remediation, a.cve_id
FROM packages p JOIN advisory a USING (ecosystem, name)
WHERE coalesce(version, '') = '' OR list_contains(versions, version) OR {extra}"""


_ADVISED = ["project", "package", "version", "severity", "description", "file_path", "remediation", "cve_id"]


@query("match_advisories", _advisory_sql())
def advised(spark, sf_dir):
    return dep.match_advisories(_packages(spark, sf_dir), co.advisory_rows(spark)).select(*_ADVISED)


@query("match_advisory_ranges", _advisory_sql("(a.cve_id = 'CVE-2018-0001' AND version IN ('2.19.0', '1'))"))
def advised_ranges(spark, sf_dir):
    return dep.match_advisories(_packages(spark, sf_dir), co.advisory_rows(spark), ranges=True).select(*_ADVISED)


_OPERATORS = ("", "^", "~", ">=", "v", "==", " ~> ")
_TAGS = ("", "-rc.1", "+b5", "beta", ".dev2")


@query("version_ranges", f"""WITH v AS (
  SELECT event_id, event_id % 4 AS a, (event_id // 4) % 7 AS b, event_id % 3 AS c, ({sql_list(_OPERATORS)})[CAST(event_id % {len(_OPERATORS)} AS INT) + 1] AS operator,
    ({sql_list(_TAGS)})[CAST(event_id % {len(_TAGS)} AS INT) + 1] AS tag, event_id % 50 = 0 AS none FROM events),
n AS (SELECT *, CASE WHEN none THEN 'latest' ELSE operator || a || '.' || b || '.' || c || tag END AS version,
    a * 10000 + b * 100 + c - CASE WHEN tag IN ('', '+b5') THEN 0 ELSE 0.5 END AS place FROM v)
SELECT event_id, version, NOT none AND (place >= 10200 AND place < 20300 OR place >= 30401 AND place <= 30500 OR place < 1) AS affected FROM n""")
def version_ranges(spark, sf_dir):
    """Requirements and releases of many forms against ranges whose events are not in order."""
    i = F.col("event_id")
    numbers = F.concat_ws(".", (i % 4).cast("string"), (F.floor(i / 4) % 7).cast("string"), (i % 3).cast("string"))
    version = F.when(i % 50 == 0, "latest").otherwise(F.concat(co._pick(_OPERATORS, i), numbers, co._pick(_TAGS, i)))
    event = "named_struct('introduced', {}, 'fixed', {}, 'last_affected', {})"
    ranges = F.expr("array(array({}, {}), array({}, {}, {}, {}))".format(
        event.format("null", "'2.3'", "null"), event.format("'1.2.0'", "null", "null"), event.format("'3.4.1'", "null", "null"),
        event.format("null", "null", "'3.5'"), event.format("null", "'0.0.1'", "null"), event.format("'0'", "null", "null"),
    ))
    return co.read(spark, sf_dir, "events").select("event_id", version.alias("version"), dep.in_ranges(version, ranges).alias("affected"))


# Advisories made from the events, of six kinds of ranges; packages from the orders. A version's place is a number that sorts like it.
_RANGE_KINDS = (
    '{{"introduced":"{a}"}},{{"fixed":"{b}"}}', '{{"introduced":"0"}},{{"fixed":"{b}"}}', '{{"last_affected":"{b}"}},{{"introduced":"{a}"}}',
    '{{"introduced":"{a}"}},{{"fixed":"{b}"}},{{"introduced":"{c}"}}', '{{"fixed":"{c}"}},{{"introduced":"{b}"}},{{"fixed":"{a}"}},{{"introduced":"0"}}',
    '{{"introduced":"{a}"}},{{"fixed":"{b}"}}]}},{{"type":"SEMVER","events":[{{"introduced":"{a}"}},{{"last_affected":"{c}"}}',
)
_LIBS = 300


@query("advisory_table", f"""WITH records AS (SELECT event_id AS i, 'lib' || (event_id % {_LIBS}) AS name, CASE WHEN event_id % 2 = 0 THEN 'python' ELSE 'npm' END AS ecosystem, event_id % 6 AS kind,
    event_id % 3 AS a0, event_id % 7 AS a1, 3 + event_id % 4 AS b0, event_id % 11 AS b1, 7 + event_id % 2 AS c0, event_id % 5 AS c1 FROM events),
advisory AS (SELECT *, a0 * 10000 + a1 * 100 AS a, b0 * 10000 + b1 * 100 AS b, c0 * 10000 + c1 * 100 AS c FROM records),
asked AS (SELECT o_orderkey, o_orderkey % 97 AS p, 'lib' || (o_orderkey % {_LIBS * 2}) AS name, CASE WHEN o_orderkey % 4 < 2 THEN 'python' ELSE 'npm' END AS ecosystem, o_orderkey % 10 AS x, o_custkey % 12 AS y,
    o_orderkey % 2 AS z, o_custkey % 5 = 0 AS early, o_orderkey % 40 = 3 AS none FROM orders),
package AS (SELECT *, x * 10000 + y * 100 + z - CASE WHEN early THEN 0.5 ELSE 0 END AS place, x || '.' || y || CASE WHEN z > 0 THEN '.1' ELSE '' END || CASE WHEN early THEN '-rc.2' ELSE '' END AS version FROM asked)
SELECT 's' || p AS project, p.name AS package, CASE WHEN none THEN NULL ELSE version END AS version, 'svc' || o_orderkey || '/requirements.txt' AS file_path, 'CVE-' || i AS cve_id, 'HIGH' AS severity
FROM package p JOIN advisory v ON v.name = p.name AND v.ecosystem = p.ecosystem
WHERE none OR (i % 50 = 0 AND version = '9.' || (i % 12)) OR CASE kind WHEN 0 THEN place >= a AND place < b WHEN 1 THEN place < b WHEN 2 THEN place >= a AND place <= b WHEN 3 THEN place >= a AND place < b OR place >= c
  WHEN 4 THEN place < a OR place >= b AND place < c ELSE place >= a AND place <= c END""")
def advisory_table(spark, sf_dir):
    """Packages of the orders against an advisory for every event, as intervals."""
    i, o, k = F.col("event_id"), F.col("o_orderkey"), F.col("o_custkey")
    numbers = {"a": (i % 3, i % 7), "b": (3 + i % 4, i % 11), "c": (7 + i % 2, i % 5)}
    events = F.element_at(F.array(*[F.lit(t.format(a="{a}", b="{b}", c="{c}")) for t in _RANGE_KINDS]), (i % 6 + 1).cast("int"))
    for name, (major, minor) in numbers.items():
        events = F.replace(events, F.lit("{" + name + "}"), F.concat_ws(".", major.cast("string"), minor.cast("string")))
    listed = F.when(i % 50 == 0, F.concat(F.lit('"9.'), (i % 12).cast("string"), F.lit('"'))).otherwise("")
    payload = F.concat(
        F.lit('{"id":"A-'), i.cast("string"), F.lit('","aliases":["CVE-'), i.cast("string"), F.lit('"],"summary":"s","affected":[{"package":{"ecosystem":"'),
        F.when(i % 2 == 0, "PyPI").otherwise("npm"), F.lit('","name":"Lib'), (i % _LIBS).cast("string"), F.lit('"},"versions":['), listed,
        F.lit('],"ranges":[{"type":"ECOSYSTEM","events":['), events, F.lit("]}]}]}"),
    )
    advisories = adv.read_advisories(adv.advisories_from_json(co.read(spark, sf_dir, "events").select(payload.alias("payload"))))
    version = F.concat((o % 10).cast("string"), F.lit("."), (k % 12).cast("string"), F.when(o % 2 > 0, ".1").otherwise(""), F.when(k % 5 == 0, "-rc.2").otherwise(""))
    name = F.concat(F.lit("lib"), (o % (2 * _LIBS)).cast("string"))
    packages = co.read(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), (o % 97).cast("string")).alias("project"), F.concat(F.lit("svc"), o.cast("string"), F.lit("/requirements.txt")).alias("path"),
        F.when(o % 4 < 2, "python").otherwise("npm").alias("ecosystem"), name.alias("name"), name.alias("original"), F.when(o % 40 != 3, version).alias("version"),
    )
    return match_advisory_intervals(packages, advisories).select("project", "package", "version", "file_path", "cve_id", "severity")


@query("advisory_severity", """SELECT event_id, CASE WHEN l = 'MODERATE' THEN 'MEDIUM' WHEN l = 'IMPORTANT' THEN 'HIGH' WHEN l = 'NEGLIGIBLE' THEN 'LOW'
  WHEN l IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN l ELSE 'HIGH' END AS severity,
  CASE event_id % 3 WHEN 0 THEN 'CVE-' || CAST(event_id AS VARCHAR) WHEN 1 THEN 'A-' || CAST(event_id AS VARCHAR) ELSE 'UNKNOWN' END AS cve_id
FROM (SELECT event_id, upper(CASE WHEN event_id % 5 = 0 THEN (['important', 'low', 'critical'])[CAST(event_id % 3 AS INT) + 1]
  ELSE (['moderate', 'Negligible', 'high', 'odd', '', 'Critical'])[CAST(event_id % 6 AS INT) + 1] END) AS l FROM events)""")
def advisory_levels(spark, sf_dir):
    """Severity and preferred id of advisory records made from the events."""
    e = co.read(spark, sf_dir, "events")
    i = F.col("event_id")
    label = co._pick(("moderate", "Negligible", "high", "odd", "", "Critical"), i)
    eco = F.when(i % 5 == 0, co._pick(("important", "low", "critical"), i))
    named = F.when(i % 3 == 0, F.array(F.lit("GHSA-1"), F.concat(F.lit("CVE-"), i.cast("string")))).otherwise(F.array(F.lit("GHSA-2")))
    advisory_id = F.when(i % 3 != 2, F.concat(F.lit("A-"), i.cast("string")))
    return e.select(
        "event_id", sc.advisory_severity(label, F.array(F.lit(None).cast("string"), F.lit(""), eco)).alias("severity"),
        sc.preferred_cve(advisory_id, named).alias("cve_id"),
    )


@query("dep_counts", f"""WITH {co.MANIFEST_SQL}, {_KNOWN_SQL}, {_ADVISORY_SQL},
every AS (SELECT project, issue_type FROM packages JOIN known_names USING (ecosystem, name)
  UNION ALL SELECT project, 'suspicious' FROM packages WHERE ecosystem = 'npm' AND version IN ('*', 'latest', '')
  UNION ALL SELECT project, 'vulnerable' FROM packages JOIN advisory USING (ecosystem, name) WHERE coalesce(version, '') = '' OR list_contains(versions, version))
SELECT project, issue_type, count(*) AS findings FROM every GROUP BY ALL""")
def dep_counts(spark, sf_dir):
    return dep.dep_counts(audit_dependencies(co.manifests(spark, sf_dir), co.advisory_rows(spark)))


@query("ingest_pip_audit", """SELECT 's' || CAST(s_suppkey AS VARCHAR) AS project, 'lib' || CAST(s_suppkey AS VARCHAR) AS package, '1.' || CAST(s_nationkey AS VARCHAR) AS version,
  'HIGH' AS severity, 'V-' || CAST(s_suppkey AS VARCHAR) AS cve_id, 'V-' || CAST(s_suppkey AS VARCHAR) || ' (via pip-audit)' AS description FROM supplier
UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'lib' || CAST(s_suppkey AS VARCHAR), '1.' || CAST(s_nationkey AS VARCHAR), 'HIGH', 'V-0', 'V-0 (via pip-audit)' FROM supplier
UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'unknown', NULL, 'HIGH', 'Unknown', 'Unknown (via pip-audit)' FROM supplier""")
def pip_audit(spark, sf_dir):
    s = co.read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    payload = F.concat(
        F.lit('[{"name":"lib'), k, F.lit('","version":"1.'), F.col("s_nationkey").cast("string"),
        F.lit('","vulns":[{"id":"V-'), k, F.lit('"},{"id":"V-0"}]},{"name":"safe","version":"1","vulns":[]},{"vulns":null}]'),
    )
    reports = s.select(F.concat(F.lit("s"), k).alias("project"), payload.alias("payload"))
    return adv.ingest_pip_audit(reports).select("project", "package", "version", "severity", "cve_id", "description")


@query("ingest_npm_audit", """WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k FROM supplier)
SELECT 's' || k AS project, 'a' || k AS package, '<' || k AS version, 'MODERATE' AS severity, 'title ' || k || ' (via npm audit)' AS description FROM s
UNION ALL SELECT 's' || k, 'a' || k, '<' || k, 'MODERATE', 'second (via npm audit)' FROM s
UNION ALL SELECT 's' || k, 'b', NULL, 'HIGH', '[''a' || k || ''', ''c''] (via npm audit)' FROM s
UNION ALL SELECT 's' || k, 'd', '*', 'LOW', 'Security vulnerability (via npm audit)' FROM s""")
def npm_audit(spark, sf_dir):
    s = co.read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    payload = F.concat(
        F.lit('{"vulnerabilities":{"a'), k, F.lit('":{"severity":"moderate","range":"<'), k, F.lit('","via":[{"title":"title '), k,
        F.lit('"},"x",{"title":"second"}]},"b":{"via":["a'), k, F.lit('","c"]},"d":{"severity":"low","range":"*","via":[{"source":1}]}}}'),
    )
    reports = s.select(F.concat(F.lit("s"), k).alias("project"), payload.alias("payload"))
    return adv.ingest_npm_audit(reports).select("project", "package", "version", "severity", "description")


@query("ingest_semgrep", """WITH s AS (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS k FROM supplier)
SELECT 's' || k AS project, 'r.' || k AS rule_id, 'ERROR' AS severity, 'm' AS message, 'f' || k || '.py' AS file, CAST(s_suppkey AS INT) AS line, 'CWE-1|CWE-2' AS cwe, 'A1' AS owasp FROM s
UNION ALL SELECT 's' || k, '', 'WARNING', '', '', 0, '', '' FROM s""")
def semgrep(spark, sf_dir):
    s = co.read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    payload = F.concat(
        F.lit('{"results":[{"check_id":"r.'), k, F.lit('","path":"f'), k, F.lit('.py","start":{"line":'), k,
        F.lit('},"extra":{"severity":"error","message":"m","metadata":{"cwe":["CWE-1","CWE-2"],"owasp":"A1"}}},{}]}'),
    )
    found = adv.ingest_semgrep(s.select(F.concat(F.lit("s"), k).alias("project"), payload.alias("payload")))
    return found.select(
        "project", "rule_id", "severity", "message", "file", "line", F.array_join("cwe", "|").alias("cwe"),
        F.array_join("owasp", "|").alias("owasp"),
    )


# --- commit history -----------------------------------------------------------------------------

_LOG_CTES = f"{co.CORPUS_SQL},\n{co.VERSIONS_SQL},\n{co.LOG_SQL}"


@query("parse_commit_log", f"""WITH {_LOG_CTES}
SELECT repo, seq, sha1(CAST(doc_id AS VARCHAR)) AS commit_hash, lang AS commit_author,
  CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS VARCHAR) AS commit_date, 'change ' || CAST(doc_id AS VARCHAR) AS commit_message,
  path AS file_path, sha1(content) AS digest FROM added""")
def parsed_log(spark, sf_dir):
    log = cl.parse_commit_log(co.commit_log(spark, sf_dir))
    return log.select(
        "repo", "seq", "commit_hash", "commit_author", "commit_date", "commit_message", "file_path",
        F.sha1(F.col("content").cast("binary")).alias("digest"),
    )


@query("limit_commits", f"""WITH {_LOG_CTES}, newest AS (
  SELECT repo, doc_id, row_number() OVER (PARTITION BY repo ORDER BY doc_id DESC) AS nth FROM raw_log)
SELECT repo, count(*) AS lines, count(DISTINCT doc_id) AS commits FROM added JOIN newest USING (repo, doc_id) WHERE nth <= 7 GROUP BY repo""")
def limited(spark, sf_dir):
    log = cl.parse_commit_log(cl.limit_commits(co.commit_log(spark, sf_dir), 7))
    return log.groupBy("repo").agg(F.count("*").alias("lines"), F.countDistinct("commit_hash").alias("commits"))


def _history_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(content, {quote('(?i)' + r.pattern)}) THEN {i} END" for i, r in enumerate(hi.HISTORY_RULES))
    ids = sql_list([r.rule_id for r in hi.HISTORY_RULES])
    descriptions = sql_list([r.description for r in hi.HISTORY_RULES])
    pattern = quote("(?i)" + ENTROPY_RULE.pattern)
    return f"""{_LOG_CTES}, tested AS (
  SELECT *, list_filter([{cases}], lambda x: x IS NOT NULL) AS rs,
    list_filter(regexp_extract_all(content, {pattern}, 1), lambda v: round(list_entropy(string_split(v, '')), 9) >= 4.5) AS vals FROM added),
history_hits AS (
  SELECT * EXCLUDE (r), r AS hit_ord, ({ids})[r + 1] AS rule_id, ({descriptions})[r + 1] AS description, CAST(NULL AS VARCHAR) AS value FROM (SELECT *, unnest(rs) AS r FROM tested)
  UNION ALL SELECT * EXCLUDE (v, i), {len(hi.HISTORY_RULES)} + i, '{ENTROPY_RULE.rule_id}', 'High-entropy secret in history (entropy=' || printf('%.2f', list_entropy(string_split(v, ''))) || ')', v
  FROM (SELECT *, unnest(vals) AS v, unnest(range(0, len(vals))) AS i FROM tested)),
identified AS (
  SELECT *, left(trim(content), 120) AS line_snippet, trim(content) AS line_text, left(sha1(rule_id || ':' || path || ':' || trim(content) || coalesce(chr(10) || value, '')), 16) AS fingerprint FROM history_hits),
history AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, fingerprint ORDER BY seq, hit_ord) AS nth FROM identified) WHERE nth = 1),
head AS (
  SELECT project AS repo, path, CASE WHEN doc_id % 11 = 0 THEN text ELSE content END AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY project, path ORDER BY doc_id DESC) AS nth FROM file_versions) WHERE nth = 1),
marked AS (
  SELECT h.* EXCLUDE (content), coalesce(contains(d.content, h.line_text), false) AS still_present
  FROM history h LEFT JOIN head d ON d.repo = h.repo AND d.path = h.path)"""


_HISTORY_SQL = _history_sql()


@query("history_findings", f"""WITH {_HISTORY_SQL}
SELECT repo, rule_id, description, sha1(CAST(doc_id AS VARCHAR)) AS commit_hash, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS VARCHAR) AS commit_date,
  lang AS commit_author, 'change ' || CAST(doc_id AS VARCHAR) AS commit_message, path AS file_path, line_snippet, line_text, fingerprint, seq, hit_ord FROM history""")
def history(spark, sf_dir):
    return hi.history_findings(co.commit_log(spark, sf_dir))


@query("still_present", f"WITH {_HISTORY_SQL}\nSELECT repo, fingerprint, rule_id, path AS file_path, still_present FROM marked")
def still_present(spark, sf_dir):
    found = hi.mark_still_present(hi.history_findings(co.commit_log(spark, sf_dir)), co.head_files(spark, sf_dir))
    return found.select("repo", "fingerprint", "rule_id", "file_path", "still_present")


@query("history_counts", f"""WITH {_HISTORY_SQL}
SELECT repo, count(*) AS total, count_if(still_present) AS still_present, count_if(NOT still_present) AS removed FROM marked GROUP BY repo""")
def history_totals(spark, sf_dir):
    found = hi.mark_still_present(hi.history_findings(co.commit_log(spark, sf_dir)), co.head_files(spark, sf_dir))
    return hi.history_counts(found)


# --- profiles -----------------------------------------------------------------------------------

ROOT_NAMES = ("package.json", "requirements.txt", "app.py", "Gemfile", "main.go", "go.mod", "pyproject.toml",
              "next.config.js", "pom.xml", "src/settings.py", "web/App.vue", ".cursorrules", "docker-compose.yml",
              "node_modules/vue/package.json", "lovable.json", "src/main.rs", "Cargo.toml")
WORDS = ("flask", "pymongo", "@aws-sdk", "redis", "react", "supabase", "azure", "sqlite3", "@nestjs", "nothing",
         "psycopg2", "express", "boto3")


def profile_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of a few files each, named and filled by document id."""
    d = co.read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    project = F.concat(F.lit("r"), F.floor(i / 8).cast("string")).alias("project")
    # eight files per project; the step differs by project so that their mix does
    pick = (i % 8) * (F.floor(i / 8) % 5 + 1) + F.floor(i / 8)
    content = F.concat(F.lit("use "), co._pick(WORDS, pick), F.lit("\n"), F.col("text"))
    return d.select(project, co._pick(ROOT_NAMES, pick).alias("path"), content.alias("content"))


def _profile_sql() -> str:
    def any_word(words, text="sample"):
        return "(" + " OR ".join(f"contains({text}, {quote(w.lower())})" for w in words) + ")"

    def named(words):
        low = sql_list([w.lower() for w in words])
        return f"bool_or(list_contains({low}, lower(name)) OR list_contains({low}, lower(path)))"

    fw = ", ".join(f"{named(w)} AS fw{i}" for i, w in enumerate(pf.FRAMEWORKS.values()))
    ai = ", ".join(f"bool_or({any_word(w, 'path')}) AS ai{i}" for i, w in enumerate(pf.AI_TOOLS.values()))
    langs = ", ".join(f"bool_or(ext = '{e}') AS lang{i}" for i, e in enumerate(pf.LANGUAGES))
    samples = ", ".join(f"max(CASE WHEN path = '{n}' THEN content END)" for n in pf.SAMPLED)

    def listed(flags):
        return "list_filter([" + ", ".join(f"CASE WHEN {f} THEN '{n}' END" for n, f in flags.items()) + "], lambda x: x IS NOT NULL)"

    frameworks = listed({n: f"(fw{i} OR {any_word(w)})" for i, (n, w) in enumerate(pf.FRAMEWORKS.items())})
    languages = "list_sort(" + listed({n: f"lang{i}" for i, n in enumerate(pf.LANGUAGES.values())}) + ")"
    return f"""files AS (
  SELECT 'r' || CAST(doc_id // 8 AS VARCHAR) AS project, (doc_id % 8) * ((doc_id // 8) % 5 + 1) + doc_id // 8 AS pick,
    ({sql_list(ROOT_NAMES)})[CAST(pick % {len(ROOT_NAMES)} AS INT) + 1] AS path, string_split(path, '/')[-1] AS name,
    lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext,
    'use ' || ({sql_list(WORDS)})[CAST(pick % {len(WORDS)} AS INT) + 1] || chr(10) || text AS content
  FROM documents),
named AS (
  SELECT project, bool_or(name = 'package.json') AS pkg, bool_or(name IN ('requirements.txt', 'pyproject.toml')) AS py,
    bool_or(contains(path, 'next')) AS nx, bool_or(contains(path, '.vue')) AS vu, bool_or(contains(path, 'settings.py')) AS se, bool_or(contains(path, 'app.py')) AS ap,
    bool_or(name = 'Gemfile') AS ge, bool_or(name IN ('pom.xml', 'build.gradle')) AS po, bool_or(name = 'go.mod') AS go, bool_or(name = 'Cargo.toml') AS ca,
    {fw}, {ai}, {langs}
  FROM files WHERE NOT starts_with(path, 'node_modules/') GROUP BY project),
sampled AS (SELECT project, lower(concat_ws(chr(10), {samples})) AS sample FROM files GROUP BY project),
profile AS (
  SELECT project, CASE WHEN pkg AND nx THEN 'next.js' WHEN pkg AND vu THEN 'vue' WHEN pkg THEN 'node.js' WHEN py AND se THEN 'django'
      WHEN py AND ap THEN 'flask/fastapi' WHEN py THEN 'python' WHEN ge THEN 'ruby/rails' WHEN po THEN 'java' WHEN go THEN 'go' WHEN ca THEN 'rust' ELSE 'unknown' END AS project_type,
    {frameworks} AS frameworks, {languages} AS languages,
    {listed({n: any_word(w) for n, w in pf.DATABASES.items()})} AS databases,
    {listed({n: any_word(w) for n, w in pf.CLOUDS.items()})} AS clouds,
    {listed({n: f'ai{i}' for i, n in enumerate(pf.AI_TOOLS)})} AS tools
  FROM named JOIN sampled USING (project))"""


_PROFILE_SQL = _profile_sql()


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.profile_projects(profile_corpus(spark, sf_dir))


@query("profile_type", f"WITH {_PROFILE_SQL} SELECT project, project_type FROM profile")
def profile_type(spark, sf_dir):
    return _profiles(spark, sf_dir).select("project", "project_type")


@query("profile_languages", f"WITH {_PROFILE_SQL} SELECT project, array_to_string(languages, ',') AS languages FROM profile")
def profile_languages(spark, sf_dir):
    return _profiles(spark, sf_dir).select("project", F.array_join("languages", ",").alias("languages"))


@query("profile_indicators", f"""WITH {_PROFILE_SQL} SELECT project, array_to_string(frameworks, ',') AS frameworks, array_to_string(databases, ',') AS databases,
  array_to_string(clouds, ',') AS clouds, array_to_string(tools, ',') AS tools FROM profile""")
def profile_indicators(spark, sf_dir):
    p = _profiles(spark, sf_dir)
    columns = {"frameworks": "frameworks", "databases": "databases", "cloud_services": "clouds", "ai_tool_indicators": "tools"}
    return p.select("project", *[F.array_join(c, ",").alias(a) for c, a in columns.items()])


@query("recommend_checks", f"""WITH {_PROFILE_SQL}, parts AS (
  SELECT project, list_concat(
    CASE WHEN list_contains(tools, 'lovable') THEN ['cloud'] ELSE [] END, ['secrets'], CASE WHEN len(databases) > 0 THEN ['injection'] ELSE [] END,
    CASE WHEN list_has_any(frameworks, {sql_list(pf.WEB_FRAMEWORKS)}) THEN ['xss', 'auth', 'cors'] ELSE [] END,
    CASE WHEN len(clouds) > 0 OR list_has_any(databases, ['supabase', 'firebase']) THEN ['cloud'] ELSE [] END,
    CASE WHEN list_contains(frameworks, 'django') THEN ['crypto'] ELSE [] END, CASE WHEN len(tools) > 0 THEN ['data'] ELSE [] END) AS c FROM profile)
SELECT project, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ',') AS checks FROM parts""")
def recommended(spark, sf_dir):
    return _profiles(spark, sf_dir).select("project", F.array_join("recommended_checks", ",").alias("checks"))
