"""SQL text that computes findings independently of the Spark operators."""

from __future__ import annotations

from auditlake.catalog.rules import ENTROPY_RULE, RULES, Rule
from auditlake.functions.text import DEFAULT_MARKER as MARKER
from workload.corpus import quote, sql_list

# Forms of the rules with lookaround, which the checking engine does not have.
REWRITTEN = {
    "INJ-020": r"""innerHTML\s*=(?:[^'"]|['"]\s*[^'"\s]|['"]\s*\z|\z)""",
    "DBG-002": r"""(?:^|[^0-9A-Za-z_\n])DEBUG\s*=\s*True""",
    "NET-001": r"""["']http://[a-zA-Z0-9][^"']{4,}["']""",
    "NET-003": r"""sameSite\s*[=:]\s*["']?none["']?""",
    "HDR-001": r"""X-Frame-Options.{0,30}[=:,]\s*["']?ALLOW(?:[^Ee]|[Ee][^Dd]|[Ee]?\z)""",
}

# Matches of the rewritten pattern that the rule does not mean.
REJECTED = {
    "NET-001": r"""["']http://(?:localhost|127\.|0\.0\.0\.0|10\.|192\.168\.|example\.com)""",
    "NET-003": r"""sameSite\s*[=:]\s*["']?none["']?.*secure""",
}


def after(comment: str, line: str = "raw", rule: str = "rule_id") -> str:
    tag = f"{comment} {MARKER}"
    rest = f"trim(substr({line}, strpos({line}, '{tag}') + {len(tag)}))"
    return (
        f"(strpos({line}, '{tag}') > 0 AND ({rest} = '' OR list_contains(string_split_regex({rest}, '\\s+'), {rule})))"
    )


def suppressed(line: str = "raw", rule: str = "rule_id") -> str:
    return f"({after('#', line, rule)} OR {after('//', line, rule)})"


def _one_rule(rule: Rule, files: str) -> str:
    pattern = quote("(?im)" + REWRITTEN.get(rule.rule_id, rule.pattern))
    marked = f"regexp_replace(content, {pattern}, chr(1) || '\\0', 'g')"
    if rule.rule_id in REJECTED:
        rejected = quote("(?im)" + "\x01(" + REJECTED[rule.rule_id] + ")")
        marked = f"regexp_replace({marked}, {rejected}, '\\1', 'g')"
    tests = [f"regexp_matches(content, {pattern})"]
    if rule.extensions:
        tests.insert(0, f"list_contains({sql_list(rule.extensions)}, raw_ext)")
    severity, category = quote(rule.severity), quote(rule.category)
    cwe_id, cwe_name, owasp = rule.weakness
    return (
        f"SELECT project, path, {quote(rule.rule_id)} AS rule_id, {severity} AS severity, {rule.severity_rank} AS severity_rank, "
        f"{category} AS category, {quote(rule.description)} AS base_description, {quote(rule.remediation)} AS remediation, "
        f"{quote(cwe_id)} AS cwe_id, {quote(cwe_name)} AS cwe_name, {quote(owasp)} AS owasp, {quote(rule.fix_hint)} AS fix_hint, "
        f"{quote(rule.confidence)} AS confidence, {rule.check_ord} AS check_ord, {rule.rule_ord} AS rule_ord, "
        f"string_split({marked}, chr(10)) AS parts FROM {files} WHERE {' AND '.join(tests)}"
    )


def findings_ctes(rules=RULES, files: str = "corpus_files", entropy: bool = False, name: str = "found") -> str:
    """CTEs ending in ``found``: the findings of the given rules over (project, path, raw_ext, content)."""
    union = "\n    UNION ALL ".join(_one_rule(r, files) for r in rules)
    columns = (
        "project, path AS file_path, rule_id, severity, severity_rank, category, description, line_number, match_count, "
        "code_snippet, remediation, cwe_id, cwe_name, owasp, fix_hint, confidence, check_ord, rule_ord, "
        "left(sha1(rule_id || ':' || path || ':' || code_text), 16) AS fingerprint"
    )
    text = f"""{name}_marked AS (
    {union}),
{name}_lines AS (
  SELECT * EXCLUDE (parts, x), replace(x, chr(1), '') AS raw, length(x) - length(replace(x, chr(1), '')) AS n
  FROM (SELECT *, unnest(parts) AS x, unnest(range(1, len(parts) + 1)) AS line FROM {name}_marked)
  WHERE contains(x, chr(1))),
{name}_first AS (
  SELECT * EXCLUDE (raw, n, line, base_description), CAST(line AS INT) AS line_number, left(trim(raw), 100) AS code_snippet, trim(raw) AS code_text,
         CAST(sum(n) OVER w AS BIGINT) AS match_count, row_number() OVER (PARTITION BY project, path, rule_id ORDER BY line) AS nth,
         base_description || CASE WHEN sum(n) OVER w > 1 THEN ' (and ' || CAST(sum(n) OVER w - 1 AS BIGINT) || ' more in this file)' ELSE '' END AS description
  FROM {name}_lines WHERE NOT {suppressed()}
  WINDOW w AS (PARTITION BY project, path, rule_id)),
{name}_rules AS (SELECT {columns} FROM {name}_first WHERE nth = 1)"""
    if not entropy:
        return text + f",\n{name} AS (SELECT * FROM {name}_rules)"
    r = ENTROPY_RULE
    pattern = quote("(?i)" + r.pattern)
    cwe_id, cwe_name, owasp = r.weakness
    return text + f""",
{name}_text AS (
  SELECT project, path, unnest(string_split(content, chr(10))) AS raw, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line
  FROM {files}),
{name}_values AS (
  SELECT project, path, raw, line, unnest(regexp_extract_all(raw, {pattern}, 1)) AS value,
         unnest(range(0, len(regexp_extract_all(raw, {pattern}, 1)))) AS pos
  FROM {name}_text WHERE regexp_matches(raw, {pattern})),
{name}_random AS (
  SELECT *, list_entropy(string_split(value, '')) AS bits, {quote(r.rule_id)} AS rule_id FROM {name}_values
  WHERE round(list_entropy(string_split(value, '')), 9) >= 4.5 AND NOT {suppressed('raw', quote(r.rule_id))}),
{name}_entropy AS (
  SELECT *, row_number() OVER (PARTITION BY project, path, trim(raw) ORDER BY line, pos) AS nth,
         '{r.severity}' AS severity, {r.severity_rank} AS severity_rank, '{r.category}' AS category,
         {quote(r.description)} || ' (entropy=' || printf('%.2f', bits) || ' bits/char)' AS description, CAST(line AS INT) AS line_number,
         CAST(1 AS BIGINT) AS match_count, left(trim(raw), 100) AS code_snippet, trim(raw) AS code_text, {quote(r.remediation)} AS remediation,
         {quote(cwe_id)} AS cwe_id, {quote(cwe_name)} AS cwe_name, {quote(owasp)} AS owasp, {quote(r.fix_hint)} AS fix_hint,
         '{r.confidence}' AS confidence, {r.check_ord} AS check_ord, {r.rule_ord} AS rule_ord
  FROM {name}_random),
{name} AS (SELECT * FROM {name}_rules UNION ALL BY NAME SELECT {columns} FROM {name}_entropy WHERE nth = 1)"""
