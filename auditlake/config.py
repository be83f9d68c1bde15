"""Scan settings that hold for a whole run."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from auditlake.catalog.rules import RULE_BY_ID, SECRETS, Rule
from auditlake.catalog.taxonomy import SEVERITY_RANK, severity_rank
from auditlake.functions.dialect import UnsupportedPattern, to_jvm
from auditlake.functions.text import DEFAULT_MARKER

CUSTOM_ORD = 1000


@dataclass(frozen=True)
class ScanConfig:
    """``checks=None`` runs every check. Paths and rules listed in ``exclude_*`` are left out.

    ``compat=True`` makes custom patterns ignore their own severity and remediation.
    """

    checks: tuple[str, ...] | None = None
    severity_threshold: str = "low"
    exclude_paths: tuple[str, ...] = ()
    exclude_rules: frozenset[str] = field(default_factory=frozenset)
    fail_on: str = "critical"
    custom_patterns: tuple[Mapping[str, str], ...] = ()
    marker: str = DEFAULT_MARKER
    compat: bool = False

    def __post_init__(self):
        rules = self.exclude_rules
        object.__setattr__(self, "exclude_rules", frozenset([rules] if isinstance(rules, str) else rules or ()))
        object.__setattr__(self, "exclude_paths", tuple(self.exclude_paths or ()))
        object.__setattr__(self, "custom_patterns", tuple(self.custom_patterns or ()))
        if self.checks is not None:
            object.__setattr__(self, "checks", tuple(self.checks))
        severity_rank(self.severity_threshold)
        if self.fail_on.lower() != "none":
            severity_rank(self.fail_on)

    def custom_rules(self) -> tuple[Rule, ...]:
        return tuple(custom_rule(p, i, self.compat) for i, p in enumerate(self.custom_patterns))


def custom_rule(entry: Mapping[str, str], index: int = 0, compat: bool = False) -> Rule:
    """A user's pattern as a rule of the secrets check."""
    try:
        re.compile(entry["pattern"])
    except re.error as e:
        raise ValueError(f"custom pattern {entry['pattern']!r} is not a regular expression: {e}") from e
    rule_id = entry.get("rule_id") or "CUSTOM-001"
    known = RULE_BY_ID.get(rule_id)
    severity = (entry.get("severity") or "CRITICAL").upper()
    if compat or severity not in SEVERITY_RANK:
        severity = "CRITICAL"
    return Rule(
        rule_id, entry["pattern"], entry.get("description") or "Custom pattern",
        extensions=known.extensions if known else None,
        confidence=known.confidence if known else "HIGH",
        cwe=known.cwe if known else None,
        fix_hint=known.fix_hint if known else "",
        family="secrets", check="secrets", category="Secrets", severity=severity,
        remediation=SECRETS.remediation if compat else entry.get("remediation") or SECRETS.remediation,
        check_ord=0, rule_ord=CUSTOM_ORD + index, linear=False,
    )


def jvm_pattern(pattern: str) -> str | None:
    """JVM form of a pattern, or None where it must be matched by Python's own engine.

    That is the case for syntax the JVM lacks and for patterns that can match the empty string.
    """
    if _can_be_empty(pattern):
        return None
    try:
        return to_jvm(pattern)
    except UnsupportedPattern:
        return None


def _can_be_empty(pattern: str) -> bool:
    from re import _parser  # the only place that knows the least width of a pattern

    return _parser.parse(pattern).getwidth()[0] == 0
