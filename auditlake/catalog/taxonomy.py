"""Severity, weakness and confidence dimensions shared by every detector."""

from __future__ import annotations

# Severity ranks, the order every threshold and grade is taken on.
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}

# Grade letter by highest severity rank present (0 = no finding).
GRADE_BY_RANK = {4: "F", 3: "D", 2: "C", 1: "B", 0: "A"}

# OWASP Top 10 (2021) categories.
OWASP_2021 = {
    "A01": "A01:2021 – Broken Access Control",
    "A02": "A02:2021 – Cryptographic Failures",
    "A03": "A03:2021 – Injection",
    "A05": "A05:2021 – Security Misconfiguration",
    "A07": "A07:2021 – Identification and Authentication Failures",
    "A08": "A08:2021 – Software and Data Integrity Failures",
    "A10": "A10:2021 – Server-Side Request Forgery",
}

# CWE number -> (CWE name, OWASP category code).
WEAKNESSES = {
    20: ("Improper Input Validation", "A03"),
    22: ("Path Traversal", "A01"),
    78: ("OS Command Injection", "A03"),
    79: ("Cross-site Scripting", "A03"),
    89: ("SQL Injection", "A03"),
    94: ("Code Injection", "A03"),
    215: ("Insertion of Sensitive Information Into Debugging Code", "A05"),
    306: ("Missing Authentication for Critical Function", "A01"),
    312: ("Cleartext Storage of Sensitive Information", "A02"),
    319: ("Cleartext Transmission of Sensitive Information", "A02"),
    327: ("Use of a Broken or Risky Cryptographic Algorithm", "A02"),
    338: ("Use of Cryptographically Weak Pseudo-Random Number Generator", "A02"),
    346: ("Origin Validation Error", "A05"),
    347: ("Improper Verification of Cryptographic Signature", "A02"),
    502: ("Deserialization of Untrusted Data", "A08"),
    521: ("Weak Password Requirements", "A07"),
    614: ("Sensitive Cookie Without 'Secure' Attribute", "A05"),
    693: ("Protection Mechanism Failure", "A05"),
    732: ("Incorrect Permission Assignment for Critical Resource", "A05"),
    798: ("Use of Hard-coded Credentials", "A02"),
    863: ("Incorrect Authorization", "A01"),
    916: ("Use of Password Hash With Insufficient Computational Effort", "A02"),
    918: ("Server-Side Request Forgery", "A10"),
    922: ("Insecure Storage of Sensitive Information", "A02"),
    943: ("Improper Neutralization of Special Elements in Data Query Logic", "A03"),
}


def weakness(cwe: int | None) -> tuple[str, str, str]:
    """(cwe_id, cwe_name, owasp) for a CWE number; blanks when there is none."""
    if cwe is None:
        return "", "", ""
    name, code = WEAKNESSES[cwe]
    return f"CWE-{cwe}", name, OWASP_2021[code]


def severity_rank(name: str) -> int:
    """Rank of a severity name in any letter case."""
    try:
        return SEVERITY_RANK[name.strip().upper()]
    except KeyError:
        raise ValueError(f"unknown severity {name!r}; use one of {sorted(SEVERITY_RANK)}") from None
