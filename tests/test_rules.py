"""The catalog against Python's own engine and against its sample lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from auditlake.catalog.rules import ENTROPY_RULE, JS, RULE_BY_ID, RULES, select_rules
from auditlake.config import ScanConfig, custom_rule, jvm_pattern
from auditlake.operators.detect import detect, detect_entropy, detect_rules
from tests import brute
from workload.samples import NEGATIVE, POSITIVE, RANDOM32

EXTS = (".py", ".js", ".html", ".json", ".yaml", ".go", "")


def found(findings):
    rows = findings.collect()
    return {(r.file_path, r.rule_id): (r.line_number, r.match_count, r.code_snippet) for r in rows}


def ext_for(rule_id):
    rule = RULE_BY_ID.get(rule_id)
    return rule.extensions[0] if rule and rule.extensions else ".txt"


def test_catalog_shape():
    assert len(RULES) == 96 and len({r.rule_id for r in RULES}) == 96
    assert set(POSITIVE) == {r.rule_id for r in RULES} | {ENTROPY_RULE.rule_id}
    assert all(r.cwe for r in RULES)
    assert sum(r.in_history for r in RULES) == 17
    assert [r.rule_ord for r in RULES] == list(range(96))


def test_selection():
    assert {r.family for r in select_rules(["xss"])} == {"xss"}
    assert {r.family for r in select_rules(["injection"])} == {"sql", "command", "path_traversal", "xss", "nosql"}
    assert len(select_rules([])) == 96
    assert "SEC-001" not in {r.rule_id for r in select_rules(None, ["SEC-001"])}


def test_every_rule_finds_its_sample(corpus):
    files = {f"{rid}{ext_for(rid)}": f"first\n  {text}\nlast" if "\n" not in text and rid != "SEC-021" else f"first\n{text}\nlast"
             for rid, text in POSITIVE.items()}
    rows = found(detect(corpus(files)))
    for rid, text in POSITIVE.items():
        line, count, code = rows[f"{rid}{ext_for(rid)}", rid]
        assert (line, count, code) == (2, 1, text.split("\n")[0]), rid


def test_near_misses(corpus):
    files = {f"{rid}_{i}{ext_for(rid)}": text for rid, texts in NEGATIVE.items() for i, text in enumerate(texts)}
    rows = found(detect(corpus(files)))
    wrong = [k for k in rows if k[0].split("_")[0] == k[1]]
    assert wrong == []


def test_file_types(corpus):
    files = {f"{rid}_{ext or 'none'}{ext}": text for rid, text in POSITIVE.items() for ext in EXTS}
    rows = found(detect(corpus(files)))
    for rule in RULES:
        for ext in EXTS:
            expected = not rule.extensions or ext in rule.extensions
            assert ((f"{rule.rule_id}_{ext or 'none'}{ext}", rule.rule_id) in rows) == expected


def noise(seed):
    """Text of samples, fragments and awkward characters."""
    rng = random.Random(seed)
    samples = list(POSITIVE.values()) + [t for ts in NEGATIVE.values() for t in ts]
    odd = ["\r", "\x85", "\u2028", "\x1c", "\x0b", "\xe9", "\u0130", "\u0131", "\u017f", "\u212a", "e\u0301", "\U0001f600", "\u3000", "\xa0",
           "\x00", "\t"]
    glue = ["\n", " ", "\n\n", "", ")", "(", "+", "'", '"', "=", " # audit-ignore", " // audit-ignore SEC-008 INJ-021",
            " # audit-ignore\tDBG-002 JWT-004", "#audit-ignore", "# audit-ignore and why", "{", "}"]
    parts = []
    for _ in range(rng.randrange(5, 60)):
        text = rng.choice(samples)
        if rng.random() < 0.3:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(odd) + text[at:]
        if rng.random() < 0.2:
            text = text.swapcase()
        if rng.random() < 0.2:
            text = text.replace("s", "\u017f", 1).replace("k", "\u212a", 1).replace("i", "\u0131", 1)
        parts += [text, rng.choice(glue), rng.choice(glue)]
    return "".join(parts)


def test_same_as_python_engine(corpus):
    files = {f"d{i}/n{i}{EXTS[i % len(EXTS)]}": noise(i) for i in range(140)}
    files["edge.py"] = POSITIVE["INJ-010"] + "\n" + POSITIVE["AUTH-020"]
    files["edge.js"] = "\n" + POSITIVE["INJ-020"]
    files["mark.py"] = "\x01" + POSITIVE["INJ-010"] + "\x01 os.system('a')\n\ufdd0os.system()"
    files["empty.py"] = ""
    rows = found(detect_rules(corpus(files), RULES))
    assert rows == brute.rule_findings(files, RULES)


def test_entropy_same_as_python(corpus):
    values = [RANDOM32, "a" * 40, "abcdefghijklmnopqrstuvwxyz012345", "0123456789abcdef" * 2 + "aabbccdd", RANDOM32[:19],
              "abcdefghijklmnop" + "qqrrssttuuvvwwxx"]
    rng = random.Random(5)
    files = {}
    for i in range(40):
        lines = []
        for _ in range(12):
            name = rng.choice(["api_key", "API-SECRET", "bearer", "hmackey", "colour", "webhook_secret"])
            lines.append(rng.choice(["", "  "]) + f"{name} {rng.choice('=:')} '{rng.choice(values)}'"
                         + rng.choice(["", "", "  ", " # audit-ignore SEC-ENT", "; signing_key = \"" + RANDOM32 + '"']))
        files[f"f{i}.py"] = "\n".join(lines)
    rows = detect_entropy(corpus(files)).collect()
    expected = brute.entropy_findings(files)
    assert {(r.file_path, r.code_snippet): r.line_number for r in rows} == {(p, s[:100]): n for (p, s), n in expected.items()}
    assert len(rows) == len(expected)
    assert all(r.confidence == "MEDIUM" and "bits/char" in r.description for r in rows)


def test_exact_threshold_counts(corpus):
    # sixteen letters once and eight twice: exactly 4.5 bits
    value = "abcdefghijklmnop" + "qqrrssttuuvvwwxx"
    assert brute.entropy(value) == pytest.approx(4.5)
    assert detect_entropy(corpus({"a.py": f'api_key = "{value}"'})).count() == 1


def test_counts_and_descriptions(corpus):
    files = {"one.py": "os.system('a')", "three.py": "os.system('a'); os.system('b')\nos.system('c')",
             "some.py": "os.system('a') # audit-ignore INJ-010\nos.system('b') # audit-ignore SEC-001\nos.system('c') // audit-ignore"}
    rows = {r.file_path: r for r in detect(corpus(files)).filter(F.col("rule_id") == "INJ-010").collect()}
    assert "more in this file" not in rows["one.py"].description and rows["one.py"].match_count == 1
    assert rows["three.py"].description.endswith(" (and 2 more in this file)")
    assert (rows["some.py"].line_number, rows["some.py"].match_count) == (2, 1)


def test_dimensions(corpus):
    rows = detect(corpus({f"{r}{ext_for(r)}": t for r, t in POSITIVE.items()})).collect()
    for r in rows:
        assert r.cwe_id.startswith("CWE-") and r.owasp and r.confidence in ("HIGH", "MEDIUM", "LOW")
        assert r.severity_rank == {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2}[r.severity]
        assert r.fix_hint is not None


CUSTOM = [
    {"pattern": r"(?P<a>x)y\Z", "rule_id": "C-1"},
    {"pattern": r"a*", "rule_id": "C-2"},
    {"pattern": r"[^\S\n]z", "rule_id": "C-3"},
    {"pattern": r"{name}|q{,2}w", "rule_id": "C-4"},
    {"pattern": r"\bword\b", "rule_id": "C-5", "severity": "low", "remediation": "none"},
    {"pattern": r"(b)(?(1)c|d)", "rule_id": "C-6"},
]


def test_custom_patterns_same_as_python(corpus):
    files = {"a.txt": "word aaa xy\nwords bc {name} qqw\n\tz z\n sword", "b.txt": "", "c.txt": "xy\nqw bcbc\nword\x1cword\nxy"}
    config = ScanConfig(checks=("secrets",), custom_patterns=tuple(CUSTOM))
    rules = config.custom_rules()
    assert {r.rule_id for r in rules if jvm_pattern(r.pattern) is None} == {"C-2", "C-3", "C-6"}
    rows = {k: v for k, v in found(detect(corpus(files), config)).items() if k[1].startswith("C-")}
    assert rows == brute.rule_findings(files, rules)
    low = detect(corpus(files), config).filter(F.col("rule_id") == "C-5").first()
    assert (low.severity, low.remediation, low.category) == ("LOW", "none", "Secrets")
    old = ScanConfig(custom_patterns=tuple(CUSTOM), compat=True).custom_rules()
    assert {r.severity for r in old} == {"CRITICAL"}


def test_bad_custom_pattern_is_refused():
    with pytest.raises(ValueError):
        custom_rule({"pattern": "("})


def test_gates_never_hide_a_match():
    """Each pattern without its gate finds nothing more, on text built to match."""
    for rule in RULES + (ENTROPY_RULE,):
        text = POSITIVE[rule.rule_id]
        for variant in (text, text.swapcase(), text.upper()):
            if re.search(rule.pattern, variant, brute.FLAGS):
                low = variant.lower()
                assert not rule.gate or any(g in low for g in rule.gate), rule.rule_id
                assert all(n in low for n in rule.need), rule.rule_id
                assert not rule.near or re.search(rule.near, low), rule.rule_id


def test_result_does_not_depend_on_partitions(spark, corpus):
    files = corpus({f"n{i}{EXTS[i % 7]}": noise(i) for i in range(30)})
    one = sorted(map(tuple, detect(files.coalesce(1)).collect()))
    many = sorted(map(tuple, detect(files.repartition(13)).collect()))
    assert one == many


def test_no_shuffle_in_detection(corpus):
    plan = detect(corpus({"a.py": "x"}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "ArrowEvalPython" not in plan


def test_js_types_are_all_scanned():
    from auditlake.operators.select import SCANNABLE_EXTENSIONS

    assert set(JS) <= set(SCANNABLE_EXTENSIONS)


def test_a_pattern_runs_over_a_text_once(corpus):
    """Gates let a file through; the pattern then finds, locates and counts in one run, and may find nothing."""
    from auditlake.operators.detect import find_hits, may_match

    gated = [r for r in RULES + (ENTROPY_RULE,) if r.gate or r.need or r.near]
    assert len(gated) > 90 and not [r.rule_id for r in gated if "rlike(content" in may_match(r)]
    files = corpus({"a.txt": "the password, a token = secret key\nno match", "b.txt": "x\npassword = 'abc'\n\n'password': 'd'", "c.txt": ""})
    some = tuple(r for r in gated if r.rule_id in ("SEC-012", "SEC-021"))
    assert {(r.path, r.rule_ord) for r in find_hits(files, some).collect()} > {("a.txt", r.rule_ord) for r in some}
    assert found(detect_rules(files, some)) == {("b.txt", "SEC-012"): (2, 2, "password = 'abc'")}
