"""Patterns that walk a text once, against Python's engine and on long hostile lines."""

import random
import re
import time

import pytest

from auditlake.catalog.rules import RULES
from auditlake.functions.dialect import to_jvm
from auditlake.operators.detect import detect_rules
from tests import brute

ONE_PASS = tuple(r for r in RULES if r.scanned[1])

#: Beginnings that a plain form would start from again and again, and text that lets the cheap tests pass.
HOSTILE = {
    "INJ-001": ("execute('x ", "\n%s"), "INJ-003": ("execute('x ", "\n+"), "INJ-004": ("cursor.execute( ", "\n,+"), "INJ-005": (".query(`x ", "\n${"),
    "INJ-006": ("where + from + select select ", ""), "INJ-011": ("subprocess.run( ", "\n)shell"), "INJ-015": ("subprocess.run( ", "\n[+"),
    "INJ-025": ("{{{ x ", "\n}}}"), "INJ-032": ("$where x ", ""), "AUTH-020": ("@app.route( ", "def"), "AUTH-021": ("router.get( ", "=>"),
    "CRYPTO-010": ("random.randint( ", ""), "CRYPTO-011": ("Math.random() x ", ""), "CRYPTO-012": ("random.choice( ", ""), "CLOUD-011": ("Access-Control-Allow-Origin x ", "\n*"),
    "CLOUD-021": ("BlockPublicAccess x ", ""), "DATA-010": ("json.loads( ", "\nrequest"), "DBG-001": ("app.run( ", "\n)debug"), "DBG-004": ("console.log( ", ""),
    "DBG-005": ("print( ", ""), "SSRF-001": ("requests.get( ", ""), "SSRF-002": ("urllib.request.urlopen( ", ""), "JWT-004": ("HS256HS ", ""),
}


def fragments(rule):
    """Pieces of a rule's pattern, to build texts that nearly match."""
    words = re.findall(r"[A-Za-z_$@.]{2,}", re.sub(r"\\[sSwdbB]", " ", rule.pattern).replace("\\", ""))
    return [w.strip(".") or w for w in words] + [r"(", ")", "\n", " ", "'", '"', "+", "%s", "%", "{{{", "}}}", "${", "`", ",", "[", "=", "True", "False", ":", "*", "shell=True", " \n ", "=>", "def f"]


@pytest.mark.parametrize("seed", range(2))
def test_same_matches_as_python(corpus, seed):
    rng = random.Random(seed)
    files = {}
    for rule in ONE_PASS:
        ext = rule.extensions[0] if rule.extensions else ".txt"
        pieces = fragments(rule)
        from workload.samples import POSITIVE

        for k in range(12):
            parts = [POSITIVE[rule.rule_id] if rng.random() < 0.08 else rng.choice(pieces) for _ in range(rng.randint(5, 90))]
            files[f"{rule.rule_id}-{k}{ext}"] = "".join(parts)
    rows = detect_rules(corpus(files), ONE_PASS).collect()
    got = {(r.file_path, r.rule_id): (r.line_number, r.match_count, r.code_snippet) for r in rows}
    want = brute.rule_findings(files, ONE_PASS)
    assert len(want) > 100 and {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {} and set(got) == set(want)


@pytest.mark.parametrize("rule", [r for r in ONE_PASS if r.rule_id in HOSTILE], ids=lambda r: r.rule_id)
def test_long_hostile_lines(spark, rule):
    """Two megabytes of beginnings, in the engine that Spark uses."""
    unit, rest = HOSTILE[rule.rule_id]
    text = unit * (2_000_000 // len(unit)) + rest
    matcher = spark._jvm.java.util.regex.Pattern.compile(to_jvm(rule.scanned[0])).matcher(text)
    start = time.perf_counter()
    matcher.find()
    assert time.perf_counter() - start < 5  # some tenths of a second on an idle machine; minutes for a plain form
