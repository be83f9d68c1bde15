"""Selection, settings, baselines, rollups and whole scans."""

import json

import pytest
from pyspark.sql import functions as F

from auditlake import ScanConfig, audit_dependencies, report_findings, scan, scan_by_project, summarize
from auditlake.operators import baseline as bl
from auditlake.operators import dependencies as dep
from auditlake.operators import rollup as ro
from auditlake.operators import select as se
from auditlake.operators.findings import min_severity, order_by_severity
from auditlake.operators.joins import join_bounded, skewed_join
from auditlake.operators.untracked import detect_untracked_env
from auditlake.plans.audit import gate_by_project
from auditlake.sources import settings as st
from workload.samples import POSITIVE


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_scannable_and_pruned(corpus):
    files = corpus({p: "" for p in ["a.py", "b.md", "c.TSX", ".env", ".env.local", "x/.envrc", "dist/a.py", "a/venv/b.py",
                                    "distant/a.py", "a.env", "Dockerfile", "env/.env", "a/.git/c.py", "vendor"]})
    assert paths(se.filter_scannable(se.prune_dirs(files))) == sorted(
        ["a.py", "c.TSX", ".env", ".env.local", "x/.envrc", "distant/a.py", "a.env"])


def test_exclude_paths(corpus):
    names = ["tests/a.py", "tests_util.py", "src/tests/a.py", "src/gen/x.js", "a/b.min.js"]
    files = corpus({p: "" for p in names})
    assert paths(se.exclude_paths(files, ["tests/"])) == ["a/b.min.js", "src/gen/x.js", "src/tests/a.py"]
    assert paths(se.exclude_paths(files, ["*.min.js", "gen/*"])) == ["src/tests/a.py", "tests/a.py", "tests_util.py"]
    assert paths(se.exclude_paths(files, ["/"])) == [] == paths(se.exclude_paths(files, [""]))
    assert paths(se.exclude_paths(files, [])) == sorted(names)


def test_changed(corpus, spark):
    before, after = corpus({"a.py": "1", "b.py": "1", "c.py": "1"}), corpus({"a.py": "1", "b.py": "2", "d.py": "1"})
    changed = se.changed_files(before, after)
    assert sorted((r.path, r.change) for r in changed.collect()) == [("b.py", "modified"), ("d.py", "added")]
    assert paths(se.restrict_to_changed(after, changed)) == ["b.py", "d.py"]
    assert paths(se.restrict_to_changed(after, changed.limit(0))) == []
    assert len(paths(se.restrict_to_changed(after, None))) == 3


def test_untracked_env(corpus):
    files = {("a", ".env"): "", ("a", "x/.env.prod"): "", ("a", "x/.env.example"): "", ("a", ".env.test"): "",
             ("a", "x/.envrc"): "", ("b", ".env"): "", ("b", ".gitignore"): ".env\n", ("c", "k/.env"): "",
             ("c", ".gitignore"): "# .env\n*.env\n", ("d", "k/.env"): "", ("d", ".gitignore"): "/k\n", ("e", "q/.env.a"): "",
             ("e", "sub/.gitignore"): "*", ("f", "q/.env.a"): "", ("f", ".gitignore"): "q/.env.?  \n"}
    rows = detect_untracked_env(corpus(files)).collect()
    assert sorted((r.project, r.file_path) for r in rows) == [("a", ".env"), ("a", "x/.env.prod"), ("d", "k/.env"), ("e", "q/.env.a")]
    assert {(r.rule_id, r.severity, r.line_number, r.cwe_id) for r in rows} == {("GIT-001", "CRITICAL", 1, "CWE-312")}


def test_settings(corpus):
    one = {"checks": ["auth"], "severity_threshold": "high", "exclude_paths": ["x/"], "exclude_rules": "A", "fail_on": "low",
           "custom_patterns": [{"pattern": "x"}]}
    files = {("a", ".audit.json"): json.dumps(one), ("b", ".audit.json"): "{", ("c", ".audit.json"): json.dumps({"exclude_rules": ["A", "B"]}),
             ("d", "sub/.audit.json"): json.dumps(one)}
    rows = {r.project: r for r in st.read_config(corpus(files)).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"].checks == ["auth"] and rows["a"].exclude_rules == ["A"] and rows["a"].custom_patterns[0].pattern == "x"
    assert (rows["b"].checks, rows["b"].severity_threshold, rows["b"].exclude_rules, rows["b"].fail_on) == (None, "low", [], "critical")
    assert rows["c"].exclude_rules == ["A", "B"]


def test_config_checks_values():
    with pytest.raises(ValueError):
        ScanConfig(severity_threshold="odd")
    assert ScanConfig(exclude_rules="SEC-001").exclude_rules == {"SEC-001"}
    assert ScanConfig(fail_on="none").fail_on == "none"


SOURCES = {("a", "m.py"): "os.system(x)\nDEBUG = True\n", ("a", "n.js"): "el.innerHTML = v", ("b", "m.py"): "DEBUG = True",
           ("c", "clean.py"): "x = 1", ("d", ".env"): "A=1", ("a", "build/gen.py"): "os.system(x)", ("e", "notes.md"): "os.system(x)",
           ("f", "k.py"): "c = DES(k)"}


def test_scan_and_summary(corpus):
    files = corpus(SOURCES)
    found = scan(files)
    assert sorted((r.project, r.rule_id) for r in found.collect()) == [
        ("a", "DBG-002"), ("a", "INJ-010"), ("a", "INJ-020"), ("b", "DBG-002"), ("d", "GIT-001"), ("f", "CRYPTO-001")]
    rows = {r.project: r for r in summarize(files, found).collect()}
    assert {p: r.grade for p, r in rows.items()} == {"a": "F", "b": "C", "c": "A", "d": "F", "f": "D"}
    assert {p: r.status for p, r in rows.items()} == {"a": "BLOCKED", "b": "REVIEW", "c": "PASSED", "d": "BLOCKED", "f": "ACTION"}
    assert (rows["a"].files_scanned, rows["a"].critical, rows["a"].high, rows["a"].medium) == (2, 1, 1, 1)
    gate = {r.project: r.failed for r in ro.quality_gate(summarize(files, found), "high").collect()}
    assert gate == {"a": True, "b": False, "c": False, "d": True, "f": True}
    assert not any(r.failed for r in ro.quality_gate(summarize(files, found), "none").collect())
    assert all(r.failed == (r.project != "c") for r in ro.quality_gate(summarize(files, found), "low").collect())


def test_scan_settings(corpus):
    files = corpus(SOURCES)
    assert {r.rule_id for r in scan(files, ScanConfig(checks=("debug",))).collect()} == {"DBG-002"}
    left = scan(files, ScanConfig(exclude_rules={"GIT-001", "DBG-002"}, exclude_paths=("n.js",)))
    assert {r.rule_id for r in left.collect()} == {"INJ-010", "CRYPTO-001"}
    assert min_severity(scan(files), "high").filter("severity = 'MEDIUM'").count() == 0
    ranks = [r.severity_rank for r in order_by_severity(scan(files)).collect()]
    assert ranks == sorted(ranks, reverse=True)


def test_scan_by_project(corpus):
    own = {("a", ".audit.json"): json.dumps({"checks": ["injection"], "exclude_rules": ["INJ-010"]}),
           ("b", ".audit.json"): json.dumps({"severity_threshold": "critical", "custom_patterns": [{"pattern": "D.BUG", "rule_id": "C-1"}]}),
           ("f", ".audit.json"): json.dumps({"exclude_paths": ["k.py"]})}
    files = corpus(SOURCES | own)
    rows = scan_by_project(files, st.read_config(files)).collect()
    assert sorted((r.project, r.rule_id, r.file_path) for r in rows if r.file_path != ".audit.json") == [
        ("a", "INJ-020", "n.js"), ("b", "C-1", "m.py"), ("d", "GIT-001", ".env")]


def test_baseline(corpus):
    first = scan(corpus({"a.py": "os.system(x)\n", "b.py": "eval(user)"}))
    shifted = scan(corpus({"a.py": "\n\n  os.system(x)\nexec(user)", "b.py": "eval(user)"}))
    known = bl.baseline_snapshot(first)
    new, suppressed = report_findings(shifted, "low", known)
    assert [r.rule_id for r in new.collect()] == ["INJ-013"]
    assert [tuple(r) for r in suppressed.collect()] == [("p", 2)]
    assert bl.split_by_baseline(shifted, known).groupBy("is_new").count().collect().__len__() == 2


def test_baseline_files(corpus):
    good = json.dumps({"version": 1, "fingerprints": ["a", "b", "a"], "findings": []})
    files = corpus({("p", ".audit-baseline.json"): good, ("q", ".audit-baseline.json"): "no json"})
    assert sorted(map(tuple, st.read_baseline(files).collect())) == [("p", "a"), ("p", "b")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_agree(spark, how):
    big = spark.range(200).select((F.col("id") % 3).alias("k"), "id", F.array(F.col("id")).alias("v"))
    small = spark.createDataFrame([(0, "x"), (1, "y"), (7, "z")], "k long, s string")
    plain = sorted(map(str, big.join(small, ["k"], how).collect()))
    assert sorted(map(str, skewed_join(big, small, ["k"], how).collect())) == plain
    assert sorted(map(str, join_bounded(big, small, ["k"], how).collect())) == plain
    assert sorted(map(str, join_bounded(big, small, ["k"], how, limit=1).collect())) == plain


def test_hot_keys_are_divided_by_size(spark):
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        big = spark.range(0, 60_000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("k"), F.sha1(F.col("id").cast("string").cast("binary")).alias("v"))
        joined = skewed_join(big, spark.range(0, 100).select(F.col("id").alias("k"), F.lit("x").alias("s")), ["k"], "left")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_version_order(spark):
    order = [("0", "0.0.1-alpha"), ("0.0.1-alpha", "0.0.1"), ("1.0.0-alpha", "1.0.0-beta"), ("1.0.0-beta", "1.0.0-rc.2"), ("1.0.0-rc.2", "1.0.0-rc.10"),
             ("1.0.0-rc.10", "1.0"), ("1.0.0rc1", "1.0.0"), ("1.0.dev3", "1.0"), ("1.0", "1.0.1"), ("1.2", "1.10"), ("9.9", "10.0.0b1"), ("10.0.0b1", "10")]
    same = [("1", "1.0.0"), ("^1.2.0", "1.2"), ("~1.2", ">=1.2"), ("v1.2", "==1.2.0"), ("1.2+build5", "1.2")]
    rows = spark.createDataFrame([(*p, True) for p in order] + [(*p, False) for p in same], "a string, b string, less boolean")
    got = rows.select("a", "b", "less", (dep.version_key(F.col("a")) < dep.version_key(F.col("b"))).alias("lt"), (dep.version_key(F.col("a")) == dep.version_key(F.col("b"))).alias("eq")).collect()
    assert [(r.a, r.b) for r in got if (r.lt, r.eq) != (r.less, not r.less)] == []


def test_version_ranges(spark):
    ranges = [[{"fixed": "1.0.0"}, {"introduced": "0"}], [{"last_affected": "2.5"}, {"introduced": "2.0.0-rc.1"}, {"fixed": "3.1"}, {"introduced": "3"}]]
    want = {"0.5": True, "^0.9": True, "1.0.0-rc1": True, "1.0.0": False, "~1.4": False, "2.0.0-beta": False, "2.0.0-rc.2": True, ">=2.5": True, "2.5.1": False,
            "3.0.9": True, "3.1": False, "latest": False, "*": False, "": False, None: False}
    event = "struct<introduced: string, fixed: string, last_affected: string>"
    rows = spark.createDataFrame([(v, ranges) for v in want], f"v string, r array<array<{event}>>")
    got = {r.v: r.hit for r in rows.select("v", dep.in_ranges(F.col("v"), F.col("r")).alias("hit")).collect()}
    assert got == want


HOSTILE = {
    "a": '{"custom_patterns": [{"pattern": "(?P<api_key>tok_[a-z]+)-(?P=api_key)", "rule_id": "NAMED"}]}',
    "b": '{"exclude_paths": [null, 3, {"x": 1}], "exclude_rules": [null], "checks": null}',
    "c": '{"custom_patterns": [null, {"pattern": null}, {"pattern": "("}, 5, {"pattern": "(?<=x|yy)z"}, {"rule_id": "NO-PATTERN"}]}',
    "d": "[]", "e": "{", "f": '"text"', "g": '{"exclude_paths": "src", "custom_patterns": "x", "checks": "secrets", "fail_on": 4, "baseline": ["x"]}',
    "h": '{"custom_patterns": [{"pattern": "(?P<n>q)?(?(n)w|v)x", "rule_id": "PYTHON"}]}',
}


def test_bad_settings_stop_nothing(corpus):
    text = f"tok_ab-tok_ab\nqwx vx\n{POSITIVE['SEC-001']}\n"
    files = corpus({(p, n): t for p, s in [*HOSTILE.items(), ("plain", "{}")] for n, t in ((".audit.json", s), ("src/x.py", text))})
    got = scan_by_project(files, st.read_config(files)).collect()
    by = {p: sorted(r.rule_id for r in got if r.project == p and r.file_path == "src/x.py") for p in [*HOSTILE, "plain"]}
    assert by.pop("a") == ["NAMED", "SEC-001"] and by.pop("h") == ["PYTHON", "SEC-001"]
    assert set(map(tuple, by.values())) == {("SEC-001",)}
    assert gate_by_project(files, st.read_config(files)).count() == 9


def test_run_settings_hold_for_every_project(corpus):
    files = corpus({("p", ".env"): "A=1", ("p", "x.py"): f"tok_1\n{POSITIVE['SEC-001']}", ("p", ".audit.json"): '{"custom_patterns": [{"pattern": "tok_[0-9]", "rule_id": "TOK", "severity": "low"}]}'})
    rules = lambda **kw: sorted({(r.rule_id, r.severity) for r in scan_by_project(files, st.read_config(files), ScanConfig(**kw)).collect()})
    every = rules()
    assert [r for r, _ in every] == ["GIT-001", "SEC-001", "TOK"] and ("TOK", "LOW") in every
    assert [r for r, _ in rules(exclude_rules={"GIT-001", "TOK"})] == ["SEC-001"]
    assert rules(checks=("xss",)) == []
    assert ("TOK", "CRITICAL") in rules(compat=True)


def test_gate_by_project(corpus):
    key, weak = POSITIVE["SEC-001"], "h = hashlib.md5(x)"
    base = corpus({("p", "x.py"): key})
    known = [r.fingerprint for r in scan(base).collect()]
    settings = {"p": '{"baseline": "ci/known.json"}', "q": '{"fail_on": "none"}', "r": '{"fail_on": "high"}', "s": "{}", "t": '{"fail_on": "LOW"}'}
    files = {(p, ".audit.json"): s for p, s in settings.items()} | {(p, "x.py"): key for p in "pqs"} | {("r", "x.py"): weak, ("t", "x.py"): "x = 1", ("u", "x.py"): key}
    files[("p", "ci/known.json")] = json.dumps({"version": 1, "fingerprints": known, "findings": []})
    got = {r.project: (r.findings > 0, r.failed) for r in gate_by_project(corpus(files), st.read_config(corpus(files))).collect()}
    assert {p: got[p][1] for p in "pqstu"} == {"p": False, "q": False, "s": True, "t": False, "u": True}
    assert got["p"] == (False, False) and got["q"][0] and got["r"][0]


def test_manifests_are_read_once(spark, tmp_path):
    rows = [("p", "requirements.txt", "requets==1\nflask"), ("p", "web/package.json", '{"dependencies": {"lodahs": "*"}}'), ("q", "x.py", "x")]
    spark.createDataFrame(rows, "project string, path string, content string").write.parquet(f"{tmp_path}/corpus")
    found = audit_dependencies(spark.read.parquet(f"{tmp_path}/corpus"))
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted({r.package for r in found.collect()}) == ["lodahs", "requets"]


def test_dependencies_of_a_corpus(corpus, spark):
    files = corpus({
        "requirements.txt": "Requests==2.0\nflask[async]>=1\n\n# x\n-e .\nhuggingface-cli\nrequests==3.0\na.b==1\nsp >= 1\nreqeusts",
        "sub/requirements-dev.txt": "sklearn\r\ntensorflow-gpu\n", "pyproject.toml": "[project]\ndependencies = [\n 'crypto>=1',\n \"pandas-utils\"\n]\ndependencies = ['cv2']",
        "web/package.json": json.dumps({"dependencies": {"Lodahs": "1", "react-utils": "*"}, "devDependencies": {"lodahs": "latest", "ok": ""}}),
        "node_modules/x/package.json": json.dumps({"dependencies": {"lodahs": "*"}}), "bad/package.json": "{", "x/.venv/requirements.txt": "requets",
        "requirements.md": "requets",
    })
    rows = audit_dependencies(files).collect()
    got = sorted((r.file_path, r.package, r.issue_type, r.version) for r in rows)
    assert got == sorted([
        ("requirements.txt", "huggingface-cli", "hallucinated", None), ("requirements.txt", "reqeusts", "typosquat", None),
        ("sub/requirements-dev.txt", "sklearn", "typosquat", None), ("sub/requirements-dev.txt", "tensorflow-gpu", "typosquat", None),
        ("pyproject.toml", "crypto", "typosquat", None), ("pyproject.toml", "pandas-utils", "hallucinated", None),
        ("web/package.json", "lodahs", "typosquat", None), ("web/package.json", "react-utils", "hallucinated", None),
        ("web/package.json", "lodahs", "suspicious", "latest"), ("web/package.json", "react-utils", "suspicious", "*"),
        ("web/package.json", "ok", "suspicious", "")])
    from auditlake.sources.manifests import read_packages

    packages = {(r.path, r.name): r.version for r in read_packages(files).collect()}
    assert packages["requirements.txt", "requests"] == "3.0" and packages["requirements.txt", "flask"] == "1"
    assert packages["requirements.txt", "a"] is None and packages["requirements.txt", "sp"] is None


def test_advisory_entries_of_one_package_are_merged(spark):
    from auditlake.operators.dependencies import match_advisories
    from auditlake.sources.advisories import advisories_from_json, read_advisories

    def entry(name, eco="PyPI", **more):
        return {"package": {"ecosystem": eco, "name": name}, **more}

    gap = [{"type": "SEMVER", "events": [{"introduced": "2"}, {"fixed": "2.5"}]}, {"type": "GIT", "events": [{"introduced": "0"}]}]
    record = {"id": "X-1", "aliases": ["CVE-1"], "affected": [entry("Lib", versions=["1.0"]), entry("lib", versions=["1.1"], ranges=gap), entry("lib", "npm")]}
    table = read_advisories(advisories_from_json(spark.createDataFrame([(json.dumps(record),), ('{"id": "X-2"}',)], "payload string")))
    assert table.count() == 2
    rows = [("p", f"r{i}.txt", "python", "lib", "lib", v, 0) for i, v in enumerate(["1.0", "1.1", "1.2", "2.2", None])]
    packages = spark.createDataFrame(rows, "project string, path string, ecosystem string, name string, original string, version string, pos int")
    assert sorted(r.file_path for r in match_advisories(packages, table).collect()) == ["r0.txt", "r1.txt", "r4.txt"]
    assert sorted(r.file_path for r in match_advisories(packages, table, ranges=True).collect()) == ["r0.txt", "r1.txt", "r3.txt", "r4.txt"]


def test_version_ranges(spark):
    from auditlake.operators.dependencies import in_ranges

    spec = "v string, e array<array<struct<introduced:string,fixed:string,last_affected:string>>>"
    between = [("1.2", None, None), (None, "1.10.0", None)]
    upto = [("0", None, None), (None, None, "0.1")]
    cases = [("1.2", [between], True), ("1.9.9", [between], True), ("1.10", [between], False), ("1.1", [between], False), ("1.2.0", [between], True),
             ("2.0", [between + [("2", None, None)]], True), ("0.1", [upto], True), ("0.2", [upto], False), ("v1.3-rc1", [between], True),
             ("1.5", [between, upto], True), ("1.5", [upto, between], True), ("0.5", [between, upto], False), ("1", [], False), ("1", None, False)]
    df = spark.createDataFrame([(v, e) for v, e, _ in cases], spec)
    assert [r[0] for r in df.select(in_ranges(F.col("v"), F.col("e"))).collect()] == [c[2] for c in cases]
