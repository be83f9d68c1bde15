"""Profiles, documents, source trees and streams."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from auditlake import ScanConfig, profile_projects, read_corpus, read_tree, scan, summarize
from auditlake.operators import select as se
from auditlake.operators.detect import detect
from auditlake.operators.durable import checkpoint_folder, durable
from auditlake.operators.rollup import files_scanned
from auditlake.sinks import documents as doc
from auditlake.sinks import report as rp
from auditlake.sources import advisories as adv
from auditlake.sources.settings import load_baseline, read_baseline
from auditlake.streaming.scan import stream_new_findings, stream_scan, stream_severity_windows
from workload.samples import POSITIVE, RANDOM32


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="auditlake-test-")


def profile(corpus, files):
    return profile_projects(corpus(files)).first()


@pytest.mark.parametrize("files, kind", [
    ({"package.json": "{}", "next.config.js": ""}, "next.js"), ({"package.json": "{}", "a/App.vue": ""}, "vue"),
    ({"sub/package.json": "{}"}, "node.js"), ({"requirements.txt": "", "x/settings.py": ""}, "django"),
    ({"pyproject.toml": "", "app.py": ""}, "flask/fastapi"), ({"pyproject.toml": ""}, "python"), ({"Gemfile": ""}, "ruby/rails"),
    ({"build.gradle": ""}, "java"), ({"go.mod": ""}, "go"), ({"Cargo.toml": ""}, "rust"), ({"a.c": ""}, "unknown"),
    ({"node_modules/package.json": "{}", "go.mod": ""}, "go"),
])
def test_project_types(corpus, files, kind):
    assert profile(corpus, files).project_type == kind


def test_profile_lists(corpus):
    p = profile(corpus, {"requirements.txt": "Flask\npsycopg2\nboto3", "app.py": "", "web/x.TSX": "", ".cursorrules": "", "b.rb": ""})
    assert p.frameworks == ["flask"] and p.databases == ["postgresql"] and p.cloud_services == ["aws"]
    assert p.languages == ["Python", "Ruby", "TypeScript/React"] and p.ai_tool_indicators == ["cursor"]
    assert p.recommended_checks == ["secrets", "injection", "xss", "auth", "cors", "cloud", "data"]
    q = profile(corpus, {"lovable.json": "", "urls.py": ""})
    assert q.frameworks == ["django"] and q.recommended_checks == ["cloud", "secrets", "xss", "auth", "cors", "crypto", "data"]
    late = profile(corpus, {"package.json": "x" * 5000 + "redis", "sub/requirements.txt": "redis"})
    assert late.databases == ["redis"]


def written(spark, lines, folder):
    """Document per project, from its files in name order."""
    doc.write_documents(lines, folder)
    out = {}
    for entry in sorted(os.listdir(folder)):
        if entry.startswith("project="):
            parts = sorted(f for f in os.listdir(f"{folder}/{entry}") if f.startswith("part-"))
            out[entry[8:]] = "".join(open(f"{folder}/{entry}/{f}", encoding="utf-8").read() for f in parts)
    return out


FILES = {("a", "m.py"): "password = 'hunter22222'\nos.system(x)\nos.system(y)", ("a", "n\\o.js"): "el.innerHTML = \"v\"", ("b", "clean.py"): "x = 1"}


def test_findings_document(spark, corpus, folder):
    files = corpus(FILES)
    found = scan(files)
    docs = {p: json.loads(t) for p, t in written(spark, doc.findings_json(found, summarize(files, found)), folder).items()}
    assert docs["b"] == {"files_scanned": 1, "total_findings": 0, "suppressed_by_baseline": 0, "grade": "A", "critical": 0,
                         "high": 0, "medium": 0, "low": 0, "findings": []}
    a = docs["a"]
    assert a["grade"] == "F" and a["total_findings"] == 3 == len(a["findings"])
    assert [f["rule_id"] for f in a["findings"]] == ["SEC-012", "INJ-010", "INJ-020"]
    assert a["findings"][0]["snippet"] == "password = '****'"
    assert set(a["findings"][0]) == {"rule_id", "severity", "category", "description", "file", "line", "snippet", "remediation",
                                     "cwe_id", "cwe_name", "owasp", "fix_hint", "confidence"}


def test_documents_keep_equal_rows(spark, corpus, folder):
    files = corpus(FILES)
    found = scan(files)
    twice = found.unionByName(found).unionByName(found)
    docs = {p: json.loads(t) for p, t in written(spark, doc.findings_json(twice, summarize(files, twice)), folder).items()}
    assert [f["rule_id"] for f in docs["a"]["findings"]] == ["SEC-012"] * 3 + ["INJ-010"] * 3 + ["INJ-020"] * 3


def test_sarif_document(spark, corpus, folder):
    files = corpus(FILES | {("a", "z.py"): "os.system(1)"})
    found = scan(files)
    docs = {p: json.loads(t) for p, t in written(spark, doc.sarif(found, files_scanned(files).select("project")), folder).items()}
    run = docs["a"]["runs"][0]
    assert docs["a"]["version"] == "2.1.0" and len(docs["a"]["runs"]) == 1
    ids = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert ids == ["SEC-012", "INJ-010", "INJ-020"] and len(run["results"]) == 4
    rule = run["tool"]["driver"]["rules"][1]
    assert rule["name"] == "Command run through os.system" and "(and" not in rule["shortDescription"]["text"]
    assert rule["helpUri"].endswith("/78.html") and rule["properties"]["tags"] == ["CWE-78", "A03:2021"]
    assert rule["defaultConfiguration"]["level"] == "error"
    uris = {r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in run["results"]}
    assert uris == {"m.py", "n/o.js", "z.py"}
    assert docs["b"]["runs"][0]["results"] == []


def test_baseline_round_trip(spark, corpus, folder):
    files = corpus(FILES)
    found = detect(files)
    docs = written(spark, doc.baseline_json(found, files_scanned(files)), f"{folder}/json")
    back = read_baseline(spark.createDataFrame([(p, ".audit-baseline.json", t) for p, t in docs.items()], "project string, path string, content string"))
    prints = sorted((r.project, r.fingerprint) for r in found.collect())
    assert sorted(map(tuple, back.collect())) == prints
    doc.write_baseline(found, f"{folder}/table")
    assert sorted(map(tuple, load_baseline(spark, f"{folder}/table").collect())) == prints


def test_problem_lines(corpus):
    rows = [r.text for r in doc.problem_lines(detect(corpus({"a.py": "x\nDEBUG = True\nos.system(x)"}))).collect()]
    assert sorted(rows) == ["a.py:2: warning: [DBG-002] DEBUG flag set to True", "a.py:3: error: [INJ-010] Command run through os.system"]


def test_report(corpus, spark):
    files = corpus(FILES | {("a", "requirements.txt"): "requets\n"})
    from auditlake import audit_dependencies

    found = scan(files)
    external = adv.ingest_semgrep(spark.createDataFrame([("a", '{"results":[{"check_id":"r<1>","path":"x.py","start":{"line":3}}]}')], "project string, payload string"))
    sections = rp.report_sections(found, summarize(files, found), audit_dependencies(files), profile_projects(files), external)
    rows = [r.text for r in sections.filter("project = 'a'").orderBy("section", "ord", "key").collect()]
    assert rows[0] == "Deployment blocked, critical findings: 2"
    assert "Dependencies: 1" in rows and "Type: python" in rows and any("r<1>" in r for r in rows)
    assert not any("hunter" in r for r in rows)
    escaped = [r.text for r in rp.html_sections(sections).collect()]
    assert any("r&lt;1&gt;" in t for t in escaped)


def test_audit_reports(spark):
    def rows(fn, text):
        return fn(spark.createDataFrame([("p", text)], "project string, payload string")).collect()

    pip = rows(adv.ingest_pip_audit, '[{"name":"a","version":"1","vulns":[{"id":"X"},{"id":"Y"}]},{"name":"b"},{"name":"c","vulns":[]}]')
    assert [(r.package, r.cve_id) for r in pip] == [("a", "X"), ("a", "Y"), ("b", "Unknown")]
    npm = rows(adv.ingest_npm_audit, '{"vulnerabilities":{"a":{"via":["b","c"]},"d":{"severity":"low","via":[]},"e":{"via":[{"title":"t"},"x",{"source":1}],"range":"<2"}}}')
    assert [(r.package, r.severity, r.version, r.description) for r in npm] == [
        ("a", "HIGH", None, "['b', 'c'] (via npm audit)"), ("d", "LOW", None, "Security vulnerability (via npm audit)"), ("e", "HIGH", "<2", "t (via npm audit)"), ("e", "HIGH", "<2", "Security vulnerability (via npm audit)")]
    assert rows(adv.ingest_pip_audit, "broken") == [] == rows(adv.ingest_npm_audit, "broken")


def test_source_tree(spark, folder):
    files = {"a/.env": b"X=1\r\n", "a/__init__.py": b"\xffok", "a/deep/er/_x.py": b"y", "b/m.py": b"z", "b/node_modules/n.py": b"n", "top.txt": b"t", "c/empty.py": b""}
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}") or folder, exist_ok=True)
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    rows = sorted(map(tuple, read_tree(spark, folder, skip=("node_modules",)).collect()))
    assert rows == [("a", ".env", "X=1\n"), ("a", "__init__.py", "ok"), ("a", "deep/er/_x.py", "y"), ("b", "m.py", "z"), ("c", "empty.py", "")]
    single = sorted((r.project, r.path) for r in read_tree(spark, f"{folder}/a", layout="single").collect())
    assert single == [("a", ".env"), ("a", "__init__.py"), ("a", "deep/er/_x.py")]


def test_read_corpus(spark, folder):
    spark.createDataFrame([("p", "a.py", bytearray(b"x\r\n\xff"))], "project string, path string, content binary").write.parquet(f"{folder}/b")
    spark.createDataFrame([("p", "a.py", "x\ry")], "project string, path string, content string").write.json(f"{folder}/t")
    assert read_corpus(spark, f"{folder}/b").first().content == "x\n"
    assert read_corpus(spark, f"{folder}/t", "json").first().content == "x\ny"


def test_scan_reads_little(spark, folder):
    rows = [("p", "a.py", "a.py", ".py", "x"), ("p", "b.md", "b.md", ".md", "y")]
    spark.createDataFrame(rows, "project string, path string, name string, ext string, content string").write.parquet(folder + "/f")
    files = read_corpus(spark, folder + "/f")
    plan = detect(files.transform(se.filter_scannable))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(In(ext" in plan
    names = profile_projects(files)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<project:string,path:string>" in names


def test_checkpoints_use_the_named_folder(spark):
    from types import SimpleNamespace

    def session(master, named):
        return SimpleNamespace(conf={"spark.checkpoint.dir": named} if named else {}, sparkContext=SimpleNamespace(master=master))

    assert checkpoint_folder(session("spark://host", "/shared/c")) == "/shared/c"
    with pytest.raises(RuntimeError):
        checkpoint_folder(session("spark://host", None))
    assert checkpoint_folder(session("local[2]", None))
    assert durable(spark.range(3)).count() == 3


def run(stream, folder, mode="append"):
    out = f"{folder}/out"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    q = w.format("parquet").start(out) if mode == "append" else w.foreachBatch(lambda d, _: d.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out).collect()


def test_streams(spark, folder):
    """Versions arrive in three batches: a repeat, a new finding, a known one."""
    layout = "project string, path string, content string, ts timestamp"

    def arrive(n, rows):
        spark.createDataFrame(rows, "project string, path string, content string, t string").withColumn(
            "ts", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.mode("append").parquet(f"{folder}/in/b{n}")

    arrive(1, [("p", "a.py", "os.system(x)", "2024-01-01 00:10:00"), ("p", "known.py", "eval(user)", "2024-01-01 00:20:00")])
    source = spark.readStream.schema(layout).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    known = detect(spark.createDataFrame([("p", "known.py", "eval(user)")], "project string, path string, content string"))
    new = stream_new_findings(stream_scan(source), known)
    assert [(r.file_path, r.rule_id) for r in run(new, f"{folder}/new")] == [("a.py", "INJ-010")]
    arrive(2, [("p", "a.py", "\n\nos.system(x)", "2024-01-01 00:40:00"), ("p", "b.py", "DEBUG = True", "2024-01-01 01:10:00")])
    assert sorted((r.file_path, r.rule_id) for r in run(new, f"{folder}/new")) == [("a.py", "INJ-010"), ("b.py", "DBG-002")]
    counts = run(stream_severity_windows(stream_scan(source, ScanConfig(checks=("injection",)))), f"{folder}/w", "complete")
    assert sorted((r.window_start.hour, r.severity, r.findings) for r in counts) == [(0, "CRITICAL", 3)]


def test_registered_queries_have_stable_names():
    import __spark_entry__ as e
    from workload.queries import BUILDS, SQL

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 85
    assert set(BUILDS) == set(SQL) and set(BUILDS) <= set(queries) and set(SQL) <= set(oracles)


@pytest.mark.parametrize("name", [
    "corpus_scannable", "detect_auth", "detect_https", "detect_entropy", "detect_untracked_env", "normalize_text", "parse_commit_log",
    "parse_requirements", "flag_typosquat", "match_advisories", "profile_indicators", "severity_counts", "mask_secret",
])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    import __spark_entry__ as e
    from check import TABLES, rows_of

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("tables not present")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = e.queries()[name](spark, folder)
    rel = db.sql(e.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


def test_samples_are_fixed():
    assert len(RANDOM32) == 32 and "SEC-ENT" in POSITIVE


def grow(root, files):
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/new.tmp", "w") as f:
            f.write(data)
        os.rename(f"{root}/new.tmp", f"{root}/{name}")


def test_tree_opens_only_what_is_asked_for(spark, folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, In, StringContains, StringStartsWith

    from auditlake.sources import tree

    grow(folder, {f"{p}/{d}/f{k}{e}": "x" for p in "abc" for d in ("src/in", "src", "doc") for k in range(3) for e in (".py", ".md")})
    entered, scan = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: (entered.append(os.path.relpath(path, folder)), scan(path))[1])
    reader = tree.TreeReader({"path": folder})
    rest = list(reader.pushFilters([EqualTo(("project",), "b"), StringStartsWith(("path",), "src/"), In(("ext",), (".py",)), StringContains(("name",), "1")]))
    assert rest == [StringContains(("name",), "1")]
    rows = sorted(r[1] for part in reader.partitions() for r in reader.read(part))
    assert rows == [f"src/f{k}.py" for k in range(3)] + [f"src/in/f{k}.py" for k in range(3)]
    assert set(entered) == {"b", "b/src", "b/src/in"}
    monkeypatch.undo()
    some = read_tree(spark, folder, where="project in ('a', 'b') and path like 'doc/%' and ext = '.md' and name <> 'f1.md'")
    assert sorted((r.project, r.path) for r in some.collect()) == [(p, f"doc/f{k}.md") for p in "ab" for k in (0, 2)]
    assert "f1.md" in (plan := some._jdf.queryExecution().executedPlan().toString()) and "(project" not in plan.split("BatchScan")[0].split("Filter")[-1]


def test_wide_directories_are_shared(folder, monkeypatch):
    from auditlake.sources import tree

    grow(folder, {f"a/f{k}.py": "x" for k in range(60)} | {f"a/d{k}/g.py": "x" for k in range(30)})
    monkeypatch.setattr(tree, "WIDE", 20)
    reader = tree.TreeReader({"path": folder})
    parts = reader.partitions()
    assert sum(len(p.folders) for p in parts) == 1 + tree.LEAST_PARTITIONS
    rows = [r[1] for part in parts for r in reader.read(part)]
    assert len(rows) == len(set(rows)) == 90


def test_stream_of_a_tree(spark, folder):
    """What arrives between runs comes out once, also after a restart and after a mark that Spark never heard of."""
    from auditlake.sources.tree import TreeStreamReader, stream_tree

    root, own = f"{folder}/tree", f"{folder}/own"
    grow(root, {"p/a.py": "one", "p/node_modules/x.py": "skipped"})

    def arrived():
        stream = stream_tree(spark, root, f"{own}/marks", skip=("node_modules",))
        stream.writeStream.option("checkpointLocation", f"{own}/state").trigger(availableNow=True).format("parquet").start(f"{own}/out").awaitTermination()
        return sorted((r.path, r.content) for r in spark.read.schema(stream.schema).parquet(f"{own}/out").collect())

    assert arrived() == [("a.py", "one")]
    assert arrived() == [("a.py", "one")]
    grow(root, {"p/b.py": "two", "p/a.py": "one more"})
    reader = TreeStreamReader({"path": root, "marks": f"{own}/marks", "skip": "node_modules"})
    assert reader.latestOffset() == {"listing": 2}  # listed, then the driver is lost
    grow(root, {"q/c.py": "three"})
    assert arrived() == [("a.py", "one"), ("a.py", "one more"), ("b.py", "two"), ("c.py", "three")]


def test_files_that_cannot_be_read_are_no_empty_files(spark, folder):
    """A file that is listed but can't be opened fails the batch; it comes out whole once it can. Links to directories are no files."""
    import pandas as pd

    from auditlake.sources.tree import Tree, _read_files, _reader, stream_tree

    root, own = f"{folder}/tree", f"{folder}/own"
    grow(root, {"p/a.py": "one", "p/empty.py": "", "q/b.py": "two"})
    os.symlink(f"{root}/q", f"{root}/p/link")
    assert sorted(Tree({"path": root}).files(root, True)) == [f"{root}/p/a.py", f"{root}/p/empty.py", f"{root}/q/b.py"]
    assert sorted((r.path, r.content) for r in read_tree(spark, root).collect()) == [("a.py", "one"), ("b.py", "two"), ("empty.py", "")]
    for bad in (f"{root}/p/gone.py", f"{root}/q"):
        with pytest.raises(OSError):
            list(_read_files(iter([pd.DataFrame({"project": ["p"], "path": ["x"], "file": [bad]})])))

    def arrived():
        stream = stream_tree(spark, root, f"{own}/marks")
        stream.writeStream.option("checkpointLocation", f"{own}/state").trigger(availableNow=True).format("parquet").start(f"{own}/out").awaitTermination()
        return sorted((r.path, r.content) for r in spark.read.schema(stream.schema).parquet(f"{own}/out").collect())

    os.makedirs(f"{own}/marks")
    with open(f"{own}/marks/000000001.json", "w") as f:  # listed before, gone when it is read
        json.dump({f"{root}/p/late.py": [1_000_000_000, 4]}, f)
    with pytest.raises(Exception, match="late.py"):
        arrived()
    spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
    try:
        left = read_tree(spark, root).collect()
        assert [tuple(r) for r in _reader(spark)(iter([pd.DataFrame({"file": [f"{root}/p/a.py", f"{root}/p/gone.py"]})])).__next__().itertuples(index=False)] == [(f"{root}/p/a.py", b"one")]
    finally:
        spark.conf.unset("spark.sql.files.ignoreMissingFiles")
    assert len(left) == 3
    grow(root, {"p/late.py": "late"})
    assert [r for r in arrived() if r[0] == "late.py"] and ("late.py", "") not in arrived()


def test_life_of_findings(spark, folder):
    from auditlake.streaming.life import finding_life

    layout = "project string, path string, content string, ts timestamp"

    def arrive(n, rows):
        df = spark.createDataFrame(rows, "project string, path string, content string, t string")
        df.withColumn("ts", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.mode("append").parquet(f"{folder}/in/b{n}")
        stream = finding_life(spark.readStream.schema(layout).option("recursiveFileLookup", "true").parquet(f"{folder}/in"), forget="2 days")
        return sorted((str(r.ts)[8:16], r.file_path, r.rule_id, r.life) for r in run(stream, f"{folder}/life"))

    bad, worse = "os.system(x)", "os.system(x)\nDEBUG = True"
    one = arrive(1, [("p", "a.py", bad, "2024-01-01 10:00:00"), ("p", "a.py", worse, "2024-01-01 10:10:00"), ("p", "b.py", "fine", "2024-01-01 10:00:00")])
    assert one == [("01 10:00", "a.py", "INJ-010", "new"), ("01 10:10", "a.py", "DBG-002", "new"), ("01 10:10", "a.py", "INJ-010", "open")]
    two = arrive(2, [("p", "a.py", None, "2024-01-01 10:20:00"), ("p", "a.py", worse, "2024-01-01 10:05:00"), ("p", "b.py", bad, "2024-01-01 10:20:00")])
    assert [r for r in two if r not in one] == [("01 10:20", "a.py", "DBG-002", "fixed"), ("01 10:20", "a.py", "INJ-010", "fixed"), ("01 10:20", "b.py", "INJ-010", "new")]
    three = arrive(3, [("p", "a.py", bad, "2024-01-01 10:30:00"), ("p", "c.py", "fine", "2024-01-05 00:00:00")])
    assert [r for r in three if r not in two] == [("01 10:30", "a.py", "INJ-010", "reopened")]
    # two days have passed without a version of a.py: it is forgotten
    four = arrive(4, [("p", "a.py", bad, "2024-01-05 01:00:00"), ("p", "a.py", worse, "2024-01-01 10:40:00")])
    assert [r for r in four if r not in three] == [("05 01:00", "a.py", "INJ-010", "new")]


def test_closed_windows_leave_late_rows_out(spark, folder):
    layout = "project string, path string, content string, ts timestamp"
    for n, rows in enumerate([[("a.py", "2024-01-01 00:30:00"), ("b.py", "2024-01-01 03:10:00")], [("late.py", "2024-01-01 00:40:00"), ("c.py", "2024-01-01 03:20:00"), ("d.py", "2024-01-01 06:00:00")]]):
        df = spark.createDataFrame([("p", path, "os.system(x)", t) for path, t in rows], "project string, path string, content string, t string")
        df.withColumn("ts", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.mode("append").parquet(f"{folder}/in/b{n}")
        source = spark.readStream.schema(layout).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        counts = run(stream_severity_windows(stream_scan(source, ScanConfig(checks=("injection",)))), f"{folder}/w")
    assert sorted((r.window_start.hour, r.findings) for r in counts) == [(0, 1), (3, 2)]


def test_commas_move_no_texts(spark):
    """One item of each project is first, also of equal ones, and texts stay out of the exchanges by hash."""
    from auditlake.sinks.documents import _with_commas

    rows = [("a", 1, (k % 3, "x"), f"text {k % 2}") for k in range(12)] + [("b", 1, (0, "y"), "same")] * 3 + [("c", 1, (1, "z"), "one")]
    items = spark.createDataFrame(rows, "project string, part int, key struct<n:int,s:string>, text string").repartition(3)
    out = _with_commas(items)
    got = sorted((r.project, r.text.lstrip(","), r.text.startswith(",")) for r in out.collect())
    assert sorted((p, t) for p, t, _ in got) == sorted((r[0], r[3]) for r in rows)
    assert sorted(p for p, _, comma in got if not comma) == ["a", "b", "c"]
    least = min((k, "text 0") for k in [(0, "x")])
    assert [r.key["n"] for r in out.collect() if r.project == "a" and not r.text.startswith(",")] == [least[0][0]]
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("text" in line.split("hashpartitioning")[1].split(")")[0] for line in exchanges)


def test_streams_read_a_table_of_several_files(spark, tmp_path):
    from workload import outputs

    rows = spark.range(6).selectExpr("id AS doc_id", "'text' AS text", "'en' AS lang", "'s' AS source", "4L AS n_chars")
    rows.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    spark.createDataFrame(rows.toPandas()).toPandas().to_parquet((tmp_path / "documents.parquet"))
    events = rows.selectExpr("doc_id AS event_id", "timestamp '2024-01-01 01:00:00' AS ts").toPandas()
    for folder in (tmp_path, tmp_path / "folder"):
        events.astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet")
        assert outputs._run(outputs._file_stream(spark, str(folder)).select("doc_id"), "append").count() == 6
        windows = outputs.streamed_windows(spark, str(folder)).collect()
        assert windows and {r["window_start"] for r in windows} == {"2024-01-01 01:00:00"}


def test_sorts_read_their_input_once(spark, corpus, tmp_path):
    from auditlake.operators.detect import detect
    from auditlake.operators.findings import order_by_emission, order_by_severity, with_place
    from auditlake.sinks.documents import problem_lines, write_documents

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    files = corpus({f"f{k:02d}.py": "password = 'abc'" for k in range(40)}).repartition(4)
    outputs = [lambda x: with_place(order_by_severity(x)).collect(), lambda x: with_place(order_by_emission(x)).collect(), lambda x: write_documents(problem_lines(x), str(tmp_path / "out"))]
    for k, output in enumerate(outputs, 1):
        output(detect(files.mapInPandas(counted, files.schema)))
        assert read.value == 40 * k


def test_log_files_are_written_in_batches(spark, tmp_path):
    """Lines in order, whatever the number of batches and repositories of a task; nothing else is left in the folder."""
    from workload.outputs import _log_files

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 7)
    try:
        log = spark.range(100).repartition(5).selectExpr("concat('r', id % 3) AS repo", "100 - id AS seq", "concat('line ', id) AS line")
        assert _log_files(log, str(tmp_path / "logs")) == 3
        assert "applyInPandas" not in _log_files.__code__.co_names
    finally:
        spark.conf.set(name, before)
    found = {p.name: p.read_text() for p in (tmp_path / "logs").iterdir()}
    assert found == {f"r{r}.log": "".join(f"line {k}\n" for k in range(99, -1, -1) if k % 3 == r) for r in range(3)}


def test_tree_listing_takes_names_as_text(tmp_path, monkeypatch):
    """Names are cut off the root's, and mean what ``relpath`` says they do."""
    from auditlake.sources.tree import Tree, TreeStreamReader

    root = str(tmp_path / "tree")
    tree = Tree({"path": f"{root}/"})
    for inner in ("p/a.py", "p", "", ".", "..", "./p/a.py", "p/../q/b.py", "p//a.py", "p/", ".p/..a/ x .py"):
        project, _, path = os.path.relpath(f"{root}/{inner}", root).partition("/")
        assert tree.names(f"{root}/{inner}") == (project, path), inner
    assert tree.names(root) == (".", "") and tree.names(f"{root}s/p/a.py")[0] == ".."
    single = Tree({"path": root, "layout": "single"})
    assert single.names(f"{root}/") == ("tree", "") and single.names(f"{root}/p/a.py") == ("tree", "p/a.py")

    for k in range(20):
        os.makedirs(f"{root}/p{k % 3}/src/d{k}")
        open(f"{root}/p{k % 3}/src/d{k}/.env", "w").close()
    monkeypatch.setattr(os.path, "relpath", None)
    reader = TreeStreamReader({"path": root, "marks": str(tmp_path / "marks")})
    assert reader.latestOffset() == {"listing": 1}
    rows = [r for p in reader.partitions({"listing": 0}, {"listing": 1}) for r in reader.read(p)]
    assert sorted(r[:2] for r in rows) == sorted((f"p{k % 3}", f"src/d{k}/.env") for k in range(20))
