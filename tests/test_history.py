import random

from pyspark.sql import functions as F

from auditlake.operators import history as hi
from auditlake.sources import commit_log as cl
from tests import brute
from workload.samples import ALNUM24, POSITIVE, RANDOM32

KEY = POSITIVE["SEC-001"]


def commit(n, *parts, message="m"):
    return [f"COMMIT:{n:040x}", f"AUTHOR: A{n} ", f"DATE:2024-01-{n % 28 + 1:02d}", f"MSG:{message}", "END_META", *parts]


def log_of(spark, repos, gap=1):
    rows = [(repo, i * gap, line) for repo, lines in repos.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "repo string, seq long, line string")


def random_log(seed, commits=30):
    rng = random.Random(seed)
    lines = ["+early line", f"+{KEY}"]
    for n in range(commits):
        lines += commit(n)
        for _ in range(rng.randrange(3)):
            path = f"d/f{rng.randrange(4)}.py"
            lines += [f"diff --git a/{path} b/{path}", f"+++ b/{path}"]
            for _ in range(rng.randrange(12)):
                text = rng.choice([KEY, POSITIVE["SEC-012"], f"hmac_key = '{RANDOM32}'", f"api_key='{RANDOM32}'", "x = 1", "'secret'", f"api_key='{RANDOM32}' token = '{RANDOM32[::-1]}'", "x" * 130 + KEY, "MSG:no", "  "])
                lines.append(rng.choice("++ -") + text)
    return lines


def test_context_is_carried_like_a_reader_would(spark):
    repos = {f"r{i}": random_log(i) for i in range(4)}
    log = log_of(spark, repos, gap=3)
    for block in (2, 7, 64, 1 << 20):
        rows = cl.parse_commit_log(log, block).orderBy("repo", "seq").collect()
        got = {r: [] for r in repos}
        for r in rows:
            got[r.repo].append((r.content, r.commit_hash, r.commit_author, r.commit_date, r.commit_message, r.file_path))
        assert got == {r: brute.log_context(lines) for r, lines in repos.items()}, block


def expected_history(lines):
    import re

    from auditlake.catalog.rules import ENTROPY_RULE

    seen, out = set(), []
    for content, c, a, d, m, f in brute.log_context(lines):
        hits = [(r.rule_id, None) for r in hi.HISTORY_RULES if re.search(r.pattern, content, re.I)]
        hits += [("SEC-ENT", v) for v in re.findall(ENTROPY_RULE.pattern, content, re.I) if brute.entropy(v) >= 4.5]
        for rule_id, value in hits:
            key = (rule_id, f, content.strip())
            if (key, value) not in seen:
                seen.add((key, value))
                out.append((*key, c))
    return sorted(out)


def test_findings_same_as_reading_in_order(spark):
    repos = {f"r{i}": random_log(10 + i) for i in range(3)}
    log = log_of(spark, repos)
    for block in (5, 1 << 20):
        rows = hi.history_findings(log, block=block).collect()
        for repo, lines in repos.items():
            got = sorted((r.rule_id, r.file_path, r.line_text, r.commit_hash) for r in rows if r.repo == repo)
            assert got == expected_history(lines)


def test_skipped_rules_and_first_rule(spark):
    lines = commit(1, "diff --git a/x b/x", "+'secret' 'changeme' 'password123' \"admin@example.com\"", f"+password='x' {KEY}", f"+password = 'y' # api_key='{ALNUM24}'")
    rows = hi.history_findings(log_of(spark, {"r": lines})).orderBy("seq", "hit_ord").collect()
    assert [r.rule_id for r in rows] == ["SEC-001", "SEC-012", "SEC-012", "SEC-013", "SEC-ENT"]


def test_limit_commits(spark):
    lines = [line for n in range(6) for line in commit(n, "diff --git a/x b/x", f"+password = 'p{n}'")]
    log = log_of(spark, {"r": lines, "s": lines[:8]})
    for block in (3, 1 << 20):
        rows = hi.history_findings(log, newest=2, block=block).collect()
        assert sorted((r.repo, r.line_snippet) for r in rows) == [("r", "password = 'p0'"), ("r", "password = 'p1'"), ("s", "password = 'p0'")]
        for newest in range(8):
            left = cl.limit_commits(log, newest, block).filter("line like 'COMMIT:%'").groupBy("repo").count().collect()
            assert {r.repo: r["count"] for r in left} == ({"r": min(newest, 6), "s": min(newest, 2)} if newest else {})


def test_fingerprint_same_across_commits(spark):
    lines = commit(1, "diff --git a/x b/x", f"+{KEY}") + commit(2, "diff --git a/x b/x", f"+   {KEY}", "diff --git a/y b/y", f"+{KEY}")
    rows = hi.history_findings(log_of(spark, {"r": lines})).collect()
    assert sorted((r.file_path, int(r.commit_hash, 16)) for r in rows) == [("x", 1), ("y", 2)]


def test_still_present_and_counts(spark):
    lines = commit(1, "diff --git a/x b/x", f"+  {KEY}", "+password = 'gone'", "diff --git a/z b/z", f"+{KEY}")
    head = spark.createDataFrame([("r", "x", f"a\n\t{KEY}\n"), ("r", "other", KEY)], "repo string, path string, content string")
    marked = hi.mark_still_present(hi.history_findings(log_of(spark, {"r": lines})), head)
    assert sorted((r.file_path, r.rule_id, r.still_present) for r in marked.collect()) == [
        ("x", "SEC-001", True), ("x", "SEC-012", False), ("z", "SEC-001", False)]
    assert [tuple(r) for r in hi.history_counts(marked).collect()] == [("r", 3, 1, 2)]


def test_secrets_after_a_long_beginning(spark):
    lead = "x = 1; " * 30
    lines = commit(2, "diff --git a/x b/x", f"+{lead}password = 'one'", f"+{lead}password = 'two'") + commit(1, "diff --git a/x b/x", f"+{lead}password = 'one'")
    head = spark.createDataFrame([("r", "x", f"{lead}password = 'two'\n{lead}password = env"), ("r", "y", "")], "repo string, path string, content string")
    marked = hi.mark_still_present(hi.history_findings(log_of(spark, {"r": lines})), head).collect()
    assert sorted((r.line_text[-5:], r.still_present) for r in marked) == [("'one'", False), ("'two'", True)]
    assert len({r.fingerprint for r in marked}) == 2 and {len(r.line_snippet) for r in marked} == {120}


def test_no_commit_is_left_out_unless_asked(spark):
    from auditlake import audit_history

    lines = [line for n in range(600) for line in commit(n, "diff --git a/x b/x", f"+password = 'p{n}'")]
    head = spark.createDataFrame([("r", "x", "password = 'p599'")], "repo string, path string, content string")
    assert audit_history(log_of(spark, {"r": lines}), head).count() == 600
    assert audit_history(log_of(spark, {"r": lines}), head, newest=3).count() == 3


def test_whole_logs_are_split_like_python(spark):
    text = "COMMIT:1\r\nAUTHOR:a\x0bDATE:d\x85MSG:m END_META\n+x\n"
    rows = cl.log_lines(spark.createDataFrame([("r", text)], "repo string, content string")).orderBy("seq").collect()
    assert [r.line for r in rows if r.line] == text.splitlines()


def test_log_files_are_numbered_in_parallel(spark, tmp_path):
    logs = {f"r{k}": random_log(20 + k, commits=40) for k in range(3)}
    for name, lines in logs.items():
        (tmp_path / f"{name}.log").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        log = cl.read_logs(spark, str(tmp_path))
        assert log.rdd.getNumPartitions() > 6
        rows = log.orderBy("repo", "seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {name: [r.line for r in rows if r.repo == name] for name in logs} == logs
    assert len({(r.repo, r.seq) for r in rows}) == len(rows)


def test_hot_repository_is_cut_into_blocks(spark):
    log = log_of(spark, {"r": random_log(3)})
    plan = cl.parse_commit_log(log, 16)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(repo" in plan and "block" in plan
    kept = cl.forward_fill(log.withColumn("v", F.when(F.col("seq") % 9 == 0, F.col("line"))), "repo", "seq", ["v"], 4)
    assert kept.filter("v is null").count() == 0
