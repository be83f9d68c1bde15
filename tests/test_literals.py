"""What patterns require, and thousands of them at once."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from auditlake import ScanConfig
from auditlake.config import custom_rule
from auditlake.functions.literals import Finder, Patterns, folded, required_literals
from auditlake.operators import detect as de
from auditlake.operators.history import mark_still_present
from tests import brute


@pytest.mark.parametrize(("pattern", "needs"), [
    ("Token-[0-9]+", {"token-"}), ("(?:abc|defg)x+yz", {"abc", "defg"}), ("(abc)?def", {"def"}), ("(?P<a>key)_(?P=a)", {"key_"}),
    ("a|bcd", None), ("[abc]de", None), (r"\bword\b.*tail", {"word"}), ("(?i:LONG)er", {"longer"}), ("x*", None), ("(?:ab){2,}cde", {"cde"}),
    ("ünïcode", {"code"}), ("(?<=pre)fix", {"fix"}), ("(?!never)ever", {"ever"}), ("^start$", {"start"}), ("(?:one|two|three)-(?:four|five)", {"one", "two", "three"}),
])
def test_required(pattern, needs):
    got = required_literals(pattern)
    assert (set(got) if got else None) == needs or (got and needs and min(map(len, got)) >= min(map(len, needs)))


PARTS = ["tok", "key", "[a-c]", "x+", "(?:ab|cd)", "(?P<n>q)", "(?=z)", r"\d", "K", "s", "i", ".", "é", "(?:end)?", r"\b"]


def test_matches_as_each_alone():
    rnd = random.Random(3)
    patterns = ["".join(rnd.sample(PARTS, rnd.randint(1, 5))) for _ in range(400)] + ["x*", "$"]
    many = Patterns(patterns)
    for _ in range(150):
        text = "".join(rnd.choice(["tok", "KEY", "ab", "cd", "x", "q", "z", "1", "\n", "K", "ſ", "İ", "ı", "s", "é", "end", " ", "c"]) for _ in range(40))
        alone = {}
        for k, p in enumerate(patterns):
            lines = [text.count("\n", 0, m.start()) for m in re.finditer(p, text, re.IGNORECASE | re.MULTILINE)]
            if lines:
                alone[k] = [(n + 1, text.split("\n")[n], lines.count(n)) for n in dict.fromkeys(lines)]
        assert dict(many.matches(text)) == alone


def test_finder_without_the_library(monkeypatch):
    import sys

    words = ["", "a", "ab", "ab", "zz", "b\nc"]
    one = Finder(words).found("xab\nc")
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert one == Finder(words).found("xab\nc") == {0, 1, 2, 3, 5}
    assert folded("Kſİı") == "ksii"


def test_many_patterns_of_a_config(corpus):
    files = {f"f{k}.py": f"tok-{k:04d}-abc\nnothing\nTOK-{k + 1:04d}-def tok-{k + 1:04d}-x" for k in range(40)} | {"empty.py": ""}
    config = ScanConfig(checks=("secrets",), custom_patterns=tuple({"pattern": rf"tok-{k:04d}-[a-z]+", "rule_id": f"T-{k}"} for k in range(300)))
    got = {k: v for k, v in brute_rows(de.detect(corpus(files), config)).items() if k[1].startswith("T-")}
    assert got == brute.rule_findings(files, config.custom_rules()) and len(got) == 80


def brute_rows(df):
    return {(r.file_path, r.rule_id): (r.line_number, r.match_count, r.code_snippet) for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"MANY": 2}, {"BROADCAST_BYTES": 10}])
def test_project_patterns_by_every_way(spark, corpus, monkeypatch, limits):
    """Few and many patterns, sent to all tasks or joined: the same rows."""
    for name, value in limits.items():
        monkeypatch.setattr(de, name, value)
    sources = {"a": [r"tok_\d+", "(?P<n>q)?(?(n)w|v)x", "x*y", "z*"], "b": ["Key=(?:one|two)"], "c": ["("], "d": None}
    files = {(p, f): t for p in "abcde" for f, t in {"1.txt": "tok_1 TOK_2\nqwx vx\nkey=one", "2.txt": "", "3.txt": "xxy\nKEY=TWO key=two"}.items()}
    rows = [(p, [{"pattern": x, "rule_id": f"R-{k}"} for k, x in enumerate(s)] if s is not None else None) for p, s in sources.items()]
    patterns = spark.createDataFrame(rows, "project string, custom_patterns array<struct<pattern:string,rule_id:string,severity:string,description:string,remediation:string>>")
    got = {(r.project, r.file_path, r.rule_id): (r.line_number, r.match_count) for r in de.detect_project_patterns(corpus(files), patterns).collect()}
    wanted = {}
    for (project, path), text in files.items():
        for k, source in enumerate(sources.get(project) or ()):
            if source != "(":
                own = brute.rule_findings({path: text}, (custom_rule({"pattern": source, "rule_id": f"R-{k}"}),))
                wanted |= {(project, f, r): v[:2] for (f, r), v in own.items()}
    assert got == wanted


def test_content_is_sent_to_python_once(corpus):
    config = ScanConfig(checks=("secrets",), custom_patterns=({"pattern": "(?P<n>q)?(?(n)w|v)x"}, {"pattern": "x*"}, {"pattern": "z*"}))
    plan = de.detect(corpus({"a.py": "x"}), config)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "ArrowEvalPython" not in plan


def test_still_present_takes_one_pass(spark):
    lines = [f"secret_{k} = 'value {k}'" for k in range(10_000)]
    text = "\n".join(f"  {x}  # note" for x in lines[::2]) + "\nfiller line" * 400_000
    findings = spark.createDataFrame([("r", "a.py", x) for x in lines] + [("r", "gone.py", "x"), ("r", "null.py", "x")], "repo string, file_path string, line_text string")
    head = spark.createDataFrame([("r", "a.py", text), ("r", "null.py", None)], "repo string, path string, content string")
    start = time.perf_counter()
    marked = mark_still_present(findings, head)
    assert sorted(r.line_text for r in marked.where("still_present").collect()) == sorted(lines[::2])
    assert time.perf_counter() - start < 60


def test_pattern_blocks(spark, corpus, monkeypatch):
    """Patterns too large to send: pieces, blocks and parts of files smaller than a project give the same rows, and no file carries all patterns."""
    files = {(p, f"f{k}.txt"): f"tok-{k}-a\nTOK-{k}-b tok-{k + 1}-c" for p in "ab" for k in range(30)}
    entry = lambda k: {"pattern": f"tok-{k}-[a-z]" if k % 5 else "(", "rule_id": f"R-{k}"}
    schema = "project string, custom_patterns array<struct<pattern:string,rule_id:string,severity:string,description:string,remediation:string>>"
    patterns = spark.createDataFrame([("a", [entry(k) for k in range(40)]), ("b", [entry(k) for k in range(5)]), ("none", [])], schema)
    columns = ("project", "file_path", "rule_id", "rule_ord", "line_number", "match_count")
    wanted = sorted(map(tuple, de.detect_project_patterns(corpus(files), patterns).select(*columns).collect()))
    for name, value in {"BROADCAST_BYTES": 10, "PIECE": 3, "BLOCK": 7, "PART_BYTES": 100}.items():
        monkeypatch.setattr(de, name, value)
    found = de.detect_project_patterns(corpus(files), patterns).select(*columns)
    assert sorted(map(tuple, found.collect())) == wanted and len(wanted) > 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "MapInPandas" not in plan


def test_filter_of_blocks_leaves_nothing_out():
    """Blocks of all literals in a text are found, across pieces of long texts and next to other texts; few others."""
    import numpy as np

    from auditlake.functions.literals import CHUNK, START_BITS, BlockFilter, filter_bits, literal_places, stretches, width_of

    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abk-\n 7") for _ in range(n))
    words = [(word(rnd.choice((3, 4, 5, 8, 9, 12, 40))), rnd.randrange(3), rnd.randrange(7)) for _ in range(300)]
    salts = np.array([11, 1 << 63, 3], np.uint64)
    bits = filter_bits(len(words))
    table = np.zeros((1 << bits) + (1 << START_BITS), np.uint8)
    table[literal_places([w for w, _, _ in words], salts[[p for _, p, _ in words]], np.array([b for _, _, b in words], np.uint64), bits)] = 1
    blocks = BlockFilter(np.packbits(table, bitorder="little"), bits, sorted({width_of(len(w)) for w, _, _ in words}))
    hold = lambda k: "".join(rnd.choice((words[rnd.randrange(300)][0].upper(), "\u017f\u212aé\U0001f600", "zz")) for _ in range(k))
    far = next(w for w, p, b in words if len(w) == 40 and p == 1)
    texts = ["", "x", *(hold(rnd.randrange(12)) for _ in range(200)), "q" * (CHUNK // 2 - 20) + far + "q" * CHUNK, "q" * (3 * CHUNK)]
    owners = [k % 3 for k in range(len(texts))]
    owners[-2] = 1
    found = blocks.blocks(texts, salts[owners], np.array([6] * len(texts)))
    needed = [{b for w, p, b in words if p == own and w in folded(t)} for t, own in zip(texts, owners)]
    assert all(n <= f for n, f in zip(needed, found)) and needed[-2] and not found[-1] and not found[0]
    some = [{b for (w, p, b), x in zip(words, stretches([w for w, _, _ in words])) if p == own and x in folded(t)} for t, own in zip(texts, owners)]
    assert sum(len(f - s) for f, s in zip(found, some)) <= 5


def test_files_go_only_to_blocks_that_may_match(spark, corpus, monkeypatch):
    """Each file goes to the block of its mark, and to that of the pattern that requires no text; others stay."""
    monkeypatch.setattr(de, "BLOCK", 10)
    schema = "project string, custom_patterns array<struct<pattern:string,rule_id:string,severity:string,description:string,remediation:string>>"
    entries = {"a": [rf"token-{k:04d}-[a-z]" for k in range(60)], "b": [r"(?:secret|hidden)-[0-9]"] * 10 + [r"\d+x"]}
    patterns = spark.createDataFrame([(p, [{"pattern": x, "rule_id": f"R-{k}"} for k, x in enumerate(own)]) for p, own in entries.items()], schema)
    numbered = de.compiled_pieces(patterns).select("project", F.inline("rules")).withColumn("block", F.floor(F.col("i") / 10))
    files = corpus({("a", "1"): "TOKEN-0042-x", ("a", "2"): "token-42-x", ("a", "3"): "token-0003-x\ntoken-0059-y", ("b", "1"): "Hidden-1", ("b", "2"): "-", ("b", "3"): None, ("c", "1"): "token-0042-x"})
    rows = {(r.project, r.path): r.blocks for r in de.may_match_blocks(files, numbered).collect()}
    assert rows == {("a", "1"): [4], ("a", "3"): [0, 5], ("b", "1"): [0, 1], ("b", "2"): [1]}


def test_few_good_patterns_of_many(spark, corpus):
    """More than MANY patterns of which few are good take the JVM's way: of a project in two rows both count, as with few patterns."""
    schema = "project string, custom_patterns array<struct<pattern:string,rule_id:string,severity:string,description:string,remediation:string>>"
    entries = [{"pattern": "(", "rule_id": "BAD"}] * (de.MANY + 1) + [{"pattern": r"tok_\d+", "rule_id": "R-1"}, {"pattern": "(?P<n>q)?(?(n)w|v)x", "rule_id": "R-2"}]
    for own in (entries, entries[-2:]):
        found = de.detect_project_patterns(corpus({"a": "tok_1 vx", "b": "x"}), spark.createDataFrame([("p", own), ("p", [{"pattern": "x", "rule_id": "R-3"}])], schema))
        assert sorted((r.file_path, r.rule_id) for r in found.collect()) == [("a", "R-1"), ("a", "R-2"), ("a", "R-3"), ("b", "R-3")]
