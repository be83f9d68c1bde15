import fnmatch
import itertools
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from auditlake.functions import scoring as sc
from auditlake.functions import text as tx
from auditlake.functions.dialect import UnsupportedPattern, tail_glob, to_jvm, whole_glob
from tests import brute


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def results(df, value):
    return [r.out for r in df.select("i", value.alias("out")).orderBy("i").collect()]


def test_decode_text(spark):
    raw = [
        b"plain\r\nold\rmac\nend", b"\xff\xfeab\xc3", b"a\xe2\x82A", b"\xed\xa0\x80x", "keep \ufffd this".encode(),
        "\ufdd0\ufdd1\ufdd2\ufffd".encode() + b"\xff\xef", "h\xe9llo \U0001f600".encode(), b"", b"\xf0\x9f\x98z", b"\xc0\xaf/",
    ]
    expected = [re.sub("\r\n?", "\n", b.decode("utf-8", "ignore")) for b in raw]
    assert results(column(spark, [bytearray(b) for b in raw], "binary"), tx.decode_text(F.col("v"))) == expected


def test_names(spark):
    paths = ["a/b.PY", ".env", "x/.env.local", "Makefile", "a.b/c", "d/e.tar.gz", "..", "a/.hidden.JS", "end."]
    df = column(spark, paths)
    assert results(df, tx.file_name(F.col("v"))) == [p.split("/")[-1] for p in paths]
    expected = [PurePosixPath(p).suffix.lower() if p not in ("end.",) else "" for p in paths]
    assert results(df, tx.file_ext(F.col("v"))) == expected


def test_strip_and_snippet(spark):
    values = ["  a b \t", "\x1c\x85 x\u3000", "", " \n ", "\xe9" * 130, "\u200bkeep\u200b", "\u2028a\xa0"]
    df = column(spark, values)
    assert results(df, tx.strip(F.col("v"))) == [v.strip() for v in values]
    assert results(df, tx.snippet(F.col("v"))) == [v.strip()[:100] for v in values]


def test_mask(spark):
    values = ["k = \"abcdefgh\" and 'abcdefghi'", "'short'", "\"mixed12345'", "'a@b.c-d_e+/='", "x"]
    assert results(column(spark, values), tx.mask_secret(F.col("v"))) == [
        "k = \"****\" and '****'", "'short'", "\"mixed12345'", "'****'", "x"
    ]


def test_entropy(spark):
    values = ["", "a", "ab", "aab", "0123456789abcdef", "zażółć😀", "AAAAbbbbCCCCdddd1234"]
    got = results(column(spark, values), tx.shannon_entropy("v"))
    assert got == pytest.approx([brute.entropy(v) for v in values], abs=1e-12)


def test_suppression(spark):
    lines = ["x # audit-ignore", "x // audit-ignore", "x #audit-ignore", "x # audit-ignore R-1 R-2", "x # audit-ignore\tR-2",
             "x # audit-ignore because", "x # audit-ignored", "// audit-ignore R-9 # audit-ignore", "audit-ignore",
             "x # audit-ignore R-9 # audit-ignore R-1", "# audit-ignore   ", "x // audit-ignore R-10"]
    got = results(column(spark, lines), tx.is_suppressed("v", "'R-1'"))
    assert got == [brute.suppressed(line, "R-1") for line in lines]
    mine = results(column(spark, ["x # skip-it R-1"]), tx.is_suppressed("v", "'R-1'", "skip-it"))
    assert mine == [True]


def test_fingerprint_ignores_line_and_slashes(spark):
    df = spark.createDataFrame([("R", "a\\b.py", " x "), ("R", "a/b.py", "x"), ("S", "a/b.py", "x")], "r string, p string, c string")
    prints = [r[0] for r in df.select(tx.fingerprint(F.col("r"), F.col("p"), F.col("c"))).collect()]
    assert prints[0] == prints[1] != prints[2] and all(re.fullmatch("[0-9a-f]{16}", p) for p in prints)


def test_html_escape(spark):
    assert results(column(spark, ["<a href=\"x\">&'"]), tx.html_escape(F.col("v"))) == ["&lt;a href=&quot;x&quot;&gt;&amp;'"]


PATTERNS = [
    r"\s+x", r"[\s,]y", r"\w+", r"[\w-]+z", r"\d{2,}", r"\bcat\b", r"\Bat", r"^a.c$", r"x{,2}y",
    r"{a}", r"a{1}b{", r"[]x]", r"[[a]", r"[a&&b]", r"(?:a|b)+?c", r"(?P<q>['\"]).*?(?P=q)", r"(?<!\w)D", r"a(?!b)", r"\x41é",
    r"\101", r"[\x41-C]", r"a\Z", r"\.\*", r"i", r"k", r"s", r"[a-z]+", r"\S+", r"\D\D", r"[^\n]+", r"(a)(b)?\1",
]
TEXTS = ["cat concat  x\ny,y", "A1 22 \xe933 \u0663\u0664", "\xe1bc a\nc aXc\nabc", "xxy xy y", "{a} a{1}b{ ab{", "]x [a &b", "aabbc", "'q' \"r\"",
         "D _D \xe9D", "ab ac", "A\xe9A", "a\x1cx\x85y x", "\u0130\u0131\u017f\u212akKiI", "a", "a\n", ".*", "\u3000x\u2028x", "aba aa", "e\u0301D", "a\r\nc"]


def test_dialect_same_as_python(spark):
    cases = [(i, p, t) for i, (p, t) in enumerate(itertools.product(PATTERNS, TEXTS))]
    df = spark.createDataFrame([(i, to_jvm(p), t) for i, p, t in cases], "i int, p string, t string")
    rows = {r.i: [(m.line, m.n) for m in r.m] for r in df.select("i", tx.match_lines("t", "p", "'\x02'").alias("m")).collect()}
    for i, p, t in cases:
        lines = [t.count("\n", 0, m.start()) + 1 for m in re.finditer(p, t, brute.FLAGS)]
        assert rows[i] == [(n, lines.count(n)) for n in dict.fromkeys(lines)], (p, t)


@pytest.mark.parametrize("pattern", [r"[\S]", r"(?x)a b", r"(?a)\w", r"(a)?(?(1)b|c)", r"\N{BULLET}"])
def test_dialect_refuses(pattern):
    with pytest.raises(UnsupportedPattern):
        to_jvm(pattern)


GLOBS = ["*.py", ".env", "src/*", "*/b?", "[a-c]x", "[!a-c]x", "[z-a]x", "[!z-a]x", "a[", "[]x]y", "[!]]", "a.b", "**/x", "?", "", "a[b-]", "(x)", "$v^", "a b", "[\\x]"]
NAMES = ["a.py", "src/a.py", "src/b1", "ax", "dx", "zx", "a[", "]y", "xy", "x", "a.b", "aXb", "q/r/x", "", "a-", "ab", "(x)", "$v^", "a b", "é", "a\nb.py", ".env", "\\", "axx"]


def test_globs_same_as_python(spark):
    cases = list(itertools.product(GLOBS, NAMES))
    df = spark.createDataFrame([(i, whole_glob(g), n) for i, (g, n) in enumerate(cases)], "i int, p string, t string")
    got = results(df, F.rlike(F.col("t"), F.col("p")))
    assert [(c, g) for c, g in zip(cases, got) if fnmatch.fnmatchcase(c[1], c[0]) != g] == []


def test_tail_globs_same_as_python(spark):
    globs = ["*.py", "tests/*.py", "a/*/c", "[ab]/?", "*", "**/c.py", "./x/", "x//y"]
    paths = ["a.py", "tests/a.py", "x/tests/a.py", "tests/x/a.py", "a/b/c", "z/a/b/c", "b/q", "c.py", "d/c.py", "x", "q/x", "x/y", "w/x/y"]
    cases = list(itertools.product(globs, paths))
    df = spark.createDataFrame([(i, tail_glob(g), n) for i, (g, n) in enumerate(cases)], "i int, p string, t string")
    got = results(df, F.rlike(F.col("t"), F.col("p")))
    assert [(c, g) for c, g in zip(cases, got) if PurePosixPath(c[1]).match(c[0]) != g] == []


def test_scoring(spark):
    df = column(spark, [9.0, 8.9, 7.0, 4.0, 3.9], "double")
    assert results(df, sc.cvss_bucket(F.col("v"))) == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW"]
    labels = column(spark, ["moderate", "IMPORTANT", "negligible", "low", "odd", None])
    assert results(labels, sc.advisory_severity(F.col("v"), F.array().cast("array<string>"))) == [
        "MEDIUM", "HIGH", "LOW", "LOW", "HIGH", "HIGH"
    ]
    ranks = column(spark, [None, 1, 2, 3, 4], "int")
    assert results(ranks, sc.grade_of(F.col("v"))) == ["A", "B", "C", "D", "F"]
    sev = column(spark, ["CRITICAL", "HIGH", "MEDIUM", "LOW"])
    assert results(sev, sc.problem_level(F.col("v"))) == ["error", "error", "warning", "warning"]
    assert results(sev, sc.rank_of(F.lower("v"))) == [4, 3, 2, 1]
