"""Renames and copies against a plain search over all pairs of files."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditlake.operators.renames import file_lines, similar_contents, traced_changes


def alike(a, b):
    a, b = Counter(a.split("\n")), Counter(b.split("\n"))
    return sum((a & b).values()) / max(a.total(), b.total())


def plain(before, after, percent):
    """(project, path) -> (change, old path, likeness) as the docstring has it."""
    out = {}
    for project in {p for p, _ in after}:
        old = {path: t for (p, path), t in before.items() if p == project}
        new = {path: t for (p, path), t in after.items() if p == project}
        for path in new.keys() & old.keys():
            if None not in (old[path], new[path]) and old[path] != new[path]:
                out[project, path] = ("modified", None, None)
        fresh, sources = sorted(new.keys() - old.keys()), sorted(p for p, t in old.items() if t)
        gone = {p for p in sources if p not in new}
        rest = []
        for text in {new[p] for p in fresh}:
            own, equal = [p for p in fresh if new[p] == text], [p for p in sources if old[p] == text]
            if not text:
                out.update({(project, p): ("added", None, None) for p in own})
                continue
            turns = [p for p in equal if p in gone]
            for k, p in enumerate(own):
                if k < len(turns):
                    out[project, p] = ("renamed", turns[k], 1.0)
                    gone = gone - {turns[k]}
                elif equal:
                    out[project, p] = ("copied", equal[0], 1.0)
                else:
                    rest.append(p)
        claims = []
        for p in rest:
            best = []
            for text in {old[s] for s in sources}:
                own = [s for s in sources if old[s] == text]
                like, free = alike(new[p], text), [s for s in own if s in gone]
                if 100 * like >= percent:
                    best.append((-like, not free, (free or own)[0]))
            claims.append((p, *min(best)) if best else (p, 0, None, None))
        for p, like, kept, source in claims:
            first = min(((x, q) for q, x, k, s in claims if s == source and not k), default=None)
            change = "added" if source is None else "renamed" if not kept and first[1] == p else "copied"
            out[project, p] = (change, source, -like if source is not None else None)
    return out


def snapshots(seed):
    rnd = random.Random(seed)
    text = lambda: "\n".join(rnd.choice(["", "}", "common", f"line {rnd.randint(0, 40)}", f"own {rnd.random()}"]) for _ in range(rnd.choice([0, 1, 2, 5, 12])))
    before = {(p, f"f{k}"): rnd.choice([text(), text(), "same\ntext", "", None if k == 3 else text()]) for p in "ab" for k in range(25)}
    after = {}
    for (p, path), t in before.items():
        lines = (t or "").split("\n")
        edited = "\n".join([x for x in lines if rnd.random() < 0.8] + ["edit"] * rnd.randint(0, 2))
        for name, value in ((path, t), (path, edited), (f"moved/{path}", t), (f"moved/{path}", edited), (f"copy/{path}", t), (f"copy/{path}", edited), (f"new/{path}", text())):
            if rnd.random() < 0.3:
                after[p, name] = value
    return before, after


@pytest.mark.parametrize(("seed", "percent"), [(1, 50), (2, 30), (3, 80)])
def test_traced_changes(spark, corpus, seed, percent):
    before, after = snapshots(seed)
    got = traced_changes(corpus(before), corpus(after), percent).collect()
    rows = {(r["project"], r["path"]): (r["change"], r["old_path"], r["likeness"]) for r in got}
    assert len(rows) == len(got) and rows == plain(before, after, percent)
    assert {r[0] for r in rows.values()} == {"added", "modified", "renamed", "copied"}


def test_alike_as_all_pairs(spark):
    """What the rarest lines and the bound let through is all there is."""
    rnd = random.Random(5)
    rows = [("p", rnd.choice(["old", "new"]), k, "\n".join(str(min(rnd.randint(0, 30), rnd.randint(0, 30))) for _ in range(rnd.randint(1, 15)))) for k in range(120)]
    df = spark.createDataFrame(rows, "project string, side string, id long, content string")
    got = {(r["a"], r["b"]): r["likeness"] for r in similar_contents(file_lines(df), 40).collect()}
    pairs = {(a, b): alike(x, y) for _, s, a, x in rows for _, t, b, y in rows if (s, t) == ("new", "old")}
    assert got == {k: v for k, v in pairs.items() if v >= 0.4} and got


def test_contents_stay_out_of_the_exchange(corpus):
    """Only digests of files that stay, move or are copied as they are take part in a shuffle."""
    before = {("p", f"f{k}"): f"text {k}" for k in range(20)}
    after = {("p", f"g{k}"): f"text {k}" for k in range(20)}
    changes = traced_changes(corpus(before), corpus(after))
    assert changes.groupBy("change").agg(F.count("*")).collect() == [("renamed", 20)]


def test_contents_with_a_close_source_do_not_meet_all_that_share_a_block(spark):
    """All contents share 12 of 15 lines or more; each new one has one closest source, some two equal ones."""
    block = [f"block {k}" for k in range(12)]
    old = {k: "\n".join([f"own {k}", f"more {k}", *block]) for k in range(40)}
    new = {100 + k: f"edited {k}\n{old[k]}" for k in range(40)}
    new[200] = "\n".join(["other", "text", *block])  # as close to all of them
    new[201] = "\n".join(f"fresh {k}" for k in range(9))
    old[40] = old[0].replace("block 0", "changed")
    new[300] = old[0].replace("block 0", "altered")
    rows = [("p", side, k, t) for side, texts in (("old", old), ("new", new)) for k, t in texts.items()]
    lines = file_lines(spark.createDataFrame(rows, "project string, side string, id long, content string"))
    found = {(r["a"], r["b"]): r["likeness"] for r in similar_contents(lines, 50, closest=True).collect()}
    every = {(r["a"], r["b"]): r["likeness"] for r in similar_contents(lines, 50).collect()}
    best = {a: max(x for (c, _), x in every.items() if c == a) for a, _ in every}
    closest = {(a, b): x for (a, b), x in every.items() if x == best[a]}
    assert closest.items() <= found.items() <= every.items() and len(every) > 1600
    assert {b for a, b in found if a == 200} == set(range(40)) and not any(a == 201 for a, _ in found)
    assert {a: b for a, b in found if a < 200} == {100 + k: k for k in range(40)} and len(found) < 90
