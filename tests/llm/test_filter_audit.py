"""The interaction audit of filters against applying every order filter by filter."""

import random
import re
from itertools import permutations

from auditlake.llm.filter_audit import FILTERS, Orders, audit_filters, audit_orders

WORDS = "a the cat Dog é İ 漢字 # $x 100% UP".split()
SPACES = [" ", "\n", "\t", "\x0b", "  "]


def fails(doc_id, text, rows):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        "A": len(words) < 50,
        "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
        "E": doc_id is not None and any(k is not None and k < doc_id and (t or "") == text for k, t, _ in rows),
    }


def plain(rows, labels):
    """One order after the other, one filter after the other."""
    own = [(k, s or "", fails(k, t or "", rows)) for k, t, s in rows]
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    out = {}
    for part in {s for _, s, _ in own}:
        docs = [(k, f) for k, s, f in own if s == part]
        total = dict.fromkeys(FILTERS, 0)
        for order in map("".join, permutations(FILTERS)):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                total[x] += len(gone)
                failing = [f for _, f in docs if f[x]]
                out[part, order, step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(sum(f.values()) == 1 for f in failing),
                    sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    got = {r[:3]: list(r[3:]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_filter_audit(spark):
    rnd = random.Random(5)
    text = lambda: "".join(rnd.choice(WORDS) + rnd.choice(SPACES) for _ in range(rnd.choice([0, 3, 49, 50, 51, 120])))
    varied = lambda n: " ".join(f"w{k}" for k in range(n))
    rows = [(k, text(), rnd.choice(["s", "t", None, ""])) for k in range(60)]
    rows += [(100 + k, varied(n), "s") for k, n in enumerate((49, 50, 51))]  # only A or nothing
    rows += [(200, "A" + "b" * 19, "s"), (201, "A" + "b" * 18, "s"), (202, " ".join(f"w{k % 65}" for k in range(100)), "t"), (203, " ".join(f"w{k % 64}" for k in range(100)), "t")]
    rows += [(300, None, "s"), (301, "", None), (302, "", "t"), (7, "same id", "s"), (7, "same id", "s"), (6, "same id", "t"), (None, "same id", "u"), (None, None, None)]
    rows += [(400, "x " * 200_000, "s"), (401, varied(60), "s"), (402, varied(60), "s"), (403, varied(60), "u")]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for k in range(0, 410, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, mask string, digest int").repartition(5)
    marks = spark.createDataFrame([(*x, "m") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = found(audit_filters(docs, marks))
    assert got == plain(rows, labels)
    assert len(got) == 600 * 4


def test_filter_audit_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(none, marks).collect() == []
    docs = spark.createDataFrame([(1, "a", None)], none.schema)
    assert len(audit_filters(docs, marks).collect()) == 600


def test_sums_never_carry(spark):
    """Counts near the largest long in every field, and other numbers of filters."""
    many = (1 << 62) - 1
    table = Orders("ABC")
    kept, removed, *_ = table.outcomes([(0b111, True, False, many), (0, False, False, 5)])
    first = [k % 3 == 0 for k in range(table.steps)]
    assert removed.tolist() == [many if x else 0 for x in first] and set(kept.tolist()) == {5}
    masks = spark.createDataFrame([(k, "p", 0b01) for k in range(10)], "doc_id long, part string, mask int")
    marks = spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int")
    assert found(audit_orders(masks, marks, "AB")) == {
        ("p", "AB", 1): [0, 10, 0, 10, 1, 1, 20], ("p", "AB", 2): [0, 0, 0, 0, 0, 0, 0],
        ("p", "BA", 1): [10, 0, 0, 0, 0, 0, 0], ("p", "BA", 2): [0, 10, 0, 10, 1, 1, 20],
    }
