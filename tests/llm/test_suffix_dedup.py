"""Removal of repeated byte strings against looking every string up."""

import random

import numpy as np
import pytest

from auditlake.llm import suffix_dedup
from auditlake.llm.suffix_dedup import Prefixes, equal_windows, remove_repeats, sort_suffixes


def plain(rows, length):
    """(doc_id, n_bytes, removed runs, kept) of every row, by a dictionary of all strings."""
    docs = sorted({(k is None, k or 0, t or "") for k, t in rows}, key=lambda d: d[:2])
    assert len({d[:2] for d in docs}) == len(docs)
    seen, cut = set(), {}
    for none, k, t in docs:
        data, gone = t.encode(), set()
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone.update(range(i, i + length))
            seen.add(s)
        marks = "".join("x" if i in gone else "." for i in range(len(data)))
        runs = [(m, m + len(r)) for m, r in starts(marks)]
        cut[none, k] = (len(data), runs, bytes(b for i, b in enumerate(data) if i not in gone))
    return sorted(((k, *cut[k is None, k or 0]) for k, _ in rows), key=repr)


def starts(marks):
    import re

    return [(m.start(), m[0]) for m in re.finditer("x+", marks)]


def texts(rnd, count):
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(15, 60))) for _ in range(6)]
    out = []
    for _ in range(count):
        parts = [rnd.choice([rnd.choice(passages), "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 40)))]) for _ in range(rnd.randint(0, 6))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize(("block", "hot"), [(1 << 20, 2048), (600, 2048), (600, 3), (200, 0)])
def test_remove_repeats(spark, block, hot):
    rnd = random.Random(4)
    some = texts(rnd, 120)
    rows = list(enumerate(some)) + [(500 + k, t) for k, t in enumerate(some[::5])]
    rows += [(700, None), (701, ""), (702, "ab" * 300), (703, "a" * 400), (704, "ab" * 200), (None, some[3] + "tail"), (-5, some[7] + some[8]), (705, "漢字" * 40), (9, some[9]), (9, some[9])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, near string").repartition(4)
    got = remove_repeats(docs, length=20, gram=6, block=block, hot=hot).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], [(s["begin"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in got), key=repr) == plain(rows, 20)


def test_long_text_and_empty_table(spark):
    rnd = random.Random(6)
    line = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(150))
    long = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(suffix_dedup.STRETCH * 3))
    rows = [(1, long), (2, "x" + long[:-1] + line), (3, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in remove_repeats(docs).collect()}
    assert got == {1: ([], long.encode()), 2: ([(1, len(long))], b"x" + line.encode()), 3: ([(0, 150)], b"")}
    assert remove_repeats(spark.createDataFrame([], docs.schema)).collect() == []


def segments(rnd, n):
    data = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(n + 40)), np.uint8)
    start = np.array([rnd.randrange(n) for _ in range(n)])
    return data, start, np.sort(np.array([rnd.randrange(1 + n // 9) for _ in range(n)]))


@pytest.mark.parametrize("n", [1, 2, 3, 50, 1200])
def test_sort_of_suffixes(n):
    data, start, segment = segments(random.Random(n), n)
    order = sort_suffixes(Prefixes(data), start, segment, 33)
    key = lambda k: (segment[k], data[start[k] : start[k] + 33].tobytes(), k)
    assert order.tolist() == sorted(range(n), key=key)


def test_colliding_hashes(monkeypatch, spark):
    """Hashes that say nothing: neighbours out of order are found, and strings compared as they are."""
    monkeypatch.setattr(Prefixes, "hash", lambda self, at, length: (self.sums[at + length] - self.sums[at]) * self.back[at] & np.uint64(1))
    data, start, segment = segments(random.Random(2), 300)
    order, classes = equal_windows(Prefixes(data), start, segment, 33)
    string = lambda k: (segment[k], data[start[k] : start[k] + 33].tobytes())
    assert [string(k) for k in order] == sorted(map(string, range(300)))
    assert len(set(classes.tolist())) == len({string(k) for k in range(300)})
    rnd = random.Random(1)
    spans = np.zeros(40, suffix_dedup.SPAN)
    spans["windows"], spans["doc_id"], spans["key"] = 5, np.arange(40), 1
    texts_ = [rnd.choice([b"a" * 24, b"ab" * 12, b"a" * 23 + b"b"]) for _ in range(40)]
    flags = suffix_dedup.repeated(np.frombuffer(b"".join(texts_), np.uint8), spans, np.arange(40) * 24, 20)
    seen, wanted = set(), []
    for t in texts_:
        own = [t[i : i + 20] for i in range(5)]
        wanted += [(i, s) in seen for i, s in enumerate(own)]
        seen.update(enumerate(own))
    assert flags.tolist() == wanted
