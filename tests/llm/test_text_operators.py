"""Packing, sharding, token files, encoding and line removal against plain versions on small tables."""

import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from auditlake.llm import line_dedup, separators, sharding
from auditlake.llm.packing import pack_documents, place
from auditlake.llm.shared import shared_folder
from auditlake.llm.tokens import ByteEncoder, WordEncoder, load
from auditlake.llm.tree_bpe import Node, encode_documents, halves, join

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "b", "é", "ß", "S", " ", "  ", "\n", "'s", "t", "1", "23", "α", "漢", ".", "!!", "<|endoftext|>", "<|startoftext|>", " the", "\r\n", "🙂", "́", "İ", "tion", "aaaaaaaa"]
ODD = [None, "", " ", "\n\n", "a", "don't  stop", "x" * 3000, "word " * 3000, "é́ İstanbul 漢字", "<|endoftext|> is text", "same", "same"]


def texts(seed, count, pieces=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, pieces))) for _ in range(count)]


def table(spark, rows, parts=3):
    """documents with names that operators use themselves as extra columns."""
    rows = [(k, t, "s", 1, "x", 2) for k, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row int, ids string, shard int").repartition(parts)


@pytest.mark.parametrize(("encoder", "path"), [(ByteEncoder, BYTES), (WordEncoder, WORDS)])
def test_encoders_same_as_library(encoder, path):
    own, library = encoder(path), load(path)
    some = [t or "" for t in ODD] + texts(1, 600)
    assert own.encode(some) == [array("I", x.ids).tobytes() for x in library.encode_batch(some, add_special_tokens=False)]


def test_place_fills_sequences():
    rnd = np.random.default_rng(0)
    lengths = rnd.integers(1, 65, 400)
    count = int(lengths.sum()) // 64
    placed, left = place(lengths, 64, count, 1.0, 0.1)
    filled = defaultdict(int)
    for _, a, b, s in placed:
        filled[s] += b - a
    assert set(filled.values()) == {64} and len(filled) == count
    assert sum(b - a for _, a, b in left) == lengths.sum() - 64 * count
    cuts = sorted([(k, a, b) for k, a, b, _ in placed] + left)
    assert all(sum(b - a for k, a, b in cuts if k == i) == n for i, n in enumerate(lengths))


def test_packing(spark):
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, "again"), (3, "again")] + [(100 + k, t) for k, t in enumerate(texts(2, 60))]
    got = pack_documents(table(spark, rows), BYTES, capacity=64, block=512).collect()
    library = load(BYTES)
    whole = lambda t: array("I", [*library.encode(t or "", add_special_tokens=False).ids, 1]).tobytes()
    by_sequence, by_doc = defaultdict(list), defaultdict(bytes)
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["start"])):
        assert len(r["ids"]) == 4 * r["length"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]] += r["ids"]
    for k, t in rows:
        if k not in (None, 3):
            assert by_doc[k] == whole(t)
    assert by_doc[None] == whole("no id") and sorted(by_doc[3]) == sorted(whole(ODD[3]) + 2 * whole("again"))
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 64 or end & (end - 1) == 0
    assert pack_documents(table(spark, []), BYTES).count() == 0


def test_sharding(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice(["hot"] * 2 + [f"text {k} " * rnd.randint(1, 9)])) for k in range(3000)] + [(None, None), (1, ""), (7, "hot"), (7, "hot")]
    got = sharding.shard_documents(table(spark, rows), 8)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    got = got.collect()
    want = sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    assert set(by_shard) == set(range(8))
    for members in by_shard.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    sizes = [sum(r["size"] for r in m) for m in by_shard.values()]
    assert max(sizes) < 1.06 * sum(sizes) / 8 and min(sizes) > 0.94 * sum(sizes) / 8
    assert sharding.shard_documents(table(spark, []), 8).count() == 0


def test_shards_keep_small_groups_together(spark):
    rows = [(k, f"text {k // 2}") for k in range(4000)]
    groups = sharding.shard_documents(table(spark, rows), 4).groupBy("text_crc32").agg(F.countDistinct("shard").alias("n"))
    assert groups.where("n > 1").count() == 0


def test_range_of(spark):
    splitters = sorted(random.Random(1).sample(range(1000), 37))
    got = spark.range(0, 1000).select("id", sharding.range_of(F.col("id"), splitters).alias("r")).collect()
    assert all(r["r"] == sum(s <= r["id"] for s in splitters) for r in got)


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_separator_scan(spark, tmp_path, block_bytes):
    files = {"part-a.bin": [5, 0, 0, 7, 8, 9, 0, 4], "part-b.bin": [0], "part-c.bin": [1, 2, 3], "part-d.bin": [], "part-e.bin": [6] * 50 + [0]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    want = []
    for name, ids in files.items():
        start, ordinal = 0, 0
        for at, i in enumerate(ids):
            if i == 0:
                want.append((name, ordinal, start, at - start, True))
                start, ordinal = at + 1, ordinal + 1
        if start < len(ids):
            want.append((name, ordinal, start, len(ids) - start, False))
    got = separators.count_tokens(spark, str(tmp_path), 0, block_bytes=block_bytes)
    assert sorted(map(tuple, got.select("file", "ordinal", "start", "n_tokens", "ended").collect())) == sorted(want)


def test_separator_scan_groups_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(separators, "GROUP", 3)
    ids = random.Random(5).choices([0, 1, 2, 3], k=400)
    (tmp_path / "x.bin").write_bytes(np.array(ids, "<u2").tobytes())
    ends = [k for k, i in enumerate(ids) if i == 0]
    got = separators.count_tokens(spark, str(tmp_path), 0, block_bytes=8).where("ended").orderBy("ordinal").collect()
    assert [r["n_tokens"] for r in got] == [b - a - 1 for a, b in zip([-1, *ends], ends, strict=False)]


def test_document_tokens(spark):
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, "again"), (3, "again")]
    got = separators.document_tokens(table(spark, rows), BYTES, 50256, block_bytes=64).collect()
    library = load(BYTES)
    library.encode_special_tokens = True
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(k), count(t)) for k, t in rows)
    assert separators.document_tokens(table(spark, []), BYTES, 50256).count() == 0


def test_tree_joins_are_exact():
    tokenizer, rnd = load(WORDS), random.Random(6)
    for k in range(800):
        some = rnd.sample(PIECES, rnd.randint(1, 8))
        text = "".join(rnd.choice(some) for _ in range(rnd.randint(1, 100)))
        nodes = [Node(p, array("I", tokenizer.encode(p, add_special_tokens=False).ids)) for p in halves(text, rnd.choice([4, 8, 40]))]
        while len(nodes) > 1:
            nodes = [join(tokenizer, *p, width=rnd.choice([2, 8, 64])) if len(p) == 2 else p[0] for p in (nodes[i : i + 2] for i in range(0, len(nodes), 2))]
        assert list(nodes[0].ids) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("leaf_chars", [16, 1 << 15])
def test_encode_documents(spark, leaf_chars):
    rows = list(enumerate(ODD)) + [(None, "no id, long enough to be cut"), (3, "again and again " * 4), (3, "again and again " * 4)] + [(50 + k, t) for k, t in enumerate(texts(7, 40))]
    got = encode_documents(table(spark, rows), WORDS, leaf_chars).collect()
    library = load(WORDS)
    want = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(k), len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert encode_documents(table(spark, []), WORDS).count() == 0


def boilerplate(rows, least_sites, most_removed=0.5):
    import re

    words = re.compile(r"[^\x20\x09-\x0D]+")
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n") if t is not None else []:
            if len(words.findall(line)) >= 3:
                sites[line.strip(line_dedup.SPACES)].add(s or "")
    flagged = {x for x, s in sites.items() if len(s) >= least_sites}
    out = []
    for k, t, _ in rows:
        if t is None:
            out.append((k, None, 0, 0))
            continue
        own = t.split("\n")
        gone = [x.strip(line_dedup.SPACES) in flagged for x in own]
        if sum(len(x) for x, g in zip(own, gone, strict=True) if g) > most_removed * sum(map(len, own)):
            gone = [False] * len(own)
        out.append((k, "\n".join(x for x, g in zip(own, gone, strict=True) if not g), len(own), sum(gone)))
    return out


@pytest.mark.parametrize("in_place", [0, 1000])
def test_line_removal(spark, in_place):
    rnd = random.Random(8)
    lines = [f"line number {k} of the site" for k in range(12)] + ["short line", "", "  padded line of words \r", "all rights reserved"]
    rows = [(k, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 9))), rnd.choice([None, "", "a", "b", "c", "d"])) for k in range(60)]
    rows += [(100, None, "a"), (101, "", "b"), (102, "all rights reserved", "a"), (102, "all rights reserved", "a"), (103, "unlike any other line\nall rights reserved", "zz")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, _doc string").repartition(3)
    got = line_dedup.remove_boilerplate(docs, least_sites=4, in_place=in_place).select("_doc.doc_id", "_cut.*").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(boilerplate(rows, 4), key=repr)
    assert line_dedup.without_boilerplate(docs).columns == docs.columns
    assert line_dedup.remove_boilerplate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("in_place", [0, 1000])
def test_line_removal_spares_copies_only(spark, in_place):
    rnd = random.Random(9)
    words = lambda k: " ".join(rnd.choice("abcdefghijklmnop") + str(rnd.randrange(500)) for _ in range(k))
    menu = [f"menu {k} " + words(12) for k in range(6)]
    own = [words(40) for _ in range(20)]
    rows = [(k, "\n".join([own[k], *rnd.sample(menu, 5)]), f"s{k}") for k in range(20)]  # mostly menu, no copies
    article = [words(15) for _ in range(8)]
    rows += [(100 + k, "\n".join([*article, menu[0]]), f"s{k}") for k in range(9)]  # copies, with a line of the menu
    rows += [(200 + k, "\n".join([words(3), *article]), f"t{k}") for k in range(9)]  # near copies
    rows += [(300, None, "a"), (301, "", "b"), (302, "\n".join(menu), None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, _doc string").repartition(3)
    got = {r["doc_id"]: r for r in line_dedup.remove_all_boilerplate(docs, in_place=in_place).select("_doc.doc_id", "_cut.*").collect()}
    assert len(got) == len(rows)
    for k, text, _ in rows:
        left = None if text is None else "\n".join(x for x in text.split("\n") if x not in menu)
        assert got[k]["text"] == left and got[k]["n_removed"] == sum(x in menu for x in (text or "").split("\n"))
    assert line_dedup.without_boilerplate(docs.limit(0)).count() == 0


def test_line_removal_of_the_pipeline(spark):
    menu = [f"menu {k} of all these many sites" for k in range(6)]
    rows = [(k, "\n".join([f"own {k} words", *menu]), f"s{k}") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert line_dedup.without_boilerplate(docs.limit(4)).where("text not like '%menu%'").count() == 0
    varied = docs.withColumn("text", F.concat(F.repeat(F.concat(F.col("source"), F.lit(" x ")), 40), F.lit("\n"), F.substring_index("text", "\n", -6), F.repeat(F.lit("\nmenu 0 of all these many sites"), 50)))
    assert [r["text"].count("menu") for r in line_dedup.without_boilerplate(varied).collect()] == [0] * 5


def test_sketches_only_decide_far_from_the_threshold(spark):
    rows = [(k, f"a line on {n} sites", f"s{k}") for n in (5, 18, 19, 20, 21, 400) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.spread_lines(docs, least_sites=20).collect()
    assert len(got) == 3 and sorted(r["sites"] for r in got)[:2] == [20, 21]


def test_shared_folders_differ(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
