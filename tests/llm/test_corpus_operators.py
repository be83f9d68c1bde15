"""Quality, language, near copies, vectors, archives and the pipeline against plain versions on small tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from auditlake.llm import embeddings, language, line_dedup, quality, shingle_join, warc
from auditlake.llm.shared import components, shared_folder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(140)] + [(k, k + 1) for k in range(300, 330)] + [(400, k) for k in range(401, 440)]
    got = dict(map(tuple, components(spark.createDataFrame([*links, (None, 1), (5, None)], "a long, b long")).collect()))
    want = reachable({x for p in links for x in p if p[0] != p[1]}, links)
    assert got == want


def test_components_without_links(spark):
    assert components(spark.createDataFrame([(1, 1), (None, None)], "a long, b long")).count() == 0


def plain_counts(text):
    t = text or ""
    words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(lines)


def test_counts_same_as_plain():
    rnd = random.Random(2)
    some = ["a", "b", "c d", "é", "\n", " ", "#", "\x85", "x|y", "\t", " ", "\x1c", "the"]
    for text in [None, "", "\n \n", "a a a a a", *("".join(rnd.choice(some) for _ in range(rnd.randint(0, 60))) for _ in range(2000))]:
        assert quality.count_text(text) == plain_counts(text), repr(text)


def good(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def test_quality(spark):
    rnd = random.Random(3)
    rows = [(k, good(rnd, rnd.randint(60, 120)), rnd.choice(["en", "de"]), rnd.choice(["a", "b"])) for k in range(400)]
    junk = [(1000 + k, " ".join(w + "&&&" for w in good(rnd, 80).split()), "en", "a") for k in range(40)] + [(1100 + k, "a | b | " * 60 + good(rnd, 9), "de", "b") for k in range(20)]
    odd = [(2000, None, "en", "a"), (2001, "", None, None), (2002, "too short", "en", "a"), (2003, "same words here " * 60, "en", "a"), (2004, good(rnd, 80), None, None), (None, good(rnd, 80), "xx", ""), (7, good(rnd, 80), "en", "a"), (7, good(rnd, 80), "en", "a")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows + junk + odd], "doc_id long, text string, lang string, source string, kept int, _lang string").repartition(3)
    got = {(r["doc_id"], r["word_chars"]): r for r in quality.judge_quality(docs, least_rows=50).collect()}
    for k, t, _, _ in rows + junk + odd:
        r = got[k, plain_counts(t)[1]]
        assert tuple(r[c] for c in quality.COUNTS) == plain_counts(t)
        n, _, _, _, again, _ = plain_counts(t)
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n)
    assert not any(r["kept"] for (k, _), r in got.items() if k and 1000 <= k < 2004)
    assert all(r["kept"] for (k, _), r in got.items() if k is None or k < 1000 or k == 2004)
    kept = quality.filter_quality(docs, least_rows=50)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == sorted([*(r[0] for r in rows), 2004, -1, 7, 7])
    assert quality.judge_quality(docs.limit(0)).count() == 0 and quality.filter_quality(docs.limit(0)).count() == 0


def test_sketches_merge(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parts = [quality.sketches(quality.counted(docs.where(f"doc_id % 2 = {k}"))) for k in (0, 1)]
    merged = parts[0].union(parts[1]).groupBy("_lang", "_source", "rate", "low").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, quality.sketches(quality.counted(docs)).collect()))


def test_bucket_keeps_leading_digits(spark):
    got = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("b")).collect()
    for r in got:
        lost = max(0, len(bin(r["id"])) - 2 - quality.DIGITS)
        assert r["b"] == r["id"] >> lost << lost


def plain_phrases(sample, text):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_phrases_same_as_plain(monkeypatch):
    monkeypatch.setattr(language, "PARSED", 50)
    rnd = random.Random(4)
    letters = {"x": "abcde ", "y": "cdefg "}
    samples = {k: "".join(rnd.choice(v) for _ in range(300)) for k, v in letters.items()}
    parser = language.CrossParser(samples)
    texts = ["".join(rnd.choice("abcdefgz, ") for _ in range(rnd.randint(0, 170))) for _ in range(40)]
    classes = [parser.classes.of(t) for t in texts]
    known = [tuple(c for c in parser.classes.of(s).tolist()) for s in samples.values()]
    as_text = lambda c: "".join(map(chr, (x + 100 for x in c)))
    for c, got in zip(classes, parser.phrases(classes).tolist(), strict=True):
        want = [sum(plain_phrases(as_text(s), as_text(c[at : at + 50].tolist())) for at in range(0, len(c), 50)) for s in known]
        assert got == want


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify_languages(docs, F.col("doc_id"), F.col("lang"), language.held_out(F.col("doc_id")).alias("held")).select("*", "_found.*").collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(None, None, "en"), (5000, "", None), (5001, "12 345 !!", "de"), (5002, "漢字", "en"), (5002, "漢字", "en"), (5003, "the and that of " * 9000, None)]
    both = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("_found", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    got = language.identify_languages(both, F.col("doc_id"), F.col("text")).where("doc_id is null or doc_id >= 5000").select("doc_id", "_found.*").collect()
    assert [r["lang_pred"] for r in got if r["doc_id"] in (None, 5000, 5001)] == ["und"] * 3
    assert all(r["lang_pred"] in {"en", "de", "fr", "es"} for r in got if r["doc_id"] == 5002)
    assert [r["lang_pred"] for r in got if r["doc_id"] == 5003] == ["en"]
    kept = language.filter_language(both)
    assert kept.columns == both.columns and kept.where("doc_id in (5000, 5001)").count() == 0
    nothing = language.identify_languages(docs.limit(3).withColumn("lang", F.lit(None).cast("string")), F.col("doc_id")).select("_found.*").distinct().collect()
    assert [tuple(r) for r in nothing] == [("und", 0.0)]
    assert language.identify_languages(docs.limit(0), F.col("doc_id")).count() == 0


def test_every_language_is_learnt(spark):
    rnd = random.Random(13)
    vocab = {f"l{k:02}": ["".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(3, 7))) for _ in range(30)] for k in range(70)}
    text = lambda name: " ".join(rnd.choice(vocab[name]) for _ in range(60))
    names = [n for k, n in enumerate(vocab) for _ in range(8 if k < 64 else 6)]
    rows = [(k, text(n), n) for k, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    got = language.identify_languages(docs, F.col("lang"), language.held_out(F.col("doc_id")).alias("held")).select("*", "_found.lang_pred").collect()
    assert {r["lang"] for r in got if r["held"]} > {f"l{k}" for k in range(64, 70)}
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_sample_of_a_language_does_not_depend_on_others(spark):
    rnd = random.Random(14)
    docs = spark.createDataFrame([(k, good(rnd, 120), f"l{k % 6}") for k in range(600)], "doc_id long, text string, lang string")
    alone = language.sample_texts(docs.where("lang = 'l3'"))
    assert language.sample_texts(docs)["l3"] == alone["l3"] and len(alone["l3"]) > 30_000


def test_languages_in_parts_same_as_together(monkeypatch):
    rnd = random.Random(15)
    samples = {f"l{k}": "".join(rnd.choice("abcdefghij "[k % 5 :]) for _ in range(400)) for k in range(7)}
    texts = pa.array([None, "", "12", "x", *("".join(rnd.choice("abcdefghijxyz, ") for _ in range(rnd.randint(0, 90))) for _ in range(600))])
    monkeypatch.setattr(language, "TOGETHER", 100)
    want = language.Parsers(samples)
    monkeypatch.setattr(language, "TOGETHER", 3)
    got = language.Parsers(samples)
    for _ in range(2):
        assert got.predict(texts) == want.predict(texts) and got.tell(texts) == want.tell(texts)


def test_language_filter_keeps_close_languages(spark):
    rnd = random.Random(12)
    rows = [(k, good(rnd, 60), rnd.choice(["en", "en-GB"])) for k in range(60)] + [(100, "a", None), (101, "12 !!", "en"), (102, None, "en"), (103, "漢字 漢字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    assert sorted(r["doc_id"] for r in language.filter_language(docs).collect()) == [*range(60), 100]
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] for r in language.filter_language(nothing).collect()) == [*range(60), 100, 103]


def shingles(text, n):
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def near_texts(seed, bases=12):
    rnd = random.Random(seed)
    vocab = [f"W{k}" for k in range(400)] + ["é", "É"]
    shared = " ".join(rnd.choice(vocab) for _ in range(30))
    out = [None, "", " ", "one", "One", "two words", "TWO words", "a b c", "a b c d", "A b c d"]
    for _ in range(bases):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([5, 8, 20, 60, 300]))]
        out.append(" ".join(words))
        for _ in range(rnd.choice([0, 1, 4, 12])):
            copy = list(words)
            for _ in range(rnd.choice([0, 1, 1, 2, max(1, len(words) // 40), max(1, len(words) // 25)])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            out.append(" ".join(copy))
        out.append(shared + " " + " ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 30, 100]))))
    return out


@pytest.mark.parametrize(("seed", "n", "percent", "tile"), [(1, 4, 85, 2_000_000), (2, 4, 85, 300), (3, 5, 80, 2_000_000), (4, 2, 50, 500)])
def test_shingle_join(spark, seed, n, percent, tile):
    texts = near_texts(seed)
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[12]), (3, texts[15]), (3, texts[15])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, component string").repartition(3)
    sets = [shingles(t, n) for _, t in rows]
    linked = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if linked(sets[i], sets[j])]
    group = reachable(range(len(rows)), links)
    ids = defaultdict(list)
    for i, g in group.items():
        ids[g].append(rows[i][0])
    smallest = {g: min((x for x in v if x is not None), default=None) for g, v in ids.items()}
    got = shingle_join.link_documents(docs, n, percent, max(3, tile // 50), tile).collect()
    want = Counter((rows[i][0], len(sets[i]), smallest[g]) for i, g in group.items())
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert shingle_join.link_documents(docs.limit(0), n, percent).count() == 0


def test_near_copies_go(spark):
    texts = near_texts(5)
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[12]), (11, texts[11]), (11, texts[11]), (700, texts[11])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, stays int").repartition(3)
    kept = shingle_join.without_near_copies(docs, 5, 80)
    assert kept.columns == docs.columns
    linked = shingle_join.link_documents(docs, 5, 80).collect()
    want = Counter({r["component_id"] for r in linked if r["component"] is not None}) + Counter(r["doc_id"] for r in linked if r["component"] is None)
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_levels_hold_every_pair():
    rnd = random.Random(7)
    for percent in (50, 80, 85, 95):
        levels = shingle_join.Levels(percent)
        for _ in range(300):
            n = rnd.choice([1, 2, 5, 9, 40, 300])
            a = {rnd.getrandbits(64) for _ in range(n)}
            b = set(rnd.sample(sorted(a), n - rnd.randint(0, n // 3))) | {rnd.getrandbits(64) for _ in range(rnd.randint(0, 1 + n // 3))}
            if 100 * len(a & b) < percent * len(a | b):
                continue
            h = [np.array(sorted(s), np.uint64) for s in (a, b)]
            got, rows = shingle_join.group_hashes(np.concatenate(h), np.array([0, len(a), len(a) + len(b)]), levels)
            assert set(got[rows == 0].tolist()) & set(got[rows == 1].tolist())


def test_tree_bounds_hold_every_pair():
    rnd = np.random.default_rng(8)
    counts = rnd.poisson(6, (500, 12))
    counts[250:] = counts[:250] + rnd.integers(-1, 2, (250, 12)).clip(-counts[:250])
    sizes = counts.sum(axis=1)
    tree = shingle_join.CountTree(counts, sizes, fanout=4)
    for k in range(500):
        bound = np.minimum(counts, counts[k]).sum(axis=1)
        want = np.flatnonzero((185 * bound >= 85 * (sizes + sizes[k])) & (100 * np.minimum(sizes, sizes[k]) >= 85 * np.maximum(sizes, sizes[k])))
        assert sorted(tree.candidates(counts[k], int(sizes[k]), 85).tolist()) == want.tolist()


def cosine(x, y):
    return math.fsum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(math.fsum(a * a for a in x) * math.fsum(b * b for b in y))


@pytest.mark.parametrize("tile_rows", [3, 4096])
def test_vectors(spark, tile_rows):
    rnd = random.Random(9)
    base = [[rnd.gauss(0, 1) for _ in range(12)] for _ in range(15)]
    rows = []
    for k in range(150):
        b = rnd.choice(base)
        rows.append((k, rnd.choice([0, 0, 1, None]), [x + rnd.gauss(0, rnd.choice([0, 0.05, 0.15])) for x in b]))
    rows += [(200, 0, None), (201, 0, []), (202, 0, [0.0] * 12), (203, 0, [float("nan")] + base[0][1:]), (204, 0, [None] + base[0][1:]), (205, 0, [float("inf")] + base[0][1:])]
    rows += [(206, 0, [x * 1e200 for x in base[0]]), (207, 0, [x * 1e-200 for x in base[0]]), (208, 0, base[0][:5]), (209, 0, [2 * x for x in base[0][:5]]), (210, 0, base[0]), (210, 0, base[0]), (None, 0, base[0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, links int").repartition(3)
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    small = lambda v: [x / max(map(abs, v)) for x in v]
    links = []
    for i in range(len(rows)):
        for j in range(i):
            (_, la, a), (_, lb, b) = rows[i], rows[j]
            if la is not None and la == lb and fine(a) and fine(b) and len(a) == len(b) and cosine(small(a), small(b)) >= 0.98:
                links.append((i, j))
    degree, group = Counter(x for p in links for x in p), reachable(range(len(rows)), links)
    ids = defaultdict(list)
    for i, g in group.items():
        ids[g].append(rows[i][0])
    least = {g: min((x for x in v if x is not None), default=None) for g, v in ids.items()}
    got = embeddings.near_vectors(frame, tile_rows=tile_rows).collect()
    want = Counter((rows[i][0], degree[i], least[g], rows[i][0] is not None and rows[i][0] == least[g]) for i, g in group.items())
    assert Counter(map(tuple, got)) == want
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_archives(spark):
    rnd = random.Random(10)
    page = lambda k: f"<html><head><title>page {k}</title></head><body>" + good(rnd, 60) + "</body></html>"
    shared = page("shared")
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(80)] + [(100 + k, "http://b.example/ x\r\ny", shared) for k in range(5)]
    rows += [(200, None, None), (201, "u", ""), (202, "u", "tiny"), (203, "u", "tiny"), (204, "é", "漢字 \r\n\r\n é" * 30), (100, "twice", shared), (None, "none", shared), (300, "long", "abc " * 300_000)]
    pages = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, payload string, bytes int").repartition(3)
    folder = shared_folder(spark, "warc-test")
    index = warc.write_archives(pages, folder, archive_bytes=1 << 12).collect()
    got = warc.read_archives(spark, folder).collect()
    assert len(index) == len(got) == len(rows) and len({r["file"] for r in index}) > 3
    payloads = {k: (h or "").encode() for k, _, h in rows}
    for r in got:
        p = payloads[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), hashlib.sha256(p).hexdigest())
        assert r["payload"] is None if r["record_type"] == "revisit" else r["payload"] == p
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds[100, "response", None] == 1 and kinds[100, "revisit", 100] == 1 and kinds[None, "revisit", 100] == 1
    assert all(kinds[100 + k, "revisit", 100] == 1 for k in range(1, 5))
    assert kinds[202, "response", None] == kinds[203, "response", None] == kinds[200, "response", None] == 1
    by_file = defaultdict(list)
    for r in index:
        by_file[r["file"]].append(r)
    path = folder.removeprefix("file://")
    for name, records in by_file.items():
        data = open(f"{path}/{name}", "rb").read()
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_MAGIC
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        for r in records:  # every record is a frame of its own
            head = unpacker.decompressobj().decompress(data[r["offset"] : r["offset"] + r["length"]])
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and r["record_id"].encode() in head


def test_dictionary_sees_all_parts_of_long_pages(spark, monkeypatch):
    rnd = random.Random(16)
    foot = good(rnd, 300)
    pages = spark.createDataFrame([(k, "u", good(rnd, 900) + foot) for k in range(60)], "page_id long, url string, html string")
    rows = warc.record_types(pages, 100)
    assert any(foot[at : at + 40].encode() in warc.train(rows, sample_bytes=2000) for at in range(len(foot) - 40))

    def fail(*_):
        raise zstandard.ZstdError("no")

    monkeypatch.setattr(zstandard, "train_dictionary", fail)
    with pytest.raises(zstandard.ZstdError):
        warc.train(rows)
    assert warc.train(rows.limit(3)) == b""


def test_archives_of_few_pages(spark):
    pages = spark.createDataFrame([(1, "u", "one"), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r["page_id"], bytes(r["payload"])) for r in warc.archive_pages(pages).collect()) == [(1, b"one"), (2, b"")]
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_pipeline(spark):
    import public_tokenizers

    import corpus_pipeline
    from auditlake.llm.tokens import load
    from tests.llm.test_text_operators import boilerplate

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9000, None, None, None, 0), (None, "", "en", "src0", 0), (9001, "!!! " * 80, "en", None, 240)], docs.schema)
    docs, seen = docs.union(odd), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        seen[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == before.columns
            docs = spark.createDataFrame(seen[name][1], before.schema)
    before, after = seen["quality rules"]
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judge_quality(spark.read.parquet(f"{SF}/documents.parquet").union(odd)).collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(k for k, kept in verdicts.items() if kept)
    before, after = seen["language ID"]
    assert all(r in before for r in after) and len(after) >= 0.98 * len(before)
    before, after = seen["line dedup"]
    want = {k: t for k, t, _, _ in boilerplate([(r["doc_id"], r["text"], r["source"]) for r in before], line_dedup.LEAST_SITES)}
    assert {r["doc_id"]: r["text"] for r in after} == want
    before, after = seen["n-gram Jaccard join"]
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in before}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in after} == set(reachable(sets, links).values())
    before, after = seen["packing"]
    library = load(public_tokenizers.path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for r in sorted(after, key=lambda r: (r["doc_id"], r["start"])):
        ids[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert dict(ids) == {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 1] for r in before}
    assert corpus_pipeline.run(spark, SF).count() > 0



def test_many_short_sets_take_little_memory():
    """A tile of sets with few shingles: their counts are what takes memory."""
    import tracemalloc

    rnd = np.random.default_rng(0)
    base, sets = rnd.integers(0, 1 << 63, 20).astype(np.uint64), []
    for other in rnd.integers(0, 1 << 63, 40_000).astype(np.uint64):
        own = base.copy()
        own[int(other) % 20] = other
        sets.append(np.sort(own).tobytes())
    tracemalloc.start()
    links = shingle_join.linked_sets(sets, np.full(len(sets), 2), 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == len(sets) - 1 and peak < 120 << 20


def test_large_group_of_near_copies_takes_one_walk():
    import time

    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = []
    for _ in range(6804):
        own = base.copy()
        own[rnd.integers(0, 60, 2)] = rnd.integers(0, 1 << 63, 2).astype(np.uint64)
        sets.append(np.unique(own).tobytes())
    start = time.perf_counter()
    links = shingle_join.linked_sets(sets, np.full(len(sets), 2), 80)
    assert len(links) == len(sets) - 1 and time.perf_counter() - start < 10


def test_hashing_documents_holds_little(monkeypatch):
    """A task remembers so many words, and packs group hashes once it has so many, however many documents it reads."""
    import pyarrow as pa

    held, most = [], []
    stars, shingle_sets = shingle_join.stars, shingle_join.shingle_sets
    monkeypatch.setattr(shingle_join, "stars", lambda h, n: held.append(len(h)) or stars(h, n))
    monkeypatch.setattr(shingle_join, "shingle_sets", lambda t, n, known: (shingle_sets(t, n, known), most.append(len(known)))[0])
    texts = [" ".join(f"w{k * 300 + i}" for i in range(300)) for k in range(3000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": texts, "text_hash": list(range(3000))})
    rows = [r for part in shingle_join.hash_documents(iter([batch]), 5, 80, 16) for r in part]
    assert sum(r[1] == shingle_join.DOCUMENT for r in rows) == 3000
    assert len(held) > 1 and max(held) < 500_000 and max(most) <= 50_001


def test_language_table_is_held_once():
    """While a worker makes the table of its languages, it takes little more than the table."""
    import tracemalloc

    letters = "".join(map(chr, [*range(0x61, 0x7B), *range(0x3B1, 0x3CA), *range(0x430, 0x450)]))
    samples = {str(k): "".join(random.Random(k).choices(letters + " ", k=16000)) for k in range(3)}
    automata = language.CrossParser(samples).automata
    tracemalloc.start()
    try:
        parser = language.CrossParser(samples, automata)
        least, most = parser.step.nbytes, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < least + (6 << 20) < 2 * least


def test_large_groups_are_cut_by_size(spark):
    """Every two sets whose sizes allow a link meet, in few tiles of a bounded number of sets; other groups stay whole."""
    sizes = [10 + k % 800 for k in range(1600)] + [100] * 400
    rows = [(k, 7, n) for k, n in enumerate(sizes)] + [(5000 + k, 8, 50) for k in range(20)]
    members = spark.createDataFrame(rows, "node long, super long, n long")
    placed = shingle_join.tasks_of(members, F.lit(1), 40, 80).collect()
    assert len(placed) == len(rows) and all((r["whole"] is None) == (r["super"] == 7) for r in placed)
    assert all(r["tile"] == 0 and r["ks"] == [0] for r in placed if r["super"] == 8)
    large = [r for r in placed if r["super"] == 7]
    held = Counter(r["tile"] for r in large)
    assert max(held.values()) <= 80 and len(held) > 40
    ks, low, high = {}, {}, {}
    for r in large:
        ks[r["tile"]] = set(r["ks"])
        low[r["tile"]], high[r["tile"]] = min(low.get(r["tile"], r["n"]), r["n"]), max(high.get(r["tile"], 0), r["n"])
    for a in ks:
        for b in ks:
            assert (b in ks[a]) == (100 * high[a] >= 80 * low[b] and 100 * high[b] >= 80 * low[a]) == (a in ks[b])
    assert sum(len(r["ks"]) for r in large) < len(large) * len(held) / 2
