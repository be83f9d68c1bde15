"""Alignment of two tokenizers against the libraries and plain loops."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from auditlake.llm import alignment
from auditlake.llm.alignment import Aligner, ByteSide, PieceSide, Speller, align_documents, group_ends, irregular_groups

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the ", " é", "漢字", "🙂", "\n", "  ", "<|endoftext|>", "<s>", "▁", "tion", "1234", "\x00", "\t", "<0x41>", "Hello", "zzzz", "́", "ſ", "</s>"]


def byte_values():
    """Characters of byte-level tokens and the bytes they stand for, as the published rule has it."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(moved)}


def plain(rows):
    """Ends as sets, every pair of occurrences one by one."""
    a_lib, b_lib = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_lib.encode_special_tokens = True
    value = byte_values()
    a_bytes = lambda i: bytes(value[c] for c in a_lib.id_to_token(i))
    b_bytes = lambda i: bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) and (p := b_lib.id_to_piece(i)) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    docs, holders = [], Counter()
    for k, t in rows:
        a = a_lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_lib.encode(t) if t else []
        whole = (" " + (t or "")).encode()
        if not t or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            docs.append((k, None))
            continue
        ends = lambda ids, size: np.cumsum([len(size(i)) for i in ids]).tolist()
        end_a, end_b = ends(a, a_bytes), ends(b, b_bytes)
        both = np.array(sorted(set(end_a) & set(end_b)))
        groups = [([], []) for _ in both]
        for side, ids, at in ((0, a, end_a), (1, b, end_b)):
            for i, e in zip(ids, at, strict=True):
                groups[np.searchsorted(both, e)][side].append(i)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        holders.update(links.keys())
        docs.append((k, (len(a), len(b), groups, links)))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    out = []
    for k, found in docs:
        if not found:
            out.append((k, 0, 0, 0, 0, "", 0, 0))
            continue
        n_a, n_b, groups, links = found
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if holders[p] == most[p[0]])
        out.append((k, n_a, n_b, len(groups), sum(links.values()), hashlib.sha256(text.encode()).hexdigest(), best, sum(n * holders[p] for p, n in links.items())))
    return Counter(out)


def test_alignment(spark):
    rnd = random.Random(8)
    rows = [(k, "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60)))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, " "), (203, "same text here"), (204, "same text here"), (204, "same text here"), (None, "no id"), (205, "🙂" * 3000), (206, "x" * 5000), (207, "word and more " * 3000)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, block int, pairs string, at int").repartition(3)
    got = Counter(tuple(r) for r in align_documents(docs, BYTES, PIECES, block=2000).collect())
    assert got == plain(rows)
    assert align_documents(spark.createDataFrame([], docs.schema), BYTES, PIECES).collect() == []


def test_groups_of_random_ends():
    rnd = np.random.default_rng(3)
    for n in (1, 2, 7, 60, 500) * 40:
        a, b = (np.unique(np.append(rnd.integers(1, n + 1, rnd.integers(0, n + 1)), n)).astype(np.uint32) for _ in range(2))
        spans = np.array(irregular_groups(a.tobytes(), b.tobytes()), np.int64).reshape(-1, 4)
        ends_a, ends_b = group_ends(len(a), spans[:, 0], spans[:, 2]), group_ends(len(b), spans[:, 1], spans[:, 3])
        assert a[ends_a - 1].tolist() == b[ends_b - 1].tolist() == np.intersect1d(a, b).tolist()


def test_stretches_are_jumped():
    """Millions of tokens one to one take a few comparisons."""
    ends = np.arange(1, 5_000_001, dtype=np.uint32)
    other = np.delete(ends, 2_500_000)
    start = time.perf_counter()
    assert irregular_groups(ends.tobytes(), other.tobytes()) == [(2_500_000, 2_500_000, 2_500_002, 2_500_001)]
    assert time.perf_counter() - start < 1


def test_chunks_same_as_whole_texts():
    rnd = random.Random(11)
    speller = Speller(ByteSide(BYTES), PieceSide(PIECES))
    assert speller.by_chunks
    parts = [*PARTS, " ", " ", "\u3000", "\xa0", "\r\n", "'s", "don't", " a", "\n\n", "  \n ", "\u200b", "\u2028", "\x1d"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25)))
        got, whole = speller.ids(text), (speller.a.ids(text), speller.b.ids(text))
        spelled = speller.a.spells(whole[0], (" " + text).encode()) and speller.b.spells(whole[1], (" " + text).encode())
        assert (got is None) != spelled
        assert got is None or (got[0].tolist(), got[1].tolist()) == whole


def told(found):
    return found and (found[0], found[1].tolist(), found[2].tolist())


def test_groups_of_chunks_same_as_of_whole_texts(monkeypatch):
    """Groups of a chunk are found once, whatever chunks are remembered, learnt or linked together."""
    rnd = random.Random(12)
    parts = [*PARTS, " ", " ", " ", "\xa0", "\n\n", " 漢字漢字🙂🙂é", "don't", "\x1d"]
    texts = [None, "", *("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(300))] * 2
    aligner = Aligner(ByteSide(BYTES), PieceSide(PIECES))
    whole = [told(aligner.align_whole(t)) if t else None for t in texts]
    searched = []
    monkeypatch.setattr(alignment, "irregular_groups", lambda a, b: searched.append(len(a)) or irregular_groups(a, b))
    for limits in ({}, {"CHUNK_LINKS": 6}, {"CHUNKS_KNOWN": 20, "CHARS_TOGETHER": 300}, {"CHUNKS_TOGETHER": 3, "CHUNKS_LINKED": 2}):
        with monkeypatch.context() as patch:
            for name, value in limits.items():
                patch.setattr(alignment, name, value)
            aligner.forget()
            assert list(map(told, aligner.align_all(texts))) == whole
    aligner.forget()
    plain = ["the same words, and again"] * 500
    list(aligner.align_all(plain))
    searched.clear()
    assert len(list(aligner.align_all(plain))) == 500 and not searched
