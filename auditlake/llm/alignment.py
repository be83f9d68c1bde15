"""Alignment of two tokenizers over whole texts, and how often their ids are linked in a corpus."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from auditlake.llm.shared import map_rows, slices, small_batches, staged
from auditlake.llm.tokens import ByteEncoder, as_bytes

#: Characters of text of a block, whose distinct id pairs are counted before any shuffle.
BLOCK = 4 << 20
#: Links made at once, and the most of a group that are made one by one; larger groups are counted by distinct ids.
LINKS, SINGLE = 1 << 20, 4096
#: Chunks of text that a task remembers, and bytes of their groups and links; the most links of a chunk that is remembered.
CHUNKS_KNOWN, BYTES_KNOWN, CHUNK_LINKS = 450_000, 96 << 20, 1024
#: Characters of texts whose chunks are learnt together, chunks that are learnt at once, and chunks of a text whose links are counted at once.
CHARS_TOGETHER, CHUNKS_TOGETHER, CHUNKS_LINKED = 1 << 19, 2048, 1 << 13
#: Ends that are compared one by one before stretches are.
SINGLY = 4
#: Bytes of rows with blocks that go to a Python worker at once.
BATCH = "16m"

DOCS = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string())]
BLOCKS = pa.schema(
    [("block", pa.int64()), *((c, pa.list_(t)) for c, t in DOCS), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64())), ("linked", pa.binary())]
)
ALIGNED = pa.schema([*DOCS, ("n_best", pa.int64()), ("count_sum", pa.int64())])


class Side:
    """Bytes of every id of a vocabulary."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.lengths = np.array([len(p) for p in pieces], np.uint32)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return self.lengths[ids].cumsum(dtype=np.uint32)

    def spells(self, ids: list[int], text: bytes) -> bool:
        return b"".join(map(self.pieces.__getitem__, ids)) == text


class ByteSide(Side):
    """Byte-level vocabulary of the tokenizers library; names of special tokens are text like any other."""

    def __init__(self, path: str):
        import tokenizers

        self.encoder = ByteEncoder(path, special=False)
        library = tokenizers.Tokenizer.from_file(path)
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others are moved up
        letters = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        names = [library.id_to_token(i) or "" for i in range(library.get_vocab_size(with_added_tokens=True))]
        super().__init__([bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names])

    def ids(self, text: str) -> list[int]:
        return self.encoder.ids(" " + text)


class PieceSide(Side):
    """Sentence pieces, which put a space before a text themselves."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        single = re.compile("<0x([0-9A-F]{2})>")
        super().__init__([bytes.fromhex(m[1]) if (m := single.fullmatch(n)) else n.replace("▁", " ").encode() for n in names])

    def ids(self, text: str) -> list[int]:
        return self.processor.encode(text)


#: Signs that libraries take for white space or not, or that stand for another one: texts with them, or with endless words, are encoded as wholes.
ODD, ENDLESS = "\x00\x1c\x1d\x1e\x1f▁", 1000
#: A space, where both vocabularies begin anew, and a sign that texts with it (``ODD``) keep from being cut into chunks.
BETWEEN = " \x1d"
#: White space and the word after it. Both vocabularies begin anew there, so chunks repeat with the same ids.
CHUNKS = re.compile(r"\s*\S+|\s+")


class Speller:
    """Ids of texts by two sides; None where one doesn't spell a text byte by byte.

    The byte-level pattern never joins other signs with white space after them, and pieces have none
    after their first sign (texts with what some have are encoded as wholes), so the ids of a text are
    those of its chunks. Chunks repeat; ``spell`` encodes, and compares the bytes of, many at once.
    """

    def __init__(self, a: ByteSide, b: PieceSide):
        self.a, self.b = a, b
        names = [b.processor.id_to_piece(i) for i in range(len(b.pieces))]
        later = [n.lstrip("▁") if n[0] == "▁" else n[1:] for n in names]
        #: white space that pieces have after their first sign (a carriage return, say): texts with it are encoded as wholes
        self.inner = {s for n in later for s in n if s.isspace() or s == "▁"}
        self.mark_a, self.mark_b = (side.ids("a" + BETWEEN)[len(side.ids("a")) :] for side in (a, b))
        sign = BETWEEN[1].encode()
        alone = all(p == sign for side in (a, b) for p in side.pieces if sign in p) and a.pieces[self.mark_a[-1]] == sign == b.pieces[self.mark_b[-1]]
        self.by_chunks = a.encoder.fast is not None and "▁" not in self.inner and alone

    def chunks(self, text: str) -> list[str]:
        """The chunks of a space and a text; none where the text is to be encoded as a whole."""
        chunks = CHUNKS.findall(" " + text) if self.by_chunks and not any(s in text for s in (*ODD, *self.inner)) else []
        return chunks if chunks and max(map(len, chunks)) < ENDLESS else []

    def spell(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids of different chunks, four bytes each, but for chunks that a side doesn't spell.

        They are encoded as one text, with a sign between that no token of a chunk reaches over and that chunks don't have.
        """
        words = [c for c in chunks if not c.isspace()]
        text = BETWEEN + BETWEEN.join(words) + BETWEEN
        parts, found = [], {}
        spelled = (" " + text).encode()
        for side, drop in ((self.a, self.mark_a), (self.b, self.mark_b)):
            ids = self.a.encoder.fast.encode_ordinary(" " + text) if side is self.a else side.ids(text)
            if not side.spells(ids, spelled):
                break
            flat = np.array(ids, "<u4")
            ends = np.flatnonzero(flat == drop[-1])
            parts.append((flat.tobytes(), (4 * ends[:-1] + 4).tolist(), (4 * (ends[1:] - len(drop) + 1)).tolist()))
        if len(parts) == 2 and all(len(x) == len(words) for _, *p in parts for x in p):
            (a, *at_a), (b, *at_b) = parts
            found = {c: (a[i:j], b[k:m]) for c, i, j, k, m in zip(words, *at_a, *at_b, strict=True)}
        for c in chunks:
            if c not in found and (alone := self.spell_alone(c)):
                found[c] = alone
        return found

    def spell_alone(self, chunk: str) -> tuple[bytes, bytes] | None:
        a = self.a.encoder.ids(chunk)
        # a space before a text is its own; other white space is no part of a piece with it
        b = self.b.ids(chunk[1:]) if chunk[0] == " " else self.b.ids(chunk)[1:]
        return (as_bytes(a), as_bytes(b)) if self.a.spells(a, chunk.encode()) and self.b.spells(b, chunk.encode()) else None

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        chunks = self.chunks(text)
        known = self.spell(list(set(chunks))) if chunks else {}
        if chunks and len(known) == len(set(chunks)):
            return tuple(np.frombuffer(b"".join(known[c][k] for c in chunks), "<u4").astype(np.int64) for k in (0, 1))
        ids = self.a.ids(text), self.b.ids(text)
        spelled = b" " + text.encode()
        return tuple(np.array(x, np.int64) for x in ids) if self.a.spells(ids[0], spelled) and self.b.spells(ids[1], spelled) else None


def irregular_groups(a: bytes, b: bytes) -> list[tuple[int, int, int, int]]:
    """Groups of more than a token to a token, as (from, from, to, to) of the two sides; all between them are one to one.

    ``a`` and ``b`` are token ends as unsigned 32-bit numbers, with the same last end. At the current
    shift between the indices, a few ends are compared one by one, then stretches of both arrays as
    wholes, each twice as long as the last, until one differs; halving finds the place. There the side that is behind goes on, token
    by token, until both end at the same byte, which gives the new shift.
    """
    n = len(a) // 4
    x, y = (memoryview(v).cast("I") if n > BLOCK else array("I", v).tolist() for v in (a, b))
    i = j = run = 0
    found = []
    while i < n:
        p, q = x[i], y[j]
        if p == q:
            i, j, run = i + 1, j + 1, run + 1
            if run < SINGLY:
                continue
            step, growing = SINGLY, True
            while step:
                u = 4 * (i + step)
                if u <= 4 * n and a[4 * i : u] == b[4 * j : 4 * (j + step)]:
                    i, j = i + step, j + step
                    step = 2 * step if growing else step // 2
                else:
                    growing = False
                    step //= 2
            if i == n:
                break
            p, q = x[i], y[j]
        run, s, t = 0, i, j
        while p != q:
            if p < q:
                i += 1
                p = x[i]
            else:
                j += 1
                q = y[j]
        i, j = i + 1, j + 1
        found.append((s, t, i, j))
    return found


def group_ends(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Index after the last token of every group of a side, from the spans of its irregular groups."""
    inner = np.zeros(n + 1, np.int32)
    np.add.at(inner, begin, 1)
    np.add.at(inner, end - 1, -1)
    return np.flatnonzero(inner.cumsum()[:n] == 0) + 1


def linked_pairs(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct linked id pairs (A's id in the upper half) of all groups, and how many links each has."""
    begin_a, begin_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    size_a, size_b = ends_a - begin_a, ends_b - begin_b
    links = size_a * size_b
    keys, times = [], []
    for g in np.flatnonzero(links > SINGLE):  # by distinct ids: their number is bounded by the vocabularies
        u, m = np.unique(a[begin_a[g] : ends_a[g]], return_counts=True)
        v, n = np.unique(b[begin_b[g] : ends_b[g]], return_counts=True)
        keys.append(((u[:, None] << 32) | v[None, :]).ravel())
        times.append((m[:, None] * n[None, :]).ravel())
    small = np.flatnonzero(links <= SINGLE)
    total = links[small].cumsum()
    at = 0
    while at < len(small):
        to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + LINKS, "right")), at + 1)
        k, n = np.unique(links_of(small[at:to], a, b, begin_a, begin_b, size_b, links), return_counts=True)
        keys.append(k)
        times.append(n)
        at = to
    return merged_pairs(keys, times)


def links_of(some: np.ndarray, a: np.ndarray, b: np.ndarray, begin_a: np.ndarray, begin_b: np.ndarray, size_b: np.ndarray, links: np.ndarray) -> np.ndarray:
    """All links of some groups, one by one, in the order of the groups."""
    which = np.repeat(np.arange(len(some)), links[some])
    place = np.arange(len(which)) - np.repeat(links[some].cumsum() - links[some], links[some])
    group = some[which]
    return a[begin_a[group] + place // size_b[group]] << 32 | b[begin_b[group] + place % size_b[group]]


def merged_pairs(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of several lists of distinct pairs, and the sums of their links."""
    if len(keys) == 1:
        return keys[0], times[0]
    keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    whole = np.zeros(len(keys), np.int64)
    np.add.at(whole, inverse, np.concatenate(times))
    return keys, whole


class Aligner:
    """Tokens, groups and linked pairs of whole texts.

    Tokens of both sides end where a chunk ends, so the groups of a text are those of its chunks. They
    are found, written and linked once for a chunk and then remembered. Texts that are not cut, or
    with a chunk of many links or one that a side doesn't spell, are aligned as wholes.
    """

    def __init__(self, a: Side, b: Side):
        self.a, self.b, self.speller = a, b, Speller(a, b)
        # an id of A is followed by a comma or a bar, one of B by a point (a comma in the end) or a semicolon
        self.written = [f"{i}{mark}".encode() for side, marks in ((a, ",|"), (b, ".;")) for mark in marks for i in range(len(side.pieces))]
        self.forget()

    def forget(self) -> None:
        self.groups: dict[str, bytes] = {}
        self.links: dict[str, bytes] = {}
        self.whole: set[str] = set()
        self.size = 0

    def group(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index after the last token of every group, by side."""
        spans = np.array(irregular_groups(self.a.ends(a).tobytes(), self.b.ends(b).tobytes()), np.int64).reshape(-1, 4)
        return group_ends(len(a), spans[:, 0], spans[:, 2]), group_ends(len(b), spans[:, 1], spans[:, 3])

    def signs(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> list[bytes]:
        """All ids by group as ``a1,a2|b1;a3|b2.b3;``, one by one."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[ends_a - 1] = last_b[ends_b - 1] = 1
        n_a, n_b = len(self.a.pieces), len(self.b.pieces)
        group_a, group_b = last_a.cumsum() - last_a, last_b.cumsum() - last_b
        # before an id are those of its side, and those of the other up to its group
        signs = np.empty(len(a) + len(b), np.int64)
        signs[np.arange(len(a)) + (ends_b[group_a] - np.diff(ends_b, prepend=0)[group_a])] = a + last_a * n_a
        signs[np.arange(len(b)) + ends_a[group_b]] = b + 2 * n_a + last_b * n_b
        return [self.written[i] for i in signs.tolist()]

    def learn(self, chunks: list[str]) -> None:
        """Groups and links of different chunks, found as those of one text."""
        spelled = self.speller.spell(chunks)
        self.whole.update(c for c in chunks if c not in spelled)
        if not spelled:
            return
        a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in zip(*spelled.values(), strict=True))
        to_a, to_b = (np.array([len(x[k]) // 4 for x in spelled.values()]).cumsum() for k in (0, 1))
        ends_a, ends_b = self.group(a, b)
        begin_a, begin_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
        size_b = ends_b - begin_b
        links = (ends_a - begin_a) * size_b
        to = np.searchsorted(ends_a, to_a) + 1  # groups up to the end of each chunk
        each = np.diff(links.cumsum()[to - 1], prepend=0)
        kept = each <= CHUNK_LINKS
        some = np.flatnonzero(np.repeat(kept, np.diff(to, prepend=0)))
        data = links_of(some, a, b, begin_a, begin_b, size_b, links).astype("<i8").tobytes()
        signs = self.signs(a, b, ends_a, ends_b)
        at = place = 0
        for chunk, good, sign, n in zip(spelled, kept.tolist(), (to_a + to_b).tolist(), (8 * each).tolist(), strict=True):
            if good:
                self.groups[chunk], self.links[chunk] = b"".join(signs[at:sign]), data[place : place + n]
                place += n
            else:
                self.whole.add(chunk)
            at = sign
        self.size += len(data) + 6 * len(signs)

    def align_all(self, texts: list[str | None]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray] | None]:
        """For each text (n_a, n_b, n_groups, n_links, digest of the groups), linked pairs and their links; None without tokens.

        New chunks of neighbouring texts are learnt together.
        """
        at = 0
        while at < len(texts):
            cut, chars = [], 0
            while at < len(texts) and chars < CHARS_TOGETHER:
                cut.append((texts[at], self.speller.chunks(texts[at]) if texts[at] else []))
                chars += len(texts[at] or "")
                at += 1
            if len(self.groups) + len(self.whole) > CHUNKS_KNOWN or self.size > BYTES_KNOWN:
                self.forget()
            every = set().union(*(chunks for _, chunks in cut))
            new = list(every.difference(self.groups, self.whole))
            for k in range(0, len(new), CHUNKS_TOGETHER):
                self.learn(new[k : k + CHUNKS_TOGETHER])
            for text, chunks in cut:
                if not text:
                    yield None
                elif chunks and self.whole.isdisjoint(chunks):
                    yield self.align_chunks(chunks)
                else:
                    yield self.align_whole(text)

    def align_whole(self, text: str) -> tuple[tuple, np.ndarray, np.ndarray] | None:
        ids = self.speller.ids(text)
        if ids is None:
            return None
        ends = self.group(*ids)
        return self.told(b"".join(self.signs(*ids, *ends)), *linked_pairs(*ids, *ends))

    def align_chunks(self, chunks: list[str]) -> tuple[tuple, np.ndarray, np.ndarray]:
        found = []
        for k in range(0, len(chunks), CHUNKS_LINKED):
            links = b"".join(map(self.links.__getitem__, chunks[k : k + CHUNKS_LINKED]))
            found.append(np.unique(np.frombuffer(links, "<i8"), return_counts=True))
        return self.told(b"".join(map(self.groups.__getitem__, chunks)), *merged_pairs(*map(list, zip(*found, strict=True))))

    @staticmethod
    def told(groups: bytes, pairs: np.ndarray, times: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray]:
        n = {mark: groups.count(mark) for mark in (b",", b"|", b".", b";")}
        digest = hashlib.sha256(groups[:-1].replace(b".", b",")).hexdigest()
        return (n[b","] + n[b"|"], n[b"."] + n[b";"], n[b"|"], int(times.sum()), digest), pairs, times


class Block:
    """What is kept of the documents of a block: their counts, and linked pairs as places in the list of the block's distinct pairs."""

    def __init__(self, key: int):
        self.key, self.docs, self.pairs, self.times, self.chars = key, [], [], [], 0

    def add(self, doc_id: int | None, text: str | None, found: tuple | None) -> None:
        counts, pairs, times = found or ((0, 0, 0, 0, ""), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.docs.append((doc_id, *counts))
        self.pairs.append(pairs)
        self.times.append(times)
        self.chars += len(text or "")

    def row(self) -> tuple:
        from zstandard import ZstdCompressor

        pairs, places, holders = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        own = np.concatenate((np.array([len(p) for p in self.pairs]), places)).astype("<u4").tobytes()
        linked = ZstdCompressor(level=3).compress(own + np.concatenate(self.times).astype("<u8").tobytes())
        return (self.key, *map(list, zip(*self.docs, strict=True)), pairs, holders, linked)


def unlink(linked: bytes, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of a block's linked pairs, their places among its distinct pairs and their links."""
    from zstandard import ZstdDecompressor

    data = ZstdDecompressor().decompress(linked)
    sizes = np.frombuffer(data, "<u4", docs)
    links = int(sizes.sum())
    return np.repeat(np.arange(docs), sizes), np.frombuffer(data, "<u4", links, 4 * docs), np.frombuffer(data, "<u8", links, 4 * (docs + links)).astype(np.int64)


def align_documents(docs: DataFrame, bytes_path: str, pieces_path: str, block: int = BLOCK) -> DataFrame:
    """Align every whole text of (doc_id, text) as a byte-level vocabulary (A) and sentence pieces (B) cut it.

    1. Texts are encoded by both, a space before them, and cut into groups where tokens of both end at
       the same byte (``irregular_groups``). What is linked is kept by blocks of ``block`` characters:
       documents refer to the block's distinct id pairs, which are counted there.
    2. Counts of a pair are summed over blocks, so a pair that every document has costs a row per block;
       the highest count of each A id is a merged aggregate.
    3. Counts go back to the blocks that hold the pair, and every document sums its own.

    Gives doc_id, n_a, n_b, n_groups, n_links (pairs of occurrences that share a group), groups (SHA-256 of
    the ids by group), n_best (links whose documents are the most of their A id, ties included) and
    count_sum (documents of its pair, over links). Texts that are null or empty, or that one side does
    not spell byte by byte, have no tokens: zeros and ''. Rows that repeat count each; null doc_ids are
    kept; other columns are not read; an empty table gives no rows. A text is encoded in one task;
    groups of any size are counted by distinct ids.
    """
    spark = docs.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        aligner = Aligner(ByteSide(bytes_path), PieceSide(pieces_path))
        part = TaskContext.get().partitionId()
        own = Block(part << 40)
        for rows in slices(batches):
            texts = rows.column("text").to_pylist()
            for doc_id, text, found in zip(rows.column("doc_id").to_pylist(), texts, aligner.align_all(texts), strict=True):
                own.add(doc_id, text, found)
                if own.chars >= block:
                    yield [own.row()]
                    own = Block(own.key + 1)
        if own.docs:
            yield [own.row()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = {c: batch.column(c)[k].values for c, _ in DOCS}
                who, places, times = unlink(batch.column("linked")[k].as_py(), len(own["doc_id"]))
                told = batch.column("told")[k].values
                counts = np.zeros(0 if told is None else len(told), np.int64)
                if len(counts):
                    counts[told.field("at").to_numpy()] = told.field("count").to_numpy()
                sums = np.zeros((2, len(own["doc_id"])), np.int64)
                for out, value in zip(sums, (counts[places] & 1, counts[places] >> 1), strict=True):
                    np.add.at(out, who, times * value)
                yield pa.RecordBatch.from_arrays([*(own[c].cast(t) for c, t in DOCS), *map(pa.array, sums)], schema=ALIGNED)

    rows = map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, BLOCKS)
    blocks = staged(rows, "aligned")
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "held")).select("block", "at", F.col("held.pairs").alias("pair"), F.col("held.holders").alias("holders"))
    counted = staged(held.groupBy("pair").agg(F.sum("holders").alias("count")).withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    most = counted.groupBy("a").agg(F.max("count").alias("most"))
    judged = counted.join(most, "a").select("pair", (F.col("count") * 2 + (F.col("count") == F.col("most")).cast("long")).alias("count"))
    told = held.select("block", "at", "pair").join(judged, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "count")).alias("told"))
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return blocks.select("block", *(c for c, _ in DOCS), "linked").join(told, "block", "left").mapInArrow(score, from_arrow_schema(ALIGNED))
