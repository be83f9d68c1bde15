"""Cost-balanced packing of token streams into sequences of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.shared import map_rows, slices
from auditlake.llm.tokens import ByteEncoder

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]
    + [("sequence_id", pa.int64()), ("offset", pa.int64()), ("cost", pa.float64())]
)
#: Tokens that are packed together: so many fill 512 sequences of 2048.
BLOCK = 1 << 20


def place(lengths: np.ndarray, capacity: int, count: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Fill ``count`` sequences from pieces of at most ``capacity`` tokens.

    Pieces go, longest first, to the sequence of lowest cost that has room for the whole piece; the
    cost of a piece of n tokens is ``linear * n + quadratic * n * n``. What fits nowhere is cut over
    the gaps, lowest cost first. Ties: first piece, first sequence. Gives (piece, from, to, sequence)
    in the order of placing, and what is left as (piece, from, to).
    """
    room, cost = np.full(count, capacity), np.zeros(count)
    placed, waiting = [], []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        at = int(np.where(room >= n, cost, np.inf).argmin()) if count else 0
        if not count or room[at] < n:
            waiting.append((k, 0, n))
            continue
        placed.append((k, 0, n, at))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n
    gaps = [int(s) for s in np.argsort(cost, kind="stable") if room[s] > 0]
    left = []
    for k, begin, end in waiting:
        while begin < end and gaps:
            n = min(end - begin, int(room[gaps[0]]))
            placed.append((k, begin, begin + n, gaps[0]))
            room[gaps[0]] -= n
            begin += n
            if not room[gaps[0]]:
                gaps.pop(0)
        if begin < end:
            left.append((k, begin, end))
    return placed, left


class Packer:
    """Packs the documents of one task block by block; what a block leaves over begins the next."""

    def __init__(self, first: int, capacity: int, block: int, linear: float, quadratic: float):
        self.next, self.capacity, self.block = first, capacity, block
        self.linear, self.quadratic = linear, quadratic
        self.pool: list[tuple] = []  # (doc_id, ids, doc_tokens, from, to), ids as 4 bytes each
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        n = len(ids) // 4
        self.pool += [(doc_id, ids, n, at, min(at + self.capacity, n)) for at in range(0, n, self.capacity)]
        self.tokens += n
        if self.tokens >= self.block:
            yield from self.flush()

    def flush(self, last: bool = False) -> Iterator[tuple]:
        pool = self.pool
        lengths = np.array([p[4] - p[3] for p in pool], dtype=np.int64)
        placed, left = place(lengths, self.capacity, self.tokens // self.capacity, self.linear, self.quadratic)
        yield from self.rows(pool, placed)
        self.next += self.tokens // self.capacity
        self.pool = [(*pool[k][:3], pool[k][3] + a, pool[k][3] + b) for k, a, b in left]
        self.tokens = sum(p[4] - p[3] for p in self.pool)
        if last:
            yield from self.tail()

    def tail(self) -> Iterator[tuple]:
        """The rest of a task is shorter than a sequence: it is cut into lengths that are powers of two, which need no padding."""
        pool = self.pool
        queue = [(k, 0, p[4] - p[3]) for k, p in enumerate(pool)]
        while self.tokens:
            room = 1 << (self.tokens.bit_length() - 1)
            self.tokens -= room
            placed = []
            while room:
                k, begin, end = queue.pop(0)
                n = min(room, end - begin)
                placed.append((k, begin, begin + n, 0))
                room -= n
                if begin + n < end:
                    queue.insert(0, (k, begin + n, end))
            yield from self.rows(pool, placed)
            self.next += 1
        self.pool = []

    def rows(self, pool: list[tuple], placed: list[tuple[int, int, int, int]]) -> Iterator[tuple]:
        filled: dict[int, int] = {}
        for k, begin, end, sequence in placed:
            doc_id, ids, total, base, _ = pool[k]
            offset = filled.get(sequence, 0)
            filled[sequence] = offset + end - begin
            n = end - begin
            yield doc_id, base + begin, n, ids[4 * (base + begin) : 4 * (base + end)], total, self.next + sequence, offset, self.linear * n + self.quadratic * n * n


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, block: int = BLOCK, linear: float = 1.0, quadratic: float = 1 / 2048
) -> DataFrame:
    """Pack (doc_id, text) into sequences of at most ``capacity`` tokens, balanced by attention cost.

    A document is its token ids and ``end_id``. Each task packs the documents of its partition in
    blocks of ``block`` tokens, so nothing is shuffled, a hot source changes nothing, and a task that
    is run again gives the same rows. A block fills as many whole sequences as it has tokens for;
    the rest goes on to the next block, and the last rest is cut into sequences whose lengths are
    powers of two, so that no sequence needs padding.

    Gives a row per piece: doc_id, start, length, ids (4 bytes each, little-endian), doc_tokens,
    sequence_id (unique, not gapless), offset and cost. Null and empty texts are the end id alone.
    Rows that repeat are packed each on its own; a null doc_id is kept; other columns are not read.
    An empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        encoder, end = ByteEncoder(tokenizer), int(end_id).to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, block, linear, quadratic)
        for part in slices(batches):
            keys, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            yield [r for k, ids in zip(keys, encoder.encode([t or "" for t in texts]), strict=True) for r in packer.add(k, ids + end)]
        yield list(packer.flush(last=True))

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, SCHEMA)
