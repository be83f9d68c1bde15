"""What filters remove in every order they could be applied in, counted with wide packed integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from auditlake.llm.shared import map_rows, slices, staged

#: Failure conditions: few words, few distinct words, capitals, symbols, the text of a smaller doc_id.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))

MASKS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in OUTCOMES)])


class Orders:
    """All orders of some filters; every mask of failed filters as an integer whose fields hold its outcomes at every step.

    A field is 64 bits wide. Counts of rows are longs, below 2**63, so a sum of such integers over any
    number of rows never carries from one field into the next. Kinds of outcomes follow each other:
    removed at the step, failed but removed before, failed as the only filter.
    """

    KINDS = 3

    def __init__(self, filters: str):
        self.filters = filters
        self.orders = list(permutations(range(len(filters))))
        self.names = ["".join(filters[f] for f in o) for o in self.orders]
        self.at = np.array(self.orders).ravel()  # the filter of every field of a kind

    @property
    def steps(self) -> int:
        return len(self.at)

    @cached_property
    def packed(self) -> list[int]:
        return [self.pack(mask) for mask in range(1 << len(self.filters))]

    def pack(self, mask: int) -> int:
        fields = np.zeros((self.KINDS, len(self.orders), len(self.filters)), np.uint64)
        for k, order in enumerate(self.orders):
            gone = False
            for step, f in enumerate(order):
                if mask >> f & 1:
                    fields[0, k, step] = not gone
                    fields[1, k, step] = gone
                    fields[2, k, step] = mask == 1 << f
                    gone = True
        return int.from_bytes(fields.astype("<u8").tobytes(), "little")

    def unpack(self, total: int) -> np.ndarray:
        """The fields of a sum: a row for each kind."""
        return np.frombuffer(total.to_bytes(8 * self.KINDS * self.steps, "little"), "<u8").astype(np.int64).reshape(self.KINDS, -1)

    def outcomes(self, counts: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
        """Columns of OUTCOMES for a part, from its (mask, good, toxic, rows)."""
        sums = [sum(n * self.packed[mask] for mask, *marks, n in counts if wanted(marks)) for wanted in (lambda _: True, lambda m: m[0], lambda m: m[1])]
        (removed, redundant, unique), (good, *_), (toxic, *_) = map(self.unpack, sums)
        kept = sum(n for *_, n in counts) - removed.reshape(len(self.orders), -1).cumsum(axis=1).ravel()
        by_filter = np.array([removed[self.at == f].sum() for f in range(len(self.filters))])
        return [kept, removed, redundant, unique, good, toxic, by_filter[self.at]]


def mask_of(text: bytes) -> int:
    """Bits of the failed filters A to D of a whole text in UTF-8; E needs the other texts."""
    words = text.split()  # of bytes: at space and \x09 to \x0d only
    few = len(words) < LEAST_WORDS
    dull = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * (len(text) - len(text.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text.decode("utf-8", "replace"))
    odd = len(text.translate(None, SYMBOLS)) < len(text)
    return few | dull << 1 | loud << 2 | odd << 3


def filter_masks(docs: DataFrame) -> DataFrame:
    """Every row of (doc_id, text, source) as doc_id, part and the mask of the filters it fails.

    One pass over the texts gives a mask and a SHA-256 per row, written once; the smallest doc_id of a
    digest is a merged aggregate, and rows look themselves up by their own doc_id and digest, so a text
    that a third of all rows have is no hot key. Null text is empty, null source the empty part. A row
    fails E if a row with a smaller doc_id has its text; null doc_ids have no order and never fail it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for part in slices(batches, 1024):
            rows = zip(*(part.column(c).to_pylist() for c in ("doc_id", "part", "text")), strict=True)
            yield [(k, p, mask_of(t), hashlib.sha256(t).digest()) for k, p, t in rows]

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = staged(map_rows(own, work, MASKS), "filter-masks")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    told = rows.where("doc_id is not null").join(first, ["doc_id", "digest"], "left").withColumn("mask", F.col("mask").bitwiseOR(later))
    return told.select("doc_id", "part", "mask").unionByName(rows.where("doc_id is null").select("doc_id", "part", "mask"))


def audit_orders(masks: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts of every part, order of ``filters`` and step, from rows (doc_id, part, mask).

    Rows with the same part, mask and labels are counted first, so at most four rows for each mask and
    part are left; the masks' packed integers (``Orders``) are summed by part with those counts and
    unpacked into a row per order and step. A document is good or toxic if any row of ``labels``
    (doc_id, quality, toxic) with its id says 1; others, and null ids, are neither.
    An empty table gives no rows.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    none = F.lit(False)
    named = masks.where("doc_id is not null").join(marks, "doc_id", "left")
    marked = named.select("part", "mask", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    marked = marked.unionByName(masks.where("doc_id is null").select("part", "mask", none.alias("good"), none.alias("toxic")))
    counted = marked.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("counts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Orders(filters)
        steps = pa.array(np.tile(np.arange(1, len(filters) + 1), len(table.orders)), pa.int32())
        names = pa.array(np.repeat(table.names, len(filters)), pa.string())
        for batch in batches:
            for name, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                found = table.outcomes([(c["mask"], c["good"], c["toxic"], c["n"]) for c in counts])
                yield pa.RecordBatch.from_arrays([pa.array([name] * table.steps, pa.string()), names, steps, *map(pa.array, found)], schema=AUDIT)

    return parts.mapInArrow(work, from_arrow_schema(AUDIT))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction of the five filters on whole documents: ``filter_masks``, then ``audit_orders``."""
    return audit_orders(filter_masks(docs), labels)
