"""Helpers that several operators use: staged tables, work in Arrow batches, connected components."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from auditlake.operators.durable import checkpoint_folder, durable, shared_folder, shuffles_removed, staged  # noqa: F401

#: A table may be sent to every executor up to this many rows of a few numbers.
BROADCAST_ROWS = 500_000
#: Texts in an Arrow batch.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold TEXT_ROWS rows at most: a batch of whole texts is held several times over, by the JVM and by its Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)


def map_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[list[tuple]]], schema: pa.Schema) -> DataFrame:
    """``mapInArrow`` for a function that reads batches and gives lists of rows, over one partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in work(batches):
            if rows:
                columns = zip(zip(*rows, strict=True), schema.types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=schema)
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, from_arrow_schema(schema))


def give_back() -> None:
    """Return memory that a task no longer needs to the system: its worker lives on, next to others, and waits for a task."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short runs of rows, so that what a task turns into Python objects stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_or_salted(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join to a written (``staged`` or ``durable``) table whose keys are unique.

    Its rows are counted: up to ``rows`` it is sent to all executors, beyond that both sides are
    shuffled and adaptive execution splits what is skewed.
    """
    with shuffles_removed(small.sparkSession):
        few = small.limit(rows + 1).count() <= rows
    if few:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components: ``edges`` (a, b) of long ids to (node, component), the smallest id reachable.

    Alternating large-star and small-star rounds: every round is joins and merged aggregates, and the
    number of rounds grows with the logarithm of the component size. Ids without an edge get no row;
    null ids and loops are ignored. Each round is written to the checkpoint folder.
    """
    pairs = durable(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        .distinct()
    )
    before = None
    while True:
        with shuffles_removed(edges.sparkSession):
            state = pairs.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = pairs.select(F.col("x").alias("u"), F.col("y").alias("v")).union(pairs.select("y", "x"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        lowest = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lowest, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        pairs = durable(small.union(lowest.select("x", F.col("m").alias("y"))).distinct())
    roots = pairs.select(F.col("y").alias("node")).distinct()
    return pairs.select(F.col("x").alias("node"), F.col("y").alias("component")).union(roots.select("node", F.col("node").alias("component")))

