"""Commit logs as a table of lines (repo, seq, line), newest commit first.

A log is the text of ``git log -p --date=short`` with the format
``COMMIT:%H%nAUTHOR:%an%nDATE:%ad%nMSG:%s%nEND_META``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.functions import text as tx
from auditlake.functions.dialect import LINE_ENDS, to_jvm
from auditlake.operators.durable import durable
from auditlake.operators.joins import join_bounded

# The line formats of a log.
FIELDS = {"commit_hash": "COMMIT:", "commit_author": "AUTHOR:", "commit_date": "DATE:", "commit_message": "MSG:"}
FILE_HEADER = r"^diff --git a/(.+) b/(.+)$"

CONTEXT = [*FIELDS, "file_path"]
BLOCK_LINES = 1 << 20


def log_lines(logs: DataFrame) -> DataFrame:
    """(repo, seq, line) of whole logs (repo, content), for logs that fit a row."""
    return logs.select("repo", F.posexplode(F.split("content", LINE_ENDS, -1)).alias("seq", "line")).withColumn(
        "seq", F.col("seq").cast("long")
    )


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(repo, seq, line) of log files, one per repository and named for it (``repo.log``).

    Files are cut into splits like any text, so a log of any size is read by many tasks. ``seq`` is
    the place of the line's split in the file plus the number of the line in the split: a split
    holds no more lines than bytes, so the numbers rise through the file, with gaps.
    """
    lines = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"(?s)^(.*?)(?:\.[^.]*)?$", 1).alias("repo"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"), F.col("value").alias("line"),
    )
    # the first number of each split: a row per split
    first = durable(lines.groupBy("file", "start").agg(F.min("number").alias("first")))
    return lines.join(F.broadcast(first), ["file", "start"]).select(
        "repo", (F.col("start") + F.col("number") - F.col("first")).alias("seq"), "line"
    )


def header_values(line: Column) -> list[Column]:
    """For each context column the value a line sets, or null if the line does not set it."""
    out = [
        F.when(F.startswith(line, F.lit(prefix)), tx.strip(F.substring(line, F.lit(len(prefix) + 1), F.char_length(line)))).alias(name)
        for name, prefix in FIELDS.items()
    ]
    pattern = to_jvm(FILE_HEADER, flags="(?d)")
    return out + [F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 2)).alias("file_path")]


def is_header(line: Column) -> Column:
    """Whether a line sets a context column. Added lines start with a plus, so no line is both."""
    out = F.startswith(line, F.lit("diff --git "))
    for prefix in FIELDS.values():
        out = out | F.startswith(line, F.lit(prefix))
    return out


def is_added(line: Column) -> Column:
    return F.startswith(line, F.lit("+")) & ~F.startswith(line, F.lit("+++"))


def added_lines(log: DataFrame) -> DataFrame:
    """(repo, seq, content) of added lines, without the plus."""
    line = F.col("line")
    return log.filter(is_added(line)).select(
        "repo", "seq", F.substring(line, F.lit(2), F.char_length(line)).alias("content")
    )


def forward_fill(
    rows: DataFrame, key: str, order: str, columns: list[str], block: int = BLOCK_LINES,
    carry_from: DataFrame | None = None,
) -> DataFrame:
    """Each column's last non-null value at or before the row, within ``key`` in the order of ``order``.

    One repository may hold a large share of all lines, so no window runs over a whole key. The key
    is cut into blocks of ``order``: a window fills each block by itself, one aggregated row per
    block carries its last values, and a window over those few rows gives what each block starts
    with. ``carry_from`` may give a cheaper form of the rows (key, order and columns) to take the
    carried values from; it must set the same values and reach every block of ``rows``.
    """

    def blocked(df: DataFrame) -> DataFrame:
        return df.withColumn("block", F.floor(F.col(order) / block).cast("long"))

    cut = blocked(rows)
    ends = blocked(rows if carry_from is None else carry_from)
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    before = W.partitionBy(key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.groupBy(key, "block").agg(*last).select(
        key, "block", *[F.last(c, ignorenulls=True).over(before).alias(f"carried_{c}") for c in columns]
    )
    inside = W.partitionBy(key, "block").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = cut.select(
        *[c for c in cut.columns if c not in columns],
        *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in columns],
    )
    return filled.join(carried, [key, "block"], "left").select(
        *[F.coalesce(F.col(c), F.col(f"carried_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns]
    )


def limit_commits(log: DataFrame, newest: int, block: int = BLOCK_LINES) -> DataFrame:
    """Lines of each repository's newest commits, by the position of their first line.

    Commits are counted per block of the log; the running count over blocks, a row each, tells in
    which block a repository's last wanted commit ends, and only that block is ranked. The cut, a
    row per repository, is measured and sent to the lines, which stay where they are.
    """
    heads = log.filter(F.startswith(F.col("line"), F.lit(FIELDS["commit_hash"]))).select(
        "repo", "seq", F.floor(F.col("seq") / block).cast("long").alias("block")
    )
    earlier = W.partitionBy("repo").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    counted = heads.groupBy("repo", "block").agg(F.count("*").alias("n"))
    ending = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).filter(
        (F.col("before") <= newest) & (F.col("before") + F.col("n") > newest)
    )
    rank = F.row_number().over(W.partitionBy("repo", "block").orderBy("seq"))
    cut = (
        heads.join(ending, ["repo", "block"]).withColumn("nth", rank)
        .filter(F.col("nth") + F.col("before") == newest + 1)
        .select("repo", F.col("seq").alias("end"))
    )
    return join_bounded(log, cut, ["repo"], "left").filter(F.col("end").isNull() | (F.col("seq") < F.col("end"))).select(*log.columns)


def parse_commit_log(log: DataFrame, block: int = BLOCK_LINES) -> DataFrame:
    """(repo, seq, commit columns, file_path, content) of every added line."""
    line = F.col("line")
    kept = log.filter(is_header(line) | is_added(line)).select("repo", "seq", "line", *header_values(line))
    filled = forward_fill(kept, "repo", "seq", CONTEXT, block)
    return filled.filter(is_added(line)).select(
        "repo", "seq", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in CONTEXT],
        F.substring(line, F.lit(2), F.char_length(line)).alias("content"),
    )
