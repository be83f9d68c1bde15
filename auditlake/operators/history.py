"""Secrets in commit history.

Added lines are tested where they are read. Only header lines and lines with a hit are shuffled to
work out which commit and file each hit belongs to.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake.catalog.rules import ENTROPY_RULE, RULES
from auditlake.functions import text as tx
from auditlake.functions.dialect import to_jvm
from auditlake.functions.literals import Finder
from auditlake.operators.detect import rule_test
from auditlake.operators.durable import durable
from auditlake.operators.entropy import is_random_sql
from auditlake.operators.joins import join_bounded
from auditlake.schema import HISTORY_COLUMNS
from auditlake.sources.commit_log import (
    BLOCK_LINES,
    CONTEXT,
    added_lines,
    forward_fill,
    header_values,
    is_added,
    is_header,
    limit_commits,
)

HISTORY_RULES = tuple(r for r in RULES if r.in_history)
LINES_A_ROW = 10_000


def line_hits(lines: DataFrame) -> DataFrame:
    """Hits in rows with a ``content`` line: the row's columns, then hit_ord, rule_id, description.

    A line gives every secret rule that matches, in catalog order, then every random value.
    """
    lowered = lines.withColumn("lowered", tx.gate_text(F.col("content")))
    rules = ", ".join(
        f"CASE WHEN {rule_test(r)} THEN named_struct('hit_ord', {i}, 'rule', {i}, 'value', string(null)) END" for i, r in enumerate(HISTORY_RULES)
    )
    pattern = tx.sql_literal(to_jvm(ENTROPY_RULE.pattern))
    # one generator gives the rows with a hit, so each line is tested once
    found = lowered.select(*lines.columns, F.expr(f"""
        inline(array_compact(concat(array({rules}),
          CASE WHEN {rule_test(ENTROPY_RULE)}
               THEN transform(filter(regexp_extract_all(content, {pattern}, 1), v -> {is_random_sql('v')}),
                              (v, i) -> named_struct('hit_ord', {len(HISTORY_RULES)} + i, 'rule', int(null), 'value', v))
               ELSE array() END)))"""))
    ids = F.array(*[F.lit(r.rule_id) for r in HISTORY_RULES])
    descriptions = F.array(*[F.lit(r.description) for r in HISTORY_RULES])
    bits = F.format_string("High-entropy secret in history (entropy=%.2f)", tx.shannon_entropy("value"))
    return found.select(
        *lines.columns, "hit_ord", "value",
        F.coalesce(F.get(ids, F.col("rule")), F.lit(ENTROPY_RULE.rule_id)).alias("rule_id"),
        F.coalesce(F.get(descriptions, F.col("rule")), bits).alias("description"),
    )


def history_findings(log: DataFrame, newest: int | None = None, block: int = BLOCK_LINES) -> DataFrame:
    """First occurrence, in log order, of every secret in a log table (repo, seq, line)."""
    if newest is not None:
        log = limit_commits(log, newest, block)
    line = F.col("line")
    hits = line_hits(added_lines(log)).select(
        "repo", "seq", "hit_ord", "rule_id", "description", "value", tx.strip(F.col("content")).alias("line_text"),
        *[F.lit(None).cast("string").alias(c) for c in CONTEXT],
    )
    headers = log.filter(is_header(line)).select("repo", "seq", *header_values(line))
    # every block of the log, found from the plain lines so that the rules run once
    spans = log.filter(is_header(line) | is_added(line)).select("repo", "seq", *header_values(line))
    filled = forward_fill(
        hits.unionByName(headers, allowMissingColumns=True), "repo", "seq", CONTEXT, block, carry_from=spans
    ).filter(F.col("rule_id").isNotNull())
    rows = filled.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in CONTEXT else F.col(c) for c in filled.columns])
    # the whole line is the identity of a hit, for random values with the value; only what is shown is cut
    code = F.concat_ws("\n", "line_text", "value")
    identified = rows.withColumns({
        "fingerprint": tx.fingerprint(F.col("rule_id"), F.col("file_path"), code, slash_paths=False),
        "line_snippet": F.left("line_text", F.lit(tx.HISTORY_SNIPPET_CHARS)),
    }).drop("value")
    return dedupe_history(identified).select(*HISTORY_COLUMNS)


def dedupe_history(hits: DataFrame) -> DataFrame:
    """First hit per repository and fingerprint. Copies merge before the shuffle."""
    rest = [c for c in hits.columns if c not in ("repo", "fingerprint")]
    first = F.min_by(F.struct(*rest), F.struct("seq", "hit_ord")).alias("first")
    return hits.groupBy("repo", "fingerprint").agg(first).select("repo", "fingerprint", "first.*")


def mark_still_present(findings: DataFrame, head: DataFrame) -> DataFrame:
    """Adds ``still_present``: the line still occurs in the current version of its file.

    ``head`` is (repo, path, content). Findings are few next to head files, so they are written to
    the checkpoint folder once. A head file meets the lines of its findings as one row of parts of
    ``LINES_A_ROW`` lines at most, so its content is joined a few times and not once per finding, and
    is read once for all lines of a part by an automaton over them. Only lines that are present come
    out and are joined to the findings.
    """
    findings = durable(findings)
    lines = findings.select("repo", F.col("file_path").alias("path"), "line_text").distinct()
    part = F.floor(F.row_number().over(W.partitionBy("repo", "path").orderBy("line_text")) / LINES_A_ROW)
    wanted = lines.withColumn("part", part).groupBy("repo", "path", "part").agg(F.collect_list("line_text").alias("lines"))
    joined = join_bounded(head.select("repo", "path", "content"), wanted.drop("part"), ["repo", "path"], "inner")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c) for c in ("repo", "path", "content", "lines")), strict=True)
            for repo, path, content, own in rows:
                if content.is_valid:
                    words = own.as_py()
                    there = [words[k] for k in sorted(Finder(words).found(content.as_py()))]
                    yield pa.RecordBatch.from_arrays([pa.array([v.as_py()] * len(there), pa.string()) for v in (repo, path)] + [pa.array(there, pa.string())], ["repo", "file_path", "line_text"])

    present = joined.mapInArrow(work, "repo string, file_path string, line_text string")
    found = present.distinct().withColumn("still_present", F.lit(True))
    return findings.join(found, ["repo", "file_path", "line_text"], "left").select(
        *findings.columns, F.coalesce("still_present", F.lit(False)).alias("still_present")
    )


def classify_changes(findings: DataFrame) -> DataFrame:
    """Adds ``status``: secrets still in the current files must be fixed, removed ones rotated."""
    status = F.when(F.col("still_present"), "still present").otherwise("removed")
    return findings.withColumn("status", status)


def history_counts(findings: DataFrame) -> DataFrame:
    """(repo, total, still_present, removed)."""
    return findings.groupBy("repo").agg(
        F.count("*").alias("total"),
        F.count_if("still_present").alias("still_present"),
        F.count_if(~F.col("still_present")).alias("removed"),
    )
