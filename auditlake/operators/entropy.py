"""Columns for high-entropy values assigned to names that sound secret."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.catalog.rules import ENTROPY_BITS, ENTROPY_RULE
from auditlake.functions import text as tx


def is_random_sql(value: str) -> str:
    """Entropy at or above the threshold; rounded so that exact sums are not lost to the last digit."""
    return f"round({tx.entropy_sql(value)}, 12) >= {ENTROPY_BITS}D"


def qualified(marker: str) -> Column:
    """Unsuppressed random values of an entropy hit, as (raw, pos, line, value) sorted by line text and position.

    Reads the columns content, pattern, matches and rule_id; null for hits of other rules. The n-th
    captured value belongs to the n-th match, whose line ``matches`` tells.
    """
    return F.expr(f"""
        CASE WHEN rule_ord = {ENTROPY_RULE.rule_ord} THEN array_sort(transform(
          filter(
            transform(
              zip_with(
                flatten(transform(matches, x -> array_repeat(named_struct('line', x.line, 'raw', x.raw), int(x.n)))),
                regexp_extract_all(content, pattern, 1),
                (at, value) -> named_struct('line', at.line, 'raw', at.raw, 'value', value)),
              (x, i) -> named_struct('pos', i, 'line', x.line, 'raw', x.raw, 'value', x.value)),
            x -> {is_random_sql('x.value')} AND NOT {tx.suppressed_sql('x.raw', 'rule_id', marker)}),
          x -> named_struct('raw', {tx.strip_sql('x.raw')}, 'pos', x.pos, 'line', x.line, 'value', x.value)))
        END""")


def first_per_line() -> Column:
    """First value of each distinct line text in ``values``, as (line, raw, n, value)."""
    return F.expr("""
        transform(
          filter(values, (x, i) -> i = 0 OR get(values, greatest(i - 1, 0)).raw <> x.raw),
          x -> named_struct('line', x.line, 'raw', x.raw, 'n', bigint(1), 'value', x.value))""")
