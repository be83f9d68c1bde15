"""Parallelism of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """Hash a table of few files over the session's cores.

    A row group is read by one task, so a table in fewer files than there are cores leaves cores idle
    while patterns are matched. Such a table is small and moving it is cheap; one with more files is
    returned as it is and never shuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    # the array is only counted; DataFrame.inputFiles() would bring every name over
    if len(table._jdf.inputFiles()) >= cores:
        return table
    return table.repartition(2 * cores, *keys)
