"""The life of findings over a stream of file versions: new, open, fixed, reopened."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditlake.config import ScanConfig
from auditlake.operators.detect import detect
from auditlake.operators.select import select_files

LIFE = "project string, file_path string, ts timestamp, fingerprint string, rule_id string, life string"
#: The time of a file's newest version, and all findings it has had: open ones and fixed ones.
STATE = "newest bigint, fingerprints array<string>, rules array<string>, open array<boolean>"
COLUMNS = ["project", "file_path", "ts", "fingerprint", "rule_id", "life"]
MILLIS = {"day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1_000}


def millis(interval: str) -> int:
    """``3 days`` and the like."""
    number, unit = interval.split()
    return int(number) * MILLIS[unit.rstrip("s")]


def next_lives(known: dict[str, tuple[str, bool]], found: dict[str, str]) -> list[tuple[str, str, str]]:
    """What a version with the findings ``found`` (fingerprint: rule) makes of the findings known so far, which are brought up to date."""
    out = []
    for fingerprint, rule in found.items():
        before = known.get(fingerprint)
        out.append((fingerprint, rule, "new" if before is None else "open" if before[1] else "reopened"))
    out += [(f, rule, "fixed") for f, (rule, open_) in known.items() if open_ and f not in found]
    known.update({f: (rule, life != "fixed") for f, rule, life in out})
    return out


def finding_life(
    files: DataFrame, config: ScanConfig | None = None, time_column: str = "ts", delay: str = "1 hour", forget: str = "365 days"
) -> DataFrame:
    """(project, file_path, ts, fingerprint, rule_id, life) for a stream of file versions (project, path, content, time).

    Each version of a file says of each of its findings whether it is ``new``, still ``open`` or
    ``reopened``, and which open ones it lacks: those are ``fixed``. A version without findings, or
    with null content (the file is gone), fixes all. Rows with the same file and time are one version.

    State is kept by file. Versions are taken in the order of their times; one that comes after a newer
    one of its file, or later than ``delay``, is left out. A file with no version for ``forget`` is
    forgotten by a timer, and what it has later is new. Works on a bounded table as well as on a stream.
    """
    config = config or ScanConfig()
    timed = files.withColumn("ts", F.col(time_column).cast("timestamp")).withWatermark("ts", delay)
    chosen = select_files(timed.select("project", "path", "content", "ts"), config.exclude_paths)
    none = F.lit(None).cast("string")
    versions = chosen.select("project", F.col("path").alias("file_path"), "ts", none.alias("fingerprint"), none.alias("rule_id"))
    found = detect(chosen, config, keep=("ts",)).select("project", "file_path", "ts", "fingerprint", "rule_id")
    keep = millis(forget)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, known = -(1 << 62), {}
        if state.exists:
            newest, *columns = state.get
            known = {f: (r, o) for f, r, o in zip(*columns, strict=True)}
        by_time: dict[int, dict[str, str]] = {}
        for part in parts:
            times = part["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            for at, fingerprint, rule in zip(times.tolist(), part["fingerprint"], part["rule_id"], strict=True):
                own = by_time.setdefault(at, {})
                if isinstance(fingerprint, str):
                    own[fingerprint] = rule
        rows = []
        for at in sorted(t for t in by_time if t > newest):
            newest, time = at, pd.Timestamp(at, unit="us")
            rows += [(*key, time, *life) for life in next_lives(known, by_time[at])]
        state.update((newest, list(known), [r for r, _ in known.values()], [bool(o) for _, o in known.values()]))
        state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + keep)
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS)

    by_file = versions.unionByName(found).groupBy("project", "file_path")
    return by_file.applyInPandasWithState(step, LIFE, STATE, "append", GroupStateTimeout.EventTimeTimeout)
