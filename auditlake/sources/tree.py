"""Source trees as a corpus table.

Spark's file sources skip names that start with a dot or an underscore, which are the very files a
secret scan is about. ``SourceTree`` lists directories itself. The tree must be on storage that
every executor mounts; for corpora at rest use a table of (project, path, content).
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import partial
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringStartsWith

from auditlake.functions import text as tx

LEAST_PARTITIONS = 64
MOST_PARTITIONS = 4096
BATCH_BYTES = 16 << 20
#: Entries of a directory that the driver reads; tasks share what a wider one holds.
WIDE = 10_000
LISTED = "project string, path string, name string, ext string, file string, modified timestamp"


class TreePart(InputPartition):
    """Directories listed by one task: (folder, whether everything below it is included, share, shares).

    Of a directory in several shares, a task takes the entries whose names hash to its own.
    """

    def __init__(self, folders: list[tuple[str, bool, int, int]]):
        super().__init__(folders)
        self.folders = folders


class FileList(InputPartition):
    """Files that a listing found, as (file, time of change in nanoseconds)."""

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)
        self.files = files


def extension(name: str) -> str:
    """As ``file_ext`` has it: from the last dot on, lower case; none for names that only start with one."""
    at = name.rfind(".")
    return name[at:].lower() if at > 0 and at + 1 < len(name) else ""


class Tree:
    """What the batch and the stream reader share: which files of a tree there are, and the row of each."""

    def __init__(self, options):
        self.root = options["path"].removeprefix("file://").rstrip("/")
        self.by_project = options.get("layout", "projects") == "projects"
        self.skip = {d for d in options.get("skip", "").split(",") if d}
        self.projects: set[str] | None = None
        self.extensions: set[str] | None = None
        self.prefixes: list[str] = []

    def names(self, file: str) -> tuple[str, str] | None:
        """Project and path of a file or directory; none for files beside the projects."""
        below = f"{self.root}/"
        # a listing asks twice for every file; ``relpath`` would ask for the working directory each time
        inner = os.path.normpath(file[len(below) :]) if file.startswith(below) else os.path.relpath(file, self.root)
        if not self.by_project:
            return os.path.basename(self.root), "" if inner == "." else inner
        project, _, path = inner.partition("/")
        return project, path

    def enters(self, folder: str) -> bool:
        """Whether files that are asked for can be below a directory."""
        if os.path.basename(folder) in self.skip:
            return False
        project, path = self.names(folder)
        if self.projects is not None and project not in self.projects:
            return False
        return all(path.startswith(p) or p.startswith(f"{path}/" if path else "") for p in self.prefixes)

    def takes(self, file: str) -> bool:
        project, path = self.names(file)
        return (
            path != ""
            and (self.projects is None or project in self.projects)
            and all(path.startswith(p) for p in self.prefixes)
            and (self.extensions is None or extension(os.path.basename(file)) in self.extensions)
        )

    def entries(self, folder: str, share: int = 0, shares: int = 1) -> Iterator[os.DirEntry]:
        with os.scandir(folder) as found:
            for e in found:
                if shares == 1 or zlib.crc32(os.fsencode(e.name)) % shares == share:
                    yield e

    def files(self, folder: str, recursive: bool, share: int = 0, shares: int = 1) -> Iterator[str]:
        for e in sorted(self.entries(folder, share, shares), key=lambda e: e.name):
            if e.is_dir(follow_symlinks=False):
                if recursive and self.enters(e.path):
                    yield from self.files(e.path, True)
            elif self.takes(e.path) and not e.is_dir():  # a link to a directory is no file and not entered
                yield e.path

    def row(self, file: str, changed: int | None = None) -> tuple:
        project, path = self.names(file)
        name = os.path.basename(file)
        changed = os.stat(file).st_mtime_ns if changed is None else changed
        return project, path, name, extension(name), file, datetime.fromtimestamp(changed // 1000 / 1e6, timezone.utc)


class TreeReader(Tree, DataSourceReader):
    def pushFilters(self, filters):
        """Projects, path prefixes and file types are looked at while listing; Spark keeps the other filters."""
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == ("project",) and values is not None:
                self.projects = values if self.projects is None else self.projects & values
            elif column == ("ext",) and values is not None:
                self.extensions = values if self.extensions is None else self.extensions & values
            elif column == ("path",) and isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            else:
                yield f

    def partitions(self):
        """Directories to list in parallel, opened level by level until there are enough.

        Only names of directories are kept here, and of no directory more than WIDE entries are read:
        the tasks share a wider one. Files are found by the tasks.
        """
        flat, deep, wide = [], [self.root], []
        if self.by_project and self.projects is not None:
            deep = sorted(p for p in (os.path.join(self.root, n) for n in self.projects) if os.path.isdir(p) and self.enters(p))
        while deep and len(flat) + len(deep) < LEAST_PARTITIONS:
            below = []
            for folder in deep:
                first = list(islice(self.entries(folder), WIDE + 1))
                if len(first) > WIDE:
                    wide += [(folder, True, k, LEAST_PARTITIONS) for k in range(LEAST_PARTITIONS)]
                else:
                    flat.append((folder, False, 0, 1))
                    below += sorted(e.path for e in first if e.is_dir(follow_symlinks=False) and self.enters(e.path))
            deep = below
        folders = flat + wide + [(f, True, 0, 1) for f in deep]
        return [TreePart(folders[i::MOST_PARTITIONS]) for i in range(min(MOST_PARTITIONS, len(folders)))]

    def read(self, partition):
        for folder, *how in partition.folders:
            for file in self.files(folder, *how):
                yield self.row(file)


class TreeStreamReader(Tree, DataSourceStreamReader):
    """Files that arrive in a tree or change there, each version once.

    An offset is the number of a listing. A listing that finds files with other times of change or
    sizes than before is written to ``marks`` under its number, whole or not at all, before Spark
    hears of it. A range of offsets names the same files whenever it is asked for, so a batch that
    runs again after a failure reads them again, and a new start goes on after the last mark. The
    driver holds a name and two numbers for each file. Files must appear whole, by renaming.
    """

    FILES = 1000

    def __init__(self, options):
        super().__init__(options)
        self.marks = options["marks"].removeprefix("file://").removeprefix("file:")
        self.known: dict[str, list[int]] | None = None
        self.last = 0

    def listing(self, number: int) -> dict[str, list[int]]:
        with open(os.path.join(self.marks, f"{number:09d}.json"), encoding="utf-8") as f:
            return json.load(f)

    def recall(self) -> dict[str, list[int]]:
        if self.known is None:
            os.makedirs(self.marks, exist_ok=True)
            self.last = max((int(n[:9]) for n in os.listdir(self.marks) if n.endswith(".json")), default=0)
            self.known = {}
            for number in range(1, self.last + 1):
                self.known |= self.listing(number)
        return self.known

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        known, new = self.recall(), {}
        for file in self.files(self.root, True):
            try:
                stat = os.stat(file)
            except FileNotFoundError:  # gone since it was listed
                continue
            if known.get(file) != [stat.st_mtime_ns, stat.st_size]:
                new[file] = [stat.st_mtime_ns, stat.st_size]
        if new:
            target = os.path.join(self.marks, f"{self.last + 1:09d}.json")
            with open(f"{target}.tmp", "w", encoding="utf-8") as f:
                f.write(json.dumps(new))
                f.flush()
                os.fsync(f.fileno())
            os.rename(f"{target}.tmp", target)
            self.last += 1
            known |= new
        return {"listing": self.last}

    def partitions(self, start: dict, end: dict):
        found = [(f, t) for n in range(start["listing"] + 1, end["listing"] + 1) for f, (t, _) in sorted(self.listing(n).items())]
        return [FileList(found[k : k + self.FILES]) for k in range(0, len(found), self.FILES)]

    def read(self, partition):
        for file, changed in partition.files:
            yield self.row(file, changed)

    def commit(self, end: dict) -> None:
        """Marks stay: a new start needs them to know what has been seen."""


class SourceTree(DataSource):
    """``format("source_tree")``: (project, path, name, ext, file, modified) of the files under ``path``.

    ``layout=projects`` takes each first-level directory as a project, ``layout=single`` the root.
    ``skip`` is a comma-separated list of directory names never entered. As a stream it needs
    ``marks``, a folder of the driver's for what has been listed.
    """

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return LISTED

    def reader(self, schema):
        return TreeReader(self.options)

    def streamReader(self, schema):
        return TreeStreamReader(self.options)


def _read_files(batches: Iterator[pd.DataFrame], leave_out: type[OSError] | tuple = ()) -> Iterator[pd.DataFrame]:
    """Adds the bytes of each listed file, in batches of bounded size. A file that cannot be read fails the task: an empty one would pass for clean."""
    for listed in batches:
        rows, size, columns = [], 0, [*listed.columns, "raw"]
        for row in listed.itertuples(index=False):
            try:
                with open(row.file, "rb") as f:
                    raw = f.read()
            except leave_out:
                continue
            rows.append((*row, raw))
            size += len(raw)
            if size >= BATCH_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def _reader(spark: SparkSession):
    """``_read_files``; files that are gone are left out only if the session says so, as for Spark's own sources."""
    return partial(_read_files, leave_out=FileNotFoundError if spark.conf.get("spark.sql.files.ignoreMissingFiles") == "true" else ())


def read_tree(
    spark: SparkSession, root: str, layout: str = "projects", skip: tuple[str, ...] = (), partitions: int | None = None, where: Column | str | None = None
) -> DataFrame:
    """Corpus (project, path, content) of a mounted source tree.

    ``where`` says of project, path, name, ext and modified which files are read. Equalities and ``in`` of
    project and ext and prefixes of path are handed to the source, which does not enter other
    directories; all of it is applied before a file is opened. Names of what is left are hashed over
    ``partitions`` tasks that read them, so that one project with most of the files is read by many tasks.
    A file that cannot be read fails the job, and so does one that is gone since it was listed, unless
    ``spark.sql.files.ignoreMissingFiles`` is set.
    """
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    listed = spark.read.format("source_tree").option("layout", layout).option("skip", ",".join(skip)).load(root)
    if where is not None:
        listed = listed.where(where)
    tasks = partitions or 8 * spark.sparkContext.defaultParallelism
    raw = listed.select("project", "path", "file").repartition(tasks, "file").mapInPandas(_reader(spark), "project string, path string, file string, raw binary")
    return raw.select("project", "path", tx.decode_text(F.col("raw")).alias("content"))


def stream_tree(spark: SparkSession, root: str, marks: str, layout: str = "projects", skip: tuple[str, ...] = ()) -> DataFrame:
    """Stream (project, path, content, modified) of the files that arrive in a mounted source tree or change there, each version once.

    ``marks`` is a folder that belongs to the stream like its checkpoint, and outlives it. A file that cannot
    be read fails the batch, which a new start runs again, and so does one that is gone since it was listed,
    unless ``spark.sql.files.ignoreMissingFiles`` is set.
    """
    spark.dataSource.register(SourceTree)
    listed = spark.readStream.format("source_tree").option("layout", layout).option("skip", ",".join(skip)).option("marks", marks).load(root)
    raw = listed.select("project", "path", "modified", "file").mapInPandas(_reader(spark), "project string, path string, modified timestamp, file string, raw binary")
    return raw.select("project", "path", tx.decode_text(F.col("raw")).alias("content"), "modified")


def read_corpus(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Corpus (project, path, content) from a table of files; content may be text or bytes."""
    table = spark.read.format(format).load(path)
    content = F.col("content")
    text = tx.decode_text(content) if dict(table.dtypes)["content"] == "binary" else tx.normalize_newlines(content)
    return table.select(*[c for c in table.columns if c != "content"], text.alias("content"))
