"""Token counts of documents in flat token files, from the separators between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.shared import map_rows, shared_folder, slices, staged
from auditlake.llm.tokens import ByteEncoder
from auditlake.operators.durable import durable

#: Bytes of a file that a row of the scan stands for, blocks that are scanned as one group, and tasks of a scan at most.
BLOCK_BYTES, GROUP, TASKS = 8 << 20, 1024, 100_000
#: A new token file is begun once one has so many bytes.
FILE_BYTES = 1 << 30

MANIFEST = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])
FOUND = pa.schema([("file", pa.string()), ("block", pa.int64()), ("tokens", pa.int64()), ("at", pa.list_(pa.int64()))])


def id_type(width: int) -> str:
    return {2: "<u2", 4: "<u4"}[width]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of every text, each followed by ``end_id``, into ``part-*.bin`` files of ``width`` bytes an id.

    ``folder`` is an empty path that all executors reach. A file gets its name once it is complete,
    so a task that is run again replaces it. Gives the written list of file, ordinal and doc_id,
    which the scan does not need. Null text is a document without ids.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        from pyarrow.fs import FileSystem

        files, place = FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        encoder, end = ByteEncoder(tokenizer, special=False), np.array([end_id], id_type(width)).tobytes()
        task, number, out, name = TaskContext.get(), 0, None, ""
        for part in slices(batches):
            rows = []
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                if out is None:
                    name, ordinal = f"part-{task.partitionId():06d}-{number:04d}.bin", 0
                    out = files.open_output_stream(f"{place}/_{name}.{task.taskAttemptId()}")
                out.write(np.frombuffer(ids, "<u4").astype(id_type(width)).tobytes() + end)
                rows.append((name, ordinal, doc_id))
                ordinal += 1
                if out.tell() >= file_bytes:
                    out.close()
                    files.move(f"{place}/_{name}.{task.taskAttemptId()}", f"{place}/{name}")
                    out, number = None, number + 1
            yield rows
        if out is not None:
            out.close()
            files.move(f"{place}/_{name}.{task.taskAttemptId()}", f"{place}/{name}")

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return staged(map_rows(rows, work, MANIFEST), "token-files")


def find_separators(spark: SparkSession, folder: str, end_id: int, width: int, block_bytes: int) -> DataFrame:
    """A row per block of the ``*.bin`` files in a folder: file, block, its number of ids and where in the file separators are."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    sizes = listed.select(F.substring_index("path", "/", -1).alias("file"), "length").where("length > 0")
    blocks = sizes.select("file", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block_bytes))).alias("block"))
    count = sizes.agg(F.sum(F.ceil(F.col("length") / block_bytes))).first()[0] or 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        from pyarrow.fs import FileSystem

        files, place = FileSystem.from_uri(folder)
        for part in slices(batches, 1):
            file, length, block = (part.column(c)[0].as_py() for c in ("file", "length", "block"))
            if length % width:
                raise ValueError(f"{file} holds no whole number of ids")
            with files.open_input_file(f"{place}/{file}") as data:
                ids = np.frombuffer(data.read_at(min(block_bytes, length - block * block_bytes), block * block_bytes), id_type(width))
            at = np.flatnonzero(ids == end_id) + block * (block_bytes // width)
            yield [(file, block, len(ids), at)]

    return map_rows(blocks.repartition(min(TASKS, count)), work, FOUND)


def stitch(found: DataFrame) -> DataFrame:
    """Documents from the separators of blocks: file, ordinal, start, n_tokens, ended.

    What a block must know of those before it, how many separators they hold and where the last one
    is, comes from a prefix scan over one row per block: within groups of GROUP blocks, and over the
    groups of a file. The positions themselves stay with their block.
    """
    group = F.floor(F.col("block") / GROUP)
    brief = durable(found.select("file", "block", group.alias("group"), "tokens", F.size("at").cast("long").alias("ends"), F.array_max("at").alias("last")))
    before = lambda w: (F.coalesce(F.sum("ends").over(w), F.lit(0)), F.max("last").over(w))
    groups = brief.groupBy("file", "group").agg(F.sum("ends").alias("ends"), F.max("last").alias("last"))
    over_groups = before(Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    over_blocks = before(Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("file", "group", over_groups[0].alias("group_ends"), over_groups[1].alias("group_last"))
    carried = brief.select("file", "group", "block", over_blocks[0].alias("ends"), over_blocks[1].alias("last")).join(groups, ["file", "group"])
    carried = carried.select("file", "block", (F.col("ends") + F.col("group_ends")).alias("base"), (F.coalesce("last", "group_last", F.lit(-1)) + 1).alias("open"))
    # documents are made inside the array, so that no row carries the positions of its block
    begin = lambda i: F.when(i == 0, F.col("open")).otherwise(F.get("at", i - 1) + 1)
    docs = F.transform("at", lambda end, i: F.struct((F.col("base") + i).alias("ordinal"), begin(i).alias("start"), (end - begin(i)).alias("n_tokens")))
    ended = found.join(carried, ["file", "block"]).select("file", F.inline(docs)).withColumn("ended", F.lit(True))
    files = brief.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.sum("ends").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"))
    rest = files.where("start < tokens").select("file", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def count_tokens(spark: SparkSession, folder: str, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents in the flat token files ``*.bin`` of a folder: file, ordinal, start, n_tokens, ended.

    Files are read in blocks of ``block_bytes`` (a multiple of ``width``), wherever documents begin or
    end; n_tokens does not count the separator. Two separators in a row are an empty document; ids
    after the last separator are a document that has not ended. Empty files and folders give no
    rows; a file that ends within an id stops the job.
    """
    return stitch(staged(find_separators(spark, folder, end_id, width, block_bytes), "separators"))


def document_tokens(docs: DataFrame, tokenizer: str, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write (doc_id, text) as token files in the shared folder and count the tokens of each document there: doc_id and the columns of ``count_tokens``.

    Rows that repeat are documents of their own; other columns are not read; an empty table gives no rows.
    """
    folder = shared_folder(docs.sparkSession, "tokens")
    named = write_token_files(docs, folder, tokenizer, end_id)
    if named.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, file string, ordinal long, start long, n_tokens long, ended boolean")
    return named.join(count_tokens(docs.sparkSession, folder, end_id, block_bytes=block_bytes), ["file", "ordinal"], "full").select("doc_id", "file", "ordinal", "start", "n_tokens", "ended")
