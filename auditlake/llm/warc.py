"""WARC archives of Zstandard frames that share a dictionary: writing from a table and reading back."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.shared import map_rows, shared_folder, slices, small_or_salted, staged
from auditlake.operators.durable import durable

#: Fixed by the format: the magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Records that train the dictionary, bytes of the stretch of each that it sees, and its size.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 16 << 10, 64 << 10
#: With fewer records or bytes than these, training may fail.
LEAST_RECORDS, LEAST_BYTES = 8, 4096
#: A new archive is begun once one has so many bytes.
ARCHIVE_BYTES = 32 << 20

INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])
RECORDS = pa.schema(
    [("file", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string())]
    + [("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def record_types(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Written rows (page_id, url, payload, bytes, digest, row) with the page and row that a revisit refers to."""
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = staged(
        pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("payload"))
        .withColumns({"bytes": F.length("payload").cast("long"), "digest": F.sha2("payload", 256), "row": F.monotonically_increasing_id()}),
        "pages",
    )
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first")
    repeated = durable(rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(first, F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    again = F.col("first.row") != F.col("row")
    return small_or_salted(rows, repeated, ["digest"], "left").select(
        "page_id", "url", "payload", "bytes", "digest", "row", F.when(again, F.col("first.page_id")).alias("to_page"), F.when(again, F.col("first.row")).alias("to_row")
    )


def train(rows: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from at most ``sample`` records, those with the lowest hashes of their payload; empty if they are too few to train on.

    Of a payload longer than ``sample_bytes`` a stretch of that length is seen, which begins where
    another hash of the payload says. Training that fails on enough records stops the job.
    """
    import zstandard

    begin = F.pmod(F.xxhash64("digest", F.lit("stretch")), F.greatest(F.col("bytes") - sample_bytes + 1, F.lit(1)))
    stretch = F.substring("payload", (begin + 1).cast("int"), F.lit(sample_bytes))
    drawn = rows.where("bytes > 0 and to_row is null").select(F.xxhash64("digest").alias("h"), "row", stretch.alias("p"))
    parts = [bytes(r["p"]) for r in drawn.orderBy("h", "row").limit(sample).collect()]
    total = sum(map(len, parts))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), parts).as_bytes()
    except zstandard.ZstdError:
        if len(parts) < LEAST_RECORDS or total < LEAST_BYTES:
            return b""
        raise


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{row}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, row: int, to_page: int | None, to_row: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = to_row is not None
    block = http if again else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or record_id(page_id, row)[1:-1]
    fields = [
        ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page_id, row)), ("WARC-Target-URI", uri), ("WARC-Date", date),
        *([("WARC-Refers-To", record_id(to_page, to_row)), ("WARC-Profile", REVISIT_PROFILE)] if again else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in fields), b"\r\n", block, b"\r\n\r\n"])


def parse(data: bytes) -> dict:
    """Fields of a record and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields | {"block": rest[: int(fields["Content-Length"])]}


class Archive:
    """One archive file; it gets its name once it is complete, so a task that is run again replaces it."""

    def __init__(self, files, folder: str, name: str, attempt: int, dictionary: bytes, level: int, date: str):
        import zstandard

        self.files, self.path, self.name = files, f"{folder}/{name}", name
        self.unnamed = f"{folder}/_{name}.{attempt}"
        self.out, self.at = files.open_output_stream(self.unnamed), 0
        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, **shared)
        if dictionary:
            self.put(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        info = b"software: auditlake\r\nformat: WARC File Format 1.1\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-archive:{name}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        self.add(head.encode() + info + b"\r\n\r\n")

    def put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, data: bytes) -> tuple[int, int]:
        return self.put(self.packer.compress(data))

    def close(self) -> None:
        self.out.close()
        self.files.move(self.unnamed, self.path)


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 100, level: int = 3, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Write a record per row of (page_id, url, html) into ``part-*.warc.zst`` files under ``folder``.

    ``folder`` is an empty path that all executors reach. A dictionary is trained on a bounded sample
    of the payloads and leads every file in a skippable frame; every record is a frame of its own. Of
    rows with equal payloads of at least ``least_bytes``, the one with the smallest page_id (then the
    first row) is the response and the others are revisits that refer to it.

    Null html is an empty payload, a null url is replaced by the record's id, null page ids come last
    and rows that repeat each get a record. Other columns are not read. Gives the index that was
    written: file, offset, length, record_id, record_type.
    """
    spark = pages.sparkSession
    rows = record_types(pages, least_bytes)
    dictionary = spark.sparkContext.broadcast(train(rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        from pyarrow.fs import FileSystem

        files, place = FileSystem.from_uri(folder)
        files.create_dir(place, recursive=True)
        task, number, archive, written = TaskContext.get(), 0, None, []
        for part in slices(batches):
            for page_id, url, payload, digest, row, to_page, to_row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if archive is None:
                    archive = Archive(files, place, f"part-{task.partitionId():06d}-{number:04d}.warc.zst", task.taskAttemptId(), dictionary.value, level, date)
                span = archive.add(record(page_id, url, payload, digest, row, to_page, to_row, date))
                written.append((archive.name, *span, record_id(page_id, row), "response" if to_row is None else "revisit"))
                if archive.at >= archive_bytes:
                    archive.close()
                    archive, number = None, number + 1
            if archive is None:
                yield written
                written = []
        if archive is not None:
            archive.close()
        yield written

    index = map_rows(rows.select("page_id", "url", "payload", "digest", "row", "to_page", "to_row"), work, INDEX)
    return staged(index, "warc-index")


def frames(data: memoryview) -> Iterator[bytes]:
    """Contents of the frames of an archive, with the dictionary of its first frame."""
    import zstandard

    at, unpacker = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_MAGIC and at == 0:
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size])))
            at += 8 + size
            continue
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            piece = data[at : at + 65536]
            if not piece:
                raise ValueError("an archive ends within a record")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all ``*.warc.zst`` files under a folder; an archive is read by one task.

    payload is null for revisits; payload_bytes and payload_digest are what the record says of the
    payload, and a response whose payload has another digest or length stops the job.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        page = lambda name: int(p) if name and (p := name[1:-1].split(":")[2]) else None
        for batch in slices(batches, 1):
            name, data = batch.column("path")[0].as_py(), batch.column("content")[0].as_buffer()
            rows = []
            for fields in map(parse, frames(memoryview(data))):
                if fields["WARC-Type"] == "warcinfo":
                    continue
                http, _, payload = fields["block"].partition(b"\r\n\r\n")
                size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                again = fields["WARC-Type"] == "revisit"
                if not again and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{name}: {fields['WARC-Record-ID']} is damaged")
                record = fields["WARC-Record-ID"]
                rows.append((name, record, fields["WARC-Type"], page(record), fields["WARC-Target-URI"], page(fields.get("WARC-Refers-To")), None if again else payload, size, digest))
                if len(rows) == 256:
                    yield rows
                    rows = []
            yield rows

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return map_rows(archives.select("path", "content"), work, RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages to a new folder of archives in the shared folder and read the records back; an empty table has none."""
    folder = shared_folder(pages.sparkSession, "warc")
    if write_archives(pages, folder).isEmpty():
        return pages.sparkSession.createDataFrame([], map_rows(pages, lambda b: iter(()), RECORDS).schema)
    return read_archives(pages.sparkSession, folder)
