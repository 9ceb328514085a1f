"""Web archives: writing, normalising, and reading them back.

Pages become WARC records. Spark writes each partition as one gzip stream over
the whole file, as many crawlers leave it. The normaliser inflates such a file
once, from front to back, and rewrites every record as a gzip member of its own,
with a sidecar index of offsets, so that any record can be read alone. Records
are then read through the index, each by its own bytes.

Of pages with equal payloads of at least `min_bytes` bytes the one with the
largest id is written in full; the others are revisit records that refer to it.

Nulls and edge cases: a null html is an empty payload; a null url leaves out the
target; white space in a url is percent-encoded. Rows that share an id are
records of their own; of those with the largest id one is the response. A null
id sorts below all others. An empty table gives no records. Extra columns are
ignored. Files that a failed task left behind are in no index and are not read.
A very long page is one record, held whole by the task that writes, rewrites or
reads it; archives are cut by bytes, not by records. Size and digest of a revisit
are those its header states, which are those of the payload it stands for.
"""

from __future__ import annotations

import re
import uuid
import zlib
from hashlib import sha1

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.llm.common import numbered, ship, text_of
from spotlake.sources.scratch import materialise, scratch_path

MIN_BYTES = 1000
# Record bytes of an archive before compression, on average; a larger record is an archive of its own size.
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 32 << 20
LEVEL = 1
_CHUNK = 1 << 20
_END = b"\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

ship(__name__)


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_bytes: int = MIN_BYTES) -> DataFrame:
    """One column `record`: the text of a WARC record per page, without the blank lines that end it."""
    body = text_of(html_col)
    keyed, number = numbered(pages)
    rows = keyed.select(F.col(number).alias("row"), F.col(f"`{id_col}`").alias("id"),
                        F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("body"),
                        F.octet_length(body).alias("bytes"), F.sha1(body.cast("binary")).alias("digest"))
    narrow = rows.select("row", "id", "bytes", "digest")
    groups = materialise(narrow, "page-digests").where(F.col("bytes") >= min_bytes).groupBy("bytes", "digest").agg(
        F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bytes", "digest", "keep")
    linked = rows.join(materialise(groups, "page-groups"), ["bytes", "digest"], "left")
    revisit = F.col("keep").isNotNull() & (F.col("row") != F.col("keep.row"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(_HTTP), F.col("body")))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    url = F.regexp_replace("url", r"[\s\p{Cntrl}]", "%20")
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), _name(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), url), F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), F.concat(F.lit("X-Payload-Bytes: "), F.col("bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _name(F.col("keep.id")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return linked.select(F.concat(head, F.lit("\r\n\r\n"), block).alias("record"))


def write_archives(record_rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One gzip stream per file; a record is its text and the two line ends after it.

    Records are dealt by hash into as many files as their bytes ask for, so that the
    normaliser, which holds one file at a time, needs the same memory at any size.
    The bytes are summed in a pass of their own: the records are built twice, and
    not written beside the archives.
    """
    total = record_rows.agg(F.sum(F.octet_length("record").cast("long") + len(_END))).first()[0] or 0
    dealt = record_rows.repartition(max(1, -(-total // archive_bytes)), F.xxhash64("record"))
    dealt.write.option("lineSep", _END.decode()).option("compression", "gzip").text(path)


class Reader:
    """Bytes of a gzip file, inflated once from front to back; members that follow each other count as one stream."""

    def __init__(self, content: bytes):
        self.content, self.at = memoryview(content), 0
        self.inflate, self.held = zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
            if self.at == len(self.content):
                return False
            self.inflate = zlib.decompressobj(31)
        piece = self.inflate.unconsumed_tail or self.content[self.at:self.at + _CHUNK]
        if not len(piece):
            return False
        if not self.inflate.unconsumed_tail:
            self.at += len(piece)
        self.held += self.inflate.decompress(piece, _CHUNK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with `mark`; None at the end of the file."""
        seen = 0
        while (found := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("archive ends inside a record")
                return None
        return self.take(found + len(mark))

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self._more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def fields(head: bytes) -> dict[str, str]:
    """Header fields of a record by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def members(content: bytes):
    """Each record of an archive as (head, its bytes as a gzip member)."""
    reader = Reader(content)
    while (head := reader.until(_END)) is not None:
        body = reader.take(int(fields(head)["content-length"]) + len(_END))
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        yield head, pack.compress(head + body) + pack.flush()


def normalise(spark: SparkSession, archives: str, target: str) -> DataFrame:
    """Rewrites every archive below `archives` into `target`; returns the index, one row per record.

    Index: `archive`, `offset`, `length` (bytes of the record's member), `record_id`, `record_type`.
    The executors write below `target`, so it must be a folder they all share.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(archives).select("content")
    schema = "archive string, offset long, length long, record_id string, record_type string"

    def rewrite(batches):
        place, root = fs.FileSystem.from_uri(target)
        place.create_dir(root, recursive=True)
        for batch in batches:
            for content in batch.column(0):
                # Every attempt writes a file of its own; only files of finished tasks reach the index.
                name = f"{uuid.uuid4().hex}.warc.gz"
                rows, offset = [], 0
                with place.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for head, member in members(content.as_buffer().to_pybytes()):
                        out.write(member)
                        f = fields(head)
                        rows.append((name, offset, len(member), f["warc-record-id"], f["warc-type"]))
                        offset += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[i] for r in rows]) for i in range(5)],
                        ["archive", "offset", "length", "record_id", "record_type"])

    return materialise(files.mapInArrow(rewrite, schema), "archive-index")


_PAGE = re.compile(r"<urn:x-page:(.*)>")


def _page(name: str | None) -> str | None:
    return (_PAGE.fullmatch(name).group(1) or None) if name else None


def read_records(index: DataFrame, target: str) -> DataFrame:
    """Every record of the index, read by its own bytes.

    Returns `page_id` (text), `url`, `payload_bytes`, `payload_digest`,
    `record_type`, `refers_to` (text). Payloads found are checked against the
    digest in their header.
    """
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"

    def read(batches):
        place, root = fs.FileSystem.from_uri(target)
        name, source = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    name, source = archive, place.open_input_file(f"{root}/{archive}")
                record = zlib.decompress(source.read_at(length, offset), 31)
                end = record.index(_END) + len(_END)
                f = fields(record[:end])
                size, digest = int(f["x-payload-bytes"]), f["warc-payload-digest"].removeprefix("sha1:")
                if f["warc-type"] == "response":
                    block = record[end:end + int(f["content-length"])]
                    payload = block[block.index(_END) + len(_END):]
                    if (len(payload), sha1(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"payload of {f['warc-record-id']} does not fit its header")
                rows.append((_page(f["warc-record-id"]), f.get("warc-target-uri"), size, digest, f["warc-type"],
                             _page(f.get("warc-refers-to"))))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[i] for r in rows], pa.int64() if i == 2 else pa.string()) for i in range(6)],
                ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # By the bytes to read, not by the small index: neighbours in an archive stay together.
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, size // READ_BYTES)
    return index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").mapInArrow(read, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages written as archives, normalised, and read back: `page_id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to`."""
    spark = pages.sparkSession
    written, target = scratch_path(spark, "crawl"), scratch_path(spark, "archives")
    target = target if re.match(r"\w+:/", target) else f"file://{target}"
    write_archives(records(pages, id_col, url_col, html_col, min_bytes), written)
    id_type = pages.schema[id_col].dataType
    return read_records(normalise(spark, written, target), target).select(
        F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(id_type).alias("refers_to"))
