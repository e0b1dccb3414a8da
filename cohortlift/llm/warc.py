"""WARC archives written with an index, and read through it.

Every writing task makes its own files of gzip members, one a record, and
returns an index row per record: file, offset, length, URL and digest. Reading
starts from the index: the selected rows are sorted by file and offset, close
byte ranges become one read, and the records are cut out of what was read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlift.llm.files import Writer, make_folder, read_range
from cohortlift.llm.shared import shared_folder, shards_for, stored, text_of

LEAST_SHARED = 1000      # smaller payloads are always written whole
FILE_BYTES = 64_000_000  # a file is closed after so many compressed bytes
GAP = 65_536             # bytes that are read over rather than starting a new read
READ_BYTES = 8_000_000   # a read ends after so many
DATE = "1970-01-01T00:00:00Z"   # pages have no date of their own

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("page_id bigint, url string, payload_digest string, record_type string, "
         "uri string, offset bigint, length bigint")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record, as a gzip member. A revisit keeps the HTTP head and no payload."""
    head = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:   # control characters and blanks would break the header
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
        if refers_to is not None:
            fields.append(("X-Refers-To-Page-ID", str(refers_to)))
    fields.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 5, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, least: int = LEAST_SHARED, file_bytes: int = FILE_BYTES,
                   date: str = DATE) -> DataFrame:
    """Write a record per row of ``pages`` and return the stored index.

    Of records with equal payloads of at least ``least`` bytes, that with the
    largest page_id is the response; the others revisit it. A null html is an
    empty payload, a null URL has no target, a null page_id no page field and
    never is the response while another has an id. Rows that repeat a page_id
    and payload are all responses or all revisits. An empty table gives an
    empty index. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark)
    make_folder(folder)
    payload = text_of("html")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), payload.alias("html")
    ).withColumns({"digest": F.sha1(F.col("html").cast("binary")),
                   "bytes": F.octet_length("html")})
    # Pre-aggregated counts of the large payloads: only shared ones are joined.
    copies = stored(
        rows.filter(F.col("bytes") >= least).groupBy("digest")
        .agg(F.count("*").alias("n"), F.max("page_id").alias("first")).filter("n > 1")
        .select("digest", "first", F.lit(True).alias("shared")))
    placed = rows.join(copies, "digest", "left").select(
        "page_id", "url", "html", "digest", "first",
        (F.col("shared").isNotNull() & (F.col("bytes") >= least)
         & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            index = []
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                page_id, url, html, digest, first, revisit = row
                if out is None or out.size >= file_bytes:
                    if out is not None:
                        out.close()
                    out = Writer(folder, ".warc.gz")
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, first, revisit, date)
                index.append((page_id, url, digest, "revisit" if revisit else "response",
                              out.uri, out.write(data), len(data)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(
                    zip(*index) if index else [()] * 7,
                    [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()])],
                names=["page_id", "url", "payload_digest", "record_type", "uri", "offset", "length"])
        if out is not None:
            out.close()

    return stored(placed.mapInArrow(work, INDEX))


def reads_of(selected: DataFrame, gap: int = GAP, most: int = READ_BYTES) -> DataFrame:
    """Sorted byte ranges of the selected index rows, close ones as one read.

    (uri, start, size, offsets, lengths). Windows go over one file's records,
    and files are of bounded size.
    """
    in_file = Window.partitionBy("uri").orderBy("offset")
    end = F.col("offset") + F.col("length")
    return (
        selected.select("uri", "offset", "length").distinct()
        .withColumn("far", F.coalesce(F.col("offset") - F.lag(end).over(in_file) > gap, F.lit(True)))
        .withColumn("slot", F.floor(F.col("offset") / most))
        .withColumn("new", F.col("far") | (F.lag("slot").over(in_file) != F.col("slot")))
        .withColumn("read", F.sum(F.col("new").cast("int")).over(in_file))
        .groupBy("uri", "read")
        .agg(F.min("offset").alias("start"), F.max(end).alias("end"),
             F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
        .select("uri", "start", (F.col("end") - F.col("start")).alias("size"),
                F.col("records.offset").alias("offsets"), F.col("records.length").alias("lengths")))


def read_archives(index: DataFrame, gap: int = GAP, most: int = READ_BYTES) -> DataFrame:
    """The records of the selected index rows, read from the archives.

    (page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    payload); a revisit's payload is null, its length and digest come from its
    own headers. A response whose payload does not have its digest raises.
    """
    schema = ("page_id bigint, url string, record_type string, payload_bytes bigint, "
              "payload_digest string, refers_to bigint, payload binary")
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, out = read_range(row["uri"], row["start"], row["size"]), []
                for offset, length in zip(row["offsets"], row["lengths"]):
                    at = offset - row["start"]
                    fields, http, payload = parsed(data[at:at + length])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{row['uri']} at {offset}: payload differs from its digest")
                    page_id, first = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                    out.append((
                        page_id and int(page_id), fields.get("WARC-Target-URI"), fields["WARC-Type"],
                        int(http["Content-Length"]), digest, first and int(first),
                        None if revisit else payload))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)],
                    names=[f.split()[0] for f in schema.split(", ")])

    reads = reads_of(index, gap, most)
    tasks = shards_for(index.sparkSession, index.agg(F.sum("length")).first()[0] or 0, most)
    return reads.repartition(tasks, "uri", "start").mapInArrow(work, schema)
