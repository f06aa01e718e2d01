"""WARC archives: writing, reading, and transaction assembly (operator 10).

Archives are written by Spark's own text writer (each value is one capture's records, the line separator is the blank
line that ends a record), so that tasks commit as usual and any Hadoop file system will do. They are read as binary
files and parsed as a stream. Request, response or revisit, and metadata are joined through WARC-Concurrent-To.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, scratch

#: Fixed values of the format and of the contract.
END, LEAST_REVISIT = "\r\n\r\n", 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
#: About so many bytes of payload go to an archive.
ARCHIVE_BYTES = 32 << 20
RECORD = "kind string, record_id string, concurrent_to string, refers_to string, page_id string, uri string, date string, digest string, payload_bytes long, payload binary"


def _record(kind: str, record_id: Column, fields: list[Column], block: Column) -> Column:
    """Fields that are null are left out."""
    head = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")), F.lit("WARC-Date: 2024-01-01T00:00:00Z"), *fields]
    return F.concat(F.concat_ws("\r\n", *head, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit(END), block)


def _field(name: str, value: Column) -> Column:
    """A header line; line ends inside a value become spaces."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]+", " "))


def write_warc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes request, response or revisit, and metadata records for each row of ``pages`` (page_id, url, html).

    The payload is html in UTF-8, of a null none. Of payloads of at least 100 bytes that are equal, the one of the
    smallest page_id is the response and the others revisit it, those without a page_id too. Names of records follow from
    the page_id and the payload, and so are the same in every pass over the pages; of rows that repeat both, each has its
    records, under the same names. Only digests are grouped and joined; payloads aren't shuffled unless over 200,000
    payloads repeat. Other columns are ignored, whatever their names.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    repeated = rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = cut(repeated.where("n > 1 AND first_id IS NOT NULL").select(F.col("digest").alias("again"), "first_id"))
    mean = rows.agg(F.avg("bytes")).first()[0] or 0
    rows = rows.join(broadcast_if_small(repeated, 200_000), (F.col("digest") == F.col("again")) & (F.col("bytes") >= LEAST_REVISIT), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = lambda page, part: F.concat_ws(":", F.lit("urn:capture"), F.coalesce(page.cast("string"), F.concat(F.lit("row"), F.col("row").cast("string"))), F.col("digest"), F.lit(part))
    own = name(F.col("page_id"), "main")
    about = [_field("WARC-Target-URI", F.col("url")), _field("Page-Id", F.col("page_id").cast("string"))]
    digest = _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))
    beside = [F.concat(F.lit("WARC-Concurrent-To: <"), own, F.lit(">")), *about]
    http = F.lit("Content-Type: application/http; msgtype=response")
    host = F.coalesce(F.nullif(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\r\n]+)", 1), F.lit("")), F.lit("unknown"))
    parts = [
        _record("request", name(F.col("page_id"), "request"), [*beside, F.lit("Content-Type: application/http; msgtype=request")], F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), host, F.lit(END))),
        F.when(revisit, _record("revisit", own, [*about, F.lit(f"WARC-Profile: {PROFILE}"), F.concat(F.lit("WARC-Refers-To: <"), name(F.col("first_id"), "main"), F.lit(">")), digest, http], F.lit(HTTP)))
        .otherwise(_record("response", own, [*about, digest, http], F.concat(F.lit(HTTP), F.col("payload")))),
        _record("metadata", name(F.col("page_id"), "metadata"), [*beside, F.lit("Content-Type: application/warc-fields")], F.lit("fetchTimeMs: 0\r\n")),
    ]
    out = rows.select(F.concat_ws(END, *parts).alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, int(archive_bytes // (mean + 1000)))).text(path)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of one archive. Field names are in lower case; an incomplete last record is an error."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (at := held.find(END.encode())) <= 0 and (at == 0 or more()):
            if at == 0:  # more blank lines than the format asks for
                del held[: len(END)]
        if at < 0:
            if held.strip():
                raise ValueError("a record has no end of its header")
            return
        lines = held[:at].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = at + len(END)
        end = start + int(fields["content-length"])
        while len(held) < end + len(END) and more():
            pass
        if len(held) < end:
            raise ValueError("a record's block is cut off")
        yield fields, bytes(held[start:end])
        del held[: end + len(END)]


def unpacked(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a file that may be gzipped, whole or member by member."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[i : i + step] for i in range(0, len(data), step))
        return
    while data:
        z = zlib.decompressobj(31)
        while not z.eof and data:
            yield z.decompress(data, step)
            data = z.unconsumed_tail
        data = z.unused_data


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row per record of all archives under ``path``. Of responses, digest and payload_bytes are those of the payload
    that was read; of revisits, the digest is the recorded one and payload_bytes is null. An archive is one row of
    binary data, so it must fit in a worker; write_warc keeps them near 32 MB unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = lambda x: x and x.strip("<>")
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string()] * 8 + [pa.int64(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows, held = [], 0
            for data in batch.column(0):
                for fields, block in parse(unpacked(data.as_py())):
                    kind, digest, size, payload = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, None, None
                    if kind == "response":
                        payload = block.partition(END.encode())[2]
                        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    rows.append((kind, bare(fields.get("warc-record-id")), bare(fields.get("warc-concurrent-to")), bare(fields.get("warc-refers-to")), fields.get("page-id"), fields.get("warc-target-uri"), fields.get("warc-date"), digest, size, payload if with_payload else None))
                    held += len(payload or b"") * with_payload
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{gz,warc,txt}").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response (a response or a revisit), metadata, and copies: how often
    the response is there.

    A record belongs to the one that it is concurrent to, else to itself. A part that is missing is null; of repeated
    parts the greatest is taken, which for copies of one record is any of them.
    """
    part = F.struct("record_id", "kind", "refers_to", "page_id", "uri", "date", "digest", "payload_bytes", "payload")
    of = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), part))
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"), F.count_if(F.col("kind").isin("response", "revisit")).alias("copies"))


def captures(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to a new folder of archives in the shared folder, reads them back, and returns page_id,
    payload_bytes, payload_digest, record_type, refers_to and url, has_request, has_metadata.

    One row per row of ``pages``, also of rows that are equal, or that have no page_id or html. A very large page is
    one record, which has to fit in a task. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages, path)
    nested = assemble(read_warc(spark, path, with_payload=False))
    main = nested.where(F.col("response").isNotNull())
    one = main.select(
        F.col("response.page_id").cast("long").alias("page_id"), "response.record_id", "response.kind", "response.digest", "response.payload_bytes", "response.uri",
        F.col("response.refers_to").alias("to"), F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"), "copies",
    )
    one = cut(one)
    wanted = one.where(F.col("to").isNotNull()).select("to").distinct()
    first = one.select(F.col("record_id").alias("first_record"), F.col("page_id").alias("first_page"), F.col("payload_bytes").alias("first_bytes"))
    first = first.join(wanted, F.col("first_record") == F.col("to"), "left_semi")
    again = one.where(F.col("to").isNotNull()).join(broadcast_if_small(first, 200_000), F.col("to") == F.col("first_record"), "left").drop("first_record")
    rest = one.where(F.col("to").isNull()).withColumns({"first_page": F.lit(None).cast("long"), "first_bytes": F.lit(None).cast("long")})
    every = rest.unionByName(again).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return every.select("page_id", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("first_page").alias("refers_to"), F.col("uri").alias("url"), "has_request", "has_metadata")
