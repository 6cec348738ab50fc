"""WARC archives written and read by Spark, oversized payloads as chunk rows.

A payload beyond ``CHUNK_BYTES`` is written as a segmented record (WARC 1.1: first
segment, then ``continuation`` records that name it), so an archive is a table of
(record id, chunk number, bytes) and no reader or writer of archives has to hold
more than a chunk: a generator cuts the payload's bytes where they lie, carries one
digest over the chunks and hands on batches of about ``BATCH_BYTES``. Spark's text writer joins the records by the two line ends that
close a WARC record; its reader, parting at ``CRLF CRLF WARC/1.1 CRLF``, gets them
back on any store, split over tasks. A payload that holds that mark itself is cut
inside the mark.

Every row's record has an id of its own (``urn:page:``, the page id, a UUID), which
its continuations carry as Segment-Origin-ID. Reading carries incremental SHA-1
digests over the ordered chunks of a record: a task keeps one digest state, whatever
the record's length. A record that lacks a segment or is not as long as its header
says fails the read.

Of payloads that are equal and at least ``least_bytes`` long, the row with the
largest id is written as ``response``, the others as ``revisit`` of it, without a
block. Equality is that of SHA-1 and length; rows that share an id are told apart by it.
A null payload is an empty one. A row with a null id is always a response. Repeated
rows give a record each. An empty table gives an empty archive and result. Columns
other than id, payload and uri are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspark.llm.staging import stage
from nearspark.session import shared_path

CHUNK_BYTES = 64 << 10
BATCH_BYTES = 1 << 20
RECORDS_PER_FILE = 20_000
BROADCAST_ROWS = 100_000
_END = "\r\n\r\n"
_MARK = _END + "WARC/1.1\r\n"
_INSIDE = re.compile(rb"\r\n\r\nWARC(?=/1\.1)")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(pages: DataFrame, least_bytes: int = 1000) -> tuple[DataFrame, DataFrame]:
    """``(page_id, n, sha1)`` of all rows, and ``(page_id, sha1, n, refers_to)`` of those that repeat another."""
    digests = stage(pages.select("page_id", F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha1")),
                    "warc-digests")
    groups = (digests.filter(F.col("n") >= least_bytes).groupBy("sha1", "n")
              .agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).filter("low < refers_to"))
    again = digests.join(groups.drop("low"), ["sha1", "n"]).filter("page_id < refers_to")
    return digests, stage(again.select("page_id", "sha1", "n", "refers_to").distinct(), "warc-revisits")


def _cuts(payload: memoryview, size: int) -> list[int]:
    """Where a payload's chunks end: every ``size`` bytes, and inside any record mark."""
    ends, a = [], 0
    for b in [*(m.end() for m in _INSIDE.finditer(payload)), len(payload)]:
        ends += range(a + size, b, size)
        ends.append(b)
        a = b
    return ends


def _header(**fields) -> bytes:
    lines = [f"{name.replace('_', '-')}: {value}\r\n" for name, value in fields.items() if value is not None]
    return ("WARC/1.1\r\n" + "".join(lines) + "\r\n").encode()


def _segments(row: dict, payload: memoryview, size: int, date: str):
    """The records of one row, in order. Holds a chunk at a time and a running digest."""
    own = f"<urn:page:{row['page_id'] or ''}:{row['uuid']}"
    about = {"WARC_Date": date, "WARC_Target_URI": row["uri"], "WARC_Payload_Digest": f"sha1:{row['sha1']}",
             "WARC_Payload_Length": row["n"]}
    if row["refers_to"] is not None:
        yield _header(WARC_Type="revisit", WARC_Record_ID=own + ">", **about,
                      WARC_Refers_To=f"<urn:page:{row['refers_to']}>", WARC_Profile=_PROFILE, Content_Type="text/html",
                      Content_Length=0)
        return
    ends, digest, a = _cuts(payload, size), hashlib.sha1(), 0
    for i, b in enumerate(ends):
        chunk = payload[a:b]
        digest.update(chunk)
        segment = {}
        if len(ends) > 1:
            segment = {"WARC_Segment_Number": i + 1, "WARC_Segment_Origin_ID": own + ">" if i else None,
                       "WARC_Block_Digest": f"sha1:{hashlib.sha1(chunk).hexdigest()}",
                       "WARC_Segment_Total_Length": row["n"] if b == len(payload) else None}
        if b == len(payload) and digest.hexdigest() != row["sha1"]:
            raise ValueError(f"page {row['page_id']}: its payload changed while it was written")
        yield _header(WARC_Type="continuation" if i else "response", WARC_Record_ID=own + (f"/{i}>" if i else ">"),
                      **about, **segment, Content_Type="text/html", Content_Length=b - a) + chunk
        a = b


def _records(size: int, date: str):
    def run(batches):
        out, held = [], 0
        for batch in batches:
            payloads = batch.column("payload")
            for i, row in enumerate(batch.drop_columns(["payload"]).to_pylist()):
                for record in _segments(row, memoryview(payloads[i].as_buffer()), size, date):
                    out.append(record)
                    held += len(record)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    return run


def write(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url",
          least_bytes: int = 1000, chunk_bytes: int = CHUNK_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write archives of all rows to the folder ``path``."""
    uri = F.regexp_replace(F.col(uri_col).cast("string"), "[\\x00-\\x20]", "%20") if uri_col in pages.columns else F.lit(None)
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
                        uri.cast("string").alias("uri"))
    _, again = revisits(rows, least_bytes)
    few = again.count() <= BROADCAST_ROWS  # beyond that, a shuffled join
    rows = (rows.withColumns({"n": F.octet_length("payload"), "sha1": F.sha1("payload")})
            .join(F.broadcast(again) if few else again, ["page_id", "sha1", "n"], "left"))
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "uri",
                       F.col("refers_to").cast("string").alias("refers_to"), F.uuid().alias("uuid"), "n", "sha1",
                       F.col("payload").cast("binary").alias("payload"))
    records = rows.mapInArrow(_records(chunk_bytes, date), "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", _END).option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record, chunk_no, segmented, record_type, refers_to, payload_bytes, payload_digest, chunk)``.

    One row per WARC record; ``record`` is the id that all segments of a record share. ``payload_bytes`` and ``payload_digest`` are what its
    header says; a block that is not as long as its header says fails the read.
    """
    text = spark.read.option("lineSep", _MARK).text(path)
    head = F.substring_index("value", _END, 1)

    def header(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))

    rows = text.select("value", head.alias("head"))
    size = header("Content-Length").cast("int")
    chunk = F.substring(F.col("value").cast("binary"), F.octet_length("head") + 5, size)
    rows = rows.select(
        F.regexp_extract("head", r"(?m)^WARC-Record-ID: <urn:page:(-?\d*)", 1).try_cast("long").alias("page_id"),
        F.coalesce(header("WARC-Segment-Origin-ID"), header("WARC-Record-ID")).alias("record"),
        (F.coalesce(header("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk_no"),
        header("WARC-Segment-Number").isNotNull().alias("segmented"),
        header("WARC-Type").alias("record_type"),
        F.regexp_extract("head", r"(?m)^WARC-Refers-To: <urn:page:(-?\d+)", 1).try_cast("long").alias("refers_to"),
        header("WARC-Payload-Length").cast("long").alias("payload_bytes"),
        F.substring(header("WARC-Payload-Digest"), 6, 40).alias("payload_digest"), size.alias("size"), chunk.alias("chunk"))
    whole = F.octet_length("chunk") == F.col("size")
    return rows.withColumn("chunk", F.when(whole, F.col("chunk")).otherwise(
        F.raise_error(F.concat(F.lit("short block in record of page "), F.col("page_id").cast("string"))).cast("binary"))
    ).drop("size")


def _running(batches):
    """Bytes and SHA-1 up to and with each chunk; chunks of a record come in order."""
    record, digest, n, least, number = None, None, 0, 0, 0

    def whole():
        if n != least:
            raise ValueError(f"record {record}: {n} bytes after its last chunk, not {least}")

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("record", "chunk_no", "payload_bytes")]
        sums, hexes = [], []
        for i, (r, c, m) in enumerate(zip(*columns)):
            if r != record:
                whole()
                record, digest, n, least, number = r, hashlib.sha1(), 0, m, 0
            if c != number:
                raise ValueError(f"record {r}: chunk {c} where chunk {number} should be")
            raw = batch.column("chunk")[i].as_buffer()
            digest.update(raw)
            n, number = n + raw.size, number + 1
            sums.append(n)
            hexes.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("record"), batch.column("chunk_no"), batch.column("payload_bytes"),
             pa.array(sums, pa.int64()), pa.array(hexes, pa.string())],
            names=["page_id", "record", "chunk_no", "payload_bytes", "bytes_so_far", "sha1_so_far"])
    whole()


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """``(page_id, record, chunk_no, payload_bytes, bytes_so_far, sha1_so_far)`` of segmented records."""
    rows = chunks.filter("segmented").select("page_id", "record", "chunk_no", "payload_bytes", "chunk")
    return (rows.repartition("record").sortWithinPartitions("record", "chunk_no")
            .mapInArrow(_running, "page_id long, record string, chunk_no int, payload_bytes long, bytes_so_far long, "
                                  "sha1_so_far string"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` measured on what was read.

    One row per record written. A revisit has no block: its length and digest are those its header carries.
    """
    chunks = read_chunks(spark, path)
    short = chunks.filter("NOT segmented").select(
        "page_id",
        F.when(F.col("record_type") == "revisit", F.col("payload_bytes")).otherwise(
            F.octet_length("chunk").cast("long")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("payload_digest")).otherwise(
            F.sha1("chunk")).alias("payload_digest"), "record_type", "refers_to")
    last = chunk_digests(chunks).filter("bytes_so_far = payload_bytes").groupBy("record", "page_id", "payload_bytes").agg(
        F.max_by("sha1_so_far", "chunk_no").alias("payload_digest"))
    long = last.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
                       F.lit(None).cast("long").alias("refers_to"))
    return short.unionByName(long)


def round_trip(pages: DataFrame, **cols) -> DataFrame:
    """Write archives to the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path, **cols)
    return read_pages(pages.sparkSession, path)
