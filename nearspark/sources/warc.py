"""WARC records: write (for round trips) and fetch-by-byte-range.

Reading follows the index: each record is one gzip member at
``(filename, offset, length)``, so executors read exactly that range and
decode one record; no task ever holds a whole WARC file. Ranges that follow one
another in a file are read together, up to ``READ_BYTES``. Files are paths or URIs
of any file system that Arrow knows. Records whose type is not ``response`` yield
nothing; any failure yields an ``error`` row and the job carries on.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READ_BYTES = 8 << 20
OUT_SCHEMA = "url string, html string, filename string, offset bigint, error string"


def _record(rec_type: str, url: str, payload: bytes, rec_id: str) -> bytes:
    head = (f"WARC/1.0\r\nWARC-Type: {rec_type}\r\nWARC-Target-URI: {url}\r\n"
            f"WARC-Record-ID: <urn:nearspark:{rec_id}>\r\n"
            f"Content-Type: application/http; msgtype={rec_type}\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode("utf-8")
    return head + payload + b"\r\n\r\n"


def _http_response(html: str) -> bytes:
    body = html.encode("utf-8")
    return (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
            + f"Content-Length: {len(body)}\r\n\r\n".encode() + body)


def write_warc(pages: DataFrame, out_dir: str, url_col: str = "url", html_col: str = "html",
               with_requests: bool = True, broken_every: int = 0, broken_col: str | None = None) -> DataFrame:
    """Write pages as ``.warc.gz`` files (one per partition, one gzip member per
    record) and return the index rows ``(url, filename, offset, length, rec_type)``.

    ``with_requests`` adds a request record before each response;
    ``broken_every`` > 0 writes a record with a corrupt header every n pages of a
    partition, ``broken_col`` (boolean) one for each page that it marks. File names
    depend only on the partition, so a retried task rewrites the same file.
    """
    def run(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        name = f"{out_dir.rstrip('/')}/part-{pid:05d}.warc.gz"
        rows = []
        store, place = pafs.FileSystem.from_uri(name)
        store.create_dir(place.rpartition("/")[0])
        with store.open_output_stream(place, compression=None) as fh:
            n = 0
            for pdf in batches:
                for url, html, broken in zip(pdf[url_col], pdf[html_col], pdf["_broken"]):
                    recs = []
                    if with_requests:
                        recs.append(("request", _record("request", url, b"GET / HTTP/1.1\r\n\r\n",
                                                        f"{pid}-{n}-q")))
                    rec = _record("response", url, _http_response(html or ""), f"{pid}-{n}-r")
                    if broken or broken_every and n % broken_every == broken_every - 1:
                        rec = rec.replace(b"Content-Length:", b"Content-Lenght:", 1)
                    recs.append(("response", rec))
                    for rec_type, raw in recs:
                        member = gzip.compress(raw)
                        offset = fh.tell()
                        fh.write(member)
                        rows.append((url, name, str(offset), str(len(member)), rec_type))
                    n += 1
        yield pd.DataFrame(rows, columns=["url", "filename", "offset", "length", "rec_type"])

    marked = F.coalesce(F.col(broken_col), F.lit(False)) if broken_col else F.lit(False)
    return pages.select(url_col, html_col, marked.alias("_broken")).mapInPandas(
        run, "url string, filename string, offset string, length string, rec_type string")


def _unchunk(body: bytes) -> bytes:
    """The bytes of a chunked HTTP body; ``ValueError`` where a chunk is cut short."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = end + 2
        if len(body) < at + size:
            raise ValueError("chunk cut short")
        out.append(body[at:at + size])
        at += size + 2


def _decode_body(http_head: bytes, body: bytes) -> bytes:
    """Undo the body's transfer and content encodings; unknown ones raise ``ValueError``.

    Crawls may store a body decoded under its original headers, so a body that does
    not begin like its encoding is taken as it is.
    """
    fields = {}
    for line in http_head.decode("latin-1").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip().lower()
    first_line = body.partition(b"\r\n")[0].split(b";")[0].strip()
    if "chunked" in fields.get("transfer-encoding", "") and first_line and not first_line.strip(b"0123456789abcdefABCDEF"):
        body = _unchunk(body)
    for coding in reversed([c.strip() for c in fields.get("content-encoding", "").split(",") if c.strip()]):
        if coding in ("gzip", "x-gzip"):
            body = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
        elif coding == "deflate":
            zlib_head = len(body) > 1 and body[0] & 15 == 8 and int.from_bytes(body[:2], "big") % 31 == 0
            body = zlib.decompress(body) if zlib_head else zlib.decompress(body, -zlib.MAX_WBITS)
        elif coding != "identity":
            raise ValueError(f"content encoding {coding!r}")
    return body


def _parse_record(raw: bytes):
    """``(rec_type, url, html)`` of one decompressed WARC record."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no header end")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    block = rest[:int(fields["content-length"])]
    rec_type = fields.get("warc-type")
    if rec_type != "response":
        return rec_type, None, None
    http_head, _, body = block.partition(b"\r\n\r\n")
    return rec_type, fields.get("warc-target-uri"), _decode_body(http_head, body).decode("utf-8", errors="ignore")


def fetch_records(plan: DataFrame) -> DataFrame:
    """Read each planned record ``(filename, start, end)`` -> ``(url, html, ..., error)``.

    Only ``response`` records produce pages; a failed record produces a row with
    ``error`` set and null ``url``/``html``.
    """
    def run(batches):
        for pdf in batches:
            out = []
            for fn, ranges in _adjacent(zip(pdf["filename"], pdf["start"], pdf["end"])):
                for start, member in _read_ranges(fn, ranges):
                    try:
                        if isinstance(member, Exception):
                            raise member
                        rec_type, url, html = _parse_record(gzip.decompress(member))
                        if rec_type == "response":
                            out.append((url, html, fn, int(start), None))
                    except Exception as e:  # noqa: BLE001 - counted, never fatal
                        out.append((None, None, fn, None if pd.isna(start) else int(start), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["url", "html", "filename", "offset", "error"])

    ordered = plan.select("filename", "start", "end").repartitionByRange("filename", "start")
    return ordered.sortWithinPartitions("filename", "start").mapInPandas(run, OUT_SCHEMA)


def _adjacent(plan):
    """``(filename, ranges)``: consecutive records that lie next to one another, ``READ_BYTES`` at most."""
    name, ranges = None, []
    for fn, start, end in plan:
        joins = ranges and fn == name and start == ranges[-1][1] + 1 and end - ranges[0][0] < READ_BYTES
        if not joins:
            if ranges:
                yield name, ranges
            name, ranges = fn, []
        ranges.append((start, end))
    if ranges:
        yield name, ranges


def _read_ranges(name: str, ranges: list[tuple]):
    """``(start, bytes or the error)`` of each range, by one read."""
    try:
        first, last = int(ranges[0][0]), int(ranges[-1][1])
        store, place = pafs.FileSystem.from_uri(name)
        with store.open_input_file(place) as fh:
            raw = fh.read_at(last - first + 1, first)
    except Exception as e:  # noqa: BLE001 - each record is reported
        yield from ((start, e) for start, _ in ranges)
        return
    for start, end in ranges:
        yield start, raw[int(start) - first:int(end) - first + 1]


def fetch_summary(fetched: DataFrame, planned: DataFrame) -> DataFrame:
    """One row: records planned, pages read, records skipped because of errors."""
    zero = F.lit(0).cast("bigint")
    p = planned.select(F.lit(1).cast("bigint").alias("_p"), zero.alias("_g"), zero.alias("_e"))
    f = fetched.select(zero.alias("_p"), F.col("url").isNotNull().cast("bigint").alias("_g"),
                       F.col("error").isNotNull().cast("bigint").alias("_e"))
    return p.unionByName(f).agg(F.coalesce(F.sum("_p"), zero).alias("planned"),
                                F.coalesce(F.sum("_g"), zero).alias("pages"),
                                F.coalesce(F.sum("_e"), zero).alias("skipped"))
