"""WARC archives: write records, index them first, then read selected records by coalesced byte ranges.

A record is one row of Spark's text writer, whose line separator is the two line ends that close a WARC record. So the
archives are committed like any other output of Spark, on any file system it can write, and a lost executor's files are
written anew. The index has file, offset, length, URL and digest of every record; reading sorts the chosen entries of a
file by offset and joins ranges that lie close together into one read.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._util import join_small, map_arrow, materialize, shared_dir

#: Payloads below this size are never revisits.
MIN_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
#: Entries with at most GAP bytes between them are read at once, up to READ bytes; tasks have stretches of up to STRETCH bytes.
GAP, READ, STRETCH = 1 << 16, 8 << 20, 64 << 20

_CRLF = "\r\n"
#: Fixed values of the WARC 1.1 format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "application/http; msgtype=response"

_INDEX = "file string, offset long, length long, record_type string, url string, digest string, page_id long, refers_to long"


def _name(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:"), F.coalesce(F.concat(F.lit("x-page:"), page_id.cast("string")), F.concat(F.lit("sha256:"), digest)), F.lit(">"))


def _line(key: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit(_CRLF)), F.lit(""))


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(value): the text of one record for every row of pages(page_id, url, html), without the closing line ends.

    Of rows with equal payloads of MIN_REVISIT bytes or more, those with the smallest page_id are responses, the others
    revisits of it; a null page_id counts as larger than any, and rows are all responses if all ids are null. A null
    html is an empty payload, a null url gives no target. Line ends in a url are percent-encoded.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    twins = rows.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    twins = materialize(twins.filter("n > 1 and original is not null").select("digest", "original"), "twins")
    rows = join_small(rows, twins, ["digest"])
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=UTF-8{_CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(_CRLF + _CRLF))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _name(F.col("page_id"), F.col("digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, _name(F.col("original"), F.col("digest")))),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        _line("Content-Type", F.lit(_HTTP)),
        _line("Content-Length", (F.octet_length(http) + F.octet_length(payload)).cast("string")),
        F.lit(_CRLF),
    )
    return rows.select(F.concat(head, http, payload).alias("value"))


def write(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write the records of pages as uncompressed WARC files under path, a file for each partition."""
    records(pages, date).write.option("lineSep", _CRLF * 2).text(path)


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(inner)


def parse(head: bytes) -> dict[str, str]:
    """The fields of a WARC or HTTP header by lower-case name; the first of equal names counts."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split(_CRLF)[1:]:
        key, sep, value = line.partition(":")
        if sep:
            out.setdefault(key.strip().lower(), value.strip(" \t"))
    return out


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def scan(f, size: int, chunk: int = READ):
    """(offset, length, fields) of each record of an open WARC file; payloads that the buffer lacks are skipped, not read."""
    at, base, buf = 0, 0, b""
    while at < size:
        while (end := buf.find(b"\r\n\r\n", at - base)) < 0:
            buf = buf[at - base :]
            base = at
            f.seek(base + len(buf))
            more = f.read(chunk)
            if not more:
                raise ValueError(f"a record without an end of its header at byte {at}")
            buf += more
        fields = parse(buf[at - base : end])
        length = end + 4 - (at - base) + int(fields["content-length"]) + 4
        yield at, length, fields
        at += length
        if at - base >= len(buf):
            base, buf = at, b""


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the WARC files under path: file, offset, length, record_type, url, digest, page_id, refers_to."""

    def run(batches):
        for b in batches:
            for file, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                with _open(file) as f:
                    for at, length, x in scan(f, size):
                        rows.append((file, at, length, x.get("warc-type"), x.get("warc-target-uri"), (x.get("warc-payload-digest") or "").removeprefix("sha256:") or None, _page(x.get("warc-record-id")), _page(x.get("warc-refers-to"))))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "length")
    return files.repartition(max(1, files.count())).transform(map_arrow, run, _INDEX)


_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)


def ranges(entries: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, int]]:
    """(first byte, byte after the last, number of entries) of the reads for (offset, length) sorted by offset."""
    out: list[tuple[int, int, int]] = []
    for at, length in entries:
        if out and at - out[-1][1] <= gap and at + length - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(out[-1][1], at + length), out[-1][2] + 1)
        else:
            out.append((at, at + length, 1))
    return out


def read(entries: DataFrame, gap: int = GAP, most: int = READ) -> DataFrame:
    """The chosen entries of an index with `payload` (binary, empty for revisits) and `http_length`, the length of the full payload.

    Repeated entries give repeated rows.
    """
    names = [x.split()[0] for x in _INDEX.split(", ")]

    def run(batches):
        for b in batches:
            rows, done = b.to_pylist(), 0
            while done < len(rows):
                file = rows[done]["file"]
                own = rows[done : next((i for i in range(done, len(rows)) if rows[i]["file"] != file), len(rows))]
                with _open(file) as f:
                    for lo, hi, n in ranges([(r["offset"], r["length"]) for r in own], gap, most):
                        f.seek(lo)
                        data, part, out = f.read(hi - lo), rows[done : done + n], []
                        for r in part:
                            record = data[r["offset"] - lo : r["offset"] - lo + r["length"] - 4]
                            block = record[record.index(b"\r\n\r\n") + 4 :]
                            cut = block.index(b"\r\n\r\n")
                            out.append((int(parse(block[:cut])["content-length"]), block[cut + 4 :]))
                        done += n
                        cols = [pa.array([r[k] for r in part], kind) for k, kind in zip(names, _KINDS, strict=True)]
                        yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], [*names, "http_length", "payload"])

    chosen = entries.select(*names, F.expr(f"offset div {STRETCH}").alias("_stretch"))
    dealt = chosen.repartition("file", "_stretch").sortWithinPartitions("file", "offset").drop("_stretch")
    return dealt.transform(map_arrow, run, f"{_INDEX}, http_length long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every page, from archives that this writes and reads back.

    Size and digest of a response come from the payload read; a revisit states those of the payload it stands for.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom/{uuid.uuid4().hex}/warc"
    write(pages, path)
    back = read(materialize(index(spark, path), "index"))
    new = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(new, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(new, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        "url",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every page through the archives."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), m AS (
  SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN m.original IS NOT NULL AND p.page_id IS DISTINCT FROM m.original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.original IS NOT NULL AND p.page_id IS DISTINCT FROM m.original THEN m.original END AS refers_to,
  replace(replace(p.url, chr(13), '%0D'), chr(10), '%0A') AS url
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND p.payload_bytes >= 100
"""
