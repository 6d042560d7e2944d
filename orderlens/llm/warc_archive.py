"""Content-addressed WARC archive.

``write_archive`` stores every distinct payload once under its SHA-256 and keeps the exact
record headers in a table of their own. ``read_archive`` recomputes each stored payload's digest and
length and fails on a difference; ``records`` joins headers and payloads to the original record
bytes. ``write_warc`` puts such records into .warc files and ``read_warc`` reads them back.

Of records with equal payloads of at least REVISIT bytes, the one with the smallest page_id is a
response and the others are revisits that name it; smaller payloads are all responses. A
revisit record has no block in the file; its payload is found by its digest.

Defined cases: a null html is the empty payload. A null url gives a record without target URI.
Rows that repeat a page_id each get a record; among equal payloads all rows of the smallest page_id
are responses. A null page_id comes last among equals. An empty table gives an empty archive.
Other columns are ignored. Line breaks in a url are percent-encoded, since a header ends there.
"""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from orderlens.llm.support import checked_broadcast, materialize

REVISIT = 100
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
EOL = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _id(page):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def _facts(pages):
    """(page_id, url, payload, digest, length) of ``pages`` (page_id, url, html)."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    return rows.withColumn("digest", F.sha2("payload", 256)).withColumn(
        "length", F.octet_length("payload").cast("long")
    )


def _headers(facts, date, revisit):
    """(page_id, digest, header) for rows with ``first``, the smallest page_id of equal payloads."""
    seen = F.expr(f"length >= {revisit} AND first IS NOT NULL AND NOT (page_id <=> first)")
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    nothing = F.lit("")
    header = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "),
        F.when(seen, "revisit").otherwise("response"),
        F.lit(f"{EOL}WARC-Record-ID: "),
        _id(F.col("page_id")),
        F.lit(f"{EOL}WARC-Date: {date}"),
        F.coalesce(F.concat(F.lit(f"{EOL}WARC-Target-URI: "), url), nothing),
        F.lit(f"{EOL}WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(
            seen,
            F.concat(F.lit(f"{EOL}WARC-Profile: {PROFILE}{EOL}WARC-Refers-To: "), _id(F.col("first"))),
        ).otherwise(nothing),
        F.lit(f"{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
        F.when(seen, "0").otherwise(F.col("length").cast("string")),
        F.lit(EOL + EOL),
    )
    return facts.select("page_id", "digest", F.encode(header, "UTF-8").alias("header"))


def write_archive(pages, folder, date=DATE, revisit=REVISIT):
    """Write ``folder``/headers and ``folder``/payloads from ``pages`` (page_id, url, html).

    Equal payloads meet as digests only. The digests of more than one page are written, so that
    the join with a very common one can be split. A payload is stored by the first page that
    has it; pages that come later are left out by their ids before any payload moves.
    """
    facts = _facts(pages)
    small = materialize(facts.drop("payload"), "facts")
    groups = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times"))
    common = materialize(groups.where("times > 1").select("digest", "first"), "common")
    joined = materialize(small.join(common, "digest", "left"), "joined")
    joined = joined.withColumn("first", F.coalesce("first", "page_id"))
    _headers(joined, date, revisit).write.parquet(f"{folder}/headers")
    later = joined.where("NOT (page_id <=> first)").select("page_id", "digest").distinct()
    later = checked_broadcast(materialize(later, "later").withColumnsRenamed({"page_id": "p", "digest": "d"}))
    first = facts.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left_anti")
    # rows that repeat a page_id with the same payload are stored again; readers take one
    first.select("digest", "payload").write.parquet(f"{folder}/payloads")


def read_archive(spark, folder):
    """(headers, payloads) of a written archive; every payload is verified against its digest."""
    headers = spark.read.schema("page_id long, digest string, header binary").parquet(f"{folder}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    found = F.sha2("payload", 256)
    wrong = F.raise_error(F.concat(F.lit("payload stored under another digest: "), F.col("digest")))
    length = F.octet_length("payload").cast("long")
    checked = F.when(found == F.col("digest"), length).otherwise(wrong.cast("long"))
    return headers, payloads.select("digest", "payload", checked.alias("payload_bytes"))


def _field(name):
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def parsed(headers):
    """Fields of the headers: page_id, record_type, payload_digest, refers_to, content_length."""
    number = r"page:(\d+|-\d+)>"
    return headers.select(
        F.regexp_extract(_field("WARC-Record-ID"), number, 1).try_cast("long").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha256:([0-9a-f]{64})", 1).alias("payload_digest"),
        F.regexp_extract(_field("WARC-Refers-To"), number, 1).try_cast("long").alias("refers_to"),
        _field("Content-Length").cast("long").alias("content_length"),
        "header",
    )


def page_records(headers, payloads):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read back from an archive.

    Every header is joined with its verified payload by digest; a header without one fails.
    """
    stored = materialize(payloads.select(F.col("digest").alias("stored"), "payload_bytes").distinct(), "stored")
    rows = parsed(headers).join(stored, F.col("payload_digest") == F.col("stored"), "left")
    lost = F.raise_error(F.concat(F.lit("no payload for digest "), F.col("payload_digest"))).cast("long")
    return rows.select(
        "page_id",
        F.when(F.col("stored").isNotNull(), F.col("payload_bytes")).otherwise(lost).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


def records(headers, payloads):
    """(page_id, record): the original record bytes, put together by a join on the digest."""
    rows = headers.join(payloads.select("digest", "payload").dropDuplicates(["digest"]), "digest")
    revisit = F.instr(F.decode("header", "UTF-8"), f"{EOL}WARC-Type: revisit{EOL}") > 0
    block = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return rows.select("page_id", F.concat("header", block, F.lit((EOL + EOL).encode())).alias("record"))


def write_warc(rows, folder, file_bytes=FILE_BYTES):
    """Write records (page_id, record) as WARC files of about ``file_bytes`` each.

    The text sink writes each record's characters and then the two line ends that close it.
    """
    end = len(EOL + EOL)
    rows = rows.select(F.expr(f"substring(decode(record, 'UTF-8'), 1, char_length(decode(record, 'UTF-8')) - {end})").alias("value"))
    total = rows.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    rows.repartition(1 + total // file_bytes).write.option("lineSep", EOL + EOL).text(folder)


def _split(batches):
    for batch in batches:
        for content in batch.column("content").to_pylist():
            at, out = 0, []
            while at < len(content):
                body = content.index(b"\r\n\r\n", at) + 4
                length = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", content[at:body]).group(1))
                if content[body + length : body + length + 4] != b"\r\n\r\n":
                    raise ValueError("a record does not end where its header says")
                out.append((content[at:body], content[body : body + length]))
                at = body + length + 4
                if len(out) == 256 or at >= len(content):
                    yield pa.RecordBatch.from_pydict(
                        {"header": [h for h, _ in out], "payload": [p for _, p in out]},
                        pa.schema([("header", pa.binary()), ("payload", pa.binary())]),
                    )
                    out = []


def read_warc(spark, folder):
    """(header, payload) of every record of the WARC files in ``folder``, by content length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(_split, "header binary, payload binary")
