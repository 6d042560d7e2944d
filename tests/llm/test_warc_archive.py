import hashlib

import pytest

from orderlens.llm import warc_archive as W
from orderlens.scratch import scratch_path

BIG = "<p>ü" + "x" * 200


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(3, "http://a", BIG), (1, "http://b\r\nX: y", BIG), (2, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", "WARC/1.1\r\n\r\n" + "y" * 300000), (7, "u", BIG), (7, "u", BIG), (None, "u", BIG)]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")


@pytest.fixture(scope="module")
def archive(spark, pages):
    folder = scratch_path(spark, "warc")
    W.write_archive(pages, folder)
    return folder


def test_records(spark, pages, archive):
    got = sorted(map(tuple, W.page_records(*W.read_archive(spark, archive)).collect()), key=str)
    want = []
    for r in pages.collect():
        data = (r.html or "").encode()
        again = len(data) >= 100 and r.html == BIG and r.page_id != 1
        want.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)


def test_payloads_are_stored_once(spark, archive):
    digests = [r.digest for r in W.read_archive(spark, archive)[1].collect()]
    assert len(digests) == len(set(digests)) == 4


def test_files_round_trip(spark, archive):
    headers, payloads = W.read_archive(spark, archive)
    rows = W.records(headers, payloads)
    folder = scratch_path(spark, "files")
    W.write_warc(rows, folder, 1 << 18)
    back = {bytes(r.header) + bytes(r.payload) + b"\r\n\r\n\r\n\r\n"[:4] for r in W.read_warc(spark, folder).collect()}
    assert back == {bytes(r.record) for r in rows.collect()}


def test_changed_payload_is_noticed(spark, archive):
    folder = scratch_path(spark, "changed")
    headers, payloads = W.read_archive(spark, archive)
    headers.write.parquet(f"{folder}/headers")
    payloads.selectExpr("digest", "CASE WHEN payload_bytes = 5 THEN cast('other' AS binary) ELSE payload END AS payload").write.parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="another digest"):
        W.page_records(*W.read_archive(spark, folder)).collect()


def test_empty_table(spark, pages):
    folder = scratch_path(spark, "none")
    W.write_archive(pages.limit(0), folder)
    assert W.page_records(*W.read_archive(spark, folder)).count() == 0
