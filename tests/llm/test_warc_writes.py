"""Several writes of one archive."""

from riskledger.llm import warc as W


def test_archives_are_appended_to_and_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    pages = lambda *ids: spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 30) for i in ids], "page_id long, url string, html string")
    read = lambda: sorted(r.page_id for r in W.page_records(spark, path).collect())
    W.archive(pages(1), path)
    W.archive(pages(2, 3), path, gzip="true")
    assert read() == [1, 2, 3]
    (tmp_path / "archive" / "part-left.warc").write_bytes(W.record({"warc_type": "response", "record_id": "<urn:x-page:9>", "target_uri": None, "refers_to": None, "payload_digest": "sha256:0", "http_length": 1, "payload": b"x"}, "2000-01-01T00:00:00Z"))
    assert read() == [1, 2, 3]  # a failed task's file
    W.archive(pages(4), path, mode="overwrite")
    assert read() == [4]
    W.archive(pages(5), path)
    assert read() == [4, 5]
    W.archive(pages(), path, mode="overwrite")
    assert read() == []


def test_stores_are_named_as_spark_names_them():
    kinds = [type(W.filesystem(p)[0]).__name__ for p in ("s3a://bucket/x?region=us-east-1", "file:///tmp/x", "/tmp/x")]
    assert kinds == ["S3FileSystem", "LocalFileSystem", "LocalFileSystem"]
