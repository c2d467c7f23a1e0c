"""Operator 7, WARC archives as a Spark data source.

spark.read.format("warc") plans one partition per archive file, takes filters on the
record type and other header columns, parses a record's header first, and passes
over the payload of records that the filters or the option payload=false leave
out: by seeking in plain files, without keeping it in compressed ones. Writing is
done in Arrow batches; a manifest names the files of the tasks that were
committed, so that files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from riskledger.llm._common import cut, lookup, scratch, table

#: Columns, in order, and the WARC header fields behind those that have one.
READ_SCHEMA = "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, content_length long, http_length long, headers map<string,string>, payload binary"
WRITE_COLUMNS = ["warc_type", "record_id", "target_uri", "refers_to", "payload_digest", "http_length", "payload"]
FIELDS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Each write of an archive leaves one manifest, _manifest-<id>.json: its files, and the manifests that it replaces.
MANIFEST = "_manifest"
BATCH_BYTES = 4 << 20


def filesystem(path: str):
    """File system and path of a URI or plain path."""
    from pyarrow import fs

    path = re.sub("^s3[an]://", "s3://", path)
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def manifests(files, root: str) -> dict[str, dict]:
    """The manifests of an archive that no other replaces, by name."""
    from pyarrow import fs

    found = {}
    for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(MANIFEST) and info.base_name.endswith(".json"):
            with files.open_input_stream(info.path) as f:
                found[info.base_name] = json.loads(f.read())
    gone = {name for m in found.values() for name in m["replaces"]}
    return {name: m for name, m in found.items() if name not in gone}


def record(row: dict, date: str) -> bytes:
    """One WARC/1.1 record; the block is an HTTP response, for revisits its header alone."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['http_length']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {date}"]
    if row["target_uri"]:
        lines.append("WARC-Target-URI: " + quote(row["target_uri"], safe=":/?#[]@!$&'()*+,;=%~"))
    if row["payload_digest"]:
        lines.append(f"WARC-Payload-Digest: {row['payload_digest']}")
    if row["warc_type"] == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {row['refers_to']}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def header_of(stream) -> dict[str, str] | None:
    """Fields of the next record's header, names in lower case; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts here: {line[:40]!r}")
    fields: dict[str, str] = {}
    name = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:
            fields[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def skip(stream, n: int, seekable: bool) -> None:
    if seekable:
        stream.seek(n, io.SEEK_CUR)
    else:
        while n > 0 and (got := len(stream.read(min(n, 1 << 20)))):
            n -= got


@dataclass
class File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.want_payload = options["path"], options.get("payload", "true").lower() != "false"
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, IsNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[File]:
        from pyarrow import fs

        files, root = filesystem(self.path)
        scheme = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        if files.get_file_info(root).type == fs.FileType.File:
            return [File(self.path)]
        if found := manifests(files, root):
            return [File(f"{scheme}{root}/{name}") for _, m in sorted(found.items()) for name in m["files"]]
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        return [File(scheme + x.path) for x in found if x.path.endswith((".warc", ".warc.gz"))]

    def wanted(self, fields: dict[str, str]) -> bool:
        for f in self.tests:
            value = fields.get(FIELDS[f.attribute[0]])
            if isinstance(f, IsNull):
                ok = value is None
            elif isinstance(f, IsNotNull):
                ok = value is not None
            elif isinstance(f, EqualTo):
                ok = value == f.value
            elif isinstance(f, In):
                ok = value in f.value
            else:
                ok = value is not None and value.startswith(f.value)
            if not ok:
                return False
        return True

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        files, path = filesystem(partition.path)
        raw = io.BufferedReader(files.open_input_file(path), 1 << 20)
        plain = not path.endswith(".gz")
        stream = raw if plain else io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)
        rows, held = [], 0
        while (fields := header_of(stream)) is not None:
            length = int(fields.get("content-length", 0))
            if not self.wanted(fields):
                skip(stream, length, plain)
                continue
            is_http, http_length, left, block = fields.get("content-type", "").startswith("application/http"), None, length, None
            if is_http:
                while left > 0 and (line := stream.readline(left)):
                    left -= len(line)
                    if line in (b"\r\n", b"\n"):
                        break
                    name, _, value = line.partition(b":")
                    if name.strip().lower() == b"content-length" and value.strip().isdigit():
                        http_length = int(value)
            if self.want_payload and fields.get("warc-type") != "revisit":
                block = stream.read(left)
                held += left
            else:
                skip(stream, left, plain)
            rows.append([*(fields.get(x) for x in FIELDS.values()), length, http_length, list(fields.items()), block])
            if held >= BATCH_BYTES or len(rows) >= 5000:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[list]) -> pa.RecordBatch:
        kinds = [*[pa.string()] * len(FIELDS), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [*FIELDS, "content_length", "http_length", "headers", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.overwrite = overwrite
        self.path, self.gzip = options["path"], options.get("gzip", "false").lower() == "true"
        self.date, self.most = options.get("date", "1970-01-01T00:00:00Z"), int(options.get("filebytes", 1 << 30))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                data = record(row, self.date)
                data = gzip.compress(data, 1) if self.gzip else data
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out, size = io.BufferedWriter(files.open_output_stream(f"{root}/{names[-1]}", compression=None), 1 << 20), 0
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        old = manifests(files, root) if self.overwrite else {}
        mine = {"files": sorted(n for m in messages if m is not None for n in m.files), "replaces": sorted(old)}
        with files.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(mine).encode())
        for name in [*old, *(n for m in old.values() for n in m["files"])]:  # nobody reads these any more
            files.delete_file(f"{root}/{name}")

    def abort(self, messages) -> None:
        files, root = filesystem(self.path)
        for m in messages:
            for name in m.files if m is not None else []:
                files.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Options: path; reading: payload; writing: gzip, date, filebytes. Writes append to what the path has, or replace it
    with mode overwrite; either way readers see a write whole or not at all."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, *, least_bytes: int = 100, mode: str = "append", **options) -> None:
    """Write one record per row of pages (page_id, url, html; other columns are not read), beside what
    the path has or, with mode overwrite, in its place.

    Payloads are the html in UTF-8 (null: empty). Among rows with equal payloads of at
    least least_bytes, those with the smallest page_id are responses (so are repeated rows of
    it) and all others revisit it; rows with a null page_id refer to nothing and are responses, as
    are all smaller payloads. A null url gives a record without a target. An empty table gives an empty archive.
    """
    register(pages.sparkSession)
    text = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), text.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    big = pages.filter((F.length("payload") >= least_bytes) & F.col("page_id").isNotNull())
    firsts = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = lookup(pages, cut(firsts, "warc-firsts"), "digest", "n")
    urn = lambda c: F.format_string("<urn:x-page:%s>", F.coalesce(F.col(c).cast("string"), F.lit("")))
    revisit = (F.col("first") < F.col("page_id")) & (F.length("payload") >= least_bytes)
    rows = rows.withColumn("__revisit", F.coalesce(revisit, F.lit(False)))
    rows.select(
        F.when(F.col("__revisit"), "revisit").otherwise("response").alias("warc_type"), urn("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.when(F.col("__revisit"), urn("first")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.length("payload").cast("long").alias("http_length"), F.when(~F.col("__revisit"), F.col("payload")).alias("payload"),
    ).write.format("warc").mode(mode).options(**options).save(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of archive's files: for responses size and digest of the payload itself."""
    register(spark)
    got = spark.read.format("warc").load(path).filter(F.col("warc_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, r"<urn:x-page:(-?\d+)>", 1).try_cast("long")
    response = F.col("warc_type") == "response"
    return got.select(
        page("record_id").alias("page_id"), F.when(response, F.length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace("payload_digest", "^sha256:", "")).alias("payload_digest"), F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to"), "target_uri",
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    archive(table(spark, sf_dir, "pages"), path)
    return page_records(spark, path).drop("target_uri")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE size >= 100 GROUP BY digest)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN size >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 100 AND first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""
