"""Web archives: a deterministic sharded WARC writer, and a reader that checks digests.

Pages are sorted over ranges of page_id and each range is written by one task as gzipped records into files that
roll at a compressed size.  Range bounds come from the rows whose hash is small (a sample that is the same in every
run) and the numbers of shards and bytes from the table, so the same pages give the same files byte for byte.  A
task writes under temporary names; the list of what the successful attempts wrote is stored by Spark, the files
named in it get their final names, and only then the manifest appears.  Readers take the files that it names.

Of equal payloads of ``least`` bytes or more the one with the largest page_id is written as response, the others
as revisit records without payload.  Which rows are revisits is found on (page_id, digest, size) alone, digests
dealt out by page as well, so that a payload that a third of all pages have is not one task's; these small rows
then meet their pages in the sort that writes them, so payloads are shuffled once.

Odd rows: a null payload is empty; a null page_id is less than any other and its records have none; of rows that
repeat page_id and payload one is the response and the others refer to it; an url that is null is written as
``urn:page:<page_id>``, and blanks, control and other non-ASCII characters of one in percent form.  No pages: no
files and an empty manifest.  All rows of one page_id are written by one task, as a stream.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import os
import shutil
import string
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import blocks

MANIFEST = "file string, written string, records long, bytes long, first_page long, last_page long"
RECORDS = "page_id long, record_id string, record_type string, url string, date string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Shares of a repeated payload's pages; samples for each range bound; shards from which they grow with the table.
SHARES, SAMPLES, MOST_SHARDS = 64, 40, 10_000
BATCH_BYTES = 8 << 20


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _record_id(page: int | None, copy: int, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page}:{copy}:{digest.hex()}'.encode()).digest()[:16])}>"


def _target(page: int | None, url: bytes | None) -> str:
    return f"urn:page:{page}" if url is None else quote(url, safe=string.punctuation)


def record(kind: str, fields: Iterable[tuple[str, object]], block: bytes, level: int = 6) -> bytes:
    """A WARC record as a gzip member of its own, with the block's length and digest; the same bytes in every run."""
    head = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())), ("Content-Length", len(block))]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head if v is not None) + b"\r\n" + block + b"\r\n\r\n"
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packed.compress(raw) + packed.flush()


def page_record(page: int | None, url: bytes | None, payload: bytes, date: str, copy: int = 0, response: tuple[int | None] | None = None) -> bytes:
    """A response record; or a revisit record, where the page of the response with the same payload is given."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Record-ID", _record_id(page, copy, digest)), ("WARC-Date", date), ("WARC-Target-URI", _target(page, url)), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", _base32(digest)), ("Page-ID", page),
    ]
    if response is None:
        return record("response", fields, http + payload)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(response[0], 0, digest)), ("Refers-To-Page-ID", response[0])]
    return record("revisit", fields, http)


class Roll:
    """Files of a shard: a new one begins when the last one has reached its size."""

    def __init__(self, folder: str, shard: int, file_bytes: int, date: str):
        self.folder, self.shard, self.most, self.date = folder, shard, file_bytes, date
        self.rows, self.file = [], None

    def write(self, page: int | None, packed: bytes) -> None:
        if self.file is None:
            name = f"{self.shard:06d}-{len(self.rows):05d}.warc.gz"
            self.file = blocks.Appender(f"{self.folder}/tmp")
            info = record("warcinfo", [("WARC-Record-ID", _record_id(self.shard, len(self.rows), b"")), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            self.file.write(info)
            self.row = [name, f"tmp/{self.file.number:016x}", 0, len(info), page, page]
        self.file.write(packed)
        self.row[2:4] = self.row[2] + 1, self.row[3] + len(packed)
        self.row[5] = page
        if self.row[3] >= self.most:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.rows.append(self.row)
            self.file = None


def _rows(rows: list, ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in ddl.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def revisits(small: DataFrame) -> DataFrame:
    """(page_id, key, leader) of the rows whose payload others have as well; small: page_id, key, size."""
    keyed = small.filter("key is not null").select("page_id", "key", F.pmod(F.xxhash64("page_id"), F.lit(SHARES)).alias("share"))
    shares = keyed.groupBy("key", "share").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    tops = shares.groupBy("key").agg(F.max("top").alias("leader"), F.sum("n").alias("n")).filter("n > 1")
    return keyed.join(shares.select("key", "share").join(tops.select("key", "leader"), "key"), ["key", "share"]).select("page_id", "key", "leader")


def bounds(small: DataFrame, shard_bytes: int) -> tuple[list[int], int]:
    """Page ids at which shards begin (but the first), and the bytes of a shard, which grow with very large tables.

    Ids whose hash is small stand for all, about SAMPLES of them for each shard.
    """
    n, total = small.agg(F.count("*"), F.sum(F.col("size") + 512)).first()
    each = max(shard_bytes, math.ceil((total or 0) / MOST_SHARDS))
    shards = math.ceil((total or 0) / each)
    if shards < 2:
        return [], each
    few = small.filter(F.pmod(F.xxhash64("page_id"), F.lit(1 << 40)) < int(min(1.0, SAMPLES * shards / n) * (1 << 40)))
    ids = few.groupBy("page_id").agg(F.sum("size").alias("size")).filter("page_id is not null").orderBy("page_id").collect()  # SAMPLES for a shard
    if not ids:
        return [], each
    upto = np.cumsum([r["size"] + 512 for r in ids])
    cuts = np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards)
    return sorted({ids[i].page_id for i in cuts.tolist()}), each


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", least: int = 1000, shard_bytes: int = 32 << 20, file_bytes: int | None = None) -> DataFrame:
    """Write (page_id, url, html) as gzipped WARC files into a folder and return the manifest: file, records, bytes, first and last page.

    ``date`` is what records say of their time.  A shard has about ``shard_bytes`` of payload; files roll at
    ``file_bytes`` of compressed records (an eighth of a shard's payload unless given, 1 MB at least).
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("binary").alias("url"), payload.alias("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    own = own.withColumn("key", F.when(F.col("size") >= least, F.unhex(F.sha2("payload", 256))))
    with blocks.shuffles_dropped(spark):
        small = blocks.written(own.select("page_id", "key", "size"), f"{folder}/plan")
        cuts, each = bounds(small, shard_bytes)
        roll = file_bytes or max(each // 8, 1 << 20)
        first = np.array(cuts, np.int64)

        @F.pandas_udf("int")
        def shard_of(page: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(first, page.to_numpy(), side="right").astype(np.int32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, flag, last, copy = Roll(folder, TaskContext.get().partitionId(), roll, date), None, None, 0
            for batch in batches:
                for page, key, kind, leader, url, body in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    if not kind:
                        flag = (page, key), leader
                        continue
                    copy = copy + 1 if last == (page, key) else 0
                    last = page, key
                    again = flag is not None and key is not None and flag[0] == last and (copy > 0 or flag[1] != page)
                    out.write(page, page_record(page, url, body, date, copy, (flag[1],) if again else None))
            out.close()
            yield _rows(out.rows, MANIFEST)

        none = [F.lit(None).cast(k).alias(c) for c, k in (("url", "binary"), ("payload", "binary"))]
        flags = revisits(small).select("page_id", "key", F.lit(0).alias("kind"), "leader", *none)
        rows = flags.union(own.select("page_id", "key", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("leader"), "url", "payload"))
        dealt = rows.withColumn("shard", shard_of(F.coalesce("page_id", F.lit(-(1 << 63))))) if cuts else rows.withColumn("shard", F.lit(0))
        dealt = dealt.repartitionById(len(cuts) + 1, "shard").drop("shard").sortWithinPartitions("page_id", "key", "kind", "url", "payload")
        listed = blocks.written(dealt.mapInArrow(run, MANIFEST), f"{folder}/written")
        done = blocks.written(_published(listed, folder).drop("written"), f"{folder}/manifest")
    _removed(f"{folder}/tmp")
    return done


def _published(listed: DataFrame, folder: str) -> DataFrame:
    """The listed files under their final names; one that an earlier attempt has moved already stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, written, size in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                _move(f"{folder}/{written}", f"{folder}/{name}", size)
            yield batch

    return listed.repartition(blocks.shards(listed.sparkSession), "file").mapInArrow(run, listed.schema)


def _move(source: str, target: str, size: int) -> None:
    if path := blocks._local(source):
        to = blocks._local(target)
        if os.path.exists(path):
            os.replace(path, to)
        if os.path.getsize(to) != size:
            raise OSError(f"{to} has not {size} bytes")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(source)
    to = fs.FileSystem.from_uri(target)[1]
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.move(path, to)
    if store.get_file_info(to).size != size:
        raise OSError(f"{to} has not {size} bytes")


def _removed(uri: str) -> None:
    """What attempts that were lost have left under temporary names goes."""
    if path := blocks._local(uri):
        shutil.rmtree(path, ignore_errors=True)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_dir(path)


def _opened(uri: str):
    if path := blocks._local(uri):
        return open(path, "rb")  # noqa: SIM115 - closed by the reader
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC stream, block digests checked."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        digest = _base32(hashlib.sha1(block).digest())
        if len(block) != size or fields.get("warc-block-digest", digest) != digest:
            raise ValueError(f"{fields.get('warc-record-id')} is cut or changed")
        yield fields, block


def _read(fields: dict[str, str], block: bytes, file: str, with_payload: bool) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    page, to = fields.get("page-id"), fields.get("refers-to-page-id")
    http = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    size = int(http["Content-Length"])
    if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is cut or changed")
    kept = payload if with_payload and fields["warc-type"] == "response" else None
    return (None if page is None else int(page), fields["warc-record-id"], fields["warc-type"], fields["warc-target-uri"], fields["warc-date"], size, digest.hex(), None if to is None else int(to), kept, file)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The response and revisit records of the files that a folder's manifest names, block and payload digests checked.

    page_id, record_id, record_type, url, date, payload_bytes and payload_digest (of the full payload, hex), refers_to
    (a revisit's response), payload (null unless asked for, and for revisits), file.  A file is read as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with _opened(f"{folder}/{name}") as f, gzip.GzipFile(fileobj=f) as g:
                    for fields, block in records(g):
                        if fields["warc-type"] in ("response", "revisit"):
                            rows.append(_read(fields, block, name, with_payload))
                            size += 500 + len(rows[-1][-2] or b"")
                        if size > BATCH_BYTES:
                            yield _rows(rows, RECORDS)
                            rows, size = [], 0
                yield _rows(rows, RECORDS)

    files = spark.read.schema("file string").parquet(f"{folder}/manifest").select("file")
    n = max(1, min(files.count(), 20_000))
    return files.repartition(n).mapInArrow(run, RECORDS)
