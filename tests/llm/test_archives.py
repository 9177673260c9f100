"""Web archives there and back, byte for byte, and with odd rows."""

import gzip
import hashlib
import io
import os

import pytest
from pyspark.sql import functions as F

from tessera.llm import archives
from tessera.llm.archives import read_archives, write_archives

BIG, OTHER = "<p>" + "a" * 1200, "<p>" + "é" * 700


def plain(rows):
    """What becomes of (page_id, url, html) rows."""
    top, seen, out = {}, set(), []
    for page, _, html in rows:
        b = (html or "").encode()
        top[b] = max(top.get(b, (False, 0)), (page is not None, page or 0))
    for page, _, html in rows:
        b = (html or "").encode()
        digest, leader = hashlib.sha1(b).hexdigest(), top[b][1] if top[b][0] else None
        first = page == leader and b not in seen
        seen |= {b} if page == leader else set()
        again = len(b) >= 1000 and not first
        out.append((page, len(b), digest, "revisit" if again else "response", leader if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def files(folder):
    folder = folder.removeprefix("file://")
    return {f: open(f"{folder}/{f}", "rb").read() for f in sorted(os.listdir(folder)) if f.endswith(".warc.gz")}


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


ROWS = [
    (1, "http://a/x", BIG), (5, "http://a/y z\r\nWARC-Type: fake", BIG), (3, None, BIG), (2, "http://ä/", OTHER), (9, "http://b", None), (8, "", ""), (7, "http://b", "short"), (6, "http://c", "short"),
    (5, "http://again", BIG), (5, "http://again", BIG), (None, None, OTHER), (None, "http://n", "n" * 1000), (None, None, "n" * 1000), (4, "http://u", "WARC/1.1\r\n\r\n" * 200), (4, "http://u", "y" * 999), (4, "http://u", "y" * 999),
]


def test_odd_rows(spark, tmp_path):
    pages = frame(spark, ROWS).withColumns({c: F.lit(1) for c in ("key", "kind", "size", "shard", "payload", "leader")})
    manifest = write_archives(pages, f"file://{tmp_path}/w")
    read = read_archives(spark, f"file://{tmp_path}/w", with_payload=True).cache()
    assert got(read) == plain(ROWS)
    assert manifest.agg(F.sum("records")).first()[0] == len(ROWS) == read.select("record_id").distinct().count()
    texts = {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h in ROWS}
    assert all(bytes(r.payload) == texts[r.payload_digest] if r.record_type == "response" else r.payload is None for r in read.collect())
    assert {r.url for r in read.filter("page_id = 5").collect()} == {"http://a/y%20z%0D%0AWARC-Type:%20fake", "http://again"}
    assert not os.path.exists(f"{tmp_path}/w/tmp")


def test_payloads_come_back(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html>{i % 7}é{'z' * (i % 7) * 300}</html>") for i in range(200)]
    write_archives(frame(spark, rows), f"file://{tmp_path}/w", shard_bytes=20_000, file_bytes=4_000)
    read = read_archives(spark, f"file://{tmp_path}/w", with_payload=True).cache()
    assert got(read) == plain(rows)
    payload = {r.page_id: bytes(r.payload).decode() for r in read.collect() if r.payload is not None}
    for r in read.collect():
        assert payload[r.refers_to if r.record_type == "revisit" else r.page_id] == rows[r.page_id][2]
    ids = {r.page_id: r.record_id for r in read.collect()}
    for data in files(f"{tmp_path}/w").values():  # a revisit names its response's record
        for fields, _ in archives.records(io.BytesIO(gzip.decompress(data))):
            if fields["warc-type"] == "revisit":
                assert fields["warc-refers-to"] == ids[int(fields["refers-to-page-id"])]


def test_files_roll_in_order_and_are_the_same_in_every_run(spark, tmp_path):
    rows = [(i * 37 % 1009, f"http://h/{i}", hashlib.sha256(str(i // 2).encode()).hexdigest() * 40) for i in range(1009)]
    made = []
    for name, parts in (("a", 2), ("b", 7)):
        manifest = write_archives(frame(spark, rows).repartition(parts), f"file://{tmp_path}/{name}", shard_bytes=200_000, file_bytes=10_000).orderBy("file").collect()
        assert len({r.file[:6] for r in manifest}) > 5 and len(manifest) > 20
        assert all(a.last_page <= b.first_page for a, b in zip(manifest, manifest[1:], strict=False))
        assert all(r.bytes < 20_000 for r in manifest)
        made.append(files(f"{tmp_path}/{name}"))
        assert {r.file: r.bytes for r in manifest} == {f: len(x) for f, x in made[-1].items()}
    assert made[0] == made[1]
    data = next(iter(made[0].values()))
    kinds = [f["warc-type"] for f, _ in archives.records(io.BytesIO(gzip.decompress(data)))]
    assert kinds[0] == "warcinfo" and set(kinds[1:]) <= {"response", "revisit"}


def test_changed_archives_are_refused(spark, tmp_path):
    block = archives.page_record(1, b"http://x", b"payload", "1970-01-01T00:00:00Z")
    raw = gzip.decompress(block)
    (fields, body), *_ = archives.records(io.BytesIO(raw))
    assert archives._read(fields, body, "f", True)[8] == b"payload"
    with pytest.raises(ValueError, match="cut or changed"):
        list(archives.records(io.BytesIO(raw.replace(b"payload\r\n", b"Payload\r\n"))))
    with pytest.raises(ValueError, match="cut or changed"):
        list(archives.records(io.BytesIO(raw[:-10])))


def test_moving_twice_and_no_pages(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"12345")
    for _ in range(2):
        archives._move(f"file://{tmp_path}/a", f"file://{tmp_path}/b", 5)
    with pytest.raises(OSError, match="has not 6"):
        archives._move(f"file://{tmp_path}/a", f"file://{tmp_path}/b", 6)
    assert write_archives(frame(spark, []), f"file://{tmp_path}/w").count() == 0
    assert got(read_archives(spark, f"file://{tmp_path}/w")) == []
