"""WARC archives: exact round trips, archives of other writers, pushed filters, skipped bodies."""

import base64
import gzip
import hashlib
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from vectide.llm import warc

SCHEMA = "page_id long, url string, html string, id long, record_type string, holder long, payload binary"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", 6, b"y") for r in rows], SCHEMA)


def pages():
    rnd = random.Random(3)
    texts = ["", None, "<p>é日本</p>", "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n", "long " * 400_000, "x"]
    rows = [(i, f"http://a/{i}\r\nEvil: 1" if i % 7 == 0 else None if i % 11 == 0 else f"http://é/{i}", rnd.choice(texts))
            for i in range(150)]
    return rows + [(1000 + i, "http://b", f"page {i}") for i in range(50)] + [(1000, "http://c", "page 0")]


def brute(rows, least=0):
    most = {}
    for i, _, html in rows:
        most[html or ""] = max(most.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        held = most[html or ""]
        revisit = held != i and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", held if revisit else None))
    return sorted(out)


def test_round_trip_equals_brute_force(spark, tmp_path):
    rows = pages()
    got = warc.round_trip(frame(spark, rows).repartition(5), str(tmp_path / "w"))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_payloads_come_back_and_small_ones_are_not_revisited(spark, tmp_path):
    rows, folder = pages(), str(tmp_path / "w")
    warc.register(spark)
    warc.captures(frame(spark, rows), min_bytes=2).write.format("warc").option("file_bytes", 500).mode("append").save(folder)
    back = spark.read.format("warc").option("partition_bytes", 2000).load(folder).filter("record_type <> 'warcinfo'").collect()
    want = {(f"urn:page:{i}", kind, None if held is None else f"urn:page:{held}") for i, _, _, kind, held in brute(rows, 2)}
    assert {(r["record_id"], r["record_type"], r["refers_to"]) for r in back} == want and len(back) == len(rows)
    html = {f"urn:page:{i}": (h or "").encode() for i, _, h in rows}
    for r in back:
        assert r["payload_length"] == len(html[r["record_id"]])
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == html[r["record_id"]] and r["digest_ok"]
        else:
            assert r["payload"] is None and r["headers"]["warc-profile"] == warc.SAME_PAYLOAD
    assert next(r for r in back if r["record_id"] == "urn:page:7")["target_uri"] == "http://a/7%0D%0AEvil: 1"


def test_null_ids_and_empty_table(spark, tmp_path):
    rows = [(None, "u", "a"), (None, "u", "a"), (3, "u", "b"), (None, "u", "b")]
    got = warc.round_trip(frame(spark, rows), str(tmp_path / "w")).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got) == [
        (0, "response", None), (0, "response", None), (0, "revisit", 3), (3, "response", None)]
    assert warc.round_trip(frame(spark, rows).limit(0), str(tmp_path / "e")).count() == 0


def foreign():
    """Records as another writer makes them, with a folded header line and bare resource bodies."""
    out = []
    for i in range(40):
        body = bytes([65 + i % 26]) * (i * 1000)
        kind = ["resource", "request", "metadata"][i % 3]
        out.append(f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Target-URI: http://h/{i}\r\n"
                   f"X-Note: one\r\n two\r\nContent-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")
    return out


@pytest.mark.parametrize("make", ["plain", "members", "one member"])
def test_archives_of_other_writers(spark, tmp_path, make):
    records = foreign()
    data = {"plain": b"".join(records), "members": b"".join(map(gzip.compress, records)),
            "one member": gzip.compress(b"".join(records))}[make]
    path = tmp_path / ("a.warc" if make == "plain" else "a.warc.gz")
    path.write_bytes(data)
    warc.register(spark)
    every = spark.read.format("warc").load(str(path)).orderBy("payload_length").collect()
    assert [r["record_id"] for r in every] == [f"urn:x:{i}" for i in range(40)]
    assert all(bytes(r["payload"]) == records[i].partition(b"\r\n\r\n")[2][:-4] for i, r in enumerate(every))
    assert every[0]["headers"]["x-note"] == "one two" and every[0]["digest_ok"] is None
    some = spark.read.format("warc").load(str(path)).filter("record_type = 'request' and target_uri like '%/1%'")
    assert sorted(r["record_id"] for r in some.collect()) == sorted(
        f"urn:x:{i}" for i in range(40) if i % 3 == 1 and str(i).startswith("1"))
    if make == "plain":
        assert all(data[r["offset"]:].startswith(records[i]) for i, r in enumerate(every))


FILTERS = ["record_type = 'request'", "record_type <> 'request'", "record_type in ('request', 'metadata')",
           "refers_to is null", "refers_to is not null", "target_uri like 'http://h/3%'", "target_uri > 'http://h/5'",
           "content_length >= 20000 and content_length < 30000", "not (content_length <= 3000)", "record_id <=> 'urn:x:9'",
           "refers_to <> 'a'", "refers_to not in ('a', null)", "target_uri like '%9'", "payload_length > 5000 and record_type = 'request'"]


def test_pushed_filters_equal_filters_of_spark(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, foreign())))
    warc.register(spark)
    df = spark.read.format("warc").load(str(tmp_path))
    df.write.parquet(str(tmp_path / "copy"))
    copy = spark.read.parquet(str(tmp_path / "copy"))
    for condition in FILTERS:
        pushed, plain = (sorted(r["record_id"] for r in t.filter(condition).collect()) for t in (df, copy))
        assert pushed == plain, condition


def test_unwanted_bodies_are_not_decoded():
    big = os.urandom(3_000_000)
    records = [warc.record(kind, f"urn:{n}", big, "text/plain") for n, kind in enumerate(["a", "b", "a", "a"])]
    data = b"".join(warc.member(r, 1) for r in records)
    archive, seen = warc.Archive(io.BytesIO(data), True), []
    while (header := archive.head()) is not None:
        fields = warc.parse_fields(header)
        wanted = fields["warc-type"] == "b"
        seen.append(fields["warc-record-id"])
        if wanted:
            assert archive.read(int(fields["content-length"])) == big
        else:
            archive.skip(int(fields["content-length"]))
    assert len(seen) == 4 and archive.inflated < len(big) + 5 * warc.READ
    assert gzip.decompress(data) == b"".join(records)


def test_only_committed_files_are_read(spark, tmp_path):
    folder = str(tmp_path / "w")
    warc.register(spark)
    rows = warc.captures(frame(spark, pages()[:20]))
    rows.write.format("warc").mode("append").save(folder)
    (tmp_path / "w" / "part-lost-00000.warc.gz").write_bytes(b"half a file")
    assert spark.read.format("warc").load(folder).filter("record_type <> 'warcinfo'").count() == 20
    rows.limit(3).write.format("warc").mode("overwrite").option("compression", "none").save(folder)
    assert spark.read.format("warc").load(folder).filter(F.col("record_type") != "warcinfo").count() == 3


def test_broken_archive_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(foreign()[3][:-100])
    warc.register(spark)
    with pytest.raises(Exception, match="ends inside the record"):
        spark.read.format("warc").load(str(tmp_path)).collect()
