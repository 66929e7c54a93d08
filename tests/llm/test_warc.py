"""WARC archives: round trips, validation of faulty archives, and the query against DuckDB."""

import base64
import hashlib
import io
import struct

import pytest
import zstandard

from revlens.llm import queries, warc
from tests.compare import compare_one
from tests.conftest import SF0001, SF001


@pytest.mark.parametrize("sf", [SF0001, SF001])
def test_query_matches_sql(spark, sf):
    from tests.compare import duck_connect
    r = compare_one(spark, duck_connect(sf), "op2_warc", queries.QUERIES["op2_warc"], queries.ORACLE_SQL["op2_warc"], sf)
    assert r["values"] and r["rows"], r["detail"]


def pages_df(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, row string")


def test_edge_rows(spark):
    rows = [(3, "http://a/ b\n", "same é"), (1, None, "same é"), (2, "", "other"), (4, "u", None), (5, "u", ""), (6, "u", "z" * 3_000_000),
            (None, "u", "same é"), (None, "u", "alone"), (7, "u", "WARC/1.1\r\n\r\n\x00"), (8, "u", "twice"), (8, "u", "twice")]
    got = warc.round_trip(pages_df(spark, rows)).collect()

    def want(k, html):
        data = (html or "").encode()
        ids = [a for a, _, h in rows if a is not None and (h or "") == (html or "")]
        first = min(ids, default=None)
        refers = first if first is not None and k != first else None
        return (k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers)

    assert sorted(map(tuple, got), key=str) == sorted((want(k, h) for k, _, h in rows), key=str)
    assert warc.round_trip(pages_df(spark, [])).collect() == []


def test_payloads_come_back_from_several_archives(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html>{i % 40} " + "text " * (i % 90)) for i in range(600)]
    folder = f"file://{tmp_path}/out"
    warc.write_archives(pages_df(spark, rows).coalesce(2), folder, archive_bytes=20_000)
    assert warc.archives(spark, folder).count() > 4
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == 600 and not any(r["error"] for r in got)
    by = {r["row"]: r for r in got}
    for k, url, html in rows:
        r = by[k]
        whole = r if r["record_type"] == "response" else by[r["refers_to"]]
        assert bytes(whole["payload"]) == html.encode() and r["target_uri"] == url and r["payload_bytes"] == len(html)
    manifest = spark.read.parquet(f"{folder}/manifest")
    assert manifest.groupBy().sum("records").first()[0] == 600
    (tmp_path / "out" / "part-000000-0000-999.warc.zst").write_bytes(archive(RECORD))  # left by an attempt that was lost
    assert warc.read_archives(spark, folder).count() == 601
    assert warc.read_archives(spark, folder, manifest=f"{folder}/manifest").count() == 600


def test_manifest_is_one_file_for_many_tasks(spark, tmp_path):
    """On a local disk every file is made by processes of its own."""
    folder = f"file://{tmp_path}/out"
    warc.write_archives(pages_df(spark, [(i, "http://h", f"text {i % 7}") for i in range(120)]).repartition(12), folder)
    found = spark.read.parquet(f"{folder}/manifest").collect()
    assert sum(r["records"] for r in found) == 120 and {r["archive"] for r in found} == {p.name for p in (tmp_path / "out").glob("*.zst")}
    assert len(list((tmp_path / "out" / "manifest").glob("part-*"))) == 1
    assert not list((tmp_path / "out").glob("*/_SUCCESS"))


RECORD = warc.build_record(1, "http://h", b"payload", None, False)


def archive(*frames, dictionary=b"", squeeze=False):
    data = zstandard.compress(dictionary) if squeeze else dictionary
    head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(data)) + data if dictionary else b""
    c = zstandard.ZstdCompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
    return head + b"".join(c.compress(f) for f in frames)


def test_dictionary_is_loaded_from_the_leading_frame():
    words = [warc.build_record(i, f"http://h/{i}", f"text {i} of many ".encode() * 20, None, False) for i in range(300)]
    raw = warc.train_dictionary(words)
    assert raw
    for squeeze in (False, True):
        data = archive(*words[:5], dictionary=raw, squeeze=squeeze)
        assert list(warc.records(io.BytesIO(data), block=7)) == words[:5]
    with pytest.raises(warc.WarcError):  # without it the frames cannot be read
        list(warc.records(io.BytesIO(archive(*words[:5], dictionary=raw)[8 + len(raw):])))


def test_plain_archives_and_other_skippable_frames():
    skip = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    assert list(warc.records(io.BytesIO(archive(RECORD) + skip + archive(RECORD)), block=5)) == [RECORD, RECORD]
    assert list(warc.records(io.BytesIO(b""))) == []


@pytest.mark.parametrize("data", [archive(RECORD)[:-3], archive(RECORD)[:5], b"garbage that is no frame", archive(RECORD) + b"tail"])
def test_broken_archives(data):
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(data)))


@pytest.mark.parametrize("old,new", [
    (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Type: response\r\n", b""), (b"WARC-Date: 2020", b"WARC-Date: x"), (b"payload", b"payloaX"),
    (b"payload", b"payload!"), (b"\r\n\r\n", b"\r\n"), (b"WARC-Record-ID: <", b"WARC-Record-ID: "), (b"WARC-Date", b"WARC-Type"),
    (b"Content-Length: 8", b"Content-Length: -8"), (b"WARC-Source-Row:", b"WARC-Source-Row")])
def test_faulty_records(old, new):
    bad = RECORD.replace(old, new)
    assert bad != RECORD
    with pytest.raises(warc.WarcError):
        headers, block = warc.parse_record(bad)
        warc.payload_of(headers, block)


def test_a_frame_holds_one_record():
    with pytest.raises(warc.WarcError):
        warc.parse_record(RECORD + RECORD)


def test_faults_are_reported_or_raised(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(archive(RECORD, RECORD.replace(b"payload", b"payloaX"), RECORD)[:-2])
    got = warc.read_archives(spark, str(tmp_path), on_error="report").orderBy("offset").collect()
    assert [bool(r["error"]) for r in got] == [False, True, True]
    with pytest.raises(Exception, match="digest|ends within"):
        warc.read_archives(spark, str(tmp_path)).collect()
