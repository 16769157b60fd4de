import base64
import hashlib

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from blockweave.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [(n, f"http://x/{n % 4}?a=é b", "same <html>" if n % 3 == 0 else f"<p>{n}\r\n\r\nx</p>") for n in range(60)]
ROWS += [(100, None, None), (101, "u", ""), (102, "bad\r\nInjected: 1", "once " * 200_000)]
SCHEMA = "page_id bigint, url string, html string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1))


def test_round_trip(spark):
    bundles = warc.write_archives(table(spark, ROWS))
    got = {r["page_id"]: r for r in warc.read_archives(bundles).collect()}
    assert len(got) == len(ROWS)
    largest = {}
    for i, _, html in ROWS:
        largest[html or ""] = max(i, largest.get(html or "", -1))
    for i, _, html in ROWS:
        r, response = got[i], largest[html or ""] == i
        assert r["record_type"] == ("response" if response else "revisit")
        assert r["refers_to"] == (None if response else largest[html or ""])
        assert r["payload_bytes"] == len((html or "").encode()) and r["payload_digest"] == digest(html)
        assert r["payload"] == ((html or "").encode() if response else None)


def test_bundles_are_seekable_zstandard(spark):
    bundles = warc.write_archives(table(spark, ROWS))
    data = {r["bundle"]: bytes(r["data"]) for r in bundles.collect()}
    whole = {}
    for name, raw in data.items():
        with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as reader:
            whole[name] = reader.readall()
        frames = warc.read_seek_table(raw)
        assert b"".join(warc.read_frame(raw, k, frames) for k in range(len(frames))) == whole[name]
    places = warc.index(bundles).collect()
    assert len({r["record_id"] for r in places}) == len(ROWS)
    for r in places:
        record = warc.read_record(data[r["bundle"]], r["frame"], r["offset"])
        assert record["head"]["WARC-Record-ID"] == r["record_id"]
        assert "Injected" not in record["head"]


def test_many_frames_and_bundles(spark, monkeypatch, tmp_path):
    bundle = warc._Bundle("b")
    records = [warc.encode_record(n, "u", b"z" * n * 1000, digest("z" * n * 1000), None, False, f"<{n}>") for n in range(60)]
    for n, record in enumerate(records):
        bundle.add(f"<{n}>", record)
    row = bundle.row().to_pylist()[0]
    assert len(set(row["frames"])) > 3
    for n, frame, offset, length in zip(range(60), row["frames"], row["offsets"], row["lengths"], strict=True):
        assert warc.read_frame(row["data"], frame)[offset : offset + length] == records[n]
    with pytest.raises(ValueError):
        warc.read_seek_table(row["data"][:-3])


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "b", "x"), (1, "a", "x"), (1, "a", "x"), (None, "c", "x"), (None, "d", "y"), (None, "e", "y")]
    bundles = warc.write_archives(table(spark, rows))
    got = sorted((r["payload_digest"] == digest("x"), r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in warc.read_archives(bundles).select("payload_digest", "page_id", "record_type", "refers_to").collect() if r["page_id"])
    assert [g[2] for g in got] == ["response", "revisit", "revisit"] and [g[3] for g in got] == [None, 1, 1]
    kinds = sorted(r["record_type"] for r in warc.read_archives(bundles).where(F.col("page_id").isNull()).collect())
    assert kinds == ["response", "revisit", "revisit"]
    ids = [r["record_id"] for r in warc.index(bundles).collect()]
    assert len(set(ids)) == len(ids) - 0
    assert warc.read_archives(warc.write_archives(table(spark, rows).limit(0))).count() == 0


def test_exported_files(spark, tmp_path):
    bundles = warc.write_archives(table(spark, ROWS))
    files = warc.export_bundles(bundles, str(tmp_path / "w")).collect()
    assert sorted(p.name for p in (tmp_path / "w").iterdir()) == sorted(r["path"].rsplit("/", 1)[1] for r in files)
    for r in files:
        with open(r["path"], "rb") as f:
            assert len(f.read()) == r["bytes"]


def test_escapes_stay_and_revisits_name_their_response(spark):
    urls = ["https://a.b/x%20y?q=%E4", "https://a.b/100%", "https://a.b/p q"]
    rows = [(n, url, "<p>same</p>") for n, url in enumerate(urls)]
    bundles = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    got = {r["page_id"]: r for r in warc.read_archives(bundles).collect()}
    assert [got[n]["url"] for n in range(3)] == [urls[0], urls[1], "https://a.b/p%20q"]
    heads = []
    for r in bundles.select("data").collect():
        table = warc.read_seek_table(r["data"])
        for frame in range(len(table)):
            text, at = warc.read_frame(r["data"], frame, table), 0
            while at < len(text):
                record, at = warc.decode_record(text, at)
                heads.append(record["head"])
    response = [h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"]
    assert len(response) == 1
    assert {h["WARC-Refers-To"] for h in heads if h["WARC-Type"] == "revisit"} == set(response)


def test_wanted_records_are_read_through_the_index(spark, monkeypatch):
    rows = [(n, f"u{n}", f"<p>page {n % 40}</p>" + "x" * 3000) for n in range(60)]
    bundles = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    whole = {r["page_id"]: r for r in warc.read_archives(bundles).collect()}
    ids = {n: warc.record_id(n, whole[n]["payload_digest"], 0) for n in range(60)}
    wanted = [3, 17, 43, 59]
    table_of = [(ids[n], 1) for n in wanted] + [(ids[3], 2), ("<unknown>", 3), (None, 4)]
    asked = spark.createDataFrame(table_of, "record_id string, frame int")
    got = {r["page_id"]: r for r in warc.read_records(bundles, asked).collect()}
    assert sorted(got) == wanted and all(got[n] == whole[n] for n in wanted)
    assert warc.read_records(bundles, asked.limit(0)).count() == 0
    # of a bundle only the frames with a wanted record are decompressed
    monkeypatch.setattr(warc, "FRAME_BYTES", 5000)
    bundle = warc._Bundle("b")
    for n in range(10):
        bundle.add(f"<{n}>", warc.encode_record(n, "u", b"y" * 3000, digest("y" * 3000), None, False, f"<{n}>"))
    row = bundle.row().to_pylist()[0]
    read, plain = [], warc.read_frame
    monkeypatch.setattr(warc, "read_frame", lambda data, frame, table=None: (read.append(frame), plain(data, frame, table))[1])
    places = [{"frame": row["frames"][n], "offset": row["offsets"][n]} for n in (7, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array([row["data"]]), pa.array([places])], names=["data", "places"])
    assert [r["page_id"] for part in warc._pick(iter([batch])) for r in part.to_pylist()] == [0, 7]
    assert read == [row["frames"][0], row["frames"][7]] and max(row["frames"]) > 3
