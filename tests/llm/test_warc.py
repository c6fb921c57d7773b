import hashlib

import pytest
import zstandard

from tarn.llm import warc
from tarn.llm.common import shared_dir
from tarn.llm.entries import op7_warc
from tests.conftest import DATA

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    tops = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= warc.REVISIT_BYTES and i is not None:
            tops[data] = max(tops.get(data, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = tops.get(data)
        again = top is not None and (i is None or i < top)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def result(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=key)


def test_query_matches_the_pages(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()]
    assert result(op7_warc(spark, f"{DATA}/sf0.01")) == sorted(expected(rows), key=key)


def test_edge_rows_and_payloads_come_back(spark):
    big = "é\r\n\r\nx" * 400
    rows = [(1, "http://a", big), (2, None, big), (3, "a b\nc", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (7, "u", "q" * 1000), (7, "u", "q" * 1000), (8, "u", "y" * 20_000_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], f"{SCHEMA}, payload string").repartition(3)
    assert result(warc.archived(df)) == sorted(expected(rows), key=key)
    folder = shared_dir(spark)
    written = warc.write(df, folder)
    assert written.agg({"records": "sum"}).first()[0] == len(rows)
    back = {(r["page_id"], r["payload_digest"]): bytes(r["payload"]).decode() for r in warc.read(spark, folder, written).where("record_type = 'response'").collect()}
    assert back[2, hashlib.sha1(big.encode()).hexdigest()] == big and len(back[8, hashlib.sha1(b"y" * 20_000_000).hexdigest()]) == 20_000_000
    assert warc.archived(df.limit(0)).collect() == []


def test_files_have_the_dictionary_in_front_and_a_frame_per_record():
    records = [warc.record(i, f"http://h/{i}", f"<html><body>page number {i} of many pages with much the same text</body></html>".encode() * 20, hashlib.sha1(b"").hexdigest(), 1) for i in range(400)]
    data = warc.packed(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    size = int.from_bytes(data[4:8], "little")
    assert size > 0 and zstandard.get_frame_parameters(data[8 + size :]).dict_id == zstandard.ZstdCompressionDict(data[8 : 8 + size]).dict_id()
    assert list(warc.unpacked(data)) == records
    for some in (records[:1], records[:3], [b"x"], [bytes(3_000_000)], [r * 200 for r in records[:5]]):
        data = warc.packed(some)
        assert list(warc.unpacked(data)) == some and int.from_bytes(data[4:8], "little") > 0


def test_what_other_attempts_left_is_not_read(spark):
    from pathlib import Path

    rows = [(i, f"http://h/{i}", f"page {i} " * 300) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    folder = shared_dir(spark)
    first, second = warc.write(df, folder), warc.write(df.limit(30), folder)
    path = Path(folder.removeprefix("file:"))
    (path / "part-000009-left-000000.warc.zst").write_bytes(b"cut off")
    assert warc.read(spark, folder, first).count() == 50 and warc.read(spark, folder, second).count() == 30
    name = first.first()["name"]
    kept = (path / name).read_bytes()
    (path / name).write_bytes(warc.packed(list(warc.unpacked(kept))[:-1]))
    with pytest.raises(Exception, match="an archive has"):
        warc.read(spark, folder, first).collect()
    (path / name).unlink()
    with pytest.raises(ValueError, match="of .* archives"):
        warc.read(spark, folder, first)


def test_more_repeated_payloads_than_are_broadcast(spark, monkeypatch):
    from tarn.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = [(i, "u", f"page {i % 7} " * 300) for i in range(60)]
    assert result(warc.archived(spark.createDataFrame(rows, SCHEMA).repartition(4))) == sorted(expected(rows), key=key)


def test_files_end_at_their_limit_and_are_read_piece_by_piece(monkeypatch):
    import io

    monkeypatch.setattr(warc, "WINDOW_BYTES", 5_000)
    payloads = [hashlib.sha256(str(i).encode()).hexdigest().encode() * (i % 40) for i in range(300)] + [bytes(range(256)) * 2000]
    records = [warc.record(i, "u", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads)]
    left, files = iter(records), []
    while sum(n for n, _, _ in files) < len(records):
        out = io.BytesIO()
        n, size = warc.pack(left, out, 6_000)
        files.append((n, size, out.getvalue()))
    assert len(files) > 2 and all(size == len(data) for _, size, data in files)
    assert [r for _, _, data in files for r in warc.unpacked(io.BytesIO(data))] == records
