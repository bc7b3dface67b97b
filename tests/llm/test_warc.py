"""Web archives: whole round trips, the published seekable format, single records."""

import hashlib
import os

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from sparkloom.llm import warc as W

ROWS = (
    [(i, f"http://x/{i}", "p" * (90 + i % 20) if i % 3 else "hot" * 50) for i in range(200)]
    + [(None, None, "hot" * 50), (5, "http://é x\n", None), (None, "u", None), (3, "e", "")]
    + [(7, "a", "z" * 200), (7, "b", "z" * 200), (7, "a", "z" * 200), (None, "n", "q" * 300), (None, "n", "q" * 300)]
    + [(10_000 + i, "big", f"{i} " + "long é " * 300_000) for i in range(3)]
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("warc")
    rows = [(*r, "x", "y", "z") for r in ROWS]
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string, row string, doubt string").repartition(4).write.parquet(f"{folder}/pages.parquet")
    W.write_warc(W.typed_records(spark.read.parquet(f"{folder}/pages.parquet")), f"{folder}/archive")
    return str(folder)


def test_query_is_that_of_the_table(spark, folder):
    got = W.op11_warc_bundles(spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = con.sql(W.ORACLE)
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_payloads_come_back(spark, folder):
    rows = W.read_warc(spark, f"{folder}/archive").collect()
    assert len(rows) == len({r["record_id"] for r in rows}) == len(ROWS)
    by_id = {r["record_id"]: r for r in rows}
    back = []
    for r in rows:
        held = r if r["record_type"] == "response" else by_id[r["refers_to_record"]]
        assert held["record_type"] == "response" and held["payload_digest"] == r["payload_digest"]
        back.append((r["page_id"], held["payload"].decode()))
    assert sorted(back, key=str) == sorted(((None if i is None else str(i), h or "") for i, _, h in ROWS), key=str)
    assert {r["url"] for r in rows} >= {"http://%C3%A9%20x%0A", None}


def test_index_finds_single_records(spark, folder):
    index = W.record_index(spark, f"{folder}/archive")
    all_rows = W.read_warc(spark, f"{folder}/archive")
    some = all_rows.where("page_id in ('7', '10002', '5')")
    got = W.fetch_records(index.join(some.select("record_id"), "record_id"))
    assert got.exceptAll(some).isEmpty() and some.exceptAll(got).isEmpty() and some.count() == 7
    assert index.select("archive", "frame", "offset").distinct().count() == index.count()


def test_bundles_follow_the_seekable_format(folder):
    for name in os.listdir(f"{folder}/archive"):
        data = open(f"{folder}/archive/{name}", "rb").read()
        number, flags = int.from_bytes(data[-9:-5], "little"), data[-5]
        assert data[-4:] == bytes.fromhex("b1ea928f") and flags == 0x80
        table = data[-9 - 12 * number - 8 :]
        assert table[:4] == bytes.fromhex("5e2a4d18") and int.from_bytes(table[4:8], "little") == 12 * number + 9
        # any decompressor that goes on over frames reads the archive as a plain one
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        reader = W.Reader(f"{folder}/archive/{name}")
        assert b"".join(reader.frame(k) for k in range(len(reader))) == plain
        for _, frame, offset, length in reader.index().tolist():
            assert reader.frame(frame)[offset : offset + length].startswith(b"WARC/1.1\r\n")


def test_damage_is_an_error(folder, tmp_path):
    name = sorted(os.listdir(f"{folder}/archive"))[0]
    data = bytearray(open(f"{folder}/archive/{name}", "rb").read())
    for at, cut in ((200, 0), (0, 5)):
        bad = bytearray(data)
        bad[at] ^= 1
        (tmp_path / "bad.warc.zst").write_bytes(bad[: len(bad) - cut])
        with pytest.raises((ValueError, zstandard.ZstdError)):
            W.Reader(str(tmp_path / "bad.warc.zst")).frame(0)


def test_rows_that_are_not_from_files_and_no_rows(spark, folder):
    pages = spark.createDataFrame([(1, None, "a" * 150), (2, "v", "a" * 150)], "page_id int, url string, html string")
    W.write_warc(W.typed_records(pages), f"{folder}/other")
    rows = {r["page_id"]: r for r in W.read_warc(spark, f"{folder}/other").collect()}
    assert rows["2"]["refers_to"] == "1" and rows["2"]["payload"] is None
    assert rows["1"]["payload_digest"] == hashlib.sha256(b"a" * 150).hexdigest()
    os.makedirs(f"{folder}/empty", exist_ok=True)
    spark.read.parquet(f"{folder}/pages.parquet").where(F.lit(False)).write.mode("overwrite").parquet(f"{folder}/empty/pages.parquet")
    assert W.op11_warc_bundles(spark, f"{folder}/empty").count() == 0
