import random
import struct
from pathlib import Path
from urllib.parse import unquote, urlparse

import zstandard
from pyspark.sql import functions as F

from symgraph.llm import common, warc


def folder_of(spark):
    return common.table_path(spark, "warc-test")


def local(folder):
    return Path(unquote(urlparse(folder).path))


def test_round_trip_and_form(spark, sf_dir):
    pages = common.read(spark, sf_dir, "pages")
    folder = folder_of(spark)
    index = warc.write_warc(pages, folder)
    back = warc.read_warc(index, folder)
    assert pages.select("page_id", "url", "html").exceptAll(back.select("page_id", "url", "html")).count() == 0
    assert back.join(index.select("page_id", F.col("digest").alias("d")), "page_id").where("d <> digest").count() == 0
    for p in local(folder).iterdir():
        raw = p.read_bytes()
        magic, size = struct.unpack_from("<II", raw)
        assert magic == warc.MAGIC
        rows = index.where(F.col("file") == p.name).orderBy("offset").collect()
        assert rows[0]["offset"] == 8 + size and rows[-1]["offset"] + rows[-1]["length"] == len(raw)
        assert all(a["offset"] + a["length"] == b["offset"] for a, b in zip(rows, rows[1:]))


def test_the_dictionary_is_built_from_the_records_and_pays():
    records = [warc.record(f"http://a.example/{i}", f"<html><head><title>{i}</title></head><body><nav>the same navigation in all pages</nav><p>" + f"text {i * i} " * 40)[0] for i in range(2000)]
    data, places = warc.archive(records)
    packed, start = warc.unpacker(data)
    assert start > 8 and [packed.decompress(data[a : a + n]) for a, n in places] == records
    plain = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert sum(n for _, n in places) < plain


def test_odd_input(spark):
    long = "<p>" + "very long page " * 50_000
    rows = [(1, None, "<p>x", 1), (2, "http://a\r\nX: y", None, 2), (3, "http://b", "", 3), (None, "http://c", "é漢😀\r\n\r\n", 4), (4, "http://d", long, 5), (4, "http://d", long, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `offset` int")
    folder = folder_of(spark)
    index = warc.write_warc(pages, folder, file_bytes=1000)
    got = sorted(((r["page_id"], r["url"], r["html"]) for r in warc.read_warc(index, folder).collect()), key=repr)
    assert got == sorted([(1, None, "<p>x"), (2, "http://a X: y", ""), (3, "http://b", ""), (None, "http://c", "é漢😀\r\n\r\n"), (4, "http://d", long), (4, "http://d", long)], key=repr)
    assert warc.write_warc(pages.limit(0), folder_of(spark)).count() == 0


def test_the_dictionary_learns_from_the_last_records_too():
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    late = words(60)
    records = [(words(60) + (late if i >= 1500 else "")).encode() for i in range(2000)]
    assert late[200:260].encode() in warc.dictionary(records)
