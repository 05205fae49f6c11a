import base64
import gzip
import hashlib

from veilspark.llm import warc

ROWS = [(5, "http://a/", "same"), (3, "http://b/\r\nX: y", "same"), (9, None, "same"), (1, "http://c/", ""), (2, "http://d/", None), (4, "http://e/", "ü" * 300_000), (7, "http://f/", "one\r\n\r\nWARC/1.1"), (3, "http://b/", "same"), (None, "http://g/", "same"), (None, "http://h/", "alone")]


def frame(spark):
    return spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, first int")


def test_digests(spark):
    firsts = {}
    for page_id, _, html in ROWS:
        if page_id is not None:
            firsts[html or ""] = min(page_id, firsts.get(html or "", page_id))
    want = []
    for page_id, _, html in ROWS:
        data, first = (html or "").encode(), firsts.get(html or "")
        revisit = first is not None and page_id != first
        want.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    got = [tuple(r) for r in warc.digests(frame(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.digests(frame(spark).limit(0)).count() == 0


def test_chunks_carry_what_came_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "w")
    warc.write(warc.decide(frame(spark)).coalesce(1), path, archive_bytes=600)
    assert len(list((tmp_path / "w").glob("*.warc.gz"))) > 2
    rows = warc.read_chunks(spark, path).where("record_id = '<urn:page:4>'").orderBy("chunk_no").collect()
    data = ("ü" * 300_000).encode()
    assert [r.chunk_no for r in rows] == list(range(-(-len(data) // warc.CHUNK))) and b"".join(r.data for r in rows) == data
    so_far = 0
    for r in rows:
        so_far += len(r.data)
        assert r.bytes_so_far == so_far and r.sha1_so_far == base64.b32encode(hashlib.sha1(data[:so_far]).digest()).decode()
    assert [r.is_last for r in rows] == [False] * (len(rows) - 1) + [True]
    for file in (tmp_path / "w").glob("*.warc.gz"):
        assert gzip.decompress(file.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_small_payloads_stay_responses(spark):
    got = warc.decide(frame(spark), min_bytes=5).collect()
    assert {r.record_type for r in got} == {"response"}
    assert {r.page_id for r in warc.decide(frame(spark), min_bytes=4).where("record_type = 'revisit'").collect()} == {5, 9, None}


def test_shuffled_join_of_hot_payloads(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "http://a/", "hot" if k % 3 else f"own {k // 6}") for k in range(200)], "page_id long, url string, html string")
    want = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.decide(pages).collect())
    monkeypatch.setattr(warc.common, "BROADCAST_BYTES", 0)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.decide(pages, same_rows=10).collect()) == want
    assert sum(kind == "revisit" for _, kind, _ in want) == 200 - 1 - 34


def test_long_urls(spark):
    pages = [(1, "http://a/" + "x" * 3_000_000, "page"), (2, "http://b/" + "é" * 1_200_000, ""), (3, "http://c/", "page")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in warc.digests(frame).collect()}
    assert got == {1: (4, "response"), 2: (0, "response"), 3: (4, "revisit")}


def test_broken_bytes_are_found(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(warc.decide(frame(spark)), path)
    chunks = warc.read_chunks(spark, path)
    assert warc.records(chunks).where("not sound").count() == 0
    from pyspark.sql import functions as F

    for wrong in (F.when(F.col("chunk_no") == 3, F.expr("concat(X'00', substring(data, 2))")).otherwise(F.col("data")), F.when(F.length("data") == 4, F.lit(b"other")).otherwise(F.col("data"))):
        assert warc.records(chunks.withColumn("data", wrong)).where("not sound").count() > 0


def test_many_lists_are_few_partitions(spark, tmp_path, monkeypatch):
    from veilspark.llm import media

    path = str(tmp_path / "w")
    warc.write(warc.decide(frame(spark)).repartition(4), path, archive_bytes=300)
    whole = sorted(map(str, warc.read_chunks(spark, path).collect()))
    sizes = [len(media.plan(path, n)) for n in (1 << 30, 1000, 100)]
    assert sizes[0] == 1 and sizes[0] < sizes[1] < sizes[2]
    monkeypatch.setattr(warc, "RANGE_BYTES", 100)
    assert sorted(map(str, warc.read_chunks(spark, path).collect())) == whole
    monkeypatch.setattr(media, "MOST_RANGES", 3)
    assert len(media.plan(path, 100)) <= 3 and sorted(map(str, warc.read_chunks(spark, path).collect())) == whole
