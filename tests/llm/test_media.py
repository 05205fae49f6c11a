import hashlib
import io
import math
import zipfile
import zlib

from veilspark.llm import media

ROWS = [(1, "short"), (2, ""), (3, None), (None, "né 🙂"), (4, "x" * 576), (5, "long é " * 40_000), (1, "short"), (6, "y" * 575)]


def test_images_round_trip():
    for n in (0, 1, 575, 576, 577, 5000, 700_000):
        data = bytes(i % 251 for i in range(n))
        payload = media.pad(data)
        assert len(payload) % 576 == 0 and len(payload) >= 576 and media.from_png(media.to_png(payload)) == payload


def frame(spark):
    return spark.createDataFrame([(*r, b"clash") for r in ROWS], "doc_id long, text string, payload binary")


def test_digests(spark):
    want = []
    for doc_id, text in ROWS:
        data = (text or "").encode()
        payload = media.pad(data)
        png = media.to_png(payload)
        want.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), media.feature(payload)))
    got = [tuple(r) for r in media.digests(frame(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert media.digests(frame(spark).limit(0)).count() == 0


def test_archives_are_zip_files_and_ranges_cover_them(spark, tmp_path):
    path = str(tmp_path / "a")
    media.write(frame(spark).coalesce(1), path, archive_bytes=300)
    files = sorted((tmp_path / "a").glob("*.zip"))
    assert len(files) > 2
    names = [n for f in files for n in zipfile.ZipFile(io.BytesIO(f.read_bytes())).namelist()]
    assert len(names) == len(ROWS) and all(zipfile.ZipFile(f).testzip() is None for f in files)
    assert media.read(spark, path, range_bytes=100).count() == len(ROWS)


def test_a_broken_member_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "b")
    media.write(frame(spark).coalesce(1), path)
    (file,) = (tmp_path / "b").glob("*.zip")
    data = bytearray(file.read_bytes())
    data[60] ^= 255
    file.write_bytes(data)
    got = media.read(spark, path).collect()
    assert len(got) == len(ROWS) and [r.doc_id for r in got if r.error] == [1] and sum(r.payload is None for r in got) == 1


def samples(png):
    """Width, height and rows of an 8-bit grey image without filters, read by the letter of the format."""
    assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, parts = 8, {}
    while at < len(png):
        size = int.from_bytes(png[at : at + 4], "big")
        kind, body, check = png[at + 4 : at + 8], png[at + 8 : at + 8 + size], png[at + 8 + size : at + 12 + size]
        assert zlib.crc32(kind + body).to_bytes(4, "big") == check
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + size
    assert kind == b"IEND" and not body
    head = parts[b"IHDR"]
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    assert head[8:] == bytes([8, 0, 0, 0, 0])
    raw = zlib.decompress(parts[b"IDAT"])
    assert len(raw) == height * (width + 1) and set(raw[:: width + 1]) == {0}
    return width, height, b"".join(raw[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def slow_feature(payload):
    n = len(payload)
    mean = sum(payload) / n
    deviation = math.sqrt(sum((x - mean) ** 2 for x in payload) / n)
    bins = [0] * 16
    for x in payload:
        bins[x // 16] += 1
    marks = ""
    for k in range(64):
        cell = payload[k * n // 64 : (k + 1) * n // 64]
        marks += "1" if sum(cell) / len(cell) > mean else "0"
    return f"mean={mean:.4f};std={deviation:.4f};hist={','.join(map(str, bins))};hash={int(marks, 2):016x}"


def test_stored_images_by_another_decoder(spark, tmp_path):
    path = str(tmp_path / "c")
    media.write(frame(spark), path, archive_bytes=5000)
    stored = {}
    for file in (tmp_path / "c").glob("*.zip"):
        archive = zipfile.ZipFile(file)
        for name in archive.namelist():
            stored.setdefault(name.split("-", 1)[1][:-4], []).append(archive.read(name))
    got = media.digests(frame(spark)).collect()
    assert len(got) == len(ROWS) == sum(map(len, stored.values()))
    for r in got:
        png = stored[str(r.doc_id) if r.doc_id is not None else "null"][0]
        width, height, payload = samples(png)
        text = next(t for d, t in ROWS if d == r.doc_id)
        data = (text or "").encode()
        assert width == 576 and payload.rstrip(b"\xff") == data and len(payload) == max(576, -(-len(data) // 576) * 576)
        assert (r.media_bytes, r.media_sha256, r.payload_sha256) == (len(png), hashlib.sha256(png).hexdigest(), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.feature == slow_feature(payload)
