"""WARC archives behind a Spark data source, read as a table of bounded chunks with incremental digests.

Every record is a gzip member of its own. The writer rolls archives in a folder, lists for each task the offsets at
which reading may begin, and commits a manifest of the lists; the reader streams members from such an offset on and never holds a whole record: a
payload becomes rows of record_id and chunk_no, each with its bytes, the length so far and the SHA-1 so far.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader

from . import common
from .media import Committed, _store, archives_in, delete_archives, plan, write_list, write_manifest

#: Bytes of payload in a row of the chunk table, and of each read and decompression.
CHUNK = 64 << 10
ARCHIVE_BYTES = 64 << 20
#: Compressed bytes between two offsets at which a task may begin.
SPLIT_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
#: Bytes of archives that a reading task takes, about.
RANGE_BYTES = 16 << 20
#: Rows of one payload that a task of the salted join takes.
SAME_ROWS = 100_000
#: Payloads of at least so many bytes are stored once.
MIN_BYTES = 0
LEVEL = 3
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "record_id string, chunk_no long, data binary, bytes_so_far long, sha1_so_far string, is_last boolean, "
    "record_type string, target_uri string, refers_to string, payload_digest string, http_length long"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_uri(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _safe(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_parts(page_id, url, payload, record_type: str, refers_to):
    """A record as a sequence of byte strings; payload is a buffer that is passed on in slices."""
    view, sha = memoryview(payload), hashlib.sha1()
    for at in range(0, len(view), CHUNK):
        sha.update(view[at : at + CHUNK])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(view)}\r\n\r\n".encode()
    body = len(view) if record_type == "response" else 0
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if record_type == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32(sha.digest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + body}"]
    yield ("\r\n".join(lines) + "\r\n\r\n").encode() + http
    for at in range(0, body, CHUNK):
        yield view[at : at + CHUNK]
    yield b"\r\n\r\n"


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int):
        self.path, self.archive_bytes = path, archive_bytes

    def write(self, iterator):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        task, done, file = uuid.uuid4().hex, [], None
        for batch in iterator:
            for page_id, url, html, record_type, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if file is None:
                    name, at, starts = f"{task}-{len(done):05d}.warc.gz", 0, [0]
                    # the stream must not compress again for the name's sake
                    file = store.open_output_stream(f"{root}/{name}", compression=None)
                if at - starts[-1] >= SPLIT_BYTES:
                    starts.append(at)
                squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                for part in record_parts(page_id, url, html.as_buffer() if html.is_valid else b"", record_type, refers_to):
                    out = squeeze.compress(part)
                    file.write(out)
                    at += len(out)
                out = squeeze.flush()
                file.write(out)
                at += len(out)
                if at >= self.archive_bytes:
                    file.close()
                    done.append({"name": name, "starts": starts, "end": at})
                    file = None
        if file is not None:
            file.close()
            done.append({"name": name, "starts": starts, "end": at})
        return Committed(write_list(store, root, task, done) if done else None)

    def commit(self, messages):
        write_manifest(self.path, messages)

    def abort(self, messages):
        delete_archives(self.path, messages)


def members(file, start: int, stop: int):
    """For each gzip member that begins in start..stop an iterator of its decompressed bytes, CHUNK at most at a time.

    Each must be read to its end before the next is asked for.
    """
    file.seek(start)
    state = {"left": b"", "at": start}

    def one():
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            given = inflate.unconsumed_tail or state["left"]
            state["left"] = b""
            if not given:
                given = file.read(CHUNK)
                if not given:
                    raise ValueError("the archive ends within a record")
                state["at"] += len(given)
            out = inflate.decompress(given, CHUNK)
            if out:
                yield out
        state["left"] = inflate.unused_data

    while state["at"] - len(state["left"]) < stop:
        yield one()


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def chunks_of(member, with_data: bool = True):
    """Rows of the chunk table for one record, from an iterator of its bytes."""
    held = bytearray()

    def upto(mark: bytes, what: str) -> bytes:
        looked = 0
        while True:
            end = held.find(mark, looked)
            if end >= 0:
                found = bytes(held[:end])
                del held[: end + len(mark)]
                return found
            looked = max(0, len(held) - len(mark) + 1)
            more = next(member, None)
            if more is None:
                raise ValueError(f"the {what} does not end")
            held.extend(more)

    lines = upto(b"\r\n\r\n", "record header")
    if not lines.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = _headers(lines)
    length = int(warc["content-length"])
    # the stored response begins with its own header
    before = upto(b"\r\n\r\n", "stored header")
    http = _headers(before)
    left = length - len(before) - 4
    sha, so_far, number = hashlib.sha1(), 0, 0
    fixed = (warc["warc-type"], warc.get("warc-target-uri"), warc.get("warc-refers-to"), warc.get("warc-payload-digest"), int(http["content-length"]) if "content-length" in http else None)
    record_id = warc["warc-record-id"]
    while True:
        while len(held) < min(left, CHUNK):
            more = next(member, None)
            if more is None:
                raise ValueError("the record is cut off")
            held.extend(more)
        data = bytes(held[: min(left, CHUNK)])
        del held[: len(data)]
        left -= len(data)
        so_far += len(data)
        sha.update(data)
        yield (record_id, number, data if with_data else None, so_far, base32(sha.digest()), left == 0, *fixed)
        if not left:
            break
        number += 1
    for more in member:
        held.extend(more)
    if held != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")


class _Reader(DataSourceReader):
    def __init__(self, path: str, with_data: bool):
        self.path, self.with_data = path, with_data

    def partitions(self):
        return plan(self.path, RANGE_BYTES)

    def read(self, partition):
        kinds = pa.schema(
            [("record_id", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.string()), ("is_last", pa.bool_())]
            + [(n, pa.string()) for n in ("record_type", "target_uri", "refers_to", "payload_digest")]
            + [("http_length", pa.int64())]
        )
        store, root = _store(self.path)
        rows, held = [], 0
        for archive, first, last in archives_in(store, root, partition.spans):
            starts = [s for s in archive["starts"] if first <= s < last]
            if not starts:
                continue
            stop = next((s for s in archive["starts"] if s >= last), archive["end"])
            with store.open_input_file(f"{root}/{archive['name']}") as file:
                for member in members(file, starts[0], stop):
                    for row in chunks_of(member, self.with_data):
                        rows.append(row)
                        held += 500 + len(row[2] or b"") + len(row[7] or "")
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds.types)], schema=kinds)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds.types)], schema=kinds)


class WarcArchive(DataSource):
    """Format warc_archive. Options: path, archive_bytes (writing), with_data (reading; false leaves the bytes out)."""

    @classmethod
    def name(cls):
        return "warc_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("with_data", "true") == "true")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)))


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES, same_rows: int = SAME_ROWS) -> DataFrame:
    """(page_id, url, html, record_type, refers_to) for each row of pages.

    Of rows with equal html of at least min_bytes bytes those with the smallest page_id are responses and the others
    revisit it; smaller ones are all responses. A null html is the empty text; a null page_id counts as the
    largest; a payload that only null ids have is a response. First ids are pre-aggregated by digest, and only payloads
    that occur twice are looked up: by a broadcast where their counted bytes allow it, so that no html is shuffled; else under
    a salted digest, with as many salts as the most frequent payload's rows need.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.unhex(F.sha2(F.col("html").cast("binary"), 256))
    repeated = common.cut(
        p.where(F.octet_length("html") >= min_bytes).groupBy(key.alias("key")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"), "firsts"
    )
    firsts = common.small(repeated.select("key", "first"))
    keyed, on = p.withColumn("key", key), ["key"]
    if not common.is_broadcast(firsts):
        salts = -(-(repeated.agg(F.max("n")).first()[0] or 1) // same_rows)
        firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keyed, on = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")), ["key", "salt"]
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return keyed.join(firsts, on, "left").select(
        "page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")
    )


def write(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes records as decide() gives them; an empty table gives a folder without records."""
    spark = records.sparkSession
    common.small_batches(spark)
    spark.dataSource.register(WarcArchive)
    records.select("page_id", "url", "html", "record_type", "refers_to").write.format("warc_archive").mode("append").option("archive_bytes", archive_bytes).save(path)


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunk table of a folder of archives. A record without payload has one row, of no bytes."""
    spark.dataSource.register(WarcArchive)
    return spark.read.format("warc_archive").option("with_data", str(with_data).lower()).load(path)


def records(chunks: DataFrame) -> DataFrame:
    """(record_id, record_type, target_uri, refers_to, payload_digest, http_length, payload_bytes, payload_sha1, sound) for each
    record of a chunk table, from its chunks one after another: of a payload no more than a chunk is held at a time.

    A partition has a record's chunks together and in order, as read_chunks() gives them. sound is whether the chunks' running
    lengths and digests, the number of bytes and the stated digest are those of the bytes. A revisit has no bytes, and is sound as it is.
    """

    def run(batches):
        names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "http_length", "payload_bytes", "payload_sha1", "sound"]
        kinds = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string(), pa.bool_()]
        sha, length, sound, expected = hashlib.sha1(), 0, True, 0
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("record_id", "chunk_no", "bytes_so_far", "sha1_so_far", "is_last", "record_type", "target_uri", "refers_to", "payload_digest", "http_length")]
            for (record, number, upto, digest, last, kind, uri, refers, stated, http), data in zip(zip(*columns), batch.column(batch.schema.names.index("data"))):
                if number == 0:
                    sha, length, sound, expected = hashlib.sha1(), 0, True, 0
                held = data.as_buffer()
                sha.update(held)
                length += len(held)
                found = base32(sha.digest())
                sound &= number == expected and upto == length and digest == found
                expected += 1
                if last:
                    whole = kind == "revisit" and not length or length == http and stated == f"sha1:{found}"
                    out.append((record, kind, uri, refers, stated, http, length, found, sound and whole))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    return chunks.mapInArrow(run, "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, http_length long, payload_bytes long, payload_sha1 string, sound boolean")


def digests(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and gives per record what is read back.

    A response's length and digest are those of the bytes in its chunk rows, and must agree with its headers; a revisit's are
    from its headers. Repeated rows are records each; ties in page_id and html are all responses or all revisits; an empty
    table gives an empty one; other columns are ignored. Urls and html may be of any length.
    """
    path = common.scratch(pages.sparkSession, "warc")
    write(decide(pages), path)
    found = records(read_chunks(pages.sparkSession, path))

    def page(column: str):
        return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(.*)>$', 1) AS BIGINT)")

    response = F.col("record_type") == "response"
    return found.select(
        page("record_id").alias("page_id"),
        F.when(response, F.col("payload_bytes")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(~F.col("sound"), F.raise_error(F.concat(F.lit("broken record "), "record_id")))
        .when(response, F.col("payload_sha1"))
        .otherwise(F.regexp_replace("payload_digest", "^sha1:", ""))
        .alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


#: digests() of pages, in DuckDB's SQL: five hexadecimal digits at a time make four of base 32.
ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM q
"""
