"""A media column: texts as lossless grey images in zip archives, behind a Spark data source.

The writer rolls archives of bounded size into a folder, one file after another in each task, with a list of each task's
archives, and commits a manifest of those lists; what failed or repeated tasks left behind is not in it. The reader
plans byte ranges over the lists, of which the driver sees no more than a name and a size each; a task reads the part of an
archive's directory (the zip central directory) that its range needs, opens the members whose headers begin in it, each by
its own offset and with its own retries, and streams them on as Arrow batches.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import common

#: Samples in a row of an image; payloads are whole rows.
WIDTH = 576
#: Bytes of an archive after which a task begins another.
ARCHIVE_BYTES = 64 << 20
#: Bytes of an archive that a reading task takes.
RANGE_BYTES = 16 << 20
#: Reading tasks at most; of more ranges, several are one task's, however many bytes there are.
MOST_RANGES = 50_000
#: Bytes of an archive after which the place in its directory is noted.
MARK_BYTES = 4 << 20
#: Bytes of media and payload in an outgoing batch, beside one member.
BATCH_BYTES = 4 << 20
RETRIES = 3
MANIFEST, LIST = "_manifest", "_archives"
SCHEMA = "doc_id long, media binary, payload binary, n_bytes long, feature string, error string"

_PNG = b"\x89PNG\r\n\x1a\n"
_LOCAL, _ENTRY, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
#: The zip fields that follow the signature of a local header and of a directory entry.
_LOCAL_FIELDS, _ENTRY_FIELDS, _END_FIELDS = "<5H3I2H", "<6H3I5H2I", "<4H2IH"


def pad(data: bytes) -> bytes:
    """Bytes of value 255, which UTF-8 never has, up to a positive multiple of WIDTH."""
    return data + b"\xff" * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image whose samples are the payload; unfiltered rows."""
    rows = len(payload) // WIDTH
    squeeze = zlib.compressobj(1)
    lines = []
    for at in range(0, len(payload), WIDTH * 1024):
        block = payload[at : at + WIDTH * 1024]
        lines.append(squeeze.compress(b"".join(b"\0" + block[i : i + WIDTH] for i in range(0, len(block), WIDTH))))
    lines.append(squeeze.flush())
    return _PNG + _chunk(b"IHDR", struct.pack(">2I5B", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", b"".join(lines)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image made by to_png; raises ValueError for any other bytes."""
    if media[:8] != _PNG:
        raise ValueError("not an image")
    at, data, width = 8, [], 0
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            width, depth, colour = *struct.unpack(">I", body[:4]), body[8], body[9]
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    raw = zlib.decompress(b"".join(data))
    if any(raw[:: width + 1]):
        raise ValueError("filtered rows")
    return b"".join(raw[i : i + width] for i in range(1, len(raw), width + 1))


def feature(payload: bytes) -> str:
    """Mean, deviation and sixteen-bin histogram of the samples, and a 64-cell brightness hash, as text."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    mean = float(x.mean())
    cells = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64) / np.diff(np.append(np.arange(64) * len(x) // 64, len(x)))
    bits = int("".join("1" if c > mean else "0" for c in cells), 2)
    return f"mean={mean:.4f};std={float(x.std()):.4f};hist={','.join(map(str, bins))};hash={bits:016x}"


def _store(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_list(store, root: str, task: str, archives: list[dict]) -> tuple[str, int]:
    """Writes the list of a task's archives; gives its name and the bytes in them."""
    name = f"{LIST}-{task}.json"
    with store.open_output_stream(f"{root}/{name}") as out:
        out.write(json.dumps(archives).encode())
    return name, sum(a["end"] for a in archives)


def write_manifest(path: str, messages) -> None:
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as out:
        out.write(json.dumps([m.list for m in messages if m is not None and m.list]).encode())


def delete_archives(path: str, messages) -> None:
    store, root = _store(path)
    for message in messages:
        if message is not None and message.list:
            try:
                for archive in read_list(store, root, message.list[0]):
                    store.delete_file(f"{root}/{archive['name']}")
                store.delete_file(f"{root}/{message.list[0]}")
            except OSError:
                pass


def read_list(store, root: str, name: str) -> list[dict]:
    with store.open_input_stream(f"{root}/{name}") as file:
        return json.loads(file.read())


def plan(path: str, range_bytes: int) -> list[InputPartition]:
    """Partitions of about range_bytes of the committed archives, or of more where there would be over MOST_RANGES."""
    from pyarrow import fs

    store, root = _store(path)
    lists = []
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(MANIFEST):
            with store.open_input_stream(info.path) as file:
                lists += json.loads(file.read())
    step = max(range_bytes, -(-sum(size for _, size in lists) // MOST_RANGES))
    found, spans, held = [], [], 0
    for name, size in lists:
        at = 0
        while at < size:
            taken = min(step - held, size - at)
            spans.append((name, at, at + taken))
            at, held = at + taken, held + taken
            if held == step:
                found.append(Spans(spans))
                spans, held = [], 0
    return [*found, Spans(spans)] if spans or not found else found


def archives_in(store, root: str, spans):
    """(archive, start, stop) for the parts of archives in spans of their lists' bytes."""
    for name, start, stop in spans:
        at = 0
        for archive in read_list(store, root, name):
            if at < stop and start < at + archive["end"]:
                yield archive, max(0, start - at), min(archive["end"], stop - at)
            at += archive["end"]


class Spans(InputPartition):
    """Bytes of lists of archives: (list, start, stop)."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.spans = spans


class Committed(WriterCommitMessage):
    """The list of a task's archives, as (name, bytes); None of a task without rows."""

    def __init__(self, found):
        self.list = found


class _Archive:
    """A zip file written in one pass: members stored as they are, the directory last."""

    def __init__(self, store, name: str):
        self.name, self.file, self.entries, self.at = name, store.open_output_stream(name), [], 0
        # (offset of a member, offset of its entry in the directory), now and then
        self.marks, self.listed = [(0, 0)], 0

    def add(self, name: str, media: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(media)
        if self.at - self.marks[-1][0] >= MARK_BYTES:
            self.marks.append((self.at, self.listed))
        fields = (20, 0x800, 0, 0, 33, crc, len(media), len(media), len(raw), 0)
        self.entries.append(_ENTRY + struct.pack(_ENTRY_FIELDS, 20, *fields, 0, 0, 0, 0, self.at) + raw)
        self.listed += len(self.entries[-1])
        for part in (_LOCAL + struct.pack(_LOCAL_FIELDS, *fields) + raw, media):
            self.file.write(part)
            self.at += len(part)

    def close(self) -> dict:
        directory, n = b"".join(self.entries), len(self.entries)
        self.file.write(directory)
        self.file.write(_END + struct.pack(_END_FIELDS, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), len(directory), self.at, 0))
        self.file.close()
        return {"name": self.name.rsplit("/", 1)[1], "members": n, "directory": self.at, "end": self.at + len(directory), "marks": [*self.marks, (self.at, len(directory))]}


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, archive_bytes: int):
        self.path, self.archive_bytes = path, archive_bytes

    def write(self, iterator):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        task, done, archive, n = uuid.uuid4().hex, [], None, 0
        for batch in iterator:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if archive is None:
                    archive = _Archive(store, f"{root}/{task}-{len(done):05d}.zip")
                media = to_png(pad((text.as_py() or "").encode("utf-8")))
                archive.add(f"{n:010d}-{'null' if doc_id is None else doc_id}.png", media)
                n += 1
                # 65,535 is the most members that the directory's end can count
                if archive.at >= self.archive_bytes or len(archive.entries) == 0xFFFF:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        return Committed(write_list(store, root, task, done) if done else None)

    def commit(self, messages):
        write_manifest(self.path, messages)

    def abort(self, messages):
        delete_archives(self.path, messages)


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self):
        return plan(self.path, self.range_bytes)

    def read(self, partition):
        kinds = pa.schema([("doc_id", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("n_bytes", pa.int64()), ("feature", pa.string()), ("error", pa.string())])
        store, root = _store(self.path)
        rows, held = [], 0
        for archive, start, stop in archives_in(store, root, partition.spans):
            path, marks = f"{root}/{archive['name']}", archive["marks"]
            # the part of the directory with all members that begin in start..stop
            first = max(place for at, place in marks if at <= start)
            last = min((place for at, place in marks if at >= stop), default=marks[-1][1])
            with store.open_input_file(path) as file:
                file.seek(archive["directory"] + first)
                for name, offset, size, crc in entries(file.read(last - first)):
                    if start <= offset < stop:
                        row = self.member(store, path, file, name, offset, size, crc)
                        rows.append(row)
                        held += len(row[1] or b"") + len(row[2] or b"")
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds.types)], schema=kinds)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds.types)], schema=kinds)

    def member(self, store, path, file, name, offset, size, crc):
        """A member by its offset. A failed read is tried again on a fresh handle; what stays broken gets a row with its error."""
        tag = name[11 : name.rindex(".")]
        doc_id = None if tag == "null" else int(tag)
        for attempt in range(RETRIES + 1):
            try:
                with store.open_input_file(path) if attempt else _borrowed(file) as own:
                    media = read_member(own, offset, size)
                if zlib.crc32(media) != crc:
                    raise ValueError("checksum differs")
                payload = from_png(media)
                # UTF-8 has no byte 255, so that what follows the last other byte is padding
                return doc_id, media, payload, len(payload.rstrip(b"\xff")), feature(payload), None
            except (OSError, ValueError, zlib.error, struct.error) as failed:
                error = f"{name} at {offset}: {failed}"
                time.sleep(0.05 * attempt)
        return doc_id, None, None, None, None, error


class _borrowed:
    def __init__(self, file):
        self.file = file

    def __enter__(self):
        return self.file

    def __exit__(self, *_):
        return False


def entries(directory: bytes):
    """(name, offset, size, crc) of each entry of a central directory."""
    at, head = 0, 4 + struct.calcsize(_ENTRY_FIELDS)
    while directory[at : at + 4] == _ENTRY:
        f = struct.unpack_from(_ENTRY_FIELDS, directory, at + 4)
        n_name, n_extra, n_comment = f[9], f[10], f[11]
        yield directory[at + head : at + head + n_name].decode(), f[15], f[7], f[6]
        at += head + n_name + n_extra + n_comment


def read_member(file, offset: int, size: int) -> bytes:
    head = 4 + struct.calcsize(_LOCAL_FIELDS)
    file.seek(offset)
    header = file.read(head)
    if header[:4] != _LOCAL:
        raise ValueError("no member begins here")
    n_name, n_extra = struct.unpack_from("<2H", header, head - 4)
    file.seek(offset + head + n_name + n_extra)
    media = file.read(size)
    if len(media) != size:
        raise ValueError("the archive is cut off")
    return media


class MediaArchive(DataSource):
    """Format media_archive. Options: path, archive_bytes (writing), range_bytes (reading)."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)))


def write(docs: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes doc_id and text of every row to archives in a folder.

    A null text is the empty text, a null doc_id stays null, repeated rows are members each, an empty table gives a
    folder without members; ties have no order to keep; other columns are ignored. A task holds one batch and one member at
    a time, so a text of any length takes memory in proportion to itself alone.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    spark.dataSource.register(MediaArchive)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain.write.format("media_archive").mode("append").option("archive_bytes", archive_bytes).save(path)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(doc_id, media, payload, n_bytes, feature, error): each committed member, with null contents and an error where it can't be read."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("range_bytes", range_bytes).load(path)


def digests(docs: DataFrame) -> DataFrame:
    """Writes docs to archives in the shared folder and gives per document the digests of what is read back.

    A member that stays unreadable fails the query: no row goes missing silently.
    """
    path = common.scratch(docs.sparkSession, "media")
    write(docs, path)
    back = read(docs.sparkSession, path)
    payload = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("payload"))
    return back.select("doc_id", "media", "n_bytes", "feature", payload.alias("payload")).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
