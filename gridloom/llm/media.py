"""Media columns: payloads kept as 8-bit grey PNG members of ZIP archives, and a data source that reads them back.

Writing: each task fills archives of its own (members stored, so a member's bytes are a plain range of the archive) and
reports them; each commit names its archives in a manifest of its own, so files of lost or repeated tasks are never read.
An append adds to the manifests before it; an overwrite's manifest says that those before it no longer count, then they
and their archives are deleted.
Reading: the driver plans partitions as byte ranges of archives from the manifests alone. A task reads its archive's
central directory and takes the members whose headers start in its range, in order of offset. A member that can't be read
or fails its checksum is read again at its offset from a newly opened file, on its own, without redoing others, after a
wait that doubles. With onError=row a member that stays unreadable is a row with an error and null media.
Batches of media go through Arrow, bounded in bytes.

Defined results: a null or empty text is 64 zero bytes; texts are padded with zero bytes to a multiple of 64; rows without
or with repeated doc_id each become a member; an empty table makes an empty archive folder; null media have null features.
Columns besides the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import new_dir, tune

WIDTH = 64
ARCHIVE_BYTES, ARCHIVE_MEMBERS, RANGE_BYTES, BATCH_BYTES, RETRIES, WAIT, LEVEL = 64 << 20, 60_000, 8 << 20, 4 << 20, 3, 0.1, 2
PNG = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, member string, archive string, offset long, media binary, error string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit PNG of WIDTH columns with the payload's bytes, padded, as samples; its length stands in a text chunk."""
    n = max(WIDTH, -(-len(payload) // WIDTH) * WIDTH)
    rows = np.zeros((n // WIDTH, WIDTH + 1), np.uint8)  # column 0: filter type 0
    flat = np.zeros(n, np.uint8)
    flat[: len(payload)] = np.frombuffer(payload, np.uint8)
    rows[:, 1:] = flat.reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, n // WIDTH, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"length\0" + str(len(payload)).encode()) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """(samples, length) of a PNG that to_png made; samples are rows of WIDTH bytes."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, length, shape = 8, [], None, None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            w, h, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
            shape = h, w
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"length\0"):
            length = int(body[7:])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("a filter type that isn't used here")
    return rows[:, 1:], shape[0] * shape[1] if length is None else length


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class ArchiveWriter:
    """A ZIP archive of stored members, written front to back."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.path, self.out, self.at, self.entries = path, fs.open_output_stream(path), 0, []

    def add(self, name: str, data: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(data)
        fixed = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, 0, 33, crc, len(data), len(data), len(raw), 0)
        self.entries.append((fixed, raw, self.at))
        self.out.write(b"PK\3\4" + fixed + raw + data)
        self.at += 30 + len(raw) + len(data)

    def close(self) -> int:
        parts = [b"PK\1\2" + struct.pack("<H", 20) + fixed + struct.pack("<HHHII", 0, 0, 0, 0, at) + raw for fixed, raw, at in self.entries]
        size = sum(map(len, parts))
        self.out.write(b"".join(parts) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(parts), len(parts), size, self.at, 0))
        self.out.close()
        return self.at + size + 22


def directory(f: pa.NativeFile) -> list[tuple[str, int, int, int]]:
    """(member, offset of its header, bytes, crc) from an archive's central directory."""
    total = f.size()
    f.seek(max(0, total - 65_557))
    tail = f.read()
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no central directory")
    n, size, start = struct.unpack_from("<HII", tail, at + 10)
    f.seek(start)
    raw, at, out = f.read(size), 0, []
    for _ in range(n):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("a damaged central directory")
        crc, packed, _, ln, lx, lc = struct.unpack_from("<IIIHHH", raw, at + 16)
        (offset,) = struct.unpack_from("<I", raw, at + 42)
        out.append((raw[at + 46 : at + 46 + ln].decode(), offset, packed, crc))
        at += 46 + ln + lx + lc
    return out


@dataclass
class Range(InputPartition):
    archive: str
    begin: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list = field(default_factory=list)


def manifests(fs: pafs.FileSystem, root: str) -> list[tuple[str, dict]]:
    """(file name, {"archives": [[name, bytes], ...], "replaces": bool}) of every commit, in order."""
    found = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.startswith("_commit-"))
    out = []
    for name in found:
        with fs.open_input_stream(f"{root}/{name}") as f:
            out.append((name, json.loads(f.read())))
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"].rstrip("/"), int(options.get("rangeBytes", RANGE_BYTES))
        self.wait = float(options.get("wait", WAIT))
        self.retries, self.batch_bytes, self.on_error = int(options.get("retries", RETRIES)), int(options.get("batchBytes", BATCH_BYTES)), options.get("onError", "fail")

    def archives(self) -> list[tuple[str, int]]:
        fs, root = _open(self.path)
        commits, named = manifests(fs, root), []
        for _, m in commits:
            named = ([] if m["replaces"] else named) + [(a, n) for a, n in m["archives"]]
        if commits:
            return named
        found = fs.get_file_info(pafs.FileSelector(root))
        return sorted((x.base_name, x.size) for x in found if x.base_name.endswith(".zip"))

    def partitions(self) -> list[Range]:
        return [Range(a, b, min(n, b + self.range_bytes)) for a, n in self.archives() for b in range(0, n, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, root = _open(self.path)
        path = f"{root}/{partition.archive}"
        opened: list = []

        def handle(anew: bool):
            if anew and opened:
                try:
                    opened.pop().close()
                except OSError:
                    pass
            if not opened:
                opened.append(fs.open_input_file(path))
            return opened[0]

        def again(what, *args):
            for k in range(self.retries + 1):
                if k:
                    time.sleep(self.wait * 2 ** (k - 1))
                try:
                    return what(handle(k > 0), *args)
                except (OSError, ValueError, struct.error) as e:
                    last = e
            raise last

        def member(f, offset: int, size: int, crc: int) -> bytes:
            f.seek(offset)
            head = f.read(30)
            if head[:4] != b"PK\3\4":
                raise ValueError("no member starts here")
            ln, lx = struct.unpack_from("<HH", head, 26)
            f.seek(offset + 30 + ln + lx)
            data = f.read(size)
            if len(data) != size or zlib.crc32(data) != crc:
                raise ValueError("a member's checksum")
            return data

        rows, held = [], 0
        for name, offset, size, crc in sorted(again(directory), key=lambda x: x[1]):
            if not partition.begin <= offset < partition.end:
                continue
            data = error = None
            try:
                data = again(member, offset, size, crc)
            except (OSError, ValueError, struct.error) as e:
                if self.on_error != "row":
                    raise OSError(f"{path}, member {name} at {offset}: {e}") from e
                error = str(e)
            doc = name.split("-", 1)[1].removesuffix(".png")
            rows.append((int(doc) if doc not in ("", "null") else None, name, partition.archive, offset, data, error))
            held += size
            if held >= self.batch_bytes:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "member", "archive", "offset", "media", "error"])


class ArchiveSink(DataSourceArrowWriter):
    """Takes (doc_id, payload) rows and stores each payload as a PNG member."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.overwrite = overwrite
        self.path, self.archive_bytes = options["path"].rstrip("/"), int(options.get("archiveBytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root)
        done, archive = Written(), None

        def end():
            done.archives.append((archive.path.rsplit("/", 1)[1], archive.close()))

        for b in iterator:
            for doc, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if archive is not None and (archive.at >= self.archive_bytes or len(archive.entries) >= ARCHIVE_MEMBERS):
                    end()
                    archive = None
                if archive is None:
                    archive = ArchiveWriter(fs, f"{root}/{uuid.uuid4().hex}.zip")
                archive.add(f"{len(archive.entries):05d}-{'null' if doc is None else doc}.png", to_png(payload or b""))
        if archive is not None:
            end()
        return done

    def commit(self, messages: list) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root)
        before = manifests(fs, root)
        number = 1 + max((int(name.split("-")[1]) for name, _ in before), default=0)
        mine = {"archives": sorted(a for m in messages if m for a in m.archives), "replaces": self.overwrite}
        with fs.open_output_stream(f"{root}/_commit-{number:08d}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(mine).encode())
        for name, m in before if self.overwrite else ():
            for gone in [a for a, _ in m["archives"]] + [name]:
                fs.delete_file(f"{root}/{gone}")

    def abort(self, messages: list) -> None:
        fs, root = _open(self.path)
        for m in messages:
            for name, _ in m.archives if m else ():
                fs.delete_file(f"{root}/{name}")


class MediaArchive(DataSource):
    """format("media_archive"): write (doc_id long, payload binary); read SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveSink:
        return ArchiveSink(self.options, overwrite)


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "append", **options: str) -> None:
    """Store each text's UTF-8 bytes as a media member under path, beside what is there or (mode overwrite) instead of it."""
    spark = docs.sparkSession
    tune(spark)
    spark.dataSource.register(MediaArchive)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows.write.format("media_archive").options(**options).mode(mode).save(path)


def read_media(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


def feature(samples: np.ndarray) -> str:
    """Size, mean, variance, mean step along rows and a 16-bin histogram of the samples, as text."""
    s = samples.astype(np.int64)
    n = s.size
    mean, step = int(s.sum()) * 10_000 // n, int(np.abs(np.diff(s, axis=1)).sum()) * 10_000 // n
    var = (int((s * s).sum()) * n - int(s.sum()) ** 2) * 100 // (n * n)
    return f"{s.shape[1]}x{s.shape[0]};mean={mean};var={var};step={step};hist=" + ",".join(map(str, np.bincount(s.ravel() >> 4, minlength=16)))


def media_features(media: DataFrame) -> DataFrame:
    """Decode each stored member and describe it."""

    def run(batches):
        for b in batches:
            out = []
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is None:
                    out.append((doc, *[None] * 7))
                    continue
                samples, n = from_png(data)
                payload = samples.tobytes()
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            if out:
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "media")
    write_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return media_features(read_media(spark, path))
