"""Ranges of gzip files without inflating what comes before, and planes of NIfTI volumes read that way.

A deflate stream can be taken up at the start of any of its blocks, given the bit at which it starts and the 32 KB before it.
gzip_index() inflates each file once, piece by piece, and gives a table with such an access point about each 8 MB of
inflated bytes: a row is an interval that a task can inflate on its own. The table is meant to be kept beside the files. It is
built with the machine's zlib, whose Python binding doesn't stop at blocks; reading from it needs Python alone.

read_planes() is a plan over that table: rows whose intervals hold no plane that is asked for are filtered out before any
file is opened, the others are dealt over tasks by the bytes they inflate, and a task holds one plane at a time.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .formats import nifti_header, scaled
from .images import _open

#: Inflated bytes between access points, and bytes of a file that are read at once.
SPACING, PIECE = 8 << 20, 1 << 20
#: Inflated bytes that a task reads.
TASK_BYTES = 128 << 20
HISTORY = 32_768
#: The first inflated bytes, which the row of a file's first access point keeps: a NIfTI-2 header.
HEAD = 540
INDEX = "path string, begin long, end long, at long, bits int, history binary, head binary"
PLANES = "path string, volume int, z int, shape array<int>, vs array<double>, affine array<double>, data array<double>"

#: Fixed values of zlib's interface: stop at blocks, results of a call.
Z_BLOCK, Z_OK, Z_STREAM_END, Z_BUF_ERROR = 5, 0, 1, -5


class _Stream(ctypes.Structure):
    _fields_ = [
        ("next_in", ctypes.c_void_p),
        ("avail_in", ctypes.c_uint),
        ("total_in", ctypes.c_ulong),
        ("next_out", ctypes.c_void_p),
        ("avail_out", ctypes.c_uint),
        ("total_out", ctypes.c_ulong),
        ("msg", ctypes.c_char_p),
        ("state", ctypes.c_void_p),
        ("zalloc", ctypes.c_void_p),
        ("zfree", ctypes.c_void_p),
        ("opaque", ctypes.c_void_p),
        ("data_type", ctypes.c_int),
        ("adler", ctypes.c_ulong),
        ("reserved", ctypes.c_ulong),
    ]


def _zlib() -> ctypes.CDLL:
    name = ctypes.util.find_library("z") or "libz.so.1"
    try:
        lib = ctypes.CDLL(name)
    except OSError as e:
        raise RuntimeError("an index of a gzip file is built with the zlib library, which this machine lacks") from e
    lib.zlibVersion.restype = ctypes.c_char_p
    return lib


def access_points(pieces: Iterator[bytes], spacing: int = SPACING) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(begin, at, bits, history, head) of a gzip file given in pieces, and at its end (size, -1, 0, b"", b"").

    begin: the inflated byte at which a block starts. at: the file's next whole byte, of which `bits` bits of the byte before
    belong to the block; bits is -1 where `at` is the start of a gzip member's header.
    """
    lib, s = _zlib(), _Stream()
    out = ctypes.create_string_buffer(HISTORY)
    if lib.inflateInit2_(ctypes.byref(s), 31, lib.zlibVersion(), ctypes.sizeof(s)) != Z_OK:
        raise RuntimeError("zlib didn't start")
    try:
        inflated = read = last = 0
        history, head, first, fresh = b"", b"", (0, 0, -1, b""), True
        for piece in pieces:
            data = ctypes.create_string_buffer(piece, len(piece))
            s.next_in, s.avail_in = ctypes.addressof(data), len(piece)
            while s.avail_in:
                if fresh and inflated and inflated - last >= spacing:
                    yield inflated, read + len(piece) - s.avail_in, -1, b"", b""
                    last = inflated
                fresh = False
                s.next_out, s.avail_out = ctypes.addressof(out), HISTORY
                result = lib.inflate(ctypes.byref(s), Z_BLOCK)
                got = out.raw[: HISTORY - s.avail_out]
                inflated, history = inflated + len(got), (history + got)[-HISTORY:]
                if first and len(head) < HEAD:
                    head += got[: HEAD - len(head)]
                if result == Z_STREAM_END:
                    fresh, history = True, b""
                    lib.inflateReset(ctypes.byref(s))
                elif result not in (Z_OK, Z_BUF_ERROR):
                    raise ValueError(f"not a gzip file, or a damaged one: {s.msg}")
                if first and (len(head) == HEAD or inflated > HEAD):
                    yield *first, head
                    first = None
                at_block = s.data_type & 128 and not s.data_type & 64
                if not fresh and at_block and inflated - last >= spacing:
                    yield inflated, read + len(piece) - s.avail_in, s.data_type & 7, history, b""
                    last = inflated
                if result == Z_BUF_ERROR and not got:
                    break
            read += len(piece)
        if not fresh:
            raise ValueError("a gzip file that ends early")
        if first:
            yield *first, head
        yield inflated, -1, 0, b"", b""
    finally:
        lib.inflateEnd(ctypes.byref(s))


def pieces_of(path: str, at: int = 0, size: int = PIECE) -> Iterator[bytes]:
    fs, p = _open(path)
    with fs.open_input_file(p) as f:
        f.seek(at)
        while piece := f.read(size):
            yield piece


def gzip_index(spark: SparkSession, path: str, spacing: int = SPACING, glob: str = "*.gz") -> DataFrame:
    """INDEX rows of the gzip files in a folder (or of one file): one an interval, a file a task at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path")

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                before = None
                for point in access_points(pieces_of(name), spacing):
                    if before and point[0] > before[0]:
                        begin, at, bits, history, head = before
                        cols = [[name], [begin], [point[0]], [at], [bits], [zlib.compress(history, 1)], [head or None]]
                        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])
                    before = point

    return files.mapInArrow(run, INDEX)


def shifted(pieces: Iterator[bytes], bits: int) -> Iterator[bytes]:
    """A stream of bytes from bit 8 - bits of its first byte on, as whole bytes."""
    if not bits:
        yield from pieces
        return
    left, low = b"", 8 - bits
    for piece in pieces:
        data = np.frombuffer(left + piece, np.uint8).astype(np.uint16)
        yield ((data[:-1] >> low | data[1:] << bits) & 255).astype(np.uint8).tobytes()
        left = piece[-1:]
    if left:
        yield bytes([left[0] >> low])


def _members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Inflated bytes of gzip members one after the other; what follows the last one is ignored."""
    d = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            if d.eof:
                d = zlib.decompressobj(31)
            yield d.decompress(piece)
            piece = d.unused_data


def inflate_from(path: str, at: int, bits: int, history: bytes) -> Iterator[bytes]:
    """Inflated bytes of a file from an access point to its end, in pieces."""
    if bits < 0:
        yield from _members(pieces_of(path, at))
        return
    start = at - (1 if bits else 0)
    d, fed = zlib.decompressobj(-15, zdict=history), 0
    for piece in shifted(pieces_of(path, start), bits):
        yield d.decompress(piece)
        fed += len(piece)
        if d.eof:
            break
    if not d.eof:
        raise ValueError(f"{path} ends early")
    # the stream ends within a byte; its checksum and length take eight more, and then another member may start
    end = start + fed - len(d.unused_data)
    for next_ in (end + 8, end + 9):
        magic = next(pieces_of(path, next_, 3), b"")
        if magic == b"\x1f\x8b\x08":
            yield from _members(pieces_of(path, next_))
            return


def read_range(path: str, begin: int, at: int, bits: int, history: bytes, start: int, size: int) -> bytes:
    """Inflated bytes [start, start + size) of a file, by the access point at `begin`, which comes before."""
    out, here = bytearray(), begin
    for piece in inflate_from(path, at, bits, history):
        low = max(0, start - here)
        out += piece[low : max(low, start + size - here)]
        here += len(piece)
        if here >= start + size:
            break
    return bytes(out)


def layouts(index: DataFrame) -> DataFrame:
    """(path, shape, volumes, vs, affine, dtype, offset, slope, inter) of the NIfTI files of an index, from its heads."""

    def run(batches):
        for b in batches:
            rows = [{"path": p, **nifti_header(h)} for p, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if rows:
                out = [{**{k: r[k] for k in ("path", "shape", "volumes", "vs", "affine", "offset", "slope", "inter")}, "dtype": r["endian"] + r["dtype"]} for r in rows]
                kinds = [("path", pa.string()), ("shape", pa.list_(pa.int32())), ("volumes", pa.int32()), ("vs", pa.list_(pa.float64())), ("affine", pa.list_(pa.float64())), ("dtype", pa.string()), ("offset", pa.int64()), ("slope", pa.float64()), ("inter", pa.float64())]
                yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return index.where("head IS NOT NULL").select("path", "head").mapInArrow(run, "path string, shape array<int>, volumes int, vs array<double>, affine array<double>, dtype string, offset long, slope double, inter double")


def intervals(index: DataFrame, z: tuple[int, int] | None = None, volumes: tuple[int, int] | None = None) -> DataFrame:
    """Index rows with their file's layout and the planes that begin in them, p0 up to p1, counted over all volumes; only rows
    with a plane of the half-open ranges asked for."""
    width = F.when(F.col("dtype").rlike("1$"), 1).when(F.col("dtype").rlike("2$"), 2).when(F.col("dtype").rlike("4$"), 4).otherwise(8)
    rows = index.drop("head").join(layouts(index), "path")
    depth = F.get("shape", 2).cast("long")
    rows = rows.withColumns({"plane_bytes": (F.get("shape", 0).cast("long") * F.get("shape", 1) * width), "depth": depth})
    from_ = lambda c: F.greatest(F.ceil((F.col(c) - F.col("offset")) / F.col("plane_bytes")), F.lit(0))
    rows = rows.withColumns({"p0": from_("begin"), "p1": F.least(from_("end"), F.col("depth") * F.col("volumes"))}).where("p1 > p0")
    if z:
        n, first = F.col("p1") - F.col("p0"), F.col("p0") % F.col("depth")
        here, next_volume = (first < z[1]) & (first + n > z[0]), first + n > F.col("depth") + z[0]
        rows = rows.where((n >= F.col("depth")) | here | next_volume)
    if volumes:
        rows = rows.where((F.floor(F.col("p0") / F.col("depth")) < volumes[1]) & (F.floor((F.col("p1") - 1) / F.col("depth")) >= volumes[0]))
    return rows


def read_planes(index: DataFrame, z: tuple[int, int] | None = None, volumes: tuple[int, int] | None = None) -> DataFrame:
    """PLANES rows of the gzipped NIfTI files of an index: planes z[0] up to but without z[1], of volumes likewise."""
    spark = index.sparkSession
    rows = intervals(index, z, volumes)
    total, n = rows.agg(F.sum(F.col("end") - F.col("begin")), F.count("*")).first()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-(total or 0) // TASK_BYTES))))
    dealt = rows.repartition(tasks).select("path", "begin", "at", "bits", "history", "shape", "vs", "affine", "dtype", "offset", "slope", "inter", "plane_bytes", "depth", "p0", "p1")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                yield from _planes(r, z, volumes)

    return dealt.mapInArrow(run, PLANES)


def _planes(r: dict, z, volumes) -> Iterator[pa.RecordBatch]:
    wanted = []
    for p in range(r["p0"], r["p1"]):
        v, k = divmod(p, r["depth"])
        if (not z or z[0] <= k < z[1]) and (not volumes or volumes[0] <= v < volumes[1]):
            wanted.append((p, v, k))
    if not wanted:
        return
    held, here = bytearray(), r["begin"]
    stream = inflate_from(r["path"], r["at"], r["bits"], zlib.decompress(r["history"]))
    for p, v, k in wanted:
        start = r["offset"] + p * r["plane_bytes"]
        while here + len(held) < start + r["plane_bytes"]:
            piece = next(stream, None)
            if piece is None:
                raise ValueError(f"{r['path']} ends before plane {k} of volume {v}")
            held += piece
            drop = max(0, min(len(held), start - here))
            del held[:drop]
            here += drop
        raw = bytes(held[start - here : start - here + r["plane_bytes"]])
        data = scaled(np.frombuffer(raw, r["dtype"]), r["slope"], r["inter"])
        cols = [[r["path"]], [v], [k], [r["shape"][:2]], [r["vs"]], [r["affine"]], [data]]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in PLANES.split(", ")])


def inflated_sizes(index: DataFrame) -> DataFrame:
    """(path, points, size): access points and inflated bytes of each file."""
    return index.groupBy("path").agg(F.count("*").alias("points"), F.max("end").alias("size"))


def gaps(index: DataFrame) -> DataFrame:
    """Rows of an index that don't begin where the one before ends; a whole index has none."""
    w = Window.partitionBy("path").orderBy("begin")
    return index.withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0))).where("begin <> before").drop("before")
