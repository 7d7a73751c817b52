"""Image sources and sinks: format("nifti"), ("mat4"), ("nrrd"), ("bmp"), and ("dicom").

The Python data source reads with its own file system; read_images() does the same over Spark's binary file reader, which
opens whatever Spark opens. Both decode a file a row in the executors; columns that aren't asked for aren't decoded twice.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from . import formats

SCHEMA = "path string, name string, volume int, shape array<int>, vs array<double>, affine array<double>, data array<double>"
COLUMNS = pa.schema([("path", pa.string()), ("name", pa.string()), ("volume", pa.int32()), ("shape", pa.list_(pa.int32())), ("vs", pa.list_(pa.float64())), ("affine", pa.list_(pa.float64())), ("data", pa.list_(pa.float64()))])
EYE = [float(i % 5 == 0) for i in range(16)]


def decode(kind: str, path: str, raw: bytes, names: set[str] | None = None, volume: int | None = None) -> list[tuple]:
    """Rows of SCHEMA for one file."""
    if kind == "nifti":
        return [(path, None, r["volume"], r["shape"], r["vs"], r["affine"], r["data"]) for r in formats.read_nifti(raw, volume)]
    if kind == "mat4":
        return [(path, r["name"], 0, [r["rows"], r["cols"], 1], [1.0] * 3, EYE, r["data"]) for r in formats.read_mat4(raw, names) if names is None or r["name"] in names]
    if kind == "nrrd":
        r = formats.read_nrrd(raw)
        return [(path, None, 0, r["shape"], r["vs"], r["affine"], r["data"])]
    if kind == "bmp":
        r = formats.read_bmp(raw)
        return [(path, None, 0, r["shape"], [1.0] * 3, EYE, r["data"])]
    if kind == "dicom":
        r = formats.read_dicom(raw)
        return [(path, None, r["image_number"], r["shape"], r["vs"], r["affine"], r["data"])]
    raise ValueError(f"unknown format {kind!r}")


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([np.asarray(x) if i == 6 else x for x in c], COLUMNS.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], schema=COLUMNS)


def read_images(spark: SparkSession, kind: str, path: str, names: list[str] | None = None, volume: int | None = None, glob: str | None = None) -> DataFrame:
    """Images by Spark's own reader; glob is a file pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        files = files.option("pathGlobFilter", glob)
    wanted = set(names) if names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = decode(kind, p, raw, wanted, volume)
                if rows:
                    yield batch(rows)

    return files.load(path).select("path", "content").mapInArrow(run, SCHEMA)


@dataclass
class Files(InputPartition):
    paths: tuple


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


#: Bytes of files that one task reads, and what opening a file counts as.
TASK_BYTES, OPEN_BYTES = 128 << 20, 4 << 20
#: Files that a job has written carry its name; they count once a manifest of that job names them.
OWN = re.compile(r"-job[0-9a-f]{12}-[0-9a-f]{8}\.\w+$")
MANIFEST = "_images-"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def put(path: str, raw: bytes) -> None:
    """A file written whole, under its name only when all of it is there."""
    fs, p = _open(path)
    fs.create_dir(p.rsplit("/", 1)[0])
    draft = f"{p.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(draft, compression=None) as f:
        f.write(raw)
    fs.move(draft, p)


@dataclass
class Folder:
    """What counts of a folder of images.

    Each job ends with a manifest: the files that it wrote and, if it overwrites, those that count no longer. A file counts if
    a manifest names it, or if no job wrote it (files put there by hand), and if no manifest takes it out. So a job's files
    appear at once, an overwrite that fails before its manifest leaves the old files as they are, and what a failed or
    repeated task leaves behind never counts.
    """

    manifests: list[str]
    all: dict[str, int]  # file and size
    counts: list[str]

    @classmethod
    def of(cls, fs: pafs.FileSystem, root: str) -> Folder:
        info = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        found = {x.path: x.size for x in sorted(info, key=lambda x: x.path) if x.type == pafs.FileType.File}
        name = lambda p: p.rsplit("/", 1)[1]
        manifests = [p for p in found if name(p).startswith(MANIFEST)]
        wrote, gone = set(), set()
        for p in manifests:
            with fs.open_input_stream(p, compression=None) as f:
                m = json.loads(f.read())
            wrote.update(m["files"])
            gone.update(m["removed"])
        images = {p: n for p, n in found.items() if not name(p).startswith(("_", "."))}
        inner = lambda p: p[len(root.rstrip("/")) + 1 :]
        return cls(manifests, images, [p for p in images if inner(p) not in gone and (inner(p) in wrote or not OWN.search(p))])


class Reader(DataSourceReader):
    def __init__(self, kind: str, path: str):
        self.kind, self.path, self.names, self.volume = kind, path, None, None

    def pushFilters(self, filters):
        """Names and volumes prune what is decoded; Spark checks them again."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.names = {f.value}
            elif isinstance(f, In) and f.attribute == ("name",):
                self.names = set(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("volume",) and self.kind == "nifti":
                self.volume = f.value
            yield f

    def partitions(self) -> list[Files]:
        """Files dealt into tasks by their bytes, in the order of their names."""
        fs, p = _open(self.path)
        if fs.get_file_info(p).type == pafs.FileType.File:
            return [Files((p,))]
        folder = Folder.of(fs, p)
        out, held, size = [], [], 0
        for f in folder.counts:
            if held and size + folder.all[f] > TASK_BYTES:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(f)
            size += folder.all[f] + OPEN_BYTES
        return [*out, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        for path in partition.paths:
            with fs.open_input_stream(path, compression=None) as f:
                rows = decode(self.kind, path, f.read(), self.names, self.volume)
            if rows:
                yield batch(rows)


def encode(kind: str, r: dict) -> tuple[bytes, str]:
    """A row of SCHEMA as a file: its bytes and ending."""
    data, shape = np.asarray(r["data"], float), r["shape"]
    if kind == "nifti":
        return formats.write_nifti(data, shape, r["vs"], r["affine"]), "nii"
    if kind == "nrrd":
        return formats.write_nrrd(data, shape, affine=r["affine"]), "nrrd"
    if kind == "bmp":
        return formats.write_bmp(data, shape[0], shape[1]), "bmp"
    if kind == "mat4":
        return formats.write_mat4([{"name": r["name"] or "image", "rows": shape[0], "cols": shape[1] * shape[2], "data": data}]), "mat"
    if kind == "dicom":
        axes = np.array(r["affine"], float).reshape(4, 4)
        text = lambda v: "\\".join(f"{x:.9g}" for x in v)
        unit = axes[:3, :2] / np.maximum(np.linalg.norm(axes[:3, :2], axis=0), 1e-12)
        tags = {
            0x00200013: ("IS", str(r["volume"])),
            0x00280030: ("DS", text([r["vs"][1], r["vs"][0]])),
            0x00180050: ("DS", text([r["vs"][2]])),
            0x00200032: ("DS", text(axes[:3, 3])),
            0x00200037: ("DS", text(unit.T.ravel())),
        }
        return formats.write_dicom(data, shape[0], shape[1], tags), "dcm"
    raise ValueError(f"{kind} can't be written")


class Writer(DataSourceArrowWriter):
    """A file a row. Files don't count before the job's manifest is there; see Folder."""

    def __init__(self, kind: str, path: str, overwrite: bool = False):
        self.kind, self.path, self.overwrite, self.job = kind, path, overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root)
        done = Written()
        for b in iterator:
            for r in b.to_pylist():
                raw, ending = encode(self.kind, r)
                name = f"{r['name'] or 'image'}-{r['volume']}-job{self.job}-{uuid.uuid4().hex[:8]}.{ending}"
                with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                    f.write(raw)
                done.files.append(name)
        return done

    def _own(self, folder: Folder) -> list[str]:
        return [p for p in folder.all if f"-job{self.job}-" in p]

    def commit(self, messages) -> None:
        """The manifest, then what it has made useless: files taken out, older manifests, files of failed attempts."""
        fs, root = _open(self.path)
        fs.create_dir(root)
        folder, base = Folder.of(fs, root), root.rstrip("/")
        files = sorted(name for m in messages if m for name in m.files)
        removed = folder.counts if self.overwrite else []
        manifest = {"files": files, "removed": [p[len(base) + 1 :] for p in removed]}
        draft = f"{base}/.{self.job}.tmp"
        with fs.open_output_stream(draft, compression=None) as f:
            f.write(json.dumps(manifest).encode())
        fs.move(draft, f"{base}/{MANIFEST}{self.job}.json")
        kept = {f"{base}/{name}" for name in files}
        for p in [*removed, *(p for p in self._own(folder) if p not in kept), *(folder.manifests if self.overwrite else [])]:
            fs.delete_file(p)

    def abort(self, messages) -> None:
        fs, root = _open(self.path)
        for p in self._own(Folder.of(fs, root)):
            fs.delete_file(p)


class ImageSource(DataSource):
    KIND = ""

    @classmethod
    def name(cls) -> str:
        return cls.KIND

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.KIND, self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.KIND, self.options["path"], overwrite)


class Nifti(ImageSource):
    KIND = "nifti"


class Mat4(ImageSource):
    KIND = "mat4"


class Nrrd(ImageSource):
    KIND = "nrrd"


class Bmp(ImageSource):
    KIND = "bmp"


class Dicom(ImageSource):
    KIND = "dicom"


def register(spark: SparkSession) -> None:
    """Make the formats known; their readers prune by name and volume, which Spark has to be told to allow."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for s in (Nifti, Mat4, Nrrd, Bmp, Dicom):
        spark.dataSource.register(s)


def dicom_headers(files: DataFrame) -> DataFrame:
    """(path, tags, csa, pixel_bytes) of files (path, content); functions.dicom reads what they say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.map_(pa.int32(), pa.list_(pa.string())), pa.map_(pa.string(), pa.list_(pa.string())), pa.int64())
        for b in batches:
            got = [formats.read_dicom_header(raw) for raw in b.column(1).to_pylist()]
            columns = [b.column(0), [[*h["tags"].items()] for h in got], [[*h["csa"].items()] for h in got], [h["pixel_bytes"] for h in got]]
            yield pa.record_batch([pa.array(c, k) if isinstance(c, list) else c for c, k in zip(columns, kinds, strict=True)], ["path", "tags", "csa", "pixel_bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, tags map<int, array<string>>, csa map<string, array<string>>, pixel_bytes long")


def search_files(spark: SparkSession, path: str, wildcard: str = "*", recursive: bool = False) -> DataFrame:
    """(path, size) of files whose name fits a wildcard (* and ?), by Spark's listing: nothing is read."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", wildcard or "*")
    return files.load(path).select("path", F.col("length").alias("size"))


def search_dirs(spark: SparkSession, path: str, wildcard: str = "*") -> DataFrame:
    """(path) of folders in a folder whose name fits a wildcard and that hold a file somewhere."""
    from pyspark.sql import functions as F

    from ..functions.strings import match_wildcard

    root = path.split("://")[-1].removeprefix("file:").rstrip("/")
    below = search_files(spark, path, recursive=True).select(F.regexp_extract("path", rf"\Q{root}\E/([^/]+)/", 1).alias("d")).where("d <> ''").distinct()
    return below.where(match_wildcard(F.col("d"), wildcard or "*")).select(F.concat(F.lit(f"{root}/"), "d").alias("path"))


def read_text_file(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, line) of text files, a row a line in the order of the file."""
    from pyspark.sql import functions as F

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"\n\z", "").alias("value"))
    return whole.select("path", F.posexplode(F.split("value", "\n", -1)).alias("pos", "line"))


#: Rows and characters of values after which fields go on to Spark; a batch a file would cost more than reading it.
ROWS, TEXT = 10_000, 16 << 20


def tiff_tags(files: DataFrame) -> DataFrame:
    """(path, directory, tag, value): the fields of TIFF files (path, content), values as text."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["path", "directory", "tag", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for p, raw in zip(b.column(0), b.column(1), strict=True):
                p = p.as_py()
                for k, fields in enumerate(formats.read_tiff_tags(raw.as_py())):
                    for tag, v in sorted(fields.items()):
                        rows.append((p, k, tag, " ".join(map(str, v))))
                        size += len(rows[-1][3])
                        if len(rows) >= ROWS or size >= TEXT:
                            yield table(rows)
                            rows, size = [], 0
            if rows:
                yield table(rows)

    return files.select("path", "content").mapInArrow(run, "path string, directory int, tag int, value string")


def dicom_volume(slices: DataFrame, series: str = "name") -> DataFrame:
    """(series, shape, vs, affine, data): slices of one series in the order of their numbers.

    Slices at the beginning that look another way than the next are scouts and go. The third axis points from the first to
    the last slice.
    """
    from pyspark.sql import functions as F

    turn = F.transform(F.array(*[F.get("affine", i) for i in (0, 1, 4, 5, 8, 9)]), lambda v: F.round(v, 6))
    g = slices.groupBy(series).agg(F.sort_array(F.collect_list(F.struct("volume", turn.alias("turn"), "affine", "shape", "vs", "data"))).alias("s"))
    same = F.filter(F.sequence(F.lit(0), F.size("s") - 2, F.lit(1)), lambda i: F.get("s", i)["turn"] == F.get("s", i + 1)["turn"])
    first = F.when(F.size("s") < 2, F.lit(0)).otherwise(F.coalesce(F.get(same, 0), F.size("s") - 1))
    g = g.withColumn("s", F.slice("s", first + 1, F.size("s") - first))
    one, last = F.get("s", 0), F.get("s", F.size("s") - 1)
    a = lambda i: F.get(one["affine"], i)
    along = sum(((F.get(last["affine"], 4 * r + 3) - a(4 * r + 3)) * a(4 * r + 2) for r in range(3)), F.lit(0.0))
    affine = F.array(*[F.when(along < 0, -a(i)).otherwise(a(i)) if i % 4 == 2 and i < 12 else a(i) for i in range(16)])
    shape = F.array(F.get(one["shape"], 0), F.get(one["shape"], 1), F.size("s"))
    return g.select(series, shape.alias("shape"), one["vs"].alias("vs"), affine.alias("affine"), F.flatten(F.transform("s", lambda r: r["data"])).alias("data"))
