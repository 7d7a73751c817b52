"""Decoders and encoders of image files: bytes in, a dict with shape, voxel size, affine and values out.

Readers work on bytes, so any file system that Spark reads will do: `spark.read.format("binaryFile")` gives the content.
"""

from __future__ import annotations

import gzip
import re
import struct
import zlib

import numpy as np

#: NIfTI datatype codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def _gunzip(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def voxel_size(affine: list[float]) -> list[float]:
    return [float(np.sqrt(sum(affine[4 * r + c] ** 2 for r in range(3)))) for c in range(3)]


def quaternion_affine(b: float, c: float, d: float, q: list[float], pix: list[float], fac: float) -> list[float]:
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
    r = r * [pix[0], pix[1], pix[2] * (fac or 1.0)]
    return [*r[0], q[0], *r[1], q[1], *r[2], q[2], 0.0, 0.0, 0.0, 1.0]


def nifti_header(raw: bytes) -> dict:
    """What the first 540 bytes of a NIfTI-1 or NIfTI-2 file say (352 of the former will do)."""
    for end in "<>":
        size = struct.unpack_from(end + "i", raw)[0]
        if size in (348, 540):
            break
    else:
        raise ValueError("not a NIfTI header")
    if size == 348:
        dim = struct.unpack_from(end + "8h", raw, 40)
        kind, _ = struct.unpack_from(end + "2h", raw, 70)
        pix = struct.unpack_from(end + "8f", raw, 76)
        offset, slope, inter = struct.unpack_from(end + "3f", raw, 108)
        qform, sform = struct.unpack_from(end + "2h", raw, 252)
        quat = struct.unpack_from(end + "6f", raw, 256)
        srow = struct.unpack_from(end + "12f", raw, 280)
        descrip = raw[148:228]
    else:
        kind, _ = struct.unpack_from(end + "2h", raw, 12)
        dim = struct.unpack_from(end + "8q", raw, 16)
        pix = struct.unpack_from(end + "8d", raw, 104)
        (offset,) = struct.unpack_from(end + "q", raw, 168)
        slope, inter = struct.unpack_from(end + "2d", raw, 176)
        descrip = raw[240:320]
        qform, sform = struct.unpack_from(end + "2i", raw, 344)
        quat = struct.unpack_from(end + "6d", raw, 352)
        srow = struct.unpack_from(end + "12d", raw, 400)
    if kind not in NIFTI_TYPES:
        raise ValueError(f"datatype {kind} isn't supported")
    shape = [max(1, int(dim[i])) if i <= dim[0] else 1 for i in range(1, 5)]
    if sform > 0:
        affine = [*srow, 0.0, 0.0, 0.0, 1.0]
    elif qform > 0:
        affine = quaternion_affine(*quat[:3], list(quat[3:]), list(pix[1:4]), pix[0])
    else:
        affine = [pix[1] or 1, 0, 0, 0, 0, pix[2] or 1, 0, 0, 0, 0, pix[3] or 1, 0, 0, 0, 0, 1]
    return {
        "shape": shape[:3],
        "volumes": shape[3],
        "vs": [float(p) for p in pix[1:4]],
        "affine": [float(a) for a in affine],
        "is_mni": sform == 4,
        "dtype": NIFTI_TYPES[kind],
        "endian": end,
        "offset": int(offset or (352 if size == 348 else 544)),
        "slope": float(slope),
        "inter": float(inter),
        "descrip": descrip.split(b"\0")[0].decode("latin-1"),
    }


def scaled(v: np.ndarray, slope: float, inter: float) -> np.ndarray:
    """Stored values as doubles by scl_slope and scl_inter; a slope of 0 means none."""
    v = v.astype(float)
    return v * slope + inter if slope not in (0, 1) or (slope == 1 and inter != 0) else v


def read_nifti(raw: bytes, volume: int | None = None) -> list[dict]:
    """One dict for each 3D volume (or the one asked for), values scaled by scl_slope and scl_inter."""
    raw = _gunzip(raw)
    h = nifti_header(raw)
    n, dtype = h["shape"][0] * h["shape"][1] * h["shape"][2], np.dtype(h["endian"] + h["dtype"])
    out = []
    for k in range(h["volumes"]) if volume is None else [volume]:
        v = np.frombuffer(raw, dtype, n, h["offset"] + k * n * dtype.itemsize)
        out.append({"volume": k, **{c: h[c] for c in ("shape", "vs", "affine", "is_mni", "dtype", "descrip")}, "data": scaled(v, h["slope"], h["inter"])})
    return out


def write_nifti(data: np.ndarray, shape, vs=(1, 1, 1), affine=None, dtype: str = "f4", slope: float = 1.0, inter: float = 0.0, mni: bool = False, version: int = 1, descrip: str = "", end: str = "<", volumes: int = 1) -> bytes:
    """A single-file image; data are stored values in storage order."""
    code = {v: k for k, v in NIFTI_TYPES.items()}[dtype]
    affine = list(affine or [vs[0], 0, 0, 0, 0, vs[1], 0, 0, 0, 0, vs[2], 0])[:12]
    dims = [4 if volumes > 1 else 3, *shape, volumes, 1, 1, 1]
    head = bytearray(352 if version == 1 else 544)
    if version == 1:
        struct.pack_into(end + "i", head, 0, 348)
        struct.pack_into(end + "8h", head, 40, *dims)
        struct.pack_into(end + "2h", head, 70, code, 8 * np.dtype(dtype).itemsize)
        struct.pack_into(end + "8f", head, 76, 1, *vs, 1, 1, 1, 1)
        struct.pack_into(end + "3f", head, 108, 352, slope, inter)
        head[148 : 148 + len(descrip)] = descrip.encode("latin-1")[:80]
        struct.pack_into(end + "2h", head, 252, 0, 4 if mni else 1)
        struct.pack_into(end + "12f", head, 280, *affine)
        head[344:348] = b"n+1\0"
    else:
        struct.pack_into(end + "i", head, 0, 540)
        head[4:12] = b"n+2\0\r\n\x1a\n"
        struct.pack_into(end + "2h", head, 12, code, 8 * np.dtype(dtype).itemsize)
        struct.pack_into(end + "8q", head, 16, *dims)
        struct.pack_into(end + "8d", head, 104, 1, *vs, 1, 1, 1, 1)
        struct.pack_into(end + "q", head, 168, 544)
        struct.pack_into(end + "2d", head, 176, slope, inter)
        head[240 : 240 + len(descrip)] = descrip.encode("latin-1")[:80]
        struct.pack_into(end + "2i", head, 344, 0, 4 if mni else 1)
        struct.pack_into(end + "12d", head, 400, *affine)
    return bytes(head) + np.asarray(data).astype(end + dtype).tobytes()


def orientation_codes(affine: list[float]) -> list[int]:
    """Flips (0-2) and swaps (3 xy, 4 yz, 5 xz) that bring an affine to LPS order: swaps first, then flips."""
    r = np.array(affine).reshape(-1, 4)[:3, :3].copy()
    out = []
    for a, pairs in ((0, ((1, 3), (2, 5))), (1, ((2, 4),))):
        lead = int(np.abs(r[a]).argmax())
        for other, code in pairs:
            if lead == other:
                r[:, [a, other]] = r[:, [other, a]]
                out.append(code)
    for a in range(3):
        if (r[a, a] > 0) == (a < 2):  # left, posterior, superior: x and y fall, z rises
            out.append(a)
    return out


def lps_affine(affine: list[float], shape: tuple[int, int, int]) -> list[float]:
    """The affine that a file of an image in LPS order gets: x and y reversed, with the origin at their far ends."""
    a = [float(v) for v in affine]
    for axis in (0, 1):
        for r in range(3):
            a[4 * r + 3] += a[4 * r + axis] * (shape[axis] - 1) if r == axis else 0.0
            a[4 * r + axis] = -a[4 * r + axis]
    return a


def apply_codes(shape: tuple[int, ...], codes: list[int], reverse: bool = False) -> tuple[int, ...]:
    """A signed shape after flips (0-2, which turn the sign) and swaps (3 xy, 4 yz, 5 xz)."""
    out = list(shape)
    for c in reversed(codes) if reverse else codes:
        if c < 3:
            out[c] = -out[c]
        else:
            i, j = {3: (0, 1), 4: (1, 2), 5: (0, 2)}[c]
            out[i], out[j] = out[j], out[i]
    return tuple(out)


def bit_count(datatype: int) -> int:
    return 8 * np.dtype(NIFTI_TYPES[datatype]).itemsize


def is_integer(datatype: int) -> bool:
    return NIFTI_TYPES[datatype][0] != "f"


def is_int8(datatype: int) -> bool:
    return NIFTI_TYPES[datatype] == "u1"


def compatible(a: int, b: int) -> bool:
    """Whether values of one type are stored as the other's: the same, or whole numbers of one size."""
    return a == b or (is_integer(a) and is_integer(b) and bit_count(a) == bit_count(b))


#: MAT v4 number codes.
MAT_TYPES = {0: "f8", 1: "f4", 2: "i4", 3: "i2", 4: "u2", 5: "u1"}


def read_mat4(raw: bytes, names: set[str] | None = None) -> list[dict]:
    """Records (name, rows, cols, data in column order); payloads of other names are skipped, `.slope` and `.inter` are applied."""
    raw, at, out = _gunzip(raw), 0, []
    while at + 20 <= len(raw):
        end = "<" if struct.unpack_from("<I", raw, at)[0] < 5000 else ">"
        kind, rows, cols, imag, ln = struct.unpack_from(end + "5I", raw, at)
        name = raw[at + 20 : at + 20 + ln].rstrip(b"\0").decode("latin-1")
        dtype = np.dtype(end + MAT_TYPES[kind % 100 // 10])
        at += 20 + ln
        n = rows * cols
        base = re.sub(r"\.(slope|inter|mask)$", "", name)
        if names is None or base in names:
            out.append({"name": name, "rows": rows, "cols": cols, "dtype": dtype.str[1:], "text": bool(kind % 10), "data": np.frombuffer(raw, dtype, n, at).astype(float)})
        at += n * dtype.itemsize * (2 if imag else 1)
    by = {r["name"]: r for r in out}
    for r in out:
        slope, inter = by.get(r["name"] + ".slope"), by.get(r["name"] + ".inter")
        if slope is not None and inter is not None:
            k = np.repeat(slope["data"], len(r["data"]) // max(1, len(slope["data"])))
            r["data"] = r["data"] * k * (255.99 / 255) + np.repeat(inter["data"], len(r["data"]) // max(1, len(inter["data"])))
    return [r for r in out if not re.search(r"\.(slope|inter|mask)$", r["name"])]


def write_mat4(records: list[dict]) -> bytes:
    """Records {name, rows, cols, data, dtype}; sloped=True stores bytes with .slope and .inter beside them."""
    out = b""
    code = {v: 10 * k for k, v in MAT_TYPES.items()}

    def put(name: str, rows: int, cols: int, data, dtype: str) -> bytes:
        return struct.pack("<5I", code[dtype], rows, cols, 0, len(name) + 1) + name.encode() + b"\0" + np.asarray(data).astype("<" + dtype).tobytes()

    for r in records:
        data = np.asarray(r["data"], float).ravel()
        if r.get("sloped") and len(data):
            low, span = data.min(), float(data.max() - data.min()) or 1.0
            out += put(r["name"], r["rows"], r["cols"], np.clip((data - low) / span * 255.99, 0, 255).astype("u1"), "u1")
            out += put(r["name"] + ".slope", 1, 1, [span / 255.99], "f4") + put(r["name"] + ".inter", 1, 1, [low], "f4")
        else:
            out += put(r["name"], r["rows"], r["cols"], data, r.get("dtype", "f4"))
    return out


class MatFile:
    """The records of a file by name or number, decoded when asked for."""

    def __init__(self, raw: bytes):
        self.raw, self.records, at = _gunzip(raw), [], 0
        while at + 20 <= len(self.raw):
            end = "<" if struct.unpack_from("<I", self.raw, at)[0] < 5000 else ">"
            kind, rows, cols, imag, ln = struct.unpack_from(end + "5I", self.raw, at)
            name = self.raw[at + 20 : at + 20 + ln].rstrip(b"\0").decode("latin-1")
            dtype = np.dtype(end + MAT_TYPES[kind % 100 // 10])
            at += 20 + ln
            self.records.append({"name": name, "rows": rows, "cols": cols, "dtype": dtype, "at": at})
            at += rows * cols * dtype.itemsize * (2 if imag else 1)
        self.by_name = {r["name"]: i for i, r in enumerate(self.records)}

    def has(self, name: str) -> bool:
        return name in self.by_name

    def index_of(self, name: str) -> int:
        """The record's number; as many as there are for an unknown name."""
        return self.by_name.get(name, len(self.records))

    def shape(self, which: str | int) -> tuple[int, int] | None:
        """(rows, cols)."""
        r = self._find(which)
        return None if r is None else (r["rows"], r["cols"])

    def _find(self, which: str | int) -> dict | None:
        i = self.by_name.get(which) if isinstance(which, str) else which
        return self.records[i] if i is not None and 0 <= i < len(self.records) else None

    def total_size(self, which: str | int) -> int:
        """Bytes of a record's values."""
        r = self._find(which)
        return 0 if r is None else r["rows"] * r["cols"] * r["dtype"].itemsize

    def stored(self, which: str | int) -> np.ndarray | None:
        """Values as they are stored, by columns."""
        r = self._find(which)
        return None if r is None else np.frombuffer(self.raw, r["dtype"], r["rows"] * r["cols"], r["at"])

    def is_scaled(self, which: str) -> bool:
        return self.has(f"{which}.slope") and self.has(f"{which}.inter")

    def type_compatible(self, which: str | int, dtype: str) -> bool:
        """Whether the values are of a type, or whole numbers of 16 bits as that is."""
        r = self._find(which)
        return r is not None and (r["dtype"].str[1:] == dtype or {r["dtype"].str[1:], dtype} == {"i2", "u2"})

    def sub_data(self, which: str, part: str) -> np.ndarray | None:
        """Values of a record's part, such as slope or inter."""
        return self.stored(f"{which}.{part}")

    def read_as_type(self, which: str | int, dtype: str) -> np.ndarray | None:
        """Values converted to a type, scaled by their slope and inter; None for an unknown record."""
        r = self._find(which)
        if r is None:
            return None
        if not self.is_scaled(r["name"]):
            return self.stored(which).astype(dtype)
        return next(x for x in read_mat4(self.raw, {r["name"]}) if x["name"] == r["name"])["data"].astype(dtype)

    def read_as_value(self, which: str | int, dtype: str):
        """The first value; 0 without one."""
        v = self.read_as_type(which, dtype)
        return v[0] if v is not None and len(v) else np.dtype(dtype).type(0)

    def read_as_vector(self, which: str | int, dtype: str) -> list:
        v = self.read_as_type(which, dtype)
        return [] if v is None else v.tolist()

    def to_text(self, which: str | int, count: int = 10) -> str:
        """The first values; bytes of a short record that begins with a letter as text."""
        r, v = self._find(which), self.stored(which)
        if r["dtype"].str[1:] == "u1" and not self.is_scaled(r["name"]) and 0 < len(v) < 4096 and v[0]:
            return v.tobytes().decode("latin-1").replace("\n", " ")
        return " ".join(f"{x:g}" if r["dtype"].kind == "f" else str(x) for x in v[:count].tolist())

    def info(self, which: str | int) -> str:
        """A line on a record: name, type, rows, columns, parts and first values."""
        r = self._find(which)
        kind = {"f8": "double", "f4": "float", "i4": "int", "i2": "short", "u2": "unsigned short", "u1": "unsigned char"}[r["dtype"].str[1:]]
        parts = "".join(f"{p}={self.to_text(f'{r['name']}.{p}', 1)}, " for p in ("slope", "inter") if self.has(f"{r['name']}.{p}"))
        more = "..." if r["rows"] * r["cols"] > 10 and kind != "unsigned char" else ""
        return f"{r['name']} ({kind},{r['rows']},{r['cols']})={parts}{self.to_text(which)}{more}"


#: Tags of TIFF headers.
TIFF_TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273, "orientation": 274, "samples": 277, "rows_per_strip": 278, "strip_bytes": 279, "planar": 284}
#: Sizes of TIFF field types 1 to 12.
TIFF_SIZES = dict(enumerate((1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8), 1))


def read_tiff_tags(raw: bytes) -> list[dict[int, list]]:
    """The fields of every directory of a file: tag to values (numbers, pairs for fractions, text)."""
    end = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if end is None or struct.unpack_from(end + "H", raw, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    out, (at,) = [], struct.unpack_from(end + "I", raw, 4)
    while at and len(out) < 65_536:
        (n,) = struct.unpack_from(end + "H", raw, at)
        fields = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(end + "HHI", raw, at + 2 + 12 * k)
            size = TIFF_SIZES.get(kind, 0) * count
            start = at + 10 + 12 * k if size <= 4 else struct.unpack_from(end + "I", raw, at + 10 + 12 * k)[0]
            if kind == 2:
                fields[tag] = [raw[start : start + count].rstrip(b"\0").decode("latin-1")]
            elif kind in (5, 10):
                v = struct.unpack_from(f"{end}{2 * count}{'I' if kind == 5 else 'i'}", raw, start)
                fields[tag] = list(zip(v[::2], v[1::2], strict=True))
            elif kind in TIFF_SIZES:
                fields[tag] = list(struct.unpack_from(f"{end}{count}{'.BBHIQbBhiqfd'[kind]}", raw, start))
        out.append(fields)
        (at,) = struct.unpack_from(end + "I", raw, at + 2 + 12 * n)
    return out


def change_endian(raw: bytes, size: int) -> bytes:
    """Bytes of each value of a size in bytes the other way round."""
    return np.frombuffer(raw, np.uint8).reshape(-1, size)[:, ::-1].tobytes()


#: NRRD type names.
NRRD_TYPES = {"float": "f4", "double": "f8", "int": "i4", "unsigned int": "u4", "short": "i2", "unsigned short": "u2", "uchar": "u1", "unsigned char": "u1", "signed char": "i1"}


def read_nrrd(raw: bytes) -> dict:
    """Header map and values of a file with its data inside, raw or gzip."""
    head, _, body = raw.partition(b"\n\n")
    lines = head.decode("latin-1").replace("\r", "").split("\n")
    if not lines[0].startswith("NRRD"):
        raise ValueError("not an NRRD file")
    h = {k.strip(): v.strip() for x in lines[1:] if not x.startswith("#") and ":" in x for k, v in [re.split(r":=?\s*", x, maxsplit=1)]}
    sizes = [int(s) for s in h["sizes"].split()]
    if h.get("encoding", "raw") in ("gzip", "gz"):
        body = zlib.decompressobj(47).decompress(body)
    dtype = np.dtype((">" if h.get("endian") == "big" else "<") + NRRD_TYPES[h["type"]])
    rows = [[float(v) for v in r.split(",")] for r in re.findall(r"\(([^)]*)\)", h.get("space directions", ""))]
    origin = [float(v) for v in re.sub(r"[()]", "", h.get("space origin", "0,0,0")).split(",")]
    if len(rows) < 3:
        sp = [float(v) for v in h.get("spacings", "1 1 1").split()]
        rows = [[sp[i] if i == j and i < len(sp) else float(i == j) for j in range(3)] for i in range(3)]
    affine = [x for r in range(3) for x in (*[rows[c][r] for c in range(3)], origin[r])] + [0.0, 0.0, 0.0, 1.0]
    shape = (sizes + [1, 1, 1])[:3]
    return {"header": h, "shape": shape, "vs": voxel_size(affine), "affine": affine, "data": np.frombuffer(body, dtype, int(np.prod(sizes))).astype(float)}


def write_nrrd(data: np.ndarray, shape, dtype: str = "float", affine=None, packed: bool = False) -> bytes:
    a = affine or [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]
    dirs = " ".join(f"({a[c]:g},{a[4 + c]:g},{a[8 + c]:g})" for c in range(3))
    head = f"NRRD0004\ntype: {dtype}\ndimension: 3\nspace: left-posterior-superior\nsizes: {' '.join(map(str, shape))}\nspace directions: {dirs}\nendian: little\nencoding: {'gzip' if packed else 'raw'}\nspace origin: ({a[3]:g},{a[7]:g},{a[11]:g})\n\n"
    body = np.asarray(data).astype("<" + NRRD_TYPES[dtype]).tobytes()
    return head.encode() + (gzip.compress(body) if packed else body)


def read_bmp(raw: bytes) -> dict:
    """Pixels top row first: packed BGRA for 24 and 32 bits, grey for 8."""
    if raw[:2] != b"BM":
        raise ValueError("not a BMP file")
    (offset,) = struct.unpack_from("<I", raw, 10)
    w, h, _, bits = struct.unpack_from("<iiHH", raw, 18)
    step = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, step * abs(h), offset).reshape(abs(h), step)[:, : w * bits // 8]
    if h > 0:
        rows = rows[::-1]
    if bits == 8:
        v = rows.astype(np.int64)
    else:
        p = rows.reshape(abs(h), w, bits // 8).astype(np.int64)
        v = p[:, :, 0] + p[:, :, 1] * 256 + p[:, :, 2] * 65536
    return {"shape": [w, abs(h), 1], "bits": bits, "data": v.ravel()}


def write_bmp(data: np.ndarray, w: int, h: int, bits: int = 32) -> bytes:
    v = np.asarray(data, np.int64).reshape(h, w)[::-1]
    px = np.stack([v >> s & 255 for s in (0, 8, 16, 24)][: bits // 8], -1).astype(np.uint8) if bits > 8 else v.astype(np.uint8)
    rows = px.reshape(h, -1)
    body = np.pad(rows, [(0, 0), (0, -rows.shape[1] % 4)]).tobytes()
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if bits == 8 else b""
    offset = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", offset + len(body), 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, len(body), 0, 0, 0, 0) + palette + body


def read_bruker_parameters(text: str) -> dict[str, str]:
    """##$key=value entries; values that run over lines are joined."""
    out, key = {}, None
    for line in text.replace("\r", "").split("\n"):
        if line.startswith("$$"):
            continue
        if line.startswith("##"):
            k, _, v = line[2:].lstrip("$").partition("=")
            key = k
            out[key] = v.strip()
            if re.fullmatch(r"\([\d, ]+\)", out[key]):
                out[key] = ""
        elif key is not None:
            out[key] = (out[key] + " " + line.strip()).strip()
    return out


def read_bruker(raw: bytes, reco: str, visu: str) -> dict:
    """2dseq values; slices are divided by their slope over the largest one."""
    r, v = read_bruker_parameters(reco), read_bruker_parameters(visu)
    size = [int(x) for x in (v.get("VisuCoreSize") or r["RECO_size"]).split()]
    kind = {"_8BIT_UNSGN_INT": "u1", "_16BIT_SGN_INT": "i2", "_32BIT_SGN_INT": "i4", "_32BIT_FLOAT": "f4"}[r["RECO_wordtype"].strip()]
    data = np.frombuffer(raw, ("<" if r.get("RECO_byte_order", "littleEndian").startswith("little") else ">") + kind).astype(float)
    plane = size[0] * size[1]
    size = [*size, len(data) // plane] if len(size) == 2 else size
    slope = [float(x) for x in r.get("RECO_map_slope", "").split()]
    if len(slope) > 1:
        s = np.array(slope) / max(slope)
        data = (data.reshape(len(slope), -1) / s[:, None]).ravel()
    extent = [float(x) for x in v.get("VisuCoreExtent", "").split()]
    vs = [e / n for e, n in zip(extent, size, strict=False)] + [1.0] * 3
    return {"shape": size[:3], "vs": vs[:3], "data": data}


#: Value representations with a 4-byte length in explicit form, and binary number kinds.
DICOM_LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UN", b"UT", b"UC", b"UR", b"OV", b"SV", b"UV"}
#: Elements of pixels, and what they hold if not whole numbers.
DICOM_PIXELS = {0x7FE00010: "", 0x7FE00008: "f4", 0x7FE00009: "f8"}
DICOM_NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "FL": "f", "FD": "d"}


def _dicom_elements(raw: bytes, at: int, stop: int, explicit: bool, end: str, depth: int = 0) -> list[tuple[int, str, object]]:
    out = []
    while at + 8 <= stop:
        group, element = struct.unpack_from(end + "HH", raw, at)
        tag, vr = group << 16 | element, b""
        if group == 0xFFFE:
            (n,) = struct.unpack_from(end + "I", raw, at + 4)
            at += 8
            if element == 0xE000:
                until = at + n if n != 0xFFFFFFFF else stop
                items = _dicom_elements(raw, at, until, explicit, end, depth + 1)
                out.append((tag, "item", items))
                at = until if n != 0xFFFFFFFF else items[-1][2] if items and items[-1][1] == "end" else stop
                continue
            out.append((tag, "end", at))
            return out
        if explicit or group == 2:
            vr = raw[at + 4 : at + 6]
            if vr in DICOM_LONG:
                (n,) = struct.unpack_from(end + "I", raw, at + 8)
                at += 12
            else:
                (n,) = struct.unpack_from(end + "H", raw, at + 6)
                at += 8
        else:
            (n,) = struct.unpack_from(end + "I", raw, at + 4)
            at += 8
        if n == 0xFFFFFFFF and tag == 0x7FE00010:
            frames, at = [], at
            while True:
                _, e = struct.unpack_from(end + "HH", raw, at)
                (m,) = struct.unpack_from(end + "I", raw, at + 4)
                at += 8
                if e == 0xE0DD:
                    break
                frames.append(raw[at : at + m])
                at += m
            out.append((tag, "OB", frames[1:]))
            continue
        if vr == b"SQ" or n == 0xFFFFFFFF:
            until = at + n if n != 0xFFFFFFFF else stop
            items = _dicom_elements(raw, at, until, explicit, end, depth + 1)
            out.append((tag, "SQ", [i for i in items if i[1] == "item"]))
            at = until if n != 0xFFFFFFFF else items[-1][2] if items and items[-1][1] == "end" else stop
            continue
        out.append((tag, vr.decode("latin-1"), raw[at : at + n]))
        at += n
    return out


#: Binary kinds of tags where a file of implicit form doesn't say.
DICOM_IMPLICIT = {0x00280002: "US", 0x00280010: "US", 0x00280011: "US", 0x00280100: "US", 0x00280103: "US"}


def _dicom_open(raw: bytes) -> tuple[list[tuple[int, str, object]], str]:
    """(elements, byte order)."""
    at, meta = 132 if raw[128:132] == b"DICM" else 0, {}
    while at + 8 <= len(raw) and struct.unpack_from("<H", raw, at)[0] == 2:
        vr = raw[at + 4 : at + 6]
        n = struct.unpack_from("<I", raw, at + 8)[0] if vr in DICOM_LONG else struct.unpack_from("<H", raw, at + 6)[0]
        start = at + (12 if vr in DICOM_LONG else 8)
        meta[struct.unpack_from("<H", raw, at + 2)[0]] = raw[start : start + n]
        at = start + n
    syntax = meta.get(0x10, b"").rstrip(b"\0 ").decode()
    explicit = syntax != "1.2.840.10008.1.2" if syntax else raw[at + 4 : at + 6].isalpha()
    end = ">" if syntax == "1.2.840.10008.1.2.2" else "<"
    return _dicom_elements(raw, at, len(raw), explicit, end), end


def _dicom_text(tag: int, vr: str, value: bytes, end: str) -> str | None:
    """An element as text, numbers joined by backslashes; None for bytes without a reading."""
    kind = vr or DICOM_IMPLICIT.get(tag, "")
    if kind in DICOM_NUMBERS:
        c = DICOM_NUMBERS[kind]
        size = struct.calcsize(c)
        return "\\".join(f"{x:g}" if c in "fd" else str(x) for (x,) in struct.iter_unpack(end + c, value[: len(value) // size * size]))
    return None if kind in ("OB", "OW", "UN") else value.rstrip(b"\0 ").decode("latin-1").strip()


def read_dicom_header(raw: bytes) -> dict:
    """tags: every text a tag has, those inside sequences too, in order; csa: the private header; pixel_bytes."""
    elements, end = _dicom_open(raw)
    tags: dict[int, list[str]] = {}
    csa: dict[str, list[str]] = {}
    size, todo = 0, list(reversed(elements))
    while todo:
        tag, vr, value = todo.pop()
        if tag in DICOM_PIXELS:
            size = len(value) if isinstance(value, bytes) else sum(map(len, value))
        elif isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, bytes):
            if value[:4] == b"SV10":
                csa |= read_csa(value)
            elif (t := _dicom_text(tag, vr, value, end)) is not None:
                tags.setdefault(tag, []).append(t)
    return {"tags": tags, "csa": csa, "pixel_bytes": size}


def dicom_affine(orientation: list[float], position: list[float], vs: list[float]) -> list[float]:
    """Row-major 4x4 of a slice; axes of the grid where the file names none."""
    axes = np.eye(3)
    if len(orientation) >= 6:
        axes = np.array([orientation[:3], orientation[3:6], np.cross(orientation[:3], orientation[3:6])])
    m = np.eye(4)
    m[:3, :3] = axes.T * vs
    m[:3, 3] = position[:3] if len(position) >= 3 else 0
    return m.ravel().tolist()


def read_dicom(raw: bytes) -> dict:
    """Tags as text by number (group << 16 | element), and the pixels of an uncompressed or lossless-JPEG file."""
    elements, end = _dicom_open(raw)
    tags, pixels, real = {}, None, ""
    for tag, vr, value in elements:
        if tag in DICOM_PIXELS:
            pixels, real = value, DICOM_PIXELS[tag]
        elif isinstance(value, bytes) and (t := _dicom_text(tag, vr, value, end)) is not None:
            tags[tag] = t
    rows, cols = int(tags.get(0x00280010, 0)), int(tags.get(0x00280011, 0))
    bits, signed = int(tags.get(0x00280100, 16)), tags.get(0x00280103) == "1"
    dtype = np.dtype(end + (real or ("i" if signed else "u") + str(bits // 8)))
    if isinstance(pixels, list):
        data = np.concatenate([decode_lossless_jpeg(f).ravel() for f in pixels]).astype(float)
    else:
        data = np.frombuffer(pixels or b"", dtype, len(pixels or b"") // dtype.itemsize).astype(float)
    spacing = [float(x) for x in tags.get(0x00280030, "1\\1").split("\\")]
    thick = float(tags.get(0x00180088) or tags.get(0x00180050) or 1)
    frames = len(data) // max(1, rows * cols)
    vs = [spacing[1], spacing[0], thick]
    position, orientation = ([float(x) for x in tags.get(t, "").split("\\") if x] for t in (0x00200032, 0x00200037))
    return {"shape": [cols, rows, max(1, frames)], "vs": vs, "tags": tags, "data": data, "image_number": int(float(tags.get(0x00200013) or 0)), "position": position, "orientation": orientation, "affine": dicom_affine(orientation, position, vs), "slice_location": float(tags.get(0x00201041) or 0)}


def _dicom_pixels(v: np.ndarray) -> np.ndarray:
    """Values in the narrowest whole-number type that holds them all, doubles where none does."""
    if not v.size:
        return v.astype("<u2")
    low, high = v.min(), v.max()
    if v.dtype.kind != "f" or (np.isfinite([low, high]).all() and (v == np.floor(v)).all()):
        for t in ("<u2", "<i2", "<u4", "<i4", "<u8", "<i8"):
            if np.iinfo(t).min <= int(low) and int(high) <= np.iinfo(t).max:
                return v.astype(t)
    return v.astype("<f8")


def write_dicom(pixels: np.ndarray, w: int, h: int, tags: dict[int, tuple[str, object]] | None = None) -> bytes:
    """A file of explicit little-endian form; tags: number to (kind, text, number or bytes). Pixels are unsigned 16-bit numbers, or
    of the first type that holds all of them as they are."""
    stored = _dicom_pixels(np.asarray(pixels))
    bits, signed = 8 * stored.itemsize, int(stored.dtype.kind == "i")
    out = b"\0" * 128 + b"DICM"
    syntax = b"1.2.840.10008.1.2.1\0"
    out += struct.pack("<HH2sH", 2, 0x10, b"UI", len(syntax)) + syntax
    own = {0x00280002: ("US", 1), 0x00280010: ("US", h), 0x00280011: ("US", w), 0x00280100: ("US", bits), 0x00280103: ("US", signed)}
    at, kind = (0x7FE00009, "OD") if stored.dtype.kind == "f" else (0x7FE00010, "OV" if bits == 64 else "OW")
    for tag, (vr, value) in sorted((own | (tags or {}) | {at: (kind, stored.tobytes())}).items()):
        if vr in DICOM_NUMBERS:
            value = struct.pack("<" + DICOM_NUMBERS[vr], value)
        elif isinstance(value, str):
            value = value.encode("latin-1")
            value += b" " * (len(value) % 2)
        size = struct.pack("<HI", 0, len(value)) if vr.encode() in DICOM_LONG else struct.pack("<H", len(value))
        out += struct.pack("<HH2s", tag >> 16, tag & 0xFFFF, vr.encode()) + size + value
    return out


def write_csa(entries: dict[str, list[str]]) -> bytes:
    """A private header in its second form, as read_csa() reads it."""
    out = b"SV10\4\3\2\1" + struct.pack("<II", len(entries), 77)
    for name, values in entries.items():
        out += name.encode().ljust(64, b"\0") + struct.pack("<i4siii", len(values), b"IS\0\0", 0, len(values), 77)
        for v in values:
            raw = v.encode() + b"\0"
            out += struct.pack("<4i", len(raw), len(raw), 77, len(raw)) + raw.ljust((len(raw) + 3) // 4 * 4, b"\0")
    return out


def unmosaic(data: np.ndarray, w: int, h: int, tile_w: int, tile_h: int, n: int) -> np.ndarray:
    """Tiles of a mosaic as slices."""
    a = np.asarray(data).reshape(h // tile_h, tile_h, w // tile_w, tile_w).swapaxes(1, 2).reshape(-1, tile_h, tile_w)
    return a[:n].ravel()


def read_csa(raw: bytes) -> dict[str, list[str]]:
    """Name to values of a private header in its second form."""
    out, at = {}, 8 if raw[:4] == b"SV10" else 0
    (n,) = struct.unpack_from("<I", raw, at)
    at += 8
    for _ in range(n):
        name = raw[at : at + 64].split(b"\0")[0].decode("latin-1")
        vm, _, _, items = struct.unpack_from("<i4sii", raw, at + 64)
        at += 84
        values = []
        for _ in range(items):
            ln = struct.unpack_from("<4i", raw, at)[1]
            at += 16
            values.append(raw[at : at + ln].split(b"\0")[0].decode("latin-1").strip())
            at += (ln + 3) // 4 * 4
        out[name] = [v for v in values if v][: vm or None]
    return out


def decode_lossless_jpeg(raw: bytes) -> np.ndarray:
    """One component of a lossless JPEG image (process 14), predictors 1 to 7."""
    at, tables, bits, w, h, predictor, shift = 2, {}, 8, 0, 0, 1, 0
    while at < len(raw):
        marker, n = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body = raw[at + 4 : at + 2 + n]
        if marker == 0xC3:
            bits, h, w = struct.unpack_from(">BHH", body)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts, code, p = body[k + 1 : k + 17], 0, k + 17
                t = tables[body[k] & 15] = {}
                for ln, c in enumerate(counts, 1):
                    for _ in range(c):
                        t[ln, code] = body[p]
                        code, p = code + 1, p + 1
                    code <<= 1
                k = p
        elif marker == 0xDA:
            table = tables[body[2] >> 4]
            predictor, shift = body[-3], body[-1] & 15
            data = raw[at + 2 + n :].replace(b"\xff\x00", b"\xff")
            break
        at += 2 + n
    out = np.zeros((h, w), np.int64)
    acc = have = pos = 0

    def take(k: int) -> int:
        nonlocal acc, have, pos
        while have < k:
            acc = acc << 8 | (data[pos] if pos < len(data) else 0)
            pos, have = pos + 1, have + 8
        have -= k
        v = acc >> have & (1 << k) - 1
        acc &= (1 << have) - 1
        return v

    for y in range(h):
        for x in range(w):
            ln = code = 0
            while (ln, code) not in table:
                code, ln = code << 1 | take(1), ln + 1
                if ln > 16:
                    raise ValueError("a damaged code")
            size = table[ln, code]
            diff = 32768 if size == 16 else take(size) if size else 0
            if 0 < size < 16 and diff < 1 << size - 1:
                diff -= (1 << size) - 1
            a = out[y, x - 1] if x else 0
            b = out[y - 1, x] if y else 0
            c = out[y - 1, x - 1] if x and y else 0
            if not x and not y:
                p = 1 << bits - shift - 1
            elif not y:
                p = a
            elif not x:
                p = b
            else:
                p = (0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor]
            out[y, x] = p + diff & 0xFFFF
    return out << shift


def write_avi(frames: list[bytes], w: int, h: int, fps: int = 10) -> bytes:
    """Uncompressed 32-bit frames (bottom row first) with an index."""
    chunk = lambda k, b: k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2)
    n, size = len(frames), w * h * 4
    main = struct.pack("<14I", 1_000_000 // fps, size * fps, 0, 0x10, n, 0, 1, size, w, h, 0, 0, 0, 0)
    stream = b"vids" + b"DIB " + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, n, size, 0xFFFFFFFF, 0, 0, 0, w, h)
    fmt = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 32, 0, size, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", fmt)))
    body, index, at = b"movi", b"", 4
    for f in frames:
        index += b"00db" + struct.pack("<III", 0x10, at, len(f))
        body += chunk(b"00db", f)
        at += 8 + len(f) + len(f) % 2
    return chunk(b"RIFF", b"AVI " + head + chunk(b"LIST", body) + chunk(b"idx1", index))
