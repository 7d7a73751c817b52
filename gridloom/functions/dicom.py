"""Columns over DICOM headers: tags is MAP<INT, ARRAY<STRING>> (group << 16 | element to a text an occurrence), csa is
MAP<STRING, ARRAY<STRING>> of a private header.

Multiple values of a text are parted by a backslash. A missing tag gives the stated default, so no header stops a job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag(group: int, element: int) -> int:
    return group << 16 | element


def _all(tags: Column, group: int, element: int) -> Column:
    return F.element_at(tags, F.lit(tag(group, element)))


def text(tags: Column, group: int, element: int) -> Column:
    """The first occurrence's text, null without one."""
    return F.get(_all(tags, group, element), 0)


def text_all(tags: Column, group: int, element: int) -> Column:
    """All occurrences' texts, one behind the other."""
    return F.array_join(_all(tags, group, element), "")


def numbers(value: Column) -> Column:
    """The values of a text as doubles; what isn't a number is null."""
    return F.transform(F.split(value, r"\\"), lambda v: F.trim(v).try_cast("double"))


def number(tags: Column, group: int, element: int) -> Column:
    """The first number of a tag, 0 without one."""
    return F.coalesce(F.get(numbers(text(tags, group, element)), 0), F.lit(0.0))


def integer(tags: Column, group: int, element: int) -> Column:
    return number(tags, group, element).cast("int")


def frame_values(tags: Column, group: int, element: int) -> Column:
    """The first number of every occurrence, as frames of a file with many have it."""
    return F.transform(F.coalesce(_all(tags, group, element), F.array().cast("array<string>")), lambda t: F.get(numbers(t), 0))


def voxel_size(tags: Column) -> Column:
    """(x, y, z): pixel spacing is row distance first; z from the slice distance or thickness, 1 without; without spacing all are z."""
    first = lambda t: F.get(numbers(t), 0)
    z = F.coalesce(first(text(tags, 0x0018, 0x0088)), first(text(tags, 0x0018, 0x0050)), F.lit(1.0))
    xy = numbers(text(tags, 0x0028, 0x0030))
    return F.array(F.coalesce(F.get(xy, 1), z), F.coalesce(F.get(xy, 0), z), z)


def _axes(tags: Column) -> Column:
    return numbers(F.coalesce(text(tags, 0x0020, 0x0037), text(tags, 0x0020, 0x0035)))


def row_orientation(tags: Column) -> Column:
    """Unit vector along x, null without one."""
    return F.slice(_axes(tags), 1, 3)


def col_orientation(tags: Column) -> Column:
    return F.slice(_axes(tags), 4, 3)


def orientation(tags: Column) -> Column:
    """Nine numbers: x, y and their cross product; null without the first two."""
    v = _axes(tags)
    a = lambda i: F.get(v, i)
    cross = [a(1) * a(5) - a(2) * a(4), a(2) * a(3) - a(0) * a(5), a(0) * a(4) - a(1) * a(3)]
    return F.when(F.size(v) >= 6, F.concat(F.slice(v, 1, 6), F.array(*cross)))


def left_upper_pos(tags: Column) -> Column:
    """Position of the first pixel, zeros without one."""
    return F.coalesce(F.slice(numbers(text(tags, 0x0020, 0x0032)), 1, 3), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))


def affine(tags: Column) -> Column:
    """Row-major 4x4 from voxel indices to patient coordinates; spacing and position alone where there is no orientation."""
    o, vs, p = orientation(tags), voxel_size(tags), left_upper_pos(tags)
    eye = [float(i % 4 == 0) for i in range(9)]
    cell = lambda r, c: F.coalesce(F.get(o, 3 * c + r), F.lit(eye[3 * c + r])) * F.get(vs, c)
    rows = [x for r in range(3) for x in (cell(r, 0), cell(r, 1), cell(r, 2), F.get(p, r))]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def slice_location(tags: Column) -> Column:
    return number(tags, 0x0020, 0x1041)


def te(tags: Column) -> Column:
    return number(tags, 0x0018, 0x0081)


def btable(tags: Column, csa: Column) -> Column:
    """STRUCT<b, x, y, z> of a diffusion image, null for others: the private header first, then the makers' tags."""
    as_row = lambda b, x, y, z: F.struct(b.alias("b"), x.alias("x"), y.alias("y"), z.alias("z"))
    own = lambda name, i: F.get(F.element_at(csa, name), i).try_cast("double")
    private = as_row(own("B_value", 0), *(own("DiffusionGradientDirection", i) for i in range(3)))
    first = lambda t: F.get(numbers(t), 0)
    b = F.coalesce(*(first(text(tags, *t)) for t in ((0x0018, 0x9087), (0x0019, 0x100C), (0x0043, 0x1039), (0x0065, 0x1009))))
    v = numbers(F.coalesce(*(text(tags, *t) for t in ((0x0018, 0x9089), (0x0019, 0x100E), (0x0019, 0x1027), (0x0065, 0x1037)))))
    g = lambda i: F.get(v, i)
    zero = F.lit(0.0)
    # a vector of six that begins with zero holds its direction further on
    late = (F.size(v) >= 6) & (g(0) == 0)
    vector = F.when(late & (g(3) != 0), as_row(b, zero, g(3), g(4))).when(late, as_row(b, zero, zero, g(5))).when(F.size(v) >= 3, as_row(b, g(0), g(1), g(2)))
    x, y, z = (first(text(tags, 0x0019, e)) for e in (0x10BB, 0x10BC, 0x10BD))
    length = F.sqrt(x * x + y * y + z * z)
    parts = F.split(F.trim(F.regexp_replace(text(tags, 0x0020, 0x4000), r"[(),]", " ")), r"\s+")
    said = [F.get(parts, i).try_cast("double") for i in range(4)]
    other = F.when(b.isNull(), F.lit(None)).when(b == 0, as_row(b, zero, zero, zero)).when(v.isNotNull(), vector).when(x.isNotNull() & y.isNotNull() & z.isNotNull(), as_row(b * length, x, y, -z)).when(said[3].isNotNull(), as_row(*said))
    return F.when(own("B_value", 0).isNotNull() & own("DiffusionGradientDirection", 2).isNotNull(), private).otherwise(other)


def is_dwi(tags: Column, csa: Column) -> Column:
    return btable(tags, csa).isNotNull()


def clean_name(value: Column) -> Column:
    """Without blanks; characters that file names can't have become _."""
    return F.regexp_replace(F.replace(value, F.lit(" "), F.lit("")), r'[\\/:?"<>|^]', "_")


def patient(tags: Column) -> Column:
    """date_sexage_name; what is missing is _, a name beyond printable ASCII is left out."""
    date, sex, age, name = (F.coalesce(text(tags, *t), F.lit("_")) for t in ((0x0008, 0x0022), (0x0010, 0x0040), (0x0010, 0x1010), (0x0010, 0x0010)))
    plain = F.replace(name, F.lit(" "), F.lit(""))
    return F.concat(date, F.lit("_"), F.replace(sex, F.lit(" "), F.lit("")), age, F.when(plain.rlike(r"^[ -~]*$"), F.concat(F.lit("_"), clean_name(name))).otherwise(F.lit("")))


def sequence_id(tags: Column) -> Column:
    return clean_name(F.coalesce(text(tags, 0x0008, 0x103E), F.lit("")))


def sequence_num(tags: Column) -> Column:
    """Series number of two digits at least."""
    n = F.replace(F.coalesce(text(tags, 0x0020, 0x0011), F.lit("")), F.lit(" "), F.lit(""))
    return F.when(F.length(n) == 1, F.concat(F.lit("0"), n)).otherwise(n)


def sequence(tags: Column) -> Column:
    return F.concat(sequence_num(tags), F.lit("_"), sequence_id(tags))


def image_num(tags: Column) -> Column:
    return F.replace(F.coalesce(text_all(tags, 0x0020, 0x0013), F.lit("")), F.lit(" "), F.lit(""))


def image_name(tags: Column) -> Column:
    name = clean_name(F.coalesce(text(tags, 0x0008, 0x103E), F.lit("_")))
    return F.concat(name, F.lit("_i"), image_num(tags), F.lit(".dcm"))


def width(tags: Column) -> Column:
    return integer(tags, 0x0028, 0x0011)


def height(tags: Column) -> Column:
    return integer(tags, 0x0028, 0x0010)


def frame_num(tags: Column) -> Column:
    return integer(tags, 0x0028, 0x0008)


def bit_count(tags: Column) -> Column:
    return integer(tags, 0x0028, 0x0100)


def is_signed(tags: Column) -> Column:
    return integer(tags, 0x0028, 0x0103) != 0


def image_dimension(tags: Column, csa: Column, pixel_bytes: Column) -> Column:
    """(w, h, d): the tiles of a mosaic where the header counts some, else as many planes as the pixels fill."""
    n = F.coalesce(F.get(F.element_at(csa, "NumberOfImagesInMosaic"), 0).try_cast("int"), integer(tags, 0x0019, 0x100A))
    w, h, side = width(tags), height(tags), F.ceil(F.sqrt(n))
    plane = w.cast("long") * h * F.floor(bit_count(tags) / 8)
    depth = F.coalesce(F.try_divide(pixel_bytes, F.when(plane > 0, plane)).cast("int"), F.lit(1))
    return F.when(n > 0, F.array((w / side).cast("int"), (h / side).cast("int"), n)).otherwise(F.array(w, h, depth))


def report(tags: Column) -> Column:
    """A line a tag, in the order of tags: (group,element) =text."""
    line = lambda k: F.concat(F.format_string("(%04X,%04X) =", F.shiftright(k, 16).bitwiseAND(0xFFFF), k.bitwiseAND(0xFFFF)), F.array_join(F.element_at(tags, k), "\\"))
    return F.array_join(F.transform(F.array_sort(F.map_keys(tags)), line), "\n")
