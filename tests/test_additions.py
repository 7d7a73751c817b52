"""Minimisers, staged registration, fields of view, file accessors, learners."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import dicom
from gridloom.functions import matrix as M
from gridloom.functions import vectors as V
from gridloom.layout import Grid, empty_grid
from gridloom.operators import ml, optimize, views
from gridloom.operators import registration as R
from gridloom.operators import resample
from gridloom.operators import segmentation as S
from gridloom.sources import formats, images


def grid(spark, a):
    """An array (z, y, x) as a grid of one image."""
    d, h, w = a.shape
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a.ravel())], "idx long, v double")
    return Grid(empty_grid(spark, [0], (w, h, d)).join(table, "idx").select("img", "x", "y", "z", "idx", "v"), (w, h, d))


def array(g):
    w, h, d = g.shape
    return np.array([r["v"] for r in g.df.orderBy("img", "idx").collect()]).reshape(-1, d, h, w)


def banana(points):
    return [100 * (p[1] - p[0] ** 2) ** 2 + (1 - p[0]) ** 2 for p in points]


def test_minimisers_reach_the_valley():
    low, high = np.array([-2.0, -2.0, 0.5]), np.array([2.0, 2.0, 0.5])
    x, value = optimize.lbfgs(banana, [-1.2, 1.0, 0.5], low, high, 1e-5, 200)
    assert value < 1e-3 and abs(x[0] - 1) < 0.05 and x[2] == 0.5
    y, slower = optimize.gradient_descent(banana, [-1.2, 1.0, 0.5], low, high, 1e-3, 30)
    assert slower < banana([[-1.2, 1.0]])[0] and (y >= low).all() and (y <= high).all()
    corner, _ = optimize.lbfgs(lambda ps: [p[0] + p[1] for p in ps], [0.0, 0.0], [-1.0, -3.0], [1.0, 1.0])
    assert corner.tolist() == [-1.0, -3.0]
    assert optimize.lbfgs(banana, [0.3, 0.3], [0.3, 0.3], [0.3, 0.3])[0].tolist() == [0.3, 0.3]
    g = optimize.gradient(banana, np.array([0.0, 0.0]), 1.0, np.array([1e-6, 0.0]))
    assert abs(g[0] + 2) < 1e-3 and g[1] == 0


def blob(shape, centre, turn=0.0):
    y, x = np.mgrid[: shape[0], : shape[1]].astype(float)
    u, v = x - centre[0], y - centre[1]
    c, s = np.cos(turn), np.sin(turn)
    return np.exp(-((c * u + s * v) ** 2) / 18 - (c * v - s * u) ** 2 / 5)[None] * 100


def test_costs_of_many_matrices_in_one_job(spark):
    a, b = grid(spark, blob((14, 16), (7.5, 6))), grid(spark, blob((14, 16), (9, 7)))
    eye = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]
    near = [1.0, 0, 0, 1.5, 0, 1, 0, 1.0, 0, 0, 1, 0]
    got = R.correlation_costs(a, b, [eye, near, [1.0, 0, 0, 100, 0, 1, 0, 0, 0, 0, 1, 0]])
    assert got[1] < 0.01 < got[0] and got[2] == 1.0
    for m, c in zip((eye, near), got, strict=False):
        moved = array(resample.resample_affine(b, a.shape, m))[0]
        if m is near:
            r = np.corrcoef(moved.ravel(), array(a)[0].ravel())[0, 1]
            assert abs(1 - r * r - c) < 1e-9


def test_registration_by_levels(spark):
    from gridloom.operators.affine_search import AffineSearch
    from gridloom.operators.alignment import Alignment

    fixed, moving = grid(spark, blob((20, 24), (12, 10))), grid(spark, blob((20, 24), (14.4, 8.5), 0.3))
    a = Alignment([moving], [fixed])
    start = a.correlations()[0]
    cost = a.linear_by_levels(AffineSearch("rigid", "correlation", samples=9, rounds=12, halved_from=15))
    assert cost < 0.02 and a.correlations()[0] > 0.98 > start and len(a.matrix) == 12 and abs(a.matrix[1]) > 0.1


def test_fields_of_view(spark):
    shape, vs = (20, 18, 16), (1.0, 1.0, 1.0)
    box = ((4, 4, 2), (16, 14, 12))
    m, size, _ = views.plan_views(box, shape, vs, (8, 8, 8), vs, "align_center")
    assert len(m) == 1 and size == (8, 8, 8) and m[0][3] == 6 and m[0][7] == 5 and m[0][11] == 3
    many, _, _ = views.plan_views(box, shape, vs, (8, 8, 8), vs, "sliding_window")
    assert len(many) == 9
    _, whole, mvs = views.plan_views(box, shape, vs, (8, 8, 8), vs, "image", (4, 4, 4))
    assert whole == (12, 12, 12) and mvs == (1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        views.plan_views(box, shape, vs, (8, 8, 8), vs, "other")
    a = np.random.default_rng(0).random((16, 18, 20))
    g = grid(spark, a)
    parts = [views.take_view(g, k, (8, 8, 8), vs) for k in many[:2]]
    back = array(views.blend_views(parts, many[:2], g))[0]
    weight = sum(array(resample.resample_affine(views.view_weights(p), g.shape, views.back_matrix(k)))[0] for p, k in zip(parts, many, strict=False))
    on = weight > 2e-6  # at its least weight a view counts as it is
    assert on.sum() >= 512 and np.allclose(back[on], a[on]) and (back[weight == 0] == 0).all()
    one = views.take_view(g, m[0], size, vs)
    assert np.allclose(array(one)[0], a[3:11, 5:13, 6:14])
    w = array(views.view_weights(one))[0]
    assert w.max() == 1.0 and w.min() >= 1e-6 and w[4, 4, 4] == 1.0


def test_segmentation_steps(spark):
    a = np.zeros((4, 10, 10))
    a[1:4, 2:8, 2:8] = np.random.default_rng(1).uniform(50, 90, (3, 6, 6))
    kinds, mask = S.preprocess([grid(spark, a)], "zscore_nonzero")
    v = array(kinds[0])[0]
    assert abs(v[v != 0].mean()) < 1e-9 and array(mask)[0].sum() > 0
    with pytest.raises(ValueError):
        S.preprocess([grid(spark, a)], "other")
    with pytest.raises(ValueError):
        S.postprocess(spark.createDataFrame([], "img long, idx long, ch int, p double"), kinds[0], "argmax")


def test_mat_records():
    values = np.linspace(-2, 5, 12)
    raw = formats.write_mat4([{"name": "a", "rows": 3, "cols": 4, "data": values, "sloped": True}, {"name": "n", "rows": 1, "cols": 3, "data": [1, 2, 300], "dtype": "i2"}, {"name": "t", "rows": 1, "cols": 5, "data": list(b"hello"), "dtype": "u1"}])
    m = formats.MatFile(raw)
    assert m.has("a") and not m.has("b") and m.index_of("n") == 3 and m.index_of("b") == 5
    assert m.shape("a") == (3, 4) and m.shape("b") is None and m.total_size("n") == 6 and m.total_size("b") == 0
    assert m.is_scaled("a") and not m.is_scaled("n") and m.sub_data("a", "slope") is not None and m.sub_data("n", "slope") is None
    assert m.type_compatible("n", "u2") and m.type_compatible("n", "i2") and not m.type_compatible("n", "f4")
    assert np.abs(m.read_as_type("a", "f8") - values).max() < 0.05 and m.read_as_type("b", "f8") is None
    assert m.read_as_vector("n", "i4") == [1, 2, 300] and m.read_as_value("n", "f4") == 1 and m.read_as_value("b", "f4") == 0
    assert m.to_text("t") == "hello" and m.info("n") == "n (short,1,3)=1 2 300" and m.info("a").startswith("a (unsigned char,3,4)=slope=") and m.read_as_type(99, "f4") is None


def test_headers_of_volumes():
    eye = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]
    assert formats.lps_affine(eye, (4, 5, 6)) == [-1.0, 0, 0, 3, 0, -1, 0, 4, 0, 0, 1, 0]
    assert formats.apply_codes((2, 3, 4), [0, 3, 5]) == (4, -2, 3) or formats.apply_codes((2, 3, 4), [0, 3, 5])[1] == -2
    assert formats.apply_codes(formats.apply_codes((2, 3, 4), [0, 3, 5]), [0, 3, 5], True) == (2, 3, 4)
    assert formats.bit_count(4) == 16 and formats.is_integer(512) and not formats.is_integer(16) and formats.is_int8(2) and not formats.is_int8(256)
    assert formats.compatible(4, 512) and formats.compatible(16, 16) and not formats.compatible(8, 16) and not formats.compatible(4, 8)
    assert formats.change_endian(struct.pack("<2I", 1, 258), 4) == struct.pack(">2I", 1, 258)
    with pytest.raises(ValueError):
        formats.read_tiff_tags(b"no image")
    big = b"MM\0*" + struct.pack(">IHHHIII", 8, 1, 282, 5, 1, 26, 0) + struct.pack(">II", 3, 2)
    assert formats.read_tiff_tags(big) == [{282: [(3, 2)]}]


def test_dicom_headers_and_volumes(spark, tmp_path):
    vec = {0x0018_9087: ("FD", 1000.0), 0x0019_1027: ("DS", "0\\0\\0\\0\\0.5\\-0.5")}
    ge = {0x0043_1039: ("IS", "100"), 0x0019_10BB: ("DS", "0"), 0x0019_10BC: ("DS", "3"), 0x0019_10BD: ("DS", "4")}
    said = {0x0043_1039: ("IS", "7"), 0x0020_4000: ("LT", "2000(0.1,0.2,-0.3)")}
    files = [("vec", vec), ("ge", ge), ("said", said), ("none", {}), ("odd", {0x0028_0030: ("DS", "x"), 0x0010_0010: ("PN", "é")})]
    rows = [(n, formats.write_dicom(np.arange(6), 3, 2, t)) for n, t in files]
    h = images.dicom_headers(spark.createDataFrame(rows, "path string, content binary"))
    t, c = F.col("tags"), F.col("csa")
    got = {r["path"]: r for r in h.select("path", dicom.btable(t, c).alias("b"), dicom.voxel_size(t).alias("vs"), dicom.orientation(t).alias("o"), dicom.affine(t).alias("a"), dicom.patient(t).alias("p"), dicom.image_dimension(t, c, F.col("pixel_bytes")).alias("d")).collect()}
    assert tuple(got["vec"]["b"]) == (1000.0, 0.0, 0.0, -0.5) and tuple(got["ge"]["b"]) == (500.0, 0.0, 3.0, -4.0) and tuple(got["said"]["b"]) == (2000.0, 0.1, 0.2, -0.3) and got["none"]["b"] is None
    assert got["none"]["vs"] == [1.0] * 3 and got["none"]["o"] is None and got["none"]["a"][:4] == [1.0, 0, 0, 0] and got["none"]["d"] == [3, 2, 1]
    assert got["none"]["p"] == "______" and got["odd"]["vs"] == [1.0] * 3 and not got["odd"]["p"].endswith("é")
    for k, (number, turn) in enumerate([(1, "0\\1\\0\\1\\0\\0"), (2, "1\\0\\0\\0\\1\\0"), (3, "1\\0\\0\\0\\1\\0"), (4, "1\\0\\0\\0\\1\\0")]):
        tags = {0x0020_0013: ("IS", str(number)), 0x0020_0037: ("DS", turn), 0x0020_0032: ("DS", f"5\\6\\{-k}"), 0x0028_0030: ("DS", "3\\2"), 0x0018_0050: ("DS", "1")}
        (tmp_path / f"{k}.dcm").write_bytes(formats.write_dicom([k] * 6, 3, 2, tags))
    v = images.dicom_volume(images.read_images(spark, "dicom", str(tmp_path), glob="*.dcm").withColumn("name", F.lit("a"))).first()
    assert v["shape"] == [3, 2, 3] and v["data"] == [1.0] * 6 + [2.0] * 6 + [3.0] * 6
    assert v["affine"] == [2.0, 0, 0, 5, 0, 3, 0, 6, 0, 0, -1, -1, 0, 0, 0, 1]


def test_private_headers_and_lossless_jpeg():
    csa = {"B_value": ["1000"], "DiffusionGradientDirection": ["0.1", "0.2", "0.3"], "Empty": []}
    assert formats.read_csa(formats.write_csa(csa)) == csa
    # a 3 x 2 image of 8 bits, predictor 1: codes of sizes 0 to 3 are 00, 01, 10, 110
    values, bits, left = [130, 131, 129, 130, 130, 137], "", {0: "00", 1: "01", 2: "10", 3: "110"}
    table = bytes([0, 0, 3, 1] + [0] * 13 + [0, 1, 2, 3])
    for i, v in enumerate(values):
        before = 128 if i == 0 else values[i - 3] if i % 3 == 0 else values[i - 1]
        d = v - before
        size = abs(d).bit_length()
        bits += left[size] + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "")
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\0")
    part = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    raw = b"\xff\xd8" + part(0xC3, struct.pack(">BHHBBBB", 8, 2, 3, 1, 1, 0x11, 0)) + part(0xC4, table) + part(0xDA, bytes([1, 1, 0, 1, 0, 0])) + data + b"\xff\xd9"
    assert formats.decode_lossless_jpeg(raw).ravel().tolist() == values


def test_learners(spark):
    rows = spark.createDataFrame([(i, float(i % 3) + 0.01 * (i % 7), i % 3) for i in range(90)], "id long, x double, label int")
    assert ml.subsample(rows, 20, 1).count() == 20 and ml.subsample(rows, 20, 1).collect() == ml.subsample(rows, 20, 1).collect() != ml.subsample(rows, 20, 2).collect()
    learn = lambda r: r.where("label = 1").agg(F.avg("x")).first()[0]
    models = ml.learn_one_vs_rest(rows, learn)
    score = lambda c: 1.0 / (1.0 + F.abs(F.col("x") - models[c]))
    assert ml.one_vs_rest(rows, [0, 1, 2], score).where("predicted = label").count() == 90
    x = 2.0 + 0.02
    weighed = ml.regress_one_vs_rest(rows.where("id = 2"), [0, 1, 2], score).first()["value"]
    assert np.isclose(weighed, sum(c / (1 + abs(x - models[c])) for c in (1, 2)) / 3)
    assert ml.regress_one_vs_rest(rows, [0], score).first()["value"] is None
    assert {r["predicted"] for r in ml.one_vs_rest(rows, [1, 2], lambda c: -F.col("x")).collect()} == {0}
    nearest = lambda model, r: r.withColumn("predicted", (F.abs(F.col("x") - model) < 0.5).cast("int"))
    assert ml.repeated_validation(rows.withColumn("label", (F.col("label") == 1).cast("int")), learn, nearest, runs=2) == 1.0


def test_shapes_and_small_matrices():
    assert V.expand((2, 3), 4) == (2, 3, 4) and V.reduce((2, 3, 4)) == (2, 3) and V.swap_dim((2, 3, 4), 0, 2) == (4, 3, 2) and V.round_up((5, 8, 1), (4, 4, 4)) == (8, 8, 4)
    assert V.slice_corners(2, 1.5, (4, 6, 8)) == [(-0.5, -0.5, 1.5), (3.5, -0.5, 1.5), (-0.5, 5.5, 1.5), (3.5, 5.5, 1.5)]
    assert M.jacobi_order(np.array([[0.0, 2, 1], [5, 0, 1], [0, 0, 3]])) == [1, 0, 2] and M.jacobi_order(np.zeros((2, 2))) is None
    assert np.linalg.eigvalsh(M.random_matrix(4, 1, True)).min() > 0 and np.abs(M.random_matrix(4, 1)).max() <= 1


def test_points_between_spaces(spark, tmp_path):
    from gridloom.operators.alignment import Alignment

    g = grid(spark, np.random.default_rng(2).random((4, 5, 6)))
    a = Alignment([g], [g], [1.0, 0, 0, 2.0, 0, 1.0, 0, -1.0, 0, 0, 1.0, 0.5])
    p = spark.createDataFrame([(0, 1, 2, 3)], "img long, x int, y int, z int")
    there = a.to_subject(p).first()
    assert (there["u"], there["v"], there["w"]) == (3.0, 1.0, 3.5)
    back = a.to_template(spark.createDataFrame([(0, 3.0, 1.0, 3.5)], "img long, x double, y double, z double")).first()
    assert np.allclose((back["u"], back["v"], back["w"]), (1, 2, 3)) and a.mapping().count() == g.size
    a.displacement = g.df.select("img", "x", "y", "z", F.lit(0.5).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    assert a.to_subject(p).first()["u"] == 3.5
    a.displacement, a.matrix = None, [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]
    a.export("file://" + str(tmp_path / "out"))
    images.register(spark)
    out = spark.read.format("nifti").load("file://" + str(tmp_path / "out")).first()
    assert out["shape"] == [6, 5, 4] and np.allclose(out["data"], array(g).ravel(), atol=1e-6)
