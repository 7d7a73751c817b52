"""Parts that have no SQL: parsing, headers, file formats, numpy operators, registration, streams."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import strings as S
from gridloom.functions import transform as T
from gridloom.layout import Grid, empty_grid
from gridloom.operators import geometry as G
from gridloom.operators import ml, network, per_image, registration, stats
from gridloom.plans.commands import CommandError, command, run
from gridloom.plans.expression import ExpressionError, evaluate
from gridloom.sources import formats as FM
from gridloom.sources import images
from gridloom.streaming import running


def grid(spark, values, shape):
    values = np.asarray(values).ravel()
    df = empty_grid(spark, [0], shape)
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, v double")
    return Grid(df.join(table, "idx").select("img", "x", "y", "z", "idx", "v"), shape)


def values(g):
    return [r["v"] for r in g.df.orderBy("img", "idx").collect()]


@pytest.fixture(scope="module")
def line(spark):
    return grid(spark, [2, 5, 1, 8], (4, 1, 1))


@pytest.mark.parametrize(("text", "want"), [("x+1>2", [1, 1, 0, 1]), ("x>2+1", [1, 2, 1, 2]), ("2*x", [4, 10, 2, 16]), ("x/2-1", [0, 1.5, -0.5, 3]), ("1-x", [-1, -4, 0, -7]), ("(x-1)*2", [2, 8, 0, 14]), ("-1*x", [-2, -5, -1, -8]), ("x=5", [0, 1, 0, 0]), ("x*(x>1)", [2, 5, 0, 8])])
def test_expression(line, text, want):
    assert values(evaluate(line, text)) == want


@pytest.mark.parametrize("text", ["2*3*x", "2", "x + 1", "-x", "x+", "foo(x)", "(x", "x)", "", "2+3", "y"])
def test_expression_errors(line, text):
    with pytest.raises(ExpressionError):
        evaluate(line, text)


def test_division_by_zero_gives_infinity(spark):
    assert values(evaluate(grid(spark, [0, 1], (2, 1, 1)), "1/x")) == [float("inf"), 1.0]


def test_commands(line, spark):
    assert values(run(line, "add_value:1+multiply_value:2")) == [6, 12, 4, 18]
    with pytest.raises(CommandError):
        command(line, "nonsense")
    with pytest.raises(CommandError):
        command(line, "add_image")
    assert values(command(line, "flip_x")) == [8, 1, 5, 2]
    g = command(line, "header_flip_x")
    assert g.affine[0] == -1 and g.affine[3] == 3
    assert command(line, "set_mni", "1").is_mni
    # on float images morphology keeps the values inside the result
    assert values(command(grid(spark, [7, 0, 3, 4], (4, 1, 1)), "morphology_defragment")) == [0, 0, 3, 4]


def test_empty_grid_and_reshape(spark, line):
    assert values(G.reshape(line, (6, 1, 1))) == [2, 5, 1, 8, 0, 0]
    assert G.line_points(0, 0, 4, 2) == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)]
    order, flipped = G.orientation([0, 1, 0, -1, 0, 0, 0, 0, 1])
    assert order == (1, 0, 2) and flipped == (False, True, False)
    inv, f = G.inverse_orientation(order, flipped)
    back = G.reorder(G.reorder(line, order, flipped), inv, f)
    assert values(back) == values(line)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("end", "<>")
@pytest.mark.parametrize("dtype", ["u1", "i2", "f4", "f8", "u4"])
def test_nifti_round_trip(version, end, dtype):
    data = np.arange(24) % 7
    raw = FM.write_nifti(data, (4, 3, 2), (1, 2, 3), [1, 0, 0, 5, 0, 2, 0, 6, 0, 0, 3, 7], dtype, 2.0, 1.0, True, version, "hello", end)
    for r in (FM.read_nifti(raw), FM.read_nifti(gzip.compress(raw))):
        assert len(r) == 1 and r[0]["shape"] == [4, 3, 2] and r[0]["vs"] == [1, 2, 3] and r[0]["is_mni"] and r[0]["descrip"] == "hello"
        assert r[0]["data"].tolist() == (data * 2 + 1).tolist() and r[0]["affine"][3] == 5


def test_nifti_volumes_and_orientation():
    r = FM.read_nifti(FM.write_nifti(np.arange(12), (3, 2, 1), volumes=2, dtype="i2"))
    assert [x["data"].tolist() for x in r] == [list(range(6)), list(range(6, 12))]
    assert FM.read_nifti(FM.write_nifti(np.arange(12), (3, 2, 1), volumes=2, dtype="i2"), 1)[0]["data"][0] == 6
    assert FM.orientation_codes([-1, 0, 0, 0, 0, -1, 0, 0, 0, 0, 1, 0]) == []
    assert FM.orientation_codes([1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]) == [0, 1]
    assert FM.orientation_codes([0, -1, 0, 0, -1, 0, 0, 0, 0, 0, 1, 0]) == [3]
    with pytest.raises(ValueError):
        FM.read_nifti(b"\0" * 600)


def test_mat4_nrrd_bmp():
    raw = FM.write_mat4([{"name": "a", "rows": 2, "cols": 3, "data": range(6), "dtype": "f8"}, {"name": "b", "rows": 1, "cols": 4, "data": [0, 10, 20, 30], "sloped": True}])
    a, b = FM.read_mat4(raw)
    assert a["name"] == "a" and a["data"].tolist() == list(range(6)) and np.allclose(b["data"], [0, 10, 20, 30], atol=0.3)
    assert [r["name"] for r in FM.read_mat4(raw, {"b"})] == ["b"]
    for packed in (False, True):
        r = FM.read_nrrd(FM.write_nrrd(np.arange(6), (3, 2, 1), "short", [2, 0, 0, 1, 0, 3, 0, 2, 0, 0, 4, 3], packed))
        assert r["shape"] == [3, 2, 1] and r["vs"] == [2, 3, 4] and r["affine"][3] == 1 and r["data"].tolist() == list(range(6))
    for bits in (8, 24, 32):
        v = np.array([0x010203, 0x0A0B0C, 0x112233, 0, 1, 255]) if bits > 8 else np.arange(6)
        r = FM.read_bmp(FM.write_bmp(v, 3, 2, bits))
        assert r["shape"] == [3, 2, 1] and r["data"].tolist() == v.tolist()


def dicom(pixels, rows, cols, number=1, explicit=True, location=0.0):
    def put(g, e, vr, b):
        b += b" " * (len(b) % 2)
        if not explicit and g != 2:
            return struct.pack("<HHI", g, e, len(b)) + b
        long = vr in (b"OW", b"OB")
        return struct.pack("<HH", g, e) + vr + (b"\0\0" + struct.pack("<I", len(b)) if long else struct.pack("<H", len(b))) + b

    us = lambda n: struct.pack("<H", n)
    body = put(2, 0x10, b"UI", b"1.2.840.10008.1.2.1" if explicit else b"1.2.840.10008.1.2")
    body += put(0x18, 0x50, b"DS", b"3") + put(0x20, 0x13, b"IS", str(number).encode()) + put(0x20, 0x1041, b"DS", str(location).encode())
    body += put(0x28, 0x10, b"US", us(rows)) + put(0x28, 0x11, b"US", us(cols)) + put(0x28, 0x30, b"DS", b"2\\1.5") + put(0x28, 0x100, b"US", us(16)) + put(0x28, 0x103, b"US", us(0))
    return b"\0" * 128 + b"DICM" + body + put(0x7FE0, 0x10, b"OW", np.asarray(pixels, "<u2").tobytes())


@pytest.mark.parametrize("explicit", [True, False])
def test_dicom(explicit):
    r = FM.read_dicom(dicom(range(16), 4, 4, 7, explicit))
    assert r["shape"] == [4, 4, 1] and r["vs"] == [1.5, 2, 3] and r["image_number"] == 7 and r["data"].tolist() == list(range(16))


def test_bruker_and_mosaic():
    p = FM.read_bruker_parameters("##TITLE=x\n##$RECO_size=( 2 )\n3 2\n##$RECO_wordtype=_16BIT_SGN_INT\n##$RECO_map_slope=( 2 )\n2 1\n")
    assert p["RECO_size"] == "3 2"
    r = FM.read_bruker(np.arange(12, dtype="<i2").tobytes(), "##$RECO_size=( 2 )\n3 2\n##$RECO_wordtype=_16BIT_SGN_INT\n##$RECO_map_slope=( 2 )\n2 1\n", "##$VisuCoreExtent=( 2 )\n6 4\n")
    assert r["shape"] == [3, 2, 2] and r["vs"][:2] == [2, 2] and r["data"][6] == 12
    assert FM.unmosaic(np.arange(16), 4, 4, 2, 2, 3).tolist() == [0, 1, 4, 5, 2, 3, 6, 7, 8, 9, 12, 13]
    assert FM.write_avi([b"\0" * 16] * 3, 2, 2)[:4] == b"RIFF"


def test_image_sources(spark, tmp_path):
    images.register(spark)
    rows = [(None, "v", k, [3, 2, 1], [1.0, 2.0, 3.0], [1.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0, 1.0], [float(k + i) for i in range(6)]) for k in range(3)]
    df = spark.createDataFrame(rows, images.SCHEMA)
    for kind in ("nifti", "nrrd", "mat4"):
        out = str(tmp_path / kind)
        df.write.format(kind).mode("append").save(out)
        back = spark.read.format(kind).load(out)
        assert sorted(r["data"] for r in back.collect()) == [r[6] for r in rows]
        assert sorted(r["data"] for r in images.read_images(spark, kind, out).collect()) == [r[6] for r in rows]
    assert spark.read.format("mat4").load(str(tmp_path / "mat4")).where("name = 'v'").count() == 3
    for k in range(3):
        (tmp_path / f"s{k}.dcm").write_bytes(dicom([k] * 4, 2, 2, 3 - k))
    v = images.dicom_volume(images.read_images(spark, "dicom", str(tmp_path), glob="*.dcm").withColumn("name", F.lit("a"))).first()
    assert v["shape"] == [2, 2, 3] and v["data"] == [2.0] * 4 + [1.0] * 4 + [0.0] * 4


def test_multiple_regression(spark):
    rows = [(float(y), 1.0, float(n), float(n**3)) for n, y in enumerate([1, 2, 2, 2, 3], 1)]
    r = stats.multiple_regression(spark.createDataFrame(rows, "y double, a double, b double, c double"), "y", ["a", "b", "c"])
    assert np.allclose(r["b"], [0.896551724, 0.33646813, 0.002089864])


def test_transforms():
    m = T.affine([1, 2, 3], [0.1, 0.2, 0.3], [1.1, 0.9, 1.2], [0.01, 0.02, 0.03])
    p = T.affine_parameters(m)
    assert np.allclose(T.affine(p["shift"], p["angles"], p["scaling"], p["shear"]), m)
    assert np.allclose(T.compose(m, T.inverse(m))[:, :3], np.eye(3))
    assert np.allclose(T.rotation_between([1, 0, 0], [0, 1, 0]) @ [1, 0, 0], [0, 1, 0])
    assert np.allclose(T.axis_rotation([0, 0, 1], 0.3), T.rotation_z(0.3))


def test_network_layers():
    x = np.arange(8.0).reshape(1, 2, 2, 2)
    assert network.pool(x, (2, 2, 2), np.max).ravel().tolist() == [7]
    assert network.pool(x, (1, 2, 2), np.mean).ravel().tolist() == [1.5, 5.5]
    assert network.conv_3d(x, np.ones((1, 1, 3, 3, 3)), np.zeros(1)).ravel().tolist() == [28.0] * 8
    assert network.conv_transpose_3d(x[:, :1, :1, :1], np.ones((1, 1, 2, 2, 2)), np.ones(1)).shape == (1, 2, 2, 2)
    n = network.instance_norm_3d(x, np.ones(1), np.zeros(1))
    assert abs(n.mean()) < 1e-9 and abs(n.std() - 1) < 1e-3
    assert network.parse("conv4,ks3,stride2,relu+max_pool")[0] == ("conv", 4, {"ks": "3", "stride": "2", None: "relu"})
    y = network.sliding_window(np.random.default_rng(0).random((1, 6, 6, 6)), (4, 4, 4), lambda v: v * 2)
    assert y.shape == (1, 6, 6, 6)
    z = np.random.default_rng(0).random((1, 6, 6, 6))
    assert np.allclose(network.sliding_window(z, (4, 4, 4), lambda v: v * 2), z * 2)


def test_model_file():
    text = "split_merge(conv2,ks3,stride1,relu+max_pool+conv_trans2|conv1,ks1,stride1)+norm+conv3,ks1,stride1"
    rng = np.random.default_rng(4)
    sizes = [2 * 27, 2, 2 * 2 * 8, 2, 1, 1, 3, 3, 9, 3]
    tensors = [rng.normal(size=n) for n in sizes]
    records = [{"name": "architecture", "rows": 1, "cols": len(text), "data": list(text.encode()), "dtype": "u1"}]
    records += [{"name": f"tensor{i}", "rows": len(t), "cols": 1, "data": t, "dtype": "f8"} for i, t in enumerate(tensors)]
    layers, weights = network.load_model(FM.write_mat4(records))
    assert [w.size for w in weights] == sizes
    x = rng.random((6, 7, 5))
    y = network.evaluate(layers, weights, x)
    assert y.shape == (3, 6, 7, 5) and np.allclose(network.softmax(y).sum(0), 1)
    assert network.evaluate(layers, weights, x, (4, 4, 4)).shape == (3, 6, 7, 5)


def test_per_image():
    x = np.random.default_rng(1).random((4, 4, 4))
    assert np.allclose(per_image.fft_shift(per_image.fft_shift(x)), x)
    assert per_image.fft_round_up(np.ones((3, 5, 1))).shape == (4, 8, 1)
    assert np.allclose(per_image.fft_round_down(per_image.fft_round_up(x[:3]), (3, 4, 4)), x[:3])
    assert np.allclose(per_image.thumb(np.arange(16.0).reshape(1, 4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    z, y, w = np.mgrid[:12, :12, :12] - 5.5
    t = per_image.isosurface(np.sqrt(z**2 + y**2 + w**2), 4.0)
    area = np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1).sum() / 2
    assert abs(area - 4 * np.pi * 16) / (4 * np.pi * 16) < 0.05
    assert np.allclose(per_image.homogenize(x * 2 + 1, x, 4), x * 2 + 1)


def test_registration(spark):
    rng = np.random.default_rng(2)
    base = rng.random((1, 12, 14))
    for _ in range(2):
        base = (base + np.roll(base, 1, 1) + np.roll(base, 1, 2)) / 3
    fixed, moving = grid(spark, base[:, :, 1:11], (10, 12, 1)), grid(spark, base[:, :, :10], (10, 12, 1))
    eye = [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]
    shifted = [1, 0, 0, 1, 0, 1, 0, 0, 0, 0, 1, 0]
    assert registration.correlation_cost(fixed, moving, shifted) < registration.correlation_cost(fixed, moving, eye)
    x, v = registration.gradient_descent(lambda p: float(((p - 0.3) ** 2).sum()), np.zeros(2), -np.ones(2), np.ones(2), np.full(2, 1e-4))
    assert np.allclose(x, 0.3, atol=0.05)


def test_clusters_and_validation(spark):
    rng = np.random.default_rng(3)
    pts = [(i, [float(x) for x in rng.normal(4 * (i % 2), 0.1, 2)]) for i in range(40)]
    df = spark.createDataFrame(pts, "id long, f array<double>")
    got = {r["id"]: r["label"] for r in ml.k_means(df, 2, 2).collect()}
    assert len({got[i] for i in range(0, 40, 2)}) == 1 and got[0] != got[1]
    rows = df.withColumn("label", (F.col("id") % 2).cast("int"))
    cv = ml.cross_validation(rows, 4, lambda r: None, lambda m, r: r.withColumn("predicted", F.lit(0)))
    assert cv.count() == 4 and all(0 <= r["error"] <= 1 for r in cv.collect())
    one = ml.one_vs_rest(rows, ["a", "b"], lambda c: F.get("f", 0) if c == "b" else F.lit(2.0))
    assert {r["predicted"] for r in one.collect()} == {"a", "b"}


def test_clusters_that_settle_late(spark):
    """More than a hundred rounds, label by label as in a plain loop; a bound that a caller sets is an error when it's reached."""
    x = np.round(np.random.default_rng(15).exponential(1, 1500), 6)
    label, k, n = np.arange(1500) % 10, 10, 0
    while True:
        names = np.unique(label)
        new = names[np.round((x[:, None] - [x[label == j].mean() for j in names]) ** 2, 12).argmin(1)]
        if (new == label).all():
            break
        label, n = new, n + 1
    assert n > 100
    df = spark.createDataFrame([(3 * i, [float(v)]) for i, v in enumerate(x)], "id long, f array<double>").repartition(3)
    assert [r["label"] for r in ml.k_means(df, k, 1, scaled=False).orderBy("id").collect()] == label.tolist()
    with pytest.raises(RuntimeError):
        ml.k_means(df, k, 1, rounds=3, scaled=False)
    assert ml.k_means(df.where("false"), k, 1, scaled=False).collect() == []


@pytest.mark.parametrize("values", [[0, 1, 65_535], [-3, 0, 7], [0, 65_536, 436_800], [-70_000, 5, 6], [0, 2**40, 1], [-(2**40), 2**33, 1], [0.5, -1.25, 3e9], [float("inf"), 1.0, 2.0]])
def test_dicom_pixels_beyond_16_bits(values):
    raw = FM.write_dicom(np.array(values), 3, 1)
    back = FM.read_dicom(raw)
    assert back["data"].tolist() == values and back["shape"] == [3, 1, 1]
    assert FM.read_dicom_header(raw)["pixel_bytes"] == 3 * int(back["tags"][0x00280100]) // 8


def test_dicom_planes_of_large_sums(spark, sf, tmp_path):
    """The query's table with quantities so large that voxels exceed 16 bits."""
    from gridloom import catalog, fixtures

    fixtures.table(spark, sf, "lineitem").withColumn("l_quantity", F.col("l_quantity") * 5000).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(r["img"], r["idx"]): r["v"] for r in fixtures.vol(spark, str(tmp_path)).df.collect()}
    got = {(r["img"], r["idx"]): r["v"] for r in catalog.queries()["src_dicom"](spark, str(tmp_path)).collect()}
    assert max(want.values()) > 65_535 and got == want


def test_headers_and_tags_use_many_tasks(spark, sf):
    """A customer's or part's file takes far longer to make and read than its row, so one file's rows are dealt out."""
    from gridloom.queries import more

    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks(more._header_files(spark, sf)) == 3
    for query in (more.dicom_headers, more.dicom_report, more.tiff_tags):
        assert tasks(query(spark, sf)) == 3


def test_tiff_fields_of_many_files(spark):
    """Fields of one batch of files come together, none twice and none left behind."""
    raw = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 256, 3, 1, 7, 0) + struct.pack("<I", 0)
    files = spark.createDataFrame([(str(k), raw) for k in range(300)], "path string, content binary").coalesce(1)
    got = images.tiff_tags(files)
    assert [tuple(r) for r in got.orderBy(F.col("path").cast("int")).collect()] == [(str(k), 0, 256, "7") for k in range(300)]


def test_match_strings():
    assert S.match_strings("sub01_t1", "sub01_mask", "sub02_t1") == "sub02_mask"
    assert S.match_strings("a.nii", "a.txt", "b.nii") == "b.txt"
    assert S.match_strings("a", "a", "c") == "c"


def test_streams(spark, tmp_path):
    s = running.Sample()
    for v in (1.0, 2.0, 3.0):
        s.push(v)
    s.pop(3.0)
    s.replace(2.0, 5.0)
    assert s.mean_variance() == (3.0, 4.0)
    assert running.Sample().mean_variance() == (0.0, 0.0)
    rows = [(1, "2020-01-01 00:00:00", 2.0), (1, "2020-01-01 00:01:00", 4.0), (2, "2020-01-01 00:07:00", 6.0)]
    df = spark.createDataFrame(rows, "k int, t string, value double").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("agg", running.running_statistics(stream(), "k", "value"), "complete"), ("win", running.windowed_counts(stream(), "t", "5 minutes"), "complete"), ("state", running.incremental_samples(stream(), "k", "value"), "update")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert {(r["k"], r["n"], r["mean"]) for r in spark.table("agg").collect()} == {(1, 2, 3.0), (2, 1, 6.0)}
    assert sorted(r["n"] for r in spark.table("win").collect()) == [1, 2]
    assert {(r["k"], r["n"], r["variance"]) for r in spark.table("state").collect()} == {(1, 2, 1.0), (2, 1, 0.0)}
    assert running.sessions(df, "t", "2 minutes", "k").count() == 2


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5376
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
