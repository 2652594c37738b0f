from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.sources import cloud_files, image_files, synthetic

PLY = "ply\nformat ascii 1.0\ncomment c\nelement vertex 2\nproperty float z\nproperty int intensity\nproperty float x\nproperty float y\nend_header\n30 7 10 20\n\n60 9 40 50 1\n9 9 9 9\n"
PCD = "# c\nVERSION .7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nDATA ascii\n1 2 3 0\n4 5 6 0\n"


def test_columns_by_name():
    assert cloud_files.parse_ply(PLY).tolist() == [[10, 20, 30], [40, 50, 60]]
    assert cloud_files.parse_ply(PLY.replace("\n", "\r\n")).tolist() == [[10, 20, 30], [40, 50, 60]]
    assert cloud_files.parse_pcd(PCD).tolist() == [[1, 2, 3], [4, 5, 6]]


@pytest.mark.parametrize("text", [PLY.replace("ascii", "binary_little_endian"), PLY.replace("vertex 2", "vertex 9"), PLY.replace("float z", "float w"), PLY.replace("property int", "property list"), "PLY\n", PLY.replace("end_header\n", ""), PLY.replace("30 7 10 20", "30 7 10"), PLY.replace("vertex 2", "vertex two")])
def test_bad_ply(text):
    with pytest.raises(cloud_files.CloudFileError):
        cloud_files.parse_ply(text)


@pytest.mark.parametrize("text", [PCD.replace("ascii", "binary"), PCD.replace("COUNT 1", "COUNT 3"), PCD.replace("x y z", "a b c"), PCD.replace("WIDTH 2", "WIDTH 3")])
def test_bad_pcd(text):
    with pytest.raises(cloud_files.CloudFileError):
        cloud_files.parse_pcd(text)


@pytest.mark.parametrize("extension", [".ply", ".PCD", ".parquet"])
def test_cloud_roundtrip(spark, tmp_path, extension):
    path = str(tmp_path / f"c{extension}")
    points = synthetic.uniform_cloud(spark, 50)
    cloud_files.write_cloud(points, path)
    read = cloud_files.read_cloud(spark, path).select("point_id", "x", "y", "z")
    assert sorted(read.collect()) == sorted(points.collect())
    cloud_files.write_cloud(points.where("false"), str(tmp_path / f"empty{extension}"))
    assert cloud_files.read_cloud(spark, str(tmp_path / f"empty{extension}")).count() == 0


@pytest.mark.parametrize(("size", "n"), [("300b", 400), ("50b", 30)])
def test_a_file_is_read_in_ranges(spark, tmp_path, size, n):
    """Many tasks read one file, whose header may lie in several ranges; the rows are those of a parser of the whole file."""
    rng = np.random.default_rng(3)
    rows = [f"{i} 7 {a:.5f} {b:.5f}" for i, (a, b) in enumerate(rng.uniform(-5, 5, (n, 2)))]
    for at, odd in ((5, ""), (9, "# no row"), (20, "nan 1 2 3"), (n - 10, "text 4 5 6")):
        rows.insert(at, odd)
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {
        "a b.ply": PLY.split("30 7")[0].replace("vertex 2", f"vertex {n - 1}").replace("comment c", "comment c\n12 is no row yet") + "\n".join(rows) + "\n",
        "small.ply": PLY,
    }
    for name, text in texts.items():
        (folder / name).write_text(text)
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        got = cloud_files.read_ply(spark, str(folder)).collect()
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    for name, text in texts.items():
        own = sorted((r["point_id"], r["x"], r["y"], r["z"]) for r in got if r["cloud_id"] == name)
        assert [r[1:] for r in own] == [tuple(map(float, r)) for r in cloud_files.parse_ply(text)] and [r[0] for r in own] == list(range(len(own)))


@pytest.mark.parametrize("text", ["", PLY.replace("vertex 2", "vertex 9"), PLY.replace("30 7 10 20", "30 7 10"), PLY.replace("end_header\n", ""), PCD])
def test_files_that_are_no_clouds(spark, tmp_path, text):
    (tmp_path / "x.ply").write_text(text)
    with pytest.raises(cloud_files.CloudFileError):
        cloud_files.read_cloud(spark, str(tmp_path / "x.ply"))


def test_many_clouds_and_a_failing_task_leave_whole_files_or_none(spark, tmp_path):
    rows = [(f"c{k}.pcd" if k % 2 else f"d {k}", i, float(i), float(k), 0.5) for k in range(6) for i in range(20 * k + 1)]
    points = spark.createDataFrame(rows, "cloud_id string, point_id long, x double, y double, z double").repartition(7)
    folder = str(tmp_path / "clouds")
    cloud_files.write_clouds(points, folder)
    assert sorted(p.name for p in (tmp_path / "clouds").iterdir() if p.suffix == ".ply") == ["c1.ply", "c3.ply", "c5.ply", "d 0.ply", "d 2.ply", "d 4.ply"]
    back = {(r["cloud_id"][:-4], r["point_id"], r["x"], r["y"], r["z"]) for r in cloud_files.read_ply(spark, f"{folder}/*.ply").collect()}
    assert back == {(c.removesuffix(".pcd"), *r) for c, *r in rows}
    images = spark.createDataFrame([("good", 2, 1, 1, b"\x01\x02"), ("bad", 1, 1, 3, b"abc")], image_files.PACKED).repartition(2)
    with pytest.raises(Exception, match="PGM holds one channel"):
        image_files.write_pgm(images, str(tmp_path / "images"))
    assert not [p for p in (tmp_path / "images").rglob("*") if p.is_file()] and not list((tmp_path / "images").glob(".job*"))
    image_files.write_ppm(images, str(tmp_path / "images"))
    assert sorted(p.name for p in (tmp_path / "images").iterdir()) == ["bad.ppm", "good.ppm"]
    broken = points.withColumn("x", F.when(F.col("y") == 5, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        cloud_files.write_clouds(broken, str(tmp_path / "broken"))
    assert not [p for p in (tmp_path / "broken").rglob("*.ply")]


def test_relative_paths(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    points = synthetic.uniform_cloud(spark, 5)
    cloud_files.write_cloud(points, str(tmp_path / "a.ply"))
    image_files.write_pgm(image_files.pack(synthetic.make_test_image(spark, 4, 3)), "images")
    assert [p.name for p in (tmp_path / "images").iterdir()] == ["scene.pgm"] and cloud_files.read_ply(spark, str(tmp_path / "a.ply")).count() == 5


def test_unknown_extension(spark):
    with pytest.raises(cloud_files.CloudFileError):
        cloud_files.read_cloud(spark, "a.xyz")
    with pytest.raises(cloud_files.CloudFileError):
        cloud_files.write_cloud(synthetic.uniform_cloud(spark, 1), "a.xyz")


def test_pnm():
    assert image_files.parse_pnm(b"P5\n# c\n2 2\n# d\n1\n\x00\x01\x01\x00") == (2, 2, 1, b"\x00\xff\xff\x00")
    for raw in (b"P2\n1 1\n255\n0", b"P5\n2 2\n255\n\x00", b"P5\n0 2\n255\n", b"P5\n1 1\n256\n\x00", b"P5\n1 1\n255#\x00", b"P5\n1"):
        with pytest.raises(image_files.ImageFileError):
            image_files.parse_pnm(raw)
    ramp = bytes(np.arange(9 * 7 * 3, dtype=np.uint8))
    assert image_files.parse_pnm(image_files.format_ppm(9, 7, 3, ramp)) == (9, 7, 3, ramp)
    assert image_files.parse_pnm(image_files.format_ppm(2, 1, 1, b"\x05\x09"))[3] == b"\x05\x05\x05\x09\x09\x09"
    for form, channels in ((image_files.format_pgm, 3), (image_files.format_ppm, 2)):
        with pytest.raises(image_files.ImageFileError):
            form(1, 1, channels, b"\0" * channels)


def test_image_files(spark, tmp_path):
    image = synthetic.make_test_image(spark, 16, 12)
    image_files.write_pgm(image_files.pack(image), str(tmp_path / "out"))
    back = image_files.unpack(image_files.read_pnm(spark, str(tmp_path / "out"))).select("x", "y", "v")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, image.select("x", "y", "v").collect()))


def test_synthetic_shapes(spark):
    c = np.array([tuple(r)[1:] for r in synthetic.make_sphere(spark, 500).collect()])
    assert np.allclose(np.linalg.norm(c - [-1.5, 1.2, 1.0], axis=1), 1, atol=1e-5)
    b = np.abs(np.array([tuple(r)[1:] for r in synthetic.make_box(spark, 500).collect()]) - [1.6, -1.0, 0.8])
    assert np.allclose(b.max(1), 0.8, atol=1e-5)
    plane = synthetic.make_plane(spark, 1000)
    assert 600 < synthetic.random_subset(plane, 0.7).count() < 800 and synthetic.random_subset(plane, 5).count() == 1000
    assert synthetic.add_gaussian_noise(plane, 0) is plane


def test_the_task_that_writes_a_file_sorts_few_rows(spark, tmp_path, monkeypatch):
    """Lines come to it in chunks of one row each, whose order is that of the ids, negative, repeated and null ones too."""
    monkeypatch.setattr(cloud_files, "CHUNK", 50)
    seen, write = [], cloud_files.write_text_files
    monkeypatch.setattr(cloud_files, "write_text_files", lambda lines, *a: seen.append(lines.count()) or write(lines, *a))
    points = spark.range(3000).selectExpr("if(id % 100 = 0, null, (id * 7) % 3000 div 2 - 700) as point_id", "cast(if(id % 100 = 0, -900, (id * 7) % 3000 div 2 - 700) as double) as x", "0D y", "0D z")
    cloud_files.write_ply(points, str(tmp_path / "a.ply"))
    assert seen[0] <= 1 + 3000 / 50 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = cloud_files.parse_ply((tmp_path / "a.ply").read_text())[:, 0].tolist()
    assert len(x) == 3000 and x == sorted(x)
