"""The two commands, on small inputs."""

from __future__ import annotations

import csv

from voxelweave import __main__ as commands
from voxelweave.sources import cloud_files, image_files


def test_demo_writes_clouds_and_images(spark, tmp_path, capsys):
    commands.demo(str(tmp_path), 4000, (80, 60))
    said = capsys.readouterr().out
    assert "registration:" in said and "regions:" in said
    clouds = {n: cloud_files.read_ply(spark, str(tmp_path / f"{n}.ply")).count() for n in ("target", "source", "registered")}
    assert clouds["source"] == clouds["registered"] > 100 and clouds["target"] > 100
    names = sorted(p.name for p in tmp_path.iterdir() if p.suffix in (".pgm", ".ppm"))
    assert names == ["01-image.pgm", "02-blurred.pgm", "03-gradient.pgm", "04-thin.pgm", "05-edges.pgm", "06-mask.pgm", "07-regions.ppm"]
    sizes = {(r["width"], r["height"]) for r in image_files.read_pnm(spark, str(tmp_path / "*.p?m")).collect()}
    assert sizes == {(80, 60)}


def test_bench_writes_every_group(spark, tmp_path, monkeypatch):
    path = tmp_path / "b.csv"
    commands.bench(str(path), (300,), (16, 12), 1, 0, (3,), (0.5,), ((100, 512), (1000, 64)))
    with open(path, newline="") as f:
        rows = list(csv.DictReader(f))
    assert {(r["group"], r["case"]) for r in rows} == {
        ("index", "build"), ("knn", "boxes"), ("radius", "boxes"), ("leaf", "box"), ("leaf", "scan"), ("voxel", "downsample"), ("icp", "registration"),
        ("raster", "gaussian blur"), ("raster", "sobel"), ("raster", "non-maximum suppression"), ("raster", "hysteresis"), ("raster", "components"),
    }
    assert all(float(r["value"]) >= 0 for r in rows) and {r["metric"] for r in rows} == {"min_ms", "median_ms", "spread_pct"}
