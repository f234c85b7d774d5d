"""The LAS source: ranges, pruning by headers and ranges, headers, truncation, and the writer."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThan, LessThan

from canopyq.sources import las


def cloud(n, x0=0.0, seed=1):
    rng = np.random.default_rng(seed)
    return rng.uniform(x0, x0 + 100, n), rng.uniform(0, 100, n), rng.uniform(-1, 30, n), rng.integers(0, 32, n)


@pytest.fixture
def folder(tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.las").write_bytes(las.las_bytes(*cloud(5000, 1000.0 * k, k), epsg=27700 if k else None))
    (tmp_path / "_hidden.las").write_bytes(b"not a cloud")
    (tmp_path / "notes.txt").write_text("not a cloud")
    return tmp_path


def test_ranges_of_a_file_go_to_many_tasks(spark, folder):
    df = las.read_las(spark, str(folder), part_bytes=10_007, chunk=333)
    assert df.rdd.getNumPartitions() == 33
    got = df.toPandas()
    for k in range(3):
        part = got[got.file.str.endswith(f"/{k}.las")].sort_values("point_id")
        x, y, z, kind = cloud(5000, 1000.0 * k, k)
        assert part.point_id.tolist() == list(range(5000)) and part.classification.tolist() == (kind & 31).tolist()
        assert np.abs(part[["x", "y", "z"]].to_numpy() - np.stack([x, y, z], 1)).max() <= 0.00051


def test_bounds_skip_files_and_rows(spark, folder):
    box = (F.col("x") > 1010.0) & (F.col("x") <= 1020.5) & (F.col("y") < 50)
    df = las.read_las(spark, str(folder)).where(box)
    want = sum(1 for x, y in zip(*cloud(5000, 1000.0, 1)[:2], strict=True) if 1010.0 < round(x, 3) <= 1020.5 and round(y, 3) < 50)
    assert df.count() == want
    assert las.read_las(spark, str(folder)).where("classification = 2 and x > 5000").count() == 0


def test_bytes_read(folder, monkeypatch):
    opened = []
    inner = las.LasFile

    class Counted(inner):
        def __init__(self, path):
            super().__init__(path)
            opened.append(self)

    monkeypatch.setattr(las, "LasFile", Counted)
    reader = las.LasReader(str(folder), 20_000, 500)
    list(reader.pushFilters([GreaterThan(("x",), 2000.0), LessThan(("x",), 2500)]))
    parts = reader.partitions()
    rows = sum(b.num_rows for p in parts for b in reader.read(p))
    assert rows == 5000
    skipped = [f.read_bytes for f in opened if not f.path.endswith("/2.las")]
    assert skipped and max(skipped) <= 375
    assert sum(f.read_bytes for f in opened if f.path.endswith("/2.las")) <= 5000 * 20 + 375 * len(parts)


def test_headers(spark, folder):
    rows = {r.file[-5:]: r for r in las.las_headers(spark, str(folder)).collect()}
    assert sorted(rows) == ["0.las", "1.las", "2.las"] and {r.point_count for r in rows.values()} == {5000}
    assert rows["0.las"].epsg is None and rows["1.las"].epsg == 27700 and 1000 <= rows["1.las"].x0 <= rows["1.las"].x1 <= 1100


def test_ranges_table(spark, folder):
    ranges = las.las_ranges(spark, str(folder), 1000)
    assert ranges.count() == 15
    kept = ranges.where("x1 >= 2000 and begin >= 3000")
    got = las.points_of_ranges(kept)
    assert got.count() == 2000 and got.agg(F.min("point_id")).first()[0] == 3000


def test_truncated_and_foreign_files_raise(spark, folder):
    (folder / "3.las").write_bytes((folder / "1.las").read_bytes()[:-10])
    with pytest.raises(Exception, match="shorter"):
        las.read_las(spark, str(folder)).count()
    (folder / "3.las").write_bytes(b"something else")
    with pytest.raises(Exception, match="not a LAS file"):
        las.read_las(spark, str(folder)).count()


def test_formats_with_long_records():
    head = bytearray(375)
    head[:4], head[24], head[25] = b"LASF", 1, 4
    struct.pack_into("<HII", head, 94, 375, 375, 0)
    struct.pack_into("<BHI", head, 104, 6, 30, 0)
    struct.pack_into("<3d3d", head, 131, 0.01, 0.01, 0.01, 0, 0, 0)
    struct.pack_into("<Q", head, 247, 5_000_000_000)
    h = las.las_header(bytes(head))
    assert (h.version, h.count, h.end) == ("1.4", 5_000_000_000, 375 + 5_000_000_000 * 30)
    with pytest.raises(ValueError, match="compressed"):
        las.las_header(bytes(head[:104]) + bytes([6 | 0x80]) + bytes(head[105:]))


def test_written_files_come_back(spark, tmp_path):
    points = spark.range(2500).select((F.col("id") * 0.5).alias("x"), (F.col("id") % 7).cast("double").alias("y"), F.lit(1.25).alias("z"), F.lit(2).alias("classification"))
    path = str(tmp_path / "out")
    las.write_las(points, path, file_points=400)
    back = las.read_las(spark, path)
    assert back.agg(F.count("*"), F.sum("x"), F.min("z"), F.max("classification")).first()[:] == (2500, 2500 * 2499 / 4, 1.25, 2)
    assert las.las_headers(spark, path).agg(F.max("point_count")).first()[0] <= 400
    las.write_las(points.limit(10), path, mode="overwrite")
    assert las.read_las(spark, path).count() == 10
    broken = points.withColumn("z", F.when(F.col("x") > 1000, F.raise_error(F.lit("broken"))).otherwise(F.col("z")))
    with pytest.raises(Exception, match="broken"):
        las.write_las(broken, path)
    assert las.read_las(spark, path).count() == 10


def test_empty_folder(spark, tmp_path):
    assert las.read_las(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        las.read_las(spark, str(tmp_path / "nowhere")).count()
