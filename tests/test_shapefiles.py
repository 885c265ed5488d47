"""Shapefiles written, read back by several tasks, and laid out as published."""

import datetime
import struct

import pytest
from pyspark.sql import functions as F

from hydrostrata.sources import shapefiles

PLACES = "array<array<struct<x:double,y:double>>>"


def test_points(spark, tmp_path):
    n = 1000
    df = spark.range(0, n, 1, 3).select(
        F.expr("array(array(struct(id * 0.1D as x, -id / 7D as y)))").alias("parts"), "id", (F.col("id") / 3).alias("third"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("né "), F.col("id"))).alias("name"), (F.col("id") % 2 == 0).alias("even"), F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("day"),
    )
    path = str(tmp_path / "points")
    shapefiles.write_shapefile(df, path, "point")
    back = shapefiles.shapefile(spark, path, rows=100)
    assert back.rdd.getNumPartitions() == 12
    assert sorted(map(tuple, back.drop("record").collect()), key=lambda r: r[1]) == sorted(map(tuple, df.collect()), key=lambda r: r[1])
    one = next((tmp_path / "points").glob("*.shp"))
    single = shapefiles.shapefile(spark, f"file://{one}")
    assert [r["record"] for r in single.collect()] == list(range(1, single.count() + 1))
    assert not list((tmp_path / "points").glob("*.writing")) + list((tmp_path / "points").glob("*.body"))
    shapefiles.write_shapefile(df.where("id < 10").coalesce(1), path, "point", "overwrite")
    assert shapefiles.shapefile(spark, path).count() == 10


def test_polygons(spark, tmp_path):
    square = lambda x, y, w: [(x, y), (x, y + w), (x + w, y + w), (x + w, y), (x, y)]
    rows = [([square(0.0, 0.0, 9.0), square(1.0, 1.0, 2.0)], 1), ([square(-5.5, 1e6, 0.25)], 2), (None, 3)] + [([square(float(k), 0.0, 1.0)] * (k % 3 + 1), k) for k in range(4, 40)]
    df = spark.createDataFrame(rows, f"parts {PLACES}, id int").coalesce(1)
    path = str(tmp_path / "areas")
    shapefiles.write_shapefile(df, path, "polygon")
    back = shapefiles.shapefile(spark, path, rows=10)
    assert back.rdd.getNumPartitions() == 4
    plain = lambda parts: parts and [[tuple(p) for p in part] for part in parts]
    assert {r["id"]: plain(r["parts"]) for r in back.collect()} == {i: parts for parts, i in rows}
    raw = next((tmp_path / "areas").glob("*.shp")).read_bytes()
    assert struct.unpack_from(">i", raw)[0] == 9994 and 2 * struct.unpack_from(">i", raw, 24)[0] == len(raw)
    assert struct.unpack_from("<2i4d", raw, 28) == (1000, 5, -5.5, 0.0, 42.0 - 2.0, 1e6 + 0.25)
    assert struct.unpack_from(">2i", raw, 100) == (1, (44 + 8 + 160) // 2)


def test_other_tables(spark, tmp_path):
    """A file made by other hands: a deleted row, blank values, a whole number, a decimal and a date."""
    shapes = [struct.pack("<i2d", 1, k, k + 0.5) for k in range(3)]
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, 1, 0, 0, 2, 2.5, 0, 0, 0, 0)
    body = b"".join(struct.pack(">2i", k + 1, 10) + s for k, s in enumerate(shapes))
    (tmp_path / "a.shp").write_bytes(head(100 + len(body)) + body)
    (tmp_path / "a.shx").write_bytes(head(124) + b"".join(struct.pack(">2i", 50 + 14 * k, 10) for k in range(3)))
    fields = [(b"N", b"N", 4, 0), (b"V", b"N", 6, 2), (b"D", b"D", 8, 0), (b"T", b"C", 3, 0)]
    table = struct.pack("<4BIHH20x", 3, 100, 1, 1, 3, 33 + 32 * 4, 22) + b"".join(struct.pack("<11sc4x2B14x", *f) for f in fields) + b"\r"
    (tmp_path / "a.dbf").write_bytes(table + b"   12  1.5020210304ab " + b"*   1  1.0020210304ab " + b" " + b" " * 21 + b"\x1a")
    got = [tuple(r)[2:] for r in shapefiles.shapefile(spark, str(tmp_path / "a.shp")).collect()]
    assert got == [(12, 1.5, datetime.date(2021, 3, 4), "ab"), (None, None, None, None)]


def test_what_does_not_fit(spark, tmp_path):
    point = spark.range(1).select(F.expr("array(array(struct(1D as x, 2D as y), struct(1D as x, 2D as y)))").alias("parts"), F.lit("x" * 300).alias("t"))
    for df, kind in ((point, "point"), (point, "multipoint"), (point.withColumnRenamed("t", "longer_than_10"), "line"), (point.drop("t"), "cube")):
        with pytest.raises(Exception):
            shapefiles.write_shapefile(df, str(tmp_path / "no"), kind)
    assert not list(tmp_path.glob("no/*.shp"))
