"""Included files, well logs and the plain readers and writers."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydrostrata.functions import numeric
from hydrostrata.operators import texture
from hydrostrata.sources import sinks, tables


def test_included_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "main.in").write_text("BEGIN A\n  external_file sub/one.in\n# EXTERNAL no.in\nx 1\nEXTERNAL sub/two.in\nEXTERNAL sub/two.in\nname EXTERNAL later.in\nEND A\n")
    (tmp_path / "sub" / "one.in").write_text("one 1\nEXTERNAL two.in\none 3\n")
    (tmp_path / "sub" / "two.in").write_text("two 1\nEXTERNAL ../three.in\n")
    (tmp_path / "three.in").write_text("three\n")
    got = [r["line"].strip() for r in tables.spliced_lines(spark, f"file://{tmp_path}/main.in").orderBy("place").collect()]
    two = ["two 1", "three"]
    assert got == ["BEGIN A", "one 1", *two, "one 3", "# EXTERNAL no.in", "x 1", *two, *two, "name EXTERNAL later.in", "END A"]
    blocks = tables.block_items(tables.spliced_lines(spark, f"file://{tmp_path}/main.in").withColumn("key", F.lit(1)), ["key"], "place", "line")
    assert blocks.where("block = 'A'").count() == 10
    (tmp_path / "three.in").write_text("EXTERNAL sub/two.in\n")
    with pytest.raises(ValueError, match="includes itself"):
        tables.spliced_lines(spark, f"file://{tmp_path}/main.in")
    (tmp_path / "three.in").write_text("EXTERNAL nowhere.in\n")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.spliced_lines(spark, f"file://{tmp_path}/main.in").count()


def test_well_log(spark, tmp_path):
    rows = [("w2", 1.0, 2.0, 100.0, 5.0, 10.0, 1.0, 0.0), ("w2", 1.0, 2.0, 100.0, 0.0, 3.0, 0.0, None), ("w1", 5.0, 6.0, 90.0, 0.0, 4.0, None, None), ("w1", 5.0, 6.0, 90.0, 4.0, 8.0, 0.5, 0.5), (None, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "well string, e double, north double, z double, a double, b double, Fine double, Sand double")
    log = sinks.well_log(df, "well", "e", "north", "z", "a", "b", ["Fine", "Sand"])
    assert log.columns == ["Name", "ID", "n", "X", "Y", "Zland", "Depth", "Fine", "Sand"]
    got = [tuple(r) for r in log.orderBy("ID", "n").collect()]
    assert got == [
        ("w1", 1, 1, 5.0, 6.0, 90.0, 4.0, -999.0, -999.0), ("w1", 1, 2, 5.0, 6.0, 90.0, 8.0, 0.5, 0.5),
        ("w2", 2, 1, 1.0, 2.0, 100.0, 3.0, 0.0, -999.0), ("w2", 2, 2, 1.0, 2.0, 100.0, 5.0, -999.0, -999.0), ("w2", 2, 3, 1.0, 2.0, 100.0, 10.0, 1.0, 0.0),
    ]
    sinks.write_csv(log.orderBy("ID", "n").coalesce(1), f"file://{tmp_path}/log", sep="\t")
    text = next((tmp_path / "log").glob("part*")).read_text().splitlines()
    assert text[0].split("\t")[:3] == ["Name", "ID", "n"] and text[1].split("\t")[:2] == ["w1", "1"] and len(text) == 6
    assert sinks.well_log(df.where("false"), "well", "e", "north", "z", "a", "b", ["Fine"]).count() == 0


def test_csv_lines_and_missing_values(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("v", T.DoubleType())])
    (tmp_path / "t.csv").write_text("id,at,v\n1,2020-01-02,1.5\n2,2020-01-02 03:04:05,-999\n")
    rows = tables.csv_table(spark, f"file://{tmp_path}/t.csv", schema, (-999.0,)).orderBy("id").collect()
    assert [(r["id"], str(r["at"]), r["v"]) for r in rows] == [(1, "2020-01-02 00:00:00", 1.5), (2, "2020-01-02 03:04:05", None)]
    df = spark.createDataFrame([(1, -999.0), (2, None), (3, 4.0)], "id long, v double")
    assert [r["v"] for r in tables.missing_to_null(df, ["v"], (-999.0,)).orderBy("id").collect()] == [None, None, 4.0]
    assert [r["v"] for r in tables.null_to_missing(df, ["v"]).orderBy("id").collect()] == [-999.0, -999.0, 4.0]
    sinks.write_lines(sinks.fixed_width(spark.createDataFrame([(2, "b"), (1, "a")], "k int, s string"), "%3d|%-4s|", ["k"]), f"file://{tmp_path}/lines")
    assert "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part*"))) == "  1|a   |\n  2|b   |\n"


def test_last_class_and_turned_distance(spark):
    row = spark.createDataFrame([(0.25, 0.5, 0.9, 3.0, 4.0)], "a double, b double, c double, dx double, dy double")
    got = row.select(texture.infer_last([F.col("a"), F.col("b")]), texture.infer_last([F.col("b"), F.col("c")]), numeric.anisotropic_distance(F.col("dx"), F.col("dy"), 0.0, 1.0), numeric.anisotropic_distance(F.col("dx"), F.col("dy"), 0.0, 0.5), numeric.anisotropic_distance(F.col("dx"), F.col("dy"), 90.0, 0.5)).first()
    assert tuple(got) == pytest.approx((0.25, 0.0, 5.0, (6**2 + 4**2) ** 0.5, (3**2 + 8**2) ** 0.5))
