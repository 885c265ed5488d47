"""Writers: Parquet weight tables, CSV, fixed-width text, JSON arrays, layer-wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_weights(weights: DataFrame, path: str) -> None:
    """A weight table (qid, pid, weight), clustered by target."""
    weights.select("qid", "pid", "weight").repartition("qid").sortWithinPartitions("qid", "pid").write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.parquet(path)
    if set(out.columns) != {"qid", "pid", "weight"}:
        raise ValueError(f"not a weight table: {out.columns}")
    return out


def fixed_width(df: DataFrame, pattern: str, order: list[str]) -> DataFrame:
    """Rows as one text column by a printf pattern, in order."""
    return df.orderBy(*order).select(F.format_string(pattern, *(F.col(c) for c in df.columns)).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def json_dict(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """One JSON object a key: {key: [values in order]}."""
    arrays = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v"))
    return arrays.select(F.to_json(F.create_map(F.col(key).cast("string"), F.col("v"))).alias("value"))


def well_log(df: DataFrame, name: str, x: str, y: str, land: str, top: str, depth: str, classes: list[str], missing: float = -999.0) -> DataFrame:
    """(Name, ID, n, X, Y, Zland, Depth, classes): the rows of a well-log file, wells numbered by name and each well's intervals, from the shallowest, by their lower ends.

    Where an interval begins below the end of the one before (or below 0), a row to its upper end with missing classes
    fills the gap; null classes are missing too. Rows without name or depth are left out.
    """
    rows = df.where(F.col(name).isNotNull() & F.col(depth).isNotNull())
    ids = rows.select(F.col(name).alias("Name")).distinct().withColumn("ID", F.row_number().over(Window.orderBy("Name")))  # one row a well
    well = Window.partitionBy(name).orderBy(depth, top)
    end = F.coalesce(F.lag(depth).over(well), F.lit(0.0))
    kept = rows.select(F.col(name).alias("Name"), *(F.col(c).cast("double").alias(n) for c, n in ((x, "X"), (y, "Y"), (land, "Zland"), (top, "_top"), (depth, "Depth"))), end.cast("double").alias("_end"), *(F.coalesce(F.col(c).cast("double"), F.lit(missing)).alias(c) for c in classes))
    gaps = kept.where("_top > _end").withColumns({"Depth": F.col("_top"), **{c: F.lit(missing) for c in classes}})
    n = F.row_number().over(Window.partitionBy("Name").orderBy("Depth", "_top"))
    return kept.unionByName(gaps).withColumn("n", n).join(ids, "Name").select("Name", "ID", "n", "X", "Y", "Zland", "Depth", *classes)


def layer_wide(df: DataFrame, by: list[str], layers: list[int], value: str) -> DataFrame:
    """One column a layer, missing values as -999."""
    wide = df.groupBy(*by).pivot("layer", layers).agg(F.first(value, True))
    return wide.select(*by, *(F.coalesce(F.col(str(k)), F.lit(-999.0)).alias(f"Layer{k}") for k in layers))


def sections_of_logs(first: DataFrame, second: DataFrame, log_id: str) -> DataFrame:
    """Two logs as one table, the second's ids following the first's."""
    top = first.agg(F.coalesce(F.max(log_id), F.lit(0)).alias("_top"))
    return first.unionByName(second.crossJoin(F.broadcast(top)).withColumn(log_id, (F.col(log_id) + F.col("_top")).cast(first.schema[log_id].dataType)).drop("_top"))


def instruction_lines(df: DataFrame, date: str, name: str, origin: str) -> DataFrame:
    """Lines that read one value a date from a daily output: l<lines to move> !name!; the first counts from the origin."""
    move = F.datediff(F.col(date), F.coalesce(F.lag(date).over(Window.orderBy(date)), F.lit(origin).cast("date")))
    return df.select(date, F.format_string("l%d !%s!", move, F.col(name)).alias("value"))


#: The layout that readers of a variogram block expect, a line for a class and one for each of its structures.
VARIOGRAM_HEAD = ("BEGIN VARIOGRAMS", "  # Structure Vtype  Nugget  Sill  Range_min Range_max ang1  nnear")
VARIOGRAM_CLASS = "  CLASS %s"
VARIOGRAM_STRUCTURE = "           %d    %s    %.3f   %.3f    %.2E       %.2E  %.1f    %d"
VARIOGRAM_END = "END VARIOGRAMS"


def variogram_lines(models: DataFrame) -> DataFrame:
    """(part, class, structure, value): the block's lines in the order of the first three columns: heading (part 0), classes, each with its structures (part 1), end (part 2). models: class, structure from 1, kind, nugget, sill, range_min, range_max, angle, nnear."""
    named = models.select("class").distinct().select(F.lit(1).alias("part"), "class", F.lit(0).alias("structure"), F.format_string(VARIOGRAM_CLASS, "class").alias("value"))
    numbers = F.format_string(VARIOGRAM_STRUCTURE, "structure", "kind", "nugget", "sill", "range_min", "range_max", "angle", "nnear")
    frame = [(0, None, k, line) for k, line in enumerate(VARIOGRAM_HEAD)] + [(2, None, 0, VARIOGRAM_END)]
    return models.sparkSession.createDataFrame(frame, named.schema).unionByName(named).unionByName(models.select(F.lit(1).alias("part"), "class", F.col("structure").cast("int").alias("structure"), numbers.alias("value")))
