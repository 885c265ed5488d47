"""Tables and text files as DataFrames; sentinels become nulls on the way in."""

from __future__ import annotations

import posixpath
import re

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values that stand for missing data in input files.
MISSING = (9999.0, -999.0)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def missing_to_null(df: DataFrame, columns: list[str], values: tuple[float, ...] = MISSING) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).isin(*values), F.col(c)) for c in columns})


def null_to_missing(df: DataFrame, columns: list[str], value: float = -999.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def stripped(line: Column) -> Column:
    """Text without white space at its ends, tabs included."""
    return F.btrim(line, F.lit(" \t\r\f"))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line_no from 1, line) of text files. Files are split as usual; a split's rows are numbered in order and shifted by the lines of the splits before it."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_pos"), F.col("value").alias("line"))
    splits = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "_block", (before - F.col("_first") + 1).alias("_shift"))
    return rows.join(splits, ["file", "_block"]).select("file", (F.col("_pos") + F.col("_shift")).alias("line_no"), F.regexp_replace("line", r"\r$", "").alias("line"))


def whitespace_table(spark: SparkSession, path: str | list[str], schema: T.StructType, skip: int = 0, rows: int | None = None, missing: tuple[float, ...] = ()) -> DataFrame:
    """Columns parted by white space below `skip` lines, at most `rows` of them, named and typed by the schema, with file and line_no."""
    lines = numbered_lines(spark, path).where(F.col("line_no") > skip)
    if rows is not None:
        lines = lines.where(F.col("line_no") <= skip + rows)
    parts = F.split(stripped(F.col("line")), r"\s+")
    out = lines.where(stripped(F.col("line")) != "").select("file", "line_no", *(F.get(parts, F.lit(k)).try_cast(f.dataType).alias(f.name) for k, f in enumerate(schema.fields)))
    numbers = [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]
    return missing_to_null(out, numbers, missing) if missing else out


def headed_table(spark: SparkSession, path: str, header_line: int, missing: tuple[float, ...] = (9999.0,)) -> DataFrame:
    """A survey file whose column names stand on line `header_line` (from 1, slashes dropped); all columns are doubles."""
    lines = numbered_lines(spark, path)
    names = lines.where(F.col("line_no") == header_line).select(F.split(stripped(F.regexp_replace("line", "/", " ")), r"\s+").alias("n")).first()["n"]
    return whitespace_table(spark, path, T.StructType([T.StructField(n, T.DoubleType()) for n in names]), header_line, None, missing)


def csv_table(spark: SparkSession, path: str, schema: T.StructType, missing: tuple[float, ...] = ()) -> DataFrame:
    out = spark.read.schema(schema).option("header", True).option("timestampFormat", "yyyy-MM-dd[ HH:mm:ss]").csv(path)
    numbers = [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]
    return missing_to_null(out, numbers, missing) if missing else out


def json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(key, pos, value) of JSON objects whose values are arrays of numbers."""
    maps = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<double>>").alias("m"))
    return maps.select(F.explode("m").alias("key", "v")).select("key", F.posexplode("v").alias("pos", "value"))


def sections(lines: DataFrame, by: list[str], order: str, line: str, header: str) -> DataFrame:
    """Each line with the title of the section it stands in: group 1 of the last match of `header` at or above it; header lines and blank lines go."""
    title = F.regexp_extract(line, header, 1)
    marked = lines.withColumn("_t", F.when(F.col(line).rlike(header), title))
    out = marked.withColumn("section", F.last("_t", True).over(Window.partitionBy(*by).orderBy(order)))
    return out.where(F.col("_t").isNull() & F.col("section").isNotNull() & (F.trim(line) != "")).drop("_t")


def layered_array(spark: SparkSession, path: str) -> DataFrame:
    """(file, node from 1, value) of array files: values parted by white space, or CONSTANT v as node 0. Nodes are numbered by file, from the words of the lines before."""
    lines = numbered_lines(spark, path).withColumn("line", stripped(F.col("line"))).where("line <> ''")
    constant = F.regexp_extract("line", r"(?i)^\s*CONSTANT\s+(\S+)", 1)
    words = lines.where(constant == "").select("file", "line_no", F.split("line", r"\s+").alias("w"))
    before = F.coalesce(F.sum(F.size("w")).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nodes = words.withColumn("_b", before).select("file", "_b", F.posexplode("w").alias("k", "v")).select("file", (F.col("_b") + F.col("k") + 1).cast("int").alias("node"), F.col("v").try_cast("double").alias("value"))
    return nodes.unionByName(lines.where(constant != "").select("file", F.lit(0).alias("node"), constant.try_cast("double").alias("value")))


def cell_of_node(node: Column, rows: int, cols: int) -> tuple[Column, Column, Column]:
    """Layer, row and column (from 1) of a node number from 1 that runs along rows, then down, then through layers."""
    k = node - 1
    return (F.floor(k / (rows * cols)) + 1).cast("int"), (F.floor(k / cols) % rows + 1).cast("int"), (k % cols + 1).cast("int")


def block_items(lines: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """(by, order, block, words): the lines between BEGIN name and END name with their words; comment lines (# or * first) and blank lines go."""
    clean = stripped(F.col(line))
    word = F.split(clean, r"\s+")
    marked = lines.select(*by, order, clean.alias("_l"), word.alias("words")).where(~F.col("_l").rlike("^([#*]|$)"))
    head = F.upper(F.get("words", F.lit(0)))
    title = F.when(head == "BEGIN", F.upper(F.get("words", F.lit(1)))).when(head == "END", "")
    out = marked.withColumn("block", F.last(title, True).over(Window.partitionBy(*by).orderBy(order)))
    return out.where(~head.isin("BEGIN", "END") & (F.coalesce("block", F.lit("")) != "")).select(*by, order, "block", "words")


def observation_lists(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, name, sim) of files with a name and a simulated value a line, all together."""
    names = T.StructType([T.StructField("name", T.StringType()), T.StructField("sim", T.DoubleType())])
    return whitespace_table(spark, paths, names).select("file", "name", "sim")


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path; where there is none it is computed and written first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # no such path, or a folder without files of a finished write
        compute().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def regular_grid(spark: SparkSession, rows: int, cols: int, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """(row, col, x, y): cell centres of a regular grid, rows from the top y0 downwards."""
    cells = spark.range(rows * cols).select((F.floor(F.col("id") / cols) + 1).cast("int").alias("row"), (F.col("id") % cols + 1).cast("int").alias("col"))
    return cells.withColumns({"x": F.lit(x0) + (F.col("col") - 0.5) * dx, "y": F.lit(y0) - (F.col("row") - 0.5) * dy})


#: Include statements that one set of block input may hold; they name files and so pass the driver.
MOST_INCLUDES = 1000


def spliced_lines(spark: SparkSession, path: str, keyword: str = "EXTERNAL") -> DataFrame:
    """(place: array that orders the lines, file, line_no, line) of a text file with the lines of the files that it includes in the place of the statements: lines whose first word begins with the keyword and whose second one is a path, taken from the folder of the file that names it.

    Included files may include others: a round reads all files that the round before has named. A place is the including
    line's place with the line's own number behind it. Raises if a file includes itself, directly or not, if it can't be
    found, or if a round names more than MOST_INCLUDES files.
    """
    words = F.split(stripped(F.col("line")), r"\s+")
    statement = F.upper(F.element_at(words, 1)).startswith(keyword) & (F.size(words) > 1) & ~F.col("line").rlike(r"^\s*[#*]")
    lines = numbered_lines(spark, path).select(F.array("line_no").alias("place"), F.array("file").alias("chain"), "file", "line_no", "line")
    out = None
    while True:
        kept = lines.where(~F.coalesce(statement, F.lit(False))).select("place", "file", "line_no", "line")
        out = kept if out is None else out.unionByName(kept)
        named = lines.where(statement).select("place", "chain", "file", F.element_at(words, 2).alias("target")).limit(MOST_INCLUDES + 1).collect()
        if not named:
            return out
        if len(named) > MOST_INCLUDES:
            raise ValueError(f"more than {MOST_INCLUDES} included files")
        rows = []
        for r in named:
            store, place = re.fullmatch(r"([^/]*:(?://[^/]*)?)?(/.*)", r["file"]).groups(default="")
            target = r["target"].strip("'\"")
            whole = target if "://" in target else store + posixpath.normpath(posixpath.join(posixpath.dirname(place), target))
            if whole in r["chain"]:
                raise ValueError(f"{whole} includes itself")
            rows.append((r["place"], r["chain"] + [whole], whole))
        asked = spark.createDataFrame(rows, "above array<long>, chain array<string>, file string")
        found = numbered_lines(spark, sorted({r[2] for r in rows}))
        lines = found.join(F.broadcast(asked), "file").select(F.concat("above", F.array("line_no")).alias("place"), "chain", "file", "line_no", "line")
