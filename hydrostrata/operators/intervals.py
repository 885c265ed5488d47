"""Depth intervals: overlap joins, thickness-weighted upscaling, splitting, line geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of logs in one task: what is sorted and grouped for them stays in its memory, however many tasks there are.
ROWS = 1 << 19


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """df dealt by key to tasks of about ROWS rows, which are counted first. Windows, joins and groups by the same key then stay in the task.

    Spark itself joins partitions by their compressed bytes, of which a task's sorts and groups are many times the size.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return df.repartition(tasks, *by)


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], width: float | None = None) -> DataFrame:
    """Pairs of intervals (top, bot) of one key that overlap, with the thickness they share.

    The rule is strict on one side: a.bot > b.top and b.bot >= a.top, so that intervals that only touch at a's
    top count with thickness 0. With `width`, both sides are also dealt into depth buckets of that width and
    joined on them, so that a key with very many intervals is not compared pair by pair in one task; a pair is
    kept in the bucket where its overlap begins only.
    """
    a = a.withColumnsRenamed({"top": "top_a", "bot": "bot_a"})
    b = b.withColumnsRenamed({"top": "top_b", "bot": "bot_b"})
    begins = F.greatest("top_a", "top_b")
    if width is not None:
        at = lambda c: F.floor(F.col(c) / width).cast("long")
        a = a.withColumn("_k", F.explode(F.sequence(at("top_a"), at("bot_a"))))
        b = b.withColumn("_k", F.explode(F.sequence(at("top_b"), at("bot_b"))))
        on = [*on, "_k"]
    pairs = a.join(b, on).where("bot_a > top_b and bot_b >= top_a")
    if width is not None:
        pairs = pairs.where(F.col("_k") == F.floor(begins / width)).drop("_k")
    return pairs.withColumn("thickness", F.least("bot_a", "bot_b") - begins)


def implicit_tops(df: DataFrame, by: list[str], order: list[str], bottom: str, ground: float = 0.0) -> DataFrame:
    """Logs that give bottoms only: each interval's top is the bottom above it."""
    return df.withColumn("top", F.coalesce(F.lag(bottom).over(Window.partitionBy(*by).orderBy(*order)), F.lit(ground)))


def upscale(intervals: DataFrame, layers: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Thickness-weighted means of values by (key, layer); layers (layer, top, bot) are few. Negative values are no data."""
    # A stated layer table of fixed size: one row a model layer.
    pairs = intervals.join(layers.select("layer", F.col("top").alias("_t"), F.col("bot").alias("_b")), (F.col("bot") > F.col("_t")) & (F.col("top") < F.col("_b")))
    w = F.least("bot", "_b") - F.greatest("top", "_t")

    def mean(c: str) -> Column:
        good = F.col(c) >= 0
        return (F.sum(F.when(good, F.col(c) * w)) / F.sum(F.when(good, w))).alias(c)

    return pairs.groupBy(*by, "layer").agg(*map(mean, values), F.sum(w).alias("thickness"))


def split(intervals: DataFrame, longest: float) -> DataFrame:
    """Intervals cut into ceil(thickness / longest) equal parts: part, of, and the part's mid-depth."""
    thick = F.col("bot") - F.col("top")
    out = intervals.withColumn("of", F.greatest(F.ceil(thick / longest), F.lit(1)).cast("int"))
    out = out.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("of"))))
    return out.withColumn("mid", F.col("top") + (F.col("part") - 0.5) * thick / F.col("of"))


def line_geometry(df: DataFrame, line: str, order: list[str], x: str, y: str, widest: float = 100.0) -> DataFrame:
    """Distance along each line and width to the next point.

    A line whose first x exceeds its last is turned round. A width is the distance to the next point, the
    last one the median width; distances add up the widths as they are; then widths over `widest` become the
    median.
    """
    whole = Window.partitionBy(line).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turned = F.first(x).over(whole) > F.last(x).over(whole)
    df = df.withColumn("_n", F.row_number().over(Window.partitionBy(line).orderBy(*order))).withColumn("_n", F.when(turned, -F.col("_n")).otherwise(F.col("_n")))
    w = Window.partitionBy(line).orderBy("_n")
    nx, ny = F.lead(x).over(w), F.lead(y).over(w)
    df = df.withColumn("_w", F.sqrt((nx - F.col(x)) * (nx - F.col(x)) + (ny - F.col(y)) * (ny - F.col(y))))
    df = df.withColumn("_m", F.expr("percentile(_w, 0.5)").over(Window.partitionBy(line)))
    df = df.withColumn("line_dist", F.coalesce(F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    width = F.coalesce("_w", "_m")
    return df.withColumn("line_width", F.when(width > widest, F.col("_m")).otherwise(width)).drop("_n", "_w", "_m")


def first_below(df: DataFrame, by: list[str], depth: str, classes: list[str], label: str) -> DataFrame:
    """Per key, the shallowest depth whose class is in `classes`, and the deepest depth above it."""
    hit = F.col(label).isin(classes)
    found = df.groupBy(*by).agg(F.min(F.when(hit, F.col(depth))).alias("bottom"), F.max(depth).alias("deepest"))
    return found.withColumn("bottom", F.coalesce("bottom", "deepest"))


def class_thickness(logs: DataFrame, pixels: DataFrame, on: list[str], pixel: list[str], label: str, classes: list[str]) -> DataFrame:
    """Thickness of each class (a column each) by pixel, over the log intervals that overlap it; other labels are left out. Large logs and their pixels should be `dealt` by key."""
    pairs = overlap_join(logs.where(F.col(label).isin(classes)), pixels, on)
    return pairs.groupBy(*on, *pixel).agg(*(F.sum(F.when(F.col(label) == c, F.col("thickness")).otherwise(0.0)).alias(c) for c in classes))


def bottom_scan(pixels: DataFrame, starts: DataFrame, by: list[str], classes: list[str], bedrock: float) -> DataFrame:
    """(by, pid, bottom): where a column of pixels (point, label, mid, bot: elevations) leaves or meets the bottom classes, from a start elevation.

    The scan begins at the pixel whose middle is nearest to `start`. Outside the bottom classes it walks down to the
    last pixel above one of them. Inside, if all pixels down to `bedrock` below are of these classes, it walks up to
    the first that is not (or the first pixel of all); otherwise it takes the pixel above. The bottom counts only for
    1 < pid <= the pixel nearest to `doi` (depth of investigation), and not where no pixel has a class. starts: by, start, doi.
    """
    row = F.struct("point", "label", "mid", "bot")
    a = pixels.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("a")).join(starts, by)
    near = lambda c, at: F.array_min(F.transform("a", lambda p: F.struct(F.abs(p[c] - at).alias("gap"), p["point"].alias("point"), p["label"].alias("label"), p["mid"].alias("mid"))))
    bottom = lambda p: F.coalesce(p["label"].isin(classes), F.lit(False))
    a = a.withColumns({"_at": near("mid", F.col("start")), "_deep": near("bot", F.col("doi"))["point"]}).withColumn("_bed", near("bot", F.col("_at.mid") - bedrock)["point"])
    point = lambda p: p["point"]
    at, first, last = F.col("_at.point"), F.col("a")[0]["point"], F.element_at("a", -1)["point"]
    rock = F.forall(F.filter("a", lambda p: (p["point"] >= at) & (p["point"] <= F.col("_bed"))), bottom)
    up = F.coalesce(F.array_max(F.transform(F.filter("a", lambda p: (p["point"] < at) & ~bottom(p)), point)), first)
    down = F.coalesce(F.array_min(F.transform(F.filter("a", lambda p: (p["point"] > at) & bottom(p)), point)), last) - 1
    pid = F.when(bottom(F.col("_at")), F.when(rock, up).otherwise(at - 1)).otherwise(down)
    a = a.withColumn("pid", F.when(F.exists("a", lambda p: p["label"].isNotNull()), pid))
    found = F.get(F.transform(F.filter("a", lambda p: p["point"] == F.col("pid")), lambda p: p["bot"]), F.lit(0))
    return a.select(*by, "pid", F.when((F.col("pid") > 1) & (F.col("pid") <= F.col("_deep")), found).alias("bottom"))
