"""Class probabilities from resistivity, dominant classes and power-mean block parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrostrata.functions.numeric import normal_cdf, standard_log


@dataclass(frozen=True)
class ClassCurve:
    """Lognormal curve of a class: shape (sigma), location and scale."""

    name: str
    shape: float
    location: float
    scale: float

    @property
    def peak(self) -> float:
        return self.scale + self.location

    @property
    def mu(self) -> float:
        """ln(m^2 / sqrt(s^2 + m^2)) of mean `scale` and deviation `shape`."""
        import math

        return math.log(self.scale**2 / math.sqrt(self.shape**2 + self.scale**2))


def class_shares(rho: Column, curves: list[ClassCurve], half: float = 1.0, least: float = 1e-10) -> Column:
    """Array of class shares: the curves' probability in a window of 2 * half about rho, normalised.

    Below the least peak the class of that peak has share 1, above the greatest peak the class of that one;
    probabilities under `least` count as 0; null where rho is null or no curve has any probability.
    """

    peaks = [c.peak for c in curves]
    only = lambda k: F.array(*(F.lit(1.0 if i == k else 0.0) for i in range(len(curves))))
    # Lambda arguments are evaluated once, however often the approximation names them.
    at = F.array(*(F.struct((rho - c.location).alias("x"), F.lit(c.mu).alias("mu"), F.lit(c.shape).alias("sigma")) for c in curves))

    def prob(c: Column) -> Column:
        ends = F.array(c["x"] + half, c["x"] - half)
        cdf = F.transform(F.transform(ends, lambda x: standard_log(x, c["mu"], c["sigma"])), lambda z: F.coalesce(normal_cdf(z), F.lit(0.0)))
        return F.transform(F.array(cdf), lambda p: F.when(p[0] - p[1] < least, 0.0).otherwise(p[0] - p[1]))[0]

    sums = F.transform(F.array(F.transform(at, prob)), lambda raw: F.struct(raw.alias("raw"), F.aggregate(raw, F.lit(0.0), lambda a, b: a + b).alias("total")))
    shares = F.transform(sums, lambda s: F.when(s["total"] > 0, F.transform(s["raw"], lambda x: x / s["total"])))[0]
    return F.when(rho < min(peaks), only(peaks.index(min(peaks)))).when(rho > max(peaks), only(peaks.index(max(peaks)))).otherwise(shares)


def dominant(shares: Column, names: list[str]) -> Column:
    """Name of the greatest share; TIE where it is shared."""
    top = F.array_max(shares)
    n = F.size(F.filter(shares, lambda x: x == top))
    return F.when(n > 1, "TIE").otherwise(F.array(*map(F.lit, names))[F.array_position(shares, top).cast("int") - 1])


def ranked_shares(shares: Column) -> tuple[Column, Column, Column]:
    """Sum, greatest and second greatest of an array of shares (the second equals the first in a tie)."""
    down = F.sort_array(shares, False)
    return F.aggregate(shares, F.lit(0.0), lambda a, b: a + b), down[0], F.get(down, F.lit(1))


def infer_last(shares: list[Column]) -> Column:
    """The last class as what the others leave of 1."""
    total = F.lit(0.0)
    for s in shares:
        total = total + s
    return F.greatest(F.lit(0.0), 1 - total)


def block_parameters(fractions: DataFrame, params: DataFrame, by: list[str], p: float) -> DataFrame:
    """Power means over classes of a block: kh, kv, ss, sy; p = 0 is the geometric mean.

    fractions: by, class, fraction, depth. params: class, kmin, dk (Kmax - Kmin), kd, ss, sy, aniso.
    Conductivity falls with depth, kmin + dk * exp(-kd * depth); fractions are normalised by their sum.
    """
    rows = fractions.where("fraction >= 0").join(F.broadcast(params), "class")  # params: one row a class, a stated list
    kh = F.col("kmin") + F.col("dk") * F.exp(-F.col("kd") * F.col("depth"))
    rows = rows.withColumns({"_kh": kh, "_kv": kh / F.col("aniso")})
    total = F.nullif(F.sum("fraction"), F.lit(0.0))

    def mean(c: str) -> Column:
        if p == 0:  # the limit of the power mean
            return F.exp(F.sum(F.col("fraction") * F.ln(c)) / total)
        return F.pow(F.sum(F.col("fraction") * F.pow(F.col(c), F.lit(p))) / total, F.lit(1 / p))

    return rows.groupBy(*by).agg(mean("_kh").alias("kh"), mean("_kv").alias("kv"), mean("ss").alias("ss"), mean("sy").alias("sy"))


#: Texture words of lithology logs by class.
TEXTURE_CLASSES = {
    "shale": "Fine", "claystone": "Fine",
    "clay": "Mixed_Fine", "silt": "Mixed_Fine", "loam": "Mixed_Fine", "top soil": "Mixed_Fine",
    "sand": "Sand",
    "gravel": "Mixed_Coarse", "cobbles": "Mixed_Coarse",
    "boulders": "Very_Coarse", "sandstone": "Very_Coarse", "lava": "Very_Coarse", "lime": "Very_Coarse", "rock": "Very_Coarse",
}


def reclassify(c: Column, table: dict[str, str] | None = None) -> Column:
    """A class for each word of the table, the word itself otherwise."""
    pairs = F.create_map(*(F.lit(x) for kv in (table or TEXTURE_CLASSES).items() for x in kv))
    return F.coalesce(pairs[c], c)
