"""Column expressions over pixels, bands and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motecraft.config import Config


def chroma() -> Column:
    """How yellow a pixel is: the lesser of red and green, less blue."""
    return F.least("red", "green") - F.col("blue")


def is_red(cfg: Config = Config()) -> Column:
    r = F.col("red")
    return (r > F.col("green") + cfg.red_margin) & (r > F.col("blue") + cfg.red_margin) & (r > cfg.red_min_value)


def band(value: Column, edges: Sequence[float]) -> Column:
    """The number of the half-open band a value is in; null outside."""
    found = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        found = F.when((value >= low) & (value < high), i).otherwise(found)
    return found


def banded(rows: DataFrame, radius: Column, value: Column, edges: Sequence[float]) -> DataFrame:
    """Count, quantiles and population deviation of a value by band of a radius."""
    q = lambda p: F.round(F.percentile(F.col("v"), F.lit(p)), 6).alias(f"q{round(p * 100)}")
    banded_ = rows.select(band(radius, edges).alias("band"), value.alias("v")).where("band is not null")
    return banded_.groupBy("band").agg(F.count("*").alias("n"), q(0.1), q(0.5), q(0.9), F.round(F.stddev_pop("v"), 6).alias("std"))


def eigen_ratio(x: str, y: str) -> Column:
    """An aggregate: the smaller eigenvalue of the sample covariance over the larger."""
    a, b, d = F.var_samp(x), F.covar_samp(x, y), F.var_samp(y)
    middle, reach = (a + d) / 2, F.sqrt(((a - d) / 2) * ((a - d) / 2) + b * b)
    return (middle - reach) / F.greatest(middle + reach, F.lit(1e-6))


def orientation_histogram(gradients: DataFrame, keys: Sequence[str], n: int = 8) -> DataFrame:
    """Gradient magnitudes (`gx`, `gy`) by orientation, each shared by the two bins next to it."""
    turn = F.pmod(F.atan2("gy", "gx") + 2 * F.pi(), F.pi()) * (F.lit(n) / F.pi())
    rows = gradients.select(*keys, F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("m"), turn.alias("t"))
    low, part = F.floor("t").cast("int"), F.col("t") - F.floor("t")
    shares = F.array(F.struct((low % n).alias("bin"), (F.col("m") * (1 - part)).alias("v")), F.struct(((low + 1) % n).alias("bin"), (F.col("m") * part).alias("v")))
    return rows.select(*keys, F.explode(shares).alias("s")).groupBy(*keys, F.col("s.bin").alias("bin")).agg(F.sum("s.v").alias("weight"))


def casefold(name: Column) -> Column:
    """A name without case: capitals first, which also writes out ß and ligatures, and one form of the Greek sigma."""
    # the step between also keeps the optimizer from leaving out `upper` below `lower`
    return F.translate(F.lower(F.replace(F.upper(name), F.lit("ẞ"), F.lit("SS"))), "ς", "σ")


def valid_file_name(name: Column, suffixes: Sequence[str], longest: int = 255) -> Column:
    """A plain file name: not too long, no control characters or separators, one of the suffixes."""
    return (
        F.length(name).between(1, longest)
        & ~name.rlike(r"[\x00-\x1f\x7f/\\:]")
        & ~name.isin(".", "..")
        & F.lower(name).rlike(r"\.(" + "|".join(suffixes) + ")$")
    )


def edge_contrast(value: Column, inside: Column) -> Column:
    """An aggregate: the mean inside less the median around."""
    return F.avg(F.when(inside, value)) - F.percentile(F.when(~inside, value), F.lit(0.5))


def rim_depth(rows: DataFrame, keys: Sequence[str], direction: Column, value: Column, centre: Column, quantile: float = 0.2) -> DataFrame:
    """How much darker the darkest sample in most directions is than the centre, by `keys`: `depth`."""
    lows = rows.groupBy(*keys, direction.alias("direction")).agg(F.min(value).alias("low"), F.max(centre).alias("centre"))
    return lows.groupBy(*keys).agg(F.percentile(F.col("centre") - F.col("low"), F.lit(quantile)).alias("depth"))


def covered(depth: Column, threshold: float) -> Column:
    """An aggregate: the share of samples deeper than a threshold."""
    return F.avg((depth > threshold).cast("double"))


def mass_offset(weight: Column, x: Column, y: Column) -> Column:
    """An aggregate: how far the weighted centre lies from the origin."""
    total = F.greatest(F.sum(weight), F.lit(1e-5))
    cx, cy = F.sum(weight * x) / total, F.sum(weight * y) / total
    return F.sqrt(cx * cx + cy * cy)


def harmonic(value: Column, turn: Column, k: int) -> Column:
    """An aggregate: the size of the k-th harmonic of values around a circle (`turn` in radians)."""
    a, b = F.sum(value * F.cos(turn * k)), F.sum(value * F.sin(turn * k))
    return F.sqrt(a * a + b * b) / F.count(value)


def first_minimum(value: Column, position: Column) -> Column:
    """An aggregate: the first position of the least value."""
    return F.min(F.struct(value.alias("v"), position.alias("p")))["p"]
