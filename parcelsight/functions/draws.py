"""Random draws as column expressions: a row's draw follows from its key alone, wherever and however often it is made."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelsight.functions import tails
from parcelsight.functions.expressions import col

#: Up to this mean a Poisson draw is counted out; above it comes from the expansion of its quantile.
COUNTED_MEAN = 50
_DIGITS = 13


def uniform(*key: str | Column) -> Column:
    """A number strictly between 0 and 1 from the text of a key without nulls: 52 bits of its MD5."""
    digest = F.md5(F.concat_ws("|", *[col(k).cast("string") for k in key]))
    return (F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16 ** _DIGITS)


def poisson(u: str | Column, mean: str | Column) -> Column:
    """The Poisson quantile of a uniform number: what the sum of ``mean`` draws of mean 1 is distributed like.

    Exact up to a mean of ``COUNTED_MEAN``; above it, the Cornish-Fisher expansion, at most one away from it.
    """
    def counted(u: Column, mean: Column) -> Column:
        first = F.exp(-mean)
        # twelve steps and ten deviations beyond the mean: the rest is below the spacing of the uniform numbers
        steps = F.sequence(F.lit(1), (mean + 10.0 * F.sqrt(mean)).cast("int") + 12)
        return F.aggregate(
            steps, F.struct(F.lit(0.0).alias("draw"), first.alias("term"), first.alias("upto")),
            lambda s, k: F.struct(
                F.when(u > s["upto"], k.cast("double")).otherwise(s["draw"]).alias("draw"), (s["term"] * mean / k).alias("term"),
                (s["upto"] + s["term"] * mean / k).alias("upto")))["draw"]

    def expanded(z: Column, mean: Column) -> Column:
        return F.floor(mean + F.sqrt(mean) * z + (z * z - 1.0) / 6.0 + (z - z * z * z) / (72.0 * F.sqrt(mean)) + 0.5)

    def either(u: Column, mean: Column) -> Column:
        return F.when(mean <= 0, 0.0).when(mean <= COUNTED_MEAN, counted(u, mean)).otherwise(
            F.greatest(tails._let(expanded, tails.normal_quantile(u), mean).cast("double"), F.lit(0.0)))

    return tails._let(either, col(u), col(mean).cast("double"))
