"""Normal distribution and exponentially weighted sums as native columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.frames import KEYS, ORDER

# Hart's rational approximation of the normal tail in double precision (Hart 1968, West 2005).
HART_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
            221.213596169931, 220.206867912376)
HART_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
            637.333633378831, 793.826512519948, 440.413735824752)
HART_SPLIT = 7.07106781186547
SQRT_2PI = 2.506628274631


def _horner(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def norm_cdf(x: Column) -> Column:
    """Φ(x) to double precision, inside whole-stage codegen. Pass a plain column: the argument is used many times."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * _horner(HART_NUM, a) / _horner(HART_DEN, a)
    far = a + 0.65
    for k in (4, 3, 2, 1):
        far = a + F.lit(float(k)) / far
    upper = F.when(a > 37, F.lit(0.0)).when(a < HART_SPLIT, near).otherwise(e / far / SQRT_2PI)
    # Φ(x) = 1/2 + sign(x) (1/2 - upper): one evaluation of the tail.
    return F.lit(0.5) + F.signum(x) * (F.lit(0.5) - upper)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def ema_reach(alpha: float) -> int:
    """Rows after which a weight falls below double precision."""
    return math.ceil(math.log(1e-16) / math.log(1 - alpha))


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


# Rows of a chunk for exponential means: few chunks, so few copies of context; the weights start anew within them.
EMA_ROWS = 8192


def ewm_stretch(s: DataFrame, reach: int) -> DataFrame:
    """A segmented frame with ``_k``, the row number in the chunk, and ``_e``, its stretch of ``reach`` rows, for `ewm_mean`.

    The rows are put in the order that all windows of `ewm_mean` share, so that none of them sorts anew.
    """
    s = s.withColumn("_k", F.row_number().over(Window.partitionBy(*KEYS, "_chunk").orderBy(*ORDER)))
    return s.withColumn("_e", F.floor(F.col("_k") / reach)).sortWithinPartitions(*KEYS, "_chunk", "_e", *ORDER)


def ewm_mean(c: Column, alpha: float, rows: int) -> Column:
    """Weighted mean Σ(1-α)^i x / Σ(1-α)^i over the chunk up to the row.

    Weights grow from 1 over a stretch of rows and then start anew, so they stay finite however long the chunk is. A row takes the
    running sums of its stretch and the decayed totals of the one before; what is older weighs less than double precision. The frame
    comes from `ewm_stretch` with ``rows`` of at least ``ema_reach(alpha)``, as must its ``lookback`` be. All means over one frame share
    its stretches, and with them one sort; only where weights over ``rows`` would leave the range of doubles a mean has stretches of its own.
    """
    reach = ema_reach(alpha)
    if rows < reach:
        raise ValueError(f"stretches of {rows} rows are too short for alpha {alpha}: {reach} are needed")
    if -math.log(1 - alpha) * rows < 600:
        reach, stretch = rows, F.col("_e")
    else:
        stretch = F.floor(F.col("_k") / reach)
    inside = Window.partitionBy(*KEYS, "_chunk", stretch).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*KEYS, "_chunk").orderBy(stretch).rangeBetween(-1, -1)
    weight = F.pow(F.lit(1.0 / (1 - alpha)), F.col("_k") - stretch * reach)
    decay = (1 - alpha) ** reach

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x).over(inside), F.lit(0.0)) + F.coalesce(F.sum(x).over(before), F.lit(0.0)) * decay

    weights = total(F.when(c.isNotNull(), weight))
    return F.when(weights > 0, total(c * weight) / weights)
