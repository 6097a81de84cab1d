"""Normal distribution function as a column.

Spark has no ``erf``. The even/odd split keeps one polynomial: W. J. Cody style rational forms need three
ranges, so we take Graeme West's double-precision form of Hart's algorithm (two ranges, error below 1e-14).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Coefficients of the published approximation, highest power first.
NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]


def _horner(x, coefficients):
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * x + c
    return total


def normal_cdf(z: Column) -> Column:
    x = F.abs(z)
    tail = F.exp(-x * x / 2.0)
    near = tail * _horner(x, [F.lit(c) for c in NUMERATOR]) / _horner(x, [F.lit(c) for c in DENOMINATOR])
    frac = x + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = x + F.lit(k) / frac
    far = tail / frac / 2.506628274631
    upper = F.when(x > 37.0, F.lit(0.0)).when(x < 7.07106781186547, near).otherwise(far)
    return F.when(z.isNull(), F.lit(None).cast("double")).when(z > 0, 1.0 - upper).otherwise(upper)


def normal_cdf_sql(z: str) -> str:
    """The same formula as SQL text for tables checked elsewhere."""
    x = f"abs({z})"

    def horner(coefficients):
        total = f"CAST({coefficients[0]!r} AS DOUBLE)"
        for c in coefficients[1:]:
            total = f"({total} * {x} + CAST({c!r} AS DOUBLE))"
        return total

    frac = f"({x} + 0.65)"
    for k in (4, 3, 2, 1):
        frac = f"({x} + {k} / {frac})"
    near = f"exp(-{x} * {x} / 2.0) * {horner(NUMERATOR)} / {horner(DENOMINATOR)}"
    far = f"exp(-{x} * {x} / 2.0) / {frac} / 2.506628274631"
    upper = f"(CASE WHEN {x} > 37 THEN 0.0 WHEN {x} < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} > 0 THEN 1.0 - {upper} ELSE {upper} END)"
