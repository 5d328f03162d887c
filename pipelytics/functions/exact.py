"""Sums and means that do not depend on the order in which rows arrive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Room for any sum of ordinary doubles, at nine decimals.
FINE = "decimal(38,9)"


def money_sum(col: str | Column) -> Column:
    """Sum of amounts in hundredths, exact, as a double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast("decimal(18,2)")).cast("double")


#: Bands of magnitude: terms from ``low`` up to below ``high`` are held as whole multiples of 1e-9 / ``factor``.
#: Scaled terms stay below 1e20, which leaves room for a billion of the largest ones.
BANDS = (
    (5e-324, 1e-9, 1e27),
    (1e-9, 1e20, 1.0),
    (1e20, 1e40, 1e-20),
)


def fine_sum(col: str | Column) -> Column:
    """Sum of terms, as a double that does not depend on the order of the rows.

    Terms are held as decimals and added as whole numbers, each in the band of its
    magnitude; the bands' sums are added at the end, from the smallest up. Ordinary
    terms are held to nine decimals; those below 1e-9 keep nine digits and more down
    to 1e-27. Only with terms of 1e40 and more, infinite ones, not-a-numbers, or a
    band that overflows is the sum the plain sum of doubles. More bands would cover
    more magnitudes, at the cost of every aggregate that sums ordinary terms.
    """
    raw = F.col(col) if isinstance(col, str) else col
    c = raw.cast("double")
    size = F.abs(c)
    none = F.lit(0).cast(FINE)
    total, lost = F.lit(0.0), F.max(size) >= BANDS[-1][1]  # a not-a-number is larger than any number
    for low, high, factor in BANDS:
        inside = (size >= low) & (size < high)
        inside = inside | (size == 0) if low == 1e-9 else inside
        # Terms of other bands count as 0, so only an overflow makes a sum null.
        added = F.try_sum(F.when(inside, (raw if factor == 1.0 else c * F.lit(factor)).try_cast(FINE)).otherwise(none))
        total = total + added.cast("double") / F.lit(factor)
        lost = lost | added.isNull()
    return F.when(F.max(size).isNotNull(), F.when(lost, F.sum(c)).otherwise(total))


def fine_mean(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.try_divide(fine_sum(c), F.count(c))


def share(condition: Column) -> Column:
    """Share of rows that satisfy a condition; null for no rows."""
    return F.try_divide(
        F.count_if(condition).cast("double"), F.count(F.lit(1)).cast("double")
    )


def moment_like(value, df, column: str) -> Column:
    """A point in time as a literal of the column's own type, so filters reach the scan."""
    return F.lit(str(value)).cast(df.schema[column].dataType)
