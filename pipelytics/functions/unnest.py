"""Turning computed arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: Column, marker: str) -> DataFrame:
    """One row per struct of ``array``; rows with an empty array vanish.

    A plain ``inline`` makes the optimizer put a size check of the array below
    the scan, which computes an expensive array a second time. The outer form
    with a filter on ``marker``, a field that is never null, does not.
    """
    return df.select(*keep, F.inline_outer(array)).where(F.col(marker).isNotNull())
