"""Exact row numbers and running sums of long series without one task a series.

A series is cut into slices at approximate quantiles of its ordering column. Slices are counted,
their counts are summed up (one row a slice), and rows are numbered inside their slice only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_SERIES = 1000


def sliced(rows: DataFrame, by: tuple[str, ...], order: str, slices: int) -> DataFrame:
    """Adds ``slice``, which never falls along ``order``; with very many series each is one slice.

    The splitters pass the driver (``slices`` values a series, ``MOST_SERIES`` series at most),
    so that every use of the result cuts at the same values.
    """
    shares = F.array(*[F.lit(k / slices) for k in range(1, slices)])
    cuts = rows.groupBy(*by).agg(F.percentile_approx(order, shares, 1000).alias("cuts"))
    held = cuts.limit(MOST_SERIES + 1).collect() if slices > 1 else []
    if not held or len(held) > MOST_SERIES:
        return rows.withColumn("slice", F.lit(0))
    table = rows.sparkSession.createDataFrame(held, cuts.schema)
    place = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x < F.col(order))), F.lit(0))
    if not by:
        return rows.crossJoin(F.broadcast(table)).withColumn("slice", place(F.col("cuts"))).drop("cuts")
    own = table.select(*[F.col(c).alias(f"__{c}") for c in by], "cuts")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return rows.join(F.broadcast(own), same, "left").withColumn("slice", place(F.col("cuts"))).drop("cuts", *[f"__{c}" for c in by])


def running(rows: DataFrame, by: tuple[str, ...], order: list[Column | str], first: str, sums: dict[str, Column], slices: int = 32) -> DataFrame:
    """Adds for every name the sum of its column over all rows up to and with each row, in ``order`` within ``by``.

    ``first`` is the leading ordering column, ascending, on which slices are cut.
    """
    cut = sliced(rows, by, first, slices)
    parts = cut.groupBy(*by, "slice").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    ahead = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*by, "slice", *[F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in sums])
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "slice")]
    joined = cut.alias("a").join(before.alias("b"), keys).select("a.*", *[f"b.__{n}" for n in sums])
    inside = Window.partitionBy(*by, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({n: F.sum(c).over(inside) + F.col(f"__{n}") for n, c in sums.items()})
    return out.drop("slice", *[f"__{n}" for n in sums])


def numbered(rows: DataFrame, by: tuple[str, ...], order: list[str], name: str = "rn", slices: int = 32) -> DataFrame:
    """Adds the row number from 1 in ``order`` within ``by``; the order has to be total."""
    return running(rows, by, order, order[0], {name: F.lit(1).cast("long")}, slices)
