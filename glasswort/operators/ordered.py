"""Sums and ranks in the order of a key, without a window over the whole table.

The key's range is cut into buckets; sums of buckets are added up first
(BUCKETS rows a group at most), and each bucket is then scanned on its own
from the sum of those before it.  Any bucket function that grows with the
key is right; how even it is decides only the balance.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def unit_bucket(x: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of a number in [0, 1]; what lies outside goes to the ends."""
    return F.least(F.greatest(F.floor(x * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")


def hash_bucket(digest: Column, buckets: int = 4096) -> Column:
    """Bucket of a hexadecimal digest by its first three digits."""
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def sums_before(
    table: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], sums: Mapping[str, str], whole: Mapping[str, str] | None = None
) -> DataFrame:
    """table with, for each name: column of sums, the column's sum over the group's rows before this one, and for each of whole over all of them.

    whole's columns are among those of sums.
    """
    by, cut = list(by), "__bucket"
    cols = {name: f"__{name}_in" for name in sums}
    placed = table.select("*", bucket.alias(cut))
    totals = placed.groupBy(*by, cut).agg(*[F.sum(c).alias(cols[n]) for n, c in sums.items()])
    ahead = Window.partitionBy(*by).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    all_of = {n: cols[next(k for k, c in sums.items() if c == column)] for n, column in (whole or {}).items()}
    group = Window.partitionBy(*by)
    totals = totals.select(
        *by, cut, *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in cols.values()], *[F.sum(c).over(group).alias(f"__{n}_all") for n, c in all_of.items()]
    )
    within = Window.partitionBy(*by, cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()])
    match = [inner[c].eqNullSafe(totals[c]) for c in [*by, cut]]
    joined = inner.join(totals, match[0] if len(match) == 1 else [*match])
    return joined.select(
        *[inner[c] for c in table.columns], *[(inner[n] + totals[cols[n]]).alias(n) for n in sums], *[totals[f"__{n}_all"].alias(n) for n in all_of]
    )


def ranks(table: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """table with a rank from 0 in each group."""
    one = table.select("*", F.lit(1).cast("long").alias("__one"))
    return sums_before(one, by, bucket, order, {name: "__one"}).drop("__one")
