"""Roll-ups of a market that stay exact while postings are upserted.

A roll-up is a table of row counts `n` per (slice columns, amount), null amounts included, so
totals, counts by slice and continuous percentiles all follow from it and never from the postings.
A batch changes it by signed differences: minus one for the version of a touched posting that was
there, plus one for the version that is there now.  Its size is bounded by the distinct whole amounts
of a slice, not by the postings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.market import SALARY, amount_counts, percentile_of

QUARTILES = (0.25, 0.5, 0.75)


def rollup(rows: DataFrame, keys: Sequence[str], amount: str = SALARY) -> DataFrame:
    """Counts `n` per (keys, amount) of a whole table; combined map-side."""
    return amount_counts(rows, keys, amount)


def signed_changes(
    before: DataFrame, after: DataFrame, keys: Sequence[str], amount: str = SALARY
) -> DataFrame:
    """Differences `n` per (keys, amount) between two versions of the touched rows.

    Only the touched rows are needed: a row that is the same in both cancels out.
    """
    columns = [*keys, amount]
    both = before.select(*columns, F.lit(-1).alias("sign")).unionByName(
        after.select(*columns, F.lit(1).alias("sign"))
    )
    return both.groupBy(*columns).agg(F.sum("sign").alias("n")).where(F.col("n") != 0)


def apply_changes(counts: DataFrame, changes: DataFrame, keys: Sequence[str], amount: str = SALARY) -> DataFrame:
    """The roll-up after a batch.  Nulls are a value like any other; counts of zero leave it.

    A negative count means that the changes do not belong to this roll-up: the query fails.
    """
    merged = counts.select(*keys, amount, "n").unionByName(changes.select(*keys, amount, "n"))
    summed = merged.groupBy(*keys, amount).agg(F.sum("n").alias("n")).where(F.col("n") != 0)
    wrong = F.raise_error(F.lit("these changes do not belong to this roll-up")).cast("long")
    return summed.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(wrong))


def slice_statistics(
    counts: DataFrame, keys: Sequence[str], amount: str = SALARY, shares: Sequence[float] = QUARTILES
) -> DataFrame:
    """Per slice: `total`, `with_amount` and the percentiles `p25`, `p50`, `p75` of the known amounts.

    Coarser slices come from the same roll-up: leave keys out.
    """
    known = F.when(F.col(amount).isNotNull(), F.col("n")).otherwise(0)
    percentiles = [percentile_of(amount, x).alias(f"p{round(x * 100)}") for x in shares]
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum(known).alias("with_amount"), *percentiles
    )
