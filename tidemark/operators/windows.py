"""Splitting a time range into windows that hold at most `cap` rows each."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MICRO = timedelta(microseconds=1)


def bisect_windows(
    df: DataFrame,
    ts: str,
    start: datetime,
    end: datetime,
    cap: int = 2000,
    min_width: timedelta = timedelta(hours=1),
) -> DataFrame:
    """Windows found by halving `[start, end)` while one is over-full and wider than `min_width`.

    Rows `(level, window_start, window_end, n, over_full)` for the windows that hold rows.
    All levels come from one pass: rows are counted per finest window (a hot window combines
    map-side), the counts are added up per ancestor, and a window stays when it is not
    split itself but its parent is.  Windows are half-open, so no row is counted twice.
    """
    width = (end - start) // _MICRO
    depth = 0
    while width > (min_width // _MICRO) * 2**depth:
        depth += 1
    parts = 2**depth
    wide = "bigint" if width * parts < 2**62 else "decimal(38,0)"
    kind = df.schema[ts].dataType

    # in the column's own type, so that a zoneless time never meets the session's zone
    first, last = (F.lit(t.isoformat(sep=" ")).cast(kind) for t in (start, end))
    seconds = (F.col(ts) - first).cast("interval second").cast("decimal(20,6)")
    offset = (seconds * 1_000_000).cast("bigint")
    scaled = (offset + 1).cast(wide) * F.lit(parts).cast(wide) - F.lit(1).cast(wide)
    leaf = F.expr("_scaled div _width")
    counts = (
        df.where((F.col(ts) >= first) & (F.col(ts) < last))
        .select(scaled.alias("_scaled"), F.lit(width).cast(wide).alias("_width"))
        .groupBy(leaf.cast("bigint").alias("leaf"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    nodes = (
        counts.select("leaf", "n", levels.alias("level"))
        .groupBy("level", F.expr(f"shiftright(leaf, {depth} - level)").alias("place"))
        .agg(F.sum("n").alias("n"))
    )
    # the two halves of a window meet in one group, and add up to it
    halves = (
        nodes.groupBy("level", F.expr("shiftright(place, 1)").alias("parent"))
        .agg(F.sum("n").alias("total"), F.collect_list(F.struct("place", "n")).alias("half"))
        .where((F.col("level") == 0) | (F.col("total") > cap))
    )
    kept = halves.select("level", F.inline("half")).where(
        (F.col("n") <= cap) | (F.col("level") == depth)
    )

    def edge(place: str) -> str:
        micros = f"cast(cast({width} as decimal(38,0)) * ({place}) div shiftleft(1L, level) as bigint)"
        return f"timestampadd(MICROSECOND, {micros}, _start)"

    return (
        kept.withColumn("_start", first)
        .select(
            "level",
            F.expr(edge("place")).cast(kind).alias("window_start"),
            F.expr(edge("place + 1")).cast(kind).alias("window_end"),
            "n",
            (F.col("n") > cap).alias("over_full"),
        )
    )
