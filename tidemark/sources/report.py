"""Report sink: one Parquet folder per frame and one JSON object over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames that are lists in the JSON object; the others are single rows.
LISTS = ("by_experience", "top_employers", "top_skills", "salary_by_experience", "weekly_published")


def report_object(frames: dict[str, DataFrame]) -> DataFrame:
    """One row, one JSON text.  Every frame is bounded: a total, a top list or a week series.

    The parts are tagged rows merged by one grouped aggregate, so no join is needed.
    """
    parts = None
    for name, frame in frames.items():
        body = F.to_json(F.struct(*frame.columns))
        tagged = frame.select(
            F.lit(name).alias("part"), F.monotonically_increasing_id().alias("place"), body.alias("body")
        )
        parts = tagged if parts is None else parts.unionByName(tagged)

    def fields(name: str) -> Column:
        mine = F.array_sort(
            F.collect_list(F.when(F.col("part") == name, F.struct("place", "body")))
        )["body"]
        joined = F.concat(F.lit("["), F.array_join(mine, ","), F.lit("]"))
        value = joined if name in LISTS else F.coalesce(F.get(mine, 0), F.lit("null"))
        return F.concat(F.lit(f'"{name}":'), value)

    return parts.agg(
        F.concat(F.lit("{"), F.concat_ws(",", *[fields(n) for n in frames]), F.lit("}")).alias("value")
    )


def write_report(frames: dict[str, DataFrame], path: str) -> None:
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
    report_object(frames).write.mode("overwrite").text(f"{path}/report_json")
