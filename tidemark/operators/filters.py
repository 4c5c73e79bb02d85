"""Row filters shared by the searches and the aggregates, so their numbers agree."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _since(column: str, within_days: int, now: datetime | Column | None) -> Column:
    """Compared in the column's own type, so the bound folds to a literal and is pushed down."""
    moment = F.current_timestamp() if now is None else (F.lit(now) if isinstance(now, datetime) else now)
    return F.col(column) >= moment - F.expr(f"INTERVAL {int(within_days)} DAYS")


def market_filter(
    postings: DataFrame,
    *,
    text_hits: DataFrame | None = None,
    within_days: int | None = None,
    area_id: int | None = None,
    now: datetime | Column | None = None,
    include_archived: bool = True,
) -> DataFrame:
    """Postings of one market slice.

    `text_hits` is the result of a text match; no hits frame means no text condition.
    `now` is a parameter so that a report can be repeated.  Archived postings count by default.
    """
    out = postings
    if area_id is not None:
        out = out.where(F.col("area_id") == area_id)
    if within_days is not None:
        out = out.where(_since("published_at", within_days, now))
    if not include_archived:
        out = out.where(~F.coalesce("archived", F.lit(False)))
    if text_hits is not None:
        out = out.join(text_hits.select("posting_id"), "posting_id", "left_semi")
    return out


def search_filter(
    postings: DataFrame,
    *,
    salary_min: int | None = None,
    experience_ids: Sequence[str] = (),
    remote_only: bool = False,
    **market,
) -> DataFrame:
    """Market slice narrowed for a search.  A posting without a salary fails `salary_min`."""
    out = postings
    if salary_min is not None:
        out = out.where(F.col("salary_from_base") >= salary_min)
    if experience_ids:
        out = out.where(F.col("experience_id").isin(*experience_ids))
    if remote_only:
        out = out.where(F.col("is_remote"))
    return market_filter(out, **market)
