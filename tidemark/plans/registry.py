"""All registered queries: name to (Spark query, SQL or None)."""

from __future__ import annotations

from tidemark.plans import changes, ingest, market, quality, text, vectors

ALL = {
    **market.QUERIES,
    **changes.QUERIES,
    **ingest.QUERIES,
    **text.QUERIES,
    **vectors.QUERIES,
    **quality.QUERIES,
}
