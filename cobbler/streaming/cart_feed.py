"""The cart change feed as a Structured Streaming query (the common case of :mod:`.feeds`).

Each micro-batch of cart changes is applied to the current cart with
:func:`cobbler.operators.cart.apply_cart_changes`; the new cart replaces the
old one and the per-request statuses are appended.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.jobs import cart_changes_job
from ..sources import schemas
from .feeds import start_feed


def start_cart_feed(spark: SparkSession, root: str, changes_dir: str, checkpoint_location: str,
                    feed: str = "cart", available_now: bool = True,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the cart stream; each micro-batch is published as the shop's next batch."""
    return start_feed(spark, root, changes_dir, schemas.CART_CHANGES, cart_changes_job, checkpoint_location,
                      feed, available_now, max_files_per_trigger)
