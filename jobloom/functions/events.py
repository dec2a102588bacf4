"""Subscription events to profile status."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .dates import epoch_to_ts
from .text import col


def event_status(type_, mode, status, customer) -> Column:
    """The new status, or null when the event changes nothing."""
    kind, has_customer = col(type_), F.coalesce(col(customer), F.lit("")) != ""
    return (
        F.when((kind == "checkout.session.completed") & (col(mode) == "subscription") & has_customer,
               "active")
        .when(kind == "customer.subscription.updated",
              F.when(col(status) == "active", "active").otherwise("cancelled"))
        .when(kind == "customer.subscription.deleted", "cancelled")
        .when((kind == "invoice.payment_failed") & has_customer, "past_due")
    )


def event_end(type_, period_end) -> Column:
    """Only an update carries the end of the paid period."""
    return F.when(col(type_) == "customer.subscription.updated", epoch_to_ts(period_end))
