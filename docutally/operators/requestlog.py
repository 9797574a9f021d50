"""Request-log analytics and display tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docutally import fixed_values as fv
from docutally.functions import display

RECENT_FIELDS = ["vendor_name", "invoice_number", "invoice_date", "total_amount", "currency"]


def _stats() -> list[Column]:
    total, good = F.count(F.lit(1)), F.count_if("success")
    mean = F.round(F.avg("latency_seconds"), 3)
    return [
        total.alias("total_requests"),
        good.alias("successful_requests"),
        F.when(total > 0, F.round(good / F.nullif(total, F.lit(0)), 4)).otherwise(0.0).alias("success_rate"),
        F.when(F.avg("latency_seconds") != 0, mean).alias("average_latency_seconds"),
        F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0)).cast("double"), 6).alias("total_estimated_cost_usd"),
    ]


def stats(log: DataFrame) -> DataFrame:
    """Totals over all requests: one row, also for an empty log."""
    return log.agg(*_stats())


def stats_by_model(log: DataFrame) -> DataFrame:
    return log.groupBy("model_name").agg(*_stats())


def stats_of_totals(totals: DataFrame) -> DataFrame:
    """The statistics per model from sums that were kept per model (see ``sources.requestlog.totals``)."""
    mean = F.col("latency") / F.nullif("timed", F.lit(0))
    return totals.select(
        "model_name",
        F.col("requests").alias("total_requests"),
        F.col("successes").alias("successful_requests"),
        F.round(F.col("successes") / F.col("requests"), 4).alias("success_rate"),
        F.when(mean != 0, F.round(mean, 3)).alias("average_latency_seconds"),
        F.round(F.col("cost").cast("double"), 6).alias("total_estimated_cost_usd"),
    )


def recent(log: DataFrame, limit: int = fv.RECENT_LIMIT) -> DataFrame:
    """The newest ``limit`` requests with the display fields of their invoice.

    The JSON is read after the limit, for the kept rows only.
    """
    newest = log.orderBy(F.desc("created_at"), "job_id").limit(limit)
    return newest.select(
        "job_id",
        "model_name",
        "success",
        "error",
        *[F.get_json_object("invoice_json", f"$.{f}").alias(f) for f in RECENT_FIELDS],
        "latency_seconds",
        "estimated_cost_usd",
        "created_at",
    )


def latency_trend(log: DataFrame, limit: int = fv.RECENT_LIMIT) -> DataFrame:
    """The recent requests oldest first, numbered after leaving out those without a latency."""
    rows = recent(log, limit).where(F.col("latency_seconds").isNotNull())
    # The window sees at most ``limit`` rows.
    number = F.row_number().over(Window.orderBy("created_at", F.desc("job_id")))
    return rows.select(
        F.concat(F.lit("Job "), number.cast("string")).alias("job"),
        display.shown("invoice_number", "Unknown").alias("invoice"),
        "latency_seconds",
    )


def recent_report(log: DataFrame, limit: int = fv.RECENT_LIMIT) -> DataFrame:
    return recent(log, limit).select(
        "job_id",
        display.shown("invoice_number").alias("invoice"),
        display.shown("vendor_name").alias("vendor"),
        display.money("total_amount", "currency").alias("total"),
        display.status("success").alias("status"),
        display.shown("model_name", "Unknown").alias("model"),
        display.latency("latency_seconds").alias("latency"),
        display.cost("estimated_cost_usd").alias("cost"),
    )


def item_table(invoices: DataFrame, keys: list[str], invoice: str = "invoice") -> DataFrame:
    """One display row per line item; invoices without items give none."""
    items = invoices.select(*keys, F.col(f"{invoice}.currency").alias("_currency"), F.posexplode(f"{invoice}.line_items"))
    return items.select(
        *keys,
        F.col("pos").alias("item_pos"),
        display.shown("col.description").alias("description"),
        F.col("col.quantity").alias("qty"),
        display.money("col.unit_price", "_currency").alias("unit_price"),
        display.money("col.total", "_currency").alias("total"),
    )
