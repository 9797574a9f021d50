"""Dataset profile. Functions take frames of labelled pairs, or of the columns they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docutally import fixed_values as fv

OPTIONAL_FIELDS = ["invoice_number", "invoice_date", "subtotal", "tax_amount"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vendor_counts(pairs: DataFrame, vendor="invoice.vendor_name", position: str = "doc_id") -> DataFrame:
    return pairs.groupBy(_col(vendor).alias("vendor_name")).agg(
        F.count(F.lit(1)).alias("n"), F.min(position).alias("first_position")
    )


def vendor_profile(
    pairs: DataFrame, vendor="invoice.vendor_name", position: str = "doc_id", top: int = 5
) -> DataFrame:
    """The ``top`` vendors (ties by first appearance) with row count and number of vendors."""
    counts = vendor_counts(pairs, vendor, position)
    sizes = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("vendors"))
    leading = counts.orderBy(F.desc("n"), "first_position").limit(top)
    return leading.select(
        "vendor_name",
        "n",
        sizes.select("rows").scalar().alias("total_rows"),
        sizes.select("vendors").scalar().alias("distinct_vendors"),
    )


def currency_share(pairs: DataFrame, currency="invoice.currency") -> DataFrame:
    counts = pairs.groupBy(_col(currency).alias("currency")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.select("currency", "n", F.round(F.col("n") / total, 4).alias("share"))


def item_count_stats(pairs: DataFrame, n_items=None) -> DataFrame:
    n = F.size("invoice.line_items") if n_items is None else _col(n_items)
    return pairs.agg(
        F.min(n).cast("bigint").alias("min_items"),
        F.max(n).cast("bigint").alias("max_items"),
        F.round(F.avg(n), 4).alias("avg_items"),
    )


def omission_rates(pairs: DataFrame, prefix: str = "invoice.") -> DataFrame:
    """One row per optional field: number and share of labels without it."""
    counted = pairs.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(prefix + f).isNull()).alias(f) for f in OPTIONAL_FIELDS]
    )
    long = counted.unpivot("n", OPTIONAL_FIELDS, "field", "missing")
    return long.select("field", "missing", F.round(F.col("missing") / F.col("n"), 4).alias("rate"))


def text_length_stats(pairs: DataFrame, text: str = "raw_text") -> DataFrame:
    n = F.char_length(text)
    return pairs.agg(
        F.min(n).cast("bigint").alias("min_chars"),
        F.max(n).cast("bigint").alias("max_chars"),
        F.round(F.avg(n), 4).alias("avg_chars"),
    )


def flagged(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per line item whose description is missing from the text, ignoring case."""
    lower = F.lower("raw_text")
    missing = F.filter(
        F.transform("invoice.line_items", lambda x, i: F.struct(i.alias("pos"), x.alias("item"))),
        lambda s: ~F.contains(lower, F.lower(s["item"]["description"])),
    )
    return pairs.select(*keys, "raw_text", F.explode(missing).alias("flag")).select(
        *keys, F.col("flag.pos").alias("item_pos"), F.col("flag.item.*"), "raw_text"
    )


def missing_descriptions(pairs: DataFrame) -> DataFrame:
    """Number of line items and of those whose description is missing from the text."""
    lower = F.lower("raw_text")
    missing = F.filter("invoice.line_items", lambda x: ~F.contains(lower, F.lower(x["description"])))
    return pairs.agg(
        F.sum(F.size("invoice.line_items")).alias("n_items"), F.sum(F.size(missing)).alias("missing")
    )


def missing_totals(pairs: DataFrame) -> DataFrame:
    """Number of labels whose total, as written, is missing from the text."""
    absent = ~F.contains(F.col("raw_text"), F.col("invoice.total_amount"))
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(absent).alias("missing"))


def duplicate_count(pairs: DataFrame, text: str = "raw_text") -> DataFrame:
    """Rows and rows beyond the first of each text. Copies are folded before the shuffle."""
    per_text = pairs.groupBy(F.xxhash64(text).alias("_hash"), text).agg(F.count(F.lit(1)).alias("copies"))
    rows, texts = F.coalesce(F.sum("copies"), F.lit(0)), F.count(F.lit(1))
    return per_text.agg(rows.alias("n"), (rows - texts).alias("duplicates"))


def flagged_items(pairs: DataFrame, keys: list[str], limit: int = fv.FLAGGED_LIMIT) -> DataFrame:
    """The first ``limit`` flagged items in file order, with their text."""
    return flagged(pairs, keys).orderBy(*keys, "item_pos").limit(limit)
