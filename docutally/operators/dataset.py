"""Labelled-dataset building: assembly, arithmetic, rendering, filters, splits, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docutally import fixed_values as fv
from docutally.functions.text import hash_draw, hash_fraction, is_blank, sha256_mod_10000
from docutally.schemas import MONEY

CENTS = "decimal(18,2)"


# --- arithmetic ----------------------------------------------------------------------
def line_total(quantity, unit_price) -> Column:
    """Quantity times unit price, rounded half up to cents."""
    quantity = F.col(quantity) if isinstance(quantity, str) else quantity
    unit_price = F.col(unit_price) if isinstance(unit_price, str) else unit_price
    return F.round(quantity * unit_price, 2).cast(CENTS)


def tax_of(subtotal, rate) -> Column:
    subtotal = F.col(subtotal) if isinstance(subtotal, str) else subtotal
    return F.round(subtotal * rate, 2).cast(CENTS)


def document_sums(lines: DataFrame, key: str = "doc_id", total: str = "total") -> DataFrame:
    """Subtotal and number of items per document, pre-aggregated before the shuffle."""
    return lines.groupBy(key).agg(
        F.sum(total).cast(CENTS).alias("subtotal"), F.count(F.lit(1)).alias("n_items")
    )


def add_totals(headers: DataFrame, rate: str = "tax_rate", omit_tax: str = "omit_tax") -> DataFrame:
    """Add ``tax`` (0 where omitted) and ``total`` to rows with a ``subtotal``."""
    tax = F.when(F.col(omit_tax), F.lit(0).cast(CENTS)).otherwise(tax_of("subtotal", F.col(rate)))
    with_tax = headers.withColumn("tax", tax)
    return with_tax.withColumn("total", (F.col("subtotal") + F.col("tax")).cast(CENTS))


def omit(condition: Column, value) -> Column:
    """``value`` unless ``condition`` says that the document leaves the field out."""
    return F.when(~condition, F.col(value) if isinstance(value, str) else value)


# --- nested assembly -----------------------------------------------------------------
def assemble_items(lines: DataFrame, order: list[str], item: Column, key: str = "doc_id", listed: Column | None = None, total: str | None = None) -> DataFrame:
    """Line rows to one ordered ``line_items`` array per document.

    The list of a document is part of its record, whatever its length; work on single lines stays on
    long rows. Lines that are not ``listed`` are left out. With ``total`` the sums of all lines (see
    :func:`document_sums`) come along, so that the lines move once for both.
    """
    line = F.struct(*order, item.alias("item"))
    line = line if listed is None else F.when(listed, line)
    # Collecting shrinks nothing before the shuffle, so rows are moved first and collected once. They are moved as they are: an item
    # repeats numbers of its line as text and takes about twice the space.
    moved = lines.repartition(key).select(key, line.alias("line"), *([] if total is None else [total]))
    sums = [] if total is None else [F.sum(total).cast(CENTS).alias("subtotal"), F.count(F.lit(1)).alias("n_items")]
    lists = moved.groupBy(key).agg(F.sort_array(F.collect_list("line")).alias("lines"), *sums)
    return lists.select(key, F.col("lines.item").alias("line_items"), *([] if total is None else ["subtotal", "n_items"]))


# --- text rendering ------------------------------------------------------------------
# One entry per layout: banner, label before each field, bullet and separator of item lines.
LAYOUTS = {
    "banner": ["INVOICE", "*** RECEIPT ***", "receipt", "STATEMENT OF ACCOUNT", "thanks for shopping!"],
    "vendor": ["Vendor: ", "SOLD BY ", "from ", "Issued by: ", "@ "],
    "number": ["Invoice #: ", "INV# ", "no. ", "Reference: ", "nr "],
    "date": ["Date: ", "DT ", "on ", "Date of issue: ", "date "],
    "bullet": ["- ", "* ", "~ ", "> ", "+ "],
    "sep": [" | ", " x ", " , ", " ; ", " .. "],
    "subtotal": ["Subtotal: ", "SUB ", "sub ", "Net amount: ", "items "],
    "tax": ["Tax: ", "TX ", "tax ", "Tax amount: ", "plus tax "],
    "total": ["Total Due: ", "TTL ", "total ", "Amount due: ", "all in "],
}
N_LAYOUTS = len(LAYOUTS["banner"])


def render_text(layout, invoice: str = "invoice") -> Column:
    """Document text of a label. Null fields are left out; every value appears unchanged."""
    layout = F.col(layout) if isinstance(layout, str) else layout

    def label(name: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in LAYOUTS[name]]), layout.cast("int"))

    def line(name: str, field: str) -> Column:
        return F.concat(label(name), F.col(f"{invoice}.{field}"))

    item_lines = F.transform(
        f"{invoice}.line_items",
        lambda x: F.concat(
            label("bullet"),
            F.call_function(
                "concat_ws", label("sep"), x["description"], x["quantity"].cast("string"), x["unit_price"], x["total"]
            ),
        ),
    )
    return F.concat_ws(
        "\n",
        label("banner"),
        line("vendor", "vendor_name"),
        line("number", "invoice_number"),
        line("date", "invoice_date"),
        item_lines,
        line("subtotal", "subtotal"),
        line("tax", "tax_amount"),
        F.concat_ws(" ", line("total", "total_amount"), F.col(f"{invoice}.currency")),
    )


# --- generation ----------------------------------------------------------------------
def generate_invoices(ids: DataFrame, key: str = "doc_id", seed: int = 0, today: str = "2024-12-31") -> DataFrame:
    """One ground-truth invoice per row of ``ids``, decided by ``seed`` and the row's key alone.

    Adds the label as ``invoice`` (the JSON form: dates and amounts are strings).
    """

    def draw(slot: str, *more) -> Column:
        return hash_draw(F.lit(f"{seed}:{slot}"), F.col(key).cast("string"), *more)

    def fraction(slot: str, *more) -> Column:
        return hash_fraction(F.lit(f"{seed}:{slot}"), F.col(key).cast("string"), *more)

    def pick(values, number: Column) -> Column:
        return F.get(values, (number % F.size(values)).cast("int"))

    def cents(low: int, high: int, number: Column) -> Column:
        span = (high - low) * 100 + 1
        return ((number % span + low * 100) / F.lit(100)).cast(CENTS)

    def literals(values) -> Column:
        return F.array(*[F.lit(v) for v in values])

    names = literals(name.replace("{name}", "%s") for name, _ in fv.VENDOR_TEMPLATES)
    pools = F.array(*[literals(pool) for _, pool in fv.VENDOR_TEMPLATES])
    template = (draw("vendor") % len(fv.VENDOR_TEMPLATES)).cast("int")
    drawn = ids.select(
        "*",
        F.replace(F.get(names, template), F.lit("%s"), pick(literals(fv.NAME_PREFIXES), draw("name"))).alias("_vendor"),
        F.get(pools, template).alias("_pool"),
        (draw("items") % fv.MAX_ITEMS + 1).cast("int").alias("_n"),
        pick(literals(fv.CURRENCIES), draw("currency")).alias("_currency"),
        pick(literals(fv.TAX_RATES), draw("rate")).cast("decimal(5,4)").alias("tax_rate"),
        (fraction("omit-tax") < fv.OMIT_TAX).alias("omit_tax"),
        (fraction("omit-subtotal") < fv.OMIT_SUBTOTAL).alias("_omit_subtotal"),
        F.concat(
            F.lit("INV-"),
            (draw("number") % 9000 + 1000).cast("string"),
            F.lit("-"),
            F.chr(draw("letter1") % 26 + 65),
            F.chr(draw("letter2") % 26 + 65),
        ).alias("_number"),
        (fraction("omit-number") < fv.OMIT_NUMBER).alias("_omit_number"),
        F.date_sub(F.lit(today).cast("date"), (draw("date") % (fv.DATE_WINDOW_DAYS + 1)).cast("int")).alias("_date"),
        (fraction("omit-date") < fv.OMIT_DATE).alias("_omit_date"),
    )
    # Without replacement while the pool lasts (the pool in hash order), then with replacement.
    shuffled = F.array_sort(F.transform("_pool", lambda d: F.struct(draw("order", d).alias("r"), d.alias("d"))))
    chosen = drawn.withColumn("_shuffled", F.transform(shuffled, lambda s: s["d"])).withColumn(
        "_chosen",
        F.transform(
            F.sequence(F.lit(1), F.col("_n")),
            lambda i: F.struct(
                F.when(i <= F.size("_pool"), F.get("_shuffled", i - 1))
                .otherwise(pick(F.col("_pool"), draw("again", i.cast("string"))))
                .alias("description"),
                (fraction("flat", i.cast("string")) < fv.FLAT_ITEM_RATE).alias("flat"),
                pick(literals(float(q) for q in fv.QUANTITIES), draw("quantity", i.cast("string"))).alias("q"),
                cents(*fv.UNIT_PRICE_RANGE, draw("price", i.cast("string"))).alias("u"),
                cents(*fv.FLAT_TOTAL_RANGE, draw("total", i.cast("string"))).alias("t"),
            ),
        ),
    )
    priced = chosen.withColumn(
        "_items",
        F.transform(
            "_chosen",
            lambda c: F.struct(
                c["description"].alias("description"),
                F.when(~c["flat"], c["q"]).alias("quantity"),
                F.when(~c["flat"], c["u"]).alias("unit_price"),
                F.when(c["flat"], c["t"]).otherwise(line_total(c["q"].cast("decimal(10,1)"), c["u"])).alias("total"),
            ),
        ),
    ).withColumn(
        "subtotal",
        F.aggregate("_items", F.lit(0).cast(CENTS), lambda total, x: (total + x["total"]).cast(CENTS)),
    )
    money = add_totals(priced)
    return money.select(
        *ids.columns,
        F.struct(
            F.col("_vendor").alias("vendor_name"),
            omit(F.col("_omit_number"), "_number").alias("invoice_number"),
            omit(F.col("_omit_date"), F.col("_date").cast("string")).alias("invoice_date"),
            F.transform(
                "_items",
                lambda x: F.struct(
                    x["description"].alias("description"),
                    x["quantity"].alias("quantity"),
                    x["unit_price"].cast("string").alias("unit_price"),
                    x["total"].cast("string").alias("total"),
                ),
            ).alias("line_items"),
            omit(F.col("_omit_subtotal"), F.col("subtotal").cast("string")).alias("subtotal"),
            omit(F.col("omit_tax"), F.col("tax").cast("string")).alias("tax_amount"),
            F.col("total").cast("string").alias("total_amount"),
            F.col("_currency").alias("currency"),
        ).alias("invoice"),
    )


# --- quality filter, de-duplication, split, counters ---------------------------------
def roundtrip_ok(success, total, vendor, target_total, target_vendor) -> Column:
    """True where an extraction recovered the target's total (within 0.05) and vendor."""
    off = F.abs(F.col(total).try_cast(MONEY) - F.col(target_total).try_cast(MONEY))
    first_word = F.lower(F.get(F.split(F.trim(F.col(target_vendor)), r"\s+"), F.lit(0)))
    close = off <= F.lit(fv.ROUNDTRIP_TOLERANCE).cast(MONEY)
    return F.coalesce(F.col(success) & close & F.contains(F.lower(vendor), first_word), F.lit(False))


def first_per_text(rows: DataFrame, text: str, order: str) -> DataFrame:
    """One row (``text``, smallest ``order``, number of copies) per distinct text.

    Copies are folded before the shuffle, so a text that makes up a third of the rows costs
    each task one row of it.
    """
    return rows.groupBy(F.xxhash64(text).alias("_hash"), text).agg(
        F.min(order).alias(order), F.count(F.lit(1)).alias("copies")
    ).drop("_hash")


def drop_duplicates(rows: DataFrame, text: str, order: str, history: DataFrame | None = None) -> DataFrame:
    """Rows whose text occurs first (by ``order``) here and nowhere in ``history``."""
    rank = F.row_number().over(Window.partitionBy(F.xxhash64(text), text).orderBy(order))
    kept = rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    if history is None:
        return kept
    return _unknown(kept, text, history)


def is_test_row(text, test_split: float = fv.TEST_SPLIT) -> Column:
    """Stable assignment by text hash; the bound is truncated to a whole number."""
    return sha256_mod_10000(text) < int(test_split * 10000)


def _stage(text: str, failed: Column, passed: Column) -> Column:
    return F.when(failed | is_blank(text), "error").when(~passed, "roundtrip").otherwise("passed")


def attempt_status(
    attempts: DataFrame, text: str, order: str, failed: Column, passed: Column, history: DataFrame | None = None
) -> DataFrame:
    """Add ``status`` per attempt, decided in this order: error, roundtrip, duplicate, kept.

    Reads ``attempts`` twice; give it a written table when they are costly to make.
    """
    return with_status(attempts, kept_attempts(attempts, text, order, failed, passed, history), text, order, failed, passed)


def kept_attempts(
    attempts: DataFrame, text: str, order: str, failed: Column, passed: Column, history: DataFrame | None = None
) -> DataFrame:
    """The ``order`` of every attempt that is kept, as ``_kept``: the first that passed of each text that ``history`` does not hold."""
    ok = attempts.where(_stage(text, failed, passed) == "passed")
    return _unknown(first_per_text(ok, text, order), text, history).select(F.col(order).alias("_kept"))


def with_status(attempts: DataFrame, kept: DataFrame, text: str, order: str, failed: Column, passed: Column) -> DataFrame:
    """Add ``status`` to all attempts or a part of them, ``kept`` being those of :func:`kept_attempts`."""
    checked = attempts.withColumn("_stage", _stage(text, failed, passed))
    joined = checked.join(kept, F.col(order) == F.col("_kept"), "left")
    return joined.withColumn(
        "status",
        F.when(F.col("_stage") != "passed", F.col("_stage"))
        .when(F.col("_kept").isNull(), "duplicate")
        .otherwise("kept"),
    ).drop("_stage", "_kept")


def _unknown(texts: DataFrame, text: str, history: DataFrame | None) -> DataFrame:
    """Rows of distinct texts that ``history`` (texts or their digests) does not hold."""
    if history is None:
        return texts
    # Only digests meet, each once: the side that an anti join cannot split stays small.
    seen = history.select("digest").distinct() if "digest" in history.columns else text_digests(history, text)
    return texts.join(seen, text_digest(texts[text]) == seen["digest"], "left_anti")


def text_digests(history: DataFrame, text: str) -> DataFrame:
    """The history as one 32-byte digest per distinct text; write and append to it instead of the texts."""
    return history.select(text_digest(text).alias("digest")).distinct()


def text_digest(text) -> Column:
    """SHA-256 of a text: texts are taken for equal when their digests are."""
    return F.unhex(F.sha2(text, 256))


def build_counters(
    attempts: DataFrame, text: str, failed: Column, passed: Column, history: DataFrame | None = None
) -> DataFrame:
    """Number of attempts per status, in one pass: every accepted text is kept once, its other
    copies are duplicates. Texts become digests first and never travel; copies are folded before the shuffle.

    ``history`` has the texts of earlier runs or their digests (see :func:`text_digests`).
    """
    staged = attempts.select(_stage(text, failed, passed).alias("_stage"), text_digest(text).alias("_digest"))
    groups = staged.groupBy("_stage", F.when(F.col("_stage") == "passed", F.col("_digest")).alias("_digest")).agg(F.count(F.lit(1)).alias("n"))
    if history is None:
        known = groups.withColumn("_known", F.lit(False))
    else:
        digests = history if "digest" in history.columns else text_digests(history, text)
        seen = digests.select(F.col("digest").alias("_digest")).distinct().withColumn("_known", F.lit(True))
        known = groups.join(seen, "_digest", "left").na.fill(False, ["_known"])
    ok, n = F.col("_stage") == "passed", F.col("n")
    new = (ok & ~F.col("_known")).cast("bigint")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0).cast("bigint"))

    names = ["error", "roundtrip", "duplicate", "kept"]
    sums = known.agg(
        total(F.when(F.col("_stage") == "error", n)).alias("error"),
        total(F.when(F.col("_stage") == "roundtrip", n)).alias("roundtrip"),
        total(F.when(ok, n - new)).alias("duplicate"),
        total(new).alias("kept"),
    )
    return sums.unpivot([], names, "status", "n")
