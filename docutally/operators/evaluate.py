"""Scoring predictions against labels.

Functions take one row per (document, model) with two label structs, by default ``invoice``
(the truth) and ``prediction`` (null where the answer was not valid). ``pair_up`` builds such
rows from two tables.

Line items are matched as multisets: per document and normalised description, as many are
matched as both sides have. Counts are kept instead of item pairs, so repeated descriptions
need neither an ordering nor all pairs of a group.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docutally import fixed_values as fv
from docutally.functions.text import norm_number, norm_text, same_number
from docutally.operators import evidence
from docutally.operators.validate import strict_json
from docutally.schemas import DOCUMENT_FIELDS
from docutally.session import TEXTS, cleaned

AMOUNTS = ["subtotal", "tax_amount", "total_amount"]
METRICS = ["valid_json", "field_accuracy", "item_recall", "item_precision", "complete_item"]


def pair_up(truth: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Every labelled document with its prediction; a document without one counts as wrong."""
    return truth.join(predictions, keys, "left")


def comparable(label) -> Column:
    """The seven document fields in comparable form."""
    label = F.col(label) if isinstance(label, str) else label
    fields = []
    for f in DOCUMENT_FIELDS:
        value = norm_number(label[f]) if f in AMOUNTS else norm_text(label[f])
        fields.append(value.alias(f))
    return F.struct(*fields)


def with_comparable(rows: DataFrame, truth: str = "invoice", prediction: str = "prediction") -> DataFrame:
    return rows.withColumns({"truth_norm": comparable(truth), "prediction_norm": comparable(prediction)})


def with_matches(rows: DataFrame, truth: str = "invoice", prediction: str = "prediction") -> DataFrame:
    """Add ``right``: per document field, whether the prediction agrees (null agrees with null)."""
    normed = with_comparable(rows, truth, prediction)
    parsed = F.col(prediction).isNotNull()
    right = F.struct(
        *[
            (parsed & _agrees(f, truth, prediction)).alias(f)
            for f in DOCUMENT_FIELDS
        ]
    )
    return normed.withColumn("right", right)


def _agrees(field: str, truth: str, prediction: str) -> Column:
    left, right = F.col(truth)[field], F.col(prediction)[field]
    # Equal as they stand, most values need no comparable form.
    other = same_number(left, right) if field in AMOUNTS else norm_text(left).eqNullSafe(norm_text(right))
    return F.when(left.eqNullSafe(right), True).otherwise(other)


def _percent(part: Column, whole: Column) -> Column:
    return F.round(part * 100.0 / F.nullif(whole, F.lit(0)), 2)


def per_field_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy per document field; documents without a valid answer count as wrong."""
    matched = with_matches(rows)
    counted = matched.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), *[F.count_if(f"right.{f}").alias(f) for f in DOCUMENT_FIELDS]
    )
    long = counted.unpivot([*by, "documents"], DOCUMENT_FIELDS, "field", "correct")
    return long.select(*by, "field", "correct", "documents", _percent(F.col("correct"), F.col("documents")).alias("accuracy"))


def field_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """Correct fields over all fields of all documents (micro average)."""
    matched = with_matches(rows)
    n_right = sum((F.col(f"right.{f}").cast("bigint") for f in DOCUMENT_FIELDS), F.lit(0).cast("bigint"))
    counted = matched.groupBy(*by).agg(
        F.sum(n_right).alias("correct"), (F.count(F.lit(1)) * len(DOCUMENT_FIELDS)).alias("evaluated")
    )
    return counted.select("*", _percent(F.col("correct"), F.col("evaluated")).alias("accuracy"))


def valid_rate(rows: DataFrame, by: list[str]) -> DataFrame:
    counted = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("prediction").isNotNull()).alias("valid")
    )
    return counted.select("*", _percent(F.col("valid"), F.col("documents")).alias("valid_rate"))


# --- line items ----------------------------------------------------------------------
ITEM_KEY = ["description", "quantity", "unit_price", "total"]


_ITEM_KINDS = {"description": "string", "quantity": "double", "unit_price": "decimal(18,6)", "total": "decimal(18,6)"}
_ITEM_ENTRY = ",".join(f"{name}:{kind}" for name, kind in _ITEM_KINDS.items())


def item_counts(
    rows: DataFrame,
    keys: list[str],
    truth: str = "invoice",
    prediction: str = "prediction",
    measures: dict[str, Column] | None = None,
) -> DataFrame:
    """Per document and distinct item: how often the label (``g``) and the prediction (``p``) has it.

    ``measures`` are whole numbers per document. They travel as one more entry, without an
    item, so that documents and items are counted in one pass over the rows.
    """
    measures = measures or {}
    counted = ["g", "p", *measures]

    def numbers(values: dict[str, Column]) -> list[Column]:
        return [F.coalesce(values.get(n, F.lit(0)).cast("bigint"), F.lit(0)).alias(n) for n in counted]

    def side(label: str, name: str) -> Column:
        return F.transform(
            F.col(label)["line_items"],
            lambda x: F.struct(
                norm_text(x["description"]).alias("description"),
                x["quantity"].alias("quantity"),
                norm_number(x["unit_price"]).alias("unit_price"),
                norm_number(x["total"]).alias("total"),
                *numbers({name: F.lit(1)}),
            ),
        )

    kind = f"array<struct<{_ITEM_ENTRY},{','.join(n + ':bigint' for n in counted)}>>"
    none = F.array().cast(kind)
    document = F.struct(
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("double").alias("quantity"),
        F.lit(None).cast("decimal(18,6)").alias("unit_price"),
        F.lit(None).cast("decimal(18,6)").alias("total"),
        *numbers(measures),
    )
    entries = [F.coalesce(side(truth, "g"), none), F.coalesce(side(prediction, "p"), none)]
    if measures:
        entries.append(F.array(document))
    long = rows.select(*keys, F.inline(F.concat(*entries)))
    return long.groupBy(*keys, *ITEM_KEY).agg(*[F.sum(n).alias(n) for n in counted])


def item_matches(rows: DataFrame, keys: list[str], measures: dict[str, Column] | None = None) -> DataFrame:
    """Per document and description: label and predicted copies, matched copies, complete copies."""
    per_item = item_counts(rows, keys, measures=measures)
    return per_item.groupBy(*keys, "description").agg(
        F.sum("g").alias("g"),
        F.sum("p").alias("p"),
        F.sum(F.least("g", "p")).alias("complete"),
        *[F.sum(n).alias(n) for n in measures or {}],
    ).withColumn("matched", F.least("g", "p"))


def _same_items(rows: DataFrame, truth: str, prediction: str) -> Column:
    """Whether both lists are equal as they stand, so that nothing has to be matched. Lists of different types are never taken for equal."""
    left, right = F.col(truth)["line_items"], F.col(prediction)["line_items"]
    kinds = [kind for _, kind in rows.select(left.alias("left"), right.alias("right")).dtypes]
    return F.coalesce(left == right, F.lit(False)) if kinds[0] == kinds[1] else F.lit(False)


def with_item_sums(rows: DataFrame, truth: str = "invoice", prediction: str = "prediction") -> DataFrame:
    """Add per row ``g`` and ``p`` (items of the label and of the prediction), ``matched`` and ``complete`` copies.

    All items of a document stand in its row, so nothing is shuffled. Only lists that differ are brought to comparable form.
    """
    n_left, n_right = (F.coalesce(F.when(F.col(x)["line_items"].isNotNull(), F.size(F.col(x)["line_items"])), F.lit(0)) for x in (truth, prediction))
    sized = rows.withColumns({"g": n_left, "p": n_right, "_same": _same_items(rows, truth, prediction)})
    differ = ~F.col("_same") & (F.col("g") > 0) & (F.col("p") > 0)
    sides = sized.withColumn("_sides", F.when(differ, F.struct(_normal_items(truth).alias("_g"), _normal_items(prediction).alias("_p"))))
    # Unpacked from a list so that the items are normalised once, not once per level.
    read = sides.select(*sized.columns, F.inline(F.array("_sides")))

    def copies(*value: str) -> Column:
        return F.when(F.col("_same"), F.col("g")).when(F.col("_g").isNotNull(), _counted(*value)["matched"]).otherwise(0).cast("bigint")

    summed = read.withColumns({"g": F.col("g").cast("bigint"), "p": F.col("p").cast("bigint"), "matched": copies("description"), "complete": copies(*ITEM_KEY)})
    return summed.drop("_same", "_g", "_p")


def _normal_items(label: str) -> Column:
    return F.transform(
        F.col(label)["line_items"],
        lambda x: F.struct(
            norm_text(x["description"]).alias("description"), x["quantity"].alias("quantity"), norm_number(x["unit_price"]).alias("unit_price"), norm_number(x["total"]).alias("total")
        ),
    )


def item_prf(rows: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Recall, precision, F1 and complete-item accuracy (over label items), in percent. ``keys`` tell the rows apart."""
    counted = with_item_sums(rows).groupBy(*by).agg(
        F.sum("g").alias("label_items"),
        F.sum("p").alias("predicted_items"),
        F.sum("matched").alias("matched"),
        F.sum("complete").alias("complete"),
    )
    g, p, m = F.col("label_items"), F.col("predicted_items"), F.col("matched")
    return counted.select(
        "*",
        _percent(m, g).alias("item_recall"),
        _percent(m, p).alias("item_precision"),
        _percent(2 * m, g + p).alias("item_f1"),
        _percent(F.col("complete"), g).alias("complete_item"),
    )


def missing_extra_items(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Items only the label has (missing) or only the prediction has (extra), with their number."""
    # Items of equal lists are all matched and need not be moved.
    unmatched = item_matches(rows.where(~_same_items(rows, "invoice", "prediction")), keys).where("g <> p")
    return unmatched.select(
        *keys,
        "description",
        F.when(F.col("g") > F.col("p"), "missing").otherwise("extra").alias("kind"),
        F.abs(F.col("g") - F.col("p")).alias("copies"),
    )


# --- hallucination, truncation, error codes ------------------------------------------
def invented(amount: Column, amounts: str = "amounts") -> Column:
    """Whether an amount is stated but not among ``amounts`` of the document. What is no number counts as invented."""
    return F.coalesce(amount.isNotNull() & ~F.array_contains(F.col(amounts), norm_number(amount)), amount.isNotNull())


def hallucinated_items(lower="lower", prediction: str = "prediction") -> Column:
    """Number of predicted items with a description, unit price or total that the document (in ``lower`` case) does not state.

    Amounts are looked up among the document's ``amounts`` (see ``evidence``), so 5.00 is found neither in 15.00 nor in a date.
    """
    odd = F.filter(
        F.col(prediction)["line_items"],
        lambda x: ~F.contains(F.col(lower), F.lower(x["description"])) | invented(x["unit_price"]) | invented(x["total"]),
    )
    return F.coalesce(F.size(F.when(F.col(prediction).isNotNull(), odd)), F.lit(0))


def hallucinated_amounts(prediction: str = "prediction") -> Column:
    """Number of predicted document amounts (subtotal, tax, total) that the document does not state."""
    found = [F.coalesce(invented(F.col(prediction)[f]).cast("int"), F.lit(0)) for f in AMOUNTS]
    return F.when(F.col(prediction).isNotNull(), found[0] + found[1] + found[2]).otherwise(0)


def is_truncated(raw="raw_output", json_valid: Column | None = None) -> Column:
    """Text that is not valid JSON and leaves a list, an object or a string open at its end."""
    json_valid = strict_json(raw).isNotNull() if json_valid is None else json_valid
    outside = F.regexp_replace(raw, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")

    def count(marks: str) -> Column:
        return F.length(outside) - F.length(F.translate(outside, marks, ""))

    is_open = (count("{[") > count("}]")) | F.contains(outside, F.lit('"'))
    return F.coalesce(is_open & ~json_valid, F.lit(False))


def with_flags(rows: DataFrame) -> DataFrame:
    """Add ``hallucinated`` (items), ``hallucinated_amounts`` and ``truncated`` per answer; uses ``json_valid`` where known."""
    known = F.col("json_valid") if "json_valid" in rows.columns else None
    # Unpacked from a list so that the text is read once per row, not once per item. Without a prediction nothing is looked up in it.
    read = F.struct(evidence.stated("amount").alias("amounts"), F.lower("raw_text").alias("lower"))
    text = rows.withColumn("_text", F.when(F.col("prediction").isNotNull(), read))
    read = text.select(*rows.columns, F.inline(F.array("_text")))
    flags = {"hallucinated": hallucinated_items(), "hallucinated_amounts": hallucinated_amounts(), "truncated": is_truncated(json_valid=known)}
    return read.withColumns(flags).drop("amounts", "lower")


def document_errors() -> dict[tuple[str, str], Column]:
    """(level, code) to condition on a matched and flagged row, apart from line items."""
    parsed = F.col("prediction").isNotNull()
    return {
        **{("document", code): parsed & ~F.col(f"right.{f}") for f, code in fv.FIELD_ERRORS.items()},
        ("generation", "TRUNCATION"): F.col("truncated"),
        ("generation", "HALLUCINATION"): F.col("hallucinated") + F.col("hallucinated_amounts") > 0,
    }


def with_item_agreement(rows: DataFrame, truth: str = "invoice", prediction: str = "prediction") -> DataFrame:
    """Add ``agreed``: per row, how the items of label and prediction agree on four levels (zeros without a prediction).

    ``matched``, ``missing`` and ``extra`` copies by description; ``same_quantity``, ``same_price`` and ``same_total`` are the copies
    that also agree on that value. All items of a document stand in its row: the entries of both sides are sorted by their
    value and counted in one run, so nothing is shuffled.
    """

    same = _same_items(rows, truth, prediction)

    def side(label: str) -> Column:
        return F.coalesce(F.when(F.col(prediction).isNotNull() & ~F.col("_same"), _normal_items(label)), F.array().cast(f"array<struct<{_ITEM_ENTRY}>>"))

    # Unpacked from a list so that the items are normalised once, not once per level.
    sides = rows.withColumn("_same", same).withColumn("_sides", F.struct(side(truth).alias("_g"), side(prediction).alias("_p")))
    read = sides.select(*rows.columns, "_same", F.inline(F.array("_sides")))
    values = [_counted("description", value)["matched"].alias(name) for value, name in (("quantity", "same_quantity"), ("unit_price", "same_price"), ("total", "same_total"))]
    # Bound by a list of one, so that all three numbers come from one count.
    agreed = F.transform(F.array(_counted("description")), lambda n: F.struct(*[n[c].alias(c) for c in ("matched", "missing", "extra")], *values))[0]
    # Most answers list the items as the label does, many of them letter by letter.
    n, zero = F.when(F.col("_same"), F.size(F.col(truth)["line_items"])).otherwise(F.size("_g")), F.lit(0)
    equal = F.struct(*[value.alias(c) for c, value in zip(("matched", "missing", "extra", "same_quantity", "same_price", "same_total"), (n, zero, zero, n, n, n))])
    return read.withColumn("agreed", F.when(F.col("_g") == F.col("_p"), equal).otherwise(agreed)).drop("_same", "_g", "_p")


def _counted(*value: str) -> Column:
    """(matched, missing, extra) copies of the items in ``_g`` and ``_p``, told apart by the fields ``value``."""

    def entries(items: str, g: int, p: int) -> Column:
        # Flat: rows inside rows would be given an order of their own at every comparison.
        return F.transform(items, lambda x: F.struct(*[x[v].alias(v) for v in value], F.lit(g).alias("g"), F.lit(p).alias("p")))

    zero = F.lit(0)
    start = F.struct(*[F.lit(None).cast(_ITEM_KINDS[v]).alias(v) for v in value], *[zero.alias(n) for n in ("g", "p", "matched", "missing", "extra")])

    def closed(s: Column) -> list[Column]:
        g, p = s["g"], s["p"]
        return [
            (s["matched"] + F.least(g, p)).alias("matched"),
            (s["missing"] + F.greatest(g - p, zero)).alias("missing"),
            (s["extra"] + F.greatest(p - g, zero)).alias("extra"),
        ]

    def step(s: Column, x: Column) -> Column:
        same = reduce(and_, (s[v].eqNullSafe(x[v]) for v in value))
        counts = [(F.when(same, s[n]).otherwise(zero) + x[n]).alias(n) for n in ("g", "p")]
        sums = [F.when(same, s[n]).otherwise(done).alias(n) for n, done in zip(("matched", "missing", "extra"), closed(s))]
        return F.struct(*[x[v].alias(v) for v in value], *counts, *sums)

    both = F.sort_array(F.concat(entries("_g", 1, 0), entries("_p", 0, 1)))
    return F.aggregate(both, start, step, lambda s: F.struct(*closed(s)))


def item_error_counts() -> dict[str, Column]:
    """Item error code to its number, from ``agreed``.

    Wrong quantities are the matched copies minus those that agree on description and quantity; prices and totals likewise. When
    a document has both missing and extra items, the smaller of the two numbers is counted as wrong descriptions.
    """
    n = {c: F.col(f"agreed.{c}") for c in ("matched", "missing", "extra", "same_quantity", "same_price", "same_total")}
    renamed = F.least(n["missing"], n["extra"])
    return {
        "MISSING_LINE_ITEMS": n["missing"] - renamed,
        "EXTRA_LINE_ITEMS": n["extra"] - renamed,
        "WRONG_DESCRIPTION": renamed,
        "WRONG_QUANTITY": n["matched"] - n["same_quantity"],
        "WRONG_UNIT_PRICE": n["matched"] - n["same_price"],
        "WRONG_TOTAL": n["matched"] - n["same_total"],
    }


def example_errors(rows: DataFrame, keys: list[str], labels: DataFrame | None = None) -> DataFrame:
    """Error records per example: (keys, level, code, n).

    A row is one example and gives its records by itself, without a shuffle. SEMANTIC_SUBSTITUTION and
    ANNOTATION_AMBIGUITY need a human judgement: they come only from ``labels`` (keys, level, code), never from a
    guess. Item errors are looked for in valid answers only.
    """
    judged = with_item_agreement(with_flags(with_matches(rows)))

    def entry(level: str, code: str, n: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), n.cast("bigint").alias("n"))

    entries = [entry(level, code, condition) for (level, code), condition in document_errors().items()]
    entries += [entry("line_item", code, n) for code, n in item_error_counts().items()]
    errors = judged.select(*keys, F.inline(F.array(*entries))).where("n > 0")
    if labels is not None:
        one = F.lit(1).cast("bigint").alias("n")
        errors = errors.unionByName(labels.select(*keys, "level", "code", one))
    return errors


def error_taxonomy(errors: DataFrame, by: list[str]) -> DataFrame:
    return errors.groupBy(*by, "level", "code").agg(F.count(F.lit(1)).alias("examples"), F.sum("n").alias("errors"))


# --- result tables -------------------------------------------------------------------
def _document_measures() -> dict[str, Column]:
    """Per matched row: one document, whether it is valid, and its number of right fields."""
    n_right = sum((F.col(f"right.{f}").cast("bigint") for f in DOCUMENT_FIELDS), F.lit(0).cast("bigint"))
    return {"documents": F.lit(1), "valid": F.col("prediction").isNotNull(), "n_right": n_right}


def results_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per model and dataset with the five published metrics, in percent."""
    by = ["model", "dataset"]
    per_row = with_item_sums(with_matches(rows)).withColumns(_document_measures())
    sums = per_row.groupBy(*by).agg(
        *[F.sum(F.col(n).cast("bigint")).alias(n) for n in ("documents", "valid", "n_right", "g", "p", "matched", "complete")]
    )
    n = F.col
    return sums.select(
        *by,
        "documents",
        _percent(n("valid"), n("documents")).alias("valid_json"),
        _percent(n("n_right"), n("documents") * len(DOCUMENT_FIELDS)).alias("field_accuracy"),
        _percent(n("matched"), n("g")).alias("item_recall"),
        _percent(n("matched"), n("p")).alias("item_precision"),
        _percent(n("complete"), n("g")).alias("complete_item"),
    )


def metric_long(results: DataFrame) -> DataFrame:
    """Results as (model, dataset, metric, value) rows, to pick one metric for comparison."""
    return results.unpivot(["model", "dataset"], METRICS, "metric", "value")


def model_delta(results: DataFrame, before: str, after: str) -> DataFrame:
    """After minus before in percentage points, per dataset and metric."""
    wide = (
        metric_long(results.where(F.col("model").isin(before, after)))
        .groupBy("dataset", "metric")
        .pivot("model", [before, after])
        .agg(F.first("value"))
    )
    return wide.select(
        "dataset",
        "metric",
        F.col(before).alias("before"),
        F.col(after).alias("after"),
        F.round(F.col(after) - F.col(before), 2).alias("delta"),
    )


def document_checks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per labelled document: fields right, items matched and complete, and whether all agree."""
    per_row = with_item_sums(with_matches(rows)).withColumns(_document_measures())
    sums = per_row.select(
        *keys, F.col("n_right").alias("fields_right"), F.col("g").alias("label_items"), F.col("p").alias("predicted_items"), "complete"
    )
    all_fields = F.col("fields_right") == len(DOCUMENT_FIELDS)
    all_items = (F.col("complete") == F.col("label_items")) & (F.col("complete") == F.col("predicted_items"))
    return sums.withColumn("passed", all_fields & all_items)


def write_run(rows: DataFrame, keys: list[str], path: str, run: dict[str, str]) -> None:
    """Keep one evaluation run: its metrics and every example, both with the run's provenance.

    ``run`` names model, prompt and data versions and the configuration; it must hold
    ``run_id``. Examples keep the raw answer, the label, the prediction and both in
    comparable form. Files are grouped by run, and a run that is written again replaces itself. The rows
    are made once: the metrics are those of the examples as written.
    """
    about = {**{name: F.lit(value) for name, value in run.items()}, "recorded_at": F.current_timestamp()}
    parsed = F.col("prediction").isNotNull()
    examples = with_comparable(rows).withColumn("prediction_norm", F.when(parsed, F.col("prediction_norm"))).withColumns(about)

    def replace(frame: DataFrame, name: str) -> None:
        with cleaned(rows.sparkSession):
            frame.write.mode("overwrite").options(**TEXTS, partitionOverwriteMode="dynamic").partitionBy("run_id").parquet(f"{path}/{name}")

    replace(examples, "examples")
    kept = rows.sparkSession.read.schema(examples.schema).parquet(f"{path}/examples").where(F.col("run_id") == run["run_id"])
    replace(metric_long(results_table(kept.select(rows.columns), keys)).withColumns(about), "metrics")
