"""Checks on model answers: strict JSON, the invoice schema, and the typed record.

Everything is built from Spark's VARIANT functions, so no answer leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docutally.fixed_values import DEFAULT_CURRENCY
from docutally.functions.text import trim_all
from docutally.schemas import MONEY

PLAIN_NUMBER = r"^\d+(\.\d+)?$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|(?i)^[+-]?(nan|inf|infinity)$"
DATE = r"^\d{4}-\d{2}-\d{2}([Tt _]00:00(:00(\.0+)?)?([Zz]|[+-]\d{2}:?\d{2})?)?$"
# Whole numbers beyond this are milliseconds, the others seconds since 1970.
MILLIS_FROM = 20_000_000_000

INVALID_JSON = "Invalid JSON: the answer is not one JSON value"
INVALID_SCHEMA = "Schema validation failed: "


# --- strict JSON ---------------------------------------------------------------------
def _listed(raw: Column) -> Column:
    """The answer parsed as the first of two list elements, the second being its own hash."""
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit(","), F.xxhash64(raw).cast("string"), F.lit("]")))


def _only_value(listed: Column, raw: Column) -> Column:
    whole = F.try_variant_get(listed, "$[1]", "bigint") == F.xxhash64(raw)
    single = whole & F.try_variant_get(listed, "$[2]", "variant").isNull()
    return F.when(single, F.try_variant_get(listed, "$[0]", "variant"))


def strict_json(raw) -> Column:
    """The answer as VARIANT, or null unless the whole text is exactly one JSON value.

    Spark's parser stops after the first value and ignores what follows. Inside a list that
    ends with the hash of the text, anything left over breaks the list or its second element.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    return _only_value(_listed(raw), raw)


def canonical_json(raw) -> Column:
    """The answer re-serialised when it parses, else the answer without outer white space."""
    return F.coalesce(F.to_json(strict_json(raw)), trim_all(raw))


# --- field readers: each takes a VARIANT field and its type name ----------------------
def _kind(field: Column) -> Column:
    """Type name of a field; 'VOID' for an explicit null, null when the field is absent."""
    return F.schema_of_variant(field)


def _is_number(kind: Column) -> Column:
    return (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")


def _text(field: Column) -> Column:
    return F.try_variant_get(field, "$", "string")


def _amount_text(field: Column, kind: Column) -> Column:
    """Source text of an amount; numbers print the way a JSON reader keeps them (``1.50`` as 1.5)."""
    digits = F.try_variant_get(field, "$", "decimal(38,12)").cast("string")
    number = F.regexp_replace(F.regexp_replace(digits, r"0+$", ""), r"\.$", ".0")
    text = _text(field)
    cleaned = F.replace(trim_all(text), F.lit("_"), F.lit(""))
    return (
        F.when(kind == "STRING", F.when(text.rlike(PLAIN_NUMBER), text).otherwise(cleaned))
        .when(kind == "BIGINT", text)
        .when(_is_number(kind), F.coalesce(number, _text(field)))
    )


def _date(field: Column, kind: Column) -> Column:
    text = _text(field)
    day = F.when(text.rlike(DATE) & ~text.startswith("0000"), F.substring(text, 1, 10).try_cast("date"))
    whole = F.regexp_replace(text, r"\.0*$", "").try_cast("bigint")
    # Spellings with a fraction or an exponent count when they are whole numbers.
    real = F.when(text.rlike(NUMBER), text.try_cast("double"))
    number = F.coalesce(F.when(text.rlike(r"^[+-]?\d+(\.0*)?$"), whole), F.when(real == F.floor(real), real.try_cast("bigint")))
    millis = (number > MILLIS_FROM) | (number < -MILLIS_FROM)
    per_day = F.when(millis, F.lit(86_400_000)).otherwise(F.lit(86_400))
    days = F.when(number % per_day == 0, F.floor(number / per_day).try_cast("int"))
    epoch = F.when((days >= -719162) & (days <= 2932896), F.date_add(F.lit("1970-01-01").cast("date"), days))
    return F.when(kind == "STRING", F.coalesce(day, epoch)).when(_is_number(kind), epoch)


def _quantity(field: Column, kind: Column) -> Column:
    stated = trim_all(_text(field))
    # Underscores stand between two digits only, one at a time.
    text = F.when(~stated.rlike(r"(^|[^0-9])_|_([^0-9]|$)"), F.replace(stated, F.lit("_"), F.lit("")))
    return (
        F.when(_is_number(kind), F.try_variant_get(field, "$", "double"))
        .when(kind == "STRING", F.when(text.rlike(FLOAT), text.try_cast("double")))
        .when(kind == "BOOLEAN", F.when(_text(field) == "true", 1.0).otherwise(0.0))
    )


# --- error codes ---------------------------------------------------------------------
def _presence(kind: Column, required: bool, nullable: bool) -> Column:
    code = F.when(kind.isNull(), F.lit("MISSING")) if required else F.when(F.lit(False), F.lit(""))
    return code if nullable else code.when(kind == "VOID", F.lit("NULL"))


def _stated(kind: Column) -> Column:
    return kind.isNotNull() & (kind != "VOID")


def _string_code(kind: Column, required: bool = False, nullable: bool = True) -> Column:
    return _presence(kind, required, nullable).when(_stated(kind) & (kind != "STRING"), F.lit("NOT_A_STRING"))


def _amount_code(kind: Column, text: Column, required: bool = False) -> Column:
    return (
        _presence(kind, required, not required)
        .when(_stated(kind) & ~F.coalesce(text.rlike(NUMBER), F.lit(False)), F.lit("NOT_A_NUMBER"))
        .when(_negative(text), F.lit("NEGATIVE"))
    )


def _negative(text: Column) -> Column:
    return text.rlike(r"^-[^eE]*[1-9]")


def _amount_fine(kind: Column, text: Column, required: bool = False) -> Column:
    """Whether ``_amount_code`` would find nothing."""
    number = _stated(kind) & text.rlike(NUMBER) & ~_negative(text)
    return number if required else ~_stated(kind) | number


def _value_code(kind: Column, value: Column, code: str) -> Column:
    return F.when(_stated(kind) & value.isNull(), F.lit(code))


def _tagged(path, code: Column) -> Column:
    return F.concat(path if isinstance(path, Column) else F.lit(path), F.lit(":"), code)


def _money(text: Column) -> Column:
    return F.struct(text.alias("text"), text.try_cast(MONEY).alias("amount"))


# --- schema gate ---------------------------------------------------------------------
_FIELDS = [
    "vendor_name", "invoice_number", "invoice_date", "line_items",
    "subtotal", "tax_amount", "total_amount", "currency",
]
_AMOUNTS = ["subtotal", "tax_amount", "total_amount"]
_ITEM_FIELDS = ["description", "quantity", "unit_price", "total"]
_TYPED_ITEMS = "array<struct<description:string,quantity:double,unit_price:string,total:string>>"


def _variants(names: list[str]) -> str:
    return "struct<" + ",".join(f"{name}:variant" for name in names) + ">"


def _checked_items(items: Column) -> Column:
    """Per line item: typed fields and ``errors``. Each step names what the next one reuses.

    ``items`` is an array of structs of VARIANT fields; an element that is not an object has
    none of its fields, so it fails by its missing description and total.
    """
    kinds = F.transform(
        items,
        lambda s: F.struct(
            *[s[f].alias(f) for f in _ITEM_FIELDS], *[_kind(s[f]).alias(f + "_kind") for f in _ITEM_FIELDS]
        ),
    )
    values = F.transform(
        kinds,
        lambda s: F.struct(
            *[s[f + "_kind"].alias(f + "_kind") for f in _ITEM_FIELDS],
            _text(s["description"]).alias("description"),
            _quantity(s["quantity"], s["quantity_kind"]).alias("quantity"),
            _amount_text(s["unit_price"], s["unit_price_kind"]).alias("unit_price"),
            _amount_text(s["total"], s["total_kind"]).alias("total"),
        ),
    )

    def finish(s: Column, i: Column) -> Column:
        at = F.concat(F.lit("line_items["), i.cast("string"), F.lit("]"))

        def path(name: str) -> Column:
            return F.concat(at, F.lit("." + name))

        codes = F.array_compact(
            F.array(
                _tagged(path("description"), _string_code(s["description_kind"], required=True, nullable=False)),
                _tagged(path("quantity"), _value_code(s["quantity_kind"], s["quantity"], "NOT_A_NUMBER")),
                _tagged(path("unit_price"), _amount_code(s["unit_price_kind"], s["unit_price"])),
                _tagged(path("total"), _amount_code(s["total_kind"], s["total"], required=True)),
            )
        )
        # Most items are right; paths and codes are only made for the others.
        fine = (
            (s["description_kind"] == "STRING")
            & (~_stated(s["quantity_kind"]) | s["quantity"].isNotNull())
            & _amount_fine(s["unit_price_kind"], s["unit_price"])
            & _amount_fine(s["total_kind"], s["total"], required=True)
        )
        return F.struct(
            s["description"].alias("description"),
            s["quantity"].alias("quantity"),
            _money(s["unit_price"]).alias("unit_price"),
            _money(s["total"]).alias("total"),
            F.when(fine, F.array().cast("array<string>")).otherwise(codes).alias("errors"),
        )

    return F.transform(values, finish)


#: Type name of a list of objects that hold nothing but the item fields, in the types most answers use.
PLAIN_LIST = (
    r"^ARRAY<OBJECT<description: STRING(, quantity: (VOID|DOUBLE|BIGINT|DECIMAL\(\d+, ?\d+\)))?, total: STRING"
    r"(, unit_price: (VOID|STRING))?>>\z"
)
_PLAIN = r"\d{1,12}(?:\.\d{1,6})?"
#: Stands for a null among the prices of a list, and for what no description is.
_NULL_PRICE, _NO_TEXT = "~", "\x00"
_ITEMS = (
    "array<struct<description:string,quantity:double,unit_price:struct<text:string,amount:decimal(18,6)>,"
    "total:struct<text:string,amount:decimal(18,6)>,errors:array<string>>>"
)


def _plain_list(items: Column, kind: Column) -> Column:
    """Whether every item is right as it stands: a text, at most a number, at most one plain price, one plain total.

    ``items`` are the items' fields in their own types, ``kind`` is the type name of the whole list. A list is looked at as a whole,
    so nothing is evaluated item by item; whatever is not plain goes through :func:`_checked_items`.
    """
    commas = F.lit(",")

    def joined(name: str, null: str) -> Column:
        return F.array_join(items[name], ",", null)

    def one_each(text: Column) -> Column:
        # A value with a comma of its own would count twice.
        return F.length(text) - F.length(F.replace(text, commas, F.lit(""))) == F.size(items["total"]) - 1

    prices, totals = joined("unit_price", _NULL_PRICE), joined("total", "")
    price = rf"(?:{_NULL_PRICE}|{_PLAIN})"
    plain = (
        kind.rlike(PLAIN_LIST)
        & (F.array_contains(items["description"], _NO_TEXT) == F.lit(False))  # null where a description is null
        # Repeated without a way back, which would take a piece of the stack for every item.
        & totals.rlike(rf"^{_PLAIN}(?:,{_PLAIN})*+\z") & one_each(totals)
        & prices.rlike(rf"^{price}(?:,{price})*+\z") & one_each(prices)
        & ~F.coalesce(F.array_contains(items["unit_price"], _NULL_PRICE), F.lit(False))
    )
    return F.coalesce(plain, F.lit(False))


def _plain_items(items: Column) -> Column:
    """The items of a plain list as :func:`_checked_items` returns them."""

    def money(name: str) -> Column:
        text = items[name]
        return F.arrays_zip(text.alias("text"), text.try_cast(T.ArrayType(MONEY)).alias("amount")).alias(name)

    none = F.array_repeat(F.array().cast("array<string>"), F.size(items["total"])).alias("errors")
    return F.arrays_zip(items["description"].alias("description"), items["quantity"].alias("quantity"), money("unit_price"), money("total"), none).cast(_ITEMS)


def check_answers(answers: DataFrame, raw: str = "raw_output") -> DataFrame:
    """Add the verdict on every answer.

    ``json_valid``  the answer is one JSON value
    ``errors``      failing paths with their codes, empty when the schema accepts the answer
    ``warnings``    amounts too large for the numeric column (kept as text)
    ``valid``       both gates passed
    ``record``      the typed invoice with defaults; null when not valid
    """
    parsed = answers.withColumn("_listed", _listed(F.col(raw))).withColumn("_doc", _only_value(F.col("_listed"), F.col(raw)))
    opened = parsed.withColumn("_fields", F.try_variant_get("_doc", "$", _variants(_FIELDS)))
    fields = opened.select(
        *answers.columns,
        F.col("_doc").isNotNull().alias("json_valid"),
        F.col("_fields").isNotNull().alias("_is_object"),
        *[F.col(f"_fields.{f}").alias("_" + f) for f in _FIELDS],
        F.try_variant_get("_fields.line_items", "$", _TYPED_ITEMS).alias("_typed"),
    )
    scalars = [f for f in _FIELDS if f != "line_items"]
    kinds = fields.withColumns(
        {
            **{f"_{f}_kind": _kind(F.col("_" + f)) for f in scalars},
            # The type name of a list spells out its elements; whether it is null is enough here.
            "_line_items_kind": F.when(F.is_variant_null("_line_items"), "VOID").when(
                F.col("_line_items").isNotNull(), "STATED"
            ),
            "_plain": _plain_list(F.col("_typed"), F.schema_of_variant("_line_items")),
        }
    )
    # Taken apart only where a list is not plain, which few are.
    item_list = F.try_variant_get("_line_items", "$", f"array<{_variants(_ITEM_FIELDS)}>")
    values = kinds.withColumns(
        {
            "_items": F.when(F.col("_plain"), _plain_items(F.col("_typed"))).otherwise(_checked_items(item_list)),
            "_date": _date(F.col("_invoice_date"), F.col("_invoice_date_kind")),
            **{f"_{f}_text": _amount_text(F.col("_" + f), F.col(f"_{f}_kind")) for f in _AMOUNTS},
        }
    )

    values = values.withColumns({f"_{f}_money": _money(F.col(f"_{f}_text")) for f in _AMOUNTS})

    def kind(f: str) -> Column:
        return F.col(f"_{f}_kind")

    codes = [
        _tagged("vendor_name", _string_code(kind("vendor_name"), required=True, nullable=False)),
        _tagged("invoice_number", _string_code(kind("invoice_number"))),
        _tagged("invoice_date", _value_code(kind("invoice_date"), F.col("_date"), "NOT_A_DATE")),
        _tagged(
            "line_items",
            _presence(kind("line_items"), required=False, nullable=False).when(
                _stated(kind("line_items")) & F.col("_items").isNull(), F.lit("NOT_A_LIST")
            ),
        ),
        _tagged("subtotal", _amount_code(kind("subtotal"), F.col("_subtotal_text"))),
        _tagged("tax_amount", _amount_code(kind("tax_amount"), F.col("_tax_amount_text"))),
        _tagged("total_amount", _amount_code(kind("total_amount"), F.col("_total_amount_text"), required=True)),
        _tagged("currency", _string_code(kind("currency"), nullable=False)),
    ]
    item_errors = F.flatten(F.col("_items.errors"))
    no_errors = F.array().cast("array<string>")
    errors = (
        F.when(~F.col("json_valid"), no_errors)
        .when(~F.col("_is_object"), F.array(F.lit("document:NOT_AN_OBJECT")))
        .otherwise(F.concat(F.array_compact(F.array(*codes)), F.coalesce(item_errors, no_errors)))
    )

    def too_large(money: Column) -> Column:
        return money["amount"].isNull() & money["text"].rlike(NUMBER)

    warnings = F.array_compact(
        F.array(
            *[F.when(too_large(F.col(f"_{f}_money")), F.lit(f"{f}:AMOUNT_OUT_OF_RANGE")) for f in _AMOUNTS],
            F.when(
                ~F.col("_plain") & F.exists("_items", lambda x: too_large(x["unit_price"])),
                F.lit("line_items.unit_price:AMOUNT_OUT_OF_RANGE"),
            ),
            F.when(
                ~F.col("_plain") & F.exists("_items", lambda x: too_large(x["total"])),
                F.lit("line_items.total:AMOUNT_OUT_OF_RANGE"),
            ),
        )
    )
    record = F.struct(
        _text(F.col("_vendor_name")).alias("vendor_name"),
        _text(F.col("_invoice_number")).alias("invoice_number"),
        F.col("_date").alias("invoice_date"),
        F.coalesce(
            F.arrays_zip(*[F.col(f"_items.{f}").alias(f) for f in _ITEM_FIELDS]),
            F.array().cast("array<struct<description:string,quantity:double,"
                           "unit_price:struct<text:string,amount:decimal(18,6)>,"
                           "total:struct<text:string,amount:decimal(18,6)>>>"),
        ).alias("line_items"),
        *[F.col(f"_{f}_money").alias(f) for f in _AMOUNTS],
        F.coalesce(_text(F.col("_currency")), F.lit(DEFAULT_CURRENCY)).alias("currency"),
    )
    gated = values.withColumns({"errors": errors, "warnings": warnings}).withColumn(
        "valid", F.col("json_valid") & (F.size("errors") == 0)
    )
    verdict = F.struct(
        "json_valid", "errors", "warnings", "valid", F.when(F.col("valid"), record).alias("record")
    )
    # Unpacking a one-element list keeps later filters from being moved below the checks, where
    # every mention of a verdict would repeat all of them. The list holds a finished column: what stands
    # inside a generator is interpreted, not compiled.
    made = gated.withColumn("_gate_verdict", verdict)
    return made.select(*answers.columns, F.inline(F.array("_gate_verdict")))


def gate_error() -> Column:
    """Error text of a checked answer, null when it is valid."""
    return F.when(~F.col("json_valid"), F.lit(INVALID_JSON)).when(
        ~F.col("valid"), F.concat(F.lit(INVALID_SCHEMA), F.array_join("errors", ", "))
    )


def record_label(record) -> Column:
    """A typed record as a label: dates and amounts become text again."""
    record = F.col(record) if isinstance(record, str) else record
    items = record["line_items"]
    label = F.struct(
        record["vendor_name"].alias("vendor_name"),
        record["invoice_number"].alias("invoice_number"),
        record["invoice_date"].cast("string").alias("invoice_date"),
        F.arrays_zip(
            items["description"].alias("description"),
            items["quantity"].alias("quantity"),
            items["unit_price"]["text"].alias("unit_price"),
            items["total"]["text"].alias("total"),
        ).alias("line_items"),
        *[record[f]["text"].alias(f) for f in _AMOUNTS],
        record["currency"].alias("currency"),
    )
    return F.when(record.isNotNull(), label)


def record_json(record) -> Column:
    """JSON text of a typed record, nulls written; null for a null record."""
    return F.to_json(record_label(record), {"ignoreNullFields": "false"})
