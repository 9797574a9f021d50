"""Record types."""

from pyspark.sql import types as T

# The label form of an invoice: dates and amounts are strings, as in the JSON text.
ITEM = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("unit_price", T.StringType()),
        T.StructField("total", T.StringType()),
    ]
)
INVOICE = T.StructType(
    [
        T.StructField("vendor_name", T.StringType()),
        T.StructField("invoice_number", T.StringType()),
        T.StructField("invoice_date", T.StringType()),
        T.StructField("line_items", T.ArrayType(ITEM)),
        T.StructField("subtotal", T.StringType()),
        T.StructField("tax_amount", T.StringType()),
        T.StructField("total_amount", T.StringType()),
        T.StructField("currency", T.StringType()),
    ]
)
PAIR = T.StructType(
    [T.StructField("raw_text", T.StringType()), T.StructField("invoice", INVOICE)]
)
TRAIN = T.StructType(
    [T.StructField("prompt", T.StringType()), T.StructField("completion", T.StringType())]
)
REQUEST_LOG = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("invoice_json", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("latency_seconds", T.DoubleType()),
        T.StructField("estimated_cost_usd", T.DecimalType(12, 6)),
        T.StructField("created_at", T.TimestampType()),
    ]
)

MONEY = T.DecimalType(18, 6)
# Document fields compared by the evaluation.
DOCUMENT_FIELDS = [
    "vendor_name",
    "invoice_number",
    "invoice_date",
    "subtotal",
    "tax_amount",
    "total_amount",
    "currency",
]
