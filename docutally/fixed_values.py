"""Constants that decide results and therefore may not vary."""

# --- Fixed values: invoice generation ------------------------------------------------
VENDOR_TEMPLATES = [
    ("{name} Electronics", ["USB-C Cable", "Wireless Mouse", "Laptop Stand", "HDMI Adapter", "Bluetooth Speaker", "Power Bank"]),
    ("{name} Hardware", ["Hammer", "Screwdriver Set", "Nails (box)", "Paint (gallon)", "Drill Bit Set", "Measuring Tape"]),
    ("{name} Bistro", ["Grilled Chicken", "Caesar Salad", "House Wine (glass)", "Espresso", "Tiramisu", "Garlic Bread"]),
    ("{name} Consulting", ["Strategy Session (hr)", "Report Drafting (hr)", "On-site Visit", "Follow-up Call (hr)"]),
    ("{name} Auto Repair", ["Oil Change", "Brake Pad Replacement", "Tire Rotation", "Diagnostic Fee", "Wiper Blades"]),
    ("{name} Print Shop", ["Business Cards (100)", "Flyer Printing (50)", "Banner (3x6ft)", "Binding Service"]),
    ("{name} Cleaning Co", ["Standard Clean", "Deep Clean Add-on", "Window Cleaning", "Carpet Shampoo"]),
    ("{name} Bookstore", ["Paperback Novel", "Notebook", "Bookmark Set", "Gift Wrap"]),
]
NAME_PREFIXES = [
    "ACME", "Summit", "Riverside", "Golden Gate", "Northstar", "Cedar", "Blue Ridge", "Pioneer", "Harbor",
    "Union", "Maple", "Crestwood", "Lakeside", "Ironclad", "Meridian", "Vista", "Evergreen",
]
CURRENCIES = ["USD", "USD", "USD", "USD", "EUR", "GBP", "INR"]
QUANTITIES = [1, 1, 2, 3, 4, 1.5, 2.5]
TAX_RATES = ["0.05", "0.07", "0.08", "0.0875", "0.1"]
MAX_ITEMS = 8
FLAT_ITEM_RATE = 0.35
UNIT_PRICE_RANGE = (3, 80)
FLAT_TOTAL_RANGE = (5, 200)
OMIT_NUMBER, OMIT_DATE, OMIT_TAX, OMIT_SUBTOTAL = 0.25, 0.2, 0.3, 0.3
DATE_WINDOW_DAYS = 730

# --- Fixed values: prompt marks ------------------------------------------------------
TEXT_MARK = 'Invoice text:\n"""\n'
END_MARK = '"""\n\nJSON output:'
INSTRUCTION_HEAD = "### Instruction:\n"
INSTRUCTION_TAIL = "\n\n### Response:\n"

# --- Fixed values: fixed-response client ---------------------------------------------
FIXED_ANSWER = """
{
  "vendor_name": "Fake Vendor Inc",
  "invoice_number": "FAKE-001",
  "invoice_date": "2024-01-01",
  "line_items": [
    {"description": "Sample Item", "quantity": 1, "unit_price": "10.00", "total": "10.00"}
  ],
  "subtotal": "10.00",
  "tax_amount": "0.00",
  "total_amount": "10.00",
  "currency": "USD"
}
"""
FIXED_LATENCY = 0.01

# --- Fixed values: USD per million tokens, (input, output) ---------------------------
DEFAULT_PRICE = "_default"
PRICES = {
    "openai/gpt-oss-120b": ("0.15", "0.60"),
    "openai/gpt-oss-20b": ("0.075", "0.30"),
    "_default": ("0.15", "0.60"),
}

# --- Fixed values: dataset building and training rows --------------------------------
TEST_SPLIT = 0.15
ROUNDTRIP_TOLERANCE = "0.05"
MAX_LENGTH = 512
MASKED_LABEL = -100
VALIDATION_RATIO = 0.10
SPLIT_SEED = 42

# --- Fixed values: reports -----------------------------------------------------------
RECENT_LIMIT = 20
FLAGGED_LIMIT = 15
NOTE_CHARS = 40
NOT_DETECTED = "Not detected"
NOT_AVAILABLE = "Not available"
DEFAULT_CURRENCY = "USD"

# --- Fixed values: error codes -------------------------------------------------------
FIELD_ERRORS = {
    "vendor_name": "WRONG_VENDOR",
    "invoice_number": "WRONG_INVOICE_NUMBER",
    "invoice_date": "WRONG_DATE",
    "tax_amount": "WRONG_TAX",
    "subtotal": "WRONG_SUBTOTAL",
    "total_amount": "WRONG_TOTAL",
    "currency": "WRONG_CURRENCY",
}
ITEM_ERRORS = [
    "MISSING_LINE_ITEMS",
    "EXTRA_LINE_ITEMS",
    "WRONG_DESCRIPTION",
    "WRONG_QUANTITY",
    "WRONG_UNIT_PRICE",
    "WRONG_TOTAL",
]
GENERATION_ERRORS = ["TRUNCATION", "HALLUCINATION", "SEMANTIC_SUBSTITUTION"]
ANNOTATION_ERRORS = ["ANNOTATION_AMBIGUITY"]
