"""The same queries as SQL on the plain tables, written without the engine's own code.

Each statement gets the common table expressions it names, in order.
"""

from __future__ import annotations

from docutally import fixed_values as fv
from docutally.operators.dataset import LAYOUTS
from docutally.operators.prep import default_instructions
from docutally.operators.validate import INVALID_JSON, INVALID_SCHEMA
from docutally.plans import views

NL = "chr(10)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) if isinstance(v, str) else repr(v) for v in values) + "]"


def _label(name: str) -> str:
    return f"({_list(LAYOUTS[name])})[(doc_id % 5 + 1)::INT]"


_HEAD = _q(default_instructions() + fv.TEXT_MARK)
_TAIL = _q("\n" + fv.END_MARK)
_TRIMMED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_WORDS = r"len(string_split_regex(" + _TRIMMED + r", '\s+'))"
_PCT = "round({0} * 100.0::DOUBLE / nullif({1}, 0), 2)"
_VALID = (
    "defect IN ('clean', 'near_total', 'wrong_total', 'wrong_vendor', 'reformatted', "
    "'dropped_item', 'extra_item', 'wrong_date', 'wrong_quantity', 'dated_price')"
)
_JSON_OK = "defect NOT IN ('fenced', 'truncated', 'trailing', 'empty')"
_HEX8 = "('0x' || substr({0}, {1}, 8))::BIGINT"


def _draw(slot: str, *more: str) -> str:
    parts = " || ':' || ".join([_q(f"0:{slot}"), "doc_id::VARCHAR", *more])
    return _HEX8.format(f"md5({parts})", 1)


def _fraction(slot: str, *more: str) -> str:
    return f"({_draw(slot, *more)} / 4294967296.0::DOUBLE)"


def _cents(low: int, high: int, number: str) -> str:
    return f"(({number} % {(high - low) * 100 + 1} + {low * 100}) / 100.0::DOUBLE)::DECIMAL(18,2)"


def _item_json(d: str, q: str, u: str, t: str) -> str:
    return (
        f"""'{{"description":"' || {d} || '","quantity":' || coalesce({q}::VARCHAR, 'null') || ',"unit_price":' """
        f"""|| coalesce('"' || {u} || '"', 'null') || ',"total":"' || {t} || '"}}'"""
    )


def _invoice_json(vendor: str, number: str, date: str, items: str, sub: str, tax: str, total: str, currency: str) -> str:
    def text(value: str) -> str:
        return f"""coalesce('"' || {value} || '"', 'null')"""

    return (
        f"""'{{"vendor_name":' || {text(vendor)} || ',"invoice_number":' || {text(number)} || ',"invoice_date":' """
        f"""|| {text(date)} || ',"line_items":[' || coalesce({items}, '') || '],"subtotal":' || {text(sub)} """
        f"""|| ',"tax_amount":' || {text(tax)} || ',"total_amount":' || {text(total)} || ',"currency":' || {text(currency)} || '}}'"""
    )


_ANSWERING = " UNION ALL ".join(f"SELECT '{m}' AS model, {a} AS a, {b} AS b" for m, (a, b) in views.ANSWERING.items())

CTES = {
    "request_log": f"""
        SELECT event_id::VARCHAR AS job_id, ({_list(views.MODELS)})[user_id % 3 + 1] AS model_name,
               event_type <> 'error' AS success,
               CASE WHEN event_type = 'error' THEN 'Invalid JSON: answer ' || event_id END AS error,
               CASE WHEN event_type <> 'error' THEN CASE WHEN user_id % 10 = 0 THEN ' ' ELSE 'Vendor ' || user_id END END AS vendor_name,
               CASE WHEN event_type <> 'error' AND event_id % 4 <> 0 THEN 'INV-' || event_id END AS invoice_number,
               CASE WHEN event_type <> 'error' AND event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS invoice_date,
               CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 50 = 7 THEN 'n/a' ELSE value::DECIMAL(12,2)::VARCHAR END END AS total_amount,
               CASE WHEN event_type <> 'error' THEN ({_list(fv.CURRENCIES)})[user_id % 7 + 1] END AS currency,
               value AS latency_seconds,
               (value::DECIMAL(12,2)::DOUBLE / 10000)::DECIMAL(12,6) AS estimated_cost_usd, ts AS created_at
        FROM events""",
    "priced": """
        SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supplier_id,
               (l_partkey + l_suppkey) % 20 < 7 AS flat, (l_quantity / 2)::DECIMAL(10,1) AS q0,
               l_extendedprice::DECIMAL(18,2) AS price
        FROM lineitem""",
    "lines": """
        SELECT doc_id, p_name AS description,
               row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part_id, supplier_id, t) - 1 AS pos, q, u, t
        FROM (SELECT *, CASE WHEN NOT flat THEN q0 END AS q, CASE WHEN NOT flat THEN price END AS u,
                     CASE WHEN flat THEN price ELSE round(q0 * price, 2)::DECIMAL(18,2) END AS t
              FROM priced JOIN part ON p_partkey = part_id)""",
    "sums": """
        SELECT doc_id, sum(CASE WHEN flat THEN price ELSE round(q0 * price, 2)::DECIMAL(18,2) END)::DECIMAL(18,2) AS subtotal,
               count(*) AS n_items
        FROM priced GROUP BY doc_id""",
    "taxed": f"""
        SELECT o_orderkey AS doc_id, coalesce(subtotal, 0)::DECIMAL(18,2) AS subtotal, coalesce(n_items, 0) AS n_items,
               CASE WHEN o_orderkey % 10 IN (1, 4, 7) THEN 0.00
                    ELSE round(coalesce(subtotal, 0)::DECIMAL(18,2) * (({_list(fv.TAX_RATES)})[o_orderkey % 5 + 1])::DECIMAL(5,4), 2)
               END::DECIMAL(18,2) AS tax
        FROM orders LEFT JOIN sums ON doc_id = o_orderkey""",
    "headers": f"""
        SELECT doc_id, o_orderpriority AS dataset, n_items, c_name || ' ' || c_mktsegment AS vendor_name,
               CASE WHEN doc_id % 4 <> 0 THEN 'INV-' || doc_id END AS invoice_number,
               CASE WHEN doc_id % 5 <> 0 THEN o_orderdate::DATE END AS invoice_date,
               CASE WHEN (doc_id // 10) % 10 NOT IN (2, 5, 8) THEN subtotal END AS subtotal,
               CASE WHEN doc_id % 10 NOT IN (1, 4, 7) THEN tax END AS tax_amount,
               (subtotal + tax)::DECIMAL(18,2) AS total_amount,
               ({_list(fv.CURRENCIES)})[o_custkey % 7 + 1] AS currency
        FROM taxed JOIN orders ON o_orderkey = doc_id JOIN customer ON c_custkey = o_custkey""",
    "item_text": f"""
        SELECT doc_id, string_agg({_label('bullet')} || concat_ws({_label('sep')}, description, q, u, t), {NL} ORDER BY pos) AS item_lines,
               string_agg({_item_json('description', 'q', 'u', 't')}, ',' ORDER BY pos) AS items_json
        FROM lines GROUP BY doc_id""",
    "pairs": f"""
        SELECT headers.*, items_json,
               concat_ws({NL}, {_label('banner')}, {_label('vendor')} || vendor_name, {_label('number')} || invoice_number,
                   {_label('date')} || invoice_date, item_lines, {_label('subtotal')} || subtotal, {_label('tax')} || tax_amount,
                   {_label('total')} || total_amount || ' ' || currency) AS raw_text,
               {_invoice_json('vendor_name', 'invoice_number', 'invoice_date', 'items_json', 'subtotal', 'tax_amount', 'total_amount', 'currency')} AS label
        FROM headers LEFT JOIN item_text USING (doc_id)""",
    "noisy": """
        SELECT * REPLACE (CASE WHEN doc_id % 6 = 0 THEN replace(short_text, '.', ',') ELSE short_text END AS raw_text)
        FROM (SELECT *, CASE WHEN doc_id % 4 = 0 THEN replace(raw_text, 'widget', 'wdgt') ELSE raw_text END AS short_text FROM pairs)""",
    "marked": f"""
        SELECT pairs.*, model, ({_list(views.DEFECTS)})[(doc_id * a + b) % {views.N_DEFECTS} + 1] AS defect
        FROM pairs, ({_ANSWERING})""",
    "found_items": """
        SELECT model, doc_id, pos, description,
               CASE WHEN defect = 'wrong_quantity' AND pos = 0 THEN (coalesce(q, 0) + 1)::DECIMAL(10,1) ELSE q END AS q,
               CASE WHEN defect = 'dated_price' AND pos = 0 THEN coalesce(day(invoice_date), 31)::DECIMAL(18,2) ELSE u END AS u, t
        FROM marked JOIN lines USING (doc_id) WHERE NOT (defect = 'dropped_item' AND pos = 0)
        UNION ALL
        SELECT model, doc_id, 1000000, 'Unlisted surcharge', 1.0, 7.77, 7.77 FROM marked WHERE defect = 'extra_item'""",
    "found_text": f"""
        SELECT model, doc_id, string_agg({_item_json('description', 'q', 'u', 't')}, ',' ORDER BY pos) AS found_json
        FROM found_items GROUP BY model, doc_id""",
    "found": f"""
        SELECT marked.*, {_VALID} AS valid, found_json,
               CASE defect WHEN 'reformatted' THEN '  ' || lower(replace(vendor_name, ' ', '  '))
                           WHEN 'wrong_vendor' THEN 'Somebody Else' ELSE vendor_name END AS f_vendor,
               CASE WHEN defect = 'wrong_date' THEN coalesce((invoice_date + 1)::DATE, DATE '1999-12-31') ELSE invoice_date END AS f_date,
               CASE defect WHEN 'negative_total' THEN '-5.00' WHEN 'reformatted' THEN total_amount || '0 '
                           WHEN 'near_total' THEN (total_amount + 0.05)::DECIMAL(18,2)::VARCHAR
                           WHEN 'wrong_total' THEN (total_amount + 1.00)::DECIMAL(18,2)::VARCHAR
                           ELSE total_amount::VARCHAR END AS f_total,
               CASE WHEN defect <> 'null_currency' THEN currency END AS f_currency
        FROM marked LEFT JOIN found_text USING (model, doc_id)""",
    "answers": f"""
        SELECT *, CASE defect WHEN 'fenced' THEN '```json' || {NL} || plain || {NL} || '```'
                              WHEN 'truncated' THEN substr(plain, 1, length(plain) // 2)
                              WHEN 'trailing' THEN plain || ' Hope this helps!'
                              WHEN 'numeric_vendor' THEN replace(plain, '"vendor_name":"' || vendor_name || '"', '"vendor_name":12345')
                              WHEN 'empty' THEN '' WHEN 'not_object' THEN '[' || plain || ']' ELSE plain END AS raw_output,
               CASE WHEN {_JSON_OK} THEN CASE defect WHEN 'null_currency' THEN 'currency:NULL' WHEN 'numeric_vendor' THEN 'vendor_name:NOT_A_STRING'
                    WHEN 'negative_total' THEN 'total_amount:NEGATIVE' WHEN 'not_object' THEN 'document:NOT_AN_OBJECT' ELSE '' END ELSE '' END AS errors
        FROM (SELECT *, {_invoice_json('f_vendor', 'invoice_number', 'f_date', 'found_json', 'subtotal', 'tax_amount', 'f_total', 'f_currency')} AS plain,
                     {_invoice_json('f_vendor', 'invoice_number', 'f_date', 'found_json', 'subtotal', 'tax_amount', 'trim(f_total)', 'f_currency')} AS typed
              FROM found)""",
    "outcome": f"""
        SELECT model, doc_id, model || '-' || doc_id AS job_id, valid AS success, CASE WHEN valid THEN typed END AS invoice_json,
               CASE WHEN defect = 'empty' THEN 'the model returned no text' WHEN NOT ({_JSON_OK}) THEN {_q(INVALID_JSON)}
                    WHEN NOT valid THEN {_q(INVALID_SCHEMA)} || errors END AS error,
               0.01::DOUBLE AS latency_seconds,
               round((length(raw_text)::DECIMAL(18,0) * 0.15 + length(raw_output)::DECIMAL(18,0) * 0.60) * 0.000001, 6)::DECIMAL(12,6) AS estimated_cost_usd,
               CASE model WHEN 'large' THEN 'openai/gpt-oss-120b' ELSE 'invoice-small' END AS model_name, model = 'small' AS fallback_used
        FROM answers""",
    "fields": """
        SELECT model, dataset, doc_id, valid, valid AND defect <> 'wrong_vendor' AS vendor_name, valid AS invoice_number,
               valid AND defect <> 'wrong_date' AS invoice_date, valid AS subtotal, valid AS tax_amount,
               valid AND defect NOT IN ('near_total', 'wrong_total') AS total_amount, valid AS currency
        FROM found""",
    "n_right": """
        SELECT model, dataset, doc_id, valid, vendor_name::INT + invoice_number::INT + invoice_date::INT + subtotal::INT
               + tax_amount::INT + total_amount::INT + currency::INT AS n_right FROM fields""",
    "both_sides": """
        SELECT model, dataset, doc_id, description, q, u, t, 1 AS g, 0 AS p FROM marked JOIN lines USING (doc_id)
        UNION ALL
        SELECT model, dataset, doc_id, description, q, u, t, 0, 1 FROM found JOIN found_items USING (model, doc_id) WHERE valid""",
    "stated": """
        SELECT doc_id, list(DISTINCT x) AS amounts FROM (
            SELECT doc_id, u AS x FROM lines UNION ALL SELECT doc_id, t FROM lines UNION ALL SELECT doc_id, subtotal FROM headers
            UNION ALL SELECT doc_id, tax_amount FROM headers UNION ALL SELECT doc_id, total_amount FROM headers) GROUP BY doc_id""",
    "invented": """
        SELECT model, doc_id, defect = 'truncated' AS truncated, (defect = 'extra_item' OR (defect = 'dated_price' AND n_items > 0
                   AND NOT list_contains(amounts, coalesce(day(invoice_date), 31)::DECIMAL(18,2))))::BIGINT AS items,
               ((defect = 'near_total' AND NOT list_contains(amounts, (total_amount + 0.05)::DECIMAL(18,2)))
                   OR (defect = 'wrong_total' AND NOT list_contains(amounts, (total_amount + 1.00)::DECIMAL(18,2))))::BIGINT AS amounts
        FROM marked JOIN stated USING (doc_id)""",
    "per_item": """
        SELECT model, dataset, doc_id, description, q, u, t, sum(g)::BIGINT AS g, sum(p)::BIGINT AS p
        FROM both_sides GROUP BY ALL""",
    "per_text": """
        SELECT model, dataset, doc_id, description, sum(g)::BIGINT AS g, sum(p)::BIGINT AS p, sum(least(g, p))::BIGINT AS complete
        FROM per_item GROUP BY ALL""",
    "item_scores": """
        SELECT model, dataset, sum(g)::BIGINT AS g, sum(p)::BIGINT AS p, sum(least(g, p))::BIGINT AS m, sum(complete)::BIGINT AS c
        FROM per_text GROUP BY ALL""",
    "results": f"""
        SELECT model, dataset, documents, {_PCT.format('valid_docs', 'documents')} AS valid_json,
               {_PCT.format('right_fields', 'documents * 7')} AS field_accuracy, {_PCT.format('m', 'g')} AS item_recall,
               {_PCT.format('m', 'p')} AS item_precision, {_PCT.format('c', 'g')} AS complete_item
        FROM (SELECT model, dataset, count(*) AS documents, count(*) FILTER (valid) AS valid_docs, sum(n_right)::BIGINT AS right_fields
              FROM n_right GROUP BY ALL) LEFT JOIN item_scores USING (model, dataset)""",
    "metric_rows": " UNION ALL ".join(
        f"SELECT model, dataset, '{m}' AS metric, {m} AS value FROM results"
        for m in ("valid_json", "field_accuracy", "item_recall", "item_precision", "complete_item")
    ),
    "error_rows": """
        SELECT model, doc_id, 'document' AS level, 'WRONG_VENDOR' AS code, 1 AS n FROM fields WHERE valid AND NOT vendor_name
        UNION ALL SELECT model, doc_id, 'document', 'WRONG_DATE', 1 FROM fields WHERE valid AND NOT invoice_date
        UNION ALL SELECT model, doc_id, 'document', 'WRONG_TOTAL', 1 FROM fields WHERE valid AND NOT total_amount
        UNION ALL SELECT model, doc_id, 'generation', 'TRUNCATION', 1 FROM found WHERE defect = 'truncated'
        UNION ALL SELECT model, doc_id, 'generation', 'HALLUCINATION', 1 FROM invented WHERE items + amounts > 0
        UNION ALL SELECT model, doc_id, 'line_item', 'MISSING_LINE_ITEMS', 1 FROM found WHERE defect = 'dropped_item' AND n_items > 0
        UNION ALL SELECT model, doc_id, 'line_item', 'EXTRA_LINE_ITEMS', 1 FROM found WHERE defect = 'extra_item'
        UNION ALL
        SELECT model, doc_id, 'line_item', 'WRONG_QUANTITY', sum(m)::BIGINT - sum(s)::BIGINT FROM (
            SELECT model, doc_id, description, least(sum(g), sum(p)) AS m, 0 AS s FROM per_item JOIN found USING (model, doc_id) WHERE valid GROUP BY ALL
            UNION ALL
            SELECT model, doc_id, description || coalesce(q, -1), 0, least(sum(g), sum(p)) FROM per_item JOIN found USING (model, doc_id) WHERE valid GROUP BY model, doc_id, description, q
        ) GROUP BY model, doc_id HAVING sum(m) > sum(s)
        UNION ALL
        SELECT model, doc_id, 'line_item', 'WRONG_UNIT_PRICE', sum(m)::BIGINT - sum(s)::BIGINT FROM (
            SELECT model, doc_id, description, least(sum(g), sum(p)) AS m, 0 AS s FROM per_item JOIN found USING (model, doc_id) WHERE valid GROUP BY ALL
            UNION ALL
            SELECT model, doc_id, description || coalesce(u, -1), 0, least(sum(g), sum(p)) FROM per_item JOIN found USING (model, doc_id) WHERE valid GROUP BY model, doc_id, description, u
        ) GROUP BY model, doc_id HAVING sum(m) > sum(s)
        UNION ALL SELECT model, doc_id, 'annotation', 'ANNOTATION_AMBIGUITY', 1 FROM labels, (SELECT unnest(['large', 'small']) AS model) WHERE quality = 0""",
    "staged": """
        SELECT model, doc_id, raw_text, CASE WHEN defect = 'empty' THEN 'error' WHEN NOT valid OR defect IN ('wrong_total', 'wrong_vendor') THEN 'roundtrip' ELSE 'passed' END AS stage
        FROM found""",
    "first_run": """
        SELECT 0 AS run, raw_text, CASE WHEN stage <> 'passed' THEN stage WHEN row_number() OVER (PARTITION BY stage, raw_text ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'kept' END AS status
        FROM staged WHERE model = 'large' AND doc_id % 2 = 0""",
    "told": """
        SELECT * FROM first_run UNION ALL
        SELECT 1, raw_text, CASE WHEN stage <> 'passed' THEN stage WHEN raw_text IN (SELECT raw_text FROM first_run WHERE status = 'kept')
               OR row_number() OVER (PARTITION BY stage, raw_text ORDER BY doc_id, model) > 1 THEN 'duplicate' ELSE 'kept' END FROM staged""",
    # generated invoices
    "gen": f"""
        SELECT o_orderkey AS doc_id,
               ({_list(t.replace('{name}', '%s') for t, _ in fv.VENDOR_TEMPLATES)})[{_draw('vendor')} % 8 + 1] AS template,
               ([{', '.join(_list(p) for _, p in fv.VENDOR_TEMPLATES)}])[{_draw('vendor')} % 8 + 1] AS pool,
               ({_list(fv.NAME_PREFIXES)})[{_draw('name')} % {len(fv.NAME_PREFIXES)} + 1] AS name,
               {_draw('items')} % 8 + 1 AS n, ({_list(fv.CURRENCIES)})[{_draw('currency')} % 7 + 1] AS currency,
               (({_list(fv.TAX_RATES)})[{_draw('rate')} % 5 + 1])::DECIMAL(5,4) AS rate
        FROM (SELECT o_orderkey, o_orderkey AS doc_id FROM orders)""",
    "gen_order": f"""
        SELECT doc_id, list(d ORDER BY r, d) AS shuffled
        FROM (SELECT doc_id, d, {_draw('order', 'd')} AS r FROM (SELECT doc_id, unnest(pool) AS d FROM gen)) GROUP BY doc_id""",
    "gen_items": f"""
        SELECT doc_id, i, description, CASE WHEN NOT flat THEN q END AS q, CASE WHEN NOT flat THEN u END AS u,
               CASE WHEN flat THEN t0 ELSE round(q::DECIMAL(10,1) * u, 2)::DECIMAL(18,2) END AS t
        FROM (SELECT doc_id, i, CASE WHEN i <= len(pool) THEN shuffled[i] ELSE pool[{_draw('again', 'i::VARCHAR')} % len(pool) + 1] END AS description,
                     {_fraction('flat', 'i::VARCHAR')} < {fv.FLAT_ITEM_RATE} AS flat,
                     ({_list(float(q) for q in fv.QUANTITIES)})[{_draw('quantity', 'i::VARCHAR')} % 7 + 1]::DOUBLE AS q,
                     {_cents(*fv.UNIT_PRICE_RANGE, _draw('price', 'i::VARCHAR'))} AS u,
                     {_cents(*fv.FLAT_TOTAL_RANGE, _draw('total', 'i::VARCHAR'))} AS t0
              FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM gen) JOIN gen_order USING (doc_id))""",
    "gen_sums": f"""
        SELECT doc_id, sum(t)::DECIMAL(18,2) AS subtotal, string_agg({_item_json('description', 'q', 'u', 't')}, ',' ORDER BY i) AS items_json
        FROM gen_items GROUP BY doc_id""",
    "gen_money": f"""
        SELECT *, CASE WHEN {_fraction('omit-tax')} < {fv.OMIT_TAX} THEN NULL ELSE round(subtotal * rate, 2)::DECIMAL(18,2) END AS tax
        FROM gen JOIN gen_sums USING (doc_id)""",
}
_DEPENDS = {
    "lines": ["priced"], "sums": ["priced"], "taxed": ["sums"], "headers": ["taxed"], "item_text": ["lines"],
    "pairs": ["headers", "item_text"], "noisy": ["pairs"], "marked": ["pairs"], "found_items": ["marked", "lines"],
    "found_text": ["found_items"], "found": ["marked", "found_text"], "answers": ["found"], "outcome": ["answers"],
    "fields": ["found"], "n_right": ["fields"], "both_sides": ["found", "found_items"], "per_item": ["both_sides"],
    "per_text": ["per_item"], "item_scores": ["per_text"], "results": ["n_right", "item_scores"],
    "metric_rows": ["results"], "error_rows": ["fields", "found", "per_item", "invented"], "stated": ["lines", "headers"], "staged": ["found"], "first_run": ["staged"], "told": ["first_run"], "invented": ["marked", "stated"], "gen_order": ["gen"],
    "gen_items": ["gen_order"], "gen_sums": ["gen_items"], "gen_money": ["gen_sums"],
}


def _needed(name: str, seen: list[str]) -> None:
    for other in _DEPENDS.get(name, []):
        _needed(other, seen)
    if name not in seen:
        seen.append(name)


def _with(sql: str, *names: str) -> str:
    seen: list[str] = []
    for name in names:
        _needed(name, seen)
    ctes = ", ".join(f"{name} AS ({CTES[name]})" for name in seen)
    return f"WITH {ctes} {sql}" if seen else sql


_STATS = """count(*) AS total_requests, count(*) FILTER (success) AS successful_requests,
    round(count(*) FILTER (success)::DOUBLE / count(*), 4) AS success_rate, round(avg(latency_seconds), 3) AS average_latency_seconds,
    round(sum(estimated_cost_usd)::DOUBLE, 6) AS total_estimated_cost_usd"""
_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_RECENT = "(SELECT * FROM request_log ORDER BY created_at DESC, job_id LIMIT 20)"
_MONEY = """CASE WHEN trim(coalesce({0}, '')) = '' THEN 'Not detected' WHEN try_cast({0} AS DOUBLE) IS NULL THEN concat_ws(' ', {1}, {0})
    ELSE concat_ws(' ', {1}, format('{{:,.2f}}', try_cast({0} AS DOUBLE))) END"""
_SHOWN = "coalesce(nullif(trim({0}), ''), '{1}')"
_IS_TEST = """list_reduce(list_transform(range(0, 8), lambda i: ('0x' || substr(sha256({0}), (i * 8 + 1)::INT, 8))::BIGINT),
    lambda r, x: (r * 7296 + x) % 10000)"""


def statements() -> dict[str, str]:
    """SQL per query name."""
    out: dict[str, str] = {}

    def add(name: str, sql: str, *ctes: str) -> None:
        out[name] = _with(sql, *ctes)

    # scans, sources, sinks
    add("scan_pairs", "SELECT vendor_name, invoice_number, total_amount::VARCHAR AS total_amount, n_items, length(raw_text) AS n_chars FROM pairs", "pairs")
    add("scan_train", "SELECT md5(raw_text) AS document_md5, md5(label) AS completion_md5 FROM pairs", "pairs")
    add("scan_documents", f"""SELECT folder, length(body) AS n_chars, md5(body) AS text_md5 FROM
        (SELECT doc_id // 50 AS folder, string_agg(text || {NL}, '' ORDER BY doc_id) AS body FROM documents GROUP BY 1)""")
    add("scan_request_log", f"""SELECT job_id, model_name, success, error, latency_seconds, estimated_cost_usd,
        {_STAMP.format('created_at')} AS created_at, created_at::DATE::VARCHAR AS created_date FROM request_log""", "request_log")
    add("idempotent_append", f"SELECT job_id, model_name, success, {_STAMP.format('created_at')} AS created_at FROM request_log", "request_log")
    add("sink_roundtrip", f"""SELECT CASE WHEN {_IS_TEST.format('raw_text')} < 1500 THEN 'test' ELSE 'train' END AS side,
        md5(raw_text) AS text_md5, md5(label) AS label_md5 FROM pairs""", "pairs")
    add("append_history", "SELECT currency, count(*) AS n, sum(length(raw_text))::BIGINT AS chars FROM pairs GROUP BY currency", "pairs")

    # document preparation
    prompt = f"({_HEAD} || text || {_TAIL})"
    add("build_prompt", f"SELECT doc_id, length({prompt}) AS prompt_chars, md5({prompt}) AS prompt_md5 FROM documents")
    add("invert_prompt", f"SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE {_TRIMMED.format('text')} END) AS document_md5 FROM documents")
    add("reject_blank", "SELECT doc_id, CASE WHEN doc_id % 25 = 0 THEN 'rejected' ELSE 'accepted' END AS status FROM documents")
    add("format_training", f"SELECT doc_id, md5({_HEAD} || raw_text || {_TAIL}) AS prompt_md5, label AS completion FROM pairs", "pairs")

    # extraction
    add("apply_model", "SELECT doc_id, NULL::VARCHAR AS model_error, TRUE AS valid, label AS invoice_json FROM pairs", "pairs")
    fixed_words = len((default_instructions() + fv.TEXT_MARK + "\n" + fv.END_MARK).split())
    add("fixed_client", f"""SELECT doc_id, {_WORDS.format('text')} + {fixed_words} AS input_tokens, 0.01::DOUBLE AS latency_seconds,
        0::DECIMAL(12,6) AS estimated_cost_usd, TRUE AS valid, 'Fake Vendor Inc' AS vendor_name FROM documents""")
    add("route_fallback", """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 < 3 THEN 'primary' ELSE 'fallback' END AS model_used,
        o_orderkey % 5 >= 3 AS fallback_used, CASE WHEN o_orderkey % 5 = 4 THEN 'UnknownLayout: unknown layout' END AS model_error,
        CASE WHEN o_orderkey % 5 = 4 THEN 0.0 ELSE 0.01 END::DOUBLE AS latency_seconds FROM orders""")
    add("route_on_invalid", """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 IN (0, 2) THEN 'primary' ELSE 'fallback' END AS model_used,
        o_orderkey % 5 NOT IN (0, 2) AS fallback_used, TRUE AS valid,
        CASE WHEN o_orderkey % 5 = 1 THEN 0.02 ELSE 0.01 END::DOUBLE AS latency_seconds FROM orders""")
    large = "WHERE model = 'large'"
    add("empty_output", f"SELECT doc_id, CASE WHEN raw_output = '' THEN 'the model returned no text' END AS error FROM answers {large}", "answers")
    add("json_gate", f"SELECT doc_id, {_JSON_OK} AS json_valid FROM marked {large}", "marked")
    add("schema_gate", f"SELECT doc_id, {_JSON_OK} AS json_valid, valid, errors FROM answers {large}", "answers")
    add("typed_invoice", f"SELECT doc_id, CASE WHEN valid THEN typed END AS invoice_json FROM answers {large}", "answers")
    add("outcomes", """SELECT job_id, success, invoice_json, error, latency_seconds, estimated_cost_usd, model_name, fallback_used FROM outcome""", "outcome")
    add("cost_estimate", f"""SELECT doc_id, model_used, input_tokens, output_tokens, round((input_tokens::DECIMAL(18,0) * p_in + output_tokens::DECIMAL(18,0) * p_out) * 0.000001, 6)::DECIMAL(12,6) AS estimated_cost_usd
        FROM (SELECT doc_id, ({_list(views.MODELS)})[doc_id % 3 + 1] AS model_used, {_WORDS.format('text')} AS input_tokens, length(text) AS output_tokens,
              CASE WHEN doc_id % 3 = 1 THEN 0.075 ELSE 0.15 END::DECIMAL(12,6) AS p_in, CASE WHEN doc_id % 3 = 1 THEN 0.30 ELSE 0.60 END::DECIMAL(12,6) AS p_out FROM documents)""")
    add("canonical_json", f"""SELECT doc_id, {_JSON_OK} AS parsed, TRUE AS stable, CASE WHEN NOT ({_JSON_OK}) THEN trim(raw_output) END AS kept_text,
        CASE WHEN {_JSON_OK} AND defect <> 'not_object' THEN invoice_number END AS invoice_number FROM answers {large}""", "answers")
    add("baseline_table", f"""SELECT job_id, CASE WHEN success THEN 'PASS' ELSE 'FAIL' END AS result, latency_seconds, estimated_cost_usd,
        CASE WHEN success THEN '' ELSE substr(error, 1, 40) END AS notes FROM outcome {large}""", "outcome")

    # request log
    add("stats_global", f"SELECT {_STATS} FROM request_log", "request_log")
    add("stats_by_model", f"SELECT model_name, {_STATS} FROM request_log GROUP BY model_name", "request_log")
    out["stream_stats"] = out["log_stats"] = out["stats_by_model"]
    add("recent_topk", f"""SELECT job_id, model_name, success, error, vendor_name, invoice_number, invoice_date, total_amount, currency,
        latency_seconds, estimated_cost_usd, {_STAMP.format('created_at')} AS created_at FROM {_RECENT}""", "request_log")
    out["log_recent"] = out["recent_topk"]
    add("latency_trend", f"""SELECT 'Job ' || row_number() OVER (ORDER BY created_at, job_id DESC) AS job,
        {_SHOWN.format('invoice_number', 'Unknown')} AS invoice, latency_seconds FROM {_RECENT} WHERE latency_seconds IS NOT NULL""", "request_log")
    add("recent_report", f"""SELECT job_id, {_SHOWN.format('invoice_number', 'Not detected')} AS invoice, {_SHOWN.format('vendor_name', 'Not detected')} AS vendor,
        {_MONEY.format('total_amount', 'currency')} AS total, CASE WHEN success THEN 'success' ELSE 'failed' END AS status, model_name AS model,
        format('{{:.2f}}s', latency_seconds) AS latency, format('${{:.6f}}', estimated_cost_usd::DOUBLE) AS cost FROM {_RECENT}""", "request_log")
    add("item_table", f"""SELECT doc_id, pos AS item_pos, description, q::DOUBLE AS qty, {_MONEY.format('u::VARCHAR', 'currency')} AS unit_price,
        {_MONEY.format('t::VARCHAR', 'currency')} AS total FROM lines JOIN headers USING (doc_id)""", "lines", "headers")

    # labelled-dataset building
    number = f"""'INV-' || ({_draw('number')} % 9000 + 1000) || '-' || chr(({_draw('letter1')} % 26 + 65)::INT) || chr(({_draw('letter2')} % 26 + 65)::INT)"""
    day = f"(DATE '2024-12-31' - ({_draw('date')} % {fv.DATE_WINDOW_DAYS + 1})::INT)::DATE::VARCHAR"
    label = _invoice_json(
        "replace(template, '%s', name)",
        f"CASE WHEN {_fraction('omit-number')} < {fv.OMIT_NUMBER} THEN NULL ELSE {number} END",
        f"CASE WHEN {_fraction('omit-date')} < {fv.OMIT_DATE} THEN NULL ELSE {day} END",
        "items_json",
        f"CASE WHEN {_fraction('omit-subtotal')} < {fv.OMIT_SUBTOTAL} THEN NULL ELSE subtotal END",
        "tax", "(subtotal + coalesce(tax, 0))::DECIMAL(18,2)", "currency",
    )
    add("generate_invoices", f"SELECT doc_id, {label} AS label FROM gen_money", "gen_money")
    add("invoice_totals", "SELECT doc_id, n_items, taxed.subtotal, tax, (taxed.subtotal + tax)::DECIMAL(18,2) AS total FROM taxed WHERE n_items > 0", "taxed")
    add("assemble_invoices", "SELECT doc_id, '[' || coalesce(items_json, '') || ']' AS items FROM pairs", "pairs")
    add("omit_fields", "SELECT doc_id, invoice_number, invoice_date::VARCHAR AS invoice_date, subtotal, tax_amount, total_amount FROM headers", "headers")
    add("render_text", "SELECT doc_id, raw_text FROM pairs", "pairs")
    add("roundtrip_filter", """SELECT doc_id, total_amount::VARCHAR AS target_total, trim(f_total) AS found_total FROM found
        WHERE model = 'large' AND valid AND defect NOT IN ('wrong_total', 'wrong_vendor')""", "found")
    add("dedup_texts", """SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents
        WHERE text NOT IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY text""")
    add("hash_split", f"SELECT doc_id, bucket, bucket < 1500 AS is_test FROM (SELECT doc_id, {_IS_TEST.format('text')} AS bucket FROM documents)")
    add("build_counters", """SELECT status, count(*) AS n FROM (
        SELECT CASE WHEN stage <> 'passed' THEN stage WHEN row_number() OVER (PARTITION BY stage, raw_text ORDER BY doc_id, model) > 1 THEN 'duplicate' ELSE 'kept' END AS status
        FROM (SELECT *, CASE WHEN defect = 'empty' THEN 'error' WHEN NOT valid OR defect IN ('wrong_total', 'wrong_vendor') THEN 'roundtrip' ELSE 'passed' END AS stage FROM found))
        GROUP BY status""", "found")
    add("build_counters_history", """SELECT status, count(*) AS n FROM (
        SELECT CASE WHEN stage <> 'passed' THEN stage WHEN row_number() OVER (PARTITION BY stage, raw_text ORDER BY doc_id, model) > 1 OR (stage = 'passed' AND raw_text IN (SELECT raw_text FROM pairs WHERE doc_id % 10 = 0)) THEN 'duplicate' ELSE 'kept' END AS status
        FROM (SELECT *, CASE WHEN defect = 'empty' THEN 'error' WHEN NOT valid OR defect IN ('wrong_total', 'wrong_vendor') THEN 'roundtrip' ELSE 'passed' END AS stage FROM found))
        GROUP BY status""", "found")

    add("build_dataset", f"""SELECT run, status, count(k) AS n FROM (
            SELECT * FROM (VALUES (0, 'error'), (0, 'roundtrip'), (0, 'duplicate'), (0, 'kept'), (1, 'error'), (1, 'roundtrip'), (1, 'duplicate'), (1, 'kept')) v(run, status))
        LEFT JOIN (SELECT run, status, 1 AS k FROM told) USING (run, status) GROUP BY run, status
        UNION ALL SELECT 1, CASE WHEN {_IS_TEST.format('raw_text')} < 1500 THEN 'test' ELSE 'train' END, count(*) FROM told WHERE status = 'kept' GROUP BY ALL""", "told")

    # dataset profile
    add("vendor_profile", """SELECT vendor_name, n, (SELECT count(*) FROM headers) AS total_rows, (SELECT count(DISTINCT vendor_name) FROM headers) AS distinct_vendors
        FROM (SELECT vendor_name, count(*) AS n, min(doc_id) AS first_position FROM headers GROUP BY vendor_name ORDER BY n DESC, first_position LIMIT 5)""", "headers")
    add("currency_share", """SELECT currency, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM headers), 4) AS share FROM headers GROUP BY currency""", "headers")
    add("item_count_stats", "SELECT min(n_items) AS min_items, max(n_items) AS max_items, round(avg(n_items), 4) AS avg_items FROM headers", "headers")
    add("omission_rates", " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER ({f} IS NULL) AS missing, round(count(*) FILTER ({f} IS NULL)::DOUBLE / count(*), 4) AS rate FROM headers"
        for f in ("invoice_number", "invoice_date", "subtotal", "tax_amount")), "headers")
    add("text_length_stats", "SELECT min(length(raw_text)) AS min_chars, max(length(raw_text)) AS max_chars, round(avg(length(raw_text)), 4) AS avg_chars FROM pairs", "pairs")
    add("missing_descriptions", """SELECT count(*) AS n_items, count(*) FILTER (NOT contains(lower(raw_text), lower(description))) AS missing
        FROM noisy JOIN lines USING (doc_id)""", "noisy", "lines")
    add("missing_totals", "SELECT count(*) AS n, count(*) FILTER (NOT contains(raw_text, total_amount::VARCHAR)) AS missing FROM noisy", "noisy")
    add("duplicate_count", "SELECT count(*) AS n, count(*) - count(DISTINCT text) AS duplicates FROM documents")
    add("flagged_items", """SELECT doc_id, pos AS item_pos, description, t::VARCHAR AS total, raw_text FROM noisy JOIN lines USING (doc_id)
        WHERE NOT contains(lower(raw_text), lower(description)) ORDER BY doc_id, pos LIMIT 15""", "noisy", "lines")

    # evaluation
    add("normalise_fields", r"""SELECT doc_id, lower(trim(regexp_replace(f_vendor, '\s+', ' ', 'g'))) AS vendor_name,
        trim(f_total)::DECIMAL(18,2) AS total_amount, trim(f_total)::DECIMAL(18,2) AS from_display FROM found WHERE model = 'large' AND valid""", "found")
    add("field_accuracy", f"""SELECT model, sum(n_right)::BIGINT AS correct, count(*) * 7 AS evaluated, {_PCT.format('sum(n_right)', 'count(*) * 7')} AS accuracy
        FROM n_right GROUP BY model""", "n_right")
    add("per_field_accuracy", " UNION ALL ".join(
        f"SELECT model, '{f}' AS field, count(*) FILTER ({f}) AS correct, count(*) AS documents, {_PCT.format(f'count(*) FILTER ({f})', 'count(*)')} AS accuracy FROM fields GROUP BY model"
        for f in fv.FIELD_ERRORS), "fields")
    add("valid_rate", f"""SELECT model, dataset, count(*) AS documents, count(*) FILTER (valid) AS valid, {_PCT.format('count(*) FILTER (valid)', 'count(*)')} AS valid_rate
        FROM found GROUP BY ALL""", "found")
    add("item_prf", f"""SELECT model, dataset, g AS label_items, p AS predicted_items, m AS matched, {_PCT.format('m', 'g')} AS item_recall,
        {_PCT.format('m', 'p')} AS item_precision, {_PCT.format('2 * m', '(g + p)')} AS item_f1 FROM item_scores""", "item_scores")
    add("complete_item", f"SELECT model, sum(g)::BIGINT AS label_items, sum(c)::BIGINT AS complete, {_PCT.format('sum(c)', 'sum(g)')} AS complete_item FROM item_scores GROUP BY model", "item_scores")
    add("missing_extra_items", """SELECT model, doc_id, lower(description) AS description, CASE WHEN g > p THEN 'missing' ELSE 'extra' END AS kind, abs(g - p) AS copies
        FROM per_text WHERE g <> p""", "per_text")
    add("error_taxonomy", "SELECT model, level, code, count(*) AS examples, sum(n)::BIGINT AS errors FROM error_rows GROUP BY ALL", "error_rows")
    add("hallucination_flags", "SELECT model, doc_id, items AS hallucinated, amounts AS hallucinated_amounts, truncated FROM invented", "invented")
    add("evidence_spans", """SELECT doc_id, (invoice_date IS NOT NULL)::BIGINT AS dates, coalesce(n, 0) + (subtotal IS NOT NULL)::BIGINT + (tax_amount IS NOT NULL)::BIGINT + 1 AS amounts,
        coalesce(n_q, 0) AS quantities, 1 + (invoice_number IS NOT NULL)::BIGINT AS codes, TRUE AS aligned
        FROM headers LEFT JOIN (SELECT doc_id, count(t) + count(u) AS n, count(q) AS n_q FROM lines GROUP BY doc_id) USING (doc_id)""", "headers", "lines")
    add("results_table", "SELECT * FROM results", "results")
    add("model_delta", """SELECT dataset, metric, b.value AS before, a.value AS after, round(a.value - b.value, 2) AS delta
        FROM metric_rows a JOIN metric_rows b USING (dataset, metric) WHERE a.model = 'large' AND b.model = 'small'""", "metric_rows")
    add("sample_check", """SELECT doc_id, n_right AS fields_right, coalesce(g, 0) AS label_items, coalesce(p, 0) AS predicted_items, coalesce(c, 0) AS complete,
        n_right = 7 AND coalesce(c, 0) = coalesce(g, 0) AND coalesce(c, 0) = coalesce(p, 0) AS passed
        FROM (SELECT doc_id, n_right::BIGINT AS n_right FROM n_right WHERE model = 'large')
        LEFT JOIN (SELECT doc_id, sum(g)::BIGINT AS g, sum(p)::BIGINT AS p, sum(complete)::BIGINT AS c FROM per_text WHERE model = 'large' GROUP BY doc_id) USING (doc_id)""", "n_right", "per_text")
    add("run_artifacts", """SELECT 'run-1' AS run_id, '1' AS prompt_version, 'temperature=0' AS config, model, dataset, metric, value, examples, normalised
        FROM metric_rows JOIN (SELECT model, dataset, count(*) AS examples, count(*) FILTER (valid) AS normalised FROM found GROUP BY ALL) USING (model, dataset)""", "metric_rows", "found")

    # training rows
    n_words = _WORDS.format("text")
    done = f"CASE WHEN doc_id % 7 = 0 THEN {n_words} ELSE 2 END"
    add("pack_training_rows", f"""SELECT doc_id, 512::BIGINT AS length, least(512, c + least(4 + n, greatest(512 - c, 0))) AS real_tokens, least(c, 512) AS label_tokens, TRUE AS aligned
        FROM (SELECT doc_id, {n_words} AS n, {done} AS c FROM documents)""")
    add("pack_subword_rows", "SELECT doc_id, 512::BIGINT AS length, TRUE AS spells_completion, TRUE AS labels_are_inputs, TRUE AS rest_is_masked FROM documents")
    add("train_valid_split", """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= ceil(0.1 * (SELECT count(*) FROM documents)) THEN 'valid' ELSE 'train' END AS split FROM documents""")

    # streams
    add("stream_extract", """SELECT doc_id::VARCHAR AS job_id, doc_id % 5 <> 4 AS success, CASE WHEN doc_id % 5 < 3 THEN 'primary' ELSE 'fallback' END AS model_name,
        CASE WHEN doc_id % 5 = 4 THEN 'UnknownLayout: unknown layout' END AS error, CASE WHEN doc_id % 5 <> 4 THEN total_amount::VARCHAR END AS total_amount FROM headers""", "headers")
    add("stream_idempotent", "SELECT job_id, model_name, success, estimated_cost_usd FROM request_log", "request_log")
    return out
