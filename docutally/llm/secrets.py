"""Secret scan over a trigram inverted index, in DataFrame functions only.

Method: every rule's regex is analysed once on the driver for the trigrams that each of its
matches must contain, as an OR of ANDs (:func:`trigram_query`). The index holds postings
(trigram, document) for the trigrams the rules ask for. Postings are intersected per clause by
counting, and only documents that pass are verified with the rule's regex. Rules without a
mandatory trigram are run on every document. Trigrams are folded to lower case, which only
widens the candidate set.

Scale: one row per (document, trigram) is shuffled for the intersection; texts move once, for the
join with the candidates. No group is ever collected beyond the rules of one document.

Defined results: null text counts as empty and has no span; a null id is a value like any other;
rows that share an id are each scanned on their own text (candidates of an id are the union over its rows); an
empty table gives an empty result. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docutally.llm.common import text_or_empty

_parser = re._parser
_constants = re._constants
#: More alternatives than this in a trigram query and the rule scans fully instead.
MAX_CLAUSES = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: In the order in which kinds are listed at one start.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)


def _strings(tree, limit: int) -> list[list[str]]:
    """Alternatives of a parsed regex; each a list of literal runs that every match contains in order.

    An empty string inside an alternative marks a break: what stands there is not fixed.
    """
    out: list[list[str]] = [[""]]
    for op, value in tree:
        if op is _constants.LITERAL:
            options = [[chr(value).lower()]]
        elif op is _constants.SUBPATTERN:
            options = _strings(value[3], limit)
        elif op is _constants.BRANCH:
            options = [o for branch in value[1] for o in _strings(branch, limit)]
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[:2] == (0, 1):
            options = [[""], *_strings(value[2], limit)] if len(out) < limit else [["", ""]]
        elif op is _constants.IN and all(o is _constants.LITERAL for o, _ in value) and len({chr(c).lower() for _, c in value}) == 1:
            options = [[chr(value[0][1]).lower()]]
        elif op is _constants.AT:
            options = [[""]]
        else:
            options = [["", ""]]
        out = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in out for b in options]
        if len(out) > limit:
            return [["", ""]]
    return out


def trigram_query(pattern: str) -> list[list[str]] | None:
    """OR of ANDs of lower-case trigrams that any match must contain; None where there are none."""
    clauses = []
    for runs in _strings(_parser.parse(pattern), MAX_CLAUSES):
        grams = {run[i : i + 3] for run in runs for i in range(len(run) - 2)}
        grams = {g for g in grams if g.isascii()}
        if not grams:
            return None
        clauses.append(grams)
    # A clause that asks for more than another one adds nothing.
    kept = [c for i, c in enumerate(clauses) if not any(d < c or (d == c and j < i) for j, d in enumerate(clauses))]
    return [sorted(c) for c in kept]


def postings(docs: DataFrame, grams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (gram, id) for each of ``grams`` in the lower-cased text: the inverted index."""
    low = F.lower(text_or_empty(text_col))
    found = F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in grams])
    return docs.select(F.explode(F.array_compact(found)).alias("gram"), F.col(id_col).alias("id"))


def candidates(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """Rows (id, kinds): the indexed rules whose trigram query each document meets."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    if not queries:
        return None
    clauses = [(kind, i, g, len(c)) for kind, q in queries.items() for i, c in enumerate(q) for g in c]
    grams = sorted({g for _, _, g, _ in clauses})
    asked = F.create_map(
        *[
            x
            for g in grams
            for x in (
                F.lit(g),
                F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("clause"), F.lit(n).alias("need")) for k, i, h, n in clauses if h == g]),
            )
        ]
    )
    # distinct first: rows that share an id may repeat a posting
    found = postings(docs, grams, id_col, text_col).distinct()
    met = (
        found.select("id", F.inline(asked[F.col("gram")]))
        .groupBy("id", "kind", "clause", "need")
        .count()
        .filter(F.col("count") == F.col("need"))
    )
    return met.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end, kind), in code points, of the rule's leftmost matches."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    before = F.split(text, rule.pattern, -1)
    if rule.group == 0 and rule.pattern.endswith("+"):
        # A run of one class is kept or dropped whole, so the least length can be part of the pattern.
        head = re.match(r"[A-Za-z]*(?=\[)", rule.pattern).group() if re.fullmatch(r"[A-Za-z]*\[[^\]]+\]\+", rule.pattern) else None
        if head is not None:
            tight = f"{rule.pattern[:-1]}{{{rule.least - len(head)},}}"
            whole = value = F.regexp_extract_all(text, F.lit(tight), F.lit(0))
            before = F.split(text, tight, -1)
    parts = F.arrays_zip(before.alias("before"), whole.alias("whole"), value.alias("value"))
    empty = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")

    def step(state, part):
        start = state["at"] + F.length(part["before"])
        end = start + F.length(part["whole"])
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = F.length(part["value"]) >= rule.least
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(keep, F.array_append(state["out"], span)).otherwise(state["out"]).alias("out"),
        )

    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.aggregate(parts, state, step, lambda s: s["out"])


def find_secrets(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """Rows (id_col, text_col, *keep, spans): spans sorted by start, then by the order of the rules."""
    found = candidates(docs, rules, id_col, text_col)
    base = docs.select(id_col, F.col(text_col).alias("_text"), F.struct(*keep).alias("_keep") if keep else F.lit(None).alias("_keep"))
    if found is not None:
        base = base.join(found, base[id_col].eqNullSafe(found["id"]), "left").drop("id")
    text = text_or_empty("_text")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    spans = []
    for order, rule in enumerate(rules):
        own = _spans(text, rule, order)
        spans.append(own if trigram_query(rule.pattern) is None else F.when(F.array_contains("kinds", rule.kind), own).otherwise(none))
    every = reduce(lambda a, b: F.concat(a, b), spans)
    out = base.withColumn("spans", F.array_sort(every))
    return out.select(id_col, F.col("_text").alias(text_col), *[F.col("_keep")[c].alias(c) for c in keep], "spans")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every run of overlapping spans replaced by ``mark``. Null stays null."""

    def step(state, span):
        inside = span["start"] < state["at"]
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(inside, state["out"]).otherwise(F.concat(state["out"], F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mark))).alias("out"),
        )

    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    from docutally.llm.common import prepare, table

    found = find_secrets(table(prepare(spark), sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = listed(F.col("spans"))
    return found.select("doc_id", *[count(r.kind) for r in RULES], F.sha2(every, 256).alias("base_sha256"), every.alias("spans"))


_ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _sql_kind(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    return f"""
    SELECT doc_id, '{kind}' AS kind, {order} AS ord, start_at, start_at + length(whole) AS end_at
    FROM (
      SELECT doc_id, unnest(w) AS whole, unnest(v) AS value,
             unnest(list_transform(range(1, len(w) + 1), lambda i:
               list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0)))::BIGINT AS start_at
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS w, regexp_extract_all(t, '{pattern}', {group}) AS v,
                   string_split_regex(t, '{pattern}') AS b FROM texts)
      WHERE len(w) > 0)
    WHERE length(value) >= {least}"""


OP7_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_sql_kind("assign", 0, _ASSIGN, 2, 6)} UNION ALL {_sql_kind("access", 1, "AKIA[A-Z0-9]+", 0, 20)} UNION ALL {_sql_kind("hex", 2, "[0-9a-f]{24,}", 0, 24)}),
lists AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, ord) AS spans
  FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN lists USING (doc_id)
"""
